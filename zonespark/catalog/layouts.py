"""Imported layouts and previews."""

from pyspark.sql import functions as F

from zonespark.catalog.registry import query
from zonespark.catalog.zones import UNION_CTES, UNION_VIEWS
from zonespark.operators import layouts as L
from zonespark.operators import zones as Z
from zonespark.schemas import LAYOUT_KEY, ZONE

_KEY = "combo, ref_width, ref_height"
_ZONE = "x, y, width, height, note"

_MERGE = f""", fresh AS (
 SELECT {_KEY}, {_ZONE}, min(ord) AS ord FROM lay2 n
 WHERE EXISTS (SELECT 1 FROM lays k WHERE k.combo = n.combo AND k.ref_width = n.ref_width AND k.ref_height = n.ref_height)
 AND NOT EXISTS (SELECT 1 FROM lay z WHERE z.combo = n.combo AND z.ref_width = n.ref_width AND z.ref_height = n.ref_height
  AND z.x = n.x AND z.y = n.y AND z.width = n.width AND z.height = n.height AND z.note = n.note)
 GROUP BY {_KEY}, {_ZONE}),
fresh_counts AS (SELECT {_KEY}, count(*) AS fresh FROM fresh GROUP BY {_KEY}),
new_layouts AS (
 SELECT * FROM lays2 n WHERE NOT EXISTS (SELECT 1 FROM lays k WHERE k.combo = n.combo AND k.ref_width = n.ref_width AND k.ref_height = n.ref_height))
"""
_MERGE_VIEWS = ("lays", "lays2")


def _layouts(t):
    return t.lays, t.lay.drop("promoted")


def _merged(t):
    return L.merge_layouts(*_layouts(t), t.lays2, t.lay2)


@query(
    "J7_merge_layouts",
    _MERGE + f"""SELECT l.combo, l.ref_width, l.ref_height, l.promoted AND f.fresh IS NULL AS promoted, l.layout_idx FROM lays l
LEFT JOIN fresh_counts f ON f.combo = l.combo AND f.ref_width = l.ref_width AND f.ref_height = l.ref_height
UNION ALL SELECT {_KEY}, false, layout_idx + (SELECT max(layout_idx) + 1 FROM lays) FROM new_layouts""",
    _MERGE_VIEWS,
)
def merge_layouts(t):
    return _merged(t)[0]


@query(
    "J7_merge_layout_zones",
    _MERGE + f"""SELECT {_KEY}, ord, {_ZONE} FROM lay
UNION ALL SELECT f.combo, f.ref_width, f.ref_height, (SELECT max(l.ord) FROM lay l WHERE l.combo = f.combo
 AND l.ref_width = f.ref_width AND l.ref_height = f.ref_height) + 1 + f.ord, f.x, f.y, f.width, f.height, f.note FROM fresh f
UNION ALL SELECT n.combo, n.ref_width, n.ref_height, n.ord, n.x, n.y, n.width, n.height, n.note FROM lay2 n
 JOIN new_layouts k ON k.combo = n.combo AND k.ref_width = n.ref_width AND k.ref_height = n.ref_height""",
    _MERGE_VIEWS,
)
def merge_layout_zones(t):
    return _merged(t)[1]


@query(
    "J7_merge_outcome",
    _MERGE + """SELECT n.combo, n.ref_width, n.ref_height, CASE WHEN k.combo IS NULL THEN 'added' WHEN f.fresh > 0 THEN 'merged' ELSE 'unchanged' END AS outcome,
 coalesce(f.fresh, 0) AS fresh_zones FROM lays2 n
LEFT JOIN lays k ON k.combo = n.combo AND k.ref_width = n.ref_width AND k.ref_height = n.ref_height
LEFT JOIN fresh_counts f ON f.combo = n.combo AND f.ref_width = n.ref_width AND f.ref_height = n.ref_height""",
    _MERGE_VIEWS,
)
def merge_outcome(t):
    return _merged(t)[2]


@query(
    "J8_matching_layouts",
    """SELECT i.image_id, i.import_idx, i.combo, l.ref_width, l.ref_height, l.promoted, l.layout_idx FROM img i
JOIN lays2 l ON l.combo = i.combo AND l.ref_width = i.width AND l.ref_height = i.height""",
    ("img", "lays2"),
)
def matching_layouts(t):
    return L.matching_layouts(t.img, t.lays2)


_OWN = """, own AS (
 SELECT i.image_id, i.combo, i.width AS ref_width, i.height AS ref_height, z.x, z.y, z.width, z.height, z.note
 FROM img i JOIN zon z ON z.image_id = i.image_id AND z.frame_index = i.open_frame
 WHERE EXISTS (SELECT 1 FROM nz n WHERE n.image_id = z.image_id AND n.frame_index = z.frame_index AND n.ord = z.ord)),
sizes AS (SELECT combo, ref_width, ref_height, count(*) AS n FROM uni GROUP BY combo, ref_width, ref_height),
shared AS (
 SELECT o.image_id, count(*) AS n FROM (SELECT DISTINCT * FROM own) o
 JOIN uni u ON u.combo = o.combo AND u.ref_width = o.ref_width AND u.ref_height = o.ref_height AND u.x = o.x AND u.y = o.y
  AND u.width = o.width AND u.height = o.height AND u.note = o.note GROUP BY o.image_id),
mine AS (SELECT image_id, count(*) AS n FROM own GROUP BY image_id)
"""


@query(
    "J9_preview_counts",
    _OWN + """SELECT i.image_id, CASE WHEN i.combo = '' THEN 'frame' ELSE 'union' END AS scope,
 CASE WHEN i.combo = '' THEN coalesce(m.n, 0) ELSE coalesce(s.n, 0) END AS zones,
 CASE WHEN i.combo = '' THEN 0 ELSE coalesce(s.n, 0) - coalesce(h.n, 0) END AS extra
FROM img i LEFT JOIN sizes s ON s.combo = i.combo AND s.ref_width = i.width AND s.ref_height = i.height
LEFT JOIN mine m ON m.image_id = i.image_id LEFT JOIN shared h ON h.image_id = i.image_id""",
    UNION_VIEWS,
    UNION_CTES,
)
def preview_counts(t):
    return L.preview_counts(t.img, t.zon, Z.layout_union(t.img, t.zon, *_layouts(t)))


@query(
    "J9_preview_layout",
    _OWN + """, opened AS (SELECT * FROM img WHERE combo = '3' ORDER BY import_idx LIMIT 1)
SELECT i.image_id, u.x, u.y, u.width, u.height, u.note, NOT EXISTS (SELECT 1 FROM own o WHERE o.image_id = i.image_id
 AND o.x = u.x AND o.y = u.y AND o.width = u.width AND o.height = u.height AND o.note = u.note) AS extra
FROM opened i JOIN uni u ON u.combo = i.combo AND u.ref_width = i.width AND u.ref_height = i.height""",
    UNION_VIEWS,
    UNION_CTES,
)
def preview_layout(t):
    opened = t.img.filter(F.col("combo") == "3").orderBy("import_idx").limit(1)
    return L.preview_layout(opened, t.zon, Z.layout_union(t.img, t.zon, *_layouts(t)))


# Zones an operator takes out after review: all that lie in the lower half of their raster.
_LOW = f"""low AS (SELECT {_KEY}, ord FROM lay2 WHERE y > ref_height / 2),
hit AS (SELECT DISTINCT {_KEY} FROM low),
rest AS (SELECT * FROM lay2 z WHERE NOT EXISTS (SELECT 1 FROM low l WHERE l.combo = z.combo AND l.ref_width = z.ref_width
 AND l.ref_height = z.ref_height AND l.ord = z.ord))
"""


@query(
    "F7_set_promotion",
    """SELECT l.combo, l.ref_width, l.ref_height, l.promoted OR k.combo IS NOT NULL AS promoted, l.layout_idx FROM lays2 l
LEFT JOIN lays k ON k.combo = l.combo AND k.ref_width = l.ref_width AND k.ref_height = l.ref_height""",
    ("lays", "lays2"),
)
def set_promotion(t):
    return L.set_promotion(t.lays2, t.lays, True)


@query(
    "F7_remove_layout_zones",
    f"""SELECT {_KEY}, NOT EXISTS (SELECT 1 FROM hit h WHERE h.combo = l.combo AND h.ref_width = l.ref_width AND h.ref_height = l.ref_height) AS promoted,
 layout_idx FROM lays2 l
WHERE EXISTS (SELECT 1 FROM rest r WHERE r.combo = l.combo AND r.ref_width = l.ref_width AND r.ref_height = l.ref_height)""",
    ("lays2",),
    _LOW,
)
def remove_layout_zones(t):
    low = t.lay2.filter(F.col("y") > F.col("ref_height") / 2)
    promoted = t.lays2.withColumn("promoted", F.lit(True))
    return L.remove_layout_zones(promoted, t.lay2, low)[0].select(*LAYOUT_KEY, "promoted", "layout_idx")


@query("F7_remaining_layout_zones", f"SELECT {_KEY}, ord, {_ZONE} FROM rest", ("lay2",), _LOW)
def remaining_layout_zones(t):
    low = t.lay2.filter(F.col("y") > F.col("ref_height") / 2)
    return L.remove_layout_zones(t.lays2, t.lay2, low)[1].select(*LAYOUT_KEY, "ord", *ZONE)


@query(
    "F7_discard_layouts",
    f"""SELECT {_KEY}, ord, {_ZONE} FROM lay2 z WHERE NOT EXISTS (
 SELECT 1 FROM lays k WHERE k.combo = z.combo AND k.ref_width = z.ref_width AND k.ref_height = z.ref_height)""",
    ("lays", "lay2"),
)
def discard_layouts(t):
    return L.discard_layouts(t.lays2, t.lay2, t.lays)[1].select(*LAYOUT_KEY, "ord", *ZONE)
