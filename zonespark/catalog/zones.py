"""Geometry, notes and layouts."""

import uuid

from pyspark.sql import functions as F

from zonespark.catalog.registry import query
from zonespark.functions import geometry as G
from zonespark.operators import layouts as L
from zonespark.operators import triage as T
from zonespark.operators import zones as Z
from zonespark.operators.layout_store import LayoutStore, occurrences
from zonespark.plans.ordering import beside_each_other, shared_folder
from zonespark.schemas import ZONE

_ZONE = "x, y, width, height, note"

# Clipped zones of labelled images and promoted layouts with the place they were first seen at.
UNION_CTES = f"""
facts AS (
 SELECT i.combo, i.width AS ref_width, i.height AS ref_height, z.x, z.y, z.width, z.height, z.note,
  0 AS origin, i.import_idx AS idx, z.frame_index AS frame, CAST(z.ord AS BIGINT) AS ord
 FROM nz z JOIN img i ON i.image_id = z.image_id WHERE i.combo <> ''
 UNION ALL
 SELECT l.combo, l.ref_width, l.ref_height, l.x, l.y, least(l.ref_width, l.x + l.width) - l.x,
  least(l.ref_height, l.y + l.height) - l.y, l.note, 1, s.layout_idx, 0, l.ord
 FROM lay l JOIN lays s ON s.combo = l.combo AND s.ref_width = l.ref_width AND s.ref_height = l.ref_height
 WHERE s.promoted AND least(l.ref_width, l.x + l.width) > l.x AND least(l.ref_height, l.y + l.height) > l.y),
uni AS (
 SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY combo, ref_width, ref_height, {_ZONE} ORDER BY origin, idx, frame, ord) AS rn
  FROM facts) f WHERE rn = 1)"""
UNION_VIEWS = ("nz", "lays")


def _layouts(t):
    return t.lays, t.lay.drop("promoted")


def _union(t, **kw):
    return Z.layout_union(t.img, t.zon, *_layouts(t), **kw)


@query(
    "P1_zone_key",
    f"SELECT {_ZONE}, count(*) AS copies FROM zon GROUP BY {_ZONE}",
    ("zon",),
)
def zone_key(t):
    return t.zon.groupBy(G.zone_key().alias("zone")).agg(F.count("*").alias("copies")).select("zone.*", "copies")


@query(
    "P2_clamp",
    """SELECT z.image_id, z.frame_index, z.ord, greatest(0, least(i.width, z.x)) AS x, greatest(0, least(i.height, z.y)) AS y
FROM zon z JOIN img i ON i.image_id = z.image_id""",
    ("zon",),
)
def clamp(t):
    raster = t.img.select("image_id", F.col("width").alias("rw"), F.col("height").alias("rh"))
    return t.zon.join(raster, "image_id").select(
        "image_id", "frame_index", "ord",
        G.clamp(F.col("x"), 0, F.col("rw")).alias("x"), G.clamp(F.col("y"), 0, F.col("rh")).alias("y"),
    )


@query(
    "P3_rect_between",
    """, edges AS (
 SELECT r.region_ord, floor(r.x0 + 0.5) AS ax, floor(r.y0 + 0.5) AS ay, floor(r.x1 + 0.5) AS bx, floor(r.y1 + 0.5) AS b2,
  i.width AS w, i.height AS h FROM reg r JOIN img i ON i.image_id = r.image_id),
cut AS (
 SELECT region_ord, greatest(0, least(w, least(ax, bx))) AS x1, greatest(0, least(h, least(ay, b2))) AS y1,
  greatest(0, least(w, greatest(ax, bx))) AS x2, greatest(0, least(h, greatest(ay, b2))) AS y2 FROM edges)
SELECT region_ord, CAST(x1 AS INT) AS x, CAST(y1 AS INT) AS y, CAST(x2 - x1 AS INT) AS width, CAST(y2 - y1 AS INT) AS height FROM cut""",
    ("reg",),
)
def rect_between(t):
    raster = t.img.select("image_id", "width", "height")
    # The corners are given in the opposite order on purpose.
    rect = G.rect_between(F.col("x1"), F.col("y1"), F.col("x0"), F.col("y0"), F.col("width"), F.col("height"))
    return t.reg.join(raster, "image_id").select("region_ord", rect.alias("r")).select("region_ord", "r.*")


@query("P4_clip_zones", f"SELECT image_id, frame_index, ord, {_ZONE} FROM nz", ("nz",))
def clip_zones(t):
    return Z.clip_zones(t.zon, t.img)


@query(
    "P5_shift_zones",
    """SELECT z.image_id, z.frame_index, z.ord, greatest(0, least(i.width - z.width, z.x + 12)) AS x,
 greatest(0, least(i.height - z.height, z.y - 7)) AS y, z.width, z.height, z.note
FROM zon z JOIN img i ON i.image_id = z.image_id""",
    ("zon",),
)
def shift_zones(t):
    return Z.shift_zones(t.zon, t.img, 12, -7)


@query(
    "P20_scale_zones",
    """SELECT z.image_id, z.frame_index, z.ord, z.x * (160 / i.width) AS x, z.y * (120 / i.height) AS y,
 greatest(1.0::DOUBLE, z.width * (160 / i.width)) AS width, greatest(1.0::DOUBLE, z.height * (120 / i.height)) AS height
FROM zon z JOIN img i ON i.image_id = z.image_id""",
    ("zon",),
)
def scale_zones(t):
    return Z.scale_zones(t.zon, t.img, 160, 120)


@query(
    "P22_clear_notes",
    """SELECT (SELECT count(*) FROM zon WHERE note <> '') + (SELECT count(*) FROM lay WHERE note <> '')
 + (SELECT count(*) FROM lay2 WHERE note <> '') AS notes,
 CAST(0 AS BIGINT) AS notes_after,
 (SELECT count(*) FROM (SELECT DISTINCT x, y, width, height FROM zon) d) AS rectangles""",
    ("zon", "lay", "lay2"),
)
def clear_notes(t):
    tables = [t.zon, t.lay, t.lay2]
    cleared = [Z.clear_notes(table) for table in tables]
    rectangles = cleared[0].select("x", "y", "width", "height").distinct()
    return beside_each_other(
        Z.count_notes(*tables),
        Z.count_notes(*cleared).withColumnRenamed("notes", "notes_after"),
        rectangles.agg(F.count("*").alias("rectangles")),
    )


@query(
    "P23_image_record",
    """SELECT import_idx, image_id, combo, width, height, frame_count, open_frame, kind, manufacturer, model,
 sop_class, software, name, path FROM ims""",
    ("ims",),
)
def image_record(t):
    return T.image_record(t.ims.withColumn("thumbnail", F.lit(1)))


@query(
    "A5_zone_summary",
    """SELECT combo, ref_width, ref_height, CAST(sum(zones) AS BIGINT) AS zones FROM (
 SELECT i.combo, i.width AS ref_width, i.height AS ref_height, count(*) AS zones
 FROM zon z JOIN img i ON i.image_id = z.image_id GROUP BY i.combo, i.width, i.height
 UNION ALL SELECT combo, ref_width, ref_height, count(*) FROM lay WHERE promoted GROUP BY combo, ref_width, ref_height) u
GROUP BY combo, ref_width, ref_height""",
    ("zon", "lay"),
)
def zone_summary(t):
    return Z.zone_summary(t.img, t.zon, *_layouts(t))


@query(
    "A5_summary_totals",
    """SELECT (SELECT count(*) FROM zon) + (SELECT count(*) FROM lay WHERE promoted) AS total,
 (SELECT count(*) FROM zon z JOIN img i ON i.image_id = z.image_id WHERE i.combo = '') AS unassigned,
 (SELECT count(*) FROM zon z JOIN img i ON i.image_id = z.image_id WHERE i.combo = '') > 0 AS v1_blocked""",
    ("zon", "lay"),
)
def summary_totals(t):
    return Z.summary_totals(Z.zone_summary(t.img, t.zon, *_layouts(t)))


@query(
    "A6_layout_union",
    f"SELECT combo, ref_width, ref_height, {_ZONE} FROM uni",
    UNION_VIEWS,
    UNION_CTES,
)
def layout_union(t):
    return _union(t).drop("first")


@query(
    "A6_layout_union_images",
    f"""SELECT DISTINCT i.combo, i.width AS ref_width, i.height AS ref_height, z.x, z.y, z.width, z.height, z.note
FROM nz z JOIN img i ON i.image_id = z.image_id WHERE i.combo <> ''""",
    ("nz",),
)
def layout_union_images(t):
    return Z.layout_union(t.img, t.zon).drop("first")


@query(
    "A6_layout_positions",
    f"""SELECT combo, ref_width, ref_height, {_ZONE},
 row_number() OVER (PARTITION BY combo, ref_width, ref_height ORDER BY origin, idx, frame, ord) - 1 AS position FROM uni""",
    UNION_VIEWS,
    UNION_CTES,
)
def layout_positions(t):
    return _union(t, with_position=True)


@query(
    "A6_union_after_batch",
    f"""SELECT i.combo, i.width AS ref_width, i.height AS ref_height, z.x, z.y, z.width, z.height, z.note, min(i.import_idx) AS first_idx
FROM nz z JOIN img i ON i.image_id = z.image_id WHERE i.combo <> '' AND (i.import_idx % 5 = 0 OR i.import_idx % 3 <> 0) GROUP BY ALL""",
    ("nz",),
)
def union_after_batch(t):
    """A stored union after a batch: of the images it held first a third goes, others come."""
    spark, early = t.img.sparkSession, F.col("import_idx") % 5 != 0
    path = f"{shared_folder(spark)}/layouts-{uuid.uuid4().hex}"
    store = LayoutStore.create(spark, path, occurrences(t.img.filter(early), t.zon))
    gone = t.img.filter(early & (F.col("import_idx") % 3 == 0))
    return store.update(occurrences(t.img.filter(~early), t.zon), occurrences(gone, t.zon)).union().select(
        "combo", "ref_width", "ref_height", *ZONE, F.col("first.import_idx").alias("first_idx")
    )


@query(
    "A7_layout_for_key",
    f"SELECT combo, ref_width, ref_height, {_ZONE} FROM uni WHERE combo = '5' AND ref_width = 1024 AND ref_height = 768",
    UNION_VIEWS,
    UNION_CTES,
)
def layout_for(t):
    return Z.layout_for(_union(t), "5", 1024, 768).drop("first")


@query("F6_promoted", "SELECT combo, ref_width, ref_height, promoted, layout_idx FROM lays WHERE promoted", ("lays",))
def promoted(t):
    return L.promoted(t.lays)


@query(
    "W3_first_seen",
    f"SELECT combo, ref_width, ref_height, {_ZONE}, origin, idx AS first_idx, frame AS first_frame, ord AS first_ord FROM uni",
    UNION_VIEWS,
    UNION_CTES,
)
def first_seen(t):
    return _union(t).select(
        "combo", "ref_width", "ref_height", *ZONE, F.col("first.origin").alias("origin"),
        F.col("first.import_idx").alias("first_idx"), F.col("first.frame_index").alias("first_frame"),
        F.col("first.ord").alias("first_ord"),
    )
