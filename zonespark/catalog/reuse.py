"""Copying zones and applying templates."""

from pyspark.sql import functions as F

from zonespark.catalog.registry import query
from zonespark.operators import reuse as R
from zonespark.operators import templates as M
from zonespark.plans.ordering import join_large, with_global_rank
from zonespark.schemas import FRAME, ZONE

_ZONE = "x, y, width, height, note"

# The first annotated file of every combo and raster is the source; its first annotated frame is copied.
_SOURCE = """, src AS (
 SELECT combo, width, height, image_id, frame_index FROM (
  SELECT i.combo, i.width, i.height, z.image_id, z.frame_index,
   row_number() OVER (PARTITION BY i.combo, i.width, i.height ORDER BY i.import_idx, z.frame_index, z.ord) AS rn
  FROM zon z JOIN img i ON i.image_id = z.image_id) s WHERE rn = 1)"""
_USABLE = """, usable AS (
 SELECT z.image_id, z.frame_index, z.ord, z.x, z.y, z.width, z.height, z.note FROM zon z
 WHERE EXISTS (SELECT 1 FROM nz n WHERE n.image_id = z.image_id AND n.frame_index = z.frame_index AND n.ord = z.ord)),
srcz AS (
 SELECT u.image_id AS source_id, u.ord, u.x, u.y, u.width, u.height, u.note FROM usable u
 JOIN src ON src.image_id = u.image_id AND src.frame_index = u.frame_index)"""
_TARGETS = """, tgt AS (
 SELECT src.image_id AS source_id, i.image_id, i.open_frame AS frame_index FROM img i
 JOIN src ON src.combo = i.combo AND src.width = i.width AND src.height = i.height WHERE i.image_id <> src.image_id)"""


def _sources(t):
    raster = t.img.select(
        "image_id", "import_idx", "combo", F.col("width").alias("rw"), F.col("height").alias("rh")
    )
    first = F.min(F.struct("import_idx", "frame_index", "ord", "image_id"))
    return (
        join_large(t.zon, raster, ["image_id"]).groupBy("combo", "rw", "rh").agg(first.alias("first"))
        .select("first.image_id", "first.frame_index")
    )


def _copy(t):
    """(source zones by key, targets by key) of copying each layout's first frame to the same-layout files."""
    t.write("img", "zon")
    sources = _sources(t)
    targets = R.reuse_targets(t.img, sources, "files", same_combo=True)
    zones = R.source_zones(t.zon, t.img).join(sources, FRAME).withColumnRenamed("image_id", "source_key")
    return zones.drop("frame_index"), targets.select(F.col("source_id").alias("source_key"), *FRAME)


@query("J5_source_zones", _USABLE.split(",\nsrcz")[0] + f"\nSELECT image_id, frame_index, ord, {_ZONE} FROM usable", ("nz",))
def source_zones(t):
    return R.source_zones(t.zon, t.img)


@query(
    "J2_reuse_targets_files",
    _SOURCE + _TARGETS + "\nSELECT source_id, image_id, frame_index FROM tgt",
    ("zon",),
)
def reuse_targets_files(t):
    return R.reuse_targets(t.img, _sources(t), "files", True).select("source_id", *FRAME)


@query(
    "J2_reuse_targets_all_frames",
    _SOURCE + """
SELECT src.image_id AS source_id, i.image_id, CAST(f.frame AS INT) AS frame_index FROM img i
JOIN src ON src.combo = i.combo AND src.width = i.width AND src.height = i.height,
 (SELECT unnest(range(0, 4)) AS frame) f WHERE i.image_id <> src.image_id AND f.frame < i.frame_count""",
    ("zon",),
)
def reuse_targets_all_frames(t):
    return R.reuse_targets(t.img, _sources(t), "files-all-frames", True).select("source_id", *FRAME)


@query(
    "J2_reuse_targets_frames",
    """SELECT i.image_id AS source_id, i.open_frame AS source_frame, i.image_id, CAST(f.frame AS INT) AS frame_index
FROM img i, (SELECT unnest(range(0, 4)) AS frame) f WHERE f.frame < i.frame_count AND f.frame <> i.open_frame""",
    ("img",),
)
def reuse_targets_frames(t):
    opened = t.img.select("image_id", F.col("open_frame").alias("frame_index"))
    return R.reuse_targets(t.img, opened, "frames")


_FRESH = _SOURCE + _USABLE + _TARGETS + """, offered AS (
 SELECT t.image_id, t.frame_index, t.source_id, min(s.ord) AS ord, s.x, s.y, s.width, s.height, s.note
 FROM tgt t JOIN srcz s ON s.source_id = t.source_id
 GROUP BY t.image_id, t.frame_index, t.source_id, s.x, s.y, s.width, s.height, s.note),
fresh AS (
 SELECT * FROM offered o WHERE NOT EXISTS (SELECT 1 FROM zon z WHERE z.image_id = o.image_id
  AND z.frame_index = o.frame_index AND z.x = o.x AND z.y = o.y AND z.width = o.width AND z.height = o.height AND z.note = o.note)),
merged AS (
 SELECT z.image_id, z.frame_index, CAST(z.ord AS BIGINT) AS ord, z.x, z.y, z.width, z.height, z.note, false AS is_new FROM zon z
 WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.image_id = z.image_id AND f.frame_index = z.frame_index)
 UNION ALL SELECT f.image_id, f.frame_index,
  coalesce((SELECT max(z.ord) FROM zon z WHERE z.image_id = f.image_id AND z.frame_index = f.frame_index), -1) + 1 + f.ord,
  f.x, f.y, f.width, f.height, f.note, true FROM fresh f)"""
_REPLACED = _SOURCE + _USABLE + _TARGETS + """, firsts AS (
 SELECT source_id, min(ord) AS ord, x, y, width, height, note FROM srcz GROUP BY source_id, x, y, width, height, note),
wanted AS (
 SELECT source_id, string_agg(concat_ws('|', x, y, width, height, note), ';' ORDER BY ord) AS list FROM firsts GROUP BY source_id),
held AS (
 SELECT image_id, frame_index, count(*) AS n, string_agg(concat_ws('|', x, y, width, height, note), ';' ORDER BY ord) AS list
 FROM zon GROUP BY image_id, frame_index),
changed AS (
 SELECT t.image_id, t.frame_index, t.source_id, coalesce(h.n, 0) AS held, w.list AS wanted FROM tgt t
 LEFT JOIN wanted w ON w.source_id = t.source_id
 LEFT JOIN held h ON h.image_id = t.image_id AND h.frame_index = t.frame_index
 WHERE w.list IS DISTINCT FROM h.list)"""


@query("J3_plan_merge", _FRESH + f"\nSELECT image_id, frame_index, ord, {_ZONE}, is_new FROM merged", ("nz",))
def plan_merge(t):
    source, targets = _copy(t)
    return R.plan_copy(source, targets, t.zon).drop("source_key")


@query(
    "J3_plan_replace",
    _REPLACED + """
SELECT c.image_id, c.frame_index, f.ord, f.x, f.y, f.width, f.height, f.note, f.x IS NOT NULL AS is_new
FROM changed c LEFT JOIN firsts f ON f.source_id = c.source_id""",
    ("nz",),
)
def plan_replace(t):
    source, targets = _copy(t)
    return R.plan_copy(source, targets, t.zon, "replace").drop("source_key")


@query(
    "J4_apply_plan",
    _FRESH + f"""
SELECT image_id, frame_index, ord, {_ZONE} FROM merged
UNION ALL SELECT image_id, frame_index, ord, {_ZONE} FROM zon z
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.image_id = z.image_id AND f.frame_index = z.frame_index)""",
    ("nz",),
)
def apply_plan(t):
    source, targets = _copy(t)
    return R.apply_plan(t.zon, R.plan_copy(source, targets, t.zon))


_PRICE = """
SELECT (SELECT count(*) FROM fresh) AS added, (SELECT count(*) FROM (SELECT DISTINCT image_id, frame_index FROM fresh) f) AS frames,
 (SELECT count(DISTINCT image_id) FROM fresh) AS files, CAST(0 AS BIGINT) AS replaced,
 (SELECT count(*) FROM tgt t JOIN srcz s ON s.source_id = t.source_id) - (SELECT count(*) FROM fresh) AS duplicates,
 (SELECT count(*) FROM tgt t JOIN srcz s ON s.source_id = t.source_id) AS offered"""


@query("A14_price_merge", _FRESH + _PRICE, ("nz",))
def price_merge(t):
    source, targets = _copy(t)
    return R.price_plan(source, targets, t.zon, R.plan_copy(source, targets, t.zon))


@query(
    "A14_price_replace",
    _REPLACED + """
SELECT (SELECT count(*) FROM changed c JOIN firsts f ON f.source_id = c.source_id) AS added, count(*) AS frames,
 count(DISTINCT image_id) AS files, CAST(sum(held) AS BIGINT) AS replaced,
 (SELECT count(*) FROM tgt t JOIN srcz s ON s.source_id = t.source_id)
 - (SELECT count(*) FROM tgt t JOIN firsts f ON f.source_id = t.source_id) AS duplicates,
 (SELECT count(*) FROM tgt t JOIN srcz s ON s.source_id = t.source_id) AS offered FROM changed""",
    ("nz",),
)
def price_replace(t):
    source, targets = _copy(t)
    plan = R.plan_copy(source, targets, t.zon, "replace")
    return R.price_plan(source, targets, t.zon, plan, "replace")


@query(
    "A14_describe_plan",
    _FRESH + f""", price AS ({_PRICE})
SELECT CAST(added AS STRING) || ' boxes into ' || CAST(frames AS STRING) || ' frames across ' || CAST(files AS STRING)
 || ' files · ' || CAST(duplicates AS STRING) || ' duplicates skipped' AS text FROM price""",
    ("nz",),
)
def describe_plan(t):
    source, targets = _copy(t)
    return R.describe_plan(R.price_plan(source, targets, t.zon, R.plan_copy(source, targets, t.zon)))


@query(
    "A14_describe_empty_source",
    "SELECT 'This frame has no boxes to copy.' AS text FROM (SELECT count(*) FROM img) one", ("img",),
)
def describe_empty_source(t):
    source, targets = _copy(t)
    none = source.filter("width < 0")
    return R.describe_plan(R.price_plan(none, targets, t.zon, R.plan_copy(none, targets, t.zon)), none)


_PREVIOUS = _USABLE.split(",\nsrcz")[0] + """, fresh AS (
 SELECT u.image_id, u.frame_index + 1 AS frame_index, min(u.ord) AS ord, u.x, u.y, u.width, u.height, u.note
 FROM usable u JOIN img i ON i.image_id = u.image_id WHERE u.frame_index + 1 < i.frame_count
 AND NOT EXISTS (SELECT 1 FROM zon z WHERE z.image_id = u.image_id AND z.frame_index = u.frame_index + 1
  AND z.x = u.x AND z.y = u.y AND z.width = u.width AND z.height = u.height AND z.note = u.note)
 GROUP BY u.image_id, u.frame_index, u.x, u.y, u.width, u.height, u.note),
last AS (SELECT image_id, frame_index, max(ord) AS last FROM zon GROUP BY image_id, frame_index)
"""


@query(
    "J10_copy_previous_frame",
    _PREVIOUS + f"""SELECT z.image_id, z.frame_index, CAST(z.ord AS BIGINT) AS ord, {_ZONE}, false AS is_new FROM zon z
WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.image_id = z.image_id AND f.frame_index = z.frame_index)
UNION ALL SELECT f.image_id, f.frame_index, coalesce(l.last, -1) + 1 + f.ord, {_ZONE}, true
FROM fresh f LEFT JOIN last l ON l.image_id = f.image_id AND l.frame_index = f.frame_index""",
    ("nz",),
)
def copy_previous_frame(t):
    return R.copy_previous_frame(t.zon, t.img).drop("source_key")


# Every annotated open frame is saved under the name of its file, except the PNGs, which get no name.
_CHOSEN = """, chosen AS (
 SELECT image_id, open_frame AS frame_index, CASE WHEN kind = 'PNG' THEN '   ' ELSE 'Layout   ' || name END AS name,
  combo, width AS rw, height AS rh FROM ims),
kept AS (
 SELECT c.image_id, c.name, c.combo, c.rw, c.rh, z.ord, z.x, z.y, z.width, z.height, z.note FROM chosen c
 JOIN nz z ON z.image_id = c.image_id AND z.frame_index = c.frame_index)
"""


def _templates(t):
    name = F.when(F.col("kind") == "PNG", "   ").otherwise(F.concat(F.lit("Layout   "), "name"))
    chosen = t.ims.select("image_id", F.col("open_frame").alias("frame_index"), name.alias("name"))
    return M.make_templates(t.zon, t.ims, chosen, "2026-01-01T00:00:00.000Z")


@query(
    "T1_make_templates",
    _CHOSEN + f"""SELECT substr(regexp_replace(name, ' +', ' ', 'g'), 1, 80) AS name, combo, rw AS template_width, rh AS template_height,
 '2026-01-01T00:00:00.000Z' AS created_at, ord, {_ZONE} FROM kept WHERE trim(name) <> ''""",
    ("nz", "ims"),
)
def make_templates(t):
    templates, zones, _ = _templates(t)
    named = templates.withColumnsRenamed({"width": "template_width", "height": "template_height"})
    return named.join(zones, "template_id").drop("template_id")


@query(
    "T1_rejected_templates",
    _CHOSEN + """SELECT c.image_id, CASE WHEN trim(name) = '' THEN 'Give the template a name.' ELSE 'This frame has no zones to save.' END AS reason
FROM chosen c WHERE trim(name) = '' OR NOT EXISTS (SELECT 1 FROM kept k WHERE k.image_id = c.image_id)""",
    ("nz", "ims"),
)
def rejected_templates(t):
    return _templates(t)[2].select("image_id", "reason")


# One template per imported layout, chosen for every image of its combo whatever the raster.
_CHOICE = """, choice AS (
 SELECT l.combo || '/' || CAST(l.ref_width AS STRING) AS template_id, l.ref_width, l.ref_height, i.* FROM img i
 JOIN lays l ON l.combo = i.combo)"""


def _choices(t):
    key = F.concat_ws("/", "combo", "ref_width").alias("template_id")
    templates = t.lays.select(
        key, F.concat(F.lit("Layout "), "combo").alias("name"), "combo", F.col("ref_width").alias("width"),
        F.col("ref_height").alias("height"), F.lit("").alias("created_at"),
    )
    zones = t.lay.select(key, "ord", *ZONE)
    choices = t.img.select("image_id", "combo").join(templates.select("template_id", "combo"), "combo")
    return templates, zones, choices.drop("combo")


@query(
    "J6_template_targets_file",
    _CHOICE + """
SELECT template_id AS source_key, image_id, CAST(f.frame AS INT) AS frame_index
FROM choice, (SELECT unnest(range(0, 4)) AS frame) f WHERE f.frame < frame_count AND width = ref_width AND height = ref_height""",
    ("img", "lays"),
)
def template_targets_file(t):
    templates, _, choices = _choices(t)
    return M.template_targets(t.img, templates, choices, "file")[0]


@query(
    "J6_template_targets_combo",
    _CHOICE + """, anchor AS (SELECT DISTINCT template_id, combo, width, height FROM choice WHERE width = ref_width AND height = ref_height)
SELECT a.template_id AS source_key, i.image_id, CAST(f.frame AS INT) AS frame_index FROM anchor a
JOIN img i ON i.combo = a.combo AND i.width = a.width AND i.height = a.height,
 (SELECT unnest(range(0, 4)) AS frame) f WHERE f.frame < i.frame_count""",
    ("img", "lays"),
)
def template_targets_combo(t):
    templates, _, choices = _choices(t)
    return M.template_targets(t.img, templates, choices, "combo")[0]


@query(
    "J6_template_refusals",
    _CHOICE + """
SELECT template_id, image_id, ref_width AS template_width, ref_height AS template_height, width, height,
 (SELECT count(*) FROM img i WHERE i.width = ref_width AND i.height = ref_height) AS fitting_images
FROM choice WHERE width <> ref_width OR height <> ref_height""",
    ("img", "lays"),
)
def template_refusals(t):
    templates, _, choices = _choices(t)
    return M.template_targets(t.img, templates, choices, "frame")[1]


@query(
    "J6_plan_template",
    _CHOICE + """, firsts AS (
 SELECT combo || '/' || CAST(ref_width AS STRING) AS template_id, min(ord) AS ord, x, y, width, height, note FROM lay
 GROUP BY 1, x, y, width, height, note),
fresh AS (
 SELECT c.image_id, c.open_frame AS frame_index, f.ord, f.x, f.y, f.width, f.height, f.note FROM choice c
 JOIN firsts f ON f.template_id = c.template_id WHERE c.width = c.ref_width AND c.height = c.ref_height
 AND NOT EXISTS (SELECT 1 FROM zon z WHERE z.image_id = c.image_id AND z.frame_index = c.open_frame AND z.x = f.x
  AND z.y = f.y AND z.width = f.width AND z.height = f.height AND z.note = f.note))
SELECT image_id, frame_index, x, y, width, height, note FROM fresh""",
    ("img", "lays", "zon"),
)
def plan_template(t):
    templates, zones, choices = _choices(t)
    targets, _ = M.template_targets(t.img, templates, choices, "frame")
    return M.plan_template(zones, targets, t.zon).filter("is_new").select(*FRAME, *ZONE)


@query(
    "O4_template_order",
    """, named AS (SELECT combo || '/' || CAST(ref_width AS STRING) AS template_id, combo, ref_width, ref_height, 'Layout ' || combo AS name FROM lays
 UNION ALL SELECT 'none/' || CAST(width AS STRING), '', width, height, 'Unassigned' FROM (SELECT DISTINCT width, height FROM img) s)
SELECT template_id, row_number() OVER (ORDER BY combo = '', try_cast(combo AS DOUBLE) NULLS FIRST, ref_width, ref_height, name) - 1 AS place FROM named""",
    ("img", "lays"),
)
def template_order(t):
    templates, _, _ = _choices(t)
    sizes = t.img.select("width", "height").distinct()
    unassigned = sizes.select(
        F.concat(F.lit("none/"), F.col("width").cast("string")).alias("template_id"), F.lit("Unassigned").alias("name"),
        F.lit("").alias("combo"), "width", "height", F.lit("").alias("created_at"),
    )
    order = [c.alias(f"o{i}") for i, c in enumerate(M.template_order())]
    listed = templates.unionByName(unassigned).select("template_id", *order)
    return with_global_rank(listed, [f"o{i}" for i in range(len(order))], "place").select("template_id", "place")
