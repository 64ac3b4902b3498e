"""Files, devices and triage."""

import uuid

from pyspark.sql import functions as F

from zonespark.catalog.registry import query
from zonespark.functions import device as D
from zonespark.functions.filenames import parse_filename, size_mismatch
from zonespark.operators import detect as K
from zonespark.operators import triage as T
from zonespark.operators.search_index import index_images, search_images_indexed
from zonespark.plans.ordering import shared_folder, with_global_rank, with_rank_within
from zonespark.schemas import DEVICE

_NAME = r"'^(?i)combo([0-9]+)_([0-9]+)x([0-9]+)_s([0-9]+)\.(png|dcm|dicom|ima)$'"
_PARSED = f""", parsed AS (
 SELECT *, nullif(regexp_extract(name, {_NAME}, 1), '') AS named_combo,
  CAST(nullif(regexp_extract(name, {_NAME}, 2), '') AS BIGINT) AS filename_width,
  CAST(nullif(regexp_extract(name, {_NAME}, 3), '') AS BIGINT) AS filename_height,
  nullif(regexp_extract(name, {_NAME}, 4), '') AS sample FROM ims)
"""
_BOXES = """, boxed AS (
 SELECT i.*, coalesce(c.n, 0) AS boxes FROM ims i
 LEFT JOIN (SELECT image_id, count(*) AS n FROM zon GROUP BY image_id) c ON c.image_id = i.image_id)
"""
_IMG = "import_idx, image_id, combo, name, boxes"


def _stated(t):
    stated = t.ims.withColumn("stated", parse_filename(F.col("name")))
    return stated.withColumns(
        {"filename_width": F.col("stated.width"), "filename_height": F.col("stated.height")}
    )


@query(
    "P6_parse_filename",
    _PARSED + "SELECT image_id, named_combo, filename_width, filename_height, sample FROM parsed",
    ("ims",),
)
def parse_filenames(t):
    return _stated(t).select(
        "image_id", F.col("stated.combo").alias("named_combo"), "filename_width", "filename_height",
        F.col("stated.sample").alias("sample"),
    )


@query(
    "P7_size_mismatch",
    _PARSED + """SELECT image_id, name, width, height FROM parsed
WHERE filename_width IS NOT NULL AND (filename_width <> width OR filename_height <> height)""",
    ("ims",),
)
def size_mismatches(t):
    return _stated(t).filter(size_mismatch()).select("image_id", "name", "width", "height")


@query("P8_device_attributes", "SELECT image_id, manufacturer, model, sop_class, software FROM img", ("img",))
def device_attributes(t):
    # An image may carry no attribute at all; stored as NULL it still compares as the empty string.
    unset = [F.nullif(F.col(c), F.lit("")).alias(c) for c in DEVICE]
    return T.with_device(t.img.select("image_id", *unset))


@query(
    "P9_attributes_source",
    """SELECT image_id, CASE WHEN manufacturer <> '' AND model <> '' AND sop_class <> '' AND software <> ''
 THEN 'dicom_tags' ELSE 'partial' END AS attributes_source FROM img""",
    ("img",),
)
def attributes_source(t):
    return t.img.select("image_id", D.attributes_source().alias("attributes_source"))


@query(
    "P10_device_signature",
    """SELECT manufacturer, model, sop_class, software, count(*) AS images,
 manufacturer = '' AND model = '' AND sop_class = '' AND software = '' AS unknown FROM img GROUP BY ALL""",
    ("img",),
)
def device_signature(t):
    signed = t.img.select(*DEVICE, D.device_signature().isNull().alias("unknown"))
    return signed.groupBy(*DEVICE, "unknown").agg(F.count("*").alias("images"))


@query(
    "P11_sop_class_name",
    """SELECT image_id, CASE trim(sop_class) WHEN '1.2.840.10008.5.1.4.1.1.6.1' THEN 'Ultrasound Image'
 WHEN '1.2.840.10008.5.1.4.1.1.1' THEN 'Computed Radiography Image' ELSE trim(sop_class) END AS sop_class_name
FROM (SELECT image_id, CASE WHEN import_idx % 4 = 0 THEN ' 1.2.840.10008.5.1.4.1.1.1 ' WHEN import_idx % 4 = 1
 THEN '1.2.3.' || CAST(import_idx % 9 AS STRING) ELSE sop_class END AS sop_class FROM img) s""",
    ("img",),
)
def sop_class_name(t):
    kind = (
        F.when(F.col("import_idx") % 4 == 0, " 1.2.840.10008.5.1.4.1.1.1 ")
        .when(F.col("import_idx") % 4 == 1, F.concat(F.lit("1.2.3."), (F.col("import_idx") % 9).cast("string")))
        .otherwise(F.col("sop_class"))
    )
    return t.img.select("image_id", D.sop_class_name(kind).alias("sop_class_name"))


# Software written in the ways vendors write it: plain, after the model, or nothing but the model.
_WRITTEN = """, written AS (
 SELECT image_id, manufacturer, model, sop_class, CASE import_idx % 5 WHEN 0 THEN lower(model) || ':' || software
  WHEN 1 THEN model || ' - ' || software WHEN 2 THEN model WHEN 3 THEN model || software ELSE software END AS software,
  software AS version, import_idx % 5 AS way FROM img),
short AS (
 SELECT *, CASE WHEN model = '' THEN trim(software) WHEN way IN (0, 1) AND version <> '' THEN version ELSE trim(software) END AS short_software
 FROM written)
"""


def _written(t):
    way = F.col("import_idx") % 5
    software = (
        F.when(way == 0, F.concat(F.lower("model"), F.lit(":"), "software"))
        .when(way == 1, F.concat("model", F.lit(" - "), "software"))
        .when(way == 2, F.col("model")).when(way == 3, F.concat("model", "software")).otherwise(F.col("software"))
    )
    return t.img.withColumn("software", software)


@query("P12_short_software", _WRITTEN + "SELECT image_id, short_software FROM short", ("img",))
def short_software(t):
    return _written(t).select("image_id", D.short_software().alias("short_software"))


@query(
    "P13_device_label",
    _WRITTEN + """SELECT image_id,
 concat_ws(' · ', nullif(manufacturer, ''), nullif(model, ''), nullif(short_software, '')) AS label,
 concat_ws(' · ', nullif(manufacturer, ''), nullif(model, ''), nullif(short_software, ''),
  CASE WHEN sop_class <> '' THEN 'Ultrasound Image' END) AS detail FROM short""",
    ("img",),
)
def device_label(t):
    return _written(t).select("image_id", D.device_label().alias("label"), D.device_detail().alias("detail"))


@query(
    "P21_review_flags",
    _BOXES + """, bare AS (
 SELECT d.image_id, count(*) AS n FROM det d WHERE NOT EXISTS (
  SELECT 1 FROM zon z WHERE z.image_id = d.image_id AND d.x >= z.x AND d.y >= z.y
   AND d.x + d.width <= z.x + z.width AND d.y + d.height <= z.y + z.height) GROUP BY d.image_id)
SELECT b.image_id, concat_ws(', ', CASE WHEN NOT has_source THEN 'no source' WHEN boxes = 0 THEN 'no zones' END,
 CASE WHEN combo = '' THEN 'no combo' END, CASE WHEN n > 0 THEN CAST(n AS STRING) || ' uncovered' END) AS flags,
 CAST(NOT has_source OR boxes = 0 OR combo = '' OR n > 0 AS BOOLEAN) IS TRUE AS flagged
FROM boxed b LEFT JOIN bare ON bare.image_id = b.image_id""",
    ("ims", "zon", "det"),
)
def review_flags(t):
    bare = K.uncovered(t.det, t.zon, "file")
    flagged = T.review_flags(t.ims, t.zon, bare)
    return flagged.select("image_id", F.array_join("flags", ", ").alias("flags"), (F.size("flags") > 0).alias("flagged"))


_STATES = {
    "all": "true", "unannotated": "boxes = 0", "annotated": "boxes > 0", "needs-combo": "boxes > 0 AND combo = ''",
    "source-needed": "NOT has_source",
}


def _register_states():
    for state, predicate in _STATES.items():
        name = "F1_triage_" + state.replace("-", "_")
        sql = _BOXES + f"SELECT {_IMG} FROM boxed WHERE {predicate}"
        query(name, sql, ("ims", "zon"))(
            lambda t, state=state: T.triage_filter(t.ims, t.zon, state).select(*_IMG.split(", "))
        )


_register_states()


@query(
    "F2_search_images",
    _BOXES + f"SELECT {_IMG} FROM boxed WHERE boxes > 0 AND contains(lower(name || ' ' || path || ' ' || combo), 'combo1_102')",
    ("ims", "zon"),
)
def search_images(t):
    return T.search_images(T.triage_filter(t.ims, t.zon, "annotated"), "  Combo1_102").select(*_IMG.split(", "))


@query(
    "F2_search_indexed",
    "SELECT image_id, import_idx, name FROM ims WHERE contains(lower(name || ' ' || path || ' ' || combo), 'combo1_102')",
    ("ims",),
)
def search_indexed(t):
    index = index_images(t.ims, f"{shared_folder(t.ims.sparkSession)}/index-{uuid.uuid4().hex}")
    return search_images_indexed(index, "  Combo1_102").select("image_id", "import_idx", "name")


@query(
    "F4_review_scope_combo",
    "SELECT image_id, import_idx FROM img WHERE combo = ''",
    ("img",),
)
def review_scope_combo(t):
    return T.review_scope(t.img, {"combo": None}, "combo").select("image_id", "import_idx")


@query(
    "F4_review_scope_size",
    "SELECT image_id, import_idx FROM img WHERE combo = '7' AND width = 640 AND height = 480",
    ("img",),
)
def review_scope_size(t):
    anchor = {"combo": "7", "width": 640, "height": 480}
    return T.review_scope(t.img, anchor, "size").select("image_id", "import_idx")


@query("A1_box_counts", _BOXES + "SELECT image_id, boxes FROM boxed", ("ims", "zon"))
def box_counts(t):
    return T.box_counts(t.img, t.zon).select("image_id", "boxes")


@query(
    "A2_filter_counts",
    _BOXES + """SELECT count(*) AS "all", count(*) FILTER (boxes = 0) AS unannotated, count(*) FILTER (boxes > 0) AS annotated,
 count(*) FILTER (boxes > 0 AND combo = '') AS needs_combo, count(*) FILTER (NOT has_source) AS source_needed FROM boxed""",
    ("ims", "zon"),
)
def filter_counts(t):
    return T.filter_counts(t.img, t.zon)


_GROUPS = _BOXES + """, known AS (
 SELECT combo, manufacturer, model, sop_class, software, row_number() OVER (PARTITION BY combo ORDER BY import_idx) AS rn
 FROM boxed WHERE manufacturer || model || sop_class || software <> ''),
grouped AS (
 SELECT combo, combo = '' AS needs_combo, count(*) AS total, count(*) FILTER (boxes > 0) AS annotated,
  count(DISTINCT (width, height)) AS size_count,
  count(DISTINCT CASE WHEN manufacturer || model || sop_class || software <> '' THEN (manufacturer, model, sop_class, software) END) AS device_count
 FROM boxed GROUP BY combo)
"""


@query(
    "A3_group_library",
    _GROUPS + """SELECT g.*, device_count > 1 AS mixed_devices, k.manufacturer, k.model, k.sop_class, k.software
FROM grouped g LEFT JOIN known k ON k.combo = g.combo AND k.rn = 1""",
    ("ims", "zon"),
)
def group_library(t):
    return T.group_library(t.img, t.zon)


@query(
    "A3_group_sizes",
    "SELECT combo, width, height, count(*) AS files FROM img GROUP BY combo, width, height",
    ("img",),
)
def group_sizes(t):
    return T.group_sizes(t.img)


_OUTLINE = """, sizes AS (SELECT combo, width, height, count(*) AS files FROM img GROUP BY combo, width, height),
folded AS (SELECT combo FROM img GROUP BY combo HAVING count(*) > (SELECT count(*) * 0.05 FROM img))
"""


@query(
    "A4_library_rollup",
    _OUTLINE + """SELECT 'group' AS row_type, combo, NULL AS width, NULL AS height, NULL AS import_idx, NULL AS image_id, count(*) AS files
FROM img GROUP BY combo
UNION ALL SELECT 'size', combo, width, height, NULL, NULL, files FROM sizes
 WHERE combo IN (SELECT combo FROM sizes GROUP BY combo HAVING count(*) > 1)
UNION ALL SELECT 'file', combo, width, height, import_idx, image_id, 1 FROM img""",
    ("img",),
)
def library_rollup(t):
    return T.library_rollup(t.img)


@query(
    "A4_library_rollup_collapsed",
    _OUTLINE + """SELECT 'group' AS row_type, combo, NULL AS width, NULL AS height, NULL AS import_idx, NULL AS image_id, count(*) AS files
FROM img GROUP BY combo
UNION ALL SELECT 'size', combo, width, height, NULL, NULL, files FROM sizes
 WHERE combo IN (SELECT combo FROM sizes GROUP BY combo HAVING count(*) > 1) AND combo NOT IN (SELECT combo FROM folded)
UNION ALL SELECT 'file', combo, width, height, import_idx, image_id, 1 FROM img WHERE combo NOT IN (SELECT combo FROM folded)""",
    ("img",),
)
def library_rollup_collapsed(t):
    img = t.img
    share = img.agg((F.count("*") * 0.05).alias("n"))
    large = img.groupBy("combo").agg(F.count("*").alias("n")).filter(F.col("n") > share.scalar())
    return T.library_rollup(img, large)


@query(
    "A13_plan_combo_assignment",
    """SELECT '5' AS combo, count(*) FILTER (combo <> '5') AS changed, count(*) FILTER (combo = '5') AS unchanged,
 count(*) FILTER (combo = '') AS assigned, count(*) FILTER (combo NOT IN ('', '5')) AS overwritten,
 count(DISTINCT combo) FILTER (combo NOT IN ('', '5')) AS replaced_id_count,
 (SELECT string_agg(combo, ', ' ORDER BY first) FROM (SELECT combo, min(import_idx) AS first FROM img
  WHERE combo NOT IN ('', '5') GROUP BY combo ORDER BY first LIMIT 4) f) AS replaced_ids FROM img""",
    ("img",),
)
def plan_combo_assignment(t):
    return T.plan_combo_assignment(t.img, "5")


@query(
    "A13_describe_assignment",
    """SELECT 'Set ' || CAST(count(*) FILTER (combo <> '5') AS STRING) || ' files to combo 5?' || chr(10)
 || CAST(count(*) FILTER (combo NOT IN ('', '5')) AS STRING) || ' files already carry a different ID ('
 || (SELECT string_agg(combo, ', ' ORDER BY first) FROM (SELECT combo, min(import_idx) AS first FROM img
  WHERE combo NOT IN ('', '5') GROUP BY combo ORDER BY first LIMIT 4) f) || ', …) and will be overwritten.' || chr(10)
 || CAST(count(*) FILTER (combo = '5') AS STRING) || ' files already match and stay as they are.' || chr(10)
 || 'Combo IDs are not covered by undo.' AS text FROM img""",
    ("img",),
)
def describe_assignment(t):
    return T.describe_assignment(T.plan_combo_assignment(t.img, "5"))


@query("A13_assign_combo", "SELECT '016' AS combo, count(*) AS files FROM img", ("img",))
def assign_combo(t):
    return T.assign_combo(t.img, "016").groupBy("combo").agg(F.count("*").alias("files"))


_DISPLAY = "combo <> '', try_cast(combo AS DOUBLE) NULLS FIRST, combo, width, height, import_idx"


@query(
    "W1_review_queue",
    f"""SELECT image_id, import_idx, lag(import_idx) OVER (ORDER BY {_DISPLAY}) AS previous,
 lead(import_idx) OVER (ORDER BY {_DISPLAY}) AS next, row_number() OVER (ORDER BY {_DISPLAY}) AS position,
 count(*) OVER () AS total FROM img""",
    ("img",),
)
def review_queue(t):
    return T.review_queue(t.img)


@query(
    "W1_queue_page",
    f"""SELECT * FROM (SELECT image_id, import_idx, row_number() OVER (ORDER BY {_DISPLAY}) AS position, count(*) OVER () AS total FROM img)
WHERE position > 700 AND position <= 800""",
    ("img",),
)
def queue_page(t):
    """The eighth page of a hundred files. Writing the queue sorts all files once; the page then reads the slices it lies in."""
    queue = T.write_queue(t.img, f"{shared_folder(t.img.sparkSession)}/queue-{uuid.uuid4().hex}")
    return T.queue_page(queue, 7, 100).select("image_id", "import_idx", "position", "total")


_QUEUE = _BOXES + f""", queue AS (
 SELECT image_id, import_idx, row_number() OVER (ORDER BY {_DISPLAY}) AS position FROM boxed WHERE boxes > 0 AND combo = ''),
every AS (
 SELECT b.image_id, b.import_idx, q.position, CASE WHEN q.position IS NOT NULL THEN (q.position, q.import_idx) END AS entry
 FROM boxed b LEFT JOIN queue q ON q.image_id = b.image_id),
walked AS (
 SELECT *, max(entry) OVER (ORDER BY import_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(entry) OVER (ORDER BY import_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM every)
"""


@query(
    "W2_queue_neighbours",
    _QUEUE + """SELECT image_id, import_idx, before[2] AS previous, after[2] AS next, CAST(NULL AS BIGINT) AS position,
 (SELECT count(*) FROM queue) AS total FROM walked WHERE position IS NULL""",
    ("ims", "zon"),
)
def queue_neighbours(t):
    queue = T.review_queue(T.triage_filter(t.img, t.zon, "needs-combo"))
    return T.queue_neighbours(queue, t.img)


@query(
    "O1_group_order",
    """SELECT combo, row_number() OVER (ORDER BY combo <> '', try_cast(combo AS DOUBLE) NULLS FIRST, combo) - 1 AS place
FROM (SELECT DISTINCT combo FROM img) c""",
    ("img",),
)
def group_order(t):
    groups = T.group_library(t.img, t.zon).select("combo", *T.library_order())
    return with_global_rank(groups, T.LIBRARY_ORDER, "place").select("combo", "place")


@query(
    "O2_size_order",
    """SELECT combo, width, height, row_number() OVER (PARTITION BY combo ORDER BY width, height) - 1 AS by_number,
 row_number() OVER (PARTITION BY combo ORDER BY CAST(width AS STRING) || 'x' || CAST(height AS STRING)) - 1 AS by_text
FROM (SELECT DISTINCT combo, width, height FROM img) s""",
    ("img",),
)
def size_order(t):
    sizes = T.group_sizes(t.img).withColumn("size", F.concat_ws("x", "width", "height"))
    numbered = with_rank_within(sizes, ["combo"], ["width", "height"], "by_number")
    return with_rank_within(numbered, ["combo"], ["size"], "by_text").select(
        "combo", "width", "height", "by_number", "by_text"
    )
