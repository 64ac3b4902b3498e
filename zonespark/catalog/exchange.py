"""Exchange files (S4-S7, S9, W4, E5), built as text from the tables or written to files, and read back."""

import uuid

from pyspark.sql import functions as F

from zonespark.catalog.registry import query
from zonespark.plans.ordering import dealt, shared_folder
from zonespark.schemas import ZONE
from zonespark.sources import documents as O
from zonespark.sources import exchange as E

_ZONE = "x, y, width, height, note"
_NL = "chr(10)"

# One layout file per customer; some name another size, lack a note, leave the raster or hold no zone.
_LAYOUT_FILES = """, files AS (
 SELECT ord AS id, 'layout' || CAST(ord AS STRING) AS path, '{"annotations":{"' || combo || '":{"' || CAST(ref_width AS STRING) || 'x' || CAST(ref_height AS STRING)
 || '":{"ref_width":' || CAST(ref_width + CASE WHEN ord % 11 = 0 THEN 1 ELSE 0 END AS STRING) || ',"ref_height":' || CAST(ref_height AS STRING)
 || ',"zones":[' || CASE WHEN ord % 17 = 0 THEN '' ELSE '{"x":' || CAST(x AS STRING) || ',"y":' || CAST(y AS STRING) || ',"width":'
 || CASE WHEN ord % 7 = 0 THEN '9000' ELSE CAST(width AS STRING) || '.0' END || ',"height":' || CAST(height AS STRING)
 || CASE WHEN ord % 13 = 0 THEN ',"note":5' ELSE ',"note":"' || note || '"' END || '}' END || ']}}}}' AS text,
 combo, ref_width, ref_height, x, y, width, height, note FROM lay2),
judged AS (
 SELECT *, CASE WHEN id % 11 = 0 THEN 'size' WHEN id % 17 = 0 THEN 'empty' WHEN id % 13 = 0 THEN 'rectangle'
  WHEN id % 7 = 0 OR x + width > ref_width OR y + height > ref_height THEN 'outside' END AS defect FROM files)
"""


def _layout_files(t):
    zone = F.when(F.col("ord") % 17 == 0, "").otherwise(
        F.concat(
            F.lit('{"x":'), F.col("x").cast("string"), F.lit(',"y":'), F.col("y").cast("string"), F.lit(',"width":'),
            F.when(F.col("ord") % 7 == 0, "9000").otherwise(F.concat(F.col("width").cast("string"), F.lit(".0"))),
            F.lit(',"height":'), F.col("height").cast("string"),
            F.when(F.col("ord") % 13 == 0, ',"note":5').otherwise(F.concat(F.lit(',"note":"'), "note", F.lit('"'))),
            F.lit("}"),
        )
    )
    text = F.concat(
        F.lit('{"annotations":{"'), "combo", F.lit('":{"'), F.concat_ws("x", "ref_width", "ref_height"),
        F.lit('":{"ref_width":'), (F.col("ref_width") + F.when(F.col("ord") % 11 == 0, 1).otherwise(0)).cast("string"),
        F.lit(',"ref_height":'), F.col("ref_height").cast("string"), F.lit(',"zones":['), zone, F.lit("]}}}}"),
    )
    return dealt(t.lay2.select(F.concat(F.lit("layout"), F.col("ord").cast("string")).alias("path"), text.alias("text")), "path")


@query(
    "S4_read_layouts",
    _LAYOUT_FILES + f"SELECT path AS file, combo, ref_width, ref_height, CAST(0 AS BIGINT) AS ord, {_ZONE} FROM judged WHERE defect IS NULL",
    ("lay2",),
)
def read_layouts(t):
    return E.parse_layouts(_layout_files(t))[1]


@query(
    "S4_layouts",
    _LAYOUT_FILES + """SELECT combo, ref_width, ref_height, false AS promoted, row_number() OVER (ORDER BY path) - 1 AS layout_idx, path AS file
FROM judged WHERE defect IS NULL""",
    ("lay2",),
)
def layouts(t):
    return E.parse_layouts(_layout_files(t))[0]


@query(
    "S4_rejected_layouts",
    _LAYOUT_FILES + """SELECT path, CASE defect
 WHEN 'size' THEN 'ref_width and ref_height disagree with ' || CAST(ref_width AS STRING) || 'x' || CAST(ref_height AS STRING)
 WHEN 'empty' THEN 'The file contains no zones.' WHEN 'rectangle' THEN 'Invalid rectangle in combo ' || combo
 ELSE 'A rectangle lies outside its raster in combo ' || combo END AS reason FROM judged WHERE defect IS NOT NULL""",
    ("lay2",),
)
def rejected_layouts(t):
    return E.parse_layouts(_layout_files(t))[2]


# One backup per image with a zone on its last frame; some say the wrong version, combo, kind or frame.
_BACKUPS = """, judged AS (
 SELECT *, 'backup' || CAST(import_idx AS STRING) AS file, CASE WHEN import_idx % 19 = 0 THEN 'Not a supported annotation backup.'
  WHEN import_idx % 29 = 0 THEN 'Invalid combo ID.' WHEN import_idx % 31 = 0 THEN 'Invalid frame index.'
  WHEN import_idx % 43 = 0 THEN 'Invalid native-pixel rectangle.' WHEN import_idx % 47 = 0 THEN 'A rectangle lies outside the source image.' END AS reason
 FROM ims)
"""


def _backup_files(t):
    idx = F.col("import_idx")

    def when(n: int, bad: str, good):
        return F.when(idx % n == 0, bad).otherwise(good)

    number = {c: F.col(c).cast("string") for c in ("width", "height", "frame_count", "open_frame")}
    frame = when(31, "99", (F.col("frame_count") - 1).cast("string"))
    x = F.when(idx % 43 == 0, "1.5").when(idx % 47 == 0, "5000").otherwise((idx % 100).cast("string"))
    text = F.concat(
        F.lit('{"format":"any-project","version":'), when(19, "2", F.lit("1")), F.lit(',"images":[{"id":"'), "image_id",
        F.lit('","name":"'), "name", F.lit('","kind":"'), "kind", F.lit('","combo":"'), when(29, "x1", F.col("combo")),
        F.lit('","width":'), number["width"], F.lit(',"height":'), number["height"], F.lit(',"frameCount":'),
        number["frame_count"], F.lit(',"frameIndex":'),
        F.when(idx % 7 == 0, "77").otherwise(number["open_frame"]),
        F.lit(',"metadata":{"manufacturer":"'), "manufacturer", F.lit('","model":"'), "model", F.lit('"},"display":{"invert":'),
        F.when(idx % 2 == 0, "true").otherwise("0"), F.lit(',"windowWidth":'), when(3, "0.5", F.lit("80")),
        F.lit('},"frames":{"'), frame, F.lit('":[{"x":'), x, F.lit(',"y":3,"width":40,"height":20,"note":"n"}]}}]}'),
    )
    return dealt(t.ims.select(F.concat(F.lit("backup"), idx.cast("string")).alias("path"), text.alias("text")), "path")


@query(
    "S5_read_backup",
    _BACKUPS + """SELECT image_id, name, name AS path, combo, width, height, frame_count, kind,
 CASE WHEN import_idx % 7 = 0 THEN 0 ELSE open_frame END AS open_frame, manufacturer, model, '' AS software,
 import_idx % 2 = 0 AS invert, CASE WHEN import_idx % 3 = 0 THEN NULL ELSE 80.0::DOUBLE END AS window_width, has_source,
 row_number() OVER (ORDER BY file) - 1 AS import_idx FROM judged WHERE reason IS NULL""",
    ("ims",),
)
def read_backup(t):
    at_hand = t.img.filter("has_source").select("image_id")
    return E.parse_backup(_backup_files(t), at_hand)[0].select(
        "image_id", "name", "path", "combo", "width", "height", "frame_count", "kind", "open_frame", "manufacturer",
        "model", "software", "invert", "window_width", "has_source", "import_idx",
    )


@query(
    "S5_backup_zones",
    _BACKUPS + """SELECT image_id, frame_count - 1 AS frame_index, CAST(0 AS BIGINT) AS ord, CAST(import_idx % 100 AS INT) AS x, 3 AS y,
 40 AS width, 20 AS height, 'n' AS note FROM judged WHERE reason IS NULL""",
    ("ims",),
)
def backup_zones(t):
    return E.parse_backup(_backup_files(t))[1].drop("file")


@query("S5_rejected_backups", _BACKUPS + "SELECT file AS path, reason FROM judged WHERE reason IS NOT NULL", ("ims",))
def rejected_backups(t):
    return E.backup_rejects(_backup_files(t))


# One template file per customer with the same template twice; some lack a name, a size or any zone.
_TEMPLATE_FILES = """, judged AS (
 SELECT *, 'templates' || CAST(ord AS STRING) AS file, CASE WHEN ord % 23 = 0 THEN 'A template is missing its name.'
  WHEN ord % 19 = 0 THEN 'Invalid raster size.' WHEN ord % 17 = 0 THEN 'A template has no zones.'
  WHEN x + width > ref_width OR y + height > ref_height THEN 'A rectangle lies outside its raster.' END AS reason FROM lay2),
copies AS (SELECT j.*, c.copy FROM judged j, (SELECT 0 AS copy UNION ALL SELECT 1) c WHERE reason IS NULL)
"""


def _template_files(t):
    ord_ = F.col("ord")
    zone = F.concat(
        F.lit('{"x":'), F.col("x").cast("string"), F.lit(',"y":'), F.col("y").cast("string"), F.lit(',"width":'),
        F.col("width").cast("string"), F.lit(',"height":'), F.col("height").cast("string"), F.lit(',"note":"'), "note",
        F.lit('"}'),
    )
    template = F.concat(
        F.lit('{"id":"t'), ord_.cast("string"), F.lit('","name":"'),
        F.when(ord_ % 23 == 0, "  ").otherwise(F.concat(F.lit(" Head  "), ord_.cast("string"))), F.lit('","combo":"'),
        "combo", F.lit('","width":'), F.when(ord_ % 19 == 0, "0").otherwise(F.col("ref_width").cast("string")),
        F.lit(',"height":'), F.col("ref_height").cast("string"), F.lit(',"zones":['),
        F.when(ord_ % 17 == 0, "").otherwise(zone), F.lit(']}'),
    )
    text = F.concat(F.lit('{"format":"any-templates","version":1,"templates":['), template, F.lit(","), template, F.lit("]}"))
    return dealt(t.lay2.select(F.concat(F.lit("templates"), ord_.cast("string")).alias("path"), text.alias("text")), "path")


@query(
    "S6_read_templates",
    _TEMPLATE_FILES + """SELECT 'Head ' || CAST(ord AS STRING) AS name, combo, ref_width AS template_width, ref_height AS template_height, '2026' AS created_at,
 CASE WHEN copy = 0 THEN 't' || CAST(ord AS STRING) END AS kept_id, x, y, width, height, note FROM copies""",
    ("lay2",),
)
def read_templates(t):
    templates, zones, _ = E.parse_templates(_template_files(t), None, "2026")
    own = F.concat(F.lit("t"), F.regexp_extract("file", "([0-9]+)$", 1))
    named = templates.withColumnsRenamed({"width": "template_width", "height": "template_height"})
    return named.join(zones, "template_id").select(
        "name", "combo", "template_width", "template_height", "created_at",
        F.when(F.col("template_id") == own, F.col("template_id")).alias("kept_id"), *ZONE,
    )


@query("S6_rejected_templates", _TEMPLATE_FILES + "SELECT file AS path, reason FROM judged WHERE reason IS NOT NULL", ("lay2",))
def rejected_templates(t):
    return E.parse_templates(_template_files(t))[2]


@query(
    "S6_known_templates_skipped",
    _TEMPLATE_FILES + "SELECT file, count(*) AS templates FROM copies WHERE copy = 1 OR note = '' GROUP BY file",
    ("lay2",),
)
def known_templates_skipped(t):
    known = t.lay2.filter("note <> ''").select(F.concat(F.lit("t"), F.col("ord").cast("string")).alias("template_id"))
    return E.parse_templates(_template_files(t), known)[0].groupBy("file").agg(F.count("*").alias("templates"))


@query(
    "W4_rekey_duplicates",
    """SELECT combo AS old_id, count(*) AS rows, count(*) AS ids, 1 AS kept FROM lay2 GROUP BY combo""",
    ("lay2",),
)
def rekey_duplicates(t):
    rows = t.lay2.select(F.lit("file").alias("path"), "combo", F.col("combo").alias("id"), "ord")
    return E.rekey(rows, ["path"], "id", ["ord"]).groupBy(F.col("combo").alias("old_id")).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"),
        F.sum(F.when(F.col("id") == F.col("combo"), 1).otherwise(0)).cast("int").alias("kept"),
    )


def _comma(partition: str, order: str) -> str:
    over = f"PARTITION BY {partition} ORDER BY {order} DESC" if partition else f"ORDER BY {order} DESC"
    return f"CASE WHEN row_number() OVER ({over}) = 1 THEN '' ELSE ',' END"


def _zone_lines(indent: int) -> str:
    pad = " " * indent
    fields = f" || ',' || {_NL} || ".join(f"'{pad}  \"{c}\": ' || CAST(z.{c} AS STRING)" for c in ("x", "y", "width", "height"))
    return f"'{pad}{{' || {_NL} || {fields} || ',' || {_NL} || '{pad}  \"note\": \"' || z.note || '\"' || {_NL} || '{pad}}}'"


_NOW = "2026-01-01T00:00:00.000Z"
_HEAD = (
    "'{{' || chr(10) || '  \"format\": \"zonespark-{kind}\",' || chr(10) || '  \"version\": 1,' || chr(10) || "
    "'  \"generated_at\": \"" + _NOW + "\",' || chr(10) || '  \"{items}\": ['"
)
_STRINGS = [
    ("id", "image_id"), ("name", "name"), ("path", "path"), ("combo", "combo"), ("width", None), ("height", None),
    ("kind", "kind"), ("frameCount", None), ("frameIndex", None),
]
_COLUMNS = {"width": "width", "height": "height", "frameCount": "frame_count", "frameIndex": "open_frame"}
_IMAGE_LINES = f" || ',' || {_NL} || ".join(
    f"'      \"{key}\": \"' || {column} || '\"'" if column else f"'      \"{key}\": ' || CAST({_COLUMNS[key]} AS STRING)"
    for key, column in _STRINGS
)
_METADATA = f" || ',' || {_NL} || ".join(
    f"'        \"{key}\": \"' || {column} || '\"'"
    for key, column in (("manufacturer", "manufacturer"), ("model", "model"), ("sopClass", "sop_class"), ("software", "software"))
)


@query(
    "S9_backup_document",
    f""", used AS (SELECT DISTINCT image_id, frame_index FROM zon),
listed AS (SELECT *, image_id IN (SELECT image_id FROM used) AS has_zones, {_comma('', 'import_idx')} AS comma FROM ims)
SELECT {_HEAD.format(kind='project', items='images').replace('{{', '{')} AS line
UNION ALL SELECT '  ]' || {_NL} || '}}'
UNION ALL SELECT '    {{' || {_NL} || {_IMAGE_LINES} || ',' || {_NL} || '      "metadata": {{' || {_NL} || {_METADATA} || {_NL} || '      }},' || {_NL}
 || '      "frames": {{' || CASE WHEN has_zones THEN '' ELSE '}}' || {_NL} || '    }}' || comma END FROM listed
UNION ALL SELECT '      }}' || {_NL} || '    }}' || comma FROM listed WHERE has_zones
UNION ALL SELECT '        "' || CAST(frame_index AS STRING) || '": [' FROM used
UNION ALL SELECT '        ]' || {_comma('image_id', 'frame_index')} FROM used
UNION ALL SELECT {_zone_lines(10)} || {_comma('z.image_id, z.frame_index', 'z.ord')} FROM zon z""".replace("{{", "{").replace("}}", "}"),
    ("ims", "zon"),
)
def backup_document(t):
    return O.backup_document(t.ims, t.zon, _NOW).select("line")


_TEMPLATE_LINES = f" || ',' || {_NL} || ".join(
    [
        "'      \"id\": \"' || id || '\"'", "'      \"name\": \"Layout ' || combo || '\"'", "'      \"combo\": \"' || combo || '\"'",
        "'      \"width\": ' || CAST(ref_width AS STRING)", "'      \"height\": ' || CAST(ref_height AS STRING)",
        "'      \"createdAt\": \"2026\"'",
    ]
)


@query(
    "S9_templates_document",
    f""", listed AS (SELECT *, combo || '/' || CAST(ref_width AS STRING) AS id FROM lays2)
SELECT {_HEAD.format(kind='templates', items='templates').replace('{{', '{')} AS line
UNION ALL SELECT '  ]' || {_NL} || '}}'
UNION ALL SELECT '    {{' || {_NL} || {_TEMPLATE_LINES} || ',' || {_NL} || '      "zones": [' FROM listed
UNION ALL SELECT '      ]' || {_NL} || '    }}' || CASE WHEN row_number() OVER (ORDER BY CAST(combo AS INT) DESC, ref_width DESC, ref_height DESC) = 1 THEN '' ELSE ',' END FROM listed
UNION ALL SELECT {_zone_lines(8)} || {_comma('z.combo, z.ref_width, z.ref_height', 'z.ord')} FROM lay2 z""".replace("{{", "{").replace("}}", "}"),
    ("lays2",),
)
def templates_document(t):
    key = F.concat_ws("/", "combo", "ref_width").alias("template_id")
    templates = t.lays2.select(
        key, F.concat(F.lit("Layout "), "combo").alias("name"), "combo", F.col("ref_width").alias("width"),
        F.col("ref_height").alias("height"), F.lit("2026").alias("created_at"),
    )
    return O.templates_document(templates, t.lay2.select(key, "ord", *ZONE), _NOW).select("line")


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.ims.sparkSession)}/{name}-{uuid.uuid4().hex}"


# A backup is refused with any zone off its raster, as every record is a backup of one image.
_WHOLE = """, bad AS (SELECT DISTINCT z.image_id FROM zon z JOIN ims i ON i.image_id = z.image_id
 WHERE z.x < 0 OR z.y < 0 OR z.width <= 0 OR z.height <= 0 OR z.x + z.width > i.width OR z.y + z.height > i.height)"""


@query(
    "S9_backup_round_trip",
    _WHOLE + """ SELECT i.image_id, i.name, i.path, i.combo, i.width, i.height, i.frame_count, i.open_frame, i.kind, i.manufacturer, i.model, i.sop_class,
 i.software, row_number() OVER (ORDER BY i.import_idx) - 1 AS import_idx FROM ims i WHERE i.image_id NOT IN (SELECT image_id FROM bad)""",
    ("ims", "zon"),
)
def backup_round_trip(t):
    folder = _folder(t, "backup")
    O.write_backup(folder, t.ims, t.zon, _NOW, "gzip")
    return E.read_backup(t.ims.sparkSession, folder)[0].select(
        "image_id", "name", "path", "combo", "width", "height", "frame_count", "open_frame", "kind", "manufacturer", "model", "sop_class", "software",
        "import_idx",
    )


@query(
    "S9_backup_zones_round_trip",
    _WHOLE + """ SELECT image_id, frame_index, CAST(row_number() OVER (PARTITION BY image_id, frame_index ORDER BY ord) - 1 AS BIGINT) AS ord,
 x, y, width, height, note FROM zon WHERE image_id NOT IN (SELECT image_id FROM bad)""",
    ("ims", "zon"),
)
def backup_zones_round_trip(t):
    folder = _folder(t, "backup")
    O.write_backup(folder, t.ims, t.zon, _NOW, "gzip")
    return E.read_backup(t.ims.sparkSession, folder)[1].drop("file")


@query(
    "S5_read_document",
    """ SELECT i.image_id, i.name, i.path, i.combo, i.width, i.height, i.frame_count, i.open_frame, i.kind, i.manufacturer, i.model, i.sop_class, i.software,
 row_number() OVER (ORDER BY i.import_idx) - 1 AS import_idx, (SELECT count(*) FROM nz z WHERE z.image_id = i.image_id) AS zones FROM ims i""",
    ("ims", "nz"),
)
def read_document(t):
    """One document over the whole library, written in parts and read back as one, in splits."""
    folder = _folder(t, "document")
    O.write_backup_document(folder, t.ims, t.nz, _NOW, "gzip")
    found, zones, _ = E.read_backup(t.ims.sparkSession, folder, one_document=True)
    counts = zones.groupBy("image_id").agg(F.count("*").alias("zones"))
    return found.join(counts, "image_id", "left").select(
        "image_id", "name", "path", "combo", "width", "height", "frame_count", "open_frame", "kind", "manufacturer", "model", "sop_class", "software",
        "import_idx", F.coalesce("zones", F.lit(0)).alias("zones"),
    )


@query(
    "S5_read_document_zones",
    "SELECT image_id, frame_index, CAST(row_number() OVER (PARTITION BY image_id, frame_index ORDER BY ord) - 1 AS BIGINT) AS ord, x, y, width, height, note FROM nz",
    ("nz",),
)
def read_document_zones(t):
    folder = _folder(t, "document")
    O.write_backup_document(folder, t.ims, t.nz, _NOW, "gzip")
    return E.read_backup(t.ims.sparkSession, folder, one_document=True)[1].drop("file")


@query(
    "S9_templates_round_trip",
    """, bad AS (SELECT DISTINCT combo, ref_width, ref_height FROM lay2 WHERE x + width > ref_width OR y + height > ref_height)
SELECT 'Layout ' || l.combo AS name, l.combo, l.ref_width AS width, l.ref_height AS height, '2026' AS created_at, count(*) AS zones
FROM lay2 l WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.combo = l.combo AND b.ref_width = l.ref_width AND b.ref_height = l.ref_height)
GROUP BY l.combo, l.ref_width, l.ref_height""",
    ("lays2",),
)
def templates_round_trip(t):
    folder = _folder(t, "templates")
    key = F.concat_ws("/", "combo", "ref_width").alias("template_id")
    templates = t.lays2.select(
        key, F.concat(F.lit("Layout "), "combo").alias("name"), "combo", F.col("ref_width").alias("width"),
        F.col("ref_height").alias("height"), F.lit("2026").alias("created_at"),
    )
    O.write_templates(folder, templates, t.lay2.select(key, "ord", *ZONE), _NOW)
    found, zones, _ = E.read_templates(t.ims.sparkSession, folder)
    return found.join(zones.groupBy("template_id").agg(F.count("*").alias("zones")), "template_id").drop("template_id", "file")


# One definition per supplier; by turns they lack a name or zones, read an unknown source, or name a taken key.
def _definitions(t):
    key = F.col("s_suppkey")

    def by_turns(n: int, bad: str, good: str):
        return F.when(key % n == 0, bad).otherwise(good)

    text = F.concat(
        F.lit('{"id":"s'), F.expr("s_suppkey div 2 * 2").cast("string"), F.lit('","name":"'),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("Schema "), key.cast("string"))),
        F.lit('","zone":'), by_turns(7, "{}", '{"left":"x"}'), F.lit(',"entry":{"make":"'), by_turns(11, "patient", "manufacturer"),
        F.lit('"},"root":'), by_turns(13, '{"annotations":1}', "{}"), F.lit(',"shape":"'), by_turns(3, "flat", "nested"), F.lit('"}'),
    )
    return t.supplier.select(key.cast("long").alias("key"), text.alias("definition"))


_ORDERLY = "s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0"


@query(
    "E5_validate_schemas",
    f"""SELECT CAST(s_suppkey AS BIGINT) AS key, CAST((s_suppkey % 5 = 0)::INT + (s_suppkey % 7 = 0)::INT + (s_suppkey % 11 = 0)::INT
 + (s_suppkey % 13 = 0)::INT AS BIGINT) AS defects,
 CASE WHEN {_ORDERLY} THEN CASE WHEN s_suppkey % 3 = 0 THEN 'flat' ELSE 'nested' END END AS shape FROM supplier""",
)
def validate_schemas(t):
    schemas, defects = E.judge_definitions(_definitions(t))
    nothing = F.lit(None).cast("string")
    return schemas.select("key", F.lit(0).cast("long").alias("defects"), "shape").unionByName(
        defects.select("key", F.size("defects").cast("long").alias("defects"), nothing.alias("shape"))
    )


def _schema_records(t) -> str:
    """A folder of schema files written as records, one schema each, in order of their keys."""
    folder = f"{shared_folder(t.supplier.sparkSession)}/schemas-{uuid.uuid4().hex}"
    record = F.concat(F.lit('{"format":"any-schema","version":1,"schemas":['), "definition", F.lit("]}"))
    _definitions(t).orderBy("key").select(record.alias("value")).write.text(folder)
    return folder


@query(
    "S7_read_schemas",
    f"""SELECT 'Schema ' || CAST(s_suppkey AS STRING) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'flat' ELSE 'nested' END AS shape,
 CASE WHEN row_number() OVER (PARTITION BY s_suppkey // 2 ORDER BY s_suppkey) = 1 THEN 's' || CAST(s_suppkey // 2 * 2 AS STRING) END AS kept_id,
 '{{"left":"x"}}' AS zone FROM supplier WHERE {_ORDERLY}""",
)
def read_schemas(t):
    found, _ = E.read_schemas(t.supplier.sparkSession, _schema_records(t))
    # Ids made for later copies are 32 hexadecimal digits.
    kept = F.when(F.col("schema_id").rlike("^s[0-9]+$"), F.col("schema_id"))
    return found.select("name", "shape", kept.alias("kept_id"), "zone")


@query(
    "S7_rejected_schemas",
    f"""SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'entry' WHEN s_suppkey % 5 = 0 THEN 'name' WHEN s_suppkey % 7 = 0 THEN 'zone' ELSE 'root' END AS part,
 count(*) AS files FROM supplier WHERE NOT ({_ORDERLY}) GROUP BY ALL""",
)
def rejected_schemas(t):
    _, rejects = E.read_schemas(t.supplier.sparkSession, _schema_records(t))
    return rejects.groupBy(F.regexp_extract("reason", "^([a-z]+):", 1).alias("part")).agg(F.count("*").alias("files"))
