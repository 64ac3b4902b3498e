"""Export groups, conflicts and documents."""

import uuid

from pyspark.sql import functions as F

from zonespark.catalog.registry import ORACLES, query
from zonespark.catalog.zones import UNION_CTES, UNION_VIEWS
from zonespark.export_schema import validate_export_schema
from zonespark.operators import export as X
from zonespark.plans.documents import write_document_parts
from zonespark.plans.ordering import shared_folder, with_global_rank
from zonespark.schemas import DEVICE, ZONE
from zonespark.sources import documents as O
from zonespark.sources.ranged import document_parts

NOW = "2026-01-01T00:00:00.000Z"
_ZONE = "x, y, width, height, note"
_DEVICE = "manufacturer, model, sop_class, software"

# Parts of every group: annotated images by device, and promoted layouts as groups of their own.
_PARTS = f""", annotated AS (SELECT * FROM ims i WHERE EXISTS (SELECT 1 FROM zon z WHERE z.image_id = i.image_id)),
parts AS (
 SELECT 'attributes' AS kind, manufacturer || chr(1) || model || chr(1) || sop_class || chr(1) || software AS grp,
  width AS ref_width, height AS ref_height, combo, {_DEVICE}, image_id, 0 AS origin, import_idx AS idx,
  CASE WHEN manufacturer <> '' AND model <> '' AND sop_class <> '' AND software <> '' THEN 'dicom_tags' ELSE 'partial' END AS source
 FROM annotated
 UNION ALL SELECT 'imported', combo, ref_width, ref_height, combo, '', '', '', '', NULL, 1, layout_idx, 'imported' FROM lays WHERE promoted),
placed AS (
 SELECT p.kind, p.grp, p.ref_width, p.ref_height, z.x, z.y, z.width, z.height, z.note, p.origin, p.idx, z.frame_index AS frame, CAST(z.ord AS BIGINT) AS ord
 FROM parts p JOIN nz z ON z.image_id = p.image_id WHERE p.kind = 'attributes'
 UNION ALL SELECT p.kind, p.grp, p.ref_width, p.ref_height, l.x, l.y, l.width, l.height, l.note, 1, p.idx, 0, l.ord
 FROM parts p JOIN lay l ON l.combo = p.combo AND l.ref_width = p.ref_width AND l.ref_height = p.ref_height
 WHERE p.kind = 'imported' AND l.x < l.ref_width AND l.y < l.ref_height),
dz AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, grp, ref_width, ref_height, {_ZONE} ORDER BY origin, idx, frame, ord) AS rn
  FROM placed) p WHERE rn = 1),
sizes AS (
 SELECT p.kind, p.grp, p.ref_width, p.ref_height, count(*) AS file_count,
  (SELECT count(*) FROM dz WHERE dz.kind = p.kind AND dz.grp = p.grp AND dz.ref_width = p.ref_width AND dz.ref_height = p.ref_height) AS zone_count
 FROM parts p GROUP BY p.kind, p.grp, p.ref_width, p.ref_height),
labels AS (
 SELECT kind, grp, combo AS combo_id FROM (
  SELECT kind, grp, combo, row_number() OVER (PARTITION BY kind, grp ORDER BY count(*) DESC, combo = '', try_cast(combo AS DOUBLE), min(origin), min(idx)) AS rn
  FROM parts GROUP BY kind, grp, combo) c WHERE rn = 1),
rows AS (
 SELECT p.kind, p.grp, l.combo_id, min(p.manufacturer) AS manufacturer, min(p.model) AS model, min(p.sop_class) AS sop_class,
  min(p.software) AS software_version, min(p.source) AS attributes_source, count(*) AS file_count,
  (SELECT CAST(sum(zone_count) AS BIGINT) FROM sizes s WHERE s.kind = p.kind AND s.grp = p.grp) AS zone_count, min(p.origin) AS origin, min(p.idx) AS idx
 FROM parts p JOIN labels l ON l.kind = p.kind AND l.grp = p.grp GROUP BY p.kind, p.grp, l.combo_id)
"""
_VIEWS = ("ims", "nz", "lays")
_FIELDS = "combo_id, manufacturer, model, sop_class, software_version, attributes_source, file_count, zone_count"


def _tables(t, group_by="attributes"):
    return X.export_tables(t.ims, t.zon, t.lays, t.lay.drop("promoted"), group_by)


@query("A8_export_rows", _PARTS + f"SELECT {_FIELDS} FROM rows", _VIEWS)
def export_rows(t):
    return _tables(t).rows.select(*_FIELDS.split(", "))


@query(
    "A8_export_sizes",
    _PARTS + "SELECT kind, grp, ref_width, ref_height, CAST(ref_width AS STRING) || 'x' || CAST(ref_height AS STRING) AS size, file_count, zone_count FROM sizes",
    _VIEWS,
)
def export_sizes(t):
    grp = F.when(F.col("group_key.kind") == "imported", F.col("group_key.k0")).otherwise(
        F.concat_ws("\x01", *[F.col(f"group_key.k{i}") for i in range(4)])
    )
    return _tables(t).sizes.select(
        F.col("group_key.kind").alias("kind"), grp.alias("grp"), "ref_width", "ref_height", "size", "file_count", "zone_count"
    )


@query(
    "A8_export_zones",
    _PARTS + f"SELECT kind, grp, ref_width, ref_height, {_ZONE}, idx AS first_idx, frame AS first_frame, ord AS first_ord FROM dz",
    _VIEWS,
)
def export_zones(t):
    grp = F.when(F.col("group_key.kind") == "imported", F.col("group_key.k0")).otherwise(
        F.concat_ws("\x01", *[F.col(f"group_key.k{i}") for i in range(4)])
    )
    return _tables(t).zones.select(
        F.col("group_key.kind").alias("kind"), grp.alias("grp"), "ref_width", "ref_height", *ZONE,
        F.col("first.import_idx").alias("first_idx"), F.col("first.frame_index").alias("first_frame"),
        F.col("first.ord").alias("first_ord"),
    )


_BY_COMBO = f""", annotated AS (SELECT * FROM ims i WHERE EXISTS (SELECT 1 FROM zon z WHERE z.image_id = i.image_id)),
variants AS (
 SELECT combo, {_DEVICE}, count(*) AS files, min(import_idx) AS idx FROM annotated GROUP BY combo, {_DEVICE}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY files DESC, idx) AS rn FROM variants) v WHERE rn = 1)
"""


@query(
    "A8_export_rows_by_combo",
    _BY_COMBO + """SELECT a.combo AS combo_id, b.manufacturer, b.model, b.sop_class, b.software AS software_version,
 CASE WHEN (SELECT count(*) FROM variants v WHERE v.combo = a.combo) > 1 THEN 'mixed'
  WHEN b.manufacturer <> '' AND b.model <> '' AND b.sop_class <> '' AND b.software <> '' THEN 'dicom_tags' ELSE 'partial' END AS attributes_source,
 count(*) AS file_count,
 (SELECT count(*) FROM (SELECT DISTINCT i.width AS w, i.height AS h, z.x, z.y, z.width, z.height, z.note FROM nz z
  JOIN ims i ON i.image_id = z.image_id WHERE i.combo = a.combo) d) AS zone_count
FROM annotated a JOIN best b ON b.combo = a.combo
GROUP BY a.combo, b.manufacturer, b.model, b.sop_class, b.software""",
    ("ims", "nz"),
)
def export_rows_by_combo(t):
    return X.export_tables(t.ims, t.zon, group_by="combo").rows.select(*_FIELDS.split(", "))


@query("A9_resolve_combo_id", _PARTS + "SELECT kind, grp, combo_id FROM labels WHERE kind = 'attributes'", _VIEWS)
def resolve_combo_id(t):
    key = F.concat_ws("\x01", *DEVICE).alias("grp")
    annotated = t.ims.join(t.zon.select("image_id").distinct(), "image_id", "left_semi")
    counted = annotated.groupBy(F.lit("attributes").alias("kind"), key, "combo").agg(
        F.count("*").alias("files"), F.min("import_idx").alias("first")
    )
    return X.resolve_combo_id(counted, ["kind", "grp"])


@query("A10_modal_attributes", _BY_COMBO + f"SELECT combo, {_DEVICE}, (SELECT count(*) FROM variants v WHERE v.combo = b.combo) AS variants FROM best b", ("ims", "zon"))
def modal_attributes(t):
    annotated = t.ims.join(t.zon.select("image_id").distinct(), "image_id", "left_semi")
    counted = annotated.groupBy("combo", *DEVICE).agg(F.count("*").alias("files"), F.min("import_idx").alias("first"))
    return X.modal_attributes(counted, ["combo"]).select("combo", "attributes.*", "variants")


_CONFLICTS = f""", annotated AS (SELECT * FROM ims i WHERE combo <> '' AND EXISTS (SELECT 1 FROM zon z WHERE z.image_id = i.image_id)),
variants AS (
 SELECT combo, {_DEVICE}, count(*) AS files, string_agg(CASE WHEN rn <= 3 THEN name END, ', ' ORDER BY rn) AS shown_files,
  min(CASE WHEN rn = 1 THEN name END) AS first_file FROM (
  SELECT *, row_number() OVER (PARTITION BY combo, {_DEVICE} ORDER BY import_idx) AS rn FROM annotated) a GROUP BY combo, {_DEVICE}),
conflicts AS (SELECT *, count(*) OVER (PARTITION BY combo) AS variants FROM variants QUALIFY count(*) OVER (PARTITION BY combo) > 1)
"""


@query("A11_combo_conflicts", _CONFLICTS + "SELECT * FROM conflicts", ("ims", "zon"))
def combo_conflicts(t):
    return X.combo_conflicts(t.ims, t.zon)


@query(
    "A12_conflict_report",
    _CONFLICTS + """SELECT combo, 0 AS line, NULL AS files, NULL AS first_file,
 'Combo ' || combo || ' holds ' || CAST(max(variants) AS STRING) || ' different device combinations:' AS text FROM conflicts GROUP BY combo
UNION ALL SELECT combo, 1, files, first_file, '  ' || coalesce(nullif(concat_ws(' · ', nullif(manufacturer, ''), nullif(model, ''),
  nullif(sop_class, ''), nullif(software, '')), ''), 'no device tags') || ' — ' || CAST(files AS STRING)
 || CASE WHEN files = 1 THEN ' file: ' ELSE ' files: ' END || shown_files
 || CASE WHEN files > 3 THEN ', and ' || CAST(files - 3 AS STRING) || ' more' ELSE '' END FROM conflicts""",
    ("ims", "zon"),
)
def conflict_report(t):
    return X.conflict_report(X.combo_conflicts(t.ims, t.zon))


@query(
    "O5_conflict_files",
    _CONFLICTS + "SELECT combo, files, shown_files FROM conflicts",
    ("ims", "zon"),
)
def conflict_files(t):
    return X.combo_conflicts(t.ims, t.zon).select("combo", "files", "shown_files")


@query(
    "O3_export_row_order",
    _PARTS + f"""SELECT {_FIELDS}, row_number() OVER (ORDER BY coalesce(try_cast(nullif(combo_id, '') AS DOUBLE), 'inf'::DOUBLE),
 manufacturer, model, sop_class, software_version, origin, idx) - 1 AS place FROM rows""",
    _VIEWS,
)
def export_row_order(t):
    order = [c.alias(f"o{i}") for i, c in enumerate(X.row_order())]
    rows = _tables(t).rows.select(*_FIELDS.split(", "), *order)
    ranked = with_global_rank(rows, [f"o{i}" for i in range(len(order))], "place")
    return ranked.select(*_FIELDS.split(", "), "place")


_NL = "chr(10)"


def _zone_text(indent: int, names=("x", "y", "width", "height")) -> str:
    pad = " " * indent
    inner = f"',' || {_NL} || ".join(
        [f"'{pad}  \"{n}\": ' || CAST({c} AS STRING) || " for n, c in zip(names, ("x", "y", "width", "height"))]
    )
    note = f"'{pad}  \"note\": \"' || note || '\"'"
    return f"'{pad}{{' || {_NL} || {inner}',' || {_NL} || {note} || {_NL} || '{pad}}}'"


def _size_text(indent: int, key: str, holder: str = "zones") -> str:
    pad = " " * indent
    return (
        f"'{pad}\"' || {key} || '\": {{' || {_NL} || '{pad}  \"ref_width\": ' || CAST(ref_width AS STRING) || ',' || {_NL} || "
        f"'{pad}  \"ref_height\": ' || CAST(ref_height AS STRING) || ',' || {_NL} || '{pad}  \"{holder}\": ['"
    )


_SIZE = "CAST(ref_width AS STRING) || 'x' || CAST(ref_height AS STRING)"


def _ends(partition: str, order: str) -> str:
    """SQL for the comma after every row but the last of its partition, `order` running backwards."""
    over = f"PARTITION BY {partition} ORDER BY {order}" if partition else f"ORDER BY {order}"
    return f"CASE WHEN row_number() OVER ({over}) = 1 THEN '' ELSE ',' END"


_V1 = f""", firsts AS (
 SELECT combo, ref_width, ref_height, min((origin, idx, frame, ord)) AS first FROM uni GROUP BY combo, ref_width, ref_height),
combos AS (SELECT combo, min(first) AS first FROM firsts GROUP BY combo)
SELECT '{{' || {_NL} || '  "generated_at": "{NOW}",' || {_NL} || '  "annotations": {{' AS line
UNION ALL SELECT '  }}' || {_NL} || '}}'
UNION ALL SELECT '    "' || combo || '": {{' FROM combos
UNION ALL SELECT '    }}' || {_ends('', 'CAST(combo AS BIGINT) DESC')} FROM combos
UNION ALL SELECT {_size_text(6, _SIZE)} FROM firsts
UNION ALL SELECT '        ]' || {_NL} || '      }}' || {_ends('combo', 'first DESC')} FROM firsts
UNION ALL SELECT {_zone_text(10)} || {_ends('combo, ref_width, ref_height', 'origin DESC, idx DESC, frame DESC, ord DESC')} FROM uni"""


@query("E1_export_v1", _V1, UNION_VIEWS, UNION_CTES)
def export_v1(t):
    labelled = t.ims.filter(F.col("combo") != "")
    return X.export_v1(labelled, t.zon, NOW, t.lays, t.lay.drop("promoted")).select("line")


@query(
    "E1_blockers",
    """SELECT import_idx, name FROM ims WHERE NOT regexp_full_match(combo, '[0-9]+') AND image_id IN (SELECT image_id FROM zon)""",
    ("ims", "zon"),
)
def blockers(t):
    return X.export_blockers(t.ims, t.zon).select("import_idx", "name")


def _pair(indent: int, key: str, value: str) -> str:
    return f"'{' ' * indent}\"{key}\": ' || {value}"


def _quoted(column: str) -> str:
    return f"'\"' || {column} || '\"'"


_ROW_ORDER = """coalesce(try_cast(nullif({p}combo_id, '') AS DOUBLE), 'inf'::DOUBLE) DESC, {p}manufacturer DESC, {p}model DESC,
 {p}sop_class DESC, {p}software_version DESC, {p}origin DESC, {p}idx DESC"""
_ROW_TEXT = f" || ',' || {_NL} || ".join(
    _pair(6, c, _quoted(c))
    for c in ("combo_id", "manufacturer", "model", "sop_class", "software_version", "attributes_source")
)
_DZ_ORDER = "origin DESC, idx DESC, frame DESC, ord DESC"
_V2 = f"""SELECT '{{' || {_NL} || '  "schema_version": 2,' || {_NL} || '  "generated_at": "{NOW}",' || {_NL} || '  "annotations": [' AS line
UNION ALL SELECT '  ]' || {_NL} || '}}'
UNION ALL SELECT '    {{' || {_NL} || {_ROW_TEXT} || ',' || {_NL} || '      "sizes": {{' FROM rows
UNION ALL SELECT '      }}' || {_NL} || '    }}' || {_ends('', _ROW_ORDER.format(p=''))} FROM rows
UNION ALL SELECT {_size_text(8, _SIZE)} || CASE WHEN zone_count = 0 THEN ']' || {_NL} || '        }}' || {_ends('kind, grp', _SIZE + ' DESC')} ELSE '' END FROM sizes
UNION ALL SELECT line FROM (SELECT zone_count, '          ]' || {_NL} || '        }}' || {_ends('kind, grp', _SIZE + ' DESC')} AS line FROM sizes) c WHERE zone_count > 0
UNION ALL SELECT {_zone_text(12)} || {_ends('kind, grp, ref_width, ref_height', _DZ_ORDER)} FROM dz"""


@query("E2_export_v2", _PARTS + _V2, _VIEWS)
def export_v2(t):
    return X.export_v2(_tables(t), NOW).select("line")


@query("E2_document_file", f"SELECT unnest(string_split(line, chr(10))) AS line FROM ({ORACLES['E2_export_v2']})")
def document_file(t):
    """The export as one committed document, and its lines as they stand in the parts that the manifest lists."""
    spark = t.img.sparkSession
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    write_document_parts(X.export_v2(_tables(t), NOW), path)
    return spark.read.text([part for part, _, _ in document_parts(path)]).select(F.col("value").alias("line"))


_FLAT = validate_export_schema(
    {
        "name": "Rows", "shape": "flat", "root": {"schema_version": 3, "reviewed": False, "owner": None},
        "entry": {"combination": "combo_id", "make": "manufacturer", "raster": "size", "w": "ref_width", "files": "file_count"},
        "entry_constants": {"make": "any", "kind": "device"}, "zones_field": "boxes",
        "zone": {"left": "x", "top": "y", "w": "width", "h": "height"}, "zone_constants": {"label": "Redact"},
    },
    "rows",
)
_FLAT_ENTRY = f" || ',' || {_NL} || ".join(
    [
        _pair(6, "combination", _quoted("combo_id")), _pair(6, "make", "'\"any\"'"),
        _pair(6, "raster", _quoted(_SIZE)), _pair(6, "w", "CAST(ref_width AS STRING)"),
        _pair(6, "files", "CAST(files AS STRING)"), _pair(6, "kind", "'\"device\"'"),
    ]
)
_FLAT_ZONE = (
    _zone_text(8, ("left", "top", "w", "h")).replace('"note": "\' || note || \'"', '"label": "Redact"')
)
_FLAT_SQL = f""", flat AS (
 SELECT r.*, s.ref_width, s.ref_height, s.file_count AS files, s.zone_count AS zones,
  {_ends('', _ROW_ORDER.format(p='r.') + ', ' + _SIZE + ' DESC')} AS comma
 FROM sizes s JOIN rows r ON r.kind = s.kind AND r.grp = s.grp)
SELECT '{{' || {_NL} || '  "schema_version": 3,' || {_NL} || '  "reviewed": false,' || {_NL} || '  "owner": null,' || {_NL}
 || '  "generated_at": "{NOW}",' || {_NL} || '  "annotations": [' AS line
UNION ALL SELECT '  ]' || {_NL} || '}}'
UNION ALL SELECT '    {{' || {_NL} || {_FLAT_ENTRY} || ',' || {_NL} || '      "boxes": [' || CASE WHEN zones = 0 THEN ']' || {_NL} || '    }}' || comma ELSE '' END FROM flat
UNION ALL SELECT '      ]' || {_NL} || '    }}' || comma FROM flat WHERE zones > 0
UNION ALL SELECT {_FLAT_ZONE} || {_ends('kind, grp, ref_width, ref_height', _DZ_ORDER)} FROM dz"""


@query("E3_export_flat", _PARTS.rstrip() + _FLAT_SQL, _VIEWS)
def export_flat(t):
    return X.export_custom(_FLAT, _tables(t), NOW).select("line")


_NESTED = validate_export_schema(
    {
        "name": "Nested", "shape": "nested", "group_by": "attributes", "entries_field": "devices", "timestamp_field": "",
        "entry": {"model": "model", "files": "file_count"}, "sizes_field": "rasters", "size": {"n": "zone_count"},
        "zone": {"x": "x", "y": "y", "width": "width", "height": "height", "note": "note"},
    },
    "nested",
)
_NESTED_SQL = f"""SELECT '{{' || {_NL} || '  "devices": [' AS line
UNION ALL SELECT '  ]' || {_NL} || '}}'
UNION ALL SELECT '    {{' || {_NL} || {_pair(6, 'model', _quoted('model'))} || ',' || {_NL} || {_pair(6, 'files', 'CAST(file_count AS STRING)')}
 || ',' || {_NL} || '      "rasters": {{' FROM rows
UNION ALL SELECT '      }}' || {_NL} || '    }}' || {_ends('', _ROW_ORDER.format(p=''))} FROM rows
UNION ALL SELECT '        "' || {_SIZE} || '": {{' || {_NL} || '          "n": ' || CAST(zone_count AS STRING) || ',' || {_NL} || '          "zones": ['
 || CASE WHEN zone_count = 0 THEN ']' || {_NL} || '        }}' || {_ends('kind, grp', _SIZE + ' DESC')} ELSE '' END FROM sizes
UNION ALL SELECT line FROM (SELECT zone_count, '          ]' || {_NL} || '        }}' || {_ends('kind, grp', _SIZE + ' DESC')} AS line FROM sizes) c WHERE zone_count > 0
UNION ALL SELECT {_zone_text(12)} || {_ends('kind, grp, ref_width, ref_height', _DZ_ORDER)} FROM dz"""


@query("E3_export_nested", _PARTS + _NESTED_SQL, _VIEWS)
def export_nested(t):
    return X.export_custom(_NESTED, _tables(t), NOW).select("line")


@query(
    "S8_write_export",
    _PARTS.rstrip() + ", lines AS (" + _V2 + ") SELECT unnest(string_split(line, chr(10))) AS line FROM lines",
    _VIEWS,
)
def write_export(t):
    folder = f"{shared_folder(t.ims.sparkSession)}/export-{uuid.uuid4().hex}"
    path = O.write_export(folder, "v2", t.ims, t.zon, NOW, t.lays, t.lay.drop("promoted"))
    return t.ims.sparkSession.read.text(path).select(F.col("value").alias("line"))


@query("E4_export_unknown_format", _PARTS + _V2, _VIEWS)
def export_unknown_format(t):
    return X.export("nonsense", t.ims, t.zon, NOW, t.lays, t.lay.drop("promoted"))[0].select("line")


@query("E4_export_custom_format", _PARTS.rstrip() + _FLAT_SQL, _VIEWS)
def export_custom_format(t):
    return X.export("custom:rows", t.ims, t.zon, NOW, t.lays, t.lay.drop("promoted"), [_NESTED, _FLAT])[0].select("line")
