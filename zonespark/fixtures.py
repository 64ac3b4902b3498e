"""The operators' input tables, derived from the driver's tables by arithmetic (FIXTURES.md).

The SQL is read by Spark and, for the checks, by DuckDB, so it keeps to what both understand.
"""

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # One row per image file.
    "img": (
        ["orders"],
        """SELECT o_orderkey AS import_idx,
 lpad(CAST(o_orderkey AS STRING),64,'0') AS image_id,
 CASE WHEN o_custkey % 17 = 0 THEN '' ELSE CAST(o_custkey % 20 + 1 AS STRING) END AS combo,
 CASE WHEN o_orderkey % 3 = 0 THEN 1024 ELSE 640 END AS width,
 CASE WHEN o_orderkey % 3 = 0 THEN 768 ELSE 480 END AS height,
 CAST(o_orderkey % 4 + 1 AS INT) AS frame_count,
 CAST(o_orderkey % (o_orderkey % 4 + 1) AS INT) AS open_frame,
 CASE WHEN o_orderkey % 10 = 0 THEN 'PNG' ELSE 'DICOM' END AS kind,
 CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CASE WHEN o_custkey % 20 < 10 THEN 'GE Medical Systems' ELSE 'Philips' END END AS manufacturer,
 CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'MODEL' || CAST(o_custkey % 20 % 7 AS STRING) END AS model,
 CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '1.2.840.10008.5.1.4.1.1.6.1' END AS sop_class,
 CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN 'R9.0.0' ELSE 'R7.0.2' END AS software,
 o_orderkey % 23 <> 0 AS has_source
FROM orders""",
    ),
    # The same images under file names that parse, disagree with the raster, or do not parse at all.
    "ims": (
        ["img"],
        """SELECT *, 'batch_' || CAST(import_idx % 8 AS STRING) || '/' || name AS path FROM (
 SELECT *, CASE WHEN combo = '' THEN 'scan_' || CAST(import_idx AS STRING) || '.dcm'
  ELSE (CASE WHEN import_idx % 2 = 0 THEN 'combo' ELSE 'COMBO' END) || (CASE WHEN import_idx % 5 = 0 THEN '0' ELSE '' END) || combo || '_'
   || (CASE WHEN import_idx % 50 = 1 THEN '800x600' ELSE CAST(width AS STRING) || 'x' || CAST(height AS STRING) END)
   || '_s' || CAST(import_idx AS STRING) || (CASE WHEN kind = 'PNG' THEN '.png' ELSE '.dcm' END) END AS name
 FROM img) named""",
    ),
    # Raw zones: some hang off the left edge, some have no width, many repeat across images.
    "zon": (
        ["lineitem", "img"],
        """SELECT i.image_id, CAST(l_linenumber % i.frame_count AS INT) AS frame_index,
 CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber % i.frame_count ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) - 1 AS INT) AS ord,
 CAST(l_suppkey % 10 * 64 - 8 AS INT) AS x, CAST(l_linenumber * 40 - 40 AS INT) AS y,
 CASE WHEN l_quantity >= 48 THEN 0 ELSE CAST(l_quantity AS INT) % 4 * 60 + 60 END AS width, 24 AS height,
 CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS note
FROM lineitem l JOIN img i ON i.import_idx = l.l_orderkey""",
    ),
    # zon cut to the raster: what the checks compare clipping with.
    "nz": (
        ["zon", "img"],
        """SELECT image_id, frame_index, ord, x1 AS x, y1 AS y, x2-x1 AS width, y2-y1 AS height, note FROM (
 SELECT z.*, greatest(0,least(i.width,z.x)) AS x1, greatest(0,least(i.height,z.y)) AS y1,
  greatest(0,least(i.width,z.x+z.width)) AS x2, greatest(0,least(i.height,z.y+z.height)) AS y2
 FROM (SELECT image_id,frame_index,ord,x,y,width,height,note FROM zon) z JOIN img i ON z.image_id=i.image_id) q WHERE x2>x1 AND y2>y1""",
    ),
    # Text boxes with a confidence, on at most 1,500 images, so frames get dense as the data grows.
    "det": (
        ["events", "img"],
        """SELECT i.image_id, CAST(e.event_id % i.frame_count AS INT) AS frame_index, e.event_id AS ord,
 CAST(e.event_id % 10 * 64 + e.user_id % 30 AS INT) AS x, CAST(e.event_id % 7 * 40 + 2 AS INT) AS y,
 CAST(least(i.width, e.event_id % 10 * 64 + e.user_id % 30 + 20 + e.user_id % 50) - (e.event_id % 10 * 64 + e.user_id % 30) AS INT) AS width,
 18 AS height, e.event_type AS text, CAST(floor(e.value) AS INT) % 101 AS confidence
FROM events e JOIN img i ON i.import_idx = e.event_id % 1500""",
    ),
    # Crowded frames: a dozen words each at every scale, many of them near enough to join.
    "tight": (
        ["events", "img"],
        """SELECT i.image_id, CAST(0 AS INT) AS frame_index, e.event_id AS ord,
 CAST(e.user_id * 37 % 560 AS INT) AS x, CAST(e.event_id % 4 * 60 + e.user_id % 7 AS INT) AS y,
 CAST(20 + e.user_id % 50 AS INT) AS width, CAST(12 + e.event_id % 9 AS INT) AS height,
 e.event_type || ' ' || CAST(e.event_id % 10 AS STRING) AS text, CAST(floor(e.value) AS INT) % 101 AS confidence
FROM events e JOIN img i ON i.import_idx = CAST(floor(e.event_id / 12) AS BIGINT) + 1""",
    ),
    # Recognition results before any padding or clamping: fractional edges, two scales, short and long text.
    "reg": (
        ["events", "img"],
        """SELECT i.image_id, CAST(e.event_id % i.frame_count AS INT) AS frame_index, e.event_id AS region_ord,
 CAST(CASE WHEN e.event_id % 1500 % 2 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS scale,
 CAST((e.event_id % 11 * 64 + e.user_id % 3 - 3.5) * (CASE WHEN e.event_id % 1500 % 2 = 0 THEN 1 ELSE 2 END) AS DOUBLE) AS x0,
 CAST((e.event_id % 7 * 70 + 0.25) * (CASE WHEN e.event_id % 1500 % 2 = 0 THEN 1 ELSE 2 END) AS DOUBLE) AS y0,
 CAST((e.event_id % 11 * 64 + e.user_id % 3 + e.user_id % 4 * 25 + 0.5) * (CASE WHEN e.event_id % 1500 % 2 = 0 THEN 1 ELSE 2 END) AS DOUBLE) AS x1,
 CAST((e.event_id % 7 * 70 + e.user_id % 3 * 9 + 2.5) * (CASE WHEN e.event_id % 1500 % 2 = 0 THEN 1 ELSE 2 END) AS DOUBLE) AS y1,
 CASE WHEN e.user_id % 5 = 0 THEN ' ~ ' || CAST(e.event_id % 3 AS STRING) WHEN e.user_id % 5 = 1 THEN '..' ELSE '  ' || e.event_type || '  at ' || e.props END AS text,
 e.value AS confidence
FROM events e JOIN img i ON i.import_idx = e.event_id % 1500""",
    ),
    # Zones of imported layouts; promoted is a function of combo, so one per layout.
    "lay": (
        ["supplier"],
        """SELECT CAST(s_suppkey % 20 + 1 AS STRING) AS combo, CASE WHEN s_suppkey % 3 = 0 THEN 1024 ELSE 640 END AS ref_width,
 CASE WHEN s_suppkey % 3 = 0 THEN 768 ELSE 480 END AS ref_height, CAST(s_suppkey AS BIGINT) AS ord,
 CAST(s_suppkey % 9 * 64 AS INT) AS x, CAST(s_nationkey * 16 AS INT) AS y, 120 AS width, 24 AS height, '' AS note, s_suppkey % 20 % 2 = 0 AS promoted
FROM supplier""",
    ),
    # The layouts themselves, in the order of their first zone.
    "lays": (
        ["lay"],
        """SELECT combo, ref_width, ref_height, promoted, min(ord) AS layout_idx FROM lay GROUP BY combo, ref_width, ref_height, promoted""",
    ),
    # A second delivery of layouts: known keys with known and new zones, and keys nobody has yet.
    "lay2": (
        ["customer"],
        """SELECT CAST(c_custkey % 26 + 1 AS STRING) AS combo, CASE WHEN c_custkey % 3 = 0 THEN 1024 ELSE 640 END AS ref_width,
 CASE WHEN c_custkey % 3 = 0 THEN 768 ELSE 480 END AS ref_height, CAST(c_custkey AS BIGINT) AS ord,
 CAST(c_custkey % 9 * 64 AS INT) AS x, CAST(c_nationkey * 16 AS INT) AS y, 120 AS width, 24 AS height,
 CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END AS note
FROM customer""",
    ),
    "lays2": (
        ["lay2"],
        """SELECT combo, ref_width, ref_height, false AS promoted, min(ord) AS layout_idx FROM lay2 GROUP BY combo, ref_width, ref_height""",
    ),
    # Tag rows: standard, private, sequence, repeating 60xx group, Burned In Annotation.
    "tag": (
        ["part"],
        """SELECT lpad(CAST(p_partkey % 100 AS STRING),64,'0') AS image_id, CAST(p_partkey AS BIGINT) AS row_idx,
 CASE p_partkey % 8 WHEN 0 THEN '00100010' WHEN 1 THEN '00100030' WHEN 2 THEN '00280010' WHEN 3 THEN '00280301'
  WHEN 4 THEN '00111001' WHEN 5 THEN '60124000' WHEN 6 THEN '00081110' ELSE '00081155' END AS hex,
 CASE p_partkey % 8 WHEN 0 THEN 'PN' WHEN 1 THEN 'DA' WHEN 2 THEN 'US' WHEN 3 THEN 'CS' WHEN 4 THEN 'LO' WHEN 5 THEN 'LT' WHEN 6 THEN 'SQ' ELSE 'UI' END AS vr,
 CASE WHEN p_partkey % 8 = 3 THEN CASE WHEN p_partkey % 3 = 0 THEN 'YES' ELSE 'NO' END ELSE p_name END AS value,
 CASE WHEN p_partkey % 8 = 7 THEN 'Referenced Study Sequence [' || CAST(p_partkey % 3 + 1 AS STRING) || ']' ELSE '' END AS path
FROM part""",
    ),
}


def _le16(number: str) -> str:
    """SQL for a number below 65536 as two little-endian bytes in hexadecimal."""
    return f"lpad(hex({number} % 256),2,'0')||lpad(hex(CAST(({number} - {number} % 256) / 256 AS BIGINT)),2,'0')"


def _tag(tag: str, vr: str) -> str:
    return f"'{tag[2:4]}{tag[0:2]}{tag[6:8]}{tag[4:6]}{vr.encode().hex()}'"


# Text elements of the files: tag, VR and the SQL of the value, all shorter than 256 bytes.
_TEXTS = [
    ("00020010", "UI", "'1.2.840.10008.1.2.1'"), ("00080016", "UI", "sop_class"), ("00080060", "CS", "'US'"),
    ("00080070", "LO", "manufacturer"), ("00081090", "LO", "model"), ("00100010", "PN", "name"),
    ("00181020", "LO", "software"), ("00280004", "CS", "'MONOCHROME2'"), ("00280008", "IS", "CAST(frame_count AS STRING)"),
]
_PADDED = ", ".join(
    f"hex({text})||CASE WHEN length({text}) % 2 = 1 THEN '{'00' if vr == 'UI' else '20'}' ELSE '' END AS v{i}"
    for i, (_, vr, text) in enumerate(_TEXTS)
)
_DICOM = "||".join(
    [
        "repeat('00',128)||'4449434D'",
        *[
            f"{_tag(tag, vr)}||lpad(hex(CAST(length(v{i})/2 AS BIGINT)),2,'0')||'00'||v{i}"
            for i, (tag, vr, _) in enumerate(_TEXTS)
        ],
        f"{_tag('00280010', 'US')}||'0200'||rows16", f"{_tag('00280011', 'US')}||'0200'||columns16",
        f"{_tag('00280100', 'US')}||'02000800'", "'E07F10004F4200000400000000010203'",
    ]
)
_PNG = "'89504E470D0A1A0A0000000D49484452'||lpad(hex(width),8,'0')||lpad(hex(height),8,'0')||hex(name)"

# Every image as a file: its bytes in hexadecimal. Some files are broken, some are hidden.
VIEWS["fil"] = (
    ["ims"],
    f"""SELECT import_idx, CASE WHEN import_idx % 61 = 0 THEN 'batch/.' || name ELSE path END AS path,
 CASE WHEN import_idx % 37 = 0 THEN hex('broken ' || name) WHEN kind = 'PNG' THEN {_PNG} ELSE {_DICOM} END AS hexed
FROM (SELECT *, {_PADDED}, {_le16('CAST(height AS BIGINT)')} AS rows16, {_le16('CAST(width AS BIGINT)')} AS columns16 FROM ims) values_""",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view by name, or one of the driver's tables. `made` keeps what was put together before."""
    made = {} if made is None else made
    if name not in made:
        made[name] = _build(spark, sf_dir, name, made)
    return made[name]


def _build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    needs, text = VIEWS[name]
    for need in needs:
        for word in ("FROM", "JOIN"):
            text = re.sub(rf"\b{word} {need}\b", f"{word} {{{need}}}", text)
    return spark.sql(text, **{need: view(spark, sf_dir, need, made) for need in needs})


def with_views(*names: str) -> str:
    """The WITH clause that gives DuckDB the named views and those they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in wanted:
            for need in VIEWS[name][0]:
                add(need)
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in wanted) + "\n"
