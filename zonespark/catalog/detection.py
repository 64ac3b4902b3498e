"""Text boxes, coverage and tags."""

import uuid
from dataclasses import asdict

from pyspark.sql import functions as F

from zonespark.catalog.registry import ORACLES, query
from zonespark.functions import tags as G
from zonespark.functions.geometry import clamp, js_round
from zonespark.functions.identifying import IDENTIFYING_TAGS, is_identifying_tag
from zonespark.functions.text import clean_text, readable, readable_count
from zonespark.operators import detect as K
from zonespark.operators import tags as T
from zonespark.operators.search_index import index_tags, search_tags_indexed
from zonespark.plans.ordering import shared_folder
from zonespark.schemas import FRAME, RECT
from zonespark.sources.documents import refuse_text

_WHITE = r"[\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def _clean(column: str) -> str:
    return f"substr(trim(regexp_replace({column}, '{_WHITE}', ' ', 'g')), 1, 80)"


@query(
    "P14_tag_names",
    """SELECT hex, '(' || substr(upper(hex), 1, 4) || ',' || substr(upper(hex), 5, 4) || ')' AS tag,
 hex = '00111001' AS private, count(*) AS rows,
 CASE hex WHEN '00081110' THEN 'Referenced Study Sequence' WHEN '00081155' THEN 'Referenced SOP Instance UID' ELSE hex END AS name
FROM tag GROUP BY hex""",
    ("tag",),
)
def tag_names(t):
    keyword = (
        F.when(F.col("hex") == "00081110", "ReferencedStudySequence")
        .when(F.col("hex") == "00081155", "ReferencedSOPInstanceUID").otherwise(F.col("hex"))
    )
    named = t.tag.select(
        "hex", G.format_tag(F.col("hex")).alias("tag"), G.is_private_tag(F.col("hex")).alias("private"),
        G.keyword_to_name(keyword).alias("name"),
    )
    return named.groupBy("hex", "tag", "private", "name").agg(F.count("*").alias("rows"))


_PHI_SQL = "CASE WHEN regexp_matches(hex, '^(50|60)') THEN substr(hex, 1, 2) || '00' || substr(hex, 5) ELSE hex END IN ('" + "','".join(
    IDENTIFYING_TAGS
) + "')"

# Every tag number whose group and element follow from a part number, so most of them identify nobody.
_NUMBERS = """, numbers AS (
 SELECT p_partkey, lower(lpad(hex(p_partkey % 7 * 8 + 8), 4, '0') || lpad(hex(p_size * 16 + p_partkey % 16), 4, '0')) AS hex FROM part
 UNION ALL SELECT row_idx, hex FROM tag)
"""


@query("P15_identifying_tags", _NUMBERS + f"SELECT hex, {_PHI_SQL} AS identifying, count(*) AS rows FROM numbers GROUP BY hex", ("tag",))
def identifying_tags(t):
    group = F.lpad(F.hex(F.col("p_partkey") % 7 * 8 + 8), 4, "0")
    element = F.lpad(F.hex((F.col("p_size") * 16 + F.col("p_partkey") % 16).cast("bigint")), 4, "0")
    numbers = t.part.select(F.lower(F.concat(group, element)).alias("hex")).unionByName(t.tag.select("hex"))
    return numbers.groupBy("hex").agg(F.count("*").alias("rows")).select(
        "hex", is_identifying_tag(F.concat(F.lit("x"), "hex")).alias("identifying"), "rows"
    )


@query(
    "P16_burned_in_flag",
    """SELECT i.image_id, trim(f.value) AS value, CASE WHEN f.image_id IS NULL THEN 'absent' WHEN trim(f.value) = '' THEN 'empty'
 WHEN lower(trim(f.value)) = 'yes' THEN 'yes' WHEN lower(trim(f.value)) = 'no' THEN 'no' ELSE 'unrecognised' END AS declared
FROM (SELECT DISTINCT image_id FROM tag) i LEFT JOIN (
 SELECT image_id, value, row_number() OVER (PARTITION BY image_id ORDER BY row_idx) AS rn FROM tag WHERE hex = '00280301') f
 ON f.image_id = i.image_id AND f.rn = 1""",
    ("tag",),
)
def burned_in_flag(t):
    return T.burned_in_flag(t.tag)


@query("P17_clean_text", f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def clean_texts(t):
    return t.documents.select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(
    "P18_readable",
    """SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS characters,
 length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 400 AS readable FROM documents""",
)
def readable_texts(t):
    return t.documents.select(
        "doc_id", readable_count(F.col("text")).alias("characters"), readable(F.col("text"), 400).alias("readable")
    )


@query(
    "P19_detection_to_zone",
    "SELECT image_id, frame_index, ord, x, y, width, height, 'detected text' AS note FROM det",
    ("det",),
)
def detection_to_zone(t):
    return K.to_zones(t.det)


@query(
    "F3_search_tags",
    f"""SELECT image_id, row_idx, hex FROM tag WHERE {_PHI_SQL}
 AND (contains(lower('(' || substr(hex, 1, 4) || ',' || substr(hex, 5, 4) || ') ' || vr || ' ' || value || ' ' || path), '(0008,11')
  OR contains(hex, '000811'))""",
    ("tag",),
)
def search_tags(t):
    found = T.search_tags(T.with_tag_facts(t.tag), " (0008,11", "phi")
    return found.select("image_id", "row_idx", "hex")


@query(
    "F3_search_tag_text",
    """SELECT image_id, row_idx, value FROM tag
WHERE contains(lower('(' || substr(hex, 1, 4) || ',' || substr(hex, 5, 4) || ') ' || vr || ' ' || value || ' ' || path), 'sequence [2]')""",
    ("tag",),
)
def search_tag_text(t):
    return T.search_tags(T.with_tag_facts(t.tag), "SEQUENCE [2]").select("image_id", "row_idx", "value")


@query("F3_search_indexed", ORACLES["F3_search_tags"], ())
def search_tags_by_index(t):
    index = index_tags(T.with_tag_facts(t.tag), f"{shared_folder(t.tag.sparkSession)}/index-{uuid.uuid4().hex}")
    return search_tags_indexed(index, " (0008,11", "phi").select("image_id", "row_idx", "hex")


_COUNTS = f"""count(*) AS "all", count(*) FILTER ({_PHI_SQL}) AS phi, count(*) FILTER (hex <> '00111001') AS standard,
 count(*) FILTER (hex = '00111001') AS private, count(*) FILTER (vr = 'SQ') AS sequences"""


@query("A15_tag_counts", f"SELECT {_COUNTS} FROM tag", ("tag",))
def tag_counts(t):
    return T.tag_counts(T.with_tag_facts(t.tag))


@query("A15_tag_counts_per_image", f"SELECT image_id, {_COUNTS} FROM tag GROUP BY image_id", ("tag",))
def tag_counts_per_image(t):
    return T.tag_counts(T.with_tag_facts(t.tag), per_image=True)


@query(
    "O5_tag_page",
    """SELECT image_id, row_idx, hex FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_idx) AS place FROM tag) p
WHERE place > 1 AND place <= 2""",
    ("tag",),
)
def tag_page(t):
    return T.tag_page(t.tag.select("image_id", "row_idx", "hex"), 1, 1)


@query(
    "O5_tag_page_of_one_file",
    """SELECT image_id, row_idx, hex FROM tag WHERE image_id = lpad('7', 64, '0') ORDER BY row_idx LIMIT 150""",
    ("tag",),
)
def tag_page_of_one_file(t):
    return T.tag_page(t.tag.select("image_id", "row_idx", "hex"), 0, image_id="7".rjust(64, "0"))


@query("F5_above_confidence", "SELECT image_id, frame_index, ord, confidence FROM det WHERE confidence >= 60", ("det",))
def above_confidence(t):
    return K.above_confidence(t.det, 60).select(*FRAME, "ord", "confidence")


_BOX = "image_id, frame_index, ord, x, y, width, height"
_INSIDE = "d.x >= z.x AND d.y >= z.y AND d.x + d.width <= z.x + z.width AND d.y + d.height <= z.y + z.height"


@query(
    "J1_uncovered_frame",
    f"""SELECT {_BOX} FROM det d WHERE NOT EXISTS (SELECT 1 FROM zon z
 WHERE z.image_id = d.image_id AND z.frame_index = d.frame_index AND {_INSIDE})""",
    ("det", "zon"),
)
def uncovered_frame(t):
    return K.uncovered(t.det, t.zon).select(*FRAME, "ord", *RECT)


@query(
    "J1_uncovered_file",
    f"SELECT {_BOX} FROM det d WHERE NOT EXISTS (SELECT 1 FROM zon z WHERE z.image_id = d.image_id AND {_INSIDE})",
    ("det", "zon"),
)
def uncovered_file(t):
    return K.uncovered(t.det, t.zon, "file").select(*FRAME, "ord", *RECT)


@query(
    "A16_coverage_report",
    f"""SELECT image_id, frame_index, count(*) FILTER (confidence >= 40) AS detected,
 count(*) FILTER (confidence >= 40 AND NOT covered) AS uncovered, count(*) FILTER (confidence < 40) AS below_floor FROM (
 SELECT d.*, EXISTS (SELECT 1 FROM zon z WHERE z.image_id = d.image_id AND z.frame_index = d.frame_index AND {_INSIDE}) AS covered
 FROM det d) c GROUP BY image_id, frame_index""",
    ("det", "zon"),
)
def coverage_report(t):
    return K.coverage_report(t.det, t.zon, 40)


# One recognition run per event: a block with two lines of two words, or, from older engines, flat lines only.
_RUN = """, run AS (
 SELECT event_id, event_id % 9 AS kind, CAST(user_id AS DOUBLE) AS x, CAST(event_id % 300 AS DOUBLE) AS y, event_type AS word, value FROM events),
parts AS (SELECT r.*, l.line FROM run r, (SELECT 0 AS line UNION ALL SELECT 1) l),
words AS (SELECT p.*, w.word_no FROM parts p, (SELECT 0 AS word_no UNION ALL SELECT 1) w)
"""


def _ocr_raw(t):
    box = "named_struct('x0', x + {dx}, 'y0', y + {dy}, 'x1', x + {dx} + {w}, 'y1', y + {dy} + 12)"

    def region(dx, dy, w, text, children=""):
        return (
            f"named_struct('bbox', {box.format(dx=dx, dy=dy, w=w)}, 'text', {text}, 'confidence', value{children})"
        )

    def line(n):
        words = ", ".join(region(40 * k, 20 * n, 30, f"concat(word, ' {n}{k}')") for k in (0, 1))
        return region(0, 20 * n, 70, f"concat(word, ' line {n}')", f", 'words', array({words})")

    paragraph = region(0, 0, 70, "concat(word, ' paragraph')", f", 'lines', array({line(0)}, {line(1)})")
    block = region(0, 0, 70, "concat(word, ' block')", f", 'paragraphs', array({paragraph})")
    run = t.events.selectExpr(
        "event_id", "event_id % 9 AS kind", "CAST(user_id AS DOUBLE) AS x", "CAST(event_id % 300 AS DOUBLE) AS y",
        "event_type AS word", "value",
    )
    return run.selectExpr(
        "event_id", "lpad(CAST(event_id AS STRING), 64, '0') AS image_id", "0 AS frame_index",
        f"CASE WHEN kind <> 0 THEN array({block}) END AS blocks",
        f"CASE WHEN kind = 0 THEN array({line(0)}, {line(1)}) WHEN kind = 1 THEN array({line(0)}) END AS lines",
    )


_REGION_COLUMNS = ["event_id", "region_ord", "x0", "y0", "x1", "y1", "text", "confidence"]


def _register_levels():
    flat = "SELECT event_id, {ord} AS region_ord, x + {dx} AS x0, y + {dy} AS y0, x + {dx} + {w} AS x1, y + {dy} + 12 AS y1, {text} AS text, value AS confidence FROM {rows} WHERE {where}"
    spec = {
        "block": dict(ord="0", dx="0", dy="0", w="70", text="word || ' block'", rows="run", where="kind <> 0"),
        "paragraph": dict(ord="0", dx="0", dy="0", w="70", text="word || ' paragraph'", rows="run", where="kind <> 0"),
        "line": dict(ord="line", dx="0", dy="line * 20", w="70", text="word || ' line ' || CAST(line AS STRING)", rows="parts", where="true"),
        "word": dict(
            ord="line * 2 + word_no", dx="word_no * 40", dy="line * 20", w="30",
            text="word || ' ' || CAST(line AS STRING) || CAST(word_no AS STRING)", rows="words", where="kind <> 0",
        ),
    }
    for level in K.GRANULARITIES:
        sql = "WITH " + _RUN.lstrip(", ") + flat.format(**spec[level])
        query(f"D1_extract_{level}", sql)(
            lambda t, level=level: K.extract_regions(_ocr_raw(t), level).select(*_REGION_COLUMNS)
        )


_register_levels()

_SETTINGS = K.Settings(padding=3, min_width=8, min_height=10, min_chars=3)


def _detections(settings: dict, name: str = "", source: str = "reg") -> str:
    """SQL for the boxes the settings leave of the regions in `source`, as CTEs `edged{name}` and `found{name}`."""
    s = settings
    edge = "CAST(greatest(0, least({limit}, floor(r.{c} / r.scale + 0.5) {sign} {padding})) AS INT)"

    def cut(c, sign, limit):
        return edge.format(c=c, sign=sign, limit=limit, padding=s["padding"])

    return f""", edged{name} AS (
 SELECT r.image_id, r.frame_index, r.region_ord AS ord, {cut('x0', '-', 'i.width')} AS x, {cut('y0', '-', 'i.height')} AS y,
  {cut('x1', '+', 'i.width')} AS x2, {cut('y1', '+', 'i.height')} AS y2, {_clean('r.text')} AS text,
  CAST(floor(r.confidence + 0.5) AS INT) AS confidence
 FROM {source} r JOIN img i ON i.image_id = r.image_id
 WHERE length(regexp_replace(r.text, '[^A-Za-z0-9]', '', 'g')) >= {s['min_chars']}),
found{name} AS (
 SELECT image_id, frame_index, ord, x, y, x2 - x AS width, y2 - y AS height, text, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, frame_index, x, y, x2, y2 ORDER BY ord) AS rn FROM edged{name}
  WHERE x2 - x >= {max(1, s['min_width'])} AND y2 - y >= {max(1, s['min_height'])}) e WHERE rn = 1)"""


@query(
    "D2_detections",
    _detections(asdict(_SETTINGS)) + f"\nSELECT {_BOX}, text, confidence FROM found",
    ("reg", "img"),
)
def detections(t):
    return K.detections(t.reg, t.img, _SETTINGS)


def _joining(boxes: str, gap: int, name: str = "joined") -> str:
    """CTEs that join the boxes of every frame as the rule says: the first near pair, and again, one list per frame."""
    near = (
        f"b[i].x - {gap} <= b[j].x + b[j].width AND b[j].x - {gap} <= b[i].x + b[i].width"
        f" AND b[i].y - {gap} <= b[j].y + b[j].height AND b[j].y - {gap} <= b[i].y + b[i].height"
    )
    return f""", {name}_steps AS (
 SELECT image_id, frame_index, 0 AS step,
  list({{'ord': CAST(ord AS BIGINT), 'x': x, 'y': y, 'width': width, 'height': height, 'text': text, 'confidence': confidence}} ORDER BY ord) AS b
 FROM {boxes} GROUP BY image_id, frame_index
 UNION ALL
 SELECT image_id, frame_index, step + 1, list_transform(list_filter(range(1, len(b) + 1), lambda k: k <> j), lambda k: CASE WHEN k <> i THEN b[k] ELSE
  {{'ord': b[i].ord, 'x': least(b[i].x, b[j].x), 'y': least(b[i].y, b[j].y),
   'width': greatest(b[i].x + b[i].width, b[j].x + b[j].width) - least(b[i].x, b[j].x),
   'height': greatest(b[i].y + b[i].height, b[j].y + b[j].height) - least(b[i].y, b[j].y),
   'text': {_clean("(b[i].text || ' ' || b[j].text)")}, 'confidence': least(b[i].confidence, b[j].confidence)}} END)
 FROM (SELECT image_id, frame_index, step, b, pair // 1000000 AS i, pair % 1000000 AS j FROM (
  SELECT *, list_min(flatten(list_transform(range(1, len(b) + 1), lambda i: list_transform(
   list_filter(range(i + 1, len(b) + 1), lambda j: {near}), lambda j: i * 1000000 + j)))) AS pair FROM {name}_steps) found
  WHERE pair IS NOT NULL) chosen
),
{name} AS (
 SELECT image_id, frame_index, box.* FROM (
  SELECT image_id, frame_index, unnest(b) AS box FROM (
   SELECT *, row_number() OVER (PARTITION BY image_id, frame_index ORDER BY step DESC) AS back FROM {name}_steps) s WHERE back = 1) u
)"""


@query("D3_merge_boxes", _joining("tight", 6) + f"\nSELECT {_BOX}, text, confidence FROM joined", ("tight",), recursive=True)
def merge_boxes(t):
    return K.merge_boxes(t.tight, 6)


@query(
    "D4_visible_detections",
    ", shown AS (SELECT * FROM tight WHERE confidence >= 20)" + _joining("shown", 9) + f"\nSELECT {_BOX}, text, confidence FROM joined",
    ("tight",), recursive=True,
)
def visible_detections(t):
    return K.visible_detections(t.tight, K.Settings(confidence=20, merge_gap=9))


@query(
    "D4_visible_unmerged",
    _detections(asdict(_SETTINGS)) + f"\nSELECT {_BOX}, text, confidence FROM found WHERE confidence >= 30",
    ("reg", "img"),
)
def visible_unmerged(t):
    return K.visible_detections(K.detections(t.reg, t.img, _SETTINGS), K.Settings(confidence=30))


@query(
    "D5_drop_resolved",
    f"""SELECT {_BOX} FROM det d WHERE NOT EXISTS (SELECT 1 FROM det o WHERE o.text = 'error' AND o.image_id = d.image_id
 AND o.frame_index = d.frame_index AND o.x = d.x AND o.y = d.y AND o.width = d.width AND o.height = d.height)""",
    ("det",),
)
def drop_resolved(t):
    dismissed = t.det.filter(F.col("text") == "error")
    return K.drop_resolved(t.det, dismissed).select(*FRAME, "ord", *RECT)


@query(
    "D6_accept_detections",
    """, last AS (SELECT image_id, frame_index, max(ord) AS last FROM zon GROUP BY image_id, frame_index)
SELECT image_id, frame_index, CAST(ord AS BIGINT) AS ord, x, y, width, height, note FROM zon
UNION ALL SELECT d.image_id, d.frame_index, coalesce(l.last, -1) + 1 + d.ord, d.x, d.y, d.width, d.height, 'detected text'
FROM det d LEFT JOIN last l ON l.image_id = d.image_id AND l.frame_index = d.frame_index""",
    ("det", "zon"),
)
def accept_detections(t):
    return K.accept_detections(t.det, t.zon)[0]


@query(
    "D7_validate_settings",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'word' WHEN 1 THEN 'line' WHEN 2 THEN 'paragraph' WHEN 3 THEN 'block' ELSE 'line' END AS granularity,
 CAST(greatest(0, least(40, floor(value + 0.5))) AS INT) AS padding,
 CASE WHEN event_id % 3 = 0 THEN 60 ELSE CAST(greatest(0, least(100, floor(value * 2 - 20 + 0.5))) AS INT) END AS confidence,
 CAST(greatest(1, least(20, floor(value / 4 + 0.5))) AS INT) AS min_chars, 0 AS merge_gap FROM events""",
)
def validate_settings(t):
    level = F.element_at(F.array(*[F.lit(g) for g in (*K.GRANULARITIES, "sentence")]), (F.col("event_id") % 5 + 1).cast("int"))
    given = t.events.select(
        "event_id", level.alias("granularity"), F.col("value").alias("padding"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") * 2 - 20).alias("confidence"), (F.col("value") / 4).alias("min_chars"),
        F.lit(float("nan")).alias("merge_gap"),
    )
    return K.with_valid_settings(given).select("event_id", "settings.granularity", *[f"settings.{c}" for c in ("padding", "confidence", "min_chars", "merge_gap")])


@query(
    "D0_quarantine",
    """SELECT image_id, frame_index, CAST(ord AS BIGINT) AS ord, x, y, width, height, 'detected text' AS note FROM det
UNION ALL SELECT image_id, frame_index, -1, 0, 0, 0, 0, 'refused: ' || name FROM (
 SELECT min(image_id) AS image_id, 0 AS frame_index FROM det) one, (SELECT 'text' AS name UNION ALL SELECT 'note' UNION ALL SELECT 'label') names""",
    ("det",),
)
def quarantine(t):
    """What may leave, and per name of the column with recognised text that the writers refuse it."""
    boxes = t.det.withColumn("text", K.recognised(F.col("text")))
    out = K.to_zones(boxes).withColumn("ord", F.col("ord").cast("long"))
    refuse_text(out)
    for name in ("text", "note", "label"):
        try:
            refuse_text(boxes.withColumnRenamed("text", name))
        except ValueError:
            out = out.unionByName(boxes.agg(F.min("image_id").alias("image_id")).select(
                "image_id", F.lit(0).alias("frame_index"), F.lit(-1).cast("long").alias("ord"), *[F.lit(0).alias(c) for c in RECT],
                F.lit(f"refused: {name}").alias("note"),
            ))
    return out


_PROFILES = [
    {"name": "Tight", "settings": {"padding": 0, "confidence": 70, "min_width": 10}},
    {"name": "  Wide  ", "settings": {"padding": 12, "confidence": 25.4, "min_chars": 1, "unknown": 5}},
    {"name": "tight", "settings": {"padding": 30}},
    {"name": "Defaults", "settings": {}},
]


def _sweep_sql(profiles: dict[str, dict], source: str = "reg") -> str:
    """SQL of a sweep over profiles whose settings are spelled out in full."""
    ctes, selects = "", []
    for i, (name, s) in enumerate(profiles.items()):
        ctes += _detections(s, str(i), source) + f", shown{i} AS (SELECT * FROM found{i} WHERE confidence >= {s['confidence']})"
        shown = f"shown{i}"
        if s["merge_gap"]:
            ctes += _joining(shown, s["merge_gap"], f"joined{i}")
            shown = f"joined{i}"
        selects.append(
            f"""SELECT '{name}' AS profile, count(*) AS detected, count(*) FILTER (NOT covered) AS uncovered,
 (SELECT count(*) FROM found{i} WHERE confidence < {s['confidence']}) AS below_floor FROM (
 SELECT d.*, EXISTS (SELECT 1 FROM zon z WHERE z.image_id = d.image_id AND z.frame_index = d.frame_index AND {_INSIDE}) AS covered
 FROM {shown} d) c"""
        )
    return ctes + "\n" + "\nUNION ALL ".join(selects)


# What _PROFILES come to, spelled out for the SQL: known settings, rounded and in range, and the defaults of the rest.
_DEFAULTS = {"granularity": "line", "padding": 4, "confidence": 60, "min_width": 6, "min_height": 6, "min_chars": 2, "merge_gap": 0, "scale": 1}
_SPELLED = {
    "Tight": _DEFAULTS | {"padding": 0, "confidence": 70, "min_width": 10},
    "Wide": _DEFAULTS | {"padding": 12, "confidence": 25, "min_chars": 1},
    "Defaults": _DEFAULTS,
}


def _recognised(t):
    """reg as OCR output: each region is a run's only line."""
    box = F.struct("x0", "y0", "x1", "y1")
    plain = F.struct(box.alias("bbox"), "text", "confidence")
    word = F.array(plain)
    line = F.struct(box.alias("bbox"), "text", "confidence", word.alias("words"))
    paragraph = F.struct(box.alias("bbox"), "text", "confidence", F.array(line).alias("lines"))
    block = F.struct(box.alias("bbox"), "text", "confidence", F.array(paragraph).alias("paragraphs"))
    return t.reg.select(*FRAME, "scale", F.col("region_ord").alias("run"), F.array(block).alias("blocks"), F.array(line).alias("lines"))


@query("D8_profile_sweep", _sweep_sql(_SPELLED), ("reg", "zon"))
def profile_sweep(t):
    return K.profile_sweep(_recognised(t), t.img, t.zon, _PROFILES, ["run", "region_ord"])


_WORDS = """, words AS (
 SELECT image_id, frame_index, ord AS region_ord, 1.0 AS scale, x AS x0, y AS y0, x + width AS x1, y + height AS y1, text,
  CAST(confidence AS DOUBLE) AS confidence FROM tight)"""


@query(
    "D8_profile_sweep_merged",
    _WORDS + _sweep_sql(_SPELLED | {"Joined": _DEFAULTS | {"merge_gap": 10, "confidence": 10}}, "words"), ("tight", "zon"), recursive=True,
)
def profile_sweep_merged(t):
    profiles = [*_PROFILES, {"name": "Joined", "settings": {"merge_gap": 10, "confidence": 10}}]
    number = lambda c: c.cast("double")
    box = F.struct(
        number(F.col("x")).alias("x0"), number(F.col("y")).alias("y0"), number(F.col("x") + F.col("width")).alias("x1"),
        number(F.col("y") + F.col("height")).alias("y1"),
    )
    line = F.struct(box.alias("bbox"), "text", number(F.col("confidence")).alias("confidence"), F.lit(None).cast("array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,text:string,confidence:double>>").alias("words"))
    nothing = F.lit(None).cast(_recognised(t).schema["blocks"].dataType).alias("blocks")
    runs = t.tight.select(*FRAME, F.lit(1.0).alias("scale"), F.col("ord").alias("run"), nothing, F.array(line).alias("lines"))
    return K.profile_sweep(runs, t.img, t.zon, profiles, ["run", "region_ord"])
