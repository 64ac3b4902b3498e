"""Column names and types of the tables the operators work on, as DDL."""


def names_of(ddl: str) -> list[str]:
    """Column names of a flat DDL string."""
    return [column.split()[0] for column in ddl.split(",")]


ZONE = ["x", "y", "width", "height", "note"]
RECT = ["x", "y", "width", "height"]
FRAME = ["image_id", "frame_index"]
LAYOUT_KEY = ["combo", "ref_width", "ref_height"]
DEVICE = ["manufacturer", "model", "sop_class", "software"]

IMAGES = (
    "image_id STRING, import_idx BIGINT, name STRING, path STRING, combo STRING, width INT, height INT,"
    " frame_count INT, filename_width INT, filename_height INT, sample STRING, kind STRING, open_frame INT,"
    " has_source BOOLEAN, manufacturer STRING, model STRING, sop_class STRING, software STRING,"
    " modality STRING, photometric STRING, bits INT, transfer_syntax STRING"
)
ZONES = "image_id STRING, frame_index INT, ord BIGINT, x INT, y INT, width INT, height INT, note STRING"
LAYOUTS = "combo STRING, ref_width INT, ref_height INT, promoted BOOLEAN, layout_idx BIGINT"
LAYOUT_ZONES = "combo STRING, ref_width INT, ref_height INT, ord BIGINT, x INT, y INT, width INT, height INT, note STRING"
TEMPLATES = "template_id STRING, name STRING, combo STRING, width INT, height INT, created_at STRING"
TEMPLATE_ZONES = "template_id STRING, ord BIGINT, x INT, y INT, width INT, height INT, note STRING"
DETECTIONS = "image_id STRING, frame_index INT, ord BIGINT, x INT, y INT, width INT, height INT, text STRING, confidence INT"

_BOX = "bbox: STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, text: STRING, confidence: DOUBLE"
_WORD = f"STRUCT<{_BOX}>"
_LINE = f"STRUCT<{_BOX}, words: ARRAY<{_WORD}>>"
_PARAGRAPH = f"STRUCT<{_BOX}, lines: ARRAY<{_LINE}>>"
_BLOCK = f"STRUCT<{_BOX}, paragraphs: ARRAY<{_PARAGRAPH}>>"
OCR_RAW = f"image_id STRING, frame_index INT, scale DOUBLE, blocks ARRAY<{_BLOCK}>, lines ARRAY<{_LINE}>"

# Columns an image table keeps when it is persisted; anything else a caller added is dropped.
IMAGE_RECORD = [name for name in names_of(IMAGES) if name != "has_source"]

#: Metadata mark of a column that holds text recognised on an image.
RECOGNISED = "recognised_text"
