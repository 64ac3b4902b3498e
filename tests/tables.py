"""Small literal inputs for the operators."""

from zonespark import schemas as S

MAKER = {"manufacturer": "Nordlicht Imaging", "model": "NL40", "sop_class": "1.2.840.10008.5.1.4.1.1.6.1", "software": "NL40:V3.1"}
BAND = (16, 4, 352, 36, "headline")
LABEL = (24, 300, 144, 28, "corner")


def image_id(n) -> str:
    return str(n).rjust(64, "0")


def images(spark, *rows: dict):
    """Images numbered in order; every field has a plain default."""
    full = []
    for i, row in enumerate(rows):
        base = {
            "image_id": image_id(i), "import_idx": i, "name": f"s{i}.dcm", "path": f"x/s{i}.dcm", "combo": "16",
            "width": 640, "height": 480, "frame_count": 1, "filename_width": None, "filename_height": None,
            "sample": "", "kind": "DICOM", "open_frame": 0, "has_source": True, **MAKER,
            "modality": "US", "photometric": "MONOCHROME2", "bits": 8, "transfer_syntax": "1.2.840.10008.1.2.1",
        }
        full.append(tuple({**base, **row}[c] for c in S.names_of(S.IMAGES)))
    return spark.createDataFrame(full, S.IMAGES)


def zones(spark, frames: dict):
    """{(image, frame): [zone, ...]} as a zone table."""
    rows = [
        (image_id(image), frame, i, *zone) for (image, frame), listed in frames.items() for i, zone in enumerate(listed)
    ]
    return spark.createDataFrame(rows, S.ZONES)


def layouts(spark, *rows):
    """Layouts (combo, width, height, promoted, zones) as the two tables."""
    heads = [(c, w, h, p, i) for i, (c, w, h, p, _) in enumerate(rows)]
    inner = [(c, w, h, i, *z) for c, w, h, _, listed in rows for i, z in enumerate(listed)]
    return spark.createDataFrame(heads, S.LAYOUTS), spark.createDataFrame(inner, S.LAYOUT_ZONES)


def detections(spark, frames: dict):
    """{(image, frame): [(x, y, width, height, text, confidence), ...]} as detections."""
    rows = [
        (image_id(image), frame, i, *box) for (image, frame), listed in frames.items() for i, box in enumerate(listed)
    ]
    return spark.createDataFrame(rows, S.DETECTIONS)


def listed(df, *columns, order=None):
    """Rows as plain tuples, ordered by `order` or else by value."""
    rows = (df.orderBy(*order) if order else df).select(*columns).collect()
    values = [tuple(r) if len(columns) > 1 else r[0] for r in rows]
    return values if order else sorted(values, key=lambda v: (str(type(v)), str(v)))
