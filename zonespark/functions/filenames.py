"""Facts a file name states about its image."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonespark.functions.text import MAX_SAFE_INTEGER

# Fixed value: the file-name pattern. \z, because Java's $ also matches before a final newline.
FILENAME = r"(?i)^combo(\d+)_(\d+)x(\d+)_s(\d+)\.(png|dcm|dicom|ima)\z"


def parse_filename(name: Column) -> Column:
    """struct(combo, width, height, sample), or NULL when the name does not follow the pattern."""
    combo, width, height, sample = (F.regexp_extract(name, FILENAME, i) for i in range(1, 5))
    sizes = [c.try_cast("bigint") for c in (width, height)]
    valid = name.rlike(FILENAME)
    for size in sizes:
        valid = valid & size.between(1, MAX_SAFE_INTEGER)
    return F.when(
        valid,
        F.struct(
            combo.alias("combo"), sizes[0].alias("width"), sizes[1].alias("height"), sample.alias("sample")
        ),
    )


def size_mismatch() -> Column:
    """The file name states a raster other than the real one. The raster wins; this only reports."""
    differs = (F.col("filename_width") != F.col("width")) | (F.col("filename_height") != F.col("height"))
    return F.coalesce(F.col("filename_width"), F.lit(0)).cast("boolean") & F.coalesce(differs, F.lit(True))
