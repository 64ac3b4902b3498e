"""The device a file says it came from: four attributes, compared exactly as stored."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonespark.functions.text import WHITE, js_trim
from zonespark.schemas import DEVICE

# Names of the SOP classes a label can show (DICOM PS3.6).
SOP_CLASSES = {
    "1.2.840.10008.5.1.4.1.1.1": "Computed Radiography Image",
    "1.2.840.10008.5.1.4.1.1.1.2": "Digital Mammography X-Ray Image — For Presentation",
    "1.2.840.10008.5.1.4.1.1.2": "CT Image",
    "1.2.840.10008.5.1.4.1.1.3.1": "Ultrasound Multi-frame Image",
    "1.2.840.10008.5.1.4.1.1.4": "MR Image",
    "1.2.840.10008.5.1.4.1.1.6.1": "Ultrasound Image",
    "1.2.840.10008.5.1.4.1.1.7": "Secondary Capture Image",
    "1.2.840.10008.5.1.4.1.1.7.1": "Multi-frame Single Bit Secondary Capture",
    "1.2.840.10008.5.1.4.1.1.7.2": "Multi-frame Grayscale Byte Secondary Capture",
    "1.2.840.10008.5.1.4.1.1.7.3": "Multi-frame Grayscale Word Secondary Capture",
    "1.2.840.10008.5.1.4.1.1.7.4": "Multi-frame True Color Secondary Capture",
}
SEPARATOR = " · "


def attribute(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def device_attributes() -> list[Column]:
    """The four columns with missing values as empty strings and nothing trimmed."""
    return [attribute(name).alias(name) for name in DEVICE]


def has_device() -> Column:
    return reduce(lambda a, b: a | b, [attribute(name) != "" for name in DEVICE])


def attributes_source() -> Column:
    complete = reduce(lambda a, b: a & b, [attribute(name) != "" for name in DEVICE])
    return F.when(complete, "dicom_tags").otherwise("partial")


def device_signature() -> Column:
    """NULL for a file that states nothing, so two unknown devices never look like the same one."""
    return F.when(has_device(), F.struct(*device_attributes()))


def sop_class_name(uid: Column) -> Column:
    trimmed = js_trim(F.coalesce(uid, F.lit("")))
    names = F.create_map(*[F.lit(v) for pair in SOP_CLASSES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, trimmed), trimmed)


def short_software() -> Column:
    """Software version without a leading "<model>:" or "<model> -", unless nothing would be left."""
    software, model = js_trim(attribute("software")), js_trim(attribute("model"))
    starts = F.lower(F.substr(software, F.lit(1), F.length(model))) == F.lower(model)
    rest = F.substr(software, F.length(model) + 1, F.length(software))
    separator = f"^{WHITE}*[:\\-]{WHITE}*"
    tail = F.regexp_replace(rest, separator, "")
    strip = (model != "") & starts & rest.rlike(separator) & (tail != "")
    return F.when(strip, tail).otherwise(software)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(SEPARATOR, *[F.nullif(p, F.lit("")) for p in parts])


def device_label() -> Column:
    return _joined(js_trim(attribute("manufacturer")), js_trim(attribute("model")), short_software())


def device_detail() -> Column:
    return _joined(device_label(), sop_class_name(F.col("sop_class")))
