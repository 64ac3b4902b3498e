"""Values of DICOM elements as text. A small helper that runs inside a Spark task."""

import struct
from decimal import Decimal

from zonespark.sources.dicom_walk import PIXEL_DATA, DataSet, Element, lookup_tag

# VRs by kind, and the codec each character set (0008,0005) is read with.
TEXT = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
IN_CHARSET = {"PN", "LO", "LT", "SH", "ST", "UC", "UT"}
BINARY = {"OB", "OD", "OF", "OL", "OV", "OW", "UN"}
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "UV": "Q", "SV": "q"}
CODECS = {
    "": "cp1252", "ISO_IR 6": "cp1252", "ISO_IR 100": "cp1252", "ISO_IR 101": "iso8859_2",
    "ISO_IR 109": "iso8859_3", "ISO_IR 110": "iso8859_4", "ISO_IR 144": "iso8859_5", "ISO_IR 127": "iso8859_6",
    "ISO_IR 126": "iso8859_7", "ISO_IR 138": "iso8859_8", "ISO_IR 148": "iso8859_9", "ISO_IR 166": "cp874",
    "ISO_IR 13": "cp932", "ISO_IR 192": "utf_8", "GB18030": "gb18030", "GBK": "gbk",
}
JAPANESE = {"", "ISO 2022 IR 6", "ISO 2022 IR 13", "ISO 2022 IR 87", "ISO 2022 IR 159"}
# The bytes cp1252 leaves open stay the control characters they are in Latin-1.
_WINDOWS = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
PIXELS = {PIXEL_DATA, "7fe00008", "7fe00009"}


def _hex(raw: bytes) -> str:
    return raw.hex(" ")


def decode_text(raw: bytes, charset: str, warnings: dict) -> str:
    codec = CODECS.get(charset.strip())
    if codec is None and all(part.strip() in JAPANESE for part in charset.split("\\")):
        codec = "iso2022_jp"
    if codec is None:
        warnings[f"Character set {charset} is not supported; affected text is shown as bytes."] = None
        return "[Undecoded text] " + _hex(raw)
    if codec == "cp1252":
        text = raw.decode("latin-1").translate(_WINDOWS)
    else:
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            warnings[f"Some text could not be decoded as {charset or 'ASCII'}; replacement characters are shown."] = None
            text = raw.decode(codec, "replace")
    return text.rstrip("\0 ")


def number_text(value) -> str:
    """A number as JavaScript prints it."""
    if isinstance(value, int):
        return str(value)
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if 1e-6 <= abs(value) < 1e21:
        return format(Decimal(repr(value)), "f")
    return repr(value).replace("e-0", "e-")


def value_text(found: DataSet, element: Element, vr: str, charset: str, warnings: dict) -> tuple[str, bool]:
    """(text, whether it stands for binary content)."""
    if element.items is not None:
        count = len(element.items)
        return f"{count} sequence item{'' if count == 1 else 's'}", False
    if element.fragments is not None:
        total = sum(element.fragments)
        return f"Encapsulated pixel data · {len(element.fragments)} fragments · {total:,} bytes", True
    length = element.length
    if length == 0:
        return "", False
    if element.hex in PIXELS:
        return f"Pixel data · {length:,} bytes", True
    raw = found.value(element.hex)
    if vr in TEXT:
        return decode_text(raw, charset if vr in IN_CHARSET else "", warnings), False
    if vr in NUMBERS or vr == "AT":
        kind = NUMBERS.get(vr, "HH")
        size = struct.calcsize("<" + kind)
        if length % size:
            raise ValueError(f"Invalid {vr} length")
        values = struct.iter_unpack(found.order + kind, raw)
        if vr == "AT":
            return " \\ ".join("(%04X,%04X)" % pair for pair in values), False
        return " \\ ".join(number_text(one) for (one,) in values), False
    lead = "Binary data" if vr in BINARY else "Unknown value"
    return f"{lead} · {length:,} bytes\n{_hex(raw[:32])}{' …' if length > 32 else ''}", True


def resolve_vr(found: DataSet, element: Element, entry, creator: bool) -> str:
    vr = element.vr or (entry[0] if entry else None)
    if element.vr is None and creator:
        return "LO"
    if vr == "xs":
        return "SS" if found.number("00280103") == 1 else "US"
    if vr == "ox":
        return "OW"
    return vr or "UN"


def _is_creator(hex_digits: str) -> bool:
    return int(hex_digits[3], 16) % 2 == 1 and 0x10 <= int(hex_digits[4:], 16) <= 0xFF


def _value_or_warning(found: DataSet, element: Element, vr: str, charset: str, warnings: dict) -> tuple[str, bool]:
    try:
        return value_text(found, element, vr, charset, warnings)
    except (ValueError, struct.error):
        warnings[f"({element.hex[:4].upper()},{element.hex[4:].upper()}) contains an unreadable value."] = None
        return "[Unable to read this value]", True


def find_warnings(found: DataSet, dictionary: dict, warnings: dict, charset: str = "") -> None:
    """The warnings that tag_rows would give, in its order, without the rows. Text that any bytes can stand for is not decoded."""
    charset = found.string("00080005") or charset
    safe = TEXT if CODECS.get(charset.strip()) == "cp1252" else TEXT - IN_CHARSET
    for hex_digits in sorted(found.elements):
        element = found.elements[hex_digits]
        if element.items is None and element.vr not in safe:
            vr = resolve_vr(found, element, lookup_tag(dictionary, hex_digits), _is_creator(hex_digits))
            _value_or_warning(found, element, vr, charset, warnings)
        for item in element.items or ():
            find_warnings(item, dictionary, warnings, charset)


def tag_rows(found: DataSet, dictionary: dict, warnings: dict, path=(), charset: str = ""):
    """(tag, VR, keyword, value, binary, sequence, length, path) of every element, in tag order.

    The items of a sequence come right after it, with the sequences they lie in as their path.
    """
    charset = found.string("00080005") or charset
    for hex_digits in sorted(found.elements):
        element = found.elements[hex_digits]
        entry = lookup_tag(dictionary, hex_digits)
        private = int(hex_digits[3], 16) % 2 == 1
        creator = _is_creator(hex_digits)
        vr = resolve_vr(found, element, entry, creator)
        keyword = entry[1] if entry else "PrivateCreator" if creator else "PrivateTag" if private else "UnknownTag"
        value, binary = _value_or_warning(found, element, vr, charset, warnings)
        steps = " › ".join(f"{step} [{number}]" for step, number in path)
        yield hex_digits, vr, keyword, value, binary, element.items is not None, element.length, steps
        for number, item in enumerate(element.items or [], 1):
            yield from tag_rows(item, dictionary, warnings, (*path, (keyword, number)), charset)
