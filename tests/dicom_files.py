"""Synthetic image files."""

import struct
import zlib

LONG = {"OB", "OW", "SQ", "UN", "UT"}
EXPLICIT, IMPLICIT, BIG, DEFLATED = (
    "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99",
)


def element(tag: int, vr: str, value=b"", order="<", implicit=False, length=None) -> bytes:
    data = value.encode() if isinstance(value, str) else struct.pack(order + "H", value) if isinstance(value, int) else value
    if len(data) % 2:
        data += b"\0" if vr in ("UI", "OB", "OW") else b" "
    size = len(data) if length is None else length
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if implicit:
        return head + struct.pack(order + "I", size) + data
    if vr in LONG:
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", size) + data
    return head + vr.encode() + struct.pack(order + "H", size) + data


def item(data: bytes, closed=True, order="<") -> bytes:
    head = struct.pack(order + "HH", 0xFFFE, 0xE000)
    if closed:
        return head + struct.pack(order + "I", len(data)) + data
    return head + struct.pack(order + "I", 0xFFFFFFFF) + data + struct.pack(order + "HHI", 0xFFFE, 0xE00D, 0)


END = struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def dicom(*extra: bytes, syntax=EXPLICIT, width=640, height=480, frames="1", pixels=None, after=b"", **text) -> bytes:
    order, implicit = (">" if syntax == BIG else "<"), syntax == IMPLICIT

    def e(tag, vr, value):
        return element(tag, vr, value, order, implicit)

    meta = element(0x00020010, "UI", syntax)
    facts = {"sop": "1.2.840.10008.5.1.4.1.1.6.1", "maker": "Nordlicht Imaging", "model": "NL40", "software": "V4", **text}
    body = [
        e(0x00080016, "UI", facts["sop"]), e(0x00080060, "CS", "US"), e(0x00080070, "LO", facts["maker"]),
        e(0x00081090, "LO", facts["model"]), e(0x00181020, "LO", facts["software"]),
        e(0x00280004, "CS", "MONOCHROME2"), e(0x00280008, "IS", frames), e(0x00280010, "US", height),
        e(0x00280011, "US", width), e(0x00280100, "US", 8), *extra,
        e(0x7FE00010, "OB", b"\1\2\3\4") if pixels is None else pixels, after,
    ]
    data = b"".join(body)
    if syntax == DEFLATED:
        packer = zlib.compressobj(wbits=-15)
        data = packer.compress(data) + packer.flush()
    return b"\0" * 128 + b"DICM" + meta + data


def png(width=640, height=480, tail=b"") -> bytes:
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + tail
