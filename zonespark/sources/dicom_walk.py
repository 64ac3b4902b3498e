"""Finding the elements of one DICOM file. A small helper that runs inside a Spark task.

It only locates and decodes values; names, filters, counts and every other meaning are Spark columns.
"""

import struct
import zlib

_LONG = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
_UNDEFINED = 0xFFFFFFFF
_ITEM, _ITEM_END, _SEQUENCE_END = "fffee000", "fffee00d", "fffee0dd"
PIXEL_DATA = "7fe00010"

# The transfer syntaxes that are not explicit VR, little endian.
IMPLICIT, BIG_ENDIAN, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"


class Malformed(Exception):
    pass


class Element:
    __slots__ = ("hex", "vr", "at", "length", "items", "fragments")

    def __init__(self, hex_digits, vr, at, length):
        self.hex, self.vr, self.at, self.length = hex_digits, vr, at, length
        self.items = self.fragments = None


class DataSet:
    """The elements of a file or of a sequence item, by tag. `data` are bytes or anything with a length and slices."""

    def __init__(self, data, big: bool = False):
        self.data, self.order, self.elements = data, ">" if big else "<", {}

    def value(self, hex_digits: str) -> bytes:
        element = self.elements.get(hex_digits)
        return self.data[element.at:element.at + element.length] if element else b""

    def string(self, hex_digits: str) -> str:
        return self.value(hex_digits).split(b"\0")[0].decode("latin-1").strip()

    def number(self, hex_digits: str) -> int | None:
        raw = self.value(hex_digits)
        return struct.unpack(self.order + "H", raw[:2])[0] if len(raw) >= 2 else None


def lookup_tag(dictionary: dict, hex_digits: str):
    """(VR, keyword) of a standard tag; curve and overlay groups repeat those of 5000 and 6000."""
    if int(hex_digits[3], 16) % 2:
        return None
    if hex_digits not in dictionary and hex_digits[:2] in ("50", "60"):
        hex_digits = hex_digits[:2] + "00" + hex_digits[4:]
    return dictionary.get(hex_digits)


class _Walk:
    def __init__(self, data, dictionary: dict, big: bool, explicit: bool, until: str | None):
        self.data, self.dictionary, self.big = data, dictionary, big
        self.order, self.explicit, self.until = ">" if big else "<", explicit, until

    def numbers(self, layout: str, at: int):
        try:
            return struct.unpack(self.order + layout, self.data[at:at + struct.calcsize("=" + layout)])
        except struct.error as error:
            raise Malformed("The data ends inside an element") from error

    def tag(self, at: int) -> str:
        return "%04x%04x" % self.numbers("HH", at)

    def header(self, at: int) -> Element:
        tag = self.tag(at)
        if tag.startswith("fffee0") or not self.explicit:
            vr = None if tag.startswith("fffee0") else (lookup_tag(self.dictionary, tag) or (None,))[0]
            vr = vr if vr and vr.isupper() else None
            return Element(tag, vr, at + 8, self.numbers("I", at + 4)[0])
        vr = self.data[at + 4:at + 6].decode("latin-1")
        if not (vr.isalpha() and vr.isupper()):
            raise Malformed("No value representation where one belongs")
        if vr in _LONG:
            return Element(tag, vr, at + 12, self.numbers("I", at + 8)[0])
        return Element(tag, vr, at + 8, self.numbers("H", at + 6)[0])

    def elements(self, found: DataSet, at: int, end: int | None) -> int:
        """Fill a data set up to its end (None: up to the item's delimiter) and return where it ends."""
        stop = len(self.data) if end is None else end
        while at < stop:
            element = self.header(at)
            if element.hex == _ITEM_END:
                return element.at
            at = self.content(element)
            found.elements[element.hex] = element
            if element.hex == self.until:
                return at
        if end is None:
            raise Malformed("An item has no end")
        return at

    def content(self, element: Element) -> int:
        at, length = element.at, element.length
        if element.hex == PIXEL_DATA and length == _UNDEFINED:
            return self.pieces(element, at)
        opens = element.vr in (None, "UN") and at + 4 <= len(self.data) and self.tag(at) == _ITEM
        if element.vr == "SQ" or (length == _UNDEFINED and element.vr in (None, "UN")) or (element.vr is None and opens and length >= 8):
            return self.sequence(element, at, None if length == _UNDEFINED else at + length)
        if length == _UNDEFINED or at + length > len(self.data):
            raise Malformed("A value extends past the available data")
        return at + length

    def pieces(self, element: Element, at: int) -> int:
        sizes, start = [], at
        while True:
            piece = self.header(at)
            if piece.hex == _SEQUENCE_END:
                break
            if piece.hex != _ITEM or piece.at + piece.length > len(self.data):
                raise Malformed("Broken encapsulated pixel data")
            sizes.append(piece.length)
            at = piece.at + piece.length
        # The first item is the offset table, not a fragment.
        element.fragments, element.length = sizes[1:], at - start
        return at + 8

    def sequence(self, element: Element, at: int, end: int | None) -> int:
        if end is not None and end > len(self.data):
            raise Malformed("A sequence extends past the available data")
        element.items, start = [], at
        # A sequence of unknown representation is always implicit inside.
        inner = self if element.vr == "SQ" or not self.explicit else _Walk(
            self.data, self.dictionary, self.big, False, None
        )
        while end is None or at < end:
            item = self.header(at)
            if item.hex == _SEQUENCE_END:
                element.length = at - start
                return item.at
            if item.hex != _ITEM:
                raise Malformed("A sequence holds something other than items")
            child = DataSet(self.data, self.big)
            element.items.append(child)
            at = inner.elements(child, item.at, None if item.length == _UNDEFINED else item.at + item.length)
        return at


#: Bytes a deflated data set may have once it is inflated: it cannot be read by range.
INFLATED = 1 << 30


def _inflated(data, at: int) -> bytes:
    """Everything up to `at` as it is and the rest inflated, a piece at a time."""
    inflate, parts, size = zlib.decompressobj(-15), [data[:at]], 0
    while at < len(data) and not inflate.eof:
        piece = inflate.decompress(data[at:at + (1 << 20)], INFLATED)
        size += len(piece)
        if size > INFLATED or inflate.unconsumed_tail:
            raise Malformed("Too much deflated data")
        parts.append(piece)
        at += 1 << 20
    return b"".join(parts)


def read_elements(data, dictionary: dict, until: str | None = None) -> tuple[DataSet, str | None]:
    """(data set, what went wrong after the elements it holds). Malformed if there is nothing to hold."""
    if data[128:132] != b"DICM":
        raise Malformed("Not a DICOM Part 10 file")
    found = DataSet(data)
    meta = _Walk(data, dictionary, False, True, None)
    at = 132
    while at < len(data) and meta.numbers("H", at)[0] == 2:
        element = meta.header(at)
        at = meta.content(element)
        found.elements[element.hex] = element
    syntax = found.string("00020010")
    if not syntax:
        raise Malformed("No transfer syntax")
    if syntax == DEFLATED:
        try:
            data = _inflated(data, at)
        except zlib.error as error:
            raise Malformed("Broken deflated data") from error
        found.data = data
    big = syntax == BIG_ENDIAN
    found.order = ">" if big else "<"
    try:
        _Walk(data, dictionary, big, syntax != IMPLICIT, until).elements(found, at, len(data))
    except (Malformed, RecursionError) as error:
        return found, str(error)
    return found, None
