"""A user's export schema: data that renames and nests, never code that computes.

What a definition may hold is declared once, part by part, in PARTS. A definition is read against that list, and
everything found wrong with it is reported together.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

# What an entry, a raster and a zone may read.
ENTRY_SOURCES = [
    "combo_id", "manufacturer", "model", "sop_class", "software_version", "attributes_source",
    "file_count", "zone_count", "ref_width", "ref_height", "size",
]
SIZE_SOURCES = ["ref_width", "ref_height", "size", "zone_count", "file_count"]
ZONE_SOURCES = ["x", "y", "width", "height", "note"]
GROUP_BY = ["attributes", "combo"]
SHAPES = ["nested", "flat"]
MAX_NAME = 60
#: What only a raster has: of no use in an entry that holds several of them.
RASTER_ONLY = {"ref_width", "ref_height", "size"}


class SchemaDefects(ValueError):
    """Everything wrong with one definition."""

    def __init__(self, defects: list[str]):
        super().__init__("\n".join(defects))
        self.defects = defects


@dataclass(frozen=True)
class ExportSchema:
    id: str
    name: str
    group_by: str = "attributes"
    shape: str = "nested"
    root: dict = field(default_factory=dict)
    timestamp_field: str = "generated_at"
    entries_field: str = "annotations"
    entry: dict = field(default_factory=dict)
    entry_constants: dict = field(default_factory=dict)
    sizes_field: str = "sizes"
    size: dict = field(default_factory=dict)
    zones_field: str = "zones"
    zone: dict = field(default_factory=dict)
    zone_constants: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


def _is_constant(value) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


@dataclass(frozen=True)
class Table:
    """A part that maps output keys to values of one kind."""

    fits: Callable[[object], bool]
    expected: str

    def read(self, value) -> tuple[dict, list[str]]:
        if not isinstance(value, dict):
            return {}, ["should be an object"]
        blank = ["has a key without a name"] if any(not key.strip() for key in value) else []
        odd = [f"{key!r} should be {self.expected}, not {v!r}" for key, v in value.items() if not self.fits(v)]
        return dict(value), blank + odd

    def default(self) -> dict:
        return {}


@dataclass(frozen=True)
class Word:
    """A part that is one of a few words, or any text if none are listed; what is blank or no text counts as `usual`."""

    usual: str
    allowed: tuple[str, ...] = ()
    blank: str | None = None

    def read(self, value) -> tuple[str, list[str]]:
        if self.allowed:
            known = value is None or value in self.allowed
            return value if known and value else self.usual, [] if known else [f"should be one of {', '.join(self.allowed)}"]
        trimmed = value.strip() if isinstance(value, str) else ""
        return trimmed or (self.usual if self.blank is None else self.blank), []

    def default(self) -> str:
        return self.usual


def _sources(names: list[str]) -> Table:
    return Table(lambda v: isinstance(v, str) and v in names, "one of " + ", ".join(names))


_CONSTANTS = Table(_is_constant, "text, a number, true, false or null")

PARTS: dict[str, Table | Word] = {
    "group_by": Word("attributes", tuple(GROUP_BY)),
    "shape": Word("nested", tuple(SHAPES)),
    "entry": _sources(ENTRY_SOURCES),
    "size": _sources(SIZE_SOURCES),
    "zone": _sources(ZONE_SOURCES),
    "root": _CONSTANTS,
    "entry_constants": _CONSTANTS,
    "zone_constants": _CONSTANTS,
    "entries_field": Word("annotations"),
    "sizes_field": Word("sizes"),
    "zones_field": Word("zones"),
    # A blank name of this field is a wish for none.
    "timestamp_field": Word("generated_at", blank=""),
}


def _between_parts(read: dict) -> Iterator[str]:
    """What parts that are each in order may still get wrong together."""
    if not read["zone"]:
        yield "zone: without a field no coordinate would be exported"
    if read["shape"] == "nested":
        for key in (k for k, source in read["entry"].items() if isinstance(source, str) and source in RASTER_ONLY):
            yield f"entry: {key!r} belongs to a raster; put it under size, or make the shape flat"
    if read["shape"] == "flat" and read["size"]:
        yield "size: a flat schema has no raster objects; put these fields under entry"
    for part in ("entries_field", "timestamp_field"):
        if read[part] and read[part] in read["root"]:
            yield f"root: {read[part]!r} is the name of the {part.removesuffix('_field')} already"


def validate_export_schema(given, default_id: str | None = None) -> ExportSchema:
    """The schema a definition describes; SchemaDefects, a ValueError, lists all reasons to refuse it."""
    if not isinstance(given, dict):
        raise SchemaDefects(["a schema should be an object"])
    read, defects = {}, []
    for part, kind in PARTS.items():
        read[part], found = kind.read(given[part]) if part in given else (kind.default(), [])
        defects += [f"{part}: {text}" for text in found]
    label, _ = Word("").read(given.get("name"))
    defects += [] if label else ["name: a schema needs one"]
    defects += _between_parts(read)
    if defects:
        raise SchemaDefects(defects)
    own_id = given.get("id")
    if not isinstance(own_id, str) or not own_id:
        own_id = default_id or "s-" + re.sub(r"\W+", "-", label.lower())
    return ExportSchema(id=own_id, name=label[:MAX_NAME], **read)


def validate_schema_file(given, accepts=lambda name: name.endswith("-schema")) -> list[ExportSchema]:
    """All schemas of an exchange file, in order. An id that is taken gets the first free number as a suffix."""
    head = given if isinstance(given, dict) else {}
    version = head.get("version")
    whole = isinstance(version, (int, float)) and not isinstance(version, bool) and version == 1
    if not (isinstance(head.get("format"), str) and accepts(head["format"]) and whole and isinstance(head.get("schemas"), list)):
        raise ValueError("Not a schema file.")
    taken: dict[str, ExportSchema] = {}
    for schema in map(validate_export_schema, head["schemas"]):
        number, name = len(taken), schema.id
        while name in taken:
            name, number = f"{schema.id}-{number}", number + 1
        taken[name] = ExportSchema(**schema.as_dict() | {"id": name})
    return list(taken.values())
