"""Export schemas given as JSON, judged and read by column expressions: as many definitions as a table holds.

The parts, the words and the sources are those of export_schema.PARTS, and so are the wordings; values are named as JSON writes them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonespark.export_schema import ENTRY_SOURCES, MAX_NAME, PARTS, RASTER_ONLY, SIZE_SOURCES, ZONE_SOURCES, Table
from zonespark.functions import variants as V
from zonespark.functions.text import js_trim

_SOURCES = {"entry": ENTRY_SOURCES, "size": SIZE_SOURCES, "zone": ZONE_SOURCES}


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _part(definition: Column, name: str) -> Column:
    return V.member(definition, name)


def _members(definition: Column, name: str) -> Column:
    """The entries (key, value) of a part that is an object, none of any other."""
    held = F.try_variant_get(_part(definition, name), "$", "map<string, variant>")
    empty = F.array().cast("array<struct<key: string, value: variant>>")
    return F.when(V.is_object(_part(definition, name)), F.coalesce(F.map_entries(held), empty)).otherwise(empty)


def _is_null(value: Column) -> Column:
    return value.isNull() | (F.schema_of_variant(value) == "VOID")


def _trimmed(definition: Column, name: str) -> Column:
    return js_trim(F.coalesce(V.text(_part(definition, name)), F.lit("")))


def word(definition: Column, name: str) -> Column:
    """A part that is text: what it says, or what is usual."""
    kind, part = PARTS[name], _part(definition, name)
    if kind.allowed:
        return F.when(V.text(part).isin(*kind.allowed), V.text(part)).otherwise(kind.usual)
    usual = kind.usual if kind.blank is None else kind.blank
    trimmed = _trimmed(definition, name)
    return F.when(part.isNull(), kind.usual).when(trimmed == "", usual).otherwise(trimmed)


def _fits(name: str, value: Column) -> Column:
    if name in _SOURCES:
        return F.coalesce(V.text(value).isin(_SOURCES[name]), F.lit(False))
    kind = F.schema_of_variant(value)
    return ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))


def _table_defects(definition: Column, name: str, kind: Table) -> Column:
    part, members = _part(definition, name), _members(definition, name)
    blank = F.when(F.exists(members, lambda m: js_trim(m["key"]) == ""), F.array(F.lit(f"{name}: has a key without a name"))).otherwise(_nothing())
    odd = F.transform(
        F.filter(members, lambda m: ~_fits(name, m["value"])),
        lambda m: F.concat(F.lit(f"{name}: '"), m["key"], F.lit(f"' should be {kind.expected}, not "), F.to_json(m["value"])),
    )
    wrong = part.isNotNull() & ~V.is_object(part)
    return F.when(wrong, F.array(F.lit(f"{name}: should be an object"))).otherwise(F.concat(blank, odd))


def _word_defects(definition: Column, name: str, allowed: tuple[str, ...]) -> Column:
    part = _part(definition, name)
    known = _is_null(part) | F.coalesce(V.text(part).isin(*allowed), F.lit(False))
    return F.when(known, _nothing()).otherwise(F.array(F.lit(f"{name}: should be one of {', '.join(allowed)}")))


def _if(condition: Column, text: str) -> Column:
    return F.when(condition, F.array(F.lit(text))).otherwise(_nothing())


def definition_defects(definition: Column) -> Column:
    """Everything wrong with a definition (a variant), as an array of texts; an empty one if it is in order."""
    found = []
    for name, kind in PARTS.items():
        if isinstance(kind, Table):
            found.append(_table_defects(definition, name, kind))
        elif kind.allowed:
            found.append(_word_defects(definition, name, kind.allowed))
    found.append(_if(_trimmed(definition, "name") == "", "name: a schema needs one"))
    found.append(_if(F.size(_members(definition, "zone")) == 0, "zone: without a field no coordinate would be exported"))
    shape = word(definition, "shape")
    raster = F.filter(_members(definition, "entry"), lambda m: F.coalesce(V.text(m["value"]).isin(*sorted(RASTER_ONLY)), F.lit(False)))
    found.append(F.when(shape == "nested", F.transform(
        raster, lambda m: F.concat(F.lit("entry: '"), m["key"], F.lit("' belongs to a raster; put it under size, or make the shape flat"))
    )).otherwise(_nothing()))
    found.append(_if(
        (shape == "flat") & (F.size(_members(definition, "size")) > 0),
        "size: a flat schema has no raster objects; put these fields under entry",
    ))
    root = F.transform(_members(definition, "root"), lambda m: m["key"])
    for name in ("entries_field", "timestamp_field"):
        field = word(definition, name)
        found.append(F.when(
            (field != "") & F.array_contains(root, field),
            F.array(F.concat(F.lit("root: '"), field, F.lit(f"' is the name of the {name.removesuffix('_field')} already"))),
        ).otherwise(_nothing()))
    return F.when(V.is_object(definition), F.concat(*found)).otherwise(F.array(F.lit("a schema should be an object")))


def definition_columns(definition: Column) -> list[Column]:
    """The schema a definition without defects describes: name, the words, and the tables as JSON objects."""
    tables = [
        F.when(V.is_object(_part(definition, name)), F.to_json(_part(definition, name))).otherwise("{}").alias(name)
        for name, kind in PARTS.items() if isinstance(kind, Table)
    ]
    words = [word(definition, name).alias(name) for name, kind in PARTS.items() if not isinstance(kind, Table)]
    return [F.substring(_trimmed(definition, "name"), 1, MAX_NAME).alias("name"), *words, *tables]
