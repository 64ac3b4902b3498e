"""Strict checks on JSON values: what the value is, not what it could be cast to."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonespark.functions.text import MAX_SAFE_INTEGER


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_number(value: Column) -> Column:
    # DECIMAL goes on with its digits; the other names end here.
    return F.coalesce(F.substring(F.schema_of_variant(value), 1, 6).isin("BIGINT", "DECIMA", "DOUBLE", "FLOAT"), F.lit(False))


def integer(value: Column) -> Column:
    """The value as BIGINT if it is a JSON number without a fraction in the safe range, else NULL."""
    return whole(number(value))


def whole(number: Column) -> Column:
    """A number as BIGINT if it has no fraction and is in the safe range, else NULL."""
    return F.when(
        (number == F.floor(number)) & (F.abs(number) <= MAX_SAFE_INTEGER), number.cast("bigint")
    )


def text(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def elements(value: Column) -> Column:
    """The members of a JSON array as ARRAY<VARIANT>, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_one_value(document: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    Spark's parsers stop at the end of the first value. Inside brackets a second value or a tail shows as another
    element or an error; inside an object so does a text that closes the brackets itself.
    """
    # Read as text, which bears repeated keys; a variant does not.
    listed = F.from_json(F.concat(F.lit("["), document, F.lit("]")), "array<string>")
    named = F.from_json(F.concat(F.lit('{"value":'), document, F.lit("}")), "struct<value: string>")
    return F.coalesce((F.size(listed) == 1) & named["value"].isNotNull(), F.lit(False))
