"""How a DICOM tag number and keyword read."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_tag(hex_digits: Column) -> Column:
    """00100010 becomes (0010,0010)."""
    return F.upper(
        F.concat(
            F.lit("("), F.substring(hex_digits, 1, 4), F.lit(","), F.substring(hex_digits, 5, 4), F.lit(")")
        )
    )


def is_private_tag(hex_digits: Column) -> Column:
    return F.substring(hex_digits, 4, 1).rlike("[13579bdfBDF]")


def is_private_creator(hex_digits: Column) -> Column:
    """Odd group, element 0010 to 00FF: names the owner of a private block."""
    return is_private_tag(hex_digits) & hex_digits.rlike("(?i)^.{4}00[1-9a-f][0-9a-f]")


def keyword_to_name(keyword: Column) -> Column:
    """PatientBirthDate becomes Patient Birth Date; acronyms stay together."""
    split = F.regexp_replace(keyword, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(split, "([A-Z])([A-Z][a-z])", "$1 $2")
