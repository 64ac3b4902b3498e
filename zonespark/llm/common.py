"""Small helpers the operators share."""

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonespark.plans.ordering import shared_folder

#: The characters that separate words: space, tab, newline, vertical tab, form feed, carriage return. Fixed values.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_GAP_BYTES = re.compile(rb"[\x20\x09-\x0D]")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of df, whatever else it holds.

    A name is matched exactly first and then without regard to case, so a second column of the same name in other
    letters, or one that clashes with a name used inside an operator, does no harm. Of equal names the first counts.
    """
    have = df.columns
    lowered = [c.lower() for c in have]
    places = [have.index(n) if n in have else lowered.index(n.lower()) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(have))]).select(*[F.col(f"_{p}").alias(n) for p, n in zip(places, names)])


def keep(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the written table, which outlives any executor."""
    table = f"{shared_folder(df.sparkSession)}/zonespark-llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table)


def smallest_hashes(ids: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows of ids, those whose key has the smallest hashes: a fixed sample that grows with nothing.

    Hashes far beyond the bound are left out before the sort, so that what tasks hand on does not grow with their number.
    """
    hashed = F.xxhash64(key)
    share = min(1.0, 1.25 * bound / max(ids.count(), 1))
    near = ids.filter(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    return near.orderBy(F.pmod(hashed, F.lit(1 << 30)), key).limit(bound)


def split_blocks(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in blocks of about `size` bytes, cut only at a gap between words, so long texts take bounded memory."""
    start = 0
    while len(text) - start > size:
        gap = _GAP_BYTES.search(text, start + size)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of bounded size."""
    for block in split_blocks(text):
        # Splits at exactly the six characters of GAP.
        yield block.split()
