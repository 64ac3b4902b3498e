"""Tables with the cases every operator has to bear."""

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor " * 40_000


def odd_documents(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "one two three four", "en", "a", 18), (1, "one two three four", "en", "a", 18), (2, None, "en", "a", None),
        (3, "", None, None, 0), (4, LONG, "de", "b", len(LONG)), (None, "no id here at all", "en", "b", 17),
        (5, "one two three four", "en", None, 18), (6, " \t\n\x0b\x0c\r ", "fr", "c", 7), (7, "é ß 漢字 \U0001f600 x", "fr", "c", 12),
    ]
    rows += [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["TEXT", "fp", "row", "key", "ids", "_words", "n_words", "words", "name", "rank", "_hash", "block", "slot", "kept"]
    return df.selectExpr("*", *[f"'clash' AS `{c}`" for c in clashing])


def odd_pages(spark: SparkSession) -> DataFrame:
    html = "<html><body><nav>menu</nav><article><p>Some text &amp; more of it, long enough to be found twice in here. " + "x " * 60 + "</p></article></body></html>"
    rows = [
        (1, "http://a.org/fr/1", html), (1, "http://a.org/fr/1", html), (2, "http://a.org/fr/2", html), (3, None, None), (4, "", ""),
        (5, "no scheme", "<p>short"), (None, "https://B.example.COM/de/x?q=1#f", html), (6, "http://net", "<p>" + "long " * 100_000),
        (7, "ftp://x.net", "<" * 1000), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", *[f"'clash' AS `{c}`" for c in ["URL", "host", "path", "row", "gram", "digest", "payload", "first", "slot", "fixed", "text"]])


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)
