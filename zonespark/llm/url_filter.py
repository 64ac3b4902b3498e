"""URL filters: suffix rules first, and for the rest the ratio of two character language models.

URLs that the rules accept and reject train one smoothed variable-order Markov model each: the chance of a character is
interpolated from its longest context down to no context at all, each order weighted by how many different characters
followed it (Witten-Bell). A URL no rule fits is blocked if the log-likelihood difference per character lies above a
threshold that separates rule-judged URLs left out of the training best. Everything is DataFrame operations.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import keep, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters the models tell apart; digits count as 0 and all others as ~, and ^ stands before the first.
ALPHABET = LOWER + "0/.-_?=&#:%+~^"
#: Characters of context at most. The model has at most len(ALPHABET) ** (CONTEXT + 1) rows, whatever the input.
CONTEXT = 3
#: One page in so many is left out of the training to set the threshold.
HELD_OUT = 5


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = [
    UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z in lower case; empty for a null or one without ://."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[UrlRule], value) -> Column:
    """value(rule) of the longest rule that fits a host, or a domain above it, and the start of its path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _characters(url: Column) -> Column:
    text = F.regexp_replace(F.translate(url, UPPER, LOWER), "[0-9]", "0")
    return F.regexp_replace(text, r"[^a-z0/.\-_?=&#:%+]", "~")


def _grams(rows: DataFrame) -> DataFrame:
    """One row per character: the character with the CONTEXT before it. Empty texts give one row with a null."""
    padded = F.concat(F.lit("^" * CONTEXT), F.col("text"))
    places = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text")))
    return rows.withColumn("_at", F.explode_outer(places)).withColumn("gram", F.substr(padded, F.col("_at"), F.lit(CONTEXT + 1))).drop("_at")


def markov_ratio(counts: DataFrame) -> DataFrame:
    """gram, ratio: log of the chance of a gram's last character after the others, rejected over accepted.

    counts has a row per gram that occurs, with its times in accepted (a) and rejected (r) URLs, zero included.
    """
    chance = None
    for order in range(1, CONTEXT + 2):
        own = counts.groupBy(F.right("gram", F.lit(order)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        own = own.withColumn("before", F.substr("gram", F.lit(1), F.lit(order - 1)))
        context = own.groupBy("before").agg(
            *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.count_if(F.col(c) > 0).alias(f"t{c}") for c in "ar"]
        )
        # Both sides are bounded by the alphabet, see CONTEXT.
        joined = own.join(F.broadcast(context), "before")
        if chance is None:
            joined = joined.withColumns({f"l{c}": F.lit(1.0 / len(ALPHABET)) for c in "ar"})
        else:
            lower = chance.select(F.col("gram").alias("shorter"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            joined = joined.withColumn("shorter", F.right("gram", F.lit(order - 1))).join(F.broadcast(lower), "shorter")
        chance = keep(joined.select("gram", *[
            F.when(F.col(f"n{c}") + F.col(f"t{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"l{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
            .otherwise(F.col(f"l{c}")).alias(f"p{c}") for c in "ar"
        ]))
    return chance.select("gram", (F.log("pr") - F.log("pa")).alias("ratio"))


def best_threshold(cells: list[tuple[float, int, int]]) -> float:
    """The score above which to block, from (score, accepted, rejected) cells: least sum of both error shares.

    Of equally good ones the middle of the widest stretch. Without both labels nothing is blocked.
    """
    cells = sorted(cells)
    accepted, rejected = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not accepted or not rejected:
        return float("inf")
    best, most, missed, passed = cells[0][0] - 1.0, -1.0, 0, 0
    widest = 0.0
    for (score, a, r), after in zip(cells, [c[0] for c in cells[1:]] + [cells[-1][0] + 0.02]):
        missed, passed = missed + r, passed + a
        good = passed / accepted + (rejected - missed) / rejected
        if good > most + 1e-12 or abs(good - most) <= 1e-12 and after - score > widest:
            best, most, widest = (score + after) / 2, good, after - score
    return best


def filter_urls(pages: DataFrame, rules: list[UrlRule] | None = None) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains where the path starts with its own; the longest wins. Other URLs go by the
    models: score is the log-likelihood difference per character, positive towards rejected. A null url has empty host
    and path and, like an empty one, score zero and is allowed. If the rules accept or reject nothing, nothing else is
    blocked. Repeated rows come out repeated and count as often in the training; a null page_id is never held out. An
    empty table gives an empty result; columns other than page_id and url are ignored.
    """
    rules = RULES if rules is None else rules
    url = F.col("url")
    parts = pick(pages, "page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    judged = parts.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path",
        fitting_rule(F.col("host"), F.col("path"), rules, str).alias("rule"),
        fitting_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict).alias("by_rule"),
        _characters(F.coalesce(url, F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    held = F.coalesce(F.col("page_id") % HELD_OUT == 0, F.lit(False))
    grams = _grams(judged)
    seen = lambda verdict: F.count_if((F.col("by_rule") == verdict) & ~held)
    counts = keep(grams.filter("gram IS NOT NULL").groupBy("gram").agg(seen("allow").alias("a"), seen("block").alias("r")))
    # Broadcast: bounded by the alphabet, see CONTEXT.
    scored = keep(
        grams.join(F.broadcast(markov_ratio(counts)), "gram", "left")
        .groupBy("row", "page_id", "host", "path", "rule", "by_rule")
        .agg(F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 6).alias("score")).drop("row")
    )
    cells = scored.filter(F.col("by_rule").isNotNull() & held).groupBy(F.round("score", 2).alias("cell")).agg(
        F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("r")
    )
    threshold = best_threshold([tuple(r) for r in cells.collect()])
    by_model = F.when((F.length("host") + F.length("path") > 0) & (F.col("score") > F.lit(threshold)), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")
