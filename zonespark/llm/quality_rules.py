"""Quality rules: text statistics in Spark expressions, and an ordered list of threshold rules learned from labels.

Sequential covering: a rule is a conjunction of thresholds, grown one threshold at a time by information gain on one
part of the labelled statistics, pruned from its end on the other part, and accepted while it is precise there. What
it covers leaves the sample and the next rule is grown. The list becomes one conditional expression; no Python runs
over documents.
"""

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonespark.llm.common import GAP, pick, smallest_hashes

#: Fixed values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: What rules may test, all computed from counts of the whole text.
FEATURES = [
    "words", "word_length", "symbols_per_word", "marks_per_word", "capital_share", "duplicate_lines", "repeat_share", "distinct_share",
]


def _removed(text: Column, chars: str) -> Column:
    """How many of these characters a text holds."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_capitals and n_distinct.

    A null text has zero of everything. Windows of three words are told apart by 64-bit hashes. df must not have
    columns with these names or with names that start with an underscore and a letter.
    """
    columns = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.withColumns({"_text": whole}).withColumns(
        {
            "_words": F.array_remove(F.split("_text", GAP, -1), ""),
            "_lines": lines,
            "n_symbols": _removed(F.col("_text"), SYMBOLS).cast("long"),
            "n_marks": _removed(F.col("_text"), "!?").cast("long"),
            "n_capitals": (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long"),
        }
    )
    words = F.col("_words")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    windowed = counted.select(
        *columns, "n_symbols", "n_marks", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    # Sorted by hash, equal windows stand side by side. Texts without any need no sort.
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    sorted_windows = windowed.withColumn(
        "_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(placed)).otherwise(none)
    )
    beside = F.col("_sorted")
    repeated = F.filter(
        beside,
        lambda x, i: x["h"].eqNullSafe(F.get(beside, i + 1)["h"]) | x["h"].eqNullSafe(F.when(i > 0, F.get(beside, i - 1)["h"])),
    )
    found = sorted_windows.withColumn("_at", F.when(F.size("_sorted") > 0, F.array_sort(F.transform(repeated, lambda x: x["at"]))))
    at = F.col("_at")
    covered = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(at, i + 1) - p), F.lit(3)))
    counted = found.withColumn(
        "n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    )
    return counted.drop("_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """The tested quantities as expressions over the statistics. All are numbers, also for empty texts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "duplicate_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
    }


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.limit if self.above else row[self.feature] < self.limit

    def expression(self) -> Column:
        value = features()[self.feature]
        return value >= F.lit(self.limit) if self.above else value < F.lit(self.limit)


@dataclass
class Rule:
    """Reject a document for which every threshold holds."""

    thresholds: list[Threshold] = field(default_factory=list)

    def covers(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.thresholds)

    def expression(self) -> Column:
        condition = self.thresholds[0].expression()
        for t in self.thresholds[1:]:
            condition = condition & t.expression()
        return condition

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>=' if t.above else '<'} {t.limit:.4g}" for t in self.thresholds)


def _rejects(rows: list[dict]) -> int:
    return sum(r["reject"] for r in rows)


def _precision(rows: list[dict]) -> float:
    """Share of rejects, drawn towards one half where there is little evidence."""
    return (_rejects(rows) + 1) / (len(rows) + 2)


def _cuts(rows: list[dict], feature: str, most: int = 32) -> list[float]:
    """Thresholds between distinct values: quantiles of both labels, as one of them may be rare."""
    cuts = set()
    for label in (0, 1):
        values = sorted(r[feature] for r in rows if r["reject"] == label)
        for k in range(1, most):
            here = k * len(values) // most
            if values and here and values[here] > values[0]:
                low = max((v for v in values[max(0, here - 1) : here + 1] if v < values[here]), default=values[here])
                cuts.add((low + values[here]) / 2)
    return sorted(cuts)


def _best_threshold(rows: list[dict], cuts: dict[str, list[float]]) -> Threshold | None:
    rejects = _rejects(rows)
    if not rejects or rejects == len(rows):
        return None
    before, best, most = log2(rejects / len(rows)), None, 1e-9
    for feature, limits in cuts.items():
        for limit in limits:
            over = [r["reject"] for r in rows if r[feature] >= limit]
            for above, n, p in ((True, len(over), sum(over)), (False, len(rows) - len(over), rejects - sum(over))):
                if p and 0 < n < len(rows):
                    gain = p * (log2(p / n) - before)
                    if gain > most:
                        best, most = Threshold(feature, above, limit), gain
    return best


def learn_rules(
    rows: list[dict], max_rules: int = 8, max_thresholds: int = 4, min_precision: float = 0.95, min_covered: int = 3
) -> list[Rule]:
    """Ordered rules from labelled rows: dicts with the features, reject (1 for low quality, else 0) and held.

    A rule is accepted if it covers at least min_covered held rows, and min_precision of them are rejects.
    """
    grow, prune = [r for r in rows if not r["held"]], [r for r in rows if r["held"]]
    cuts = {f: _cuts(grow, f) for f in FEATURES}
    rules: list[Rule] = []
    while _rejects(grow) and len(rules) < max_rules:
        rule, covered = Rule(), grow
        while len(rule.thresholds) < max_thresholds and (t := _best_threshold(covered, cuts)):
            rule.thresholds.append(t)
            covered = [r for r in covered if t.holds(r)]
        if not rule.thresholds:
            break
        shorter = [Rule(rule.thresholds[:n]) for n in range(1, len(rule.thresholds) + 1)]
        rule = max(shorter, key=lambda r: (_precision([x for x in prune if r.covers(x)]), -len(r.thresholds)))
        judged = [x for x in prune if rule.covers(x)]
        if len(judged) < min_covered or _rejects(judged) < min_precision * len(judged):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not rule.covers(r)] for part in (grow, prune))
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list[dict]:
    """Features of at most max_labelled labelled documents, those with the smallest hashed ids, a third held for pruning."""
    rated = pick(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = smallest_hashes(rated, "doc_id", max_labelled)
    # Broadcast: at most max_labelled rows of two numbers.
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(texts).select(
        "doc_id", (F.col("quality") == 0).cast("int").alias("reject"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held"),
        base_failed().alias("failed"), *[e.alias(n) for n, e in features().items()],
    )
    # A repeated doc_id counts once, so the sample keeps its bound.
    return [r.asDict() for r in rows.dropDuplicates(["doc_id"]).collect() if not r["failed"]]


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the first rule that holds rejects, and what none covers is kept."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.expression(), F.lit(False)).otherwise(kept)
    return F.when(base_failed(), F.lit(False)).otherwise(kept)


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Rules are fitted on at most max_labelled labelled documents; without labels the list is empty and the base rules
    decide. A null text counts as empty and fails the base rules, and so does an empty one. Repeated rows come out
    repeated; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    rules = learn_rules(labelled_sample(docs, labels, max_labelled))
    return with_statistics(pick(docs, "doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(rules).alias("kept"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep. Nothing is shuffled but the bounded sample."""
    rules = learn_rules(labelled_sample(docs, labels, max_labelled))
    names = docs.columns
    text = names.index("text") if "text" in names else [c.lower() for c in names].index("text")
    places = [f"_{i}" for i in range(len(names))]
    judged = with_statistics(docs.toDF(*places), f"_{text}").withColumns({"_kept": verdict(rules), "_row": F.monotonically_increasing_id()})
    # A filter is not moved below a column that numbers the rows; moved there, it would repeat the statistics per element.
    return judged.filter(F.col("_kept") & (F.col("_row") >= 0)).select(*places).toDF(*names)
