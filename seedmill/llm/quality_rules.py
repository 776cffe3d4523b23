"""Learned decision lists: ordered rules of thresholds that reject documents of low quality.

Sequential covering over labelled statistics. A rule grows one condition at a
time, by information gain, on two thirds of the labelled rows; the other third
prunes it to the prefix that separates best there and decides whether it is
good enough. What a rule rejects leaves the rows that the next rule is grown
on. The outcome is a list of conjunctions of thresholds that a person can read,
and that Spark evaluates as one CASE expression inside the row.

All labelled rows take part. The driver sees only counts by feature and
threshold, at most features x thresholds x 4 numbers a step.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize
from seedmill.llm.text_stats import flat_stats, text_stats

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self) -> Column:
        feature, value = F.col(self.feature), F.lit(self.value)
        return F.coalesce(feature >= value if self.at_least else feature < value, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.value:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        return reduce(lambda a, b: a & b, [c.holds() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(str(c) for c in self.conditions)


def ratios() -> dict[str, Column]:
    """The features a rule may use, from the counts of a text."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "bangs_per_word": F.col("n_bangs") / words,
        "capital_share": F.col("n_capitals") / chars,
        "digit_share": F.col("n_digits") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "mean_word": F.col("word_chars") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _bin(feature: Column, cuts: Sequence[float]) -> Column:
    """How many of the cuts the feature reaches."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut <= feature))


def learn_rules(
    labelled: DataFrame,
    features: Sequence[str],
    bad: str,
    key: str,
    thresholds: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.98,
    min_rows: int = 3,
) -> list[Rule]:
    """The decision list for rows where ``bad`` is true.

    Rows with a null label take no part; null features are below no threshold
    and above none. Candidate thresholds are the approximate quantiles of a
    feature among the bad rows and among the good ones. No labelled row, or none bad, gives no rule.
    Equal gains go to the earlier feature and the lower threshold, so the list
    is the same for the same rows in any order. ``key`` deals rows to the
    growing and the pruning part.
    """
    rows = labelled.filter(F.col(bad).isNotNull()).select(
        *features, F.col(bad).alias("_bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("_prune")
    )
    rows = materialize(rows, "labelled")
    steps = [i / thresholds for i in range(thresholds)]
    spread = F.percentile_approx
    found = rows.groupBy("_bad").agg(*[spread(f, [*steps, 1.0], 10_000).alias(f) for f in features]).collect()
    if not any(r["_bad"] for r in found):
        return []
    cuts = {f: sorted({c for r in found for c in r[f] or []}) for f in features}
    if not any(cuts.values()):
        return []

    placed = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("feature"),
                    _bin(F.col(f), cuts[f]).alias("bin"),
                )
                for i, f in enumerate(features)
                if cuts[f]
            ]
        )
    )

    def totals(found: DataFrame) -> tuple[int, int]:
        row = found.agg(F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n")).first()
        return row["p"], row["n"]

    def grow(uncovered: DataFrame) -> list[Condition]:
        chosen: list[Condition] = []
        here = uncovered
        p0, n0 = totals(here)
        while p0 and n0 and len(chosen) < max_conditions:
            counts: dict = {}
            binned = here.select("_bad", placed.alias("at")).groupBy("at.feature", "at.bin", "_bad").count()
            for r in binned.collect():
                counts[r["feature"], r["bin"], r["_bad"]] = r["count"]
            best = (0.0, None, 0, 0)
            for i, f in enumerate(features):
                for b, cut in enumerate(cuts[f], start=1):
                    p = sum(counts.get((i, x, True), 0) for x in range(b, len(cuts[f]) + 1))
                    n = sum(counts.get((i, x, False), 0) for x in range(b, len(cuts[f]) + 1))
                    for at_least, pos, neg in ((True, p, n), (False, p0 - p, n0 - n)):
                        if pos:
                            gain = pos * (math.log2(pos / (pos + neg)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, at_least, float(cut)), pos, neg)
            if best[1] is None:
                break
            chosen.append(best[1])
            here = here.filter(best[1].holds())
            p0, n0 = best[2], best[3]
        return chosen

    def prune(chosen: list[Condition], held_out: DataFrame) -> Rule | None:
        """The prefix that separates best on the pruning part, if it is precise enough on it."""
        prefixes = [Rule(tuple(chosen[: k + 1])) for k in range(len(chosen))]
        counted = held_out.agg(
            *[F.count_if(r.holds() & F.col("_bad")).alias(f"p{k}") for k, r in enumerate(prefixes)],
            *[F.count_if(r.holds() & ~F.col("_bad")).alias(f"n{k}") for k, r in enumerate(prefixes)],
        ).first()
        best, worth = None, -math.inf
        for k, rule in enumerate(prefixes):
            p, n = counted[f"p{k}"], counted[f"n{k}"]
            if p + n >= min_rows and (p - n) / (p + n) > worth and p / (p + n) >= min_precision:
                best, worth = rule, (p - n) / (p + n)
        return best

    rules: list[Rule] = []
    uncovered = rows
    while len(rules) < max_rules:
        chosen = grow(uncovered.filter(~F.col("_prune")))
        rule = prune(chosen, uncovered.filter("_prune")) if chosen else None
        if rule is None:
            break
        rules.append(rule)
        uncovered = uncovered.filter(~rule.holds())
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null when none does."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, start=1))):
        found = F.when(rule.holds(), F.lit(number)).otherwise(found)
    return found


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the whole text and base_failed, one row per row of ``docs``."""
    counted = docs.select("doc_id", text_stats(F.col("text")).alias("s")).select("doc_id", *flat_stats("s"))
    return counted.withColumn("base_failed", base_failed())


def learn_from_labels(stats: DataFrame, labels: DataFrame, **settings) -> list[Rule]:
    """The rules for documents that the labels call low quality and the base rule lets pass.

    Several labels of one document count as its lowest. Labels of unknown
    documents and null labels take no part.
    """
    marked = labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    columns = ratios()
    rows = stats.filter(~F.col("base_failed")).join(marked, "doc_id")
    rows = rows.select("doc_id", "bad", *[c.alias(f) for f, c in columns.items()])
    return learn_rules(rows, list(columns), "bad", "doc_id", **settings)


def judge(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``stats`` with ``rule`` (the first that holds) and ``kept``."""
    named = stats.select("*", *[c.alias(f) for f, c in ratios().items()])
    judged = named.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
    return judged.select(*stats.columns, "rule", F.col("rule").isNull().alias("kept"))


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    A null or empty text has zero words and fails the base rule. Repeated rows
    are judged each by itself; extra columns are not read; an empty table gives
    an empty one.
    """
    stats = materialize(document_stats(docs), "quality-stats")
    return judge(stats, learn_from_labels(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever these are called.

    The rules are learned from stored counts; the decision is then taken inside
    each row, so texts never leave their task.
    """
    rules = learn_from_labels(materialize(document_stats(docs), "quality-stats"), labels)
    boxed = docs.select(F.struct("*").alias("doc"), text_stats(F.col("text")).alias("s"))
    counted = boxed.select("doc", *flat_stats("s")).withColumn("base_failed", base_failed())
    return judge(counted, rules).filter("kept").select("doc.*")
