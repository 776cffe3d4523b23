"""Counts over the words and lines of a text, as column expressions.

Words are runs without blank, tab, line feed, vertical tab, form feed and
carriage return. Nothing leaves the row, so no statistic needs a shuffle.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Places covered by windows that begin at the sorted ``starts``."""
    gaps = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def _repeated(hashes: Column) -> Column:
    """Sorted places of the values that occur twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(
        placed,
        lambda sorted_: F.sort_array(
            F.transform(
                F.filter(
                    sorted_,
                    lambda x, k: F.get(sorted_, k + 1)["h"].eqNullSafe(x["h"])
                    | F.get(sorted_, k - 1)["h"].eqNullSafe(x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes of their words' hashes. Most texts
    have no repeated window; for them a hash set over the window hashes is all
    the work, and only the others are sorted.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def count(found: Column) -> Column:
        none = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(none, F.lit(0)).otherwise(bind(_repeated(found), lambda at: _covered(at, width)))

    full = bind(hashes, lambda h: bind(windows(h), count))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(full).cast("long")


def marks(text: Column) -> Column:
    """Only the symbols, exclamation marks, capital letters A-Z and digits of a text, in order."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>!A-Z0-9]+", "")


def count_in(marked: Column, kind: str) -> Column:
    """How many characters of ``marked`` belong to a class such as ``[A-Z]``."""
    return F.length(F.regexp_replace(marked, f"[^{kind[1:-1]}]+", "")).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of all statistics of a text. A null text has the counts of an empty one: zeros."""
    words = bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        ),
    )
    marked = bind(
        marks(text),
        lambda m: F.struct(
            count_in(m, SYMBOLS).alias("n_symbols"),
            count_in(m, "[!]").alias("n_bangs"),
            count_in(m, "[A-Z]").alias("n_capitals"),
            count_in(m, "[0-9]").alias("n_digits"),
        ),
    )
    return F.struct(words.alias("w"), marked.alias("m"), dup_lines(text).alias("n_dup_lines"))


STAT_NAMES = {
    "n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_distinct_words": "w",
    "n_symbols": "m", "n_bangs": "m", "n_capitals": "m", "n_digits": "m",
}


def flat_stats(struct: str) -> list[Column]:
    """The fields of a ``text_stats`` struct as columns."""
    inner = [F.col(f"{struct}.{part}.{name}").alias(name) for name, part in STAT_NAMES.items()]
    return [*inner, F.col(f"{struct}.n_dup_lines").alias("n_dup_lines")]
