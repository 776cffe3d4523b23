"""Fill-in-middle examples: a text cut into prefix, middle and suffix between its tokens, and put in another order.

One full match of a repeated group keeps every repetition: ``ends(1)`` of the
match lists where each token ends, so its length is the number of tokens and two
of its entries are the cuts. Which cuts and which order a document gets hangs on
a hash of its id alone, so a retried task or another partitioning gives the same.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks, tokens, markers. Possessive, so that no way is tried twice.
TOKENS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = regex.compile("<[PSM]>")


@dataclass(frozen=True)
class Example:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def token_ends(text: str) -> list[int]:
    """Where each token of the text ends, from one full match."""
    return TOKENS.fullmatch(text).ends(1)


def draws(doc_id: object, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id; a null id counts as an empty one."""
    named = "" if doc_id is None else str(doc_id)
    hexed = hashlib.sha256(f"{seed}:{named}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]


def example(doc_id: object, text: str | None, seed: int, rate: int, suffix_first: int) -> Example:
    """One document as an example; plain when it is empty, holds a marker or isn't drawn."""
    text = text or ""
    ends = token_ends(text)
    first, second, kind, order = draws(doc_id, seed)
    if not text or MARKERS.search(text) or kind % 100 >= rate:
        return Example(len(ends), "plain", None, None, text)
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    cut, stop = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:cut], text[cut:stop], text[stop:]
    if order % 100 < suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return Example(len(ends), form, cut, stop - cut, output)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every document.

    ``rate`` per cent of the documents are cut, ``suffix_first`` per cent of those
    have the suffix in front (spm), the others the prefix (psm). A null text is an
    empty one and stays plain. Rows that share a doc_id have the same draws, each
    for its own text; a null id has the draws of an empty one. An empty table
    gives an empty one; other columns are not read. Each text is taken as a
    whole, one batch at a time, and no row moves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            found = [
                example(i, t, seed, rate, suffix_first)
                for i, t in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            columns = [
                ids,
                pa.array([e.n for e in found], pa.int64()),
                pa.array([e.form for e in found], pa.string()),
                pa.array([e.prefix_chars for e in found], pa.int64()),
                pa.array([e.middle_chars for e in found], pa.int64()),
                pa.array([e.output for e in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an example. Between the markers lie three parts, since a cut text holds no marker."""
    parts = F.split(output, MARKERS.pattern)
    first, second, third = (F.get(parts, k) for k in (1, 2, 3))
    text = F.when(form == "psm", F.concat(first, third, second))
    return text.when(form == "spm", F.concat(second, third, first)).otherwise(output)
