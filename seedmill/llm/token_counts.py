"""Token counts by a two-tier lookup, all on the map side.

First tier: a table of the pre-tokens that are frequent in the whole corpus,
with their numbers of tokens, broadcast. Its size is bounded whatever the
corpus: at most ``table_size`` entries of at most 64 characters. Second tier:
what the table lacks is encoded by the library and kept in a bounded cache of
the Python worker. Counts are exact; the table only saves time. No pre-token of
a text is shuffled: building the table moves a bounded summary of each task.
"""

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize
from seedmill.llm.pieces import MAX_KEY, cut_at_blanks, worker_encoder, worker_pieces

TABLE_SIZE = 1 << 16
TASK_SUMMARY = 1 << 13
TASK_COUNTERS = 1 << 19


def summarize(texts: Iterable[str | None], keep: int = TASK_SUMMARY, counters: int = TASK_COUNTERS) -> Counter:
    """The most frequent pre-tokens of the texts of one task, in bounded memory.

    When the counters run out, the rarer half of them is dropped; that can only
    make the table poorer, never a count wrong.
    """
    seen: Counter = Counter()
    for text in texts:
        if text:
            seen.update(cut_at_blanks(text)[1:])
            if len(seen) > counters:
                seen = Counter(dict(seen.most_common(counters // 2)))
    return Counter({p: n for p, n in seen.most_common(keep) if n > 1 and len(p) <= MAX_KEY})


def frequent_pieces(docs: DataFrame, table_size: int = TABLE_SIZE) -> list[str]:
    """At most ``table_size`` pre-tokens that are frequent in all texts."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = summarize(t for b in batches for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"piece": list(found), "n": list(found.values())}, schema)

    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])
    summed = docs.select("text").mapInArrow(tops, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "frequent-pieces")
    least, size = None, 0
    # Few counts are distinct, so the cut is found from a small table and no task sorts all pieces.
    for row in summed.groupBy("n").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("n")).toLocalIterator():
        if size + row["pieces"] > table_size:
            break
        least, size = row["n"], size + row["pieces"]
    if least is None:
        return []
    return [r["piece"] for r in summed.filter(F.col("n") >= least).select("piece").collect()]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, table_size: int = TABLE_SIZE
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    A null or empty text has no byte and no token. Repeated rows are counted
    each, an empty table gives an empty one, extra columns are not read. A text
    is read whole, however long.
    """
    spark = docs.sparkSession
    pieces = frequent_pieces(docs, table_size)
    encoder = worker_encoder(tokenizer_path)
    lengths = [len(encoder.ids(" " + p)) for p in pieces]
    table = spark.sparkContext.broadcast((pieces, lengths))
    token = uuid.uuid4().hex
    names = ["doc_id", "n_bytes", "n_tokens"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = worker_pieces(tokenizer_path, lambda: dict(zip(*table.value, strict=True)), token)
        for batch in batches:
            n_tokens = [lookup.count(text) if text else 0 for text in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
