"""Exact top-k search over an index of vectors that scores only what can reach the top.

The index is a table of posting blocks: vectors of like direction and length,
packed as one matrix, with bounds on what is inside. A query first scores the one
block with the highest bound, which gives a score that k vectors reach. Then it
goes to the blocks whose bound is not below that score, and to no others. Bounds
are met by every query, a block each; vectors only by the queries routed to their
block, so no part of the index is copied for a block of queries.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.storage import materialize

BLOCK_QUERIES = 4096
BLOCK_VECTORS = 128
BLOCK_BOUNDS = 4096
PIVOTS = 64
METRICS = ("dot", "cosine")


def _rows(column: pa.Array, metric: str) -> np.ndarray:
    """A list column as a matrix, its rows of length 1 for the cosine."""
    matrix = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if metric == "cosine" and len(matrix):
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)
    return matrix


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, "<f8").tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1) if rows else np.zeros((0, 0))


def posting_blocks(index: DataFrame, metric: str = "dot", block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """The stored posting blocks of ``index`` (id, embedding): block, n, ids, vectors and ``bounds``.

    Vectors are sorted by the nearest of ``PIVOTS`` directions, then by length, and
    cut into runs of ``block_vectors``. The directions only shape the blocks; every
    vector is in one block whatever they are. Equal vectors are cut like others.
    """
    kind = dict(index.dtypes)["id"]
    # By id first: where the vectors are still to be made, only those of the directions are made here.
    picked = [r["id"] for r in index.select("id").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    chosen = index.filter(F.col("id").isin(picked)).orderBy("id").limit(PIVOTS).select("embedding").toArrow()
    pivots = _rows(chosen["embedding"].combine_chunks(), "cosine").T

    def sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _rows(batch.column(1), metric)
            nearest = np.argmax(vectors @ pivots, axis=1) if len(vectors) else np.zeros(0)
            columns = [batch.column(0), pa.array([_packed(v) for v in vectors], pa.binary())]
            columns += [pa.array(nearest, pa.int32()), pa.array(np.linalg.norm(vectors, axis=1) if len(vectors) else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "pivot", "length"])

    keyed = index.select("id", "embedding").mapInArrow(sort_keys, f"id {kind}, vector binary, pivot int, length double")
    # Stored, since dealing rows out by range reads them twice and vectors may be costly to make.
    keyed = materialize(keyed, "packed-vectors")
    order = ["pivot", "length", "id"]
    names = ["block", "n", "ids", "vectors", "bounds"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, vectors, pivot = [], [], None

        def flush() -> pa.RecordBatch:
            matrix = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
            center = matrix.mean(axis=0)
            radius = np.linalg.norm(matrix - center, axis=1).max()
            longest = np.linalg.norm(matrix, axis=1).max()
            bounds = np.concatenate([matrix.min(axis=0), matrix.max(axis=0), center, [radius, longest]])
            columns = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(id_type))]
            columns += [pa.array([_packed(matrix)], pa.binary()), pa.array([_packed(bounds)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            columns = (batch.column(c).to_pylist() for c in ("id", "vector", "pivot"))
            for id_, vector, near in zip(*columns, strict=True):
                if ids and (len(ids) == block_vectors or near != pivot):
                    yield flush()
                    ids, vectors, number = [], [], number + 1
                pivot = near
                ids.append(id_)
                vectors.append(vector)
        if ids:
            yield flush()

    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"block long, n int, ids array<{kind}>, vectors binary, bounds binary"
    return materialize(dealt.mapInArrow(cut, schema), "posting-blocks")


def _upper_bounds(queries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Queries x blocks: what no score of the block exceeds, by box, by ball and by length."""
    d = queries.shape[1]
    low, high, center = bounds[:, :d], bounds[:, d : 2 * d], bounds[:, 2 * d : 3 * d]
    radius, longest = bounds[:, 3 * d], bounds[:, 3 * d + 1]
    size = np.linalg.norm(queries, axis=1, keepdims=True)
    box = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    ball = queries @ center.T + size * radius
    # Room for rounding: a bound may be too high, never too low.
    return np.minimum(np.minimum(box, ball), size * longest) + 1e-9 * (1 + size * longest)


def _routes(queries: DataFrame, blocks: DataFrame, metric: str, block_queries: int, seed: bool) -> DataFrame:
    """(block, numbers, vectors): which queries go to which block, packed, with their vectors.

    With ``seed`` each query goes to the block of its highest bound, a row a query
    and group of bounds; without, to all blocks not below its ``least`` score but
    the one it has scored (``had``). A bound is computed once for each query and
    block; blocks of queries meet blocks of bounds.
    """
    across = F.lit(max(1, -(-queries.count() // block_queries)))
    down = F.lit(max(1, -(-blocks.count() // BLOCK_BOUNDS)))
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), across))
    q = q.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), down - 1)))
    b = blocks.select("block", "n", "bounds").withColumn("_b", F.pmod(F.xxhash64("block"), down))
    b = b.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), across - 1)))
    id_type = dict(queries.dtypes)["query_id"]
    names = ["block", "bound", "ids", "vectors"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        ids = left["query_id"].to_pylist()
        if len(left) and len(right):
            vectors = _rows(left["embedding"].combine_chunks(), metric)
            limits = np.frombuffer(b"".join(right["bounds"].to_pylist()), "<f8").reshape(len(right), -1)
            numbers = right["block"].to_numpy()
            most = _upper_bounds(vectors, limits)
            if seed:
                best = most.argmax(axis=1)
                rows = [
                    (int(numbers[c]), float(most[r, c]), [ids[r]], _packed(vectors[r : r + 1])) for r, c in enumerate(best)
                ]
            else:
                wanted = most >= left["least"].to_numpy()[:, None]
                wanted &= numbers[None, :] != left["had"].to_numpy()[:, None]
                for c in np.flatnonzero(wanted.any(axis=0)):
                    r = np.flatnonzero(wanted[:, c])
                    rows.append((int(numbers[c]), 0.0, [ids[k] for k in r], _packed(vectors[r])))
        id_kind = left.schema.field("query_id").type
        types = [pa.int64(), pa.float64(), pa.list_(id_kind), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = f"block long, bound double, ids array<{id_type}>, vectors binary"
    return q.groupBy("_q", "_b").cogroup(b.groupBy("_q", "_b")).applyInArrow(meet, schema)


def _scored(routes: DataFrame, blocks: DataFrame, k: int, types: tuple[str, str]) -> DataFrame:
    """(query_id, block, id, score): the k best of each block for each query routed to it.

    A join by shuffle: many queries at one block are rows that Spark can split.
    """
    sent = routes.select("block", F.col("ids").alias("asked"), F.col("vectors").alias("queries"))
    met = sent.join(blocks.select("block", "n", "ids", "vectors"), "block")
    names = ["query_id", "block", "id", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked_type = batch.schema.field("asked").type.value_type
            id_type = batch.schema.field("ids").type.value_type
            # A row holds a block of vectors, so rows become Python values one at a time.
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                ids = np.array(row["ids"], dtype=object) if isinstance(row["ids"][0], str) else np.array(row["ids"])
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                vectors = _unpacked(row["vectors"], row["n"])[order]
                scores = _unpacked(row["queries"], len(row["asked"])) @ vectors.T
                # Stable, over ids in order: ties go to the smaller id.
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found = np.take_along_axis(scores, best, axis=1)
                width = best.shape[1]
                asked = [q for q in row["asked"] for _ in range(width)]
                columns = [
                    pa.array(asked, asked_type),
                    pa.array([row["block"]] * len(asked), pa.int64()),
                    pa.array(ids[best.ravel()].tolist(), id_type),
                    pa.array(found.ravel(), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(score, f"query_id {types[0]}, block long, id {types[1]}, score double")


def _plan(queries: DataFrame, index: DataFrame, k: int, metric: str, block_queries: int, block_vectors: int):
    """Stored blocks, the seeds' scores and the routes of the second round."""
    if metric not in METRICS:
        raise ValueError("metric is 'dot' or 'cosine'")
    q, n = materialize(queries.select("query_id", "embedding"), "queries"), index.select("id", "embedding")
    types = dict(q.dtypes)["query_id"], dict(n.dtypes)["id"]
    blocks = posting_blocks(n, metric, block_vectors)
    highest = Window.partitionBy("ids").orderBy(F.desc("bound"), "block")
    seeds = _routes(q, blocks, metric, block_queries, seed=True)
    seeds = seeds.withColumn("place", F.row_number().over(highest)).filter("place = 1")
    first = materialize(_scored(seeds, blocks, k, types), "seed-scores")
    reached = first.groupBy("query_id").agg(
        F.max("block").alias("had"), F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least")
    )
    routes = _routes(q.join(reached, "query_id"), blocks, metric, block_queries, seed=False)
    return blocks, first, materialize(routes, "routes"), types


def retrieve_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = fixed.RETRIEVER_TOP_K,
    metric: str = "dot",
    block_queries: int = BLOCK_QUERIES,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """The k best index rows per query, exactly; ties go to the smaller id.

    ``queries`` is ``(query_id, embedding)`` with one row for each id, ``index`` is
    ``(id, embedding)``. One plan at every size. Only k rows per query leave a block.
    """
    blocks, first, routes, types = _plan(queries, index, k, metric, block_queries, block_vectors)
    candidates = first.unionByName(_scored(routes, blocks, k, types)).drop("block")
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = candidates.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k)
    return best.withColumn("rank", F.col("rank").cast("long"))


def search_effort(
    queries: DataFrame,
    index: DataFrame,
    k: int = fixed.RETRIEVER_TOP_K,
    metric: str = "dot",
    block_queries: int = BLOCK_QUERIES,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """One row: queries, vectors, blocks, and the pairs of query and vector that the search scores."""
    blocks, first, routes, _ = _plan(queries, index, k, metric, block_queries, block_vectors)
    sizes = blocks.select("block", "n")
    seeds = first.select("query_id", "block").distinct().join(sizes, "block")
    later = routes.join(sizes, "block").select((F.col("n") * F.size("ids")).alias("pairs_scored"))
    parts = queries.select(F.lit(1).alias("queries"))
    for part in (
        blocks.select(F.col("n").alias("vectors"), F.lit(1).alias("blocks")),
        seeds.select(F.col("n").alias("pairs_scored")),
        later,
    ):
        parts = parts.unionByName(part, allowMissingColumns=True)
    names = ("queries", "vectors", "blocks", "pairs_scored")
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def augmented_context(hits: DataFrame, index: DataFrame, content: str = "content") -> DataFrame:
    """Contents of a query's hits joined with line breaks, best first. At most k rows per query."""
    texts = hits.join(index.select("id", content), "id")
    return texts.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", content))), lambda h: h[content]
            ),
            "\n",
        ).alias("context")
    )
