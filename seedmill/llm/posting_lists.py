"""Approximate nearest neighbours by cosine, over balanced posting lists.

Vectors belong to lists around centroids. A vector near the border of several
lists is copied to each of them, so a query finds it although it reads few
lists. Centroids are searched through a graph held in memory for a query's
nearest lists, and those are pruned whose centroid is more than ``ratio`` times as
far as the nearest one. How many lists and which ratio is not guessed: both are
read off the exact neighbours of a bounded sample of queries, so that the wanted
share of neighbours lies in lists that are read, however little structure the
vectors have.

Every vector is indexed and every query answered. Bounds hold for the fitted part
only: centroids (and with them all that is broadcast) are at most
``MAX_CENTROIDS``, fitted on about ``SAMPLE`` vectors. Long lists are cut into
blocks. Equal vectors, even a third of all rows, are one vector with its few
smallest ids, since no more of them can be among a query's nearest.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize

SAMPLE = 60_000
MAX_CENTROIDS = 16_384
LIST_VECTORS = 32
MAX_COPIES = 8
BORDER_RATIO = 1.15
WANTED_RECALL = 0.97
UNPRUNED_RECALL = 0.995
CALIBRATION_QUERIES = 256
BLOCK_VECTORS = 4096
LINKS = 16
ROUNDS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal pairs give equal numbers."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means that weighs nearness against the sizes so far, which keeps clusters balanced."""
    centres = points[rng.choice(len(points), k, replace=False)]
    penalty = np.zeros(k)
    nearest = np.zeros(len(points), dtype=np.int64)
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ centres.T - penalty, axis=1)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        norms = np.sqrt((sums * sums).sum(axis=1))
        full = norms > 1e-9
        centres[full] = sums[full] / norms[full, None]
        lost = np.flatnonzero(~full)
        centres[lost] = points[rng.choice(len(points), len(lost))]
        penalty = 0.05 * (sizes / (len(points) / k) - 1)
    return centres, nearest


def fit_centroids(sample: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """At most ``k`` centroids in two levels; a part gets as many as its share of the sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    top = max(1, math.isqrt(k))
    _, part = _kmeans(sample, top, rng) if top > 1 else (None, np.zeros(len(sample), dtype=np.int64))
    found = []
    for p in range(top):
        members = sample[part == p]
        if len(members):
            own = min(len(members), max(1, round(k * len(members) / len(sample))))
            found.append(_kmeans(members, own, rng)[0])
    return np.concatenate(found)[:MAX_CENTROIDS]


@dataclass
class Graph:
    """Centroids, each linked to its nearest ones and to a few others that keep the graph in one piece."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, seed: int = 13) -> "Graph":
        count = len(centroids)
        rng = np.random.default_rng(seed)
        near = min(LINKS - 4, count - 1)
        links = np.empty((count, LINKS), dtype=np.int64)
        for start in range(0, count, 1024):
            block = np.arange(start, min(count, start + 1024))
            nearness = centroids[block] @ centroids.T
            nearness[np.arange(len(block)), block] = -np.inf
            if near:
                links[block, :near] = np.argpartition(-nearness, near - 1, axis=1)[:, :near]
        ring = (np.arange(count) + 1) % count
        links[:, near] = ring
        links[:, near + 1 :] = rng.integers(0, count, (count, LINKS - near - 1))
        return cls(centroids, links, np.unique(rng.integers(0, count, 2 * math.isqrt(count) + 1)))

    def search(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """About the ``wanted`` nearest centroids of each unit vector, nearest first, and their distances."""
        count = len(self.centroids)
        wanted = min(wanted, count)
        if 4 * wanted >= count:
            nearness = queries @ self.centroids.T
            order = np.argsort(-nearness, axis=1, kind="stable")[:, :wanted]
            return order, _distance(np.take_along_axis(nearness, order, axis=1))
        ids = np.empty((len(queries), wanted), dtype=np.int64)
        found = np.empty((len(queries), wanted))
        for start in range(0, len(queries), 512):
            part = slice(start, start + 512)
            ids[part], found[part] = self._walk(queries[part], wanted)
        return ids, _distance(found)

    def _walk(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Open the best centroids not yet opened, for all queries at once, until the best are all open."""
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(self.centroids)), dtype=bool)
        seen[:, self.entries] = True
        size = max(wanted, 4)
        beam = np.full((len(queries), size), -1)
        near = np.full((len(queries), size), -np.inf)
        opened = np.ones((len(queries), size), dtype=bool)
        fresh = np.broadcast_to(self.entries, (len(queries), len(self.entries)))
        score = queries @ self.centroids[self.entries].T
        while True:
            ids = np.concatenate([beam, fresh], axis=1)
            all_near = np.concatenate([near, score], axis=1)
            open_ = np.concatenate([opened, ~np.isfinite(score)], axis=1)
            best = np.argpartition(-all_near, size - 1, axis=1)[:, :size]
            beam, near = np.take_along_axis(ids, best, axis=1), np.take_along_axis(all_near, best, axis=1)
            opened = np.take_along_axis(open_, best, axis=1)
            todo = np.where(opened, -np.inf, near)
            if not np.isfinite(todo).any():
                break
            pick = np.argpartition(-todo, 3, axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(todo, pick, axis=1))
            np.put_along_axis(opened, pick, True, axis=1)
            fresh = self.links[np.take_along_axis(beam, pick, axis=1)]
            valid = np.repeat(live, fresh.shape[2], axis=1)
            fresh = fresh.reshape(len(queries), -1)
            valid &= ~seen[rows, fresh]
            told = np.where(valid, fresh, -1)
            order = np.argsort(told, axis=1, kind="stable")
            ranked = np.take_along_axis(told, order, axis=1)
            again = np.zeros_like(valid)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
            valid &= ~again
            seen[np.nonzero(valid)[0], fresh[valid]] = True
            score = np.full(fresh.shape, -np.inf)
            r, c = np.nonzero(valid)
            score[r, c] = np.einsum("ij,ij->i", queries[r], self.centroids[fresh[r, c]])
        order = np.argsort(-near, axis=1, kind="stable")[:, :wanted]
        return np.take_along_axis(beam, order, axis=1), np.take_along_axis(near, order, axis=1)


def _distance(nearness: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * nearness))


def lists_of(graph: Graph, vectors: np.ndarray, copies: int = MAX_COPIES, border: float = BORDER_RATIO) -> list[np.ndarray]:
    """The nearest list of each unit vector and those about as near, at most ``copies``."""
    ids, distance = graph.search(vectors, copies)
    near = distance <= border * np.maximum(distance[:, :1], 1e-9)
    return [row[keep] for row, keep in zip(ids, near, strict=True)]


def lists_to_read(
    graph: Graph, queries: np.ndarray, most: int, ratio: float, primary: np.ndarray, least: int
) -> list[np.ndarray]:
    """The ``most`` nearest lists without those beyond ``ratio`` times the nearest distance.

    More are taken where it needs them to hold ``least`` vectors; ``primary``
    counts each vector in its nearest list only.
    """
    found: list = [None] * len(queries)
    left, wanted = np.arange(len(queries)), most
    while len(left):
        ids, distance = graph.search(queries[left], wanted)
        again = []
        for place, row, dist in zip(left.tolist(), ids, distance, strict=True):
            within = int(np.searchsorted(dist, ratio * max(dist[0], 1e-9), side="right"))
            enough = int(np.searchsorted(np.cumsum(primary[row]), least)) + 1
            take = max(min(within, most), enough)
            if take > len(row) and wanted < len(graph.centroids):
                again.append(place)
            else:
                found[place] = row[:take]
        left, wanted = np.array(again, dtype=np.int64), wanted * 4
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite."""
    values = F.col(vector)
    infinite = F.lit(float("inf"))
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return values.isNotNull() & fine & F.exists(values, lambda x: x != 0)


def _list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    values = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def nearest(
    table: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    k: int = 5,
    list_vectors: int = LIST_VECTORS,
    wanted_recall: float = WANTED_RECALL,
) -> DataFrame:
    """query_id, rank, the neighbour's id, and score: the ``k`` nearest found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    other rows. The score is the cosine in double precision on the given
    vectors; ties go to the smaller id. A query with fewer than ``k`` candidates
    gets all. Null ids and vectors that are null, zero or hold null or
    non-finite components take no part, nor do vectors of another length than
    the most frequent one. Of rows that share an id the smallest vector counts.
    """
    spark = table.sparkSession
    number = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    valid = number.filter(F.col("id").isNotNull() & usable("v"))
    sizes = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    result = f"query_id long, rank int, {id_column} long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    one = valid.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    # Of equal vectors a query can have at most k, or k and itself, among its nearest.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    unique = (
        one.withColumn("place", place)
        .filter(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids")
    )
    unique = materialize(unique, "unique-vectors")
    count = unique.count()
    spread = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))

    def some(rows: int) -> DataFrame:
        """About ``rows`` vectors, the same ones each time."""
        return unique.filter(spread < math.ceil(min(1.0, rows / count) * (1 << 30))).orderBy("rep")

    sample = unit(_matrix(some(SAMPLE).select("v").toArrow()["v"], dim))
    graph = Graph.build(fit_centroids(sample, min(MAX_CENTROIDS, max(1, math.ceil(count / list_vectors)))))
    sent = spark.sparkContext.broadcast(graph)
    kind = table.schema[vector].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = lists_of(sent.value, unit(_matrix(batch.column(1), dim)))
                columns = [*batch.columns, _list_array(lists, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "v", "ids", "lists"])

    posted = unique.mapInArrow(post, f"rep long, v {kind}, ids array<bigint>, lists array<int>")
    posted = materialize(posted, "posting-lists")
    most, ratio = _calibrate(posted, some(CALIBRATION_QUERIES), sent, dim, k, kind, wanted_recall)

    sizes = posted.select(F.posexplode("lists").alias("place", "list")).groupBy("list")
    sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("place") == 0).alias("primary")).collect()
    primary, blocks = np.zeros(len(graph.centroids), np.int64), np.zeros(len(graph.centroids), np.int64)
    for r in sizes:
        primary[r["list"]] = r["primary"]
        blocks[r["list"]] = -(-r["n"] // BLOCK_VECTORS)
    shape = spark.sparkContext.broadcast((primary, blocks))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = shape.value
        for batch in batches:
            if not batch.num_rows:
                continue
            chosen = lists_to_read(sent.value, unit(_matrix(batch.column(1), dim)), most, ratio, counts, k + 1)
            for start in range(0, batch.num_rows, 256):
                rows = chosen[start : start + 256]
                lists = np.concatenate(rows)
                query = np.repeat(np.arange(start, start + len(rows)), [len(r) for r in rows])
                each = np.repeat(np.arange(len(lists)), parts[lists])
                block = np.arange(len(each)) - np.repeat(np.cumsum(parts[lists]) - parts[lists], parts[lists])
                taken = batch.take(pa.array(query[each]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[each], pa.int32()), pa.array(block, pa.int32()), *taken.columns],
                    names=["list", "block", "query", "v"],
                )

    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    asked = one.filter(is_query).join(unique.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep")
    asked = materialize(asked, "queries")
    queries = unique.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    queries = queries.mapInArrow(ask, f"list int, block int, query long, v {kind}")
    block_counts = spark.createDataFrame(list(enumerate(np.maximum(blocks, 1).tolist())), "list int, blocks int")
    listed = (
        posted.select("rep", "v", "ids", F.explode("lists").alias("list"))
        .join(F.broadcast(block_counts), "list")
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_in_block(left, right, dim, k)

    hits = (
        queries.groupBy("list", "block")
        .cogroup(listed.select("list", "block", "v", "ids").groupBy("list", "block"))
        .applyInArrow(compare, "query long, best array<struct<far: double, id: bigint>>")
    )
    every = F.array_distinct(F.flatten(F.collect_list("best")))
    best = hits.groupBy("query").agg(F.slice(F.sort_array(every), 1, k + 1).alias("best"))
    # Stored, so that the join below can be split where many queries are one vector.
    best = materialize(best, "best")
    own = asked.join(best, F.col("rep") == F.col("query"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("place", "b")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("b.id").alias(id_column),
        (-F.col("b.far")).alias("score"),
    )


def best_in_block(left: pa.Table, right: pa.Table, dim: int, k: int) -> pa.Table:
    """The ``k + 1`` nearest ids of a block for each query that reads it, as one row: pairs of negated score and id.

    Products of matrices choose, with room for rounding; the chosen pairs are
    scored one by one, so that a pair has the same score wherever it is met.
    """
    queries, offsets, ids, far = [], [0], [], []
    if left.num_rows and right.num_rows:
        asked, stored = _matrix(left["v"], dim), _matrix(right["v"], dim)
        stored_unit = unit(stored)
        own_ids = right["ids"].to_pylist()
        names = left["query"].to_numpy()
        keep = min(k + 1, len(stored))
        for start in range(0, len(asked), 512):
            part = asked[start : start + 512]
            near = unit(part) @ stored_unit.T
            floor = np.partition(near, len(stored) - keep, axis=1)[:, len(stored) - keep] - 1e-9
            q, c = np.nonzero(near >= floor[:, None])
            exact = cosines(part[q], stored[c])
            for row in range(len(part)):
                lo, hi = np.searchsorted(q, [row, row + 1])
                found = [(-s, i) for s, at in zip(exact[lo:hi].tolist(), c[lo:hi].tolist(), strict=True) for i in own_ids[at]]
                for distance, i in sorted(found)[: k + 1]:
                    ids.append(i)
                    far.append(distance)
                queries.append(int(names[start + row]))
                offsets.append(len(ids))
    pairs = pa.StructArray.from_arrays([pa.array(far, pa.float64()), pa.array(ids, pa.int64())], names=["far", "id"])
    best = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
    return pa.table({"query": pa.array(queries, pa.int64()), "best": best})


def _calibrate(posted: DataFrame, sample: DataFrame, graph, dim: int, k: int, kind: str, wanted: float) -> tuple[int, float]:
    """How many lists hold ``wanted`` of the exact neighbours of the sampled vectors, and the ratio to prune by.

    One pass over all vectors compares them with the sample; a task sends on the
    ``k`` best it has for each sampled vector.
    """
    chosen = sample.select("rep", "v").toArrow()
    names, vectors = chosen["rep"].to_numpy(), unit(_matrix(chosen["v"], dim))
    from_centroids = _distance(vectors @ graph.value.centroids.T)
    ratios = from_centroids / np.maximum(from_centroids.min(axis=1, keepdims=True), 1e-9)
    ranks = np.argsort(np.argsort(from_centroids, axis=1, kind="stable"), axis=1) + 1
    sent = posted.sparkSession.sparkContext.broadcast((names, vectors, ratios, ranks))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, needed, places = sent.value
        near = np.full((len(own), k), -np.inf)
        ratio, rank = np.full((len(own), k), np.inf), np.zeros((len(own), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            stored = unit(_matrix(batch.column(1), dim))
            lists = batch.column(2)
            flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            reps = batch.column(0).to_numpy()
            for start in range(0, len(stored), 4096):
                part = slice(start, start + 4096)
                score = asked @ stored[part].T
                score[own[:, None] == reps[part][None, :]] = -np.inf
                best = np.argsort(-score, axis=1)[:, :k]
                for row in range(len(own)):
                    for at in best[row].tolist():
                        if score[row, at] > near[row, -1]:
                            end = starts[start + at + 1] if start + at + 1 < len(starts) else len(flat)
                            lists_of_it = flat[starts[start + at] : end]
                            need, need_rank = needed[row, lists_of_it].min(), places[row, lists_of_it].min()
                            order = np.argsort(-np.append(near[row], score[row, at]), kind="stable")[:k]
                            near[row] = np.append(near[row], score[row, at])[order]
                            ratio[row] = np.append(ratio[row], need)[order]
                            rank[row] = np.append(rank[row], need_rank)[order]
        q, place = np.nonzero(np.isfinite(near))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(near[q, place]), pa.array(ratio[q, place]), pa.array(rank[q, place])],
            names=["q", "near", "ratio", "rank"],
        )

    found = posted.select("rep", "v", "lists").mapInArrow(exact, "q int, near double, ratio double, rank long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "ratio"))
    best = found.withColumn("place", place).filter(F.col("place") <= k)
    found = best.agg(
        F.percentile("rank", F.lit(wanted)).alias("rank"), F.percentile("ratio", F.lit(UNPRUNED_RECALL)).alias("ratio")
    ).first()
    return max(1, math.ceil(found["rank"] or 1)), float(found["ratio"] or 1.0) * (1 + 1e-9)
