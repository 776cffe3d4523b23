"""Near-duplicate classes by consistent weighted sampling over TF-IDF weighted shingles.

A text is the set of its shingles (five words) with weights: a damped number of
occurrences times a smoothed inverse document frequency. Improved consistent
weighted sampling gives 64 samples a text; two texts share a sample with the
probability of their weighted Jaccard similarity. Texts that share a band of
four samples are candidates, and every candidate pair that counts is verified on
the full weighted sets. Links of at least the threshold form classes.

Document frequencies are exact for every shingle. The rows are stored in chunks
of bounded bytes; each chunk sends its distinct shingles, with the numbers of its
texts that hold them, to parts of the hash range. A part adds them up and answers
each chunk with the frequencies above 1. The chunks lie in buckets and stay where
they are; the answers are dealt to the buckets and read beside them. What travels
are packed arrays, not rows of single shingles, and no text.

No group is held by one task and no group's pairs are all built. In each bucket
of a band one text is compared with the others; only texts of a bucket that are
not connected after that are compared further: a bounded number of pivots a round
meets the members of the bucket in blocks, until each such text has met all texts
of its bucket. No pair becomes a row unless it links what was not yet connected.
Equal texts are one node throughout.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize, release_shuffles, remove_stored, scratch_path, shared_folder, store
from seedmill.llm.word_hashes import mix, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
BAND_ROWS = 4
IDF_SPAN = 0.25
CHUNK_SHINGLES = 2_000_000
BLOCK_SHINGLES = 32_768
# (most bytes of a text, rows as a power of two): the rows of a chunk come to at most 32 MB.
CHUNKS = ((16 << 10, 11), (512 << 10, 6), (None, 0))
PART_BYTES = 8 << 20
MOST_BUCKETS = 100_000
PIVOTS = 512
BLOCK_MEMBERS = 512
GROUP_MEMBERS = 256
FOLD = np.uint64(0x9FB21C651E98DF25)
CODEC = "zstd"  # of the large stored tables


def _gamma_quantiles(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of ``size`` equal steps."""
    grid = np.concatenate([np.geomspace(1e-4, 1, 100_000), np.linspace(1, 40, 400_000)[1:]])
    return np.interp((np.arange(size) + 0.5) / size, 1 - (1 + grid) * np.exp(-grid), grid)


_tables: list[np.ndarray] = []


def _sampling_tables() -> list[np.ndarray]:
    if not _tables:
        r = _gamma_quantiles()
        _tables.extend([r.astype(np.float32), np.log(r).astype(np.float32)])
    return _tables


def shingles_of(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts, sorted inside each text, and their number for each text.

    A text with fewer words than a shingle has one shingle of all its words; one
    without words has none.
    """
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    out = np.empty(int(n.sum()), dtype=np.uint64)
    if len(hashes) >= size:
        rolled = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            rolled *= FOLD
            rolled += hashes[k : len(hashes) - size + 1 + k]
    else:
        rolled = np.empty(0, np.uint64)
    rolled = mix(rolled)
    at = 0
    for words, end, found in zip(counts.tolist(), ends.tolist(), n.tolist(), strict=True):
        if found:
            part = out[at : at + found]
            if words >= size:
                part[:] = rolled[end - words : end - size + 1]
                part.sort()
            else:
                value = np.zeros(1, np.uint64)
                for h in hashes[end - words : end]:
                    value = value * FOLD + h
                part[:] = mix(value + np.uint64(words))
            at += found
    return out, n


def unique_in_texts(shingles: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, how often each occurs, and the distinct number for each text."""
    if not len(shingles):
        return shingles, np.empty(0, np.int64), n
    text = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    places = np.flatnonzero(new)
    return shingles[places], np.diff(np.append(places, len(shingles))), np.bincount(text[places], minlength=len(n))


def sample(shingles: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Consistent weighted samples, texts x samples.

    For each shingle and sample there are fixed random r and c of Gamma(2, 1) and
    a uniform b. A weight falls on the step t = floor(ln w / r + b) of a ladder,
    and the shingle with the least ln c - r (t - b + 1) is the sample; that least
    value also tells shingle and step. The random numbers are quantiles at 16
    bits of a hash, the same for every text.
    """
    r, log_c = _sampling_tables()
    out = np.empty((samples, len(starts)), dtype=np.float32)
    if not len(starts):
        return out.T
    u, shifted = np.empty_like(shingles), np.empty_like(shingles)
    lanes = u.view("<u2").reshape(-1, 4)
    place = np.empty(len(shingles), dtype=np.intp)
    scale, b, step, value = (np.empty(len(shingles), dtype=np.float32) for _ in range(4))
    for d in range(samples):
        np.add(shingles, np.uint64((0x9E3779B97F4A7C15 * (2 * d + 1)) & 0xFFFFFFFFFFFFFFFF), out=u)
        np.multiply(u, np.uint64(0xFF51AFD7ED558CCD), out=u)
        np.right_shift(u, np.uint64(32), out=shifted)
        np.bitwise_xor(u, shifted, out=u)
        np.multiply(u, np.uint64(0xC4CEB9FE1A85EC53), out=u)
        np.copyto(place, lanes[:, 3])
        np.take(r, place, out=scale, mode="clip")
        np.copyto(place, lanes[:, 2])
        np.take(log_c, place, out=value, mode="clip")
        np.multiply(lanes[:, 1], np.float32(1 / 65536), out=b)
        np.divide(log_weights, scale, out=step)
        np.add(step, b, out=step)
        np.floor(step, out=step)
        np.subtract(step, b, out=step)
        np.add(step, np.float32(1), out=step)
        np.multiply(step, scale, out=step)
        np.subtract(value, step, out=value)
        np.minimum.reduceat(value, starts, out=out[d])
    return np.ascontiguousarray(out.T)


def band_keys(samples: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key for each band of each text; the band's number is in it."""
    bits = samples.view(np.uint32).astype(np.uint64).reshape(len(samples), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), bands)).copy()
    for k in range(rows):
        key = mix(key * FOLD + bits[:, :, k])
    return key


def pack_hashes(sorted_hashes: np.ndarray) -> bytes:
    """Sorted 32-bit hashes as differences, byte plane by byte plane, which compresses."""
    steps = np.diff(sorted_hashes, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights; ``a`` and ``b`` are sorted and distinct."""
    if not len(a) or not len(b):
        return 0.0
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[place] == a
    least = np.minimum(wa[both], wb[place[both]]).sum(dtype=np.float64)
    return float(least / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - least))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, distinct shingles, occurrences, distinct number for each text) for runs of texts."""
    for first, end, hashes, counts in word_hashes(texts):
        yield first, end, *unique_in_texts(*shingles_of(hashes, counts))


def pack_numbers(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, which compresses."""
    return numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_shingles(shingles: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as differences."""
    return pack_numbers(np.diff(shingles, prepend=np.uint64(0)))


def unpack_shingles(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


ASKED = "chunk long, part long, shingles binary, n binary"


def document_frequencies(docs: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, shingles, n): exact frequencies in all documents of the shingles of a chunk of ``docs`` (chunk, text).

    Shingles of a single document are left out. A chunk that is read by several
    tasks asks several times and gets several answers.
    """
    names = [f.split()[0] for f in ASKED.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size, chunk = 0, None

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            part = (found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            places, firsts = np.unique(part, return_index=True)
            bounds = np.append(firsts, len(found)).tolist()
            runs = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [
                pa.array([chunk] * len(runs), pa.int64()),
                pa.array(places.astype(np.int64)),
                pa.array([pack_shingles(found[r]) for r in runs], pa.binary()),
                pa.array([pack_numbers(n[r]) for r in runs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            chunks = batch.column(0).to_numpy()
            for first, end, shingles, _, n in _runs(batch.column(1)):
                ends = np.cumsum(n)
                borders = np.flatnonzero(np.diff(chunks[first:end])) + 1
                for lo, hi in zip([0, *borders.tolist()], [*borders.tolist(), end - first], strict=True):
                    if hi == lo:
                        continue
                    if waiting and (chunks[first + lo] != chunk or size >= CHUNK_SHINGLES):
                        yield flush()
                        waiting, size = [], 0
                    chunk = int(chunks[first + lo])
                    waiting.append(shingles[ends[lo] - n[lo] : ends[hi - 1]])
                    size += len(waiting[-1])
        if waiting:
            yield flush()

    def answer(group: pa.Table) -> pa.Table:
        sets = [unpack_shingles(x) for x in group["shingles"].to_pylist()]
        counts = np.concatenate([unpack_numbers(x) for x in group["n"].to_pylist()])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)[place]
        found, numbers, at = [], [], 0
        for shingles in sets:
            n = total[at : at + len(shingles)]
            at += len(shingles)
            found.append(pack_shingles(shingles[n > 1]))
            numbers.append(pack_numbers(n[n > 1]))
        answered = [group["chunk"], group["part"], pa.array(found, pa.binary()), pa.array(numbers, pa.binary())]
        return pa.table(answered, names=names)

    asked = docs.select("chunk", "text").mapInArrow(ask, ASKED)
    return asked.groupBy("part").applyInArrow(answer, ASKED)


def idf(n: np.ndarray, total: int, span: float = IDF_SPAN) -> np.ndarray:
    """From 1 for a shingle of all documents to ``1 + span`` for one of a single document.

    The span is small on purpose: the threshold is meant for shingles of equal
    weight, and a wider span would pull apart near copies that are many.
    """
    return 1 + span * np.log(total / n) / math.log(max(total, 2))


def sign(docs: DataFrame, stored_at: str | None = None) -> DataFrame:
    """row, doc_id, digest (of the text), bands, shingles and weights of every row of ``docs`` (row, chunk, doc_id, text).

    A text that the chunk has had already is a row without bands. The rows must
    be those of ``number_rows``, since they are read more than once. The result is
    stored, at ``stored_at`` if that is given; what led to it is removed.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total = size["n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"row long, doc_id {kind}, digest string, bands array<bigint>, shingles binary, weights binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def signed(batches: list[pa.RecordBatch], common: np.ndarray, common_n: np.ndarray) -> Iterator[pa.RecordBatch]:
        had: set[str] = set()
        for batch in batches:
            for first, end, shingles, tf, n in _runs(batch.column("text")):
                in_docs = np.ones(len(shingles))
                if len(common):
                    place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
                    known = common[place] == shingles
                    in_docs[known] = common_n[place[known]]
                w = (idf(in_docs, total) * (1 + np.log(tf))).astype(np.float32)
                log_w = np.log(w)
                bounds = np.append(0, np.cumsum(n))
                full = np.flatnonzero(n)
                keys = np.empty((end - first, BANDS), dtype=np.int64)
                for block in _blocks(full, bounds):
                    lo, hi = bounds[block[0]], bounds[block[-1] + 1]
                    samples = sample(shingles[lo:hi], log_w[lo:hi], bounds[block] - lo, BANDS * BAND_ROWS)
                    keys[block] = band_keys(samples).view(np.int64)
                small = (shingles >> np.uint64(32)).astype(np.uint32)
                digests = batch.column("digest").slice(first, end - first).to_pylist()
                bands, sets, set_weights = [], [], []
                for k, digest in enumerate(digests):
                    if digest in had:
                        bands.append(None)
                        sets.append(None)
                        set_weights.append(None)
                        continue
                    had.add(digest)
                    part = slice(bounds[k], bounds[k + 1])
                    bands.append(keys[k] if n[k] else [])
                    sets.append(pack_hashes(small[part]))
                    set_weights.append(w[part].tobytes())
                columns = [batch.column(c).slice(first, end - first) for c in names[:3]]
                columns += [pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(set_weights, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def sign_chunk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.empty(0, np.uint64)
        common = np.concatenate([none, *map(unpack_shingles, answers["shingles"].to_pylist())])
        common_n = np.concatenate([none, *map(unpack_numbers, answers["n"].to_pylist())])
        order = np.argsort(common)
        return pa.Table.from_batches(signed(texts.to_batches(), common[order], common_n[order]))

    text = F.coalesce("text", F.lit(""))
    source = docs.select(
        "chunk",
        "row",
        "doc_id",
        F.md5(text.cast("binary")).alias("digest"),
        text.alias("text"),
    )
    parts = max(1, math.ceil((size["bytes"] or 0) / PART_BYTES))
    path = scratch_path(spark, "frequencies")
    answers = store(document_frequencies(source, parts), path, CODEC).groupBy("chunk")
    release_shuffles(spark)
    signed_chunks = source.groupBy("chunk").cogroup(answers).applyInArrow(sign_chunk, fields)
    stored = store(signed_chunks, stored_at or scratch_path(spark, "signed"), CODEC)
    remove_stored(spark, path)
    release_shuffles(spark)
    return stored


def _blocks(texts: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts with about ``BLOCK_SHINGLES`` shingles together."""
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(bounds[texts + 1], bounds[texts[at]] + BLOCK_SHINGLES, side="right"))
        stop = max(stop, at + 1)
        yield texts[at:stop]
        at = stop


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, by their full weighted sets.

    A set goes once to each group that needs it. Groups are those of the first
    node of a pair, cut into parts of bounded size. The join is by shuffle at every
    size: routes grow with the documents, so they are not for broadcasting.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS).cast("int").alias("parts"))
    size = materialize(size, "group-sizes")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = pairs.join(size, "a").select("a", part.alias("part"), F.col("b").alias("row"), F.lit(False).alias("first"))
    firsts = size.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("row"), F.lit(True).alias("first")
    )
    routed = materialize(members.unionByName(firsts), "routes")
    placed = routed.hint("shuffle_merge").join(sets, "row")
    placed = placed.select("a", "part", "row", "first", "shingles", "weights")

    def compare(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = next(r for r in rows if r["first"])
        set_a, weight_a = unpack_hashes(first["shingles"]), np.frombuffer(first["weights"], np.float32)
        others = [r for r in rows if not r["first"]]
        found = [
            weighted_jaccard(set_a, weight_a, unpack_hashes(r["shingles"]), np.frombuffer(r["weights"], np.float32))
            for r in others
        ]
        return pa.table(
            {
                "a": pa.array([r["a"] for r in others], pa.int64()),
                "b": pa.array([r["row"] for r in others], pa.int64()),
                "similarity": pa.array(found, pa.float64()),
            }
        )

    return placed.groupBy("a", "part").applyInArrow(compare, "a long, b long, similarity double")


def links_in_block(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the pivots and the members of a block that connect different components.

    All pivots are compared with all members on their full sets; of the links only
    those of a spanning forest leave the task, so no more than there are rows.
    """
    rows = group.to_pylist()
    pivots, members = [r for r in rows if r["pivot"]], [r for r in rows if not r["pivot"]]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found_a, found_b = [], []
    if pivots and members:
        sets = [unpack_hashes(r["shingles"]) for r in pivots]
        weights = [np.frombuffer(r["weights"], np.float32) for r in pivots]
        sums = np.array([w.sum(dtype=np.float64) for w in weights])
        every, every_weight = np.concatenate(sets), np.concatenate(weights)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        every, every_weight, owner = every[order], every_weight[order], owner[order]
        for member in members:
            open_pivots = [i for i, p in enumerate(pivots) if find(p["own"]) != find(member["own"])]
            if not open_pivots:
                continue
            own, own_weight = unpack_hashes(member["shingles"]), np.frombuffer(member["weights"], np.float32)
            low = np.searchsorted(every, own)
            n = np.searchsorted(every, own, side="right") - low
            place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            least = np.minimum(every_weight[place], np.repeat(own_weight, n))
            shared = np.bincount(owner[place], weights=least, minlength=len(sets))
            similar = shared / np.maximum(sums + own_weight.sum(dtype=np.float64) - shared, 1e-30)
            for i in np.flatnonzero(similar >= threshold).tolist():
                a, b = find(pivots[i]["own"]), find(member["own"])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found_a.append(pivots[i]["row"])
                    found_b.append(member["row"])
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def meet(pivots: DataFrame, placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between the pivots of a bucket and its members, block by block."""
    parts = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    open_keys = materialize(pivots.select("key", "n").distinct(), "open-buckets")
    members = placed.join(open_keys.select("key"), "key", "left_semi").select(
        "key", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), "row", "own", F.lit(False).alias("pivot")
    )
    sent = pivots.select(
        "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "row", "own", F.lit(True).alias("pivot")
    )
    routed = materialize(members.unionByName(sent), "routes")
    blocks = routed.hint("shuffle_merge").join(sets, "row")
    blocks = blocks.select("key", "part", "row", "own", "pivot", "shingles", "weights")
    return blocks.groupBy("key", "part").applyInArrow(
        lambda group: links_in_block(group, threshold), "a long, b long"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the least node that can be reached.

    Large-star and small-star steps in turn, each written to the shared folder,
    until the edges no longer change; they halve the distances, so few are needed.
    What is joined to all edges of a node is stored first: a join of two stored
    tables is one whose hot keys Spark can split.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    def checksum(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    now = materialize(edges.select("a", "b").distinct(), "edges")
    before = checksum(now)
    while True:
        # Large star: neighbours above a node go to the least node around it.
        around = both(now)
        least = materialize(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "edges")
        # Small star: each node has only smaller neighbours now; they and it go to the least of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("u", "m")).filter("a <> b").distinct()
        now = materialize(small, "edges")
        after = checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )


def candidates(signed: DataFrame, members_at: str, sets_at: str) -> tuple[DataFrame, DataFrame]:
    """The members of each bucket (key, n, head, row) and the sets of those texts, stored at the two paths."""
    nodes = signed.filter("bands IS NOT NULL").groupBy("digest").agg(F.min("row").alias("row")).select("row")
    nodes = materialize(nodes, "nodes")
    keyed = signed.select("row", "bands").join(nodes, "row", "left_semi")
    keyed = keyed.select("row", F.explode("bands").alias("key"))
    sets = signed.select("row", "shingles", "weights")
    # The least number after mixing in the key: another text for each bucket, not one for all.
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("row").bitwiseXOR(F.col("key"))).alias("head"))
    buckets = materialize(
        buckets.filter("n > 1").select("key", "n", F.col("head").bitwiseXOR(F.col("key")).alias("head")), "buckets"
    )
    members = store(keyed.join(buckets, "key").select("key", "n", "head", "row"), members_at, CODEC)
    # Only texts with a candidate are compared; their sets are picked out once.
    compared = members.select("row").distinct().hint("shuffle_merge")
    return members, store(sets.join(compared, "row", "left_semi"), sets_at, CODEC)


def link(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) for the distinct texts that have a near duplicate; the others are by themselves."""
    spark = members.sparkSession
    pairs = members.select(F.col("head").alias("a"), F.col("row").alias("b")).filter("a <> b").distinct()
    links = similarities(pairs, sets).filter(F.col("similarity") >= threshold).select("a", "b")
    found = components(materialize(links, "links"))
    waiting = members.filter("n > 2")
    done = None
    while True:
        # What is not connected with the head of its bucket has yet to meet the others there.
        component = found.withColumnRenamed("node", "row").withColumnRenamed("component", "own")
        heads = found.select(F.col("node").alias("head"), F.col("component").alias("head_own"))
        own, head_own = F.coalesce("own", "row").alias("own"), F.coalesce("head_own", "head").alias("head_own")
        placed = waiting.join(component, "row", "left").join(heads, "head", "left")
        placed_at = scratch_path(spark, "placed")
        placed = store(placed.select("key", "n", "head", "row", own, head_own), placed_at, CODEC)
        apart = placed.filter("own <> head_own")
        if done is not None:
            apart = apart.join(done, ["key", "row"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.col("row").bitwiseXOR(F.col("key"))))
        pivots = apart.withColumn("turn", turn).filter(F.col("turn") <= PIVOTS)
        pivots = materialize(pivots.select("key", "n", "row", "own"), "pivots")
        if pivots.isEmpty():
            remove_stored(spark, placed_at)
            return found
        found = _merged(found, materialize(meet(pivots, placed, sets, threshold), "links"))
        remove_stored(spark, placed_at)
        finished = pivots.select("key", "row")
        done = materialize(finished if done is None else done.union(finished), "finished")


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: those that the links connect become one."""
    if links.isEmpty():
        return found

    def own(side: str) -> DataFrame:
        return found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_own"))

    owned = links.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    between = owned.select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"))
    joined = components(between.filter("a <> b"))
    joined = joined.select(F.col("node").alias("old"), F.col("component").alias("least"))
    new = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    new = new.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = found.unionByName(new).join(joined, F.col("component") == F.col("old"), "left")
    return materialize(every.select("node", F.coalesce("least", "component").alias("component")), "components")


def classes(docs: DataFrame, threshold: float = THRESHOLD, numbered: str | None = None) -> DataFrame:
    """row, doc_id and component of every row of ``docs`` (row, chunk, doc_id, text), as ``number_rows`` stores them.

    Equal texts share a component. A null text is an empty one; texts without
    words are near duplicates of equal texts only. An empty table gives an empty
    one; extra columns are not read. The result is stored; large tables on the way
    go as soon as nothing reads them, the table ``numbered`` of the rows too.
    """
    spark = docs.sparkSession
    signed_at, members_at, sets_at = (scratch_path(spark, n) for n in ("signed", "members", "candidate-sets"))
    signed = sign(docs, signed_at)
    if numbered:
        spark.sql(f"DROP TABLE {numbered}")
        remove_stored(spark, f"{shared_folder(spark)}/{numbered}")
    digests = materialize(signed.select("row", "doc_id", "digest", F.col("bands").isNotNull().alias("own")), "digests")
    members, sets = candidates(signed, members_at, sets_at)
    remove_stored(spark, signed_at)
    found = link(members, sets, threshold)
    remove_stored(spark, members_at)
    remove_stored(spark, sets_at)
    nodes = digests.filter("own").groupBy("digest").agg(F.min("row").alias("node"))
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return materialize(digests.join(named, "digest").select("row", "doc_id", "component"), "classes")


def number_rows(docs: DataFrame, name: str | None = None) -> DataFrame:
    """``row``, ``chunk`` and ``doc`` (all columns) of every row of ``docs``, stored in buckets by chunk as table ``name``.

    The numbers hold for every later read. A chunk has neighbouring rows of like
    size, few where texts are long and a single one where it is very long, so its
    bytes are bounded. Each size is counted by itself, so that its chunks are full
    however rare it is: every chunk asks every part for frequencies. It lies in one
    bucket, so what is grouped by chunk needs no shuffle of the texts.
    """
    spark = docs.sparkSession
    row, size = F.monotonically_increasing_id(), F.coalesce(F.octet_length("doc.text"), F.lit(0))
    numbered = docs.select(F.struct("*").alias("doc")).withColumn("row", row)
    chunk = F.lit(None)
    for number, (most, bits) in reversed(list(enumerate(CHUNKS))):
        # An expression of its own: it counts the rows that come to this branch.
        own = F.shiftright(F.monotonically_increasing_id(), bits) * len(CHUNKS) + number
        chunk = own if most is None else F.when(size <= most, own).otherwise(chunk)
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(math.ceil(total / PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = name or _table_name()
    writer = numbered.withColumn("chunk", chunk).write.format("parquet").option("compression", CODEC)
    writer = writer.option("path", f"{shared_folder(spark)}/{name}")
    writer.bucketBy(min(buckets, MOST_BUCKETS), "chunk").sortBy("chunk").saveAsTable(name)
    return spark.table(name)


def _table_name() -> str:
    return f"numbered_{uuid.uuid4().hex}"


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_rows of every row of ``docs``."""
    numbered = _table_name()
    rows = number_rows(docs.select("doc_id", "text"), numbered).select("row", "chunk", "doc.doc_id", "doc.text")
    placed = classes(rows, threshold, numbered).select("doc_id", "component")
    named = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return placed.join(materialize(named, "class-names"), "component").select("doc_id", "class_id", "class_rows")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least doc_id, with all columns of ``docs``.

    The rows are numbered once and stored. Of rows with the same doc_id the first
    stays; a null doc_id comes after all others.
    """
    rows = number_rows(docs)
    read = rows.select("row", "chunk", "doc.doc_id", "doc.text")
    placed = classes(read, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    firsts = placed.groupBy("component").agg(F.min(order).alias("first"))
    dropped = placed.select("row").join(firsts.select(F.col("first.row").alias("row")), "row", "left_anti")
    dropped = materialize(dropped, "dropped")
    return rows.join(dropped, "row", "left_anti").select("doc.*")


