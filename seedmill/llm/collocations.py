"""Phrase collocations by vertical partitioning of the suffixes of all texts.

A suffix is a word with up to three words after it in the same piece of a text.
Suffixes that begin alike belong to one tree, and a tree is built by one task, so
what must not grow too large is the number of suffixes under its prefixes:

1. One pass counts prefixes of one, two and three words and keeps those that hold
   a notable share of some stretch of text. A prefix above the memory budget is
   certain to be among them. Such a prefix is replaced by its extensions, one word
   longer, and so on to whole suffixes; a prefix that fills more than half the
   budget is a tree of its own; all others are dealt to trees by a hash.
2. A second pass sorts the suffixes of each stretch by tree, merges equal ones and
   sends them as packed numbers, so a passage that is repeated a million times
   travels once from each stretch.
3. Each tree is grown level by level to the depth of the longest phrase. A node
   counts what its leaves hold. Below a node that is too rare nothing is grown.
   Nodes above a replaced prefix have parts in several trees, which are added up.

The nodes are phrases with exact counts. Scores, and which phrases are part of a
longer one, are joins over them.
"""

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize

DEPTH = 4
TREE_SUFFIXES = 1 << 21
MAX_TREES = 1 << 16
STRETCH_BYTES = 8 << 20

# What ends a piece, what lies between words, and which letters have a small form.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"
WORD, BLANK, END = 0, 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[list(BLANKS)] = BLANK
CLASS[list(PIECE_ENDS)] = END
SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)


@dataclass
class Stretch:
    """The words of a stretch of text: codes into ``words`` from 1 on, and the language of each.

    ``suffixes`` has a row for each depth; code 0 stands where the piece has ended.
    """

    langs: list[str]
    words: list[bytes]
    lang: np.ndarray
    suffixes: np.ndarray


def stretches(batch: pa.RecordBatch, limit: int = STRETCH_BYTES) -> Iterator[Stretch]:
    """The texts (column 0) and languages (column 1) of a batch, a bounded number of bytes at a time.

    A text longer than ``limit`` is cut where a piece ends, which no phrase crosses.
    """
    texts = batch.column(0).cast(pa.large_binary())
    langs = batch.column(1).fill_null("und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = int(offsets[0])
    while at < offsets[-1]:
        stop = min(at + limit, int(offsets[-1]))
        if stop < offsets[-1]:
            stop = _cut(data, offsets, at, stop)
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, stop, side="left"))
        begins = np.maximum(offsets[first:last], at) - at
        yield _stretch(data[at:stop], begins, langs.indices.to_numpy()[first:last], names)
        at = stop


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, stop: int) -> int:
    """The last end of a text or piece up to ``stop``, or else the next one after it."""
    text = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
    if text > at:
        return text
    following = int(offsets[np.searchsorted(offsets, stop, side="left")])
    before = np.flatnonzero(CLASS[data[at:stop]] == END)
    if len(before):
        return at + int(before[-1]) + 1
    after = np.flatnonzero(CLASS[data[stop:following]] == END)
    return stop + int(after[0]) + 1 if len(after) else following


def _stretch(data: np.ndarray, begins: np.ndarray, lang: np.ndarray, names: list[str]) -> Stretch:
    kinds = CLASS[data]
    inside = kinds == WORD
    breaks = np.zeros(len(data), bool)
    breaks[begins[begins < len(data)]] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | breaks[1:]
    places = np.flatnonzero(starts)
    n = len(places)
    if not n:
        return Stretch(names, [], np.zeros(0, np.int64), np.zeros((DEPTH, 0), np.int64))
    letters = SMALL[data[inside]]
    offsets = np.append(np.flatnonzero(starts[inside]), len(letters)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    encoded = array.dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64) + 1
    document = np.searchsorted(begins, places, side="right") - 1
    piece = np.cumsum(kinds == END)[places] + document
    goes_on = np.append(piece[1:] == piece[:-1], False)
    suffixes = np.zeros((DEPTH, n), np.int64)
    suffixes[0] = codes
    for d in range(1, DEPTH):
        suffixes[d, :-1] = np.where(goes_on[:-1], suffixes[d - 1, 1:], 0)
    return Stretch(names, encoded.dictionary.to_pylist(), lang[document].astype(np.int64), suffixes)


def ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its combination of values, and a row that has each combination."""
    key, size = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if size > (1 << 62) // width:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max(initial=0)) + 1
        key, size = key * width + column, size * width
    _, rows, numbers = np.unique(key, return_index=True, return_inverse=True)
    return numbers, rows


Prefix = tuple[str, bytes]


def notable(stretch: Stretch, share: float) -> list[tuple[str, bytes, int]]:
    """(language, prefix, count) of all prefixes shorter than a suffix that hold ``share`` of the stretch."""
    least = max(1.0, share * len(stretch.lang))
    found = []
    rows = np.arange(len(stretch.lang))
    for depth in range(1, DEPTH):
        rows = rows[stretch.suffixes[depth - 1, rows] > 0]
        if not len(rows):
            break
        numbers, firsts = ranked([stretch.lang[rows], *stretch.suffixes[:depth, rows]])
        counts = np.bincount(numbers)
        for k in np.flatnonzero(counts >= least):
            row = rows[firsts[k]]
            words = [stretch.words[c - 1] for c in stretch.suffixes[:depth, row]]
            found.append((stretch.langs[stretch.lang[row]], b" ".join(words), int(counts[k])))
        rows = rows[counts[numbers] >= least]
    return found


class Trees:
    """Which tree a suffix belongs to, and how many words of it decide that.

    ``levels`` has for each length of prefix the counted prefixes that lie under
    replaced ones: their language, their words, and the number of their own tree
    or, for a replaced one, its place among the replaced (as -2, -3 and so on).
    """

    def __init__(self, counted: list[tuple[str, bytes, int]], budget: int, total: int):
        self.dealt = max(1, -(-total // budget))
        self.levels: list[dict[Prefix, int]] = [{} for _ in range(DEPTH)]
        self.number = self.dealt
        for lang, prefix, count in sorted(counted):
            level = self.levels[prefix.count(b" ") + 1]
            if count > budget:
                level[lang, prefix] = -2 - len(level)
            elif 2 * count > budget:
                level[lang, prefix] = self.number
                self.number += 1

    def place(self, stretch: Stretch) -> tuple[np.ndarray, np.ndarray]:
        """The tree of every suffix and the length of the prefix that decided."""
        hashes = np.append(np.uint64(0), np.fromiter(map(zlib.crc32, stretch.words), np.uint64, len(stretch.words)))
        of_lang = np.array([zlib.crc32(name.encode()) for name in stretch.langs], np.uint64)
        codes = {word: k + 1 for k, word in enumerate(stretch.words)} if self.levels[1] else {}
        parents = {name: k for k, name in enumerate(stretch.langs)}
        mixed, above = of_lang[stretch.lang], stretch.lang.copy()
        depth = np.zeros(len(mixed), np.int64)
        tree = np.full(len(mixed), -1, np.int64)
        rows = np.arange(len(mixed))
        for d in range(1, DEPTH + 1):
            words = stretch.suffixes[d - 1, rows]
            mixed[rows] = _mix(mixed[rows], hashes[words])
            depth[rows] = d
            level = self.levels[d] if d < DEPTH else {}
            wanted, tags, replaced = [], [], {}
            for (lang, prefix), tag in level.items():
                before, _, word = prefix.rpartition(b" ")
                parent = parents.get((lang, before) if before else lang)
                if parent is not None and word in codes:
                    wanted.append(parent * len(hashes) + codes[word])
                    tags.append(tag)
                    if tag < -1:
                        replaced[lang, prefix] = -2 - tag
            if not wanted:
                break
            order = np.argsort(wanted)
            known, tag_of = np.array(wanted, np.int64)[order], np.array(tags, np.int64)[order]
            keys = above[rows] * len(hashes) + words
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            tag = np.where(known[at] == keys, tag_of[at], -1)
            tree[rows] = np.maximum(tag, -1)
            rows, parents = rows[tag < -1], replaced
            above[rows] = -2 - tag[tag < -1]
        light = tree < 0
        tree[light] = (mixed[light] % np.uint64(self.dealt)).astype(np.int64)
        return tree, depth


def _mix(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Hashes of what the states stand for followed by the values."""
    with np.errstate(over="ignore"):
        mixed = (state ^ value) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(31))


def packed_suffixes(stretch: Stretch, trees: Trees) -> Iterator[tuple[int, bytes]]:
    """For each tree its suffixes of a stretch, equal ones merged, as one packed value."""
    if not len(stretch.lang):
        return
    tree, depth = trees.place(stretch)
    mixed = stretch.lang.astype(np.uint64)
    for column in stretch.suffixes:
        mixed = _mix(mixed, column.astype(np.uint64))
    order = np.argsort((tree.astype(np.uint64) << np.uint64(40)) | (mixed >> np.uint64(24)))
    tree, depth, lang, suffixes = tree[order], depth[order], stretch.lang[order], stretch.suffixes[:, order]
    differs = np.ones(len(order), bool)
    differs[1:] = (tree[1:] != tree[:-1]) | (lang[1:] != lang[:-1])
    for column in suffixes:
        differs[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(differs)
    counts = np.diff(first, append=len(order))
    tree, depth, lang, suffixes = tree[first], depth[first], lang[first], suffixes[:, first]
    edges = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(tree[a]), _pack(stretch, depth[a:b], lang[a:b], suffixes[:, a:b], counts[a:b])


def _pack(stretch: Stretch, depth, lang, suffixes, counts) -> bytes:
    used = np.unique(suffixes)
    used = used[used > 0]
    codes = np.searchsorted(used, suffixes) + (suffixes > 0)
    order = np.lexsort(codes[::-1])
    text = b" ".join([stretch.words[c - 1] for c in used.tolist()])
    head = json.dumps([stretch.langs, len(text), len(counts), int(counts.max())]).encode()
    narrow = "<u2" if len(used) < 1 << 16 else "<u4"
    large = "<u2" if counts.max() < 1 << 16 else "<u8"
    parts = [text, codes[:, order].astype(narrow).tobytes(), lang[order].astype("<u4").tobytes()]
    parts += [depth[order].astype("<u1").tobytes(), counts[order].astype(large).tobytes()]
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
    return len(head).to_bytes(4, "little") + head + body


def _unpack(data: bytes) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    langs, text_size, rows, most = json.loads(data[4 : 4 + size])
    body = zstandard.ZstdDecompressor().decompress(data[4 + size :])
    words = body[:text_size].split(b" ")
    narrow, large = ("<u2" if len(words) < 1 << 16 else "<u4"), ("<u2" if most < 1 << 16 else "<u8")
    at = text_size
    found = []
    for kind, count in ((narrow, DEPTH * rows), ("<u4", rows), ("<u1", rows), (large, rows)):
        found.append(np.frombuffer(body, kind, count, at))
        at += found[-1].nbytes
    codes, lang, depth, counts = found
    return langs, words, codes.reshape(DEPTH, rows), lang, depth, counts


class Tree:
    """The suffixes of one tree, gathered from all stretches."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, data: bytes) -> None:
        langs, words, codes, lang, depth, counts = _unpack(data)
        known = self.words
        renamed = np.array([0, *[known.setdefault(w, len(known) + 1) for w in words]], np.int32)
        names = np.array([self.langs.setdefault(name, len(self.langs)) for name in langs], np.int32)
        self.parts.append((renamed[codes], names[lang], depth, counts))

    def nodes(self, least: int) -> Iterator[tuple[str, bytes, int, int]]:
        """(language, phrase, words, count) of the nodes that occur ``least`` times.

        Nodes above a prefix that is spread over several trees come whatever
        their count here. Depth 0 is the number of all words of a language.
        """
        if not self.parts:
            return
        codes = np.concatenate([p[0] for p in self.parts], axis=1)
        lang, depth, counts = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
        self.parts = []
        words, langs = list(self.words), list(self.langs)
        totals = np.bincount(lang, counts, len(langs))
        for k in np.flatnonzero(totals):
            yield langs[k], b"", 0, int(totals[k])
        parent = lang
        for d in range(1, DEPTH + 1):
            there = codes[d - 1] > 0
            codes, depth, counts, parent = codes[:, there], depth[there], counts[there], parent[there]
            if not len(counts):
                return
            node, firsts = ranked([parent, codes[d - 1]])
            held = np.bincount(node, counts)
            kept = (held >= least) | (depth[firsts] > d)
            lang = lang[there]
            for k in np.flatnonzero(kept).tolist():
                phrase = b" ".join([words[c - 1] for c in codes[:d, firsts[k]].tolist()])
                yield langs[lang[firsts[k]]], phrase, d, int(held[k])
            rows = kept[node]
            codes, depth, counts, parent, lang = codes[:, rows], depth[rows], counts[rows], node[rows], lang[rows]


def phrase_counts(
    docs: DataFrame,
    least: int,
    tree_suffixes: int = TREE_SUFFIXES,
    max_trees: int = MAX_TREES,
    stretch_bytes: int = STRETCH_BYTES,
) -> DataFrame:
    """lang, phrase, words and f of every phrase of up to four words that occurs ``least`` times or more.

    The row with 0 words and an empty phrase holds the number of all words of the
    language. The budget of a tree is ``tree_suffixes``, or more where that would
    make over ``max_trees`` trees, so the table of counted prefixes that all tasks
    get has at most 6 times ``max_trees`` rows.
    """
    texts = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL")
    size = texts.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    most_words = size // 2 + docs.sparkSession.sparkContext.defaultParallelism
    budget = max(tree_suffixes, -(-most_words // max_trees))
    share = budget / (2 * most_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch in stretches(batch, stretch_bytes):
                rows = [("", b"", len(stretch.lang)), *notable(stretch, share)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns
                )

    columns, kinds = ["lang", "prefix", "n"], [pa.string(), pa.binary(), pa.int64()]
    counted = texts.mapInArrow(count, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    listed = [(r.lang, bytes(r.prefix), r.n) for r in counted.filter((F.col("n") * 2 > budget) | (F.length("prefix") == 0)).collect()]
    total = sum(n for _, prefix, n in listed if not prefix)
    trees = Trees([r for r in listed if r[1]], budget, total)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch in stretches(batch, stretch_bytes):
                for tree, data in packed_suffixes(stretch, shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([data], pa.binary())], names=["tree", "data"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for batch in batches:
            for data in batch.column("data"):
                tree.add(data.as_py())
        rows = list(tree.nodes(least))
        if rows:
            names = ["lang", "phrase", "words", "f"]
            types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            lang, phrase, words, f = zip(*rows, strict=True)
            values = (lang, [p.decode() for p in phrase], words, f)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    packs = texts.mapInArrow(pack, "tree long, data binary")
    nodes = packs.groupBy("tree").applyInArrow(grow, "lang string, phrase string, words int, f long")
    summed = nodes.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return summed.filter((F.col("f") >= least) | (F.col("words") == 0))


def _part(phrase: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def collocations(
    docs: DataFrame, least: int = 30, covered: int = 80, first: int = 2000, **partitioning
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best ``first`` phrases of each language.

    Candidates are phrases of two to four words within a piece that occur
    ``least`` times. A phrase is scored by the cut that speaks least for it, ties
    to the shorter first part. One whose words lie in a longer candidate with
    ``covered`` per cent of its occurrences is left out. A null text is an empty
    one, a null language is ``und``, repeated rows count as often as they are
    there, an empty table gives an empty one, and other columns are not read.
    """
    nodes = materialize(phrase_counts(docs, least, **partitioning), "phrases")
    totals = nodes.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = nodes.filter("words > 0").select("lang", "phrase", "f")
    candidates = nodes.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", _part(F.col("phrase"), F.lit(1), F.col("k")))
    cuts = cuts.withColumn("right", _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(7)) * CAST(a AS DECIMAL(19))) DIV (CAST(l AS DECIMAL(19)) + CAST(r AS DECIMAL(19)))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spots = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1),
                lambda start: _part(F.col("phrase"), start, size),
            ),
        )
    )
    inner = candidates.filter("words > 2").select("lang", F.explode(spots).alias("phrase"), F.col("a").alias("f"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    share = F.expr(f"CAST(100 AS DECIMAL(3)) * CAST(longest AS DECIMAL(19)) >= CAST({covered} AS DECIMAL(3)) * CAST(a AS DECIMAL(19))")
    kept = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(share, F.lit(False)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    top = flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
