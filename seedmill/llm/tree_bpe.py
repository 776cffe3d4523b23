"""Byte-level BPE of whole texts; long ones as a tree of halves encoded in parallel.

A long text is halved until its leaves are short. Leaves are rows, so the cluster
encodes them side by side. Neighbours are then joined pairwise. Around a join
the text is encoded anew in a window that grows until both sides agree:

* The window grows to places on both sides where any text of this kind is cut, a
  blank before what is not white space, and one piece further. These places
  have to be ends of ids on their side. The window's ids have to begin with those
  of the left side for that piece and to end with those of the right side.
* Where there are no such blanks, the pattern's own cuts are compared. It reads
  from left to right and looks at most three characters past a place, so from a
  unit of the left side that ends before that, the window is cut anew until one
  of its cuts falls on a cut of the right side.
* A unit that runs over the join, such as a long string without any break, is
  not encoded anew but put together from the ids of its two parts: ids around
  the seam are encoded again, in a window that grows until its first ids are
  those of the left part and its last those of the right part. BPE ids are
  right if every two neighbours are, and these now all are.

The outcome is exactly that of the library for the whole text.
"""

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize
from seedmill.llm.packing import worker_vocabulary
from seedmill.llm.pieces import CUT, byte_symbols, worker_encoder

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LEAF_CHARS = 16_384
FIRST_WINDOW = 64
LAST_WINDOW = 4096
LOOKAHEAD = 3
LONG_UNIT = 512
AGREE = 2


@dataclass
class Segment:
    """A stretch of text and its ids by itself."""

    text: str
    ids: np.ndarray


class TreeEncoder:
    def __init__(self, path: str):
        self.encoder = worker_encoder(path)
        if not self.encoder.splits:
            raise ValueError("the tree joins ids of byte-level BPE only")
        self.tokenizer = self.encoder.tokenizer
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.vocabulary = worker_vocabulary(path)
        self.sizes = np.array([len(t) for t in self.vocabulary])
        self.symbols = {b: c for c, b in byte_symbols().items()}

    def segments(self, text: str) -> list[str | int]:
        """The text cut at added tokens, which are given as their ids."""
        found: list[str | int] = [text]
        for content, number in sorted(self.special.items(), key=lambda s: -len(s[0])):
            cut: list[str | int] = []
            for part in found:
                if isinstance(part, int):
                    cut.append(part)
                    continue
                pieces = part.split(content)
                for k, piece in enumerate(pieces):
                    if k:
                        cut.append(number)
                    if piece:
                        cut.append(piece)
            found = cut
        return found

    def leaf(self, text: str) -> Segment:
        """Encode a short stretch by itself."""
        return Segment(text, np.array(self.encoder.ids(text), dtype="<u4"))

    def units(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """The sizes of the units of a segment, in characters and in ids."""
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(segment.text)
        chars = np.array([end - start for _, (start, end) in spans], dtype=np.int64)
        in_bytes = np.cumsum([len(unit) for unit, _ in spans])
        ends = np.searchsorted(np.cumsum(self.sizes[segment.ids]), in_bytes) + 1
        return chars, np.diff(ends, prepend=0)

    def bpe(self, data: bytes) -> np.ndarray:
        """The ids of one unit."""
        mapped = "".join(map(self.symbols.__getitem__, data))
        return np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], dtype="<u4")

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        """The text of whole leaves; ids hold it, so it need not travel with them."""
        return self._bytes(ids).decode()

    def concat(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a unit from those of its two parts."""
        if not len(left) or not len(right):
            return left if len(left) else right
        size = 4
        while True:
            i, j = min(size, len(left)), min(size, len(right))
            window = self.bpe(self._bytes(left[-i:]) + self._bytes(right[:j]))
            far = len(window) >= 2 * AGREE
            left_agrees = i == len(left) or (far and (window[:AGREE] == left[len(left) - i :][:AGREE]).all())
            right_agrees = j == len(right) or (far and (window[-AGREE:] == right[j - AGREE : j]).all())
            if left_agrees and right_agrees:
                return np.concatenate([left[: len(left) - i], window, right[j:]])
            size *= 2

    def join(self, left: Segment, right: Segment) -> Segment:
        """The segment of both texts together."""
        if not left.text or not right.text:
            return left if left.text else right
        return self._join_at_blanks(left, right) or self._join_at_units(left, right)

    def _join_at_blanks(self, left: Segment, right: Segment) -> Segment | None:
        """Join in a window between blanks that are cuts; None when there are none near."""
        size = FIRST_WINDOW
        while True:
            tail, head = left.text[-size:], right.text[:size]
            left_cuts = [m.start() for m in CUT.finditer(tail)]
            right_cuts = [m.start() for m in CUT.finditer(head)]
            if len(left_cuts) > 1 and len(right_cuts) > 1:
                outer, near = left_cuts[-2:]
                far, last = right_cuts[:2]
                window = np.array(self.encoder.ids(tail[outer:] + head[:last]), dtype="<u4")
                taken_left, near_left = (self._ids_of(left.ids[::-1], tail[at:]) for at in (outer, near))
                taken_right, near_right = (self._ids_of(right.ids, head[:at]) for at in (last, far))
                if None not in (taken_left, near_left, taken_right, near_right):
                    own = left.ids[len(left.ids) - taken_left :]
                    other = right.ids[:taken_right]
                    before, after = taken_left - near_left, taken_right - near_right
                    left_agrees = np.array_equal(window[:before], own[:before])
                    right_agrees = np.array_equal(window[len(window) - after :], other[len(other) - after :])
                    if left_agrees and right_agrees:
                        ids = [left.ids[: len(left.ids) - taken_left], window, right.ids[taken_right:]]
                        return Segment(left.text + right.text, np.concatenate(ids))
            if size >= LAST_WINDOW:
                return None
            size *= 4

    def _ids_of(self, ids: np.ndarray, text: str) -> int | None:
        """How many of the first ``ids`` make up the bytes of ``text``; None where it ends inside an id."""
        size = len(text.encode())
        ends = np.append(0, np.cumsum(self.sizes[ids[:size]]))
        count = int(np.searchsorted(ends, size))
        return count if count < len(ends) and ends[count] == size else None

    def _join_at_units(self, left: Segment, right: Segment) -> Segment:
        left_chars, left_counts = self.units(left)
        right_chars, right_counts = self.units(right)
        left_ends, right_ends = np.cumsum(left_chars), np.cumsum(right_chars)
        sure = int(np.searchsorted(left_ends, len(left.text) - LOOKAHEAD, side="right"))
        begin = int(left_ends[sure - 1]) if sure else 0
        tail = left.text[begin:]
        units_in = 4
        while True:
            whole = units_in >= len(right_ends)
            stop = len(right.text) if whole else int(right_ends[units_in - 1])
            window = tail + right.text[:stop]
            ends = [e for _, (_, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(window)]
            cuts = np.append(0, right_ends[: min(units_in, len(right_ends))]) + len(tail)
            agreed = [e for e in ends if e >= len(tail) and e <= len(window) - LOOKAHEAD]
            agreed = [e for e in agreed if cuts[np.searchsorted(cuts, e)] == e][:1] or ([len(window)] if whole else [])
            if agreed:
                break
            units_in *= 2
        meet = agreed[0]
        skip = int(np.searchsorted(right_ends, meet - len(tail), side="right"))
        left_ids = int(left_counts[:sure].sum())
        right_ids = int(right_counts[:skip].sum())
        known = self._known(left.ids[left_ids:], left_chars[sure:], left_counts[sure:], 0)
        known += self._known(right.ids[:right_ids], right_chars[:skip], right_counts[:skip], len(tail))
        middle = self._units(known, window, [e for e in ends if e <= meet])
        ids = [left.ids[:left_ids], *middle, right.ids[right_ids:]]
        return Segment(left.text + right.text, np.concatenate(ids).astype("<u4"))

    @staticmethod
    def _known(ids: np.ndarray, chars: np.ndarray, counts: np.ndarray, at: int) -> list[tuple[int, int, np.ndarray]]:
        """(start in the window, end, ids) of units whose ids are known."""
        ends, used = at + np.cumsum(chars), np.cumsum(counts)
        return [
            (int(e - c), int(e), ids[u - n : u])
            for e, c, u, n in zip(ends.tolist(), chars.tolist(), used.tolist(), counts.tolist(), strict=True)
        ]

    def _units(self, known: list[tuple[int, int, np.ndarray]], window: str, ends: list[int]) -> list[np.ndarray]:
        """The ids of the units of the window; those of long units from the parts whose ids are known."""
        units = []
        start = 0
        for end in ends:
            text = window[start:end]
            if len(text) <= LONG_UNIT:
                units.append(self.bpe(text.encode()))
            else:
                ids, at = np.array([], dtype="<u4"), start
                for a, b, part in known:
                    if a >= start and b <= end:
                        if a > at:
                            ids = self.concat(ids, self.bpe(window[at:a].encode()))
                        ids, at = self.concat(ids, part), b
                if at < end:
                    ids = self.concat(ids, self.bpe(window[at:end].encode()))
                units.append(ids)
            start = end
        return units

    def tree(self, leaves: list[Segment]) -> Segment:
        """Join neighbours pairwise until one segment is left."""
        while len(leaves) > 1:
            pairs = zip(leaves[::2], leaves[1::2], strict=False)
            odd = leaves[-1:] if len(leaves) % 2 else []
            leaves = [self.join(a, b) for a, b in pairs] + odd
        return leaves[0]

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """All in one process; the cluster does the same leaf by leaf."""
        found = [np.array([], dtype="<u4")]
        for part in self.segments(text):
            if isinstance(part, int):
                found.append(np.array([part], dtype="<u4"))
            else:
                found.append(self.tree([self.leaf(x) for x in halves(part, leaf_chars)]).ids)
        return np.concatenate(found)


def halves(text: str, leaf_chars: int) -> list[str]:
    """The text halved until no part is longer than ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], leaf_chars) + halves(text[middle:], leaf_chars)


_trees: dict[str, TreeEncoder] = {}
_numbers: list[str] = []


def worker_tree(path: str) -> TreeEncoder:
    if path not in _trees:
        _trees[path] = TreeEncoder(path)
    return _trees[path]


def digests(ids: list[int], vocabulary: list[bytes]) -> tuple[int, str, str]:
    """Number of ids, hash of the ids in decimal, hash of the decoded text."""
    if len(_numbers) < len(vocabulary):
        _numbers[:] = map(str, range(len(vocabulary)))
    named = ",".join(map(_numbers.__getitem__, ids)).encode()
    decoded = b"".join(map(vocabulary.__getitem__, ids))
    try:
        decoded.decode()
    except UnicodeDecodeError:
        decoded = decoded.decode(errors="replace").encode()
    return len(ids), hashlib.sha256(named).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_and_decode(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    A null text is an empty one: no ids, and hashes of the empty string. Texts up
    to ``leaf_chars`` are encoded where they are read; only the leaves of longer
    ones move. Those meet again by a key made for that row, so repeated rows
    stay apart. An empty table gives an empty one; extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, "
    first += "row string, segment int, part int, leaf string, special int"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        vocabulary = worker_vocabulary(tokenizer_path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if len(text) <= leaf_chars or not encoder.splits:
                    rows.append((doc, *digests(encoder.ids(text), vocabulary), None, None, None, None, None))
                    continue
                row = uuid.uuid4().hex
                for s, segment in enumerate(worker_tree(tokenizer_path).segments(text)):
                    if isinstance(segment, int):
                        rows.append((doc, None, None, None, row, s, 0, None, segment))
                    else:
                        for p, leaf in enumerate(halves(segment, leaf_chars)):
                            rows.append((doc, None, None, None, row, s, p, leaf, None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(batch), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [f.split()[0] for f in first.split(", ")]

    def types(batch: pa.RecordBatch) -> list[pa.DataType]:
        text, number = pa.string(), pa.int32()
        return [batch.schema.field(0).type, pa.int64(), text, text, text, number, number, text, number]

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = worker_tree(tokenizer_path)
        narrow = "<u2" if len(tree.vocabulary) <= 1 << 16 else "<u4"
        for frame in frames:
            ids = [tree.leaf(t).ids.astype(narrow).tobytes() if t is not None else None for t in frame["leaf"]]
            yield frame[["doc_id", "row", "segment", "part", "special"]].assign(ids=ids)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        tree = worker_tree(tokenizer_path)
        narrow = "<u2" if len(tree.vocabulary) <= 1 << 16 else "<u4"
        found = []
        for _, part in frame.sort_values(["segment", "part"]).groupby("segment", sort=True):
            if part["ids"].iloc[0] is None:
                found.append(int(part["special"].iloc[0]))
                continue
            segments = []
            for data in part["ids"]:
                ids = np.frombuffer(data, dtype=narrow).astype("<u4")
                segments.append(Segment(tree.text(ids), ids))
            found.extend(tree.tree(segments).ids.tolist())
        return pd.DataFrame(
            [(frame["doc_id"].iloc[0], *digests(found, tree.vocabulary))],
            columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    result = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    begun = materialize(docs.select("doc_id", "text").mapInArrow(start, first), "encoded")
    short = begun.filter("row IS NULL").select(*result)
    encoded = (
        begun.filter("row IS NOT NULL")
        .select(F.col("doc_id").cast("string").alias("doc_id"), "row", "segment", "part", "leaf", "special")
        .repartition("row", "segment", "part")
        .mapInPandas(
            leaves,
            "doc_id string, row string, segment int, part int, special int, ids binary",
        )
    )
    long = encoded.groupBy("row").applyInPandas(
        joined, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return short.unionByName(long.withColumn("doc_id", F.col("doc_id").cast(kind)))
