"""Order-preserving packing of documents into sequences, cut where it costs least.

The token stream of a task, documents one after the other in the order they are
read, is cut into windows of at most ``width`` tokens. A cut between documents
is free, one between sentences costs a little, one inside a sentence more, and
padding costs its length. With ``cost(i)`` the least cost of all up to boundary
``i`` at position ``p``:

    cost(i) = penalty(i) + width - p(i) + min over p(j) >= p(i) - width of (cost(j) + p(j))

The minimum runs over a window that only moves forward, so a queue kept in
ascending order of ``cost + p`` gives it in constant time a boundary.

Texts do not move: each task packs what it reads, in blocks of about
``block_tokens`` whose last open window goes on into the next block. Only the
last sequence of a task is open for good.
"""

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seedmill.llm.pieces import byte_symbols, to_bytes, worker_encoder

WIDTH = 1024
SENTENCE_PENALTY = 4
INNER_PENALTY = 24
INNER_STEP = 16
LONG_GAP = 32
BLOCK_TOKENS = 1 << 20
END_ID = 0


def cut_windows(positions: Sequence[int], penalties: Sequence[int], width: int) -> list[int]:
    """The boundaries, as indices into ``positions``, at which the cheapest windows end.

    ``positions`` ascend from 0, and no gap is wider than ``width``. Of equal
    costs the later start counts.
    """
    reach = [0] * len(positions)
    before = [0] * len(positions)
    queue = deque([0])
    for i in range(1, len(positions)):
        floor = positions[i] - width
        while positions[queue[0]] < floor:
            queue.popleft()
        j = queue[0]
        before[i] = j
        total = reach[j] + width + penalties[i]
        reach[i] = total
        while queue and reach[queue[-1]] >= total:
            queue.pop()
        queue.append(i)
    ends = []
    i = len(positions) - 1
    while i > 0:
        ends.append(i)
        i = before[i]
    return ends[::-1]


class Packer:
    """Packs the documents of one task; rows out are (doc, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, vocabulary: Sequence[bytes], width: int = WIDTH, block_tokens: int = BLOCK_TOKENS):
        self.width = width
        self.block_tokens = block_tokens
        self.ends = np.array([t.rstrip()[-1:] in (b".", b"!", b"?") for t in vocabulary])
        self.lines = np.array([b"\n" in t for t in vocabulary])
        self.blank = np.array([t[:1] in (b" ", b"\n", b"\t", b"\r", b"") for t in vocabulary])
        self.blank[END_ID] = True
        self.docs: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0
        self.sequence = 0

    def add(self, doc: object, ids: bytes) -> list[tuple]:
        """Take a document; gives the pieces of what is full."""
        found = np.frombuffer(ids + to_bytes([END_ID]), dtype="<u4")
        self.docs.append((doc, len(found), 0, found))
        self.tokens += len(found)
        return self._pack(False) if self.tokens >= self.block_tokens else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def boundaries(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a cut is allowed, and what each costs."""
        last = self.ends[ids]
        last[:-1] &= self.blank[ids[1:]]
        sentence = np.flatnonzero(last | self.lines[ids]) + 1
        fixed = np.union1d(np.append(sentence, 0), doc_ends)
        gaps = np.diff(fixed)
        inner = [
            np.arange(fixed[k] + INNER_STEP, fixed[k + 1], INNER_STEP) for k in np.flatnonzero(gaps > min(LONG_GAP, self.width))
        ]
        positions = np.union1d(fixed, np.concatenate(inner)) if inner else fixed
        penalties = np.full(len(positions), INNER_PENALTY)
        penalties[np.searchsorted(positions, sentence)] = SENTENCE_PENALTY
        penalties[np.searchsorted(positions, doc_ends)] = 0
        return positions, penalties

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        positions, penalties = self.boundaries(ids, doc_ends)
        ends = cut_windows(positions.tolist(), penalties.tolist(), self.width)
        if not last:
            ends = ends[:-1]
        cuts = positions[ends]
        done = int(cuts[-1]) if len(cuts) else 0
        edges = np.union1d(cuts, doc_ends[doc_ends < done])
        starts = np.append(0, edges[:-1])
        doc_of = np.searchsorted(doc_ends, starts, side="right")
        doc_starts = np.append(0, doc_ends[:-1])
        window_of = np.searchsorted(cuts, starts, side="right")
        window_starts = np.append(0, cuts[:-1])
        data = memoryview(ids.astype("<u4", copy=False).tobytes())
        rows = []
        pieces = zip(starts.tolist(), edges.tolist(), doc_of.tolist(), window_of.tolist(), strict=True)
        for start, end, d, w in pieces:
            doc, tokens, skipped, _ = self.docs[d]
            crc = zlib.crc32(data[4 * start : 4 * end])
            inside = start - int(doc_starts[d]) + skipped
            rows.append((doc, inside, end - start, crc, tokens, self.sequence + w, start - int(window_starts[w])))
        self.sequence += len(cuts)
        self._carry(done, doc_ends, doc_starts)
        return rows

    def _carry(self, done: int, doc_ends: np.ndarray, doc_starts: np.ndarray) -> None:
        """Keep what follows the last cut for the next block."""
        first = int(np.searchsorted(doc_ends, done, side="right"))
        left = self.docs[first:]
        if left:
            doc, tokens, skipped, found = left[0]
            used = max(0, done - int(doc_starts[first]))
            left[0] = (doc, tokens, skipped + used, found[used:])
        self.docs = left
        self.tokens = sum(len(d[3]) for d in left)


def vocabulary_bytes(path: str) -> list[bytes]:
    """The bytes that each token id of a byte-level tokenizer stands for, by its id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    byte_of = byte_symbols()
    table = [b""] * tokenizer.get_vocab_size()
    for token, number in tokenizer.get_vocab().items():
        table[number] = token.encode() if token in added else bytes(byte_of[c] for c in token)
    return table


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH) -> DataFrame:
    """One row for each piece of each document, each token id in exactly one of them.

    A document is its ids and then id 0, so a null or empty text is one token.
    Repeated rows are packed each. Sequence ids hold the task's number in their
    high bits, so no task needs another's; the same splits of the same input
    give the same rows, also when a task is run again. Extra columns are not
    read. An empty table gives no row.
    """
    kind = docs.schema["doc_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_encoder(tokenizer_path)
        packer = Packer(worker_vocabulary(tokenizer_path), width)
        high = TaskContext.get().partitionId() << 33

        def batch_of(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[5] = [high + s for s in columns[5]]
            arrays = [pa.array(columns[0], like), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        like = None
        for batch in batches:
            like = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = packer.add(doc, to_bytes(encoder.ids(text or "")))
                if rows:
                    yield batch_of(rows, like)
        rows = packer.finish()
        if rows:
            yield batch_of(rows, like)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA.format(kind.simpleString()))


_vocabularies: dict[str, list[bytes]] = {}


def worker_vocabulary(path: str) -> list[bytes]:
    if path not in _vocabularies:
        _vocabularies[path] = vocabulary_bytes(path)
    return _vocabularies[path]
