"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

The states are found on word classes: the most frequent training words are a
class each, so is the end of a text, and all other words share classes by hash.
Rounds end when the likelihood hardly rises. A last round then gathers the
expected count of every training word in every state, so what the model knows
grows with the vocabulary. With p(state | word) from those counts, smoothed
towards the share of the state, a word's emission is

    p(word | state) = p(word) * p(state | word) / p(state)

where p(word) is the smoothed unigram of the base score and p(state) its sum over
all words, so that emissions of a state add up to one. The factor after p(word)
is the word's lift; the text's score is its base score plus the logarithm of the
scaled forward recursion over lifts, which is the exact likelihood.

Texts are hashed once: their tokens are stored as places in a bounded broadcast
table of the most frequent words, the other words beside them as hashes. Each
round reads those tokens once. A task runs the scaled forward and backward
recursions over its texts, many side by side. Rounds over classes emit one row
of sums a task, added up in two steps; the last round emits the words of a run
of texts with whole numbers, added up by a shuffle, so their sums do not depend
on the order of tasks. Words beyond the table meet their counts in a join.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedmill.functions.storage import materialize
from seedmill.llm.word_hashes import word_hashes

FOLDS = 5
HELD_OUT_FOLD = 1
STATES = 8
OWN_CLASSES = 2047
SHARED_CLASSES = 1024
MOST_ROUNDS = 12
LEAST_GAIN = 0.01  # nats a token
TABLE_WORDS = 1 << 19
UNIT = 1024  # counts of words by state are whole numbers of this part
TOWARDS_SHARE = 1.0
SIDE_BY_SIDE = 1024
MOST_CELLS = 1 << 22
STEPS = 256
KEPT_CELLS = 1 << 21
PRIOR = 10.0


def is_held_out(doc_id: str = "doc_id") -> Column:
    """By the checksum of the id as text. A null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD


def class_of_rest(words: np.ndarray, own: int, shared: int) -> np.ndarray:
    """The shared class of words, after the own classes."""
    return own + ((words >> np.uint64(20)) % np.uint64(shared)).astype(np.int64)


@dataclass
class Vocabulary:
    """Counts of the training tokens.

    ``words`` (sorted hashes), ``counts`` and ``number`` (their classes) are the
    frequent words, ``class_tokens`` the tokens of each class.
    """

    words: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    own: int
    shared: int
    class_tokens: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @property
    def end(self) -> int:
        return self.own + self.shared

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where words stand in the table; -1 for words that are not there."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int32)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1).astype(np.int32)
        place[self.words[place] != hashes] = -1
        return place

    def classes(self, places: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Classes of tokens; ``rest`` has the hashes of those without a place, in order."""
        if not len(self.words):
            return class_of_rest(rest, self.own, self.shared)
        found = self.number[places]
        found[places < 0] = class_of_rest(rest, self.own, self.shared)
        return found


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    def short(self) -> "Model":
        """In single precision, enough for expected counts, whose sums are doubles."""
        return Model(*(part.astype(np.float32) for part in (self.start, self.move, self.emit)))


def _count_words(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts; tasks send each of their words once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        waiting, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (words[:0], counts[:0])
            both, place = np.unique(np.concatenate([words, new]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both))
            return both, total.astype(np.int64)

        for batch in batches:
            for _, _, hashes, _ in word_hashes(batch.column(0), lower=True):
                waiting.append(hashes)
                size += len(hashes)
                if size > 4_000_000:
                    words, counts = merged()
                    waiting, size = [], 0
        words, counts = merged()
        for k in range(0, len(words), 65_536):
            part = slice(k, k + 65_536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[part].view(np.int64)), pa.array(counts[part])], names=["word", "n"]
            )

    counted = training.select("text").mapInArrow(count, "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _at_most(counted: DataFrame, size: int) -> int:
    """The least count such that no more than ``size`` words reach it."""
    total, least = 0, None
    for row in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += row["words"]
        if total > size:
            break
        least = row["n"]
    return least if least is not None else np.iinfo(np.int64).max


def build_vocabulary(
    training: DataFrame, own: int = OWN_CLASSES, shared: int = SHARED_CLASSES, table_words: int = TABLE_WORDS
) -> Vocabulary:
    """The vocabulary of the training texts."""
    counted = materialize(_count_words(training), "word-counts")
    texts = training.count()
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = counted.filter(F.col("n") >= _at_most(counted, table_words)).toArrow()
    words = frequent["word"].to_numpy().view(np.uint64)
    counts = frequent["n"].to_numpy()
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    top = np.lexsort((words, -counts))[:own]
    classes = class_of_rest(words, own, shared).astype(np.int32)  # looked up for each token
    shared_of_top = classes[top]
    classes[top] = np.arange(len(top))
    class_tokens = np.zeros(own + shared + 1)
    class_tokens[: len(top)] = counts[top]
    class_tokens[-1] = texts
    number = F.pmod(F.shiftrightunsigned("word", 20), F.lit(shared))
    for r in counted.groupBy(number.alias("c")).agg(F.sum("n").alias("n")).collect():
        class_tokens[own + r["c"]] = r["n"]
    np.subtract.at(class_tokens, shared_of_top, counts[top])
    return Vocabulary(
        words, counts, classes, own, shared, class_tokens,
        int(totals["n"]) + texts, int(totals["v"]) + (1 if texts else 0), texts,
    )


def first_model(vocabulary: Vocabulary, states: int = STATES, seed: int = 7) -> Model:
    """States that differ at random around the class frequencies; EM does the rest."""
    rng = np.random.default_rng(seed)
    share = (vocabulary.class_tokens + 1) / (vocabulary.class_tokens + 1).sum()
    emit = share[:, None] * np.exp(rng.normal(0, 1, (len(share), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
    move /= move.sum(axis=1, keepdims=True)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def side_by_side(classes: np.ndarray, counts: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of similar length: (text numbers, lengths, classes as steps x texts), longest first.

    Each text gets the end token. Steps x texts are at most ``MOST_CELLS``, or it is one text. What lies beyond a text's end is 0 and not read.
    """
    starts = np.append(0, np.cumsum(counts))[:-1]
    order = np.argsort(-counts, kind="stable")
    k = 0
    while k < len(order):
        texts = order[k : k + min(SIDE_BY_SIDE, max(1, MOST_CELLS // (int(counts[order[k]]) + 1)))]
        k += len(texts)
        lengths = counts[texts] + 1
        table = np.zeros((int(lengths[0]), len(texts)), dtype=np.int32)
        for column, t in enumerate(texts.tolist()):
            table[: counts[t], column] = classes[starts[t] : starts[t] + counts[t]]
            table[counts[t], column] = end
        yield texts, lengths, table


def _active(lengths: np.ndarray, steps: int) -> list[int]:
    """How many texts are not over at each step; lengths descend."""
    return np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()


def _emitted(by_state: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Emissions of ``part`` (steps x texts) as states x steps x texts, so that loops run along the texts."""
    out = np.empty((len(by_state), *part.shape), dtype=by_state.dtype)
    for emit, found in zip(by_state, out, strict=True):
        np.take(emit, part, out=found, mode="clip")
    return out


def _forward(
    model: Model, emitted: np.ndarray, active: list[int], at: int, before: np.ndarray | None, keep=None, scales=None
) -> tuple[np.ndarray, np.ndarray]:
    """Run the scaled forward recursion over the steps of ``emitted``, the first of which is step ``at``.

    ``before`` is the state of the texts (states x texts) after the step before. Gives the last
    state of all texts and the sum of the logarithms of the scales, which is left out where ``scales`` are kept.
    """
    ones = np.ones(len(model.start), dtype=emitted.dtype)
    move = np.ascontiguousarray(model.move.T)
    state = before
    total = np.zeros(emitted.shape[2])
    for s in range(emitted.shape[1]):
        n = active[at + s]
        if n == 0:
            break
        if state is None:
            now = model.start[:, None] * emitted[:, s, :n]
        else:
            now = move @ state[:, :n]
            now *= emitted[:, s, :n]
        scale = ones @ now
        if keep is None:
            now /= scale
            total[:n] += np.log(scale)
            state = now
        else:
            state = np.divide(now, scale, out=keep[:, s, :n])
            scales[s, :n] = scale
    return state, total


def log_likelihood(model: Model, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Natural log of the probability of the class sequences."""
    active = _active(lengths, len(table))
    total, state = np.zeros(len(lengths)), None
    for at in range(0, len(table), STEPS):
        n = active[at]
        if n == 0:
            break
        # Many words and few tokens: rows of the table are picked, not columns of a turned copy.
        emitted = np.moveaxis(model.emit[table[at : at + STEPS, :n]], 2, 0)
        state, part = _forward(model, emitted, active, at, state)
        total[:n] += part
    return total


def expected_counts(model: Model, lengths: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of start, move and emit, and the log likelihood.

    Time is worked through in stretches. Their forward states are kept, together at
    most ``KEPT_CELLS`` steps x texts. Of a larger table only those at the borders
    are kept, and inside a stretch they are worked out again on the way back, so
    memory does not grow with the longest text.
    """
    k = len(model.start)
    by_state = np.ascontiguousarray(model.emit.T)
    active = _active(lengths, len(table))
    stretches = range(0, len(table), STEPS)
    keep_all = sum(len(table[at : at + STEPS]) * active[at] for at in stretches) <= KEPT_CELLS

    def stretch(at: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Classes, forward states and scales of a stretch, and the last state."""
        part = table[at : at + STEPS, : active[at]].astype(np.intp)
        emitted = _emitted(by_state, part)
        kept, scales = np.zeros_like(emitted), np.ones(part.shape, dtype=emitted.dtype)
        after, _ = _forward(model, emitted, active, at, before, kept, scales)
        return part, emitted, kept, scales, after

    borders, ready, total = [None], [], 0.0
    for at in stretches if keep_all else stretches[:-1]:
        if keep_all:
            part, _, kept, scales, state = stretch(at, borders[-1])
            ready.append((part, kept, scales))
        else:
            part = table[at : at + STEPS, : active[at]].astype(np.intp)
            state, _ = _forward(model, _emitted(by_state, part), active, at, borders[-1])
        borders.append(state)
    moves, emits = np.zeros((k, k)), np.zeros((k, len(model.emit)))
    starts = np.zeros(k)
    ahead = None  # emission x backward state over the scale, of the step after the stretch
    for b in range(len(stretches) - 1, -1, -1):
        at = stretches[b]
        n = active[at]
        if keep_all:
            part, kept, scales = ready.pop()
            emitted = _emitted(by_state, part)
        else:
            part, emitted, kept, scales, _ = stretch(at, borders[b])
        total += float(np.log(scales).sum(dtype=np.float64))
        back = np.ones_like(emitted)  # what lies beyond a text's end meets forward states of 0
        weights = emitted  # each step's emissions become its weights once they are read
        for s in range(len(part) - 1, -1, -1):
            m = active[at + s]
            if m < n:
                weights[:, s, m:] = 0
            if ahead is not None and ahead.shape[1]:
                back[:, s, : ahead.shape[1]] = model.move @ ahead
            ahead = weights[:, s, :m]
            ahead *= back[:, s, :m]
            ahead /= scales[s, :m]
        flat_kept, flat_weights = kept.reshape(k, -1), weights.reshape(k, -1)
        moves += flat_kept[:, : flat_kept.shape[1] - n] @ flat_weights[:, n:].T
        if borders[b] is not None:
            moves += borders[b][:, :n] @ weights[:, 0].T
        else:
            starts += (kept[:, 0] * back[:, 0]).sum(axis=1)
        kept *= back
        flat = part.ravel()
        if len(flat) < len(model.emit):  # a stretch of few texts and a wide vocabulary
            met, flat = np.unique(flat, return_inverse=True)
        else:
            met = slice(None)
        size = len(met) if isinstance(met, np.ndarray) else len(model.emit)
        for state_no in range(k):
            emits[state_no, met] += np.bincount(flat, weights=flat_kept[state_no], minlength=size)
    return starts, moves * model.move, emits, total


def _batch_hashes(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and word counts of the texts of a batch, in runs of bounded size."""
    waiting, counts, size = [], [], 0
    for _, _, hashes, n in word_hashes(texts, lower=True):
        waiting.append(hashes)
        counts.append(n)
        size += len(hashes)
        if size > most:
            yield np.concatenate(waiting), np.concatenate(counts)
            waiting, counts, size = [], [], 0
    if counts:
        yield np.concatenate(waiting), np.concatenate(counts)


def number_tokens(rows: DataFrame, vocabulary) -> DataFrame:
    """The stored tokens of texts under a broadcast vocabulary, from doc_id, text and held_out.

    ``places`` holds a 32-bit place in the table for each word, or -1, ``rest``
    the hashes of the words with -1. ``known`` and ``words_log`` are the base
    counts and logarithms of the words in the table and of the end.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, row long, n_tokens long, known long, words_log double, "
    fields += "places binary, rest array<bigint>"
    names = [f.split()[0] for f in fields.split(", ")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = vocabulary.value
        row = TaskContext.get().partitionId() << 33
        logs = np.append(np.log10(table.counts + 0.5), 0.0)  # the last one for the place -1
        end_log = math.log10(table.texts + 0.5)
        for batch in batches:
            done = 0
            for words, counts in _batch_hashes(batch.column(1)):
                n = len(counts)
                doc = np.repeat(np.arange(n), counts)
                places = table.places(words)
                missing = places < 0
                rest = np.append(0, np.cumsum(np.bincount(doc[missing], minlength=n)))
                ends = np.append(0, np.cumsum(counts)).astype(np.int32) * np.int32(4)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(places)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, n),
                        batch.column(2).slice(done, n),
                        pa.array(row + np.arange(n)),
                        pa.array(counts.astype(np.int64) + 1),
                        pa.array(np.bincount(doc[~missing], minlength=n).astype(np.int64) + (1 if table.texts else 0)),
                        pa.array(np.bincount(doc, weights=logs[places], minlength=n) + end_log),
                        packed,
                        pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(words[missing].view(np.int64))),
                    ],
                    names=names,
                )
                done, row = done + n, row + n

    return materialize(rows.select("doc_id", "text", "held_out").mapInArrow(number, fields), "tokens")


def _runs(packed: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, places, word counts) of a batch of stored tokens, in runs of bounded size."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    raw = packed.buffers()[2]
    data = np.frombuffer(raw, np.int32, count=int(offsets[-1])) if raw is not None else np.empty(0, np.int32)
    first = 0
    while first < len(packed):
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), len(packed))
        yield first, end, data[offsets[first] : offsets[end]], np.diff(offsets[first : end + 1]).astype(np.int64)
        first = end


def _classes_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, hashes of the words without one, word counts) of a batch of places and rest."""
    rest, done = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), 0
    for _, _, places, counts in _runs(batch.column(0)):
        missing = int((places < 0).sum())
        yield places, rest[done : done + missing], counts
        done += missing


def baum_welch_round(tokens: DataFrame, vocabulary, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over stored tokens under a broadcast vocabulary and model of classes."""
    states, classes = len(model.value.start), len(model.value.emit)
    size = states + states * states + states * classes + 1

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, now = vocabulary.value, model.value
        total, any_text = np.zeros(size), False
        for batch in batches:
            for places, rest, counts in _classes_of(batch):
                any_text = True
                for _, lengths, table in side_by_side(known.classes(places, rest), counts, known.end):
                    starts, moves, emits, log = expected_counts(now, lengths, table)
                    total += np.concatenate([starts, moves.ravel(), emits.ravel(), [log]])
        if any_text:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([total.tobytes()])], names=["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(size), False
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py())
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    rows = tokens.select("places", "rest").mapInArrow(expect, "slot long, sums binary")
    # Two steps of about the square root of the tasks each, so that no one adds up all.
    slots = max(1, math.isqrt(tokens.rdd.getNumPartitions()))
    summed = rows.repartition(slots, F.pmod("slot", F.lit(slots))).select("sums").mapInArrow(add, "sums binary")
    total = np.zeros(size)
    for row in summed.toLocalIterator():
        total += np.frombuffer(bytes(row["sums"]))
    a, b = states, states + states * states
    return total[:a], total[a:b].reshape(states, states), total[b:-1].reshape(states, classes), float(total[-1])


def train(
    tokens: DataFrame,
    vocabulary,
    states: int = STATES,
    most_rounds: int = MOST_ROUNDS,
    least_gain: float = LEAST_GAIN,
) -> tuple[Model, list[float]]:
    """The model of classes and the log likelihood before each round.

    Rounds end when one raised the likelihood by less than ``least_gain`` a token.
    """
    spark, known = tokens.sparkSession, vocabulary.value
    model, logs = first_model(known, states), []
    share = (known.class_tokens + 1) / (known.class_tokens + 1).sum()
    for _ in range(most_rounds):
        sent = spark.sparkContext.broadcast(model.short())
        starts, moves, emits, log = baum_welch_round(tokens, vocabulary, sent)
        sent.unpersist()
        logs.append(log)
        emit = emits.T + PRIOR * share[:, None]
        model = Model(
            (starts + 1) / (starts + 1).sum(),
            (moves + 1) / (moves + 1).sum(axis=1, keepdims=True),
            emit / emit.sum(axis=0),
        )
        # The first round only breaks the symmetry of the random start, its gain says nothing.
        if len(logs) > 2 and logs[-1] - logs[-2] < least_gain * known.tokens:
            break
    return model, logs


def words_by_state(tokens: DataFrame, vocabulary, model) -> DataFrame:
    """(word, n, s0, s1, ...): expected counts of all words by state, in parts of ``UNIT``. The end has a null word."""
    states = len(model.value.start)
    names = ["word", "n", *[f"s{k}" for k in range(states)]]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = vocabulary.value, model.value
        for batch in batches:
            for places, rest, counts in _classes_of(batch):
                # Numbers within the run: first the words of the table that occur, then the others.
                met_places = np.flatnonzero(np.bincount(places + 1, minlength=1)[1:])
                number = np.empty(len(known.words), np.int32)
                number[met_places] = np.arange(len(met_places))
                met_rest, rest_unit = np.unique(rest, return_inverse=True)
                missing, unit = places < 0, np.empty(len(places), np.int32)
                unit[missing] = len(met_places) + rest_unit
                unit[~missing] = number[places[~missing]]
                met = np.concatenate([known.words[met_places], met_rest])
                end = len(met)
                classes = known.number[met_places], class_of_rest(met_rest, known.own, known.shared), [known.end]
                emit = now.emit[np.concatenate(classes).astype(np.int64)]
                # A shared class stands for one of its words here: its members have one emission.
                local, sums = Model(now.start, now.move, emit), np.zeros((states, end + 1))
                for _, lengths, table in side_by_side(unit, counts, end):
                    sums += expected_counts(local, lengths, table)[2]
                n = np.append(np.bincount(unit, minlength=end), len(counts))
                sums = np.rint(sums * UNIT).astype(np.int64)
                for k in range(0, end + 1, 65_536):
                    part = slice(k, min(k + 65_536, end + 1))
                    word = np.append(met.view(np.int64), 0)[part]
                    is_end = np.arange(part.start, part.stop) == end
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(word, mask=is_end), pa.array(n[part]), *[pa.array(s[part]) for s in sums]],
                        names=names,
                    )

    rows = tokens.select("places", "rest").mapInArrow(expect, ", ".join(f"{name} long" for name in names))
    return materialize(rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]]), "words-by-state")


@dataclass
class Lifts:
    """How p(state | word) becomes a lift: the share of the states in all tokens and their probability."""

    share: np.ndarray
    probability: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Lifts (words x states) from counts by state in parts of ``UNIT``; no counts give a word's lift unseen."""
        counts = counts / UNIT
        weight = counts.sum(axis=1, keepdims=True) + TOWARDS_SHARE
        return (counts + TOWARDS_SHARE * self.share) / weight / self.probability


def word_lifts(learned: DataFrame, vocabulary: Vocabulary, states: int) -> tuple[Lifts, np.ndarray]:
    """The lifts, and those of the words of the table in its order with the end's after them."""
    names = [f"s{k}" for k in range(states)]
    total = learned.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    share = np.array([total[c] for c in names], dtype=float)
    share = share / share.sum() if share.sum() else np.full(states, 1 / states)
    weight = sum(F.col(c) for c in names) / F.lit(float(UNIT)) + TOWARDS_SHARE
    parts = [
        F.coalesce(
            F.sum((F.col("n") + 0.5) * (F.col(c) / F.lit(float(UNIT)) + TOWARDS_SHARE * float(q)) / weight), F.lit(0.0)
        ).alias(c)
        for c, q in zip(names, share, strict=True)
    ]
    found = learned.agg(*parts).first()
    mass = vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)
    lifts = Lifts(share, (np.array([found[c] for c in names]) + 0.5 * share) / mass)
    # The frequent words again, by the least count of the table; the end's row has a null word.
    least = int(vocabulary.counts.min()) if len(vocabulary.counts) else np.iinfo(np.int64).max
    rows = learned.filter((F.col("n") >= least) | F.col("word").isNull()).toArrow()
    counts = np.zeros((len(vocabulary.words) + 1, states))
    is_end = rows["word"].is_null().to_numpy()
    place = np.full(len(rows), len(vocabulary.words))
    place[~is_end] = vocabulary.places(rows["word"].drop_null().to_numpy().view(np.uint64))
    for k, c in enumerate(names):
        counts[place, k] = rows[c].to_numpy()
    return lifts, lifts.of(counts).astype(np.float32)


def score_documents(
    docs: DataFrame,
    states: int = STATES,
    most_rounds: int = MOST_ROUNDS,
    own: int = OWN_CLASSES,
    shared: int = SHARED_CLASSES,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """Score every document under a model learned from those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    smoothed unigram) and score (this model), both log10. A null or empty text
    is its end token. Repeated rows are trained on and scored each. Without a
    training text all counts are zero and both models are uniform guesses. An
    empty table gives an empty one; extra columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", "text", is_held_out().alias("held_out"))
    vocabulary = build_vocabulary(rows.filter(~F.col("held_out")).select("text"), own, shared, table_words)
    known = spark.sparkContext.broadcast(vocabulary)
    tokens = number_tokens(rows, known)
    training = tokens.filter(~F.col("held_out"))
    model, _ = train(training, known, states, most_rounds)
    learned = words_by_state(training, known, spark.sparkContext.broadcast(model.short()))
    lifts, frequent = word_lifts(learned, vocabulary, states)
    sent = spark.sparkContext.broadcast((model.start, model.move, lifts, frequent))

    # A word without a place in the table: its counts come from the stored counts of all words.
    names = ["n", *[f"s{k}" for k in range(states)]]
    rest = tokens.select("row", F.posexplode("rest").alias("at", "word"))
    met = rest.join(learned.filter(F.col("word").isNotNull()), "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_log"),
        F.count("n").alias("rest_known"),
        F.collect_list(F.struct("at", *[F.coalesce(c, F.lit(0)).alias(c) for c in names[1:]])).alias("met"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, words_log double, lift_log double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, unseen, table_lifts = sent.value
        words = len(table_lifts) - 1
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("met"))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = column.flatten()
            at = found.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
            by_state = np.stack([found.field(c).to_numpy(zero_copy_only=False) for c in names[1:]], axis=1)
            bounds = np.append(0, np.cumsum(sizes))
            log = np.zeros(len(batch))
            for first, end, places, counts in _runs(batch.column(batch.schema.get_field_index("places"))):
                part = slice(bounds[first], bounds[end])
                emit = np.empty((words + 1 + bounds[end] - bounds[first], len(start)))
                emit[: words + 1] = table_lifts
                order = np.repeat(bounds[first:end] - bounds[first], sizes[first:end]) + at[part]
                emit[words + 1 + order] = unseen.of(by_state[part])
                unit = places.astype(np.int64)
                missing = unit < 0
                unit[missing] = words + 1 + np.arange(int(missing.sum()))
                now = Model(start, move, emit)
                for texts, lengths, table in side_by_side(unit, counts, words):
                    log[first + texts] = log_likelihood(now, lengths, table)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(5)], pa.array(log / math.log(10))],
                names=[f.split()[0] for f in fields.split(", ")],
            )

    base = math.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1))
    scored = tokens.join(met, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        (F.col("words_log") + F.coalesce("rest_log", F.lit(0.0)) - F.col("n_tokens") * base).alias("words_log"),
        "places",
        "met",
    )
    return scored.mapInArrow(score, fields).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        F.col("words_log").alias("base_score"),
        (F.col("words_log") + F.col("lift_log")).alias("score"),
    )
