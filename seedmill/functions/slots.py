"""The three places where a user plugs in a model: generator, embedder, judge.

A generator maps a batch of requests to a batch of outputs, an embedder maps
texts to vectors, a judge maps (question, reference, response) to a score.
The defaults here are deterministic and need no model.
"""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedmill import fixed
from seedmill.functions.columns import words

Generator = Callable[[pd.DataFrame], pd.DataFrame]
Embedder = Callable[[list[str]], np.ndarray]


GENERATED_COLUMNS = pd.Index(["request_id", "question", "answer"])


def template_generator(requests: pd.DataFrame) -> pd.DataFrame:
    """Stand-in generator: restates the seed pair with the number of the request."""
    numbered = [f"[{n}] " for n in requests["repeat"].tolist()]
    # One block for the frame: with few rows a batch, making columns one by one costs more than the texts.
    out = np.empty((len(GENERATED_COLUMNS), len(numbered)), dtype=object)
    out[0] = requests["request_id"].tolist()
    out[1] = [n + q for n, q in zip(numbered, requests["question"].tolist(), strict=True)]
    out[2] = [n + a for n, a in zip(numbered, requests["answer"].tolist(), strict=True)]
    return pd.DataFrame(out.T, columns=GENERATED_COLUMNS, copy=False)


GENERATED = "request_id string, question string, answer string"
PIECE_ROWS = 1024


def run_generator(
    df: DataFrame,
    generator: Generator = template_generator,
    schema: str | T.StructType = GENERATED,
    batch_size: int = fixed.GENERATOR_BATCH,
) -> DataFrame:
    """Call the generator on batches of at most ``batch_size`` rows; 0 turns batching off.

    Columns of ``schema`` that the generator does not return are taken from the
    request with the same ``request_id``; an id that comes twice is an error.
    """
    target = _schema(schema)
    step = batch_size if batch_size > 0 else 1
    # Outputs leave in pieces, so that a worker holds those of few batches at once.
    piece = step * max(1, PIECE_ROWS // step)

    def batch(frame: pd.DataFrame, start: int) -> pd.DataFrame:
        rows = frame.iloc[start : start + step]
        rows.index = pd.RangeIndex(len(rows))  # not reset_index, which copies every column
        return rows

    def call(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), piece):
                ends = range(first, min(first + piece, len(frame)), step)
                out = pd.concat(
                    [generator(batch(frame, start)) for start in ends],
                    ignore_index=True,
                )
                carried = [n for n in target.names if n not in out.columns]
                if carried:
                    if not frame["request_id"].is_unique:
                        raise ValueError("a request_id belongs to more than one request")
                    asked = frame.iloc[first : first + piece]
                    out = out.merge(asked[["request_id", *carried]], on="request_id", how="left")
                yield out[target.names]

    return df.mapInPandas(call, target)


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


MAX_CACHED = 1 << 19


class HashingEmbedder:
    """Counts of hashed words: equal texts get equal vectors, shared words bring texts closer.

    The slots of words that came before are kept, up to ``MAX_CACHED`` of them;
    then the table begins anew.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.slots: dict[str, int] = {}

    def _learn(self, found: set[str]) -> None:
        for word in found:
            self.slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % self.dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, text in enumerate(texts):
            if len(self.slots) > MAX_CACHED:
                self.slots.clear()
            found = text.split()
            slots = list(map(self.slots.get, found))
            if None in slots:
                self._learn({word for word, slot in zip(found, slots, strict=True) if slot is None})
                slots = list(map(self.slots.get, found))
            if slots:
                out[i] = np.bincount(slots, minlength=self.dim)
        return out


def embedding_column(text: Column, make_embedder: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """Vector per text. ``make_embedder`` runs once per Python worker task, then serves all batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for texts in batches:
            vectors = embedder(texts.fillna("").tolist())
            yield pd.Series(list(np.asarray(vectors, dtype=np.float32)))

    return embed(text)


def overlap_score(reference: Column, response: Column) -> Column:
    """Default judge: share of distinct reference words found in the response, as 1 to 5."""
    expected = F.array_distinct(words(F.lower(reference)))
    given = F.array_distinct(words(F.lower(response)))
    shared = F.size(F.array_intersect(expected, given))
    share = shared / F.greatest(F.size(expected), F.lit(1))
    return (F.lit(1) + F.floor(share * (fixed.RUBRIC_MAX - 1))).cast("int")


def judge_column(
    judge: Callable[[pd.Series, pd.Series, pd.Series], pd.Series],
    question: Column,
    reference: Column,
    response: Column,
) -> Column:
    """Score column from a user's judge, called on whole Arrow batches."""

    @F.pandas_udf("int")
    def score(q: pd.Series, expected: pd.Series, given: pd.Series) -> pd.Series:
        return judge(q, expected, given)

    return score(question, reference, response)
