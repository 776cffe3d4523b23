"""Exact token ids of whole texts, and a bounded cache of what their pieces come to.

A byte-level BPE tokenizer first cuts a text by a pattern and then encodes every
cut by itself. A blank followed by what is not white space always begins a new
cut, whatever stands before it, so a text may be taken apart there and the parts
encoded one by one. A blank before other white space need not begin one: the
pattern keeps a run of white space together.

Two libraries encode this kind of vocabulary; where the ids are the ranks of the
merges, the quicker one gives the ids of the other. It encodes stretches that
have such blanks; all else, and tokenizers of another make, go to the library
that the file is made for.
"""

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

MAX_CACHED = 1 << 18
MAX_KEY = 64
BLOCK_CHARS = 1 << 16

# Fixed value: the pattern by which byte-level tokenizers cut a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: what ``\\s`` stands for in the pattern. Python's own takes in four separators more.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f" (?=[^{SPACES}])")
NO_CUT = re.compile(f" (?:[{SPACES}]|\\Z)")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def to_bytes(ids: Iterable[int]) -> bytes:
    """Token ids as little-endian 32-bit numbers."""
    return array("I", ids).tobytes()


def cut_at_blanks(text: str) -> list[str]:
    """The pieces of a text: the first as it is, the others without the blank they begin with.

    A run of white space leaves all but its last blank to the piece before it, or
    all of it where it does not end with a blank.
    """
    return CUT.split(text) if NO_CUT.search(text) else text.split(" ")


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """The text cut before blanks that begin a word, into parts of at most ``size`` characters where that can be."""
    found, start = [], 0
    while len(text) - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        while cut > start and not CUT.match(text, cut):
            cut = text.rfind(" ", start + 1, cut)
        if cut <= start:
            later = CUT.search(text, start + size)
            if later is None:
                break
            cut = later.start()
        found.append(text[start:cut])
        start = cut
    return [*found, text[start:]]


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Fixed values: a byte that prints is the character of its code, and the bytes
    that do not print are the characters from code 256 on, in order.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """The ids that the tokenizers library gives for whole texts, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        cut = made.get("pre_tokenizer") or {}
        self.splits = (
            cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and not made.get("normalizer")
            and made["model"]["type"] == "BPE"
        )
        self.ordinary = self._quick(made["model"]) if self.splits else None

    def _quick(self, model: dict) -> Callable[[str], list[int]] | None:
        import tiktoken

        vocabulary = model["vocab"]
        merged = (("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"])
        symbols = byte_symbols()
        ranked = all(vocabulary.get(token) == 256 + rank for rank, token in enumerate(merged))
        if not ranked or any(vocabulary.get(s, 256) > 255 for s in symbols):
            return None
        ranks = {bytes(symbols[c] for c in t): n for t, n in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.ordinary is None or any(s in text for s in self.special):
            return self.whole(text)
        if len(text) <= BLOCK_CHARS:
            return self.ordinary(text)
        found: list[int] = []
        for block in blocks(text):
            found += self.ordinary(block) if len(block) <= BLOCK_CHARS else self.whole(block)
        return found


class Pieces:
    """Counts the tokens of texts piece by piece: from a given table, a bounded cache, or the encoder."""

    def __init__(self, path: str, known: dict[str, int] | None = None, max_cached: int = MAX_CACHED):
        self.encoder = worker_encoder(path)
        self.known = known or {}
        self.max_cached = max_cached + len(self.known)
        self.cache: dict[str, int] = dict(self.known)

    def count(self, text: str) -> int:
        encoder = self.encoder
        if not encoder.splits or any(s in text for s in encoder.special):
            return len(encoder.whole(text))
        first, *rest = cut_at_blanks(text)
        found = list(map(self.cache.get, rest))
        total = len(encoder.ids(first)) if first else 0
        if None in found:
            missing = [piece for piece, n in zip(rest, found, strict=True) if n is None]
            total += self._learn(missing)
            found = [n for n in found if n is not None]
        return total + sum(found)

    def _learn(self, missing: list[str]) -> int:
        if len(self.cache) + len(missing) > self.max_cached:
            self.cache = dict(self.known)
        total = 0
        for piece in missing:
            n = self.cache.get(piece)
            if n is None:
                n = len(self.encoder.ids(" " + piece))
                if len(piece) <= MAX_KEY and len(self.cache) < self.max_cached:
                    self.cache[piece] = n
            total += n
        return total


_encoders: dict[str, Encoder] = {}
_pieces: dict[str, tuple[object, Pieces]] = {}


def worker_encoder(path: str) -> Encoder:
    """The one encoder of this Python worker for this path; it lives on from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def worker_pieces(path: str, known: Callable[[], dict], token: object) -> Pieces:
    """The one ``Pieces`` of this Python worker for this path; a new table, told by its token, replaces it."""
    if path not in _pieces or _pieces[path][0] != token:
        _pieces[path] = (token, Pieces(path, known()))
    return _pieces[path][1]
