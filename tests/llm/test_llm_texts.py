"""Token counts, packing and tree BPE against the library, on odd texts and whole tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seedmill.llm import packing, pieces, token_counts, tree_bpe
from seedmill.llm.pieces import Encoder, Pieces, to_bytes
from seedmill.session import ship_package

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    None, "", " ", "   ", "a  b   c ", " a", "\n\n  x\t y  z　 w  ", "<|endoftext|>hi <|endoftext|> there",
    "it's we'll  '   's \r\n  x", "é  \n\n b", "日本語 テキスト  。", "\x00\x1f \x85    x ½²Ⅷ ٣", "a" * 30_000, "ab " * 9_000,
    "x. " * 20_000, "same", "same",
]
TEXTS = st.text(st.sampled_from(list("abe'slrt 1.\n\t日é　")) | st.characters(codec="utf-8"), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    rows = [(i if i else None, text, "x") for i, text in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


ENCODER = Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoder_and_pieces_agree_with_the_library(text):
    assert ENCODER.ids(text) == ids_of(text)
    assert Pieces(PATH).count(text) == len(ids_of(text))


@settings(max_examples=200, deadline=None)
@given(st.text(" a\n", max_size=60))
def test_blocks_encode_to_the_whole(text):
    parts = pieces.blocks(text, 7)
    assert "".join(parts) == text
    assert [i for p in parts for i in ids_of(p)] == ids_of(text)


def test_both_libraries_cut_every_character_alike():
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(codes), 50):
        text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2 !{chr(c)}? \n{chr(c)}{chr(c)}" for c in codes[k : k + 50])
        assert ENCODER.ordinary(text) == ids_of(text)


SPACED = ["a \u00a0 \u00a0 \u00a0 \u00a0 b", "x \u00a0 \u00a0\ny", "price: \u00a0 \u00a0 \u00a0 5", " \t \t x\u00a0 \u00a0", "a \n \n b \x1f \x1f c "]


@pytest.mark.parametrize("text", SPACED)
def test_runs_of_mixed_white_space_stay_whole(text):
    assert Pieces(PATH).count(text) == len(ids_of(text))
    assert sum(len(ids_of(p)) for p in pieces.blocks(text * 9, 7)) == len(ids_of(text * 9))


@settings(max_examples=300, deadline=None)
@given(st.text(" \u00a0\t\n\u2003\x1ca5", max_size=60))
def test_random_runs_of_mixed_white_space(text):
    assert Pieces(PATH).count(text) == len(ids_of(text))
    assert [i for p in pieces.blocks(text, 7) for i in ids_of(p)] == ids_of(text)


def test_cuts_before_every_character():
    for c in range(0x3100):
        text = f"a  {chr(c)}"
        cuts = [span for _, span in ENCODER.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert (len(pieces.cut_at_blanks(text)) == 2) == (cuts[1] == (1, 2)), hex(c)


def test_full_cache_starts_again_and_stays_exact():
    known = Pieces(PATH, {"a": 1}, max_cached=3)
    for n in range(30):
        assert known.count(f"x a w{n} v{n} u{n}") == len(ids_of(f"x a w{n} v{n} u{n}"))


def test_token_counts(odd):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, PATH).collect())
    assert got == [
        (i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 1024) for i, t in enumerate(ODD)
    ]
    assert token_counts.count_tokens(odd.limit(0), PATH).count() == 0


def test_summary_is_bounded_and_keeps_the_frequent():
    found = token_counts.summarize([f"w{n} the the {n} rare{n}" for n in range(1000)], keep=5, counters=100)
    assert len(found) <= 5 and found["the"] >= 1900


def least_cost(positions, penalties, width):
    best = [0] + [None] * (len(positions) - 1)
    for i in range(1, len(positions)):
        options = [best[j] + width - (positions[i] - positions[j]) for j in range(i) if positions[i] - positions[j] <= width]
        best[i] = min(options) + penalties[i]
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=40))
def test_windows_have_the_least_cost(steps):
    positions, penalties = [0], [0]
    for gap, penalty in steps:
        positions.append(positions[-1] + gap)
        penalties.append(penalty)
    ends = packing.cut_windows(positions, penalties, 10)
    starts = [0, *ends[:-1]]
    assert all(positions[e] - positions[s] <= 10 for s, e in zip(starts, ends, strict=True))
    cost = sum(10 - positions[e] + positions[s] + penalties[e] for s, e in zip(starts, ends, strict=True))
    assert cost == least_cost(positions, penalties, 10)


def check_pieces(rows, texts):
    """Each document's pieces follow each other and hold its ids; sequences are gapless and at most full."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*ids_of(texts[doc]), 0], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sum(r.length for r in rows) / (1024 * len(by_sequence))


def test_packing(spark, odd):
    check_pieces(packing.pack_documents(odd, PATH).collect(), {i if i else None: t for i, t in enumerate(ODD)})
    assert packing.pack_documents(odd.limit(0), PATH).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_pieces(packing.pack_documents(docs, PATH).collect(), texts) > 0.98


def test_blocks_hand_on_their_open_window():
    vocabulary = packing.vocabulary_bytes(PATH)
    whole, parts = packing.Packer(vocabulary, 64, 1 << 30), packing.Packer(vocabulary, 64, 100)
    texts = [f"One sentence here. Number {n} is next! " * (n % 7) for n in range(60)]
    rows = {}
    for name, packer in (("whole", whole), ("parts", parts)):
        rows[name] = [r for n, t in enumerate(texts) for r in packer.add(n, to_bytes(ids_of(t)))] + packer.finish()
    for found in rows.values():
        tokens = {}
        for doc, start, length, _, total, _, _ in found:
            assert start == tokens.get(doc, 0)
            tokens[doc] = start + length
            assert tokens[doc] <= total
        assert tokens == {n: len(ids_of(t)) + 1 for n, t in enumerate(texts)}


TREE = tree_bpe.TreeEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([1, 2, 3, 7, 20]))
def test_tree_gives_the_ids_of_the_whole_text(text, leaf):
    assert TREE.encode(text, leaf).tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab\n" * 2000, " " * 5000 + "x", "\n " * 3000, "é" * 3000, "qwerty" * 900])
def test_tree_on_long_units(text):
    assert TREE.encode(text, 256).tolist() == ids_of(text)


MIXED = ["\u00a0 ", "\u00a0 \u00a0 ", "word ", "price ", "\n ", "  \n", "7 ", "x", "\t ", "hello world ", "\u3000", " \u3000 ", "\x1c "]


@pytest.mark.parametrize("leaf", [64, 100, 512, 4096, 16_384])
def test_tree_on_runs_of_mixed_white_space(leaf):
    for seed in range(200 if leaf < 4096 else 30):
        draw = random.Random(f"{leaf}-{seed}")
        text = "".join(draw.choices(MIXED, k=1200 if leaf < 4096 else 12_000))
        ids = TREE.encode(text, leaf).tolist()
        assert ids == ids_of(text), (leaf, seed)
        assert LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_tree_bpe_query(odd):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = []
    for i, text in enumerate(ODD):
        ids = ids_of(text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), digest(",".join(map(str, ids))), digest(decoded)))
    got = tree_bpe.encode_and_decode(odd, PATH, leaf_chars=500).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert tree_bpe.encode_and_decode(odd.limit(0), PATH).count() == 0
