"""Fill-in-middle, personal data and collocations against plain versions of their rules."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedmill.llm import collocations, fill_in_middle, personal_data
from seedmill.session import ship_package

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill-in-middle


def plain_example(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab \t\n\x0b\x1fé日 <PSM>")), max_size=80))
def test_token_ends_are_those_of_single_matches(text):
    assert fill_in_middle.token_ends(text) == [m.end() for m in UNIT.finditer(text)]


@pytest.mark.parametrize("text", [" " * 2_000_000, "a " * 500_000, "x" * 3_000_000, "\n\n", ""])
def test_token_ends_of_long_texts(text):
    assert fill_in_middle.token_ends(text) == [m.end() for m in UNIT.finditer(text)]


TEXTS = [
    None, "", " ", "one", "two words", "  lead and trail \n ", "a <P> marker", "broken <P marker <", "é 日本 x y z",
    "word " * 30_000, "same text here", "same text here", "<S", ">x <M", "a\x00b c",
]


def test_fill_in_middle(spark):
    ship_package(spark)
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n string")
    made = fill_in_middle.fill_in_middle(docs)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    got = made.withColumn("back", back).collect()
    expected = [(i, *plain_example(i, t), t or "") for i, t, _, _ in rows]
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


# --- personal data


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 12 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def random_texts(seed, count):
    draw = random.Random(seed)
    parts = [
        "a.b@c.de", "x@y", "@", "%q@r.s.t-u", ".", "..", " ", "-", "\n", "é", "日", "192.168.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8",
        "0010.0.0.00255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "12345678901234567890123", "7",
        "+49 (30) 123456", "+1", "+1 ()", "(", ")", "+44 20 7946 0958 ", "++", "mail ", "example ", "0", "a", "_",
    ]
    return ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(count)]


def spans_of(docs):
    return {
        r.doc_id: [(s.start, s.kind_no, s.kind, s.end) for s in r.spans]
        for r in personal_data.personal_data(docs).collect()
    }


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = [*random_texts(5, 1500), None, "", "a" * 2000, "1" * 2000, "a@b" * 500, "1.1." * 500, "a.b@c.de " * 500, "+1 " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans_of(docs)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[1] < 4] == base_spans(text or ""), text and text[:200]
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def test_long_texts_are_read_once(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a.b@c.de " * 20_000, "AB12" * 200_000, "1.2.3." * 100_000, "+ 1" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans_of(docs)
    assert [len(got[k]) for k in range(6)] == [0, 0, 20_000, 0, 75_000, 0]
    assert got[2] == [(9 * k, 0, "email", 9 * k + 8) for k in range(20_000)]


def test_rows_that_share_an_id_keep_their_own_spans(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.cd", 1), (1, "none", 2), (None, "a@b.cd", 3), (None, "a@b.cd", 4)], "doc_id long, text string, spans int"
    )
    got = sorted(((r.doc_id or 0, len(r.spans)) for r in personal_data.personal_data(docs).collect()))
    assert got == [(0, 1), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("pay GB82WEST12345698765432, thanks", [("iban", "GB82WEST12345698765432")]),
        ("pay GB82WEST12345698765433, thanks", []),
        ("xGB82WEST12345698765432", []),
        ("GB82WEST123456987654321", []),
        ("ZZ82WEST12345698765432", []),
        ("sample GB82WEST12345698765432 of a bank account", [("iban", "GB82WEST12345698765432")]),
        ("example: GB82WEST12345698765432", []),
        ("my SSN is 123-45-6789.", [("ssn", "123-45-6789")]),
        ("order 123-45-6789.", []),
        ("SSN 000-45-6789, SSN 123-00-6789, SSN 123-45-0000", []),
        ("ssn 1123-45-6789", []),
    ],
)
def test_further_kinds_need_a_checksum_or_words_nearby(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [(kind, text[start:end]) for start, number, kind, end in spans_of(docs)[1] if number > 3]
    assert found == expected


def test_words_nearby_move_the_score(spark):
    texts = ["a@b.cd", "mail a@b.cd", "a@b.cd example", "mailbox a@b.cd", "mail " + "x" * 50 + " a@b.cd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r.doc_id: r.spans[0].score for r in personal_data.personal_data(docs).collect()}
    assert [scores[k] for k in range(5)] == [70, 100, 30, 70, 70]


# --- collocations


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    counts[lang, " ".join(words[k : k + size])] += 1
    return counts, {lang: n for lang, n in totals.items() if n}


def plain_collocations(rows, least, covered=80, first=2000):
    counts, totals = plain_counts(rows)
    frequent = {k: f for k, f in counts.items() if f >= least}
    longest = {}
    for (lang, phrase), f in frequent.items():
        words = phrase.split(" ")
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                part = (lang, " ".join(words[k : k + size]))
                longest[part] = max(longest.get(part, 0), f)
    found = []
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        if len(words) < 2 or 100 * longest.get((lang, phrase), 0) >= covered * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = frequent[lang, " ".join(words[:k])], frequent[lang, " ".join(words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, phrase.encode(), left, right))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= first:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return ranked


def phrase_rows(seed, documents):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "B", "日", "x y", "rare", "NEW", "york", "city"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), (".,;", "de")]
    for n in range(documents):
        made = []
        for _ in range(draw.randint(0, 30)):
            made.append("new york city hall" if draw.random() < 0.2 else draw.choice(words))
            made.append(draw.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", " "]))
        rows.append(("".join(made), draw.choice(["en", "de", None])))
    rows += [("the very same line of words. ", "en")] * 60
    return rows


@pytest.mark.parametrize(
    ("budget", "stretch"), [(10, 300), (60, 1000), (500, 1 << 20), (1 << 21, 8 << 20), (3, 1)], ids=str
)
def test_counts_at_every_budget(spark, budget, stretch):
    ship_package(spark)
    rows = phrase_rows(3, 120)
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, f int, tree string")
    counts, totals = plain_counts(rows)
    found = collocations.phrase_counts(docs, 5, tree_suffixes=budget, stretch_bytes=stretch).collect()
    assert {(r.lang, r.phrase): r.f for r in found if r.words} == {k: f for k, f in counts.items() if f >= 5}
    assert {r.lang: r.f for r in found if not r.words} == totals


def test_collocations(spark):
    rows = phrase_rows(7, 300)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for first in (2000, 3):
        got = collocations.collocations(docs, least=8, first=first, tree_suffixes=200, stretch_bytes=2000).collect()
        assert sorted(tuple(r) for r in got) == plain_collocations(rows, 8, first=first)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_prefixes_above_the_budget_are_replaced():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a b c d e. " * 50 + "a b x. " * 40 + "y z. " * 30]), pa.array(["en"])], names=["text", "lang"]
    )
    (stretch,) = collocations.stretches(batch)
    counted = collocations.notable(stretch, 0.01)
    trees = collocations.Trees(counted, 60, len(stretch.lang))
    tree, depth = trees.place(stretch)
    by_first = {}
    for k in range(len(tree)):
        words = tuple(stretch.words[c - 1] for c in stretch.suffixes[:, k] if c)
        by_first.setdefault(words, set()).add((int(tree[k]), int(depth[k])))
    assert all(len(places) == 1 for places in by_first.values())
    (place,) = by_first[(b"a", b"b", b"c", b"d")]
    assert place[1] == 3
    (place,) = by_first[(b"b", b"x")]
    assert place[1] == 2
    assert max(int(t) for t in tree) < trees.number


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.one_of(st.none(), st.text("aB .,\n\té", max_size=40)), st.sampled_from(["en", "de", None])), max_size=8),
    st.sampled_from([1, 5, 17, 1000]),
)
def test_stretches_hold_every_suffix_once(rows, limit):
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], names=["text", "lang"]
    )
    counts = Counter()
    for stretch in collocations.stretches(batch, limit):
        for k in range(len(stretch.lang)):
            words = [stretch.words[c - 1].decode() for c in stretch.suffixes[:, k] if c]
            for d in range(1, len(words) + 1):
                counts[stretch.langs[stretch.lang[k]], " ".join(words[:d])] += 1
    assert counts == plain_counts(rows)[0]
