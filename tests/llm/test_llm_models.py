"""Near duplicates, neighbour search, the hidden Markov model and the pipeline against brute force."""

import collections
import glob
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seedmill.functions.storage import FILE_CLEANUP, materialize, shared_folder
from seedmill.llm import hidden_markov, near_duplicates, posting_lists, quality_rules, secret_ledger, word_hashes
from seedmill.session import ship_package

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- word hashes


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(word_hashes, "BLOCK_BYTES", 64)
    rng = random.Random(2)
    number = {}
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("aB é\n\t日", k=rng.randint(0, 200))) for _ in range(9)]
        column = pa.array(texts).slice(2)
        for first, end, hashes, counts in word_hashes.word_hashes(column, lower=True):
            at = 0
            for text, count in zip(texts[2 + first : 2 + end], counts.tolist(), strict=True):
                found = [w.replace("B", "b") for w in words(text)]
                assert len(found) == count
                for word, h in zip(found, hashes[at : at + count].tolist(), strict=True):
                    assert number.setdefault(word, h) == h
                at += count
    assert len(set(number.values())) == len(number)


# --- near duplicates


def brute_classes(texts):
    """Classes by comparing all pairs under the documented weights."""
    shingles = []
    for text in texts:
        w = words(text)
        found = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        shingles.append(collections.Counter(found))
    df = collections.Counter(s for c in shingles for s in c)
    total = len(texts)
    weights = [
        {s: (1 + math.log(n)) * (1 + 0.25 * math.log(total / max(df[s], 0.01 * total)) / math.log(100)) for s, n in c.items()}
        for c in shingles
    ]
    parent = list(range(total))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(total), 2):
        least = sum(min(w, weights[j][s]) for s, w in weights[i].items() if s in weights[j])
        most = sum(weights[i].values()) + sum(weights[j].values()) - least
        if (texts[i] or "") == (texts[j] or "") or (most and least / most >= 0.8):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(x) for x in range(total)]


def edited(rng, text, share):
    return " ".join(f"z{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 8, 60, 200]))) for _ in range(60)]
    texts += [edited(rng, rng.choice(texts[:60]), rng.choice([0.005, 0.02, 0.2])) for _ in range(100)]
    hot = " ".join(f"h{n}" for n in range(300))
    texts += [edited(rng, hot, 0.01) for _ in range(90)] + [hot] * 30
    texts += [None, "", "", "one two", "one two", "a b c d e " * 40, "a b c d e " * 41]
    return texts


def test_classes_against_all_pairs(spark, corpus):
    ship_package(spark)
    rows = [(n, t, "x") for n, t in enumerate(corpus)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(7)
    got = {r.doc_id: r.class_id for r in near_duplicates.duplicate_classes(docs).collect()}
    assert [got[n] for n in range(len(corpus))] == brute_classes(corpus)
    assert near_duplicates.duplicate_classes(docs.limit(0)).count() == 0


def test_weights_follow_the_frequencies_of_all_shingles(spark, corpus, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(near_duplicates, "CHUNKS", ((40, 4), (200, 2), (None, 0)))
    monkeypatch.setattr(near_duplicates, "PART_BYTES", 10_000)
    texts = [t for t in corpus if len(words(t)) >= 5]
    sets = [collections.Counter(tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)) for t in texts]
    df = collections.Counter(s for c in sets for s in c)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = near_duplicates.number_rows(frame).select("row", "chunk", "doc.doc_id", "doc.text")
    signed = {r.doc_id: r.weights for r in near_duplicates.sign(rows).collect() if r.weights is not None}
    assert {texts[k] for k in signed} == set(texts)
    for k, weights in signed.items():
        expected = [(1 + math.log(n)) * (1 + 0.25 * math.log(len(texts) / df[s]) / math.log(len(texts))) for s, n in sets[k].items()]
        assert sorted(np.frombuffer(weights, np.float32)) == pytest.approx(sorted(expected), rel=1e-5)


def test_rare_sizes_fill_their_chunks(spark, monkeypatch):
    """Every chunk asks every part for frequencies, so chunks with few of the rows they may have multiply what travels."""
    monkeypatch.setattr(near_duplicates, "CHUNKS", ((40, 4), (200, 2), (None, 0)))
    texts = ["y" * 100 if n % 5 == 0 else "z" * 300 if n % 50 == 1 else None if n % 7 == 0 else "x" * 20 for n in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = near_duplicates.number_rows(frame).select("row", "chunk", "doc.doc_id", "doc.text").collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.row)] == list(range(200))
    members = collections.defaultdict(list)
    for r in rows:
        members[r.chunk].append(len(r.text or ""))
    assert all(len({s > 40 for s in sizes}) == len({s > 200 for s in sizes}) == 1 for sizes in members.values())
    full = collections.Counter((max(sizes), len(sizes)) for sizes in members.values())
    assert full == {(100, 4): 10, (300, 1): 4, (20, 16): 9, (20, 12): 1}


def test_few_pivots_a_round_find_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PIVOTS", 1)
    monkeypatch.setattr(near_duplicates, "GROUP_MEMBERS", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK_MEMBERS", 4)
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(corpus)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.duplicate_classes(docs).collect()}
    assert [got[n] for n in range(len(corpus))] == brute_classes(corpus)


def test_keep_one_of_each_class(spark, corpus, tmp_path):
    rows = [(n, t, "x") for n, t in enumerate(corpus)] + [(0, corpus[0], "x"), (None, corpus[1], "y"), (None, "only without id", "z")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter([*set(brute_classes(corpus)), None])


def shared_tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if os.path.isdir(os.path.join(folder, name))}


def shuffle_files(spark):
    temporary = spark.sparkContext._jvm.System.getProperty("java.io.tmpdir")
    roots = os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", temporary)
    return {p for root in roots.split(",") for p in glob.glob(f"{root}/blockmgr-*/*/shuffle_*.data")}


def test_large_tables_go_when_nothing_reads_them(spark, corpus):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(corpus)], "doc_id long, text string")
    large = {"signed", "members", "candidate-sets", "placed", "waiting", "frequencies"}

    def left(before):
        return {re.split(r"[-_][0-9a-f]{32}", name)[0] for name in shared_tables(spark) - before}

    before = shared_tables(spark)
    near_duplicates.duplicate_classes(docs).count()
    assert not left(before) & (large | {"numbered"})
    before = shared_tables(spark)
    near_duplicates.keep_one(docs).count()
    assert not left(before) & large and "numbered" in left(before)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    numbers = spark.range(100_000).repartition(5, "id")
    before = shuffle_files(spark)
    kept = numbers.select("id")
    kept.collect()
    assert shuffle_files(spark) - before
    before = shuffle_files(spark)
    stored = materialize(numbers, "numbers")
    stop = time.time() + 20
    while shuffle_files(spark) - before and time.time() < stop:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert stored.count() == 100_000
    assert spark.conf.get(FILE_CLEANUP, None) is None


def test_keep_one_when_later_reads_are_split_otherwise(spark, tmp_path, monkeypatch):
    ship_package(spark)
    rows = [(n, f"text {n % 30} of words {n % 30} and more {n % 30}") for n in range(60)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    store = near_duplicates.materialize

    def fewer_splits(frame, name):
        stored = store(frame, name)
        if name == "classes":
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return stored

    monkeypatch.setattr(near_duplicates, "materialize", fewer_splits)
    try:
        kept = near_duplicates.keep_one(spark.read.parquet(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(r.doc_id for r in kept) == list(range(30))


def test_samples_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(6)
    a = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 2**63, 80).astype(np.uint64)]))
    weight = {s: w for s, w in zip(a.tolist(), np.exp(rng.normal(0, 0.5, 400)), strict=True)}
    wa = np.array([weight[s] for s in a.tolist()], dtype=np.float32)
    wb = np.array([weight.get(s, 1.0) * 1.2 for s in b.tolist()], dtype=np.float32)
    expected = near_duplicates.weighted_jaccard(a, wa, b, wb)
    samples = near_duplicates.sample(np.concatenate([a, b]), np.log(np.concatenate([wa, wb])), np.array([0, 400]), 4000)
    assert abs((samples[0] == samples[1]).mean() - expected) < 0.03


def test_packed_hashes_come_back():
    for size in (0, 1, 1000):
        values = np.sort(np.random.default_rng(size).integers(0, 2**32, size, dtype=np.uint32))
        assert (near_duplicates.unpack_hashes(near_duplicates.pack_hashes(values)) == values).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 30)] + [(200, 201), (201, 200)]
    found = near_duplicates.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{n: 0 for n in range(41)}, **{100 + n: 100 for n in range(30)}, 200: 200, 201: 200}
    assert near_duplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- neighbours


def brute_nearest(rows, every, k):
    ids = np.array(sorted(rows))
    vectors = np.array([rows[i] for i in ids], dtype=np.float64)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    found = {}
    for at in np.flatnonzero(ids % every == 0):
        score = (vectors * vectors[at]).sum(axis=1) / (norms * norms[at])
        order = [o for o in np.lexsort((ids, -score)) if o != at][:k]
        found[int(ids[at])] = [(int(ids[o]), float(score[o])) for o in order]
    return found


def found_of(frame):
    got = collections.defaultdict(dict)
    for r in frame.collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    return {q: [ranks[n] for n in sorted(ranks)] for q, ranks in got.items()}


def test_neighbours_of_odd_vectors(spark):
    ship_package(spark)
    rng = np.random.default_rng(1)
    rows = {n: rng.normal(size=8).astype(np.float32).tolist() for n in range(40)}
    rows |= {n: rows[0] for n in range(100, 130)} | {n: [2 * x for x in rows[1]] for n in range(150, 155)}
    bad = [(200, None), (250, [0.0] * 8), (300, [float("nan")] + [1.0] * 7), (350, [None] + [1.0] * 7), (400, [float("inf")] + [1.0] * 7),
           (None, [1.0] * 8), (450, [1.0, 2.0]), (500, [])]
    table = [(i, v, "x") for i, v in rows.items()] + [(7, rows[7], "x")] + [(i, v, "x") for i, v in bad]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>, ids string")
    got, expected = found_of(posting_lists.nearest(frame)), brute_nearest(rows, 50, 5)
    assert set(got) == set(expected)
    for query, hits in expected.items():
        assert [h[1] for h in got[query]] == pytest.approx([h[1] for h in hits], abs=1e-12)
    assert [h[0] for h in got[0]] == [100, 101, 102, 103, 104]
    assert posting_lists.nearest(frame.limit(0)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [h[0] for h in found_of(posting_lists.nearest(three))[0]] == [1, 2]


def test_recall_against_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in frame.collect()}
    got, expected = found_of(posting_lists.nearest(frame)), brute_nearest(rows, 50, 5)
    hits = sum(len({h[0] for h in got[q]} & {h[0] for h in expected[q]}) for q in expected)
    assert set(got) == set(expected) and all(len(h) == 5 for h in got.values())
    assert hits / (5 * len(expected)) >= 0.9


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    centroids = posting_lists.unit(rng.normal(size=(2000, 16)))
    queries = posting_lists.unit(rng.normal(size=(100, 16)))
    graph = posting_lists.Graph.build(centroids)
    ids, distance = graph.search(queries, 32)
    exact = np.argsort(-(queries @ centroids.T), axis=1)[:, :32]
    assert np.mean([len(set(a) & set(b)) / 32 for a, b in zip(ids.tolist(), exact.tolist(), strict=True)]) > 0.9
    assert (np.diff(distance, axis=1) >= 0).all() and all(len(set(r)) == 32 for r in ids.tolist())


# --- hidden Markov model


def tiny_model(rng, states=3, classes=4):
    def rows(*shape):
        table = rng.random(shape) + 0.05
        return table / table.sum(axis=-1, keepdims=True)

    return hidden_markov.Model(rows(states), rows(states, states), rows(states, classes).T.copy())


def test_forward_and_counts_against_all_paths(monkeypatch):
    monkeypatch.setattr(hidden_markov, "STEPS", 2)
    rng = np.random.default_rng(8)
    model = tiny_model(rng)
    counts = np.array([4, 0, 2, 5])
    classes = rng.integers(0, 3, counts.sum())
    texts = np.split(classes, np.cumsum(counts)[:-1])
    (order, lengths, table), = hidden_markov.side_by_side(classes, counts, 3)
    likelihood = hidden_markov.log_likelihood(model, lengths, table)
    expected = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))]
    for place, t in enumerate(order.tolist()):
        sequence = [*texts[t].tolist(), 3]
        paths = {}
        for path in itertools.product(range(3), repeat=len(sequence)):
            p = model.start[path[0]]
            for s, (state, c) in enumerate(zip(path, sequence, strict=True)):
                p *= model.emit[c, state] * (model.move[path[s - 1], state] if s else 1)
            paths[path] = p
        total = sum(paths.values())
        assert likelihood[place] == pytest.approx(math.log(total))
        for path, p in paths.items():
            expected[0][path[0]] += p / total
            for s, (state, c) in enumerate(zip(path, sequence, strict=True)):
                expected[2][state, c] += p / total
                if s:
                    expected[1][path[s - 1], state] += p / total
    starts, moves, emits, log = hidden_markov.expected_counts(model, lengths, table)
    assert starts == pytest.approx(expected[0]) and moves == pytest.approx(expected[1])
    assert emits == pytest.approx(expected[2]) and log == pytest.approx(likelihood.sum())


def test_forward_states_are_worked_out_once_where_they_fit(monkeypatch):
    rng = np.random.default_rng(3)
    counts = np.array([1100, 600, 599, 256, 255, 20, 1, 0])
    emit = rng.random((5, 3))
    model = hidden_markov.Model(np.full(3, 1 / 3), np.full((3, 3), 0.1) + 0.7 * np.eye(3), emit / emit.sum(axis=0))
    ((_, lengths, table),) = hidden_markov.side_by_side(rng.integers(0, 4, counts.sum()), counts, 4)
    forward, steps, found = hidden_markov._forward, [], []

    def counted(model, emitted, active, at, *rest):
        steps.append(at)
        return forward(model, emitted, active, at, *rest)

    monkeypatch.setattr(hidden_markov, "_forward", counted)
    for cells in (hidden_markov.KEPT_CELLS, 0):
        monkeypatch.setattr(hidden_markov, "KEPT_CELLS", cells)
        found.append(np.concatenate([np.ravel(x) for x in hidden_markov.expected_counts(model, lengths, table)]))
    assert steps[:5] == [0, 256, 512, 768, 1024] and steps[5:] == [0, 256, 512, 768, 1024, 768, 512, 256, 0]
    assert found[0] == pytest.approx(found[1], rel=1e-12)
    assert found[0][-1] == pytest.approx(hidden_markov.log_likelihood(model, lengths, table).sum())


def test_a_long_text_does_not_widen_its_neighbours():
    counts = np.array([5] * 1500 + [1_000_000, 0])
    classes = np.arange(counts.sum()) % 3
    found = []
    for texts, lengths, table in hidden_markov.side_by_side(classes, counts, 3):
        assert table.size <= hidden_markov.MOST_CELLS and lengths.tolist() == (counts[texts] + 1).tolist()
        found += texts.tolist()
    assert sorted(found) == list(range(len(counts)))


def check_scores(docs, **settings):
    rows = docs.collect()
    got = sorted(hidden_markov.score_documents(docs, **settings).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    tokens, held = [], []
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, len(words(r.text)))):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        tokens.append([*words(lower), None])
        held.append(zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 1)
    counts = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    total = sum(counts.values())
    for r, t, h in zip(got, tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score)
    return got


def test_scores_of_odd_texts(spark):
    ship_package(spark)
    rows = [(None, "Alone"), (0, None), (1, ""), (2, "The the THE"), (2, "the é É ß"), *[(n, f"w{n % 7} the end {n}") for n in range(3, 60)]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held_out string")
    check_scores(docs, own=3, shared=5, table_words=4)
    assert hidden_markov.score_documents(docs.limit(0)).count() == 0
    unseen = docs.filter(hidden_markov.is_held_out())
    assert hidden_markov.score_documents(unseen).filter("train_tokens <> 0 OR isnan(score)").count() == 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in check_scores(docs) if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_rounds_raise_the_likelihood(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    vocabulary = hidden_markov.build_vocabulary(docs, 100, 50)
    known = spark.sparkContext.broadcast(vocabulary)
    tokens = hidden_markov.number_tokens(docs.select("doc_id", "text", F.lit(False).alias("held_out")), known)
    _, logs = hidden_markov.train(tokens, known, 4, 6, 0.0)
    assert len(logs) == 6 and logs == sorted(logs)
    assert len(hidden_markov.train(tokens, known, 4, 6, 100.0)[1]) == 3
    members = vocabulary.class_tokens[:-1].sum() + vocabulary.texts
    assert members == vocabulary.tokens


def test_every_training_word_has_counts_by_state_and_emissions_add_up_to_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    vocabulary = hidden_markov.build_vocabulary(docs, 20, 10, 50)
    known = spark.sparkContext.broadcast(vocabulary)
    tokens = hidden_markov.number_tokens(docs, known)
    model, _ = hidden_markov.train(tokens, known, 3, 3)
    learned = hidden_markov.words_by_state(tokens, known, spark.sparkContext.broadcast(model))
    rows = learned.collect()
    texts = [r.text for r in docs.collect()]
    lower = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in texts]
    counts = collections.Counter(w for t in lower for w in words(t))
    assert sorted(r.n for r in rows) == sorted([*counts.values(), len(texts)])
    assert all(abs(r.s0 + r.s1 + r.s2 - r.n * hidden_markov.UNIT) <= 2 * len(texts) for r in rows)
    lifts, frequent = hidden_markov.word_lifts(learned, vocabulary, 3)
    by_state = np.array([[r.s0, r.s1, r.s2] for r in rows])
    n = np.array([r.n for r in rows])
    mass = vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)
    emission = ((n + 0.5) / mass)[:, None] * lifts.of(by_state)
    unknown = 0.5 / mass * lifts.of(np.zeros((1, 3)))
    assert emission.sum(axis=0) + unknown[0] == pytest.approx(np.ones(3))
    assert len(frequent) == len(vocabulary.words) + 1 and len(vocabulary.words) <= 50


# --- pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns = docs.columns
    (_, quality), (_, dedup), (_, secrets), (_, pack) = corpus_pipeline.STAGES

    def stored(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = stored(quality(spark, docs, FOLDER), "good")
    kept = {r.doc_id for r in quality_rules.rate_documents(docs, labels).filter("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept
    single = stored(dedup(spark, good, FOLDER), "single")
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    firsts = {rows[c].doc_id for c in brute_classes([r.text for r in rows])}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(firsts)
    clean = stored(secrets(spark, single, FOLDER), "clean")
    assert clean.columns == columns
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert len(r.text) == r.n_chars
        assert r.text == before[r.doc_id] or "[secret]" in r.text
    assert secret_ledger.document_secrets(clean).filter("spans <> ''").count() == 0
    pieces = pack(spark, clean, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    lengths = collections.Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert lengths == tokens
    run = corpus_pipeline.run(spark, FOLDER)
    assert run.agg(F.sum("length")).first()[0] == sum(tokens.values())
