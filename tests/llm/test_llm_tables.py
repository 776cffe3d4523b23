"""Shards, secrets, quality rules and revisits on small tables with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from seedmill.functions.storage import scratch_path
from seedmill.llm import quality_rules, queries, revisits, secret_ledger, sharding, text_stats

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    count, problem = differences(spark, queries.QUERIES[name], queries.SQL[name], FOLDER, connect(FOLDER))
    assert problem is None
    assert count > 0


# --- shards


def test_shards_of_odd_rows(spark):
    rows = [(1, "a", 5), (1, "a", 6), (2, None, 7), (None, "", 8), (None, None, 9), *[(n, "x" * n, n) for n in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs, [1.0] * 7, 1.0).collect()
    assert len(got) == len(rows)
    sizes = sorted((r.size, r.text_crc32) for r in got)
    assert sizes == sorted((len(t or "") + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    for shard in range(7):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 7) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(docs.limit(0), [1.0], 1.0).count() == 0


def test_weights_and_changes(spark):
    keys = spark.range(20_000)

    def shares(weights):
        placed = sharding.assign_shards(keys, "id", weights).select("id", "placed.shard")
        return {r.id: r.shard for r in placed.collect()}

    before, after = shares([1.0, 1.0, 2.0]), shares([1.0, 1.0, 4.0])
    counts = [sum(s == n for s in before.values()) for n in range(3)]
    assert abs(counts[2] / 20_000 - 0.5) < 0.02 and abs(counts[0] / 20_000 - 0.25) < 0.02
    assert all(after[k] in (before[k], 2) for k in before)
    with pytest.raises(ValueError):
        sharding.shard_scores(F.col("id"), [1.0, 0.0])


def test_many_copies_of_one_row(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("key"), F.lit(0).alias("shard"))
    slots = sharding.with_slots(rows, "shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()
    assert tuple(slots) == (0, 199_999, 200_000)


# --- secrets

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def brute_secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    kinds = ["assign", "access", "hex"]
    found.sort(key=lambda s: (s[1], kinds.index(s[0])))
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (*[sum(s[0] == k for s in found) for k in kinds], hashlib.sha256(line.encode()).hexdigest())


def random_text(rng):
    parts = ["password", "API_key", "token", "=", ": ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "日", " ",
             "abcdefghijklmnop", "short", "\n", "ſecret", "Key"]
    return "".join(rng.choices(parts, k=rng.randint(0, 30)))


def test_secrets_against_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "token=" + "a" * 20_000, *[random_text(rng) for _ in range(400)]]
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, blob string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_ledger.document_secrets(docs).collect()}
    assert got == {n: brute_secrets(t) for n, t in enumerate(texts)}
    assert secret_ledger.document_secrets(docs.limit(0)).count() == 0


def test_ledger_scans_a_text_once_for_each_rule_version(spark):
    path = scratch_path(spark, "ledger-test")
    first = spark.createDataFrame([("a", "token=abcdefghijklmnop"), ("b", "token=abcdefghijklmnop"), ("c", "x")], "path string, text string")
    later = first.union(spark.createDataFrame([("d", "x"), ("a", "new deadbeefdeadbeef00")], first.schema))

    def blobs(version):
        return secret_ledger.read_ledger(spark, path).filter(F.col("rule_version") == version).count()

    secret_ledger.scan_versions(first, path)
    assert blobs("1") == 2
    assert secret_ledger.unseen_blobs(later, secret_ledger.read_ledger(spark, path), "1").count() == 1
    secret_ledger.scan_versions(later, path)
    secret_ledger.scan_versions(later, path)
    assert blobs("1") == 3
    found = secret_ledger.findings(later, path, ["path"]).select("path", F.size("spans").alias("n"))
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("a", 1), ("b", 1), ("c", 0), ("d", 0)]
    secret_ledger.scan_versions(later, path, secret_ledger.BASE_RULES[:1], "2")
    assert blobs("2") == 3


def test_redaction_keeps_all_else(spark):
    rows = [(1, "é token = 'abcdefghijklmnop' end", 33, "k"), (2, None, 0, None), (3, "plain", 5, "k"), (3, "plain", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = secret_ledger.redact(docs)
    assert got.columns == docs.columns
    clean = "é [secret]' end"
    assert sorted(map(tuple, got.collect())) == [(1, clean, len(clean), "k"), (2, None, 0, None), (3, "plain", 5, "k"), (3, "plain", 5, "k")]


# --- quality


def test_redaction_moves_a_text_once_to_its_spans(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('password=hunter2hunter2 ', id) AS text")
    got = secret_ledger.redact(docs)
    node = got._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    sent = node.children().head().output()
    assert {sent.apply(k).name() for k in range(sent.size())} == {"doc", "blob"}
    assert {r.text.split()[0] for r in got.collect()} == {"[secret]"}


def test_redaction_masks_whole_private_keys(spark):
    body = "\n".join("QUJD+/" * 10 for _ in range(3000))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = [f"a {begin}\n{body}\n{end} b", f"a {begin}\n{headers}QUJD\n{end} b {begin}\nQUJD\n{end}", f"a {begin} no more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in secret_ledger.redact(docs).orderBy("doc_id").collect()]
    assert got == ["a [secret] b", "a [secret] b [secret]", "a [secret] no more"]


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(covered), len(set(words)), sum(text.count(c) for c in "#*$%&|<>"),
        text.count("!"), len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text)), len(lines) - len(set(lines)),
    )


def test_statistics_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 50, "x\n" * 9, "x  \n x\n\n x", "a b　c"]
    texts += ["".join(rng.choices(["a", "b", " ", " ", "\n", "#", "!", "Z", "9", "é"], k=rng.randint(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counted = docs.select("doc_id", text_stats.text_stats(F.col("text")).alias("s"))
    got = {r[0]: tuple(r)[1:] for r in counted.select("doc_id", *text_stats.flat_stats("s")).collect()}
    assert got == {n: brute_stats(t) for n, t in enumerate(texts)}


def test_rules_find_the_planted_thresholds(spark):
    rows = [(n, float(n % 10), float(n % 7), None if n % 50 == 49 else (n % 10 >= 7 and n % 7 < 3)) for n in range(2100)]
    labelled = spark.createDataFrame(rows, "id long, a double, b double, bad boolean")
    rules = quality_rules.learn_rules(labelled, ["a", "b"], "bad", "id")
    assert len(rules) == 1 and sorted(str(rules[0]).split(" and ")) == ["a >= 7", "b < 3"]
    caught = labelled.select("bad", (quality_rules.verdict(rules).isNotNull()).alias("hit")).filter("bad IS NOT NULL")
    assert caught.filter("bad <> hit").count() == 0
    assert quality_rules.learn_rules(labelled.limit(0), ["a", "b"], "bad", "id") == []
    assert quality_rules.learn_rules(labelled.filter("NOT bad"), ["a", "b"], "bad", "id") == []


def test_keep_good_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("kept", F.lit("mine"))
    docs = docs.withColumn("rule", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = labels.union(labels).union(spark.createDataFrame([(10**9, 0, 0), (None, None, None)], labels.schema))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    rated = quality_rules.rate_documents(docs, labels)
    ids = {r.doc_id for r in rated.filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").join(rated, "doc_id")
    assert good.filter("NOT kept AND NOT base_failed").count() <= 0.01 * good.count()
    bad = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 0").join(rated, "doc_id")
    assert bad.filter("NOT kept").count() >= 0.9 * bad.count()
    assert quality_rules.keep_good(docs.limit(0), labels.limit(0)).count() == 0


# --- revisits


def canonical(url):
    bare = re.sub(r"(?is)^https?://", "", re.sub(r"(?s)#.*$", "", url))
    host, path, query = re.match(r"(?s)([^/?]*)([^?]*)(?:\?(.*))?$", bare).groups()
    host = re.sub(r":(80|443)$", "", re.sub(r"^www[0-9]*\.", "", host.lower()))
    kept = sorted(p for p in (query or "").split("&") if p and not re.match(revisits.TRACKING, p.lower()))
    return host + re.sub("/+$", "", path) + ("?" + "&".join(kept) if kept else "")


def brute_revisit(record, records):
    number, url, ts, _, headers, _ = record
    own = {k.lower(): v for k, v in (headers or {}).items()}
    if url is None or ts is None:
        return number, "no_response", None, None, own
    earlier = [r for r in records if r[3] and r[1] is not None and r[2] is not None and canonical(r[1]) == canonical(url) and r[2] < ts]
    if not earlier:
        return number, "no_response", None, None, own
    best = max(earlier, key=lambda r: (r[2], r[0]))
    stored = {k.lower(): v for k, v in (best[4] or {}).items()}
    tags = [re.sub("^W/", "", h["etag"]) if "etag" in h else None for h in (stored, own)]
    dates = [h.get("last-modified") for h in (stored, own)]
    agree = tags[0] == tags[1] if None not in tags else dates[0] == dates[1] if None not in dates else None
    if agree is None:
        return number, "unverified", best[0], None, own
    if not agree:
        return number, "mismatch", best[0], None, own
    merged = stored | {k: v for k, v in own.items() if k in revisits.PERMITTED}
    return number, "resolved", best[0], best[5], merged


def test_revisits_against_brute_force(spark):
    rng = random.Random(9)
    urls = [None, "http://a.org/x", "https://www.A.org/x/#f", "http://a.org/x?utm_source=q", "http://a.org:80/x?b=2&a=1",
            "https://a.org/x?a=1&b=2", "http://b.org", "https://www2.b.org/"]
    records = []
    for n in range(500):
        headers = {}
        if rng.random() < 0.7:
            headers["ETag"] = rng.choice(['"1"', 'W/"1"', '"2"'])
        if rng.random() < 0.5:
            headers["Last-Modified"] = rng.choice(["d1", "d2"])
        headers[rng.choice(["Date", "Content-Length", "Cache-Control"])] = str(n)
        ts = rng.randint(0, 60) if rng.random() < 0.97 else None
        full = rng.random() < 0.4
        records.append((n, rng.choice(urls), ts, full, headers if rng.random() < 0.95 else None, f"d{n}"))
    schema = "record_id long, url string, ts long, full boolean, headers map<string,string>, digest string"
    table = spark.createDataFrame(records, schema).withColumn("match", F.lit(1)).withColumn("slice", F.lit("x"))
    expected = sorted((brute_revisit(r, records) for r in records if not r[3]), key=lambda r: r[0])
    for slices in (1, 2, 7, 256):
        got = revisits.resolve_revisits(table, slices).collect()
        found = sorted(((r.record_id, r.outcome, r.refers_to, r.digest, r.headers) for r in got), key=lambda r: r[0])
        assert found == expected
    assert revisits.resolve_revisits(table.limit(0)).count() == 0
    none = table.withColumn("full", F.lit(None).cast("boolean"))
    assert revisits.resolve_revisits(none).count() == 0


def test_header_names_in_two_cases_are_one_field(spark):
    row = spark.range(1).select(revisits.plain_headers(F.create_map(F.lit("Vary"), F.lit("a"), F.lit("vary"), F.lit("b"))).alias("h"))
    assert row.first().h == {"vary": "a, b"}
