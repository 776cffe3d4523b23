"""Conversion, chunks, ids and search against plain Python."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedmill.functions.slots import HashingEmbedder
from seedmill.operators import documents as dc
from seedmill.operators.retrieval import _upper_bounds, augmented_context, retrieve_topk, search_effort

PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><script>var a = "<p>x</p>";</script>
<!-- gone --><nav><a href="/">Home</a></nav><h1 class="x">One &amp; only</h1><p>First <b>bold</b> line.<br>Second&nbsp;line</p>
<h2>Two</h2><ul><li>a &lt; b</li></ul><footer>foot</footer></body></html>"""


def convert(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return dc.convert_documents(df)


def test_page_items(spark):
    row = convert(spark, PAGE).first()
    assert row["status"] == "success"
    assert [(i["label"], i["text"]) for i in row["items"]] == [
        ("section_header", "One & only"),
        ("text", "First bold line."),
        ("text", "Second line"),
        ("section_header", "Two"),
        ("text", "a < b"),
    ]


def lines_of(spark, body):
    return [i["text"] for i in convert(spark, f"<html>{body}</html>").first()["items"] or []]


@pytest.mark.parametrize("body, lines", [
    ("<table><tr><td>12</td><td>34</td></tr><TR class=x>\n<th>a</th> <th>b</th></TR></table>", ["12 | 34", "a | b"]),
    ("<table><tr><td>1<td>2<tr><td>3<td>4</table>", ["1 | 2", "3 | 4"]),
    ("<p title='a > b'>x<p title=\"c > 'd'\" id=1>y", ["x", "y"]),
    ("<p title=it's>x</p><p>y</p>", ["x", "y"]),
    ("<img alt='1 > 0' src=x/>seen <b data-x='>'>bold</b>", ["seen bold"]),
    ("<figure><img><figcaption>Cap</figcaption></figure>after", ["Cap", "after"]),
    ("<dl><dt>term<dd>meaning</dl><ul><li>one<li>two</ul>", ["term", "meaning", "one", "two"]),
    ("<p>a < b and c > d</p>", ["a < b and c > d"]),
    ("<script x='>'>no</script><pre>yes</pre>", ["yes"]),
    ("<p>" + "x" * 50_000 + "<a href='" + "y" * 50_000 + "'>z</a></p>", ["x" * 50_000 + "z"]),
])
def test_markup(spark, body, lines):
    assert lines_of(spark, body) == lines


def test_characters_by_name_and_number(spark):
    texts = [
        "&mdash;&eacute;&#8212;&#x1F600;&hellip;", "&amp;lt; &amp;amp; &lt;p&gt;", "x&nbsp;y&#160;z&#xa0;w", "AT&T &unknown; & &;",
        "&notin;&NotEqualTilde;&AMP;", "no references", "", "1 &lt 2",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(dc.named_characters(F.col("t"))).collect()]
    with_end = [t for t in texts[:-1]]
    assert got[:-1] == [html.unescape(t).replace("\u00a0", " ") for t in with_end] and got[-1] == "1 &lt 2"
    odd = spark.createDataFrame([("&#0; &#xD800; &#1114112; &#999999999;",), (None,)], "t string")
    assert [r[0] for r in odd.select(dc.named_characters(F.col("t"))).collect()] == ["&#0; &#xD800; &#1114112; &#999999999;", None]


def test_status_and_report(spark):
    df = convert(spark, PAGE, PAGE.replace("</html>", ""), "", "no markup", None, "<p></p>")
    assert [r["status"] for r in df.orderBy("page_id").collect()] == [
        "success", "partial", "failure", "failure", "failure", "failure",
    ]
    assert tuple(dc.conversion_report(df).first()) == (1, 1, 4)
    assert dc.successful_conversions(df).count() == 1
    with pytest.raises(RuntimeError, match="failed converting 4 of 6"):
        dc.fail_on_conversion_errors(dc.conversion_report(df))
    clean = dc.conversion_report(df.filter("page_id < 2"))
    assert tuple(dc.fail_on_conversion_errors(clean).first()) == (1, 1, 0)


def test_status_filter_converts_once(spark):
    plan = dc.successful_conversions(convert(spark, PAGE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1


def test_markdown(spark):
    df = spark.createDataFrame([("intro\n\n# Head\nbody  \n## Next\n#tag stays",)], "text string")
    row = dc.convert_documents(df, "text", kind="markdown").first()
    assert [(i["label"], i["text"]) for i in row["items"]] == [
        ("text", "intro"), ("section_header", "Head"), ("text", "body"),
        ("section_header", "Next"), ("text", "#tag stays"),
    ]


def test_clean(spark):
    got = spark.range(1).select(dc.clean_text(F.lit("  a \t b\r\n\n \n  c  "))).first()[0]
    assert got == "a b\nc"


@pytest.mark.parametrize("count,size", [(0, 5), (1, 5), (5, 5), (6, 5), (23, 5)])
def test_chunks_cover_the_text(spark, count, size):
    tokens = [f"w{i}" for i in range(count)]
    df = spark.createDataFrame([(1, " ".join(tokens))], "doc_id int, text string")
    got = dc.chunk_by_words(df, size).orderBy("chunk").collect()
    assert [r["content"].split() for r in got] == [tokens[i : i + size] for i in range(0, count, size)]


def items_frame(spark, *documents):
    data = [(i, [{"label": a, "text": b} for a, b in d] if d is not None else None) for i, d in enumerate(documents)]
    return spark.createDataFrame(data, "doc_id int, items array<struct<label:string,text:string>>")


def test_chunks_keep_headings_and_captions(spark):
    df = items_frame(
        spark,
        [("text", "before"), ("section_header", "H"), ("text", "a b c"), ("caption", "Fig 1"), ("text", "d e"),
         ("section_header", "Empty"), ("title", "T"), ("text", "z")],
    )
    got = dc.split_documents(df, max_tokens=3).orderBy("section", "chunk").collect()
    assert [(r["content"], r["headings"], r["captions"], r["n_tokens"]) for r in got] == [
        ("before", [], [], 1),
        ("H\na b", ["H"], ["Fig 1"], 3),
        ("H\nc d", ["H"], ["Fig 1"], 3),
        ("H\ne", ["H"], ["Fig 1"], 2),
        ("Empty", ["Empty"], [], 1),
        ("T\nz", ["T"], [], 2),
    ]


def test_missing_content_is_an_error(spark):
    df = items_frame(spark, None, [("text", "a")])
    with pytest.raises(Exception, match="has no content"):
        dc.split_documents(df).collect()
    assert dc.split_documents(df, on_error="skip").count() == 1


def test_plan_cuts_words_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    plan = dc.chunk_by_words(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_first_copy_stays(spark):
    data = [(i, "copy" if i % 3 else f"own {i}") for i in range(300)]
    df = dc.with_content_id(spark.createDataFrame(data, "n int, content string"))
    got = dc.dedup_skip(df, "n")
    assert got.columns == df.columns
    assert sorted(r["n"] for r in got.collect()) == sorted([1] + list(range(0, 300, 3)))


def test_id_depends_on_metadata(spark):
    df = spark.createDataFrame([("x", "m1"), ("x", "m2"), ("x", "m1")], "content string, meta string")
    assert dc.with_content_id(df).select("id").distinct().count() == 1
    assert dc.with_content_id(df, ("content", "meta")).select("id").distinct().count() == 2


def test_embedder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("b a a",)], "content string")
    got = [np.array(r["embedding"]) for r in dc.embed(df).collect()]
    assert got[0].sum() == 3 and got[1].sum() == 0 and got[2].sum() == 0
    assert (got[0] == got[3]).all()

    class Constant:
        def __call__(self, texts):
            return np.ones((len(texts), 10))

    assert dc.embed(df, make_embedder=Constant).first()["embedding"] == [1.0] * 10


def best(queries, index, k, metric):
    def scores(q, x):
        if metric == "cosine":
            return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        return x @ q

    found = []
    for number, q in enumerate(queries):
        s = scores(q, index)
        order = np.lexsort((np.arange(len(index)), -s))[:k]
        found += [(number, int(i), rank + 1) for rank, i in enumerate(order)]
    return sorted(found)


@pytest.mark.parametrize("metric", ["dot", "cosine"])
@pytest.mark.parametrize("limits", [{}, {"block_queries": 7, "block_vectors": 50}])
def test_topk_equals_brute_force(spark, metric, limits):
    """A third of the index are copies of one vector, so ties reach far beyond k."""
    random = np.random.default_rng(5)
    index = random.integers(-4, 5, (300, 8)).astype(float)
    index[::3] = index[0]
    queries = random.integers(-4, 5, (20, 8)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<double>")
    n = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "id int, embedding array<double>").repartition(6)
    got = retrieve_topk(q, n, 5, metric, **limits)
    if metric == "dot":
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == best(queries, index, 5, metric)
    else:
        want = {a: sorted(i for b, i, _ in best(queries, index, 5, metric) if b == a) for a in range(20)}
        scores = {(r["query_id"], r["rank"]): r["score"] for r in got.collect()}
        exact = index / np.linalg.norm(index, axis=1, keepdims=True)
        for a, ids in want.items():
            wanted = np.sort(exact[ids] @ queries[a] / np.linalg.norm(queries[a]))[::-1]
            assert np.allclose([scores[a, r] for r in range(1, 6)], wanted)


def test_blocks_that_cannot_reach_the_top_are_not_scored(spark):
    """Vectors in tight groups: a query scores its own group and little else, and still finds what brute force finds."""
    random = np.random.default_rng(11)
    centers = random.normal(size=(40, 16)) * 5
    index = np.repeat(centers, 50, axis=0) + random.normal(size=(2000, 16)) * 0.05
    queries = centers[::2]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<double>")
    n = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], "id int, embedding array<double>")
    got = retrieve_topk(q, n, 4, "cosine", block_vectors=32)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == best(queries, index, 4, "cosine")
    effort = search_effort(q, n, 4, "cosine", block_vectors=32).first()
    assert (effort["queries"], effort["vectors"]) == (20, 2000)
    assert 20 * 4 <= effort["pairs_scored"] < 20 * 2000 / 5


def test_bounds_are_never_too_low():
    random = np.random.default_rng(2)
    for _ in range(200):
        vectors, queries = random.normal(size=(9, 5)) * random.uniform(0, 9), random.normal(size=(7, 5))
        center = vectors.mean(axis=0)
        radius, longest = np.linalg.norm(vectors - center, axis=1).max(), np.linalg.norm(vectors, axis=1).max()
        bounds = np.concatenate([vectors.min(axis=0), vectors.max(axis=0), center, [radius, longest]])
        assert (_upper_bounds(queries, bounds[None, :])[:, 0] >= (queries @ vectors.T).max(axis=1)).all()


def test_fewer_vectors_than_k_and_empty_sides(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    q = one.withColumnRenamed("id", "query_id")
    assert retrieve_topk(q, one).count() == 1
    assert retrieve_topk(q.limit(0), one).count() == 0
    assert retrieve_topk(q, one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        retrieve_topk(q, one, metric="l2")


def test_text_ids(spark):
    index = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [0.5])], "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [2.0])], "query_id string, embedding array<double>")
    got = retrieve_topk(q, index, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 2.0), ("b", 2.0)]


def test_context_in_rank_order(spark):
    docs = spark.createDataFrame(
        [(1, "# Cats\ncats purr"), (2, "# Dogs\ndogs bark loud"), (3, "# Cats\ncats purr")], "doc_id int, text string"
    )
    index = dc.build_index(docs)
    assert index.count() == 2 and sorted(r["doc_id"] for r in index.collect()) == [1, 2]
    asked = spark.createDataFrame([(1, "dogs bark")], "query_id int, content string")
    hits = retrieve_topk(dc.embed(asked), index, 3)
    assert augmented_context(hits, index).first()["context"] == "Dogs\ndogs bark loud\nCats\ncats purr"


def test_equal_texts_equal_vectors():
    embedder = HashingEmbedder(16)
    assert (embedder(["x y"]) == embedder(["y  x"])).all()
