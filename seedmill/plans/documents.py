"""Queries on documents, pages and vectors: conversion, chunks, index, search."""

from pyspark.sql import functions as F

from seedmill.functions import sql
from seedmill.functions.slots import HashingEmbedder
from seedmill.functions.storage import scratch_path
from seedmill.operators import documents as dc
from seedmill.operators.retrieval import retrieve_topk
from seedmill.plans.registry import query
from seedmill.plans.tables import table, words_sql
from seedmill.sources import records, sinks, snapshots

CLEANED = r"""array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x:
  regexp_replace(regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), '^[ \t\r\n\f]+', ''), '[ \t\r\n\f]+$', '')),
  lambda x: x <> ''), chr(10))"""


@query(f"SELECT doc_id, {CLEANED} AS text FROM documents")
def clean_documents(spark, folder):
    return dc.clean_documents(table(spark, folder, "documents").select("doc_id", "text"))


def chunks_sql(size: int) -> str:
    return f"""WITH split AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w), {size})) AS s FROM split)
SELECT doc_id, s // {size} AS chunk, len(w[s + 1 : s + {size}]) AS n_words,
       md5(array_to_string(w[s + 1 : s + {size}], ' ')) AS content FROM starts"""


@query(chunks_sql(1000))
def chunk_by_words(spark, folder):
    chunks = dc.chunk_by_words(table(spark, folder, "documents").select("doc_id", "text"))
    return chunks.select(
        "doc_id", F.col("chunk").cast("long"), F.col("n_words").cast("long"), F.md5("content").alias("content")
    )


@query(chunks_sql(100))
def chunk_by_100_words(spark, folder):
    chunks = dc.chunk_by_words(table(spark, folder, "documents").select("doc_id", "text"), 100)
    return chunks.select(
        "doc_id", F.col("chunk").cast("long"), F.col("n_words").cast("long"), F.md5("content").alias("content")
    )


@query(chunks_sql(100))
def chunk_in_sql(spark, folder):
    sql.register(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spark.sql(
        """SELECT doc_id, CAST(chunk AS LONG) AS chunk, CAST(size(words_of(content)) AS LONG) AS n_words,
                  md5(content) AS content
           FROM (SELECT doc_id, chunks_of(text, 100) AS parts FROM {docs})
           LATERAL VIEW OUTER posexplode(parts) AS chunk, content
           WHERE chunk IS NOT NULL""",
        docs=docs,
    )


def _html_sql() -> str:
    """The rule for the markup that the table has: no quoted ``>``, no tables, few named characters."""
    text = "html"
    for tag in ("script", "style", "head", "nav", "footer"):
        text = f"regexp_replace({text}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', '', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"
    text = f"regexp_replace({text}, '(?i)<h[1-6](\\s[^>]*)?>', chr(10) || chr(1), 'g')"
    text = f"regexp_replace({text}, '(?i)</h[1-6]>', chr(10), 'g')"
    text = f"regexp_replace({text}, '(?i)</?(p|div|br|li|ul|ol|section|article|blockquote|pre)(\\s[^>]*)?/?>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    for name, character in (("nbsp", " "), ("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{character}')"
    return text


_STRIP = r"regexp_replace(regexp_replace(x, '^[ \t\r\n\f]+', ''), '[ \t\r\n\f]+$', '')"
CONVERTED = f"""WITH lines AS (
  SELECT page_id, html, list_filter(list_transform(string_split({_html_sql()}, chr(10)), lambda x: {_STRIP}),
         lambda x: x <> '' AND x <> chr(1)) AS lines FROM pages),
converted AS (
  SELECT page_id, CASE WHEN len(lines) = 0 OR NOT regexp_matches(html, '(?i)<[a-z]') THEN 'failure'
                       WHEN NOT regexp_matches(html, '(?i)</html>') THEN 'partial' ELSE 'success' END AS status,
         lines FROM lines)
"""
SHOWN = """array_to_string(list_transform(lines, lambda x:
  CASE WHEN starts_with(x, chr(1)) THEN 'section_header: ' || replace(x, chr(1), '') ELSE 'text: ' || x END), chr(10))"""


def converted(spark, folder):
    return dc.convert_documents(table(spark, folder, "pages"))


def _shown(items):
    return F.array_join(F.transform(items, lambda i: F.concat(i["label"], F.lit(": "), i["text"])), "\n")


@query(CONVERTED + f"SELECT page_id, status, len(lines) AS n_items, {SHOWN} AS shown FROM converted")
def convert_documents(spark, folder):
    return converted(spark, folder).select(
        "page_id", "status", F.size("items").cast("long").alias("n_items"), _shown(F.col("items")).alias("shown")
    )


@query(
    CONVERTED
    + """SELECT count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'partial') AS partial,
  count(*) FILTER (WHERE status = 'failure') AS failure FROM converted"""
)
def conversion_report(spark, folder):
    return dc.conversion_report(converted(spark, folder))


@query(CONVERTED + f"SELECT page_id, {SHOWN} AS shown FROM converted WHERE status = 'success'")
def successful_conversions(spark, folder):
    return dc.successful_conversions(converted(spark, folder)).select("page_id", _shown(F.col("items")).alias("shown"))


@query(CONVERTED + f"SELECT printf('page-%d', page_id) AS doc_stem, {SHOWN} AS shown FROM converted WHERE status = 'success'")
def write_converted(spark, folder):
    path = scratch_path(spark, "converted")
    rows = converted(spark, folder).select(
        F.format_string("page-%d", F.col("page_id")).alias("doc_stem"), "items", "status"
    )
    sinks.write_converted(rows, path)
    stored = spark.read.schema("doc_stem string, items array<struct<label: string, text: string>>").json(path)
    return stored.select("doc_stem", _shown(F.col("items")).alias("shown"))


@query(
    CONVERTED
    + f"""SELECT printf('page-%d.html', page_id) AS filename, (10000000000000000000 + page_id)::VARCHAR AS binary_hash,
  {SHOWN} AS shown FROM converted"""
)
def parse_converted_docs(spark, folder):
    """Converted pages as document JSON in the two layouts, read back by the one parser."""
    name = F.format_string("page-%d.html", F.col("page_id"))
    number = (F.col("page_id").cast("decimal(20,0)") + F.lit("10000000000000000000").cast("decimal(20,0)")).cast(
        "decimal(20,0)"
    )
    rows = converted(spark, folder)
    content = F.to_json(
        F.struct(
            F.lit("Document").alias("schema_name"),
            F.struct(number.alias("binary_hash"), name.alias("filename")).alias("origin"),
            F.col("items").alias("texts"),
        )
    )
    docs = rows.select(name.alias("file_path"), content.alias("content"))
    return _documents_shown(docs)


@query(
    CONVERTED
    + f"""SELECT printf('page-%d.html', page_id) AS filename, (10000000000000000000 + page_id)::VARCHAR AS binary_hash,
  {SHOWN} AS shown FROM converted"""
)
def read_converted_docs(spark, folder):
    """The same documents as files, one each, found by the reader."""
    rows = converted(spark, folder)
    number = F.col("page_id").cast("decimal(20,0)") + F.lit("10000000000000000000").cast("decimal(20,0)")
    files = rows.select(
        F.lit("Document").alias("schema_name"),
        F.struct(
            number.cast("decimal(20,0)").alias("binary_hash"),
            F.format_string("page-%d.html", F.col("page_id")).alias("filename"),
        ).alias("origin"),
        F.col("items").alias("texts"),
    )
    path = scratch_path(spark, "converted-docs")
    files.write.option("maxRecordsPerFile", 1).json(path)
    return _documents_shown(records.read_converted_docs(spark, path))


def _documents_shown(docs):
    return records.parse_converted_docs(docs).select(
        "origin.filename", F.col("origin.binary_hash").cast("string").alias("binary_hash"), _shown(F.col("items")).alias("shown")
    )


# Sections start with heading lines; a heading is repeated in front of each of its chunks.
PAGE_CHUNKS = (
    CONVERTED
    + f"""
, marked AS (
  SELECT page_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM converted),
placed AS (
  SELECT *, starts_with(line, chr(1)) AS is_head, min(pos) OVER (PARTITION BY page_id) AS first FROM marked),
numbered AS (
  SELECT *, sum(CASE WHEN is_head OR pos = first THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS section
  FROM placed),
sections AS (
  SELECT page_id, section, coalesce(max(replace(line, chr(1), '')) FILTER (WHERE is_head), '') AS heading,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_head), '') AS body
  FROM numbered GROUP BY page_id, section),
tokens AS (
  SELECT *, len(h) AS head, greatest(1, 150 - len(h)) AS room FROM (
    SELECT *, {words_sql('body')} AS w, {words_sql('heading')} AS h FROM sections)),
starts AS (
  SELECT *, unnest(CASE WHEN len(w) = 0 AND head > 0 THEN [0] ELSE range(0, len(w), room) END) AS s FROM tokens),
chunks AS (
  SELECT page_id, section::INT AS section, (s // room)::INT AS chunk, (head + len(w[s + 1 : s + room]))::INT AS n_tokens, heading,
         concat_ws(chr(10), nullif(heading, ''), nullif(array_to_string(w[s + 1 : s + room], ' '), '')) AS content
  FROM starts)
"""
)


def page_chunks(spark, folder):
    return dc.split_documents(converted(spark, folder).select("page_id", "items"))


@query(PAGE_CHUNKS + "SELECT page_id, section, chunk, n_tokens, heading, md5(content) AS content FROM chunks")
def split_documents(spark, folder):
    return page_chunks(spark, folder).select(
        "page_id",
        "section",
        "chunk",
        "n_tokens",
        F.array_join("headings", "\n").alias("heading"),
        F.md5("content").alias("content"),
    )


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS id FROM documents GROUP BY sha256(text)")
def dedup_skip(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return dc.dedup_skip(dc.with_content_id(docs), "doc_id").select("doc_id", "id")


@query("SELECT count(DISTINCT text) AS documents FROM documents")
def index_count(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return dc.index_count(dc.dedup_skip(dc.with_content_id(docs), "doc_id"))


def _embedding_sql(source: str, key: str) -> str:
    return f"""slots AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 6))::INT % 64 AS slot
  FROM (SELECT {key}, unnest({words_sql('content')}) AS token FROM {source})),
counts AS (SELECT {key}, slot, count(*) AS n FROM slots GROUP BY {key}, slot)"""


@query(
    f"""WITH source AS (SELECT conv_id * 1000 + turn AS id, text AS content FROM conversations),
{_embedding_sql('source', 'id')}
SELECT id, 64::BIGINT AS dim, sum(n)::BIGINT AS total, string_agg(slot || ':' || n, ' ' ORDER BY slot) AS shown
FROM counts GROUP BY id"""
)
def embed_texts(spark, folder):
    source = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content")
    )
    slots = F.filter(
        F.transform("embedding", lambda v, i: F.struct(i.alias("slot"), v.cast("int").alias("n"))),
        lambda s: s["n"] > 0,
    )
    return dc.embed(source).select(
        "id",
        F.size("embedding").cast("long").alias("dim"),
        F.aggregate("embedding", F.lit(0).cast("long"), lambda a, v: a + v.cast("long")).alias("total"),
        F.array_join(
            F.transform(slots, lambda s: F.concat(s["slot"].cast("string"), F.lit(":"), s["n"].cast("string"))), " "
        ).alias("shown"),
    )


def label_centers(spark, folder):
    """One query per label: the mean of its vectors, so the whole table shapes the queries."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("embedding")
    )


CENTERS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
centers AS (
  SELECT label AS query_id, list(x ORDER BY pos) AS v
  FROM (SELECT label, pos, avg(x) AS x FROM cells GROUP BY label, pos) GROUP BY label)"""


def _topk_sql(function: str) -> str:
    return f"""WITH {CENTERS},
scored AS (SELECT q.query_id, x.vec_id AS id, {function}(q.v, x.v) AS score FROM centers q CROSS JOIN e x)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM scored QUALIFY rank <= 3"""


def _topk(spark, folder, metric, **limits):
    index = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieve_topk(label_centers(spark, folder), index, 3, metric, **limits).select(
        "query_id", "id", F.round("score", 6).alias("score"), "rank"
    )


@query(_topk_sql("list_dot_product"))
def retrieve_topk_dot(spark, folder):
    return _topk(spark, folder, "dot")


@query(_topk_sql("list_cosine_similarity"))
def retrieve_topk_cosine(spark, folder):
    return _topk(spark, folder, "cosine")


@query(_topk_sql("list_dot_product"))
def retrieve_topk_by_blocks(spark, folder):
    return _topk(spark, folder, "dot", block_queries=3, block_vectors=100)


# The index over documents: cleaned lines, headings by leading #, first copy of equal chunks kept.
INDEX = f"""WITH cleaned AS (SELECT doc_id, {CLEANED} AS text FROM documents),
lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x:
         regexp_replace(x, '^#{{1,6}} +', chr(1))), lambda x: x <> '' AND x <> chr(1)) AS lines FROM cleaned),
marked AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM lines),
numbered AS (
  SELECT *, starts_with(line, chr(1)) AS is_head,
         sum(CASE WHEN starts_with(line, chr(1)) OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS section
  FROM marked),
sections AS (
  SELECT doc_id, section, coalesce(max(replace(line, chr(1), '')) FILTER (WHERE is_head), '') AS heading,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_head), '') AS body
  FROM numbered GROUP BY doc_id, section),
tokens AS (
  SELECT *, len(h) AS head, greatest(1, 150 - len(h)) AS room FROM (
    SELECT *, {words_sql('body')} AS w, {words_sql('heading')} AS h FROM sections)),
starts AS (
  SELECT *, unnest(CASE WHEN len(w) = 0 AND head > 0 THEN [0] ELSE range(0, len(w), room) END) AS s FROM tokens),
chunks AS (
  SELECT doc_id, section, s // room AS chunk,
         concat_ws(chr(10), nullif(heading, ''), nullif(array_to_string(w[s + 1 : s + room], ' '), '')) AS content
  FROM starts),
index_rows AS (
  SELECT sha256(content) AS id, first(content ORDER BY doc_id, section, chunk) AS content,
         min(doc_id) AS doc_id FROM chunks GROUP BY sha256(content))
"""


def index_of(spark, folder):
    return dc.build_index(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    INDEX
    + f""", {_embedding_sql('index_rows', 'id')}
SELECT i.id, i.doc_id, sum(c.n)::BIGINT AS total, max(c.n)::BIGINT AS top
FROM index_rows i JOIN counts c USING (id) GROUP BY i.id, i.doc_id"""
)
def build_index(spark, folder):
    return index_of(spark, folder).select(
        "id",
        "doc_id",
        F.aggregate("embedding", F.lit(0).cast("long"), lambda a, v: a + v.cast("long")).alias("total"),
        F.array_max("embedding").cast("long").alias("top"),
    )


@query(INDEX + "SELECT true AS ok, count(*) AS documents FROM index_rows")
def write_index(spark, folder):
    path = scratch_path(spark, "index")
    ok, documents = sinks.write_index(index_of(spark, folder), path)
    stored = dc.index_count(spark.read.parquet(path))
    return stored.select(F.lit(ok & (documents >= 0)).alias("ok"), "documents")


@query(
    """SELECT sha256(text) AS id, coalesce(min(doc_id) FILTER (lang = 'en'), min(doc_id)) % 10 AS first FROM documents
GROUP BY text"""
)
def append_index(spark, folder):
    """An index over one language, then the documents of all appended: known ids are skipped."""
    path = scratch_path(spark, "index")
    docs = dc.with_content_id(
        table(spark, folder, "documents").select(
            "doc_id", (F.col("doc_id") % 10).alias("first"), "lang", F.col("text").alias("content")
        )
    )
    sinks.write_index(dc.dedup_skip(docs.filter("lang = 'en'"), "doc_id").drop("doc_id"), path)
    sinks.append_index(docs, path, "doc_id")
    return spark.read.parquet(path).select("id", "first")


@query(
    """WITH texts AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text),
english AS (SELECT text, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY text)
SELECT 1::BIGINT AS version, count(*) AS documents, sum(first)::BIGINT AS firsts FROM english
UNION ALL SELECT 2, count(*), sum(coalesce(e.first, t.first))::BIGINT FROM texts t LEFT JOIN english e USING (text)
UNION ALL SELECT 3, count(*), sum(first)::BIGINT FROM texts"""
)
def index_versions(spark, folder):
    """Three versions of an index, each read after all were written: one language, all appended, rebuilt from all."""
    uri = scratch_path(spark, "versions")
    docs = dc.with_content_id(
        table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("first"), "lang", F.col("text").alias("content"))
    )
    snapshots.rebuild(dc.dedup_skip(docs.filter("lang = 'en'"), "doc_id").drop("doc_id"), uri)
    snapshots.append(docs, uri, "doc_id")
    snapshots.rebuild(dc.dedup_skip(docs, "doc_id").drop("doc_id"), uri)
    found = [
        snapshots.read_version(spark, uri, n).agg(F.count(F.lit(1)).alias("documents"), F.sum("first").alias("firsts"))
        .select(F.lit(n).cast("long").alias("version"), "documents", F.col("firsts").cast("long").alias("firsts"))
        for n in snapshots.versions(spark, uri)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    f"""WITH texts AS (SELECT doc_id AS id, text AS content FROM documents),
questions AS (SELECT item_id AS query_id, text AS content FROM benchmark),
{_embedding_sql('texts', 'id')},
{_embedding_sql('questions', 'query_id').replace('slots', 'query_slots').replace('counts', 'query_counts')},
products AS (
  SELECT q.query_id, x.id, sum(q.n * x.n) AS dot FROM query_counts q JOIN counts x USING (slot) GROUP BY q.query_id, x.id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank
FROM products QUALIFY rank <= 3"""
)
def search_texts(spark, folder):
    """Every benchmark item searches all documents with the default embedder."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("content")
    )
    queries = dc.embed(asked, make_embedder=HashingEmbedder)
    return retrieve_topk(queries, dc.embed(texts), 3).select("query_id", "id", "rank")
