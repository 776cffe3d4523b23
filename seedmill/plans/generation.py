"""Queries on generation requests and generated datasets."""

from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.slots import GENERATED as GENERATED_ROW
from seedmill.functions.storage import scratch_path
from seedmill.operators import generation as gn
from seedmill.operators import taxonomy as tx
from seedmill.operators.documents import chunk_by_words
from seedmill.plans.registry import query
from seedmill.plans.tables import table, words_sql
from seedmill.plans.taxonomy import EXPLODED, parsed
from seedmill.sources import sinks

REQUESTS = f"""WITH seeds AS ({EXPLODED}),
requests AS (
  SELECT s.*, r.repeat::INT AS repeat,
         md5(length(path) || ':' || path || '|' || length(example::VARCHAR) || ':' || example || '|1:0|'
             || length(r.repeat::VARCHAR) || ':' || r.repeat) AS request_id
  FROM seeds s CROSS JOIN (SELECT unnest(range(1, 31)) AS repeat) r)
"""


def seeds(spark, folder):
    return tx.explode_seeds(parsed(spark, folder))


def requests(spark, folder, batch_size=None):
    return gn.seed_requests(seeds(spark, folder), batch_size=batch_size)


@query(REQUESTS + "SELECT path, repeat, request_id FROM requests")
def seed_requests(spark, folder):
    return requests(spark, folder).select("path", "repeat", "request_id")


GENERATED = (
    REQUESTS
    + """, generated AS (
  SELECT request_id, path, '[' || repeat || '] ' || question AS question, '[' || repeat || '] ' || answer AS answer
  FROM requests)
"""
)


@query(GENERATED + "SELECT request_id, md5(question) AS question, md5(answer) AS answer FROM generated")
def generate(spark, folder):
    out = gn.generate(requests(spark, folder).select("request_id", "repeat", "question", "answer"))
    return out.select("request_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(REQUESTS + "SELECT request_id FROM requests WHERE repeat > 10")
def resume_requests(spark, folder):
    every = requests(spark, folder)
    return gn.resume_requests(every, every.filter("repeat <= 10")).select("request_id")


@query(GENERATED + "SELECT request_id, md5(question) AS question, md5(answer) AS answer FROM generated")
def generate_resumable(spark, folder):
    """A first run that stopped early, then a second one that adds what is missing."""
    path = scratch_path(spark, "generated")
    every = requests(spark, folder).select("request_id", "repeat", "question", "answer")
    gn.generate_resumable(every.filter("repeat <= 10"), path)
    out = gn.generate_resumable(every, path)
    return out.select("request_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


LEAF_CHUNKS = f"""WITH split AS (SELECT doc_id, lang AS leaf, {words_sql('text')} AS w FROM documents),
chunks AS (SELECT leaf, doc_id || '-' || unnest(range(0, (len(w) + 999) // 1000)) AS item FROM split),
items AS (
  SELECT leaf, 'chunk' AS origin, item FROM chunks
  UNION ALL SELECT leaf, 'pair', i::VARCHAR FROM (SELECT DISTINCT lang AS leaf FROM documents), range(0, 2) t(i))
SELECT leaf, origin, md5(length(leaf) || ':' || leaf || '|' || length(origin) || ':' || origin || '|'
         || length(item) || ':' || item || '|1:' || repeat) AS request_id, repeat::INT AS repeat,
       CASE origin WHEN 'pair' THEN 1 ELSE 2 END AS examples
FROM items CROSS JOIN (SELECT unnest(range(1, 4)) AS repeat)"""


@query(LEAF_CHUNKS)
def knowledge_requests(spark, folder):
    """Leaves are languages with two seed pairs each; every document chunk becomes requests of its leaf."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("leaf"), "text")
    chunks = chunk_by_words(docs).select(
        "leaf", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk").cast("string")).alias("chunk_id"), "content"
    )

    def pair(question: str):
        return F.struct(F.concat(F.lit(question), "leaf").alias("question"), F.col("leaf").alias("answer"))

    files = docs.select("leaf").distinct().withColumn(
        "examples", F.array(pair("Which language is "), pair("Name the language "))
    )
    out = gn.knowledge_requests(files, chunks, scale=3)
    return out.select("leaf", "origin", "request_id", "repeat", F.size("examples").alias("examples"))


TRAINING = (
    GENERATED
    + """, sides AS (
  SELECT request_id, CASE WHEN starts_with(path, 'knowledge/') THEN 'knowledge' ELSE 'skills' END AS kind,
         replace(regexp_replace(path, '/[^/]*$', ''), '/', '_') AS node,
         CASE WHEN ('0x' || substr(request_id, 1, 6))::INT % 100 < 10 THEN 'test' ELSE 'train' END AS side,
         3::BIGINT AS messages
  FROM generated)
"""
)


def training_messages(spark, folder):
    every = requests(spark, folder, fixed.GENERATOR_BATCH).select("request_id", "path", "repeat", "question", "answer")
    return gn.to_training_messages(gn.generate(every, schema=f"{GENERATED_ROW}, path string", dealt=True))


@query(TRAINING + "SELECT request_id, kind, node, side, messages FROM sides")
def to_training_messages(spark, folder):
    return training_messages(spark, folder).withColumn("messages", F.size("messages").cast("long"))


@query(TRAINING + "SELECT kind, node, count(*) AS rows FROM sides GROUP BY kind, node")
def write_run(spark, folder):
    path = scratch_path(spark, "runs")
    run = sinks.write_run(training_messages(spark, folder), path, kinds=True, compression="gzip")
    stored = spark.read.schema("request_id string, kind string, node string").json(run)
    return stored.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""WITH split AS (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) > 200 THEN array_to_string(w[1:200], ' ') ELSE text END) AS text FROM split"""
)
def limit_tokens(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return gn.limit_tokens(docs, 200, "text").withColumn("text", F.md5("text"))


@query(
    f"""WITH seeds AS ({EXPLODED}) SELECT path,
  sum(len({words_sql('question')}) + len({words_sql('answer')}))::BIGINT AS words,
  sum(len({words_sql('question')}) + len({words_sql('answer')})) > 1000 AS over_budget FROM seeds GROUP BY path"""
)
def seed_word_budget(spark, folder):
    return gn.seed_word_budget(seeds(spark, folder), 1000)
