"""Queries that write files from the given tables and read them with the package's readers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedmill.functions.storage import scratch_path
from seedmill.plans.registry import query
from seedmill.plans.tables import table
from seedmill.sources import files as fl
from seedmill.sources import records, sinks


@query("SELECT md5(text) AS digest FROM documents")
def read_documents(spark, folder):
    """Files of whole texts, one JSON line for each document, found and opened as documents."""
    path = scratch_path(spark, "files")
    lines = table(spark, folder, "documents").select(F.to_json(F.struct("text")).alias("value"))
    # A file is read as one value, so files are kept small.
    lines.write.option("maxRecordsPerFile", 1000).text(path)
    found = fl.read_documents(spark, path).select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    return found.filter("line <> ''").select(F.md5(F.from_json("line", "text string")["text"]).alias("digest"))


@query("SELECT text AS user_input, 'item ' || item_id AS reference FROM benchmark")
def read_questions(spark, folder):
    """The benchmark as files of questions, one for each task that writes; the reader takes one at a time."""
    path = scratch_path(spark, "questions")
    rows = table(spark, folder, "benchmark").select(
        F.col("text").alias("user_input"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("reference")
    )
    rows.write.json(path)
    location = spark._jvm.org.apache.hadoop.fs.Path
    store = location(path).getFileSystem(spark._jsc.hadoopConfiguration())
    read = []
    for n, part in enumerate(s.getPath() for s in store.globStatus(location(f"{path}/part-*"))):
        named = f"{path}-{n}.jsonl"
        store.rename(part, location(named))
        read.append(records.read_questions(spark, named))
    return reduce(DataFrame.unionByName, read)


@query(
    """SELECT 'chat ' || conv_id AS session_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations"""
)
def read_session(spark, folder):
    """Saved sessions, whose names hold a blank, as they are loaded again."""
    path = scratch_path(spark, "sessions")
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
    )
    sinks.write_session(turns, path)
    return records.read_session(spark, path)
