"""Inputs derived from the given tables, as DataFrames and as the matching SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def qna_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows. The join key is one turn, so it is even."""
    turns = table(spark, folder, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(replied, ["conv_id", "turn"])


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def judged_pairs(spark: SparkSession, folder: str, side: int) -> DataFrame:
    """Quality labels as judged scores per source; ``side`` 1 is the candidate and 0 the base."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    labels = table(spark, folder, "labels")
    return (
        docs.join(labels, "doc_id")
        .filter(F.floor(F.col("doc_id") / 20) % 2 == side)
        .select(
            F.col("doc_id").alias("question_id"),
            F.col("source").alias("qna_file"),
            "lang",
            F.col("quality").cast("double").alias("score"),
        )
    )


JUDGED = """judged AS (
  SELECT d.doc_id AS question_id, d.source AS qna_file, d.lang, l.quality::DOUBLE AS score,
         (d.doc_id // 20) % 2 AS side
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def job_changes(events: DataFrame, *extra: str) -> DataFrame:
    """Events as job status changes: the user is the job, the event type gives the status."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.format_string("job-%05d", F.col("user_id")).alias("uuid"),
        F.when(kind == "purchase", "Done").when(kind == "error", "Errored").otherwise("Running").alias("status"),
        F.when(F.col("user_id") % 2 == 0, "Generation").otherwise("Training").alias("type"),
        *extra,
    )


CHANGES = """changes AS (
  SELECT event_id, ts, printf('job-%05d', user_id) AS uuid,
         CASE event_type WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Errored' ELSE 'Running' END AS status,
         CASE WHEN user_id % 2 = 0 THEN 'Generation' ELSE 'Training' END AS type
  FROM events)"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per event: started at the event, ended ``value`` hours later when it has an end."""
    events = table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    length = (F.round(F.col("value") * 100).cast("long") * 36) * 1_000_000
    done = F.col("status") != "Running"
    return job_changes(events, "value").select(
        F.col("event_id").alias("added"),
        F.concat("uuid", F.lit("-"), F.col("event_id").cast("string")).alias("uuid"),
        F.col("event_id").alias("pid"),
        "type",
        "status",
        F.col("ts").cast("timestamp").alias("start_time"),
        F.when(done, F.timestamp_micros(micros + length)).alias("end_time"),
    )


JOBS = CHANGES + """, jobs AS (
  SELECT c.event_id AS added, c.uuid || '-' || c.event_id AS uuid, c.event_id AS pid, c.type, c.status,
         c.ts AS start_time, round(e.value * 100)::BIGINT * 36 AS seconds,
         CASE WHEN c.status <> 'Running'
              THEN make_timestamp(epoch_us(c.ts) + round(e.value * 100)::BIGINT * 36 * 1000000) END AS end_time
  FROM changes c JOIN events e USING (event_id))"""

NOW = "2024-03-01 00:00:00"


def dataset_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a file listing: one file per document in dated run folders."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    run = F.format_string("2025-01-%02d_120000", F.col("doc_id") % 28 + 1)
    stem = F.element_at(
        F.array(F.lit("train"), F.lit("test"), F.lit("messages"), F.lit("skills_train_msgs")),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    name = F.concat(
        stem,
        F.lit("_"),
        F.col("source"),
        F.format_string("_2024-10-%02dT08_34_48", F.col("doc_id") % 31 + 1),
        F.when(F.col("doc_id") % 7 == 0, ".txt").otherwise(".jsonl"),
    )
    inner = F.when(F.col("doc_id") % 5 == 0, F.lit("/node_datasets/")).otherwise(F.lit("/"))
    top = F.col("doc_id") % 11 == 0
    return docs.select(
        "doc_id",
        F.when(top, F.concat(F.col("doc_id").cast("string"), F.lit("_"), name))
        .otherwise(F.concat(run, inner, F.col("doc_id").cast("string"), F.lit("_"), name))
        .alias("unique_path"),
        F.when(top, name).otherwise(F.concat(run, inner, name)).alias("path"),
        F.timestamp_seconds(F.lit(1_735_000_000) + F.col("doc_id") * 61).alias("modificationTime"),
        (F.col("n_chars") * F.col("n_chars")).alias("length"),
    )


FILES = """files AS (
  SELECT doc_id, lang,
         CASE WHEN doc_id % 11 = 0 THEN name ELSE run || inner_dir || name END AS path,
         make_timestamp((1735000000 + doc_id * 61) * 1000000) AS modified,
         n_chars * n_chars AS length
  FROM (SELECT *, printf('2025-01-%02d_120000', doc_id % 28 + 1) AS run,
               CASE WHEN doc_id % 5 = 0 THEN '/node_datasets/' ELSE '/' END AS inner_dir,
               ['train', 'test', 'messages', 'skills_train_msgs'][doc_id % 4 + 1] || '_' || source
                 || printf('_2024-10-%02dT08_34_48', doc_id % 31 + 1)
                 || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.jsonl' END AS name
        FROM documents))"""


def words_sql(text: str) -> str:
    """The SQL form of the word split."""
    stripped = rf"regexp_replace(regexp_replace({text}, '^[ \t\r\n\f]+', ''), '[ \t\r\n\f]+$', '')"
    return (
        f"(CASE WHEN {stripped} = '' THEN []::VARCHAR[] "
        rf"ELSE string_split_regex({stripped}, '[ \t\r\n\f]+') END)"
    )


def human_size_sql(size: str, places: int) -> str:
    def scaled(power: int, unit: str) -> str:
        return f"printf('%.{places}f {unit}', {size} / {1024.0**power:.1f})"

    return (
        f"CASE WHEN {size} < 1024 THEN {scaled(0, 'B')} WHEN {size} < 1048576 THEN {scaled(1, 'KB')} "
        f"WHEN {size} < 1073741824 THEN {scaled(2, 'MB')} ELSE {scaled(3, 'GB')} END"
    )
