"""Readers for datasets, questions, jobs, sessions, tasks and converted documents."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedmill import fixed, schemas
from seedmill.functions.columns import file_stem
from seedmill.operators.catalog import dataset_catalog
from seedmill.sources.files import list_files, relative_to


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGE_SAMPLE).json(path)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEGACY_SAMPLE).json(path)


def read_inputs_targets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.INPUTS_TARGETS).json(path)
    return rows.withColumnsRenamed({"inputs": "user", "targets": "assistant"})


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question rows from ``.jsonl``; a folder, another suffix, bad JSON or a missing column is an error.

    ``response`` is part of the result only if some row of the file has it.
    """
    if not path.endswith(".jsonl"):
        raise ValueError(f"{path} should end with .jsonl")
    kept = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    if len(kept) != 1 or not kept[0]["path"].endswith(path.split(":", 1)[-1].lstrip("/")):
        raise ValueError(f"{path} is a directory, not a file of questions")
    rows = spark.read.schema(schemas.QUESTION).option("mode", "FAILFAST").json(path)
    empty = rows.agg(
        F.count_if(F.col("user_input").isNull() | F.col("reference").isNull()).alias("broken"),
        F.count("response").alias("responses"),
    ).first()
    if empty["broken"]:
        raise ValueError(f"{path}: user_input and reference are required in every row")
    return rows if empty["responses"] else rows.drop("response")


def converted_docs_glob(spark: SparkSession, folder: str) -> str:
    """The artifacts sub-folder when it exists, the folder itself otherwise."""
    base = folder.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{fixed.ARTIFACTS_FOLDER}")
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return f"{base}/{fixed.ARTIFACTS_FOLDER}/*.json" if exists else f"{base}/*.json"


def read_converted_docs(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_path, content)``, one row per converted document."""
    found = converted_docs_glob(spark, folder)
    # As a pattern each file would be a path that Spark lists by itself; a folder is listed at once.
    parent = spark._jvm.org.apache.hadoop.fs.Path(found.removesuffix("/*.json"))
    store = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [status.getPath() for status in store.globStatus(parent) or [] if status.isDirectory()]
    place = F.col("_metadata.file_path")
    if folders:
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        files = reader.text([path.toString() for path in folders], wholetext=True)
        # Folders below are listed too; only what lies directly in the folder counts.
        above = F.regexp_replace(place, "^[^/:]+:(//[^/]*)?|/[^/]*$", "")
        files = files.filter(above.isin([path.toUri().getRawPath() for path in folders]))
    if not folders or not files.select(place).take(1):
        files = spark.read.text(found, wholetext=True)
    return files.select(place.alias("file_path"), F.col("value").alias("content"))


def parse_converted_docs(docs: DataFrame) -> DataFrame:
    """Converted documents as labelled text items.

    The older layout is tried first, then the newer one; a document that fits
    neither has a null ``items`` and is an error to the splitter.
    """
    lenient = {"mode": "PERMISSIVE"}
    older = F.from_json("content", schemas.LEGACY_CONVERTED_DOCUMENT, lenient)
    newer = F.from_json("content", schemas.CONVERTED_DOCUMENT, lenient)
    parsed = docs.withColumn("_older", older).withColumn("_newer", newer)
    old_items = F.transform(
        F.col("_older.main-text"),
        lambda x: F.struct(
            F.when(F.contains(F.lower(x["type"]), F.lit("subtitle")), F.lit("section_header"))
            .otherwise(x["type"])
            .alias("label"),
            x["text"].alias("text"),
        ),
    )
    from_older = F.col("_older.main-text").isNotNull()
    return parsed.select(
        "file_path",
        F.when(from_older, old_items).otherwise(F.col("_newer.texts")).alias("items"),
        F.struct(
            F.col("_newer.origin.mimetype").alias("mimetype"),
            F.col("_newer.origin.binary_hash").alias("binary_hash"),
            F.coalesce("_newer.origin.filename", "_older.file-info.filename").alias("filename"),
        ).alias("origin"),
        file_stem(F.col("file_path")).alias("doc_stem"),
    )


def parse_job_registry(rows: DataFrame, value: str = "value") -> DataFrame:
    """A JSON object keyed by job id, to one row per job in the order of the file."""
    entries = F.map_entries(F.from_json(value, T.MapType(T.StringType(), schemas.JOB)))
    job = rows.select(F.posexplode(entries).alias("added", "entry"))
    return job.select(
        F.col("added").cast("long").alias("added"),
        F.col("entry.key").alias("uuid"),
        "entry.value.pid",
        "entry.value.type",
        "entry.value.log_file",
        "entry.value.children_pids",
        F.to_timestamp("entry.value.start_time").alias("start_time"),
        "entry.value.status",
        F.to_timestamp("entry.value.end_time").alias("end_time"),
    )


def read_job_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_job_registry(spark.read.text(path, wholetext=True))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """Saved sessions as rows ``(session_id, turn, role, content)``.

    Files are JSON lines of whole sessions, below a folder ``session_lines=...`` as
    ``write_session`` makes it, or hold one session each, a JSON array of messages. Such
    a session is named by its folder ``session_id=...`` or by its file.
    """
    def decoded(name):
        return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))

    # The path is given as a URI, and the name of a partition folder is escaped in it once more.
    place = F.col("_metadata.file_path")
    named = decoded(decoded(F.regexp_extract(place, "session_id=([^/]*)/[^/]*$", 1)))
    in_lines = F.contains(place, F.lit(f"/{fixed.SESSION_LINES}="))
    reader = spark.read.option("recursiveFileLookup", "true")
    whole = reader.text(path, wholetext=True).filter(~in_lines).select(
        F.when(F.contains(place, F.lit("session_id=")), named).otherwise(file_stem(place)).alias("session_id"),
        F.from_json("value", T.ArrayType(schemas.MESSAGE)).alias("messages"),
    )
    line = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("messages", T.ArrayType(schemas.MESSAGE))])
    lines = reader.schema(line).json(path).filter(in_lines).select("session_id", "messages")
    return whole.unionByName(lines).select("session_id", F.posexplode("messages").alias("turn", "m")).select(
        "session_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content"
    )


TASK = "path string, task string, include string, group_name string, data_file string, template string"


def parse_task_files(files: DataFrame) -> DataFrame:
    """Multiple-choice task definitions; settings a file lacks come from the file it includes."""

    def parse(batches: Iterable[pa.RecordBatch]):
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(
                batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True
            ):
                body = yaml.safe_load(text) or {}
                data = (body.get("dataset_kwargs") or {}).get("data_files") or {}
                rows.append(
                    {
                        "path": path,
                        "task": body.get("task"),
                        "include": body.get("include"),
                        "group_name": body.get("group"),
                        "data_file": data.get("test"),
                        "template": body.get("doc_to_text"),
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema([(n.split()[0], pa.string()) for n in TASK.split(", ")]),
            )

    own = files.select("path", "content").mapInArrow(parse, TASK)
    base = own.select(
        F.col("path").alias("include_path"),
        F.col("group_name").alias("base_group"),
        F.col("data_file").alias("base_file"),
        F.col("template").alias("base_template"),
    )
    folder = F.regexp_replace("path", "[^/]*$", "")
    resolved = own.withColumn("include_path", F.concat(folder, "include")).join(
        base, "include_path", "left"
    )
    return resolved.select(
        "path",
        "task",
        "include_path",
        F.coalesce("group_name", "base_group").alias("group_name"),
        F.coalesce("data_file", "base_file").alias("data_file"),
        F.coalesce("template", "base_template").alias("template"),
    )


def _small_text(spark: SparkSession, path: str) -> str:
    """One small file by way of the Hadoop file system, whatever its name starts with."""
    jvm = spark._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    stream = location.getFileSystem(spark._jsc.hadoopConfiguration()).open(location)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_mc_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of a folder, resolved against their templates.

    A Spark scan passes over names that start with an underscore, which is how
    templates are named. The few templates that tasks include are read one by one.
    """
    found = spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    named = parse_task_files(found).filter(F.col("include_path").isNotNull())
    wanted = [r["include_path"] for r in named.select("include_path").distinct().collect()]
    templates = [(path, _small_text(spark, path)) for path in wanted]
    every = found.unionByName(spark.createDataFrame(templates, found.schema)) if templates else found
    return parse_task_files(every).filter(F.col("data_file").isNotNull())


def read_mc_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHOICE_QUESTION).json(path)


def list_datasets(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Catalog of every ``.jsonl`` below the folders; a missing folder is an error of the scan."""
    parts = [
        dataset_catalog(
            files.withColumn("path", relative_to(F.col("path"), folder))
        )
        for folder in folders
        for files in [list_files(spark, folder, name_filter="*.jsonl")]
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
