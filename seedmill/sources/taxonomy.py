"""Seed files: discovery on a file system and parsing of their text."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedmill import schemas
from seedmill.functions.columns import is_seed_file, seed_name_warning
from seedmill.functions.sizing import task_slots
from seedmill.sources.files import relative_to

_TEXT_FIELDS = ("created_by", "domain", "task_description", "document_outline")


def taxonomy_files(files: DataFrame, path: Column | None = None) -> DataFrame:
    """Keep seed files; near misses in the name are kept apart by ``warn_name``."""
    where = F.col("path") if path is None else path
    return files.withColumn("path", where).withColumn(
        "is_seed_file", is_seed_file(F.col("path"))
    ).withColumn("warn_name", seed_name_warning(F.col("path")))


def read_taxonomy(spark: SparkSession, root: str) -> DataFrame:
    """One parsed row per seed file below ``root``; paths are relative to it."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "[qQ][nN][aA].[yY]*")
        .load(root)
    )
    content = taxonomy_files(found, relative_to(F.col("path"), root)).filter("is_seed_file")
    return parse_seed_files(content.select("path", F.col("content").cast("string").alias("content")))


def _text(value, name: str, mistyped: list[str]) -> str | None:
    if value is None or isinstance(value, str):
        return value
    mistyped.append(name)
    return str(value)


def _pair(item, where: str, mistyped: list[str]) -> dict:
    item = item if isinstance(item, dict) else {}
    return {
        name: _text(item.get(name), f"{where}.{name}", mistyped) for name in ("question", "answer")
    }


def _example(item, index: int, mistyped: list[str]) -> dict:
    where = f"seed_examples[{index}]"
    nested = item.get("questions_and_answers") if isinstance(item, dict) else None
    return {
        "context": _text(
            item.get("context") if isinstance(item, dict) else None, f"{where}.context", mistyped
        ),
        **_pair(item, where, mistyped),
        "questions_and_answers": [
            _pair(p, f"{where}.questions_and_answers[{j}]", mistyped) for j, p in enumerate(nested)
        ]
        if isinstance(nested, list)
        else None,
    }


def _document(value) -> dict | None:
    if not isinstance(value, dict):
        return None
    patterns = value.get("patterns")
    return {
        "repo": None if value.get("repo") is None else str(value["repo"]),
        "commit": None if value.get("commit") is None else str(value["commit"]),
        "patterns": [str(p) for p in patterns] if isinstance(patterns, list) else None,
    }


def _record(path: str, content: str, load) -> dict:
    row = {field.name: None for field in schemas.SEED_FILE.fields} | {"path": path}
    mistyped: list[str] = []
    try:
        body = load(content)
    except Exception as error:  # any broken file becomes a row with its reason
        return row | {"parse_error": str(error).splitlines()[0], "mistyped": mistyped}
    if not isinstance(body, dict):
        return row | {"parse_error": "not a mapping", "mistyped": mistyped}
    examples = body.get("seed_examples")
    version = body.get("version")
    return row | {
        **{name: _text(body.get(name), name, mistyped) for name in _TEXT_FIELDS},
        "version": version if isinstance(version, int) else None,
        "seed_examples": [_example(e, i, mistyped) for i, e in enumerate(examples)]
        if isinstance(examples, list)
        else None,
        "document": _document(body.get("document")),
        "mistyped": mistyped,
    }


def parse_seed_files(files: DataFrame) -> DataFrame:
    """``(path, content)`` text rows to the seed file layout; bad YAML becomes ``parse_error``.

    Seed files are small and slow to parse, so they go to all task slots first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schemas.SEED_FILE)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def load(text: str):
            return yaml.load(text, Loader=loader)

        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            rows = [_record(p, c or "", load) for p, c in zip(paths, contents, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    spread_out = files.select("path", "content").repartition(task_slots(files.sparkSession), "path")
    return spread_out.mapInArrow(parse, schemas.SEED_FILE)
