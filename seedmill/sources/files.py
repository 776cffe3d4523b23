"""File listings: which files are there, how old, how large."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.columns import base_name, folder_name


def relative_to(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``; the scheme in front of the path does not matter."""
    prefix = root.split(":", 1)[-1].rstrip("/") + "/"
    start = F.instr(path, prefix)
    return F.when(start == 0, path).otherwise(F.substring(path, start + len(prefix), F.length(path)))


def list_files(
    spark: SparkSession, root: str, recursive: bool = True, name_filter: str | None = None
) -> DataFrame:
    """``(path, modificationTime, length)``; the pruned scan never opens the files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(root).select("path", "modificationTime", "length")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Regular files directly in a folder, with their bytes."""
    found = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*")
    return found.filter(~F.contains(relative_to(F.col("path"), folder), F.lit("/")))


def latest_processed_folder(files: DataFrame) -> DataFrame:
    """The newest first-level entry, if it holds the artifacts folder; otherwise null.

    ``files`` is ``(path, modificationTime)`` relative to the output folder. An
    older folder with artifacts does not stand in for a newer one without.
    """
    entry = F.element_at(F.split("path", "/"), 1)
    has_artifacts = F.element_at(F.split("path", "/"), 2) == fixed.ARTIFACTS_FOLDER
    per_entry = files.groupBy(entry.alias("entry")).agg(
        F.max("modificationTime").alias("changed"),
        F.coalesce(F.bool_or(has_artifacts), F.lit(False)).alias("complete"),
    )
    newest = per_entry.agg(F.max_by(F.struct("entry", "complete"), F.struct("changed", "entry")).alias("top"))
    return newest.select(
        F.when(F.col("top.complete"), F.concat("top.entry", F.lit("/" + fixed.ARTIFACTS_FOLDER))).alias(
            "folder"
        )
    )


def latest_train_test(
    files: DataFrame, exclude: tuple[str, ...] = (), kinds: tuple[str, ...] = ("train", "test")
) -> DataFrame:
    """Newest file per kind, in run folders or at the top; ``exclude`` holds target file names.

    Files of run folders come before top-level ones, whatever their age.
    """
    name = base_name(F.col("path"))
    depth = F.size(F.split("path", "/"))
    kind = F.element_at(F.split(name, "_"), 1)
    candidates = files.filter(
        name.contains("_") & kind.isin(*kinds) & (depth <= 2) & ~name.isin(*exclude)
    )
    return candidates.groupBy(kind.alias("kind")).agg(
        F.max_by("path", F.struct(depth, "modificationTime", "path")).alias("path"),
        F.count(F.lit(1)).alias("candidates"),
    )


def newest_test_file(files: DataFrame) -> DataFrame:
    """The test-only variant: plain newest over run folders and top level."""
    name = base_name(F.col("path"))
    candidates = files.filter(name.startswith("test_") & (F.size(F.split("path", "/")) <= 2))
    return candidates.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def require_files(latest: DataFrame, kinds: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Raise when a kind has no file at all."""
    present = {row["kind"] for row in latest.select("kind").collect()}
    missing = [k for k in kinds if k not in present]
    if missing:
        raise FileNotFoundError(f"no {' or '.join(missing)} files found")
    return latest


def size_by_folder(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Bytes and newest time per folder; ``depth`` cuts the folder path to its first parts."""
    folder = folder_name(F.col("path"))
    if depth is not None:
        folder = F.array_join(F.slice(F.split(folder, "/"), 1, depth), "/")
    return files.groupBy(folder.alias("folder")).agg(
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("modified"),
        F.count(F.lit(1)).alias("files"),
    )
