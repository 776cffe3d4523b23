"""Dataset listings: what was written, by which run, for which model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedmill.functions.columns import (
    base_name,
    human_size,
    listing_time,
    model_name_from_file,
    run_id_from_path,
)


def only_jsonl(files: DataFrame) -> DataFrame:
    return files.filter(F.endswith("path", F.lit(".jsonl")))


def dataset_catalog(files: DataFrame) -> DataFrame:
    """``(path, modificationTime, length)`` relative to a data folder, as listing rows."""
    return only_jsonl(files).select(
        F.col("path").alias("dataset"),
        model_name_from_file(base_name(F.col("path"))).alias("model"),
        listing_time(F.col("modificationTime")).alias("created_at"),
        human_size(F.col("length")).alias("size"),
        F.col("length").alias("bytes"),
        run_id_from_path(F.col("path")).alias("run_id"),
    )


def datasets_by_run(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("bytes").alias("bytes"),
        F.max("created_at").alias("last_created"),
    )


def dataset_listing(catalog: DataFrame) -> DataFrame:
    """Newest run name first, dataset names ascending inside a run."""
    return catalog.orderBy(F.desc("run_id"), F.asc("dataset"))


def with_formatted_size(sizes: DataFrame) -> DataFrame:
    """Folder listing text: one decimal and a local time string."""
    return sizes.select(
        "folder",
        listing_time(F.col("modified")).alias("modified"),
        human_size(F.col("bytes"), places=1).alias("size"),
        "files",
    )
