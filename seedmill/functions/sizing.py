"""How many partitions a step gets."""

from pyspark.sql import SparkSession


def task_slots(spark: SparkSession) -> int:
    """Partitions for a step whose rows are few bytes and much work each."""
    return max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
