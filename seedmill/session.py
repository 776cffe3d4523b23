"""Session settings for local work, and the package for Python workers."""

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "seedmill") -> SparkSession:
    memory = os.environ.get("SEEDMILL_DRIVER_MEMORY", "12g")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.minPartitionNum", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` would at submission. Once per application."""
    context = spark.sparkContext
    if "seedmill.zip" in context._python_includes:
        return
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="seedmill-"), "seedmill"), "zip", root, "seedmill"
    )
    context.addPyFile(archive)
