"""An index as versions: readers keep theirs while it is rebuilt, and writers at once do not lose or double rows.

``<uri>/data`` holds folders of rows that are written once and never changed,
``<uri>/versions/<number>`` the names of the folders that make up a version. A
version appears by one rename of a staged folder, so it is there whole or not at
all. Where the number is taken already, the rename puts the staged folder inside
the winner's (its name begins with ``_``, readers pass over it); the loser finds
it there, takes it away and goes on from the winner's version.

The file system must rename folders atomically, as HDFS and local ones do.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from seedmill.operators.documents import dedup_skip

MOST_TRIES = 100


def _files(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(uri).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, uri: str) -> list[int]:
    """The numbers of all versions, oldest first; none for an index that was never written."""
    path, files = _files(spark, uri)
    folder = path(f"{uri}/versions")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def _newest(spark: SparkSession, uri: str) -> int:
    return max(versions(spark, uri), default=0)


def folders_of(spark: SparkSession, uri: str, version: int) -> list[str]:
    """The data folders of a version, by name; version 0 has none."""
    if version == 0:
        return []
    return sorted(r["folder"] for r in spark.read.schema("folder string").json(f"{uri}/versions/{version}").collect())


def _read_folders(spark: SparkSession, uri: str, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{uri}/data/{name}" for name in folders])


def read_version(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default. Later writes do not change what the result gives."""
    version = _newest(spark, uri) if version is None else version
    if version not in versions(spark, uri):
        raise FileNotFoundError(f"no version {version} of the index {uri}")
    return _read_folders(spark, uri, folders_of(spark, uri, version))


def _write_rows(rows: DataFrame, uri: str) -> str:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{uri}/data/{name}")
    return name


def _remove(spark: SparkSession, uri: str, name: str) -> None:
    path, files = _files(spark, uri)
    files.delete(path(f"{uri}/{name}"), True)


def commit(spark: SparkSession, uri: str, folders: list[str], version: int) -> bool:
    """Make ``folders`` the version of this number; False, with nothing changed, where another writer has it."""
    path, files = _files(spark, uri)
    name = f"_staged-{uuid.uuid4().hex}"
    staged, target = path(f"{uri}/{name}"), path(f"{uri}/versions/{version}")
    spark.createDataFrame([(f,) for f in folders], "folder string").coalesce(1).write.json(staged.toString())
    files.mkdirs(target.getParent())
    moved = not files.exists(target) and files.rename(staged, target)
    if moved and not files.exists(path(target, name)):
        return True
    files.delete(path(target, name) if moved else staged, True)
    return False


def rebuild(chunks: DataFrame, uri: str) -> int:
    """A version of these rows only; its number. The rows before stay readable under their own."""
    spark = chunks.sparkSession
    folder = _write_rows(chunks, uri)
    for _ in range(MOST_TRIES):
        version = _newest(spark, uri) + 1
        if commit(spark, uri, [folder], version):
            return version
    raise TimeoutError(f"{MOST_TRIES} other writers of {uri} came first")


def append(chunks: DataFrame, uri: str, order: str) -> int:
    """A version with the chunks added whose id the newest one lacks; its number.

    Of several chunks with one id the first by ``order`` counts; ``order`` is not
    stored. A writer that another one overtook takes out the ids that came with
    the other and tries again on the version that is newest then. Null ids are
    no id: they count as one chunk within a call and are added by each.
    """
    spark = chunks.sparkSession
    columns = [c for c in chunks.columns if c != order]
    base = _newest(spark, uri)
    known = folders_of(spark, uri, base)
    fresh = dedup_skip(chunks, order).select(*columns)
    if known:
        fresh = fresh.join(_read_folders(spark, uri, known).select("id"), "id", "left_anti").select(*columns)
    folder = _write_rows(fresh, uri)
    for _ in range(MOST_TRIES):
        if commit(spark, uri, [*known, folder], base + 1):
            return base + 1
        base = _newest(spark, uri)
        now = folders_of(spark, uri, base)
        # A rebuild may have dropped folders this writer left rows out for, so all rows are looked at again.
        if set(known) <= set(now):
            written, others = _read_folders(spark, uri, [folder]), [name for name in now if name not in known]
        else:
            written, others = dedup_skip(chunks, order).select(*columns), now
        if others:
            written = written.join(_read_folders(spark, uri, others).select("id"), "id", "left_anti").select(*columns)
        replaced, folder, known = folder, _write_rows(written, uri), now
        _remove(spark, uri, f"data/{replaced}")
    raise TimeoutError(f"{MOST_TRIES} other writers of {uri} came first")


def forget(spark: SparkSession, uri: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` versions, and the data that only those had; the numbers removed.

    Data of no version, such as a running writer's, is left alone.
    """
    if keep < 1:
        raise ValueError("at least one version must be kept")
    numbers = versions(spark, uri)
    old, kept = numbers[:-keep], numbers[-keep:]
    needed = {name for version in kept for name in folders_of(spark, uri, version)}
    gone = {name for version in old for name in folders_of(spark, uri, version)} - needed
    for version in old:
        _remove(spark, uri, f"versions/{version}")
    for name in sorted(gone):
        _remove(spark, uri, f"data/{name}")
    return old
