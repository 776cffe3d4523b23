"""Queries on file listings."""

from pyspark.sql import functions as F

from seedmill.functions import columns as c
from seedmill.operators import catalog as ct
from seedmill.plans.registry import query
from seedmill.plans.tables import FILES, dataset_files, human_size_sql, table
from seedmill.sources import files as fl

CATALOG = f"""WITH {FILES},
catalog AS (
  SELECT path AS dataset,
         CASE WHEN regexp_extract(split_part(path, '/', -1), '^(test|messages|train)_([\\w\\-\\.]+)_(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}_\\d{{2}}_\\d{{2}})', 2) = ''
              THEN 'General' ELSE regexp_extract(split_part(path, '/', -1), '^(test|messages|train)_([\\w\\-\\.]+)_(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}_\\d{{2}}_\\d{{2}})', 2) END AS model,
         strftime(modified, '%Y-%m-%d %H:%M:%S') AS created_at, {human_size_sql('length', 2)} AS size,
         length AS bytes, split_part(path, '/', 1) AS run_id
  FROM files WHERE path LIKE '%.jsonl')
"""


def catalog(spark, folder):
    return ct.dataset_catalog(dataset_files(spark, folder))


@query(CATALOG + "SELECT dataset, model, created_at, size, run_id FROM catalog")
def dataset_catalog(spark, folder):
    return catalog(spark, folder).drop("bytes")


@query(CATALOG + "SELECT * FROM catalog ORDER BY run_id DESC, dataset")
def dataset_listing(spark, folder):
    return ct.dataset_listing(catalog(spark, folder))


@query(
    CATALOG
    + """SELECT run_id, count(*) AS datasets, sum(bytes)::BIGINT AS bytes, max(created_at) AS last_created
FROM catalog GROUP BY run_id"""
)
def datasets_by_run(spark, folder):
    return ct.datasets_by_run(catalog(spark, folder))


SIZES = f"""WITH {FILES},
sizes AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS folder, sum(length)::BIGINT AS bytes, max(modified) AS modified,
         count(*) AS files FROM files GROUP BY 1)
"""


@query(SIZES + f"SELECT folder, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified, {human_size_sql('bytes', 1)} AS size, files FROM sizes")
def size_by_folder(spark, folder):
    return ct.with_formatted_size(fl.size_by_folder(dataset_files(spark, folder)))


def artifact_files(spark, folder):
    """Pages as converted artifacts in output folders; the newest folder decides."""
    p = F.col("page_id")
    return table(spark, folder, "pages").select(
        F.concat(
            F.lit("out"),
            (p % 17).cast("string"),
            F.when(p % 17 != 3, "/docling-artifacts/").otherwise("/"),
            p.cast("string"),
            F.lit(".json"),
        ).alias("path"),
        F.timestamp_seconds(F.lit(1_735_000_000) + p % 1009).alias("modificationTime"),
    )


@query(
    """WITH entries AS (
  SELECT 'out' || page_id % 17 AS entry, page_id % 17 <> 3 AS complete, 1735000000 + page_id % 1009 AS changed FROM pages)
SELECT CASE WHEN complete THEN entry || '/docling-artifacts' END AS folder
FROM entries ORDER BY changed DESC, entry DESC LIMIT 1"""
)
def latest_processed_folder(spark, folder):
    return fl.latest_processed_folder(artifact_files(spark, folder))


LATEST = f"""WITH {FILES},
named AS (
  SELECT path, modified, split_part(path, '/', -1) AS name, len(string_split(path, '/')) AS depth FROM files),
candidates AS (
  SELECT *, split_part(name, '_', 1) AS kind FROM named
  WHERE depth <= 2 AND split_part(name, '_', 1) IN ('train', 'test') AND name <> 'train_src1_2024-10-02T08_34_48.jsonl')
"""


@query(
    LATEST
    + """SELECT kind, arg_max(path, (depth, modified, path)) AS path, count(*) AS candidates
FROM candidates GROUP BY kind"""
)
def latest_train_test(spark, folder):
    return fl.latest_train_test(dataset_files(spark, folder), exclude=("train_src1_2024-10-02T08_34_48.jsonl",))


@query(
    LATEST
    + """SELECT arg_max(path, (modified, path)) AS path FROM named WHERE depth <= 2 AND starts_with(name, 'test_')"""
)
def newest_test_file(spark, folder):
    return fl.newest_test_file(dataset_files(spark, folder))


@query(f"WITH {FILES} SELECT doc_id, path FROM files WHERE path LIKE '%.jsonl'")
def only_jsonl(spark, folder):
    return ct.only_jsonl(dataset_files(spark, folder)).select("doc_id", "path")


@query(
    f"""WITH {FILES} SELECT doc_id, split_part(path, '/', 1) AS run_id, split_part(path, '/', -1) AS base_name,
  regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem,
  CASE WHEN path LIKE '%.txt' THEN '.txt' ELSE '.jsonl' END AS suffix,
  {human_size_sql('length', 1)} AS size, strftime(modified, '%Y-%m-%d_%H%M%S') AS run_time FROM files"""
)
def path_functions(spark, folder):
    path = F.col("path")
    return dataset_files(spark, folder).select(
        "doc_id",
        c.run_id_from_path(path).alias("run_id"),
        c.base_name(F.concat(path, F.lit("/"))).alias("base_name"),
        c.file_stem(path).alias("stem"),
        c.file_suffix(path).alias("suffix"),
        c.human_size(F.col("length"), 1).alias("size"),
        c.run_folder_time(F.col("modificationTime")).alias("run_time"),
    )


@query(
    """WITH places AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'docker://registry.example.org:5000/' || lang || '/' || source || ':v1'
    WHEN 1 THEN lang || '/' || source WHEN 2 THEN source || '-bucket' WHEN 3 THEN 'docker://' || source
    ELSE 'a b/' || source END AS location FROM documents)
SELECT doc_id, location, CASE doc_id % 5 WHEN 0 THEN 'oci' WHEN 1 THEN 'owner/model' WHEN 2 THEN 's3'
  ELSE 'unknown' END AS kind FROM places"""
)
def classify_repo(spark, folder):
    d = F.col("doc_id") % 5
    location = (
        F.when(d == 0, F.concat(F.lit("docker://registry.example.org:5000/"), "lang", F.lit("/"), "source", F.lit(":v1")))
        .when(d == 1, F.concat("lang", F.lit("/"), "source"))
        .when(d == 2, F.concat("source", F.lit("-bucket")))
        .when(d == 3, F.concat(F.lit("docker://"), "source"))
        .otherwise(F.concat(F.lit("a b/"), "source"))
    )
    docs = table(spark, folder, "documents").select("doc_id", location.alias("location"))
    return docs.withColumn("kind", c.classify_repo(F.col("location")))


@query(
    """SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+')) AS words FROM documents"""
)
def text_sizes(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", c.char_count(text).cast("long").alias("chars"), c.word_count(text).cast("long").alias("words")
    )
