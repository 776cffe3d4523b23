"""Queries on seed files, which are built from conversations, and on repository paths."""

from pyspark.sql import functions as F

from seedmill.functions.columns import is_seed_file, seed_name_warning
from seedmill.functions.storage import materialize
from seedmill.operators import taxonomy as tx
from seedmill.plans.registry import query
from seedmill.plans.tables import PAIRS, qna_pairs, table
from seedmill.sources.taxonomy import parse_seed_files

# Four conversations make a seed file. Every fifth one is knowledge with a document
# reference, every seventh lacks its author, every eleventh is not readable.
FILE_PATH = """CASE WHEN f % 5 = 0 THEN 'knowledge/topic' || f % 3 || '/leaf' || f || '/qna.yaml'
  ELSE 'compositional_skills/writing/leaf' || f || '/qna.yaml' END"""
SEEDS = f"""{PAIRS},
seed_pairs AS (SELECT *, conv_id // 4 AS f FROM pairs),
seed_files AS (
  SELECT f, {FILE_PATH} AS path, f % 5 = 0 AS knowledge, count(*) AS n FROM seed_pairs GROUP BY f)"""


def seed_path(number):
    text = number.cast("string")
    return F.when(
        number % 5 == 0,
        F.concat(F.lit("knowledge/topic"), (number % 3).cast("string"), F.lit("/leaf"), text, F.lit("/qna.yaml")),
    ).otherwise(F.concat(F.lit("compositional_skills/writing/leaf"), text, F.lit("/qna.yaml")))


def seed_texts(spark, folder):
    """``(path, content)``: the YAML text of each seed file (JSON is YAML).

    A file takes all pairs of four conversations.
    """
    pairs = qna_pairs(spark, folder).withColumn("f", F.floor(F.col("conv_id") / 4))
    grouped = pairs.groupBy("f").agg(
        F.array_sort(F.collect_list(F.struct("conv_id", "turn", "question", "answer"))).alias("pairs")
    )
    f = F.col("f")
    knowledge = f % 5 == 0
    flat = F.transform("pairs", lambda p: F.struct(p["question"].alias("question"), p["answer"].alias("answer")))
    nested = F.transform(
        "pairs",
        lambda p: F.struct(
            F.concat(F.lit("about "), p["question"]).alias("context"),
            F.array(F.struct(p["question"].alias("question"), p["answer"].alias("answer"))).alias(
                "questions_and_answers"
            ),
        ),
    )
    body = F.struct(
        F.lit(3).alias("version"),
        F.when(f % 7 != 0, F.lit("team")).alias("created_by"),
        F.when(knowledge, F.lit("facts")).alias("domain"),
        F.when(~knowledge, F.lit("to write")).alias("task_description"),
        F.when(knowledge, F.lit("outline")).alias("document_outline"),
        F.when(
            knowledge,
            F.struct(
                F.concat(F.lit("repo"), (f % 3).cast("string")).alias("repo"),
                F.lit("c0").alias("commit"),
                F.array(F.when(f % 2 == 0, F.lit("docs/*.md")).otherwise(F.lit("docs/[!0-8]*"))).alias("patterns"),
            ),
        ).alias("document"),
    )
    text = F.when(
        knowledge, F.to_json(F.struct(body.alias("b"), nested.alias("s")))
    ).otherwise(F.to_json(F.struct(body.alias("b"), flat.alias("s"))))
    # Lift the two halves to one mapping.
    content = F.regexp_replace(F.regexp_replace(text, r'^\{"b":\{', "{"), r'\},"s":\[', ',"seed_examples":[')
    broken = F.when(f % 11 == 0, F.concat(content, F.lit("]"))).otherwise(content)
    return grouped.select(seed_path(f).alias("path"), broken.alias("content"))


def parsed(spark, folder):
    return parse_seed_files(seed_texts(spark, folder))


@query(
    f"""WITH {SEEDS} SELECT path, CASE WHEN f % 11 <> 0 THEN 3 END AS version,
  CASE WHEN f % 11 <> 0 AND f % 7 <> 0 THEN 'team' END AS created_by,
  CASE WHEN f % 11 <> 0 THEN n END AS examples, f % 11 = 0 AS unreadable FROM seed_files"""
)
def parse_seed_texts(spark, folder):
    return parsed(spark, folder).select(
        "path",
        "version",
        "created_by",
        F.when(F.col("parse_error").isNull(), F.size("seed_examples")).cast("long").alias("examples"),
        F.col("parse_error").isNotNull().alias("unreadable"),
    )


# Repository files: one per document; the type and the folder come from the document.
REPO_FILES = """repo_files AS (
  SELECT 'repo' || doc_id % 3 AS repo,
         CASE WHEN doc_id % 4 = 0 THEN 'docs/sub/' ELSE 'docs/' END || doc_id || '_' || lang
         || CASE WHEN doc_id % 10 = 9 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.md' ELSE '.pdf' END AS path
  FROM documents)"""


def repo_files(spark, folder):
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        F.concat(F.lit("repo"), (d % 3).cast("string")).alias("repo"),
        F.concat(
            F.when(d % 4 == 0, "docs/sub/").otherwise("docs/"),
            d.cast("string"),
            F.lit("_"),
            "lang",
            F.when(d % 10 == 9, ".txt").when(d % 2 == 0, ".md").otherwise(".pdf"),
        ).alias("path"),
    )


MATCHES = f"""{SEEDS}, {REPO_FILES},
wanted AS (
  SELECT path AS seed_path, f, 'repo' || f % 3 AS repo,
         CASE WHEN f % 2 = 0 THEN '^docs/[^/.][^/]*\\.md$' ELSE '^docs/[^0-8./][^/]*$' END AS regex,
         CASE WHEN f % 2 = 0 THEN 'docs/*.md' ELSE 'docs/[!0-8]*' END AS pattern
  FROM seed_files WHERE knowledge AND f % 11 <> 0),
patterns AS (SELECT DISTINCT repo, pattern, regex FROM wanted),
matches AS (
  SELECT r.repo, r.path, p.pattern FROM repo_files r JOIN patterns p ON r.repo = p.repo AND regexp_matches(r.path, p.regex)),
reached AS (
  SELECT w.seed_path AS path, count(m.path) FILTER (WHERE m.path LIKE '%.md' OR m.path LIKE '%.pdf') AS readable,
         count(m.path) FILTER (WHERE m.path LIKE '%.txt') AS unsupported
  FROM wanted w LEFT JOIN matches m ON m.repo = w.repo AND m.pattern = w.pattern GROUP BY w.seed_path),
document_errors AS (
  SELECT *, CASE WHEN unsupported > 0 THEN 'a matched document has a type that is not read'
                 WHEN readable = 0 THEN 'Couldn''t find any valid knowledge documents.' END AS document_error
  FROM reached),
validated AS (
  SELECT s.path, CASE WHEN f % 11 = 0 THEN 1
      WHEN (f % 7 = 0)::INT + (n < 5)::INT > 0 THEN (f % 7 = 0)::INT + (n < 5)::INT
      WHEN d.document_error IS NOT NULL THEN 1 ELSE 0 END AS n_errors,
    CASE WHEN f % 11 = 0 THEN 'unreadable' ELSE CASE WHEN f % 7 = 0 OR n < 5
      THEN concat_ws('; ', CASE WHEN f % 7 = 0 THEN 'created_by is missing' END,
                           CASE WHEN n < 5 THEN 'fewer than 5 seed examples' END)
      ELSE coalesce(d.document_error, '') END END AS errors,
    0 AS n_warnings
  FROM seed_files s LEFT JOIN document_errors d ON d.path = s.path)"""


def knowledge_patterns(spark, folder):
    files = parsed(spark, folder).filter(F.col("document").isNotNull())
    return files.select("document.repo", F.explode("document.patterns").alias("pattern")).distinct()


@query(f"WITH {MATCHES} SELECT repo, path, pattern FROM matches")
def match_patterns(spark, folder):
    return tx.match_patterns(repo_files(spark, folder), knowledge_patterns(spark, folder))


@query(f"WITH {MATCHES} SELECT path, readable, unsupported, document_error FROM document_errors")
def validate_documents(spark, folder):
    return tx.validate_documents(parsed(spark, folder), repo_files(spark, folder))


@query(f"WITH {MATCHES} SELECT DISTINCT repo, path FROM matches")
def collect_seed_documents(spark, folder):
    return tx.collect_seed_documents(parsed(spark, folder), repo_files(spark, folder))


def validated(spark, folder):
    """Validation reads the parsed files twice, so they are stored once."""
    stored = materialize(parsed(spark, folder), "parsed-seeds")
    return tx.validate_seed_files(stored, repo_files(spark, folder))


@query(f"WITH {MATCHES} SELECT path, errors, n_errors, n_warnings FROM validated")
def validate_seed_files(spark, folder):
    shown = F.transform("errors", lambda e: F.regexp_replace(e, "(?s)^unreadable:.*", "unreadable"))
    return validated(spark, folder).select("path", F.array_join(shown, "; ").alias("errors"), "n_errors", "n_warnings")


@query(
    f"""WITH {MATCHES} SELECT count(*) AS files, sum(n_warnings)::BIGINT AS warnings, sum(n_errors)::BIGINT AS errors
FROM validated"""
)
def validation_totals(spark, folder):
    return tx.validation_totals(validated(spark, folder))


EXPLODED = f"""WITH {SEEDS} SELECT s.path, p.question, p.answer,
  CASE WHEN s.knowledge THEN 'about ' || p.question END AS context,
  CASE WHEN s.knowledge THEN 'outline' ELSE 'to write' END AS task_description,
  row_number() OVER (PARTITION BY s.path ORDER BY p.conv_id, p.turn) - 1 AS example
FROM seed_files s JOIN seed_pairs p USING (f) WHERE f % 11 <> 0"""


@query(EXPLODED)
def explode_seeds(spark, folder):
    return tx.explode_seeds(parsed(spark, folder)).drop("pair").withColumn("example", F.col("example").cast("long"))


# Paths with good names, near misses and other folders, from the document ids.
PATHS = """paths AS (
  SELECT doc_id, text, lang, ['knowledge', 'compositional_skills', 'docs'][doc_id % 3 + 1] || '/' || source || '/' || doc_id || '/'
         || ['qna.yaml', 'qna.yml', 'QNA.yaml', 'attribution.txt', 'qna.yaml'][doc_id % 5 + 1] AS path FROM documents),
seed_paths AS (SELECT * FROM paths WHERE doc_id % 3 < 2 AND path LIKE '%/qna.yaml')"""


def paths(spark, folder):
    d = F.col("doc_id")

    def pick(names, count):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (d % count + 1).cast("int"))

    return table(spark, folder, "documents").select(
        "doc_id",
        "text",
        "lang",
        F.concat_ws(
            "/",
            pick(["knowledge", "compositional_skills", "docs"], 3),
            "source",
            d.cast("string"),
            pick(["qna.yaml", "qna.yml", "QNA.yaml", "attribution.txt", "qna.yaml"], 5),
        ).alias("path"),
    )


@query(
    f"""WITH {PATHS} SELECT path, doc_id % 3 < 2 AND path LIKE '%/qna.yaml' AS is_seed_file,
  doc_id % 3 < 2 AND doc_id % 5 IN (1, 2) AS warn_name FROM paths"""
)
def is_taxonomy_file(spark, folder):
    return paths(spark, folder).select(
        "path",
        is_seed_file(F.col("path")).alias("is_seed_file"),
        seed_name_warning(F.col("path")).alias("warn_name"),
    )


@query(
    f"""WITH {PATHS} SELECT path, split_part(path, '/', 3) AS leaf, split_part(path, '/', 4) AS file_name,
  split_part(path, '/', 1) || '->' || split_part(path, '/', 2) || '->' || split_part(path, '/', 3) AS arrow_path,
  3::BIGINT AS depth FROM seed_paths"""
)
def taxonomy_levels(spark, folder):
    levels = tx.taxonomy_levels(paths(spark, folder).filter(is_seed_file(F.col("path"))).select("path"))
    return levels.select("path", "leaf", "file_name", "arrow_path", F.size("levels").cast("long").alias("depth"))


def snapshots(spark, folder):
    """Base and head of a taxonomy: some files are only in one of them, some differ."""
    d = F.col("doc_id")
    every = paths(spark, folder)
    base = every.filter(d % 7 != 0).select("path", F.col("text").alias("content"))
    changed = F.when(d % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    head = every.filter(d % 13 != 0).select("path", changed.alias("content"))
    return base, head


DIFF = f"""WITH {PATHS}, diff AS (
  SELECT path, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'added' ELSE 'modified' END AS state FROM seed_paths
  WHERE doc_id % 13 <> 0 AND (doc_id % 7 = 0 OR doc_id % 4 = 0))
"""


@query(DIFF + "SELECT path, state FROM diff")
def taxonomy_diff(spark, folder):
    base, head = snapshots(spark, folder)
    return tx.taxonomy_diff(head, base)


@query(f"WITH {PATHS} SELECT path, 'added' AS state FROM seed_paths")
def taxonomy_diff_from_empty(spark, folder):
    return tx.taxonomy_diff(paths(spark, folder).select("path", F.col("text").alias("content")))


@query(DIFF + "SELECT path FROM diff UNION SELECT path FROM seed_paths WHERE lang <> 'en'")
def changed_files(spark, folder):
    base, head = snapshots(spark, folder)
    untracked = paths(spark, folder).filter((F.col("lang") != "en") & is_seed_file(F.col("path")))
    return tx.changed_files(untracked, tx.taxonomy_diff(head, base))


@query(f"WITH {PATHS} SELECT path FROM paths WHERE doc_id % 3 <> 1 AND doc_id % 8 <> 5")
def existing_not_deleted(spark, folder):
    d = F.col("doc_id")
    diff = paths(spark, folder).select(
        F.when(d % 8 != 5, F.col("path")).alias("path"),
        F.when(d % 3 == 1, "deleted").otherwise("modified").alias("state"),
    )
    return tx.existing_not_deleted(diff).select("path")


@query(f"WITH {PATHS} SELECT path FROM paths WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_targets(spark, folder):
    every = paths(spark, folder).select("doc_id", "path")
    targets = every.join(table(spark, folder, "labels"), "doc_id", "left_semi")
    return tx.exclude_targets(every.select("path"), targets)
