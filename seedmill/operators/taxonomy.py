"""Seed files as rows: differences, validation, flattening, folder levels."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.columns import base_name, file_suffix, glob_to_regex, is_seed_file
from seedmill.functions.storage import materialize

WILDCARD = r"[*?\[]"


def changed_files(untracked: DataFrame, modified: DataFrame) -> DataFrame:
    """New and modified paths, each once."""
    return untracked.select("path").union(modified.select("path")).distinct()


def existing_not_deleted(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("path").isNotNull() & (F.col("state") != "deleted"))


def taxonomy_diff(head: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Seed files added or modified against a base snapshot; no base means everything is new.

    Snapshots are ``(path, content)``. Contents are hashed before they move, so
    the join carries paths and digests only.
    """

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.filter(is_seed_file(F.col("path"))).select("path", F.sha2("content", 256).alias(name))

    new = digest(head, "head_hash")
    if base is None:
        return new.select("path", F.lit("added").alias("state"))
    both = new.join(digest(base, "base_hash"), "path", "full_outer")
    state = (
        F.when(F.col("head_hash").isNull(), "deleted")
        .when(F.col("base_hash").isNull(), "added")
        .when(F.col("head_hash") != F.col("base_hash"), "modified")
    )
    return existing_not_deleted(both.select("path", state.alias("state"))).filter(
        F.col("state").isNotNull()
    )


def exclude_targets(candidates: DataFrame, targets: DataFrame, column: str = "path") -> DataFrame:
    """Candidates that are not themselves a target file."""
    return candidates.join(targets.select(column), column, "left_anti")


def is_knowledge(path: Column) -> Column:
    return F.startswith(path, F.lit("knowledge/"))


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def seed_errors(df: DataFrame) -> Column:
    """Messages for everything that makes a parsed seed file unusable."""
    knowledge = is_knowledge(F.col("path"))
    examples = F.coalesce(F.col("seed_examples"), F.array().cast(df.schema["seed_examples"].dataType))
    nested = F.exists(examples, lambda e: e["questions_and_answers"].isNotNull())

    def unanswered(e: Column) -> Column:
        pairs = e["questions_and_answers"]
        return F.when(
            pairs.isNotNull(),
            (F.size(pairs) == 0) | F.exists(pairs, lambda p: _blank(p["question"]) | _blank(p["answer"])),
        ).otherwise(_blank(e["question"]) | _blank(e["answer"]))

    parsed = F.col("parse_error").isNull()
    rules = [
        (~parsed, F.concat(F.lit("unreadable: "), F.col("parse_error"))),
        (parsed & _blank(F.col("created_by")), F.lit("created_by is missing")),
        (
            parsed & ~knowledge & _blank(F.col("task_description")),
            F.lit("task_description is missing"),
        ),
        (parsed & knowledge & _blank(F.col("domain")), F.lit("domain is missing")),
        (parsed & knowledge & F.col("document").isNull(), F.lit("document is missing")),
        (
            parsed & (F.size(examples) < fixed.SEED_EXAMPLES_MIN),
            F.lit(f"fewer than {fixed.SEED_EXAMPLES_MIN} seed examples"),
        ),
        (
            parsed & F.exists(examples, unanswered),
            F.lit("a seed example lacks a question or an answer"),
        ),
        (
            parsed & nested & F.exists(examples, lambda e: _blank(e["context"])),
            F.lit("a seed example lacks its context"),
        ),
        (parsed & (F.size("mistyped") > 0), F.concat(F.lit("not text: "), F.array_join("mistyped", ", "))),
    ]
    return F.array_compact(F.array(*[F.when(rule, message) for rule, message in rules]))


def seed_warnings() -> Column:
    return F.array_compact(
        F.array(
            F.when(
                F.col("parse_error").isNull() & F.col("version").isNull(), F.lit("version is missing")
            )
        )
    )


def validate_seed_files(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Errors and warnings per seed file.

    ``files`` lists the repository files ``(repo, path)`` that document
    references can match. A file that is clean so far and whose document cannot
    be read gets one more error.
    """
    checked = parsed.withColumn("errors", seed_errors(parsed)).withColumn("warnings", seed_warnings())
    if files is not None:
        found = validate_documents(parsed, files).select("path", "document_error")
        checked = checked.join(found, "path", "left")
        clean = (F.size("errors") == 0) & (F.size("warnings") == 0)
        bad = clean & F.col("document").isNotNull() & F.col("document_error").isNotNull()
        checked = checked.withColumn(
            "errors", F.when(bad, F.array("document_error")).otherwise(F.col("errors"))
        )
    return checked.select(
        "path",
        "errors",
        "warnings",
        F.size("errors").alias("n_errors"),
        F.size("warnings").alias("n_warnings"),
    )


def validation_totals(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).alias("errors"),
    )


def require_valid(validated: DataFrame) -> DataFrame:
    """Raise when any file has an error; the totals come back otherwise."""
    totals = validation_totals(validated)
    row = totals.first()
    if row["errors"]:
        raise ValueError(f"{row['files']} seed files have {row['errors']} errors")
    return totals


def pattern_edges(patterns: DataFrame) -> DataFrame:
    """The trie of the wildcard patterns: one row for each step from a prefix of segments to the next one.

    Patterns of a repository and a number of segments share the steps of what
    they have in common. ``key`` is the segment of a plain step and empty for a
    wildcard, whose expression for one segment is ``regex``.
    """
    segments = F.split("pattern", "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda n: F.struct(
            n.alias("level"),
            F.array_join(F.slice(segments, 1, n - 1), "/").alias("prefix"),
            F.array_join(F.slice(segments, 1, n), "/").alias("reached"),
            F.element_at(segments, n).alias("segment"),
        ),
    )
    every = patterns.select("repo", F.size(segments).alias("depth"), F.inline(steps)).distinct()
    wild = F.rlike("segment", F.lit(WILDCARD))
    return every.select(
        "repo",
        "depth",
        "level",
        "prefix",
        "reached",
        wild.alias("wild"),
        F.when(wild, "").otherwise(F.col("segment")).alias("key"),
        F.when(wild, glob_to_regex(F.col("segment"))).alias("regex"),
    )


def match_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files matched by each glob pattern of the same repository.

    A pattern without wildcards is a path, and an equality join finds it. The
    others form a trie of segments, which files walk down one level at a time:
    at each level an equality join on the prefix reached and the file's segment,
    or on the prefix and the mark of a wildcard step. An expression is tried on
    one segment of the files that came as far, once for all patterns that share
    the step. There is a join for each segment of the deepest pattern.
    """
    every = materialize(patterns.select("repo", "pattern").distinct(), "patterns")
    wild = F.rlike(F.col("pattern"), F.lit(WILDCARD))
    places = files.select("repo", "path")

    named = places.join(
        every.filter(~wild).withColumn("path", F.col("pattern")), ["repo", "path"]
    ).select("repo", "path", "pattern")

    edges = materialize(pattern_edges(every.filter(wild)), "pattern-edges")
    deepest = edges.agg(F.max("depth")).first()[0]
    if deepest is None:
        return named
    walk = places.withColumn("_segments", F.split("path", "/"))
    walk = walk.withColumn("depth", F.size("_segments")).withColumn("prefix", F.lit(""))
    walk = walk.join(edges.select("repo", "depth").distinct(), ["repo", "depth"], "left_semi")
    done = []
    for level in range(1, deepest + 1):
        step = edges.filter(F.col("level") == level).drop("level")
        segment = F.element_at("_segments", level)
        ways = F.array(
            F.struct(F.lit(False).alias("wild"), segment.alias("key")), F.struct(F.lit(True).alias("wild"), F.lit("").alias("key"))
        )
        walk = (
            walk.filter(F.col("depth") >= level)
            .select("repo", "path", "_segments", "depth", "prefix", F.inline(ways))
            .join(step, ["repo", "depth", "prefix", "wild", "key"])
            .filter(~F.col("wild") | F.rlike(segment, F.col("regex")))
            .select("repo", "path", "_segments", "depth", F.col("reached").alias("prefix"))
        )
        walk = materialize(walk, f"walk-{level}")  # read twice: by what ends here and by the next level
        done.append(walk.filter(F.col("depth") == level).select("repo", "path", F.col("prefix").alias("pattern")))
    return reduce(DataFrame.unionByName, [named, *done])


def validate_documents(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each seed file's patterns reach readable documents of a supported type.

    Any match of another type is fatal; no match at all is an error. Matches
    are counted per pattern first, so what joins the seed files stays small.
    """
    wanted = parsed.filter(F.col("document").isNotNull()).select(
        F.col("path").alias("seed_path"),
        F.col("document.repo").alias("repo"),
        F.explode_outer("document.patterns").alias("pattern"),
    )
    patterns = wanted.filter(F.col("pattern").isNotNull()).select("repo", "pattern").distinct()
    supported = file_suffix(F.col("path")).isin(*fixed.DOCUMENT_SUFFIXES)
    counts = (
        match_patterns(files.select("repo", "path"), patterns)
        .groupBy("repo", "pattern")
        .agg(F.count_if(supported).alias("good"), F.count_if(~supported).alias("bad"))
    )
    per_seed = (
        wanted.join(counts, ["repo", "pattern"], "left")
        .groupBy("seed_path")
        .agg(
            F.coalesce(F.sum("good"), F.lit(0)).alias("readable"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("unsupported"),
        )
    )
    return per_seed.select(
        F.col("seed_path").alias("path"),
        "readable",
        "unsupported",
        F.when(F.col("unsupported") > 0, "a matched document has a type that is not read")
        .when(F.col("readable") == 0, "no document matches")
        .alias("document_error"),
    )


def collect_seed_documents(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """The documents knowledge seeds refer to; skills have none and are skipped."""
    wanted = parsed.filter(F.col("document").isNotNull()).select(
        F.col("document.repo").alias("repo"), F.explode("document.patterns").alias("pattern")
    )
    hits = match_patterns(files.select("repo", "path"), wanted.distinct())
    return hits.select("repo", "path").distinct()


def explode_seeds(parsed: DataFrame) -> DataFrame:
    """Flat rows ``(path, example, context, question, answer, task_description)`` of both seed layouts."""
    examples = parsed.select(
        "path",
        F.coalesce("task_description", "document_outline").alias("task_description"),
        F.posexplode("seed_examples").alias("example", "e"),
    )
    own = F.array(F.struct(F.col("e.question").alias("question"), F.col("e.answer").alias("answer")))
    pairs = F.coalesce(F.col("e.questions_and_answers"), own)
    return examples.select("path", "task_description", "example", "e", F.posexplode(pairs).alias("pair", "p")).select(
        "path",
        "example",
        "pair",
        F.col("e.context").alias("context"),
        F.col("p.question").alias("question"),
        F.col("p.answer").alias("answer"),
        "task_description",
    )


def taxonomy_levels(df: DataFrame, path: str = "path") -> DataFrame:
    """Folder levels of a seed file, its leaf folder and the older arrow form of the path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return df.withColumns(
        {
            "levels": folders,
            "leaf": F.try_element_at(folders, F.lit(-1)),
            "file_name": base_name(F.col(path)),
            "arrow_path": F.array_join(folders, "->"),
        }
    )
