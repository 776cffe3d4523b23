"""Scores: means, comparison with a base, rankings, reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.columns import fixed_text, round2
from seedmill.functions.ordering import with_position
from seedmill.functions.storage import materialize


def avg_score_by_qna(pairs: DataFrame) -> DataFrame:
    """Mean score per seed file."""
    return pairs.groupBy("qna_file").agg(F.avg("score").alias("avg_score"))


def _change(score: Column, base: Column) -> Column:
    return (
        F.when(base.isNull(), "new")
        .when(score > base, "improvement")
        .when(score < base, "regression")
        .otherwise("no change")
    )


def compare_to_base(candidate: DataFrame, base: DataFrame, key: str = "qna_file", score: str = "avg_score") -> DataFrame:
    """Class and rounded delta per file of the candidate; files only in the base are left out.

    Both sides have one row per key, so the join cannot be uneven.
    """
    joined = candidate.select(key, F.col(score).alias("score")).join(
        base.select(key, F.col(score).alias("base_score")), key, "left"
    )
    return joined.select(
        key,
        "base_score",
        "score",
        _change(F.col("score"), F.col("base_score")).alias("change"),
        round2(F.col("score") - F.col("base_score")).alias("delta"),
    )


def compare_tasks(candidate: DataFrame, base: DataFrame, key: str = "task", score: str = "score") -> DataFrame:
    """As ``compare_to_base``, but a task the base lacks is an error."""
    compared = compare_to_base(candidate, base, key, score)
    missing = F.raise_error(F.concat(F.lit("no base score for "), F.col(key))).cast("double")
    return compared.withColumn(
        "base_score", F.when(F.col("base_score").isNull(), missing).otherwise(F.col("base_score"))
    )


def rank_improvements(
    compared: DataFrame,
    order: Sequence[Column],
) -> DataFrame:
    """1-based rank inside each class: improvements from the largest rounded delta, regressions from
    the smallest, the other classes in input order; ``order`` is that order and settles ties.

    The comparison is stored first: ranking reads its input more than once.
    """
    compared = materialize(compared, "compared")
    signed = (
        F.when(F.col("change") == "improvement", -F.col("delta"))
        .when(F.col("change") == "regression", F.col("delta"))
        .otherwise(F.lit(0.0))
    )
    ranked = with_position(
        compared, [signed, *order], keys=["change"], position="_at"
    )
    return ranked.withColumn("rank", F.col("_at") + 1).drop("_at")


def report_lines(ranked: DataFrame, key: str = "qna_file") -> DataFrame:
    """The text line of every ranked row."""
    number = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col(key))
    score = round2(F.col("score")).cast("string")
    moved = F.concat(
        number, F.lit(": "), round2(F.col("base_score")).cast("string"), F.lit(" -> "), score, F.lit(" (")
    )
    delta = F.col("delta").cast("string")
    line = (
        F.when(F.col("change") == "improvement", F.concat(moved, F.lit("+"), delta, F.lit(")")))
        .when(F.col("change") == "regression", F.concat(moved, delta, F.lit(")")))
        .otherwise(F.concat(number, F.lit(" ("), score, F.lit(")")))
    )
    return ranked.select("change", "rank", line.alias("line"))


def question_number(
    df: DataFrame, order: Sequence[Column]
) -> DataFrame:
    placed = with_position(df, order, position="_at")
    return placed.withColumn("number", F.col("_at") + 1).drop("_at")


def needs_responses(questions: DataFrame) -> bool:
    """Questions that bring their responses are judged as they are."""
    return "response" not in questions.columns


def answered(questions: DataFrame, respond: Column) -> DataFrame:
    """Questions with a response each: their own, or ``respond`` where the table has none."""
    return questions.withColumn("response", respond) if needs_responses(questions) else questions


def dk_report(scored: DataFrame, score: str = "scores") -> DataFrame:
    """Total, maximum total and mean of 1-5 scores."""
    return scored.agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(score).alias("total_score"),
        (F.count(F.lit(1)) * fixed.RUBRIC_MAX).alias("max_score"),
        F.concat(fixed_text(F.avg(score), 2), F.lit(f"/{fixed.RUBRIC_MAX}")).alias("average_text"),
    )


def dk_summary(scored: DataFrame, score: str = "scores") -> DataFrame:
    """Mean, total and exact median. The median counts distinct scores, of which a rubric has five."""
    return scored.agg(
        F.avg(score).alias("average"), F.sum(score).alias("total"), F.median(score).alias("median")
    )


def results_summary(
    scored: DataFrame,
    order: Sequence[Column] = (),
    score: str = "scores",
) -> DataFrame:
    """Second results table ``(metric, value)``: the three totals, then one row per question.

    The scores are stored first, so that a judge behind them is asked once.
    """
    order = list(order) or [F.col("user_input")]
    names = [f"_order{i}" for i in range(len(order))]
    scored = materialize(
        scored.select(score, *[c.alias(n) for c, n in zip(order, names, strict=True)]), "scored"
    )
    summary = dk_summary(scored, score).select(
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("Average"), F.lit("Total Score"), F.lit("Median")),
                F.array(
                    F.col("average").cast("double"),
                    F.col("total").cast("double"),
                    F.col("median").cast("double"),
                ),
            )
        ).alias("metric", "value")
    )
    numbered = question_number(scored, [F.col(n) for n in names])
    each = numbered.select(
        F.concat(F.lit("Q"), F.col("number").cast("string")).alias("metric"),
        F.col(score).cast("double").alias("value"),
    )
    return summary.unionByName(each)


def turn_scores(judged: DataFrame) -> DataFrame:
    """Overall, first-turn and second-turn means and the share of turns that got no score.

    The second turn is null when no turn two was scored.
    """
    return judged.agg(
        F.avg("score").alias("overall_score"),
        F.avg(F.when(F.col("turn") == 1, F.col("score"))).alias("turn_one"),
        F.avg(F.when(F.col("turn") == 2, F.col("score"))).alias("turn_two"),
        (F.count_if(F.col("score").isNull()) / F.count(F.lit(1))).alias("error_rate"),
    )


def combined_error_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean of two error rates; no row when it is zero, as then nothing is shown."""
    rates = first.select("error_rate").unionByName(second.select("error_rate"))
    return rates.agg(F.avg("error_rate").alias("error_rate")).filter(F.col("error_rate") > 0)


def task_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy per task and, with a null task, over all answers."""
    return answers.rollup("task").agg(
        F.avg(F.col("correct").cast("double")).alias("acc"), F.count(F.lit(1)).alias("answers")
    )


def weighted_mean_loss(batches: DataFrame) -> DataFrame:
    """Token-weighted loss and its perplexity."""
    mean = F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")
    return batches.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"))


def answers_by_model(answers: DataFrame, models: Sequence[str], order: str) -> DataFrame:
    """One row per question, one column per model; a repeated question keeps its last answer.

    ``answers`` is ``(question, model, answer, order)``. The last answer per
    model is an aggregate, so repeats collapse before the shuffle.
    """
    last = [
        F.max_by(
            F.when(F.col("model") == model, F.col("answer")),
            F.when(F.col("model") == model, F.col(order)),
        ).alias(model)
        for model in models
    ]
    return answers.groupBy("question").agg(*last)


def ask_models(questions: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every question once per model of a short list."""
    return questions.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def before_after(
    test: DataFrame,
    old: DataFrame,
    new: DataFrame,
    order: str,
) -> DataFrame:
    """Question, old answer, new answer and expected answer by position; the shortest side ends it."""

    def placed(df: DataFrame) -> DataFrame:
        return with_position(df, [F.col(order)]).drop(order)

    return (
        placed(test.select(order, "user", F.col("assistant").alias("assistant_expected")))
        .join(placed(old.select(order, F.col("answer").alias("assistant_old"))), "position")
        .join(placed(new.select(order, F.col("answer").alias("assistant_new"))), "position")
    )


def checkpoints_todo(every: DataFrame, finished: DataFrame, required: bool = False) -> DataFrame:
    """Checkpoints without a result; with ``required`` an empty answer is an error."""
    todo = every.select("checkpoint").distinct().join(finished, "checkpoint", "left_anti")
    if required and todo.isEmpty():
        raise RuntimeError("no checkpoints left to evaluate")
    return todo


def best_checkpoint(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest score; among equals the one recorded first."""
    rank = F.struct(F.col("score"), (-F.unix_micros(F.col("ended_at_utc").cast("timestamp"))).alias("early"))
    return results.groupBy(*keys).agg(
        F.max_by("checkpoint", rank).alias("checkpoint"), F.max("score").alias("score")
    )


def latest_checkpoint(paths: DataFrame, keys: Sequence[str] = (), required: bool = False) -> DataFrame:
    """Largest number after the last underscore of the name."""
    number = F.substring_index("checkpoint", "_", -1).cast("long")
    found = paths.groupBy(*keys).agg(
        F.max_by("checkpoint", number).alias("checkpoint"), F.max(number).alias("samples")
    ).filter(F.col("checkpoint").isNotNull())
    if required and found.isEmpty():
        raise FileNotFoundError("no checkpoints were saved")
    return found
