"""Queries on scores: comparison with a base, reports, answers, checkpoints."""

import pandas as pd
from pyspark.sql import functions as F

from seedmill.fixed import RUBRIC_MAX
from seedmill.functions.columns import round2
from seedmill.functions.slots import judge_column, overlap_score
from seedmill.functions.storage import scratch_path
from seedmill.operators import evaluation as ev
from seedmill.operators.splits import take_first_n
from seedmill.plans.registry import query
from seedmill.plans.tables import JUDGED, PAIRS, judged_pairs, qna_pairs, table, words_sql
from seedmill.sources import sinks

COMPARED = f"""WITH {JUDGED},
candidate AS (SELECT qna_file, avg(score) AS score FROM judged WHERE side = 1 GROUP BY qna_file),
base AS (SELECT qna_file, avg(score) AS base_score FROM judged WHERE side = 0 GROUP BY qna_file),
compared AS (
  SELECT c.qna_file, b.base_score, c.score,
         CASE WHEN b.base_score IS NULL THEN 'new' WHEN c.score > b.base_score THEN 'improvement'
              WHEN c.score < b.base_score THEN 'regression' ELSE 'no change' END AS change,
         printf('%.2f', c.score - b.base_score)::DOUBLE AS delta
  FROM candidate c LEFT JOIN base b USING (qna_file)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY change ORDER BY
            CASE change WHEN 'improvement' THEN -delta WHEN 'regression' THEN delta ELSE 0 END, qna_file) AS rank
  FROM compared)
"""


def compared(spark, folder):
    candidate = ev.avg_score_by_qna(judged_pairs(spark, folder, 1))
    base = ev.avg_score_by_qna(judged_pairs(spark, folder, 0))
    return ev.compare_to_base(candidate, base)


@query(f"WITH {JUDGED} SELECT side, qna_file, avg(score) AS avg_score FROM judged GROUP BY side, qna_file")
def avg_score_by_qna(spark, folder):
    def of(side: int):
        return ev.avg_score_by_qna(judged_pairs(spark, folder, side)).withColumn("side", F.lit(side).cast("long"))

    return of(0).unionByName(of(1))


@query(COMPARED + "SELECT * FROM compared")
def compare_to_base(spark, folder):
    return compared(spark, folder)


@query(
    f"""WITH {JUDGED}
SELECT lang AS task, avg(score) FILTER (side = 0) AS base_score, avg(score) FILTER (side = 1) AS score,
       CASE WHEN avg(score) FILTER (side = 1) > avg(score) FILTER (side = 0) THEN 'improvement'
            WHEN avg(score) FILTER (side = 1) < avg(score) FILTER (side = 0) THEN 'regression'
            ELSE 'no change' END AS change,
       printf('%.2f', avg(score) FILTER (side = 1) - avg(score) FILTER (side = 0))::DOUBLE AS delta
FROM judged GROUP BY lang HAVING count(*) FILTER (side = 1) > 0"""
)
def compare_tasks(spark, folder):
    def by_lang(side):
        return judged_pairs(spark, folder, side).groupBy(F.col("lang").alias("task")).agg(
            F.avg("score").alias("score")
        )

    return ev.compare_tasks(by_lang(1), by_lang(0))


@query(COMPARED + "SELECT qna_file, change, delta, rank FROM ranked")
def rank_improvements(spark, folder):
    ranked = ev.rank_improvements(compared(spark, folder), [F.col("qna_file")])
    return ranked.select("qna_file", "change", "delta", "rank")


@query(
    COMPARED
    + """SELECT change, rank, rank || '. ' || qna_file || CASE change
  WHEN 'improvement' THEN ': ' || printf('%.2f', base_score)::DOUBLE || ' -> ' || printf('%.2f', score)::DOUBLE || ' (+' || delta || ')'
  WHEN 'regression' THEN ': ' || printf('%.2f', base_score)::DOUBLE || ' -> ' || printf('%.2f', score)::DOUBLE || ' (' || delta || ')'
  ELSE ' (' || printf('%.2f', score)::DOUBLE || ')' END AS line
FROM ranked"""
)
def report_lines(spark, folder):
    return ev.report_lines(ev.rank_improvements(compared(spark, folder), [F.col("qna_file")]))


SCORED = f"""WITH {PAIRS},
scored AS (
  SELECT conv_id, turn, 1 + floor(len(list_intersect(expected, given)) / greatest(len(expected), 1) * 4)::INT AS scores
  FROM (SELECT conv_id, turn, list_distinct({words_sql('lower(question)')}) AS expected,
               list_distinct({words_sql('lower(answer)')}) AS given FROM pairs))
"""


def scored(spark, folder):
    """Each question as the reference and its answer as the response, judged by word overlap."""
    return qna_pairs(spark, folder).select(
        "conv_id", "turn", overlap_score(F.col("question"), F.col("answer")).alias("scores")
    )


@query(SCORED + "SELECT conv_id, turn, scores FROM scored")
def judge_overlap(spark, folder):
    return scored(spark, folder)


def overlap_judge(questions, references, responses):
    """The overlap judge once more as a user would write one: three series in, scores out."""
    shares = [
        len(set(e.split()) & set(g.split())) / max(len(set(e.split())), 1)
        for e, g in zip(references.str.lower(), responses.str.lower(), strict=True)
    ]
    return pd.Series([1 + int(share * (RUBRIC_MAX - 1)) for share in shares], dtype="int32")


@query(SCORED + "SELECT conv_id, turn, scores FROM scored")
def judge_by_function(spark, folder):
    text = F.col("question")
    return qna_pairs(spark, folder).select(
        "conv_id", "turn", judge_column(overlap_judge, text, text, F.col("answer")).alias("scores")
    )


@query(SCORED + "SELECT conv_id, turn, scores, 'candidate' AS model_name, f.format FROM scored CROSS JOIN (VALUES ('csv'), ('jsonl')) f(format)")
def write_results(spark, folder):
    """Scores written in two formats and read back."""
    written = sinks.write_results(scored(spark, folder), ["jsonl", "csv"], scratch_path(spark, "results"), "candidate")
    columns = "conv_id long, turn long, scores int, model_name string, timestamp string"
    stored = spark.read.schema(columns).json(written[0]).withColumn("format", F.lit("jsonl"))
    table_form = spark.read.schema(columns).csv(written[1], header=True).withColumn("format", F.lit("csv"))
    return stored.unionByName(table_form).drop("timestamp")


@query(
    SCORED
    + """SELECT count(*) AS questions, sum(scores)::BIGINT AS total_score, count(*) * 5 AS max_score,
  printf('%.2f/5', avg(scores)) AS average_text FROM scored"""
)
def dk_report(spark, folder):
    return ev.dk_report(scored(spark, folder))


@query(SCORED + "SELECT avg(scores) AS average, sum(scores)::BIGINT AS total, median(scores)::DOUBLE AS median FROM scored")
def dk_summary(spark, folder):
    return ev.dk_summary(scored(spark, folder))


@query(
    SCORED
    + """SELECT 'Average' AS metric, avg(scores) AS value FROM scored
UNION ALL SELECT 'Total Score', sum(scores)::DOUBLE FROM scored
UNION ALL SELECT 'Median', median(scores)::DOUBLE FROM scored
UNION ALL SELECT 'Q' || row_number() OVER (ORDER BY conv_id, turn), scores::DOUBLE FROM scored"""
)
def results_summary(spark, folder):
    return ev.results_summary(scored(spark, folder), [F.col("conv_id"), F.col("turn")])


@query(f"WITH {PAIRS} SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS number FROM pairs")
def question_number(spark, folder):
    pairs = qna_pairs(spark, folder).select("conv_id", "turn")
    return ev.question_number(pairs, [F.col("conv_id"), F.col("turn")])


@query(
    """SELECT d.doc_id AS item_id, 'quality ' || l.quality AS response
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def questions_with_responses(spark, folder):
    """Every document is a question; labels are its response, where there is one."""
    responses = table(spark, folder, "labels").select(
        "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("response")
    )
    questions = table(spark, folder, "documents").join(responses, "doc_id", "left")
    return ev.answered(questions, F.lit("unused")).select(F.col("doc_id").alias("item_id"), "response")


@query("SELECT item_id, sha256(text) AS response FROM benchmark")
def questions_needing_responses(spark, folder):
    return ev.answered(table(spark, folder, "benchmark"), F.sha2("text", 256)).select("item_id", "response")


TURNS = """WITH judged AS (
  SELECT event_id, event_id % 2 + 1 AS turn, CASE WHEN event_type <> 'error' THEN floor(value) END AS score FROM events)
"""


def judged_turns(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        (F.col("event_id") % 2 + 1).alias("turn"),
        F.when(F.col("event_type") != "error", F.floor("value").cast("double")).alias("score"),
    )


@query(
    TURNS
    + """SELECT avg(score) AS overall_score, avg(score) FILTER (turn = 1) AS turn_one,
  avg(score) FILTER (turn = 2) AS turn_two, count(*) FILTER (score IS NULL) / count(*) AS error_rate FROM judged"""
)
def turn_scores(spark, folder):
    return ev.turn_scores(judged_turns(spark, folder))


@query(
    TURNS
    + """SELECT avg(error_rate) AS error_rate FROM (
  SELECT count(*) FILTER (score IS NULL) / count(*) AS error_rate FROM judged
  GROUP BY event_id % 4 < 2) HAVING avg(error_rate) > 0"""
)
def combined_error_rate(spark, folder):
    turns = judged_turns(spark, folder)
    first, second = (turns.filter((F.col("event_id") % 4 < 2) == side) for side in (True, False))
    return ev.combined_error_rate(ev.turn_scores(first), ev.turn_scores(second))


@query(
    """SELECT event_type AS task, avg((value > 25)::INT) AS acc, count(*) AS answers
FROM events GROUP BY ROLLUP (event_type)"""
)
def task_accuracy(spark, folder):
    answers = table(spark, folder, "events").select(
        F.col("event_type").alias("task"), (F.col("value") > 25).cast("int").alias("correct")
    )
    return ev.task_accuracy(answers)


@query(
    """SELECT loss, round(exp(loss), 6) AS perplexity FROM (
  SELECT sum(floor(value) / 64 * (event_id % 100 + 1)) / sum(event_id % 100 + 1) AS loss FROM events)"""
)
def weighted_mean_loss(spark, folder):
    batches = table(spark, folder, "events").select(
        (F.floor("value") / 64).alias("loss"), (F.col("event_id") % 100 + 1).alias("tokens")
    )
    return ev.weighted_mean_loss(batches).withColumn("perplexity", F.round("perplexity", 6))


@query("SELECT event_id, printf('%.2f', value / 7)::DOUBLE AS rounded FROM events")
def round2_scores(spark, folder):
    return table(spark, folder, "events").select("event_id", round2(F.col("value") / 7).alias("rounded"))


MODELS = ["click", "error", "purchase", "signup", "view"]


@query(
    "SELECT user_id AS question, "
    + ", ".join(f"arg_max(props, event_id) FILTER (event_type = '{m}') AS {m}" for m in MODELS)
    + " FROM events GROUP BY user_id"
)
def answers_by_model(spark, folder):
    answers = table(spark, folder, "events").select(
        F.col("user_id").alias("question"),
        F.col("event_type").alias("model"),
        F.col("props").alias("answer"),
        "event_id",
    )
    return ev.answers_by_model(answers, MODELS, "event_id")


@query(
    f"WITH {PAIRS} SELECT conv_id, turn, m.model FROM pairs CROSS JOIN (VALUES ('before'), ('after')) m(model)"
)
def ask_models(spark, folder):
    return ev.ask_models(qna_pairs(spark, folder).select("conv_id", "turn"), ["before", "after"])


@query(
    f"""WITH {PAIRS},
t AS (SELECT md5(question) AS "user", md5(answer) AS assistant_expected,
             row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS position FROM pairs),
o AS (SELECT md5(text) AS assistant_old, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
n AS (SELECT md5(html) AS assistant_new, row_number() OVER (ORDER BY page_id) - 1 AS position FROM pages)
SELECT position, "user", assistant_expected, assistant_old, assistant_new
FROM t JOIN o USING (position) JOIN n USING (position)"""
)
def before_after(spark, folder):
    test = qna_pairs(spark, folder).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
        F.md5("question").alias("user"),
        F.md5("answer").alias("assistant"),
    )
    old = table(spark, folder, "documents").select(F.col("doc_id").alias("at"), F.md5("text").alias("answer"))
    new = table(spark, folder, "pages").select(F.col("page_id").alias("at"), F.md5("html").alias("answer"))
    return ev.before_after(test, old, new, "at")


@query(
    """SELECT DISTINCT source || '_' || lang AS checkpoint FROM documents WHERE source || '_' || lang NOT IN (
  SELECT d.source || '_' || d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)"""
)
def checkpoints_todo(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.concat_ws("_", "source", "lang").alias("checkpoint"))
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    finished = docs.join(toxic, "doc_id", "left_semi").select("checkpoint")
    return ev.checkpoints_todo(docs, finished)


@query(
    """SELECT event_type AS run, arg_max('samples_' || user_id, (value, -epoch_us(ts))) AS checkpoint,
  max(value) AS score FROM events GROUP BY event_type"""
)
def best_checkpoint(spark, folder):
    results = table(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        F.concat(F.lit("samples_"), F.col("user_id").cast("string")).alias("checkpoint"),
        F.col("value").alias("score"),
        F.col("ts").alias("ended_at_utc"),
    )
    return ev.best_checkpoint(results, ["run"])


@query(
    """SELECT event_type AS run, 'hf/samples_' || max(event_id) AS checkpoint, max(event_id) AS samples
FROM events GROUP BY event_type"""
)
def latest_checkpoint(spark, folder):
    paths = table(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        F.concat(F.lit("hf/samples_"), F.col("event_id").cast("string")).alias("checkpoint"),
    )
    return ev.latest_checkpoint(paths, ["run"])


@query("SELECT doc_id, quality FROM labels ORDER BY doc_id LIMIT 4")
def take_first_tasks(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return take_first_n(labels, [F.col("doc_id")])
