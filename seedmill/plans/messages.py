"""Queries on conversations: layouts, conversions, prompt text, history."""

from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.storage import scratch_path
from seedmill.operators import messages as ms
from seedmill.operators import sessions as ss
from seedmill.operators.retrieval import augmented_context, retrieve_topk
from seedmill.plans.documents import CENTERS, label_centers
from seedmill.plans.registry import query
from seedmill.plans.tables import PAIRS, qna_pairs, table
from seedmill.sources import records, sinks


def samples(spark, folder):
    return ms.collect_messages(table(spark, folder, "conversations"))


def _shown(messages):
    """Message array as one text, so that any engine can compare it."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


SHOWN = "string_agg(role || ': ' || text, chr(10) ORDER BY turn)"


@query(f"SELECT conv_id, count(*) AS n, {SHOWN} AS shown FROM conversations GROUP BY conv_id")
def collect_messages(spark, folder):
    return samples(spark, folder).select(
        "conv_id", F.size("messages").cast("long").alias("n"), _shown(F.col("messages")).alias("shown")
    )


@query(
    f"""SELECT conv_id, turn // 3 AS part, count(*) AS n, {SHOWN} AS shown
FROM conversations GROUP BY conv_id, turn // 3"""
)
def collect_messages_in_parts(spark, folder):
    parts = ms.collect_messages(table(spark, folder, "conversations"), part_size=3)
    return parts.select(
        "conv_id", "part", F.size("messages").cast("long").alias("n"), _shown(F.col("messages")).alias("shown")
    )


@query("SELECT conv_id, turn, role, text AS content FROM conversations")
def explode_messages(spark, folder):
    parts = ms.collect_messages(table(spark, folder, "conversations"), part_size=3)
    return ms.explode_messages(parts, part_size=3)


TOO_SHORT = "a sample needs three messages"
STANDARD = f"""standard AS (
  SELECT conv_id,
    CASE WHEN count(*) >= 3 THEN arg_max(text, turn) FILTER (WHERE turn < 3 AND role = 'system') END AS system,
    CASE WHEN count(*) >= 3 THEN arg_max(text, turn) FILTER (WHERE turn < 3 AND role = 'user') END AS "user",
    CASE WHEN count(*) >= 3 THEN arg_max(text, turn) FILTER (WHERE turn < 3 AND role = 'assistant') END AS assistant,
    CASE WHEN count(*) < 3 THEN '{TOO_SHORT}' END AS error
  FROM conversations GROUP BY conv_id)"""


@query(f'WITH {STANDARD} SELECT conv_id, system, "user", assistant, error FROM standard')
def standard_to_legacy(spark, folder):
    first = ms.first_messages(table(spark, folder, "conversations"))
    return ms.standard_to_legacy(first, on_error="quarantine")


def pretraining_samples(spark, folder):
    """Question and answer in one ``pretraining`` message; some lack a token or have one twice."""
    pairs = qna_pairs(spark, folder)
    between = (
        F.when(F.col("conv_id") % 9 == 4, F.lit(""))
        .when(F.col("conv_id") % 9 == 5, F.lit(fixed.ASSISTANT_TOKEN * 2))
        .otherwise(F.lit(fixed.ASSISTANT_TOKEN))
    )
    start = F.when(F.col("conv_id") % 9 == 6, F.lit("")).otherwise(F.lit(fixed.USER_TOKEN))
    text = F.concat(start, F.col("question"), between, F.col("answer"))
    entry = F.array(F.struct(text.alias("content"), F.lit("pretraining").alias("role")))
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample"), entry.alias("messages"))


PRETRAINING = f"""{PAIRS},
texts AS (
  SELECT conv_id * 1000 + turn AS sample, question, answer, conv_id % 9 AS kind,
         CASE WHEN conv_id % 9 = 6 THEN '' ELSE '<|user|>' END || question
         || CASE conv_id % 9 WHEN 4 THEN '' WHEN 5 THEN '<|assistant|><|assistant|>' ELSE '<|assistant|>' END
         || answer AS text
  FROM pairs),
pretraining AS (
  SELECT sample, '' AS system,
         CASE WHEN kind NOT IN (4, 5, 6) THEN question END AS "user",
         CASE WHEN kind NOT IN (4, 5, 6) THEN answer END AS assistant,
         CASE kind WHEN 4 THEN 'no <|assistant|> in the pretraining text: ' || text
                   WHEN 5 THEN 'each token must occur once, user before assistant'
                   WHEN 6 THEN 'no <|user|> in the pretraining text: ' || text END AS error
  FROM texts)"""


@query(f'WITH {PRETRAINING} SELECT sample, system, "user", assistant, error FROM pretraining')
def pretraining_to_legacy(spark, folder):
    return ms.pretraining_to_legacy(pretraining_samples(spark, folder), on_error="quarantine")


def mixed_samples(spark, folder):
    return _mixed(spark, folder, ms.first_messages(table(spark, folder, "conversations")))


def _mixed(spark, folder, conversations):
    standard = conversations.select((F.col("conv_id") * -1 - 1).alias("sample"), "messages")
    return standard.unionByName(pretraining_samples(spark, folder))


@query(
    f"""WITH {PRETRAINING}, {STANDARD}
SELECT sample, system, "user", assistant, error FROM pretraining
UNION ALL SELECT -conv_id - 1, system, "user", assistant, error FROM standard"""
)
def to_legacy_per_row(spark, folder):
    return ms.to_legacy(mixed_samples(spark, folder), on_error="quarantine", per_row=True)


@query(f'WITH {STANDARD} SELECT conv_id, system, "user", assistant, error FROM standard')
def to_legacy_by_first_record(spark, folder):
    first = ms.first_messages(table(spark, folder, "conversations"))
    return ms.to_legacy(first, order="conv_id", on_error="quarantine")


@query(
    f"""WITH {PAIRS} SELECT true AS is_messages, false AS first_is_pretraining,
  (SELECT count(*) FROM pairs) AS pretraining_rows,
  (SELECT count(DISTINCT conv_id) FROM conversations) AS standard_rows"""
)
def dataset_kind(spark, folder):
    mixed = _mixed(spark, folder, samples(spark, folder))
    first = F.min_by(ms.has_pretraining(F.col("messages")), F.col("sample"))
    return mixed.agg(
        F.lit("messages" in mixed.columns).alias("is_messages"),
        first.alias("first_is_pretraining"),
        F.count_if(ms.has_pretraining(F.col("messages"))).alias("pretraining_rows"),
        F.count_if(~ms.has_pretraining(F.col("messages"))).alias("standard_rows"),
    )


# Architecture prompts are a caller's table; these two stand in for it.
PROMPTS = {"small": "You are a small model.", "large": "You are a large model."}


def prompted(spark, folder):
    arch = F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("other")
    return ms.with_system_prompt(qna_pairs(spark, folder).withColumn("arch", arch), PROMPTS)


PROMPTED = f"""{PAIRS},
prompted AS (
  SELECT *, CASE conv_id % 3 WHEN 0 THEN 'You are a small model.' WHEN 1 THEN 'You are a large model.'
            ELSE '{fixed.DEFAULT_SYSTEM_PROMPT}' END AS system FROM pairs),
formatted AS (
  SELECT *, '<|system|>' || chr(10) || system || chr(10) || '<|user|>' || chr(10) || question || chr(10)
            || '<|assistant|>' AS prompt FROM prompted),
texts AS (SELECT *, prompt || chr(10) || answer || '<|endoftext|>' AS text FROM formatted)"""


def texts(spark, folder):
    text = ms.format_text(F.col("system"), F.col("question"), F.col("answer"))
    return prompted(spark, folder).withColumn("text", text)


@query(f"WITH {PROMPTED} SELECT conv_id, turn, system FROM prompted")
def with_system_prompt(spark, folder):
    return prompted(spark, folder).select("conv_id", "turn", "system")


@query(f"WITH {PROMPTED} SELECT conv_id, turn, text FROM texts")
def format_text(spark, folder):
    return texts(spark, folder).select("conv_id", "turn", "text")


@query(f"WITH {PROMPTED} SELECT conv_id, turn, prompt FROM formatted")
def format_prompt(spark, folder):
    return prompted(spark, folder).select(
        "conv_id", "turn", ms.format_prompt(F.col("system"), F.col("question")).alias("prompt")
    )


@query(f"WITH {PROMPTED} SELECT conv_id, turn, trim(answer, ' \t\r\n\f') || '<|endoftext|>' AS response FROM texts")
def extract_response(spark, folder):
    return texts(spark, folder).select("conv_id", "turn", ms.extract_response(F.col("text")).alias("response"))


@query(
    f"""WITH {PROMPTED} SELECT conv_id, turn, length(prompt) + 1 AS prompt_len,
  length(answer) + 13 AS loss_len FROM texts"""
)
def mask_to_response(spark, folder):
    return texts(spark, folder).select("conv_id", "turn", ms.mask_to_response(F.col("text")).alias("m")).select(
        "conv_id", "turn", "m.*"
    )


@query(
    f"""WITH lead AS (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS system,
         min(turn) FILTER (WHERE role = 'user') AS first_user FROM conversations GROUP BY conv_id),
merged AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN c.turn = l.first_user AND l.system IS NOT NULL THEN l.system || chr(10) || c.text ELSE c.text END AS text
  FROM conversations c JOIN lead l USING (conv_id)
  WHERE c.role <> 'system' OR l.first_user IS NULL)
SELECT conv_id, count(*) AS n, {SHOWN} AS shown FROM merged GROUP BY conv_id"""
)
def merge_system_into_user(spark, folder):
    merged = samples(spark, folder).withColumn("messages", ms.merge_system_into_user(F.col("messages")))
    return merged.select(
        "conv_id", F.size("messages").cast("long").alias("n"), _shown(F.col("messages")).alias("shown")
    )


@query(
    r"""SELECT doc_id, regexp_replace(text, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')
  || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. ' || n_chars
  || chr(10) || 'D. ' || chr(10) || 'Answer:' AS prompt FROM documents"""
)
def render_multiple_choice(spark, folder):
    choices = F.array("lang", "source", F.col("n_chars").cast("string"))
    return table(spark, folder, "documents").select(
        "doc_id", ms.render_multiple_choice(F.col("text"), choices).alias("prompt")
    )


@query(f"SELECT dataset, {SHOWN} AS shown FROM (SELECT 'conv-' || conv_id AS dataset, * FROM conversations) GROUP BY dataset")
def read_messages(spark, folder):
    path = scratch_path(spark, "messages")
    rows = samples(spark, folder).select(
        "messages",
        F.lit("chat").alias("group"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("dataset"),
        F.lit("{}").alias("metadata"),
    )
    rows.write.json(path)
    return records.read_messages(spark, path).select("dataset", _shown(F.col("messages")).alias("shown"))


@query(f'WITH {PAIRS} SELECT NULL::VARCHAR AS system, question AS "user", answer AS assistant FROM pairs')
def read_legacy(spark, folder):
    path = scratch_path(spark, "legacy")
    qna_pairs(spark, folder).select(F.col("question").alias("user"), F.col("answer").alias("assistant")).write.json(path)
    return records.read_legacy(spark, path)


@query(f'WITH {PAIRS} SELECT question AS "user", answer AS assistant FROM pairs')
def read_inputs_targets(spark, folder):
    path = scratch_path(spark, "inputs-targets")
    qna_pairs(spark, folder).select(F.col("question").alias("inputs"), F.col("answer").alias("targets")).write.json(path)
    return records.read_inputs_targets(spark, path)


@query(
    """SELECT printf('%d', conv_id) AS session_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations"""
)
def write_session(spark, folder):
    path = scratch_path(spark, "sessions")
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )
    sinks.write_session(turns, path)
    return records.read_session(spark, path)


@query(
    """SELECT conv_id, turn, role, text FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS suffix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
WHERE suffix <= 1000 OR back = 1"""
)
def trim_history(spark, folder):
    return ss.trim_history(table(spark, folder, "conversations"), 1000)


@query(
    """SELECT conv_id, turn, role, text FROM (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total,
         max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
WHERE total <= 1000 OR turn = last"""
)
def trim_history_compat(spark, folder):
    return ss.trim_history(table(spark, folder, "conversations"), 1000, compat=True)


@query(
    """SELECT conv_id, turn, role, text FROM (
  SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last
  FROM conversations) WHERE turn <> first OR first = last"""
)
def drop_oldest(spark, folder):
    return ss.drop_oldest(table(spark, folder, "conversations"))


@query(
    """SELECT conv_id, CASE WHEN n > 3 THEN text END AS response,
  CASE WHEN n <= 3 THEN 'Invalid index: 2' END AS error
FROM (SELECT conv_id, text, count(*) OVER (PARTITION BY conv_id) AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
WHERE back = least(n, 3)"""
)
def previous_response(spark, folder):
    return ss.previous_response(table(spark, folder, "conversations"), 2)


CONTEXT = f"""{CENTERS},
hits AS (
  SELECT q.query_id, x.vec_id, row_number() OVER (
           PARTITION BY q.query_id ORDER BY list_dot_product(q.v, x.v) DESC, x.vec_id) AS rank
  FROM centers q CROSS JOIN e x QUALIFY rank <= 3),
context AS (
  SELECT query_id, string_agg('vector ' || vec_id, chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id)"""


def topic_context(spark, folder):
    """Context per topic; a topic is a label whose mean vector is the query."""
    index = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = retrieve_topk(label_centers(spark, folder), index, 3)
    contents = index.select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("content"))
    return augmented_context(hits, contents)


@query(f"WITH {CONTEXT} SELECT query_id, context FROM context")
def augmented_context_of_topics(spark, folder):
    return topic_context(spark, folder)


@query(
    f"""WITH {CONTEXT}
SELECT conv_id, turn * 2 AS turn, role, text FROM conversations
UNION ALL SELECT conv_id, turn * 2 - 1, 'assistant', context
FROM conversations JOIN context ON query_id = (conv_id + turn) % 10 WHERE role = 'user'"""
)
def augment_sessions(spark, folder):
    """Each user turn belongs to a topic; equal questions are searched once."""
    turns = table(spark, folder, "conversations")
    topics = turns.filter("role = 'user'").select(
        "conv_id", "turn", ((F.col("conv_id") + F.col("turn")) % 10).cast("int").alias("query_id")
    )
    context = topics.join(topic_context(spark, folder), "query_id").drop("query_id")
    return ss.augment_sessions(turns, context)
