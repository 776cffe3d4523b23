"""From seeds and chunks to generation requests and generated message datasets."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedmill import fixed
from seedmill.functions.columns import word_count, words
from seedmill.functions.sizing import task_slots
from seedmill.functions.storage import scratch_path
from seedmill.functions.slots import GENERATED, Generator, run_generator, template_generator
from seedmill.operators.messages import messages_of


def with_request_id(requests: DataFrame, parts: list[str]) -> DataFrame:
    """An id made from ``parts``, which name a request. Lengths keep different parts from giving one text."""

    def told(part: str):
        text = F.col(part).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return requests.withColumn("request_id", F.md5(F.concat_ws("|", *[told(p) for p in parts])))


def seed_requests(
    seeds: DataFrame, scale: int = fixed.SCALE_FACTOR, batch_size: int | None = None
) -> DataFrame:
    """``scale`` requests per seed pair, numbered from 1. Pairs are told apart by place, not by question.

    With ``batch_size`` they come spread over all task slots, as ``generate`` takes them
    with ``dealt``: up to so many requests of a pair go to a slot as one row, so that a
    pair's texts travel once a batch, not once a request.
    """
    place = ["path", "example", "pair"]
    if batch_size is None:
        repeated = seeds.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(scale))))
    else:
        step = max(batch_size, 1)
        batches = seeds.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(scale), F.lit(step))))
        spread = batches.repartition(task_slots(seeds.sparkSession), *place, "_first")
        last = F.least(F.col("_first") + (step - 1), F.lit(scale))
        repeated = spread.withColumn("repeat", F.explode(F.sequence("_first", last))).drop("_first")
    return with_request_id(repeated, [*place, "repeat"])


def knowledge_requests(files: DataFrame, chunks: DataFrame, scale: int = 1) -> DataFrame:
    """Requests for each chunk of a knowledge leaf, next to those for the leaf's own pairs.

    ``files`` has one row per leaf with its ``examples`` (the pairs of one seed
    file, bounded by the file); ``chunks`` is ``(leaf, chunk_id, content)``. A
    chunk request carries the examples as few-shot context instead of being
    repeated for each of them, so a leaf never multiplies into all pairs.
    """
    leaves = files.select("leaf", "examples")
    chunk_rows = chunks.join(leaves, "leaf")
    from_chunks = chunk_rows.select(
        "leaf",
        F.lit("chunk").alias("origin"),
        F.col("chunk_id").cast("string").alias("item"),
        F.col("content").alias("context"),
        "examples",
    )
    own = leaves.select("leaf", "examples", F.posexplode("examples").alias("n", "pair")).select(
        "leaf",
        F.lit("pair").alias("origin"),
        F.col("n").cast("string").alias("item"),
        F.lit(None).cast("string").alias("context"),
        F.array("pair").alias("examples"),
    )
    both = from_chunks.unionByName(own)
    repeated = both.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(scale))))
    return with_request_id(repeated, ["leaf", "origin", "item", "repeat"])


def generate(
    requests: DataFrame,
    generator: Generator = template_generator,
    schema: str = GENERATED,
    batch_size: int = fixed.GENERATOR_BATCH,
    max_concurrency: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Run a user's generator over the requests in batches.

    Requests are few bytes and much work, so they are spread over all task
    slots first; a hash of the request id keeps a retried task's rows in place.
    ``max_concurrency`` limits how many batches are in flight at an endpoint.
    ``dealt`` requests are spread out already and stay where they are, unless that limit is given.
    """
    spread = requests if dealt and max_concurrency is None else _dealt(requests, max_concurrency)
    return run_generator(spread, generator, schema, batch_size)


def _dealt(requests: DataFrame, slots: int | None = None) -> DataFrame:
    return requests.repartition(slots or task_slots(requests.sparkSession), "request_id")


def resume_requests(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a stored result."""
    return requests.join(done.select("request_id"), "request_id", "left_anti")


def generate_resumable(
    requests: DataFrame,
    folder: str,
    generator: Generator = template_generator,
    schema: str = GENERATED,
    batch_size: int = fixed.GENERATOR_BATCH,
    slices: int = 1,
) -> DataFrame:
    """Generate what the folder lacks, slice by slice; each finished slice stays finished.

    Returns everything generated so far, read back from the folder. Requests are
    dealt out by their id once; what is stored meets them there, by its ids alone.
    """
    spark = requests.sparkSession
    done = spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else None
    if slices == 1:
        todo = _dealt(requests)
        if done is not None:
            # An anti join would be moved below the dealing, whose partitions Spark would then merge by their bytes.
            stored = done.select("request_id", F.col("request_id").alias("_stored"))
            todo = todo.join(stored, "request_id", "left").filter(F.col("_stored").isNull()).drop("_stored")
        run_generator(todo, generator, schema, batch_size).write.mode("append").parquet(folder)
        return spark.read.schema(schema).parquet(folder)
    todo = requests if done is None else resume_requests(requests, done)
    # Stored by slice, so that each slice reads its own requests only.
    queue = scratch_path(spark, "requests")
    number = F.pmod(F.xxhash64("request_id"), F.lit(slices)).cast("int")
    todo.withColumn("_slice", number).write.partitionBy("_slice").parquet(queue)
    queued = T.StructType([*todo.schema.fields, T.StructField("_slice", T.IntegerType())])
    for n in range(slices):
        part = spark.read.schema(queued).parquet(queue).filter(F.col("_slice") == n).drop("_slice")
        generate(part, generator, schema, batch_size).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def limit_tokens(
    df: DataFrame,
    max_tokens: int = fixed.MAX_GENERATED_TOKENS,
    text: str = "answer",
    tokenize: Callable = words,
) -> DataFrame:
    """Bound on what one request may generate; texts within it stay as they are."""
    cut = F.array_join(F.slice("_tokens", 1, max_tokens), " ")
    return (
        df.withColumn("_tokens", tokenize(F.col(text)))
        .withColumn(text, F.when(F.size("_tokens") > max_tokens, cut).otherwise(F.col(text)))
        .drop("_tokens")
    )


def to_training_messages(
    generated: DataFrame,
    test_percent: int = 10,
    system: str = fixed.DEFAULT_SYSTEM_PROMPT,
) -> DataFrame:
    """Generated pairs as message samples by ``kind`` (skills, knowledge), ``node`` and train or test.

    ``generated`` is ``(request_id, path, question, answer)``. The side is a
    function of the request id, so a resumed run keeps every row where it was.
    """
    kind = F.when(F.startswith("path", F.lit("knowledge/")), "knowledge").otherwise("skills")
    node = F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), F.lit("_"))
    number = F.conv(F.substring("request_id", 1, 6), 16, 10).cast("long") % 100
    return generated.select(
        "request_id",
        messages_of(F.lit(system), F.col("question"), F.col("answer")).alias("messages"),
        kind.alias("kind"),
        node.alias("node"),
        F.when(number < test_percent, "test").otherwise("train").alias("side"),
    )


def seed_word_budget(seeds: DataFrame, budget: int = fixed.SEED_WORD_BUDGET) -> DataFrame:
    """Words over the pairs of each seed file, flagged beyond the advised budget."""
    size = word_count(F.col("question")) + word_count(F.col("answer"))
    return seeds.groupBy("path").agg(F.sum(size).alias("words")).withColumn(
        "over_budget", F.col("words") > budget
    )
