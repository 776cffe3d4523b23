"""Record layouts shared by the readers, the operators and the writers."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("content", T.StringType()), T.StructField("role", T.StringType())]
)

MESSAGE_SAMPLE = T.StructType(
    [
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("group", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

LEGACY_SAMPLE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("system", "user", "assistant")]
)

INPUTS_TARGETS = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("inputs", "targets")]
)

PAIR = T.StructType(
    [T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]
)

SEED_EXAMPLE = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("questions_and_answers", T.ArrayType(PAIR)),
    ]
)

DOCUMENT_SOURCE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("patterns", T.ArrayType(T.StringType())),
    ]
)

SEED_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("task_description", T.StringType()),
        T.StructField("document_outline", T.StringType()),
        T.StructField("seed_examples", T.ArrayType(SEED_EXAMPLE)),
        T.StructField("document", DOCUMENT_SOURCE),
        T.StructField("parse_error", T.StringType()),
        T.StructField("mistyped", T.ArrayType(T.StringType())),
    ]
)

# The hash of a source file is an unsigned 64-bit number, so BIGINT is too small for it.
CHUNK_ORIGIN = T.StructType(
    [
        T.StructField("mimetype", T.StringType()),
        T.StructField("binary_hash", T.DecimalType(20, 0)),
        T.StructField("filename", T.StringType()),
    ]
)

CONVERTED_DOCUMENT = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("origin", CHUNK_ORIGIN),
        T.StructField(
            "texts",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

LEGACY_CONVERTED_DOCUMENT = T.StructType(
    [
        T.StructField("_name", T.StringType()),
        T.StructField(
            "file-info",
            T.StructType(
                [
                    T.StructField("filename", T.StringType()),
                    T.StructField("document-hash", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "main-text",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

QUESTION = T.StructType(
    [
        T.StructField("user_input", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

CHOICE_QUESTION = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
    ]
)

JOB = T.StructType(
    [
        T.StructField("pid", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("log_file", T.StringType()),
        T.StructField("children_pids", T.ArrayType(T.LongType())),
        T.StructField("start_time", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("end_time", T.StringType()),
    ]
)
