"""Functions for SQL callers. Their bodies are SQL, so they stay in the JVM.

They return arrays: select one in a subquery and put ``LATERAL VIEW posexplode``
on it. A SQL table function under ``LATERAL`` would be planned as a join on the
text itself.
"""

from pyspark.sql import SparkSession

from seedmill import fixed

_BLANKS = "".join(f"\\u{ord(c):04X}" for c in fixed.WHITESPACE)
_WORDS = f"array_remove(split(trim(BOTH '{_BLANKS}' FROM body), r'{fixed.BLANKS_PATTERN}'), '')"

DEFINITIONS = (
    f"""CREATE OR REPLACE TEMPORARY FUNCTION words_of(body STRING)
RETURNS ARRAY<STRING> RETURN {_WORDS}""",
    # The words are bound once by the outer transform; the inner one only slices them.
    f"""CREATE OR REPLACE TEMPORARY FUNCTION chunks_of(body STRING, width INT)
RETURNS ARRAY<STRING> RETURN element_at(transform(array({_WORDS}), w ->
  CASE WHEN size(w) = 0 THEN CAST(array() AS ARRAY<STRING>)
  ELSE transform(sequence(0, size(w) - 1, width), i -> array_join(slice(w, i + 1, width), ' ')) END), 1)""",
)


def register(spark: SparkSession) -> None:
    for definition in DEFINITIONS:
        spark.sql(definition)
