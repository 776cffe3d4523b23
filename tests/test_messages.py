"""Layout conversions on the exact cases of the format."""

import pytest
from pyspark.sql import functions as F

from seedmill import fixed, schemas
from seedmill.operators import messages as ms
from seedmill.operators import sessions as ss

SYSTEM = {"role": "system", "content": "Answer in one line."}
USER = {"role": "user", "content": "Is the ferry late?"}
ASSISTANT = {"role": "assistant", "content": "By an hour."}


def dataset(spark, *samples):
    return spark.createDataFrame(
        [(list(s), "g7", "harbour-notes", "row 1") for s in samples], schemas.MESSAGE_SAMPLE
    )


def legacy(df):
    return [(r["system"], r["user"], r["assistant"]) for r in df.collect()]


def convert(df):
    return ms.to_legacy(df, order="metadata")


def test_pretraining_with_system(spark):
    text = {"role": "pretraining", "content": "<|user|>Which river runs through Ulm?<|assistant|>The Danube"}
    assert legacy(convert(dataset(spark, [SYSTEM, text]))) == [
        ("Answer in one line.", "Which river runs through Ulm?", "The Danube")
    ]


def test_pretraining_without_system(spark):
    text = {"role": "pretraining", "content": "<|user|>Which river runs through Ulm?<|assistant|>The Danube"}
    assert legacy(convert(dataset(spark, [text]))) == [("", "Which river runs through Ulm?", "The Danube")]


@pytest.mark.parametrize(
    "content,message",
    [
        ("<|user|>Which river? The Danube", r"<\|assistant\|>"),
        ("<|assistant|>The Danube", r"<\|user\|>"),
        ("<|assistant|>The Danube<|user|>late", "each token must occur once"),
        ("<|user|>a<|user|>b<|assistant|>c", "each token must occur once"),
        ("<|user|>a<|assistant|>b<|assistant|>c", "each token must occur once"),
        ("", "no pretraining text"),
    ],
)
def test_bad_pretraining_text(spark, content, message):
    df = dataset(spark, [{"role": "pretraining", "content": content}])
    with pytest.raises(Exception, match=message):
        convert(df).collect()
    kept = ms.pretraining_to_legacy(df, on_error="quarantine").first()
    assert kept["user"] is None and kept["error"]


def test_later_user_token_belongs_to_the_answer(spark):
    text = {"role": "pretraining", "content": "<|user|>q <|assistant|> see <|user|> here"}
    assert legacy(convert(dataset(spark, [text]))) == [("", "q ", " see <|user|> here")]


def test_standard_messages(spark):
    more = {"role": "user", "content": "and then?"}
    assert legacy(convert(dataset(spark, [SYSTEM, USER, ASSISTANT, more]))) == [
        (SYSTEM["content"], USER["content"], ASSISTANT["content"])
    ]


def test_repeated_role_keeps_the_last(spark):
    again = {"role": "user", "content": "second"}
    assert legacy(convert(dataset(spark, [USER, ASSISTANT, again]))) == [
        (None, "second", ASSISTANT["content"])
    ]


@pytest.mark.parametrize("keep", range(7))
def test_too_few_messages(spark, keep):
    chosen = [m for i, m in enumerate([SYSTEM, USER, ASSISTANT]) if keep >> i & 1]
    with pytest.raises(Exception, match="needs three messages"):
        convert(dataset(spark, chosen)).collect()


def test_empty_dataset(spark):
    empty = dataset(spark).limit(0)
    assert convert(empty).count() == 0
    assert ms.is_pretraining_dataset(empty, "metadata") is False
    with pytest.raises(ValueError, match="dataset is empty"):
        ms.is_messages_dataset(empty)


def test_legacy_passes_through(spark):
    df = spark.createDataFrame([("s", "u", "a")], schemas.LEGACY_SAMPLE)
    assert ms.to_legacy(df) is df
    assert not ms.is_messages_dataset(df)


def test_first_record_decides_the_kind(spark):
    text = {"role": "pretraining", "content": "<|user|>q<|assistant|>a"}
    rows = [([SYSTEM, USER, ASSISTANT], 1), ([text], 2)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, n int")
    assert not ms.is_pretraining_dataset(df, "n")
    with pytest.raises(Exception, match="needs three messages"):
        ms.to_legacy(df, order="n").collect()
    assert len(legacy(ms.to_legacy(df, per_row=True))) == 2


def test_prompt_text(spark):
    row = spark.range(1).select(
        ms.format_text(F.lit("S"), F.lit("U"), F.lit("A")).alias("text"),
        ms.format_prompt(F.lit("S"), F.lit("U")).alias("prompt"),
        ms.extract_response(F.lit("x<|assistant|>\n one <|assistant|>\n two \n")).alias("response"),
        ms.mask_to_response(F.lit("ab\n<|assistant|>\ncd")).alias("mask"),
        ms.mask_to_response(F.lit("nothing")).alias("no_mask"),
    ).first()
    assert row["text"] == "<|system|>\nS\n<|user|>\nU\n<|assistant|>\nA<|endoftext|>"
    assert row["prompt"] == "<|system|>\nS\n<|user|>\nU\n<|assistant|>"
    assert row["response"] == "two"
    assert tuple(row["mask"]) == (2 + len("\n<|assistant|>\n"), 2)
    assert tuple(row["no_mask"]) == (7, 0)


def test_system_prompt_by_architecture(spark):
    df = spark.createDataFrame([("llama",), ("other",), (None,)], "arch string")
    got = {r["arch"]: r["system"] for r in ms.with_system_prompt(df, {"llama": "L"}).collect()}
    assert got == {"llama": "L", "other": fixed.DEFAULT_SYSTEM_PROMPT, None: fixed.DEFAULT_SYSTEM_PROMPT}
    assert {r["system"] for r in ms.with_system_prompt(df, {}).collect()} == {fixed.DEFAULT_SYSTEM_PROMPT}


def test_multiple_choice_text(spark):
    got = spark.range(1).select(
        ms.render_multiple_choice(F.lit("  Why?\n"), F.array(*map(F.lit, "wxyz"))).alias("t")
    ).first()["t"]
    assert got == "Why?\nA. w\nB. x\nC. y\nD. z\nAnswer:"


def test_merge_system(spark):
    df = dataset(spark, [SYSTEM, USER, ASSISTANT], [USER, ASSISTANT], [SYSTEM])
    got = [
        [(m["role"], m["content"]) for m in r["m"]]
        for r in df.select(ms.merge_system_into_user(F.col("messages")).alias("m")).collect()
    ]
    assert got[0][0] == ("user", SYSTEM["content"] + "\n" + USER["content"])
    assert len(got[0]) == 2 and len(got[1]) == 2
    assert got[2] == [("system", SYSTEM["content"])]


@pytest.fixture
def turns(spark):
    text = ["aaaa", "bbb", "cc", "dddd", "e"]
    data = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(text)]
    data += [(2, 0, "user", "x" * 50)]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_sessions_in_parts_lose_nothing(turns, rows):
    parts = ms.collect_messages(turns, part_size=2)
    assert {(r["conv_id"], r["part"], len(r["messages"])) for r in parts.collect()} == {
        (1, 0, 2), (1, 1, 2), (1, 2, 1), (2, 0, 1),
    }
    back = ms.explode_messages(parts, part_size=2)
    assert rows(back) == rows(turns.withColumnRenamed("text", "content"))


@pytest.mark.parametrize("limit,kept", [(7, [2, 3, 4]), (6, [3, 4]), (4, [4]), (0, [4]), (14, [0, 1, 2, 3, 4])])
def test_trim_history(turns, limit, kept):
    got = ss.trim_history(turns, limit)
    assert sorted(r["turn"] for r in got.filter("conv_id = 1").collect()) == kept
    assert got.filter("conv_id = 2").count() == 1


def test_trim_history_compat_keeps_all_or_one(turns):
    assert ss.trim_history(turns, 13, compat=True).filter("conv_id = 1").count() == 1
    assert ss.trim_history(turns, 14, compat=True).filter("conv_id = 1").count() == 5


def test_previous_response(turns):
    for index, want in ((1, "e"), (2, "cc"), (3, None)):
        row = ss.previous_response(turns, index).filter("conv_id = 1").first()
        assert row["response"] == want
        assert (row["error"] is None) == (want is not None)
    with pytest.raises(ValueError):
        ss.previous_response(turns, 0)


def test_context_goes_before_its_question(spark, turns):
    context = spark.createDataFrame([(1, 2, "facts")], "conv_id long, turn long, context string")
    got = ss.augment_sessions(turns, context).filter("conv_id = 1").orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got][1:4] == [
        ("assistant", "bbb"), ("assistant", "facts"), ("user", "cc"),
    ]


def test_drop_oldest(turns):
    left = ss.drop_oldest(turns)
    assert sorted(r["turn"] for r in left.filter("conv_id = 1").collect()) == [1, 2, 3, 4]
    assert left.filter("conv_id = 2").count() == 1
