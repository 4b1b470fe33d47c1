from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.config import RESPONSE_LETTERS, TURNS
from turnwise.functions import turns as nested
from turnwise.operators.ordered import by_value, sums_before, value_buckets
from turnwise.operators.turns import chosen_first, collapse_same_role, until_first_missing
from turnwise.plans import prepare
from turnwise.schemas import CONVERSATIONS, SURVEY, UTTERANCES

HISTORY = [
    ("user", "hi", None),
    ("model", "a", False),
    ("model", "b", True),
    ("user", "more", None),
    ("model", "c", False),
    ("user", "again", None),
    ("model", "d", True),
]


def conversations(spark, history=HISTORY):
    return spark.createDataFrame([("u1", "c1", history), ("u2", "c2", [])], CONVERSATIONS)


def survey(spark):
    data = [
        ("u1", "18-24 years old", "Male", None, None, None, None, None, ("Christian",), None, ("Europe", None)),
        ("u2", "65+ years old", "Female", None, None, None, None, None, None, (None,), None),
    ]
    return spark.createDataFrame(data, SURVEY)


def test_survey_conversations(spark):
    out = {r.conversation_id: r for r in prepare.survey_conversations(conversations(spark), survey(spark)).collect()}
    # The unchosen answer between two user turns leaves a run of one role; its first turn stays.
    assert [(m.role, m.content) for m in out["c1"].messages] == [
        ("user", "hi"), ("assistant", "b"), ("user", "more"), ("assistant", "d"),
    ]
    assert out["c2"].messages == []
    assert (out["c1"].religion, out["c1"].ethnicity) == ("Christian", "Prefer not to say")
    assert (out["c2"].religion, out["c2"].ethnicity) == ("Prefer not to say", None)
    assert (out["c1"].birth_region, out["c1"].reside_region) == ("Europe", None)
    assert out["c2"].birth_region == "Prefer not to say"


def test_typed_messages_and_prompt(spark):
    df = conversations(spark).filter("conversation_id = 'c1'")
    typed = nested.to_messages(nested.select_turns(F.col("conversation_history")), typed=True)
    full = nested.with_prompt(typed, F.lit("Why?"), "Be fair.", typed=True)
    messages = df.select(full.alias("m")).first().m
    assert (messages[0].role, messages[0].content[0].text) == ("system", "Be fair.")
    assert (messages[-1].content[0].type, messages[-1].content[0].text) == ("text", "Why?")
    text = nested.conversation_text(nested.to_messages(nested.select_turns(F.col("conversation_history"))))
    assert df.select(text.alias("t")).first().t.startswith("user: hi\nassistant: b\nuser: more")


def test_utterances_first_non_null_per_column(spark):
    data = [
        ("c1", "u1", 0, True, None, "late", 2),
        ("c1", "u1", 0, True, "prompt", None, 1),
        ("c1", "u1", 0, False, "unchosen", "unchosen", 0),
        ("c1", "u1", 1, True, "p1", "r1", 3),
    ]
    utterances = spark.createDataFrame(data, UTTERANCES)
    out = prepare.survey_utterances(utterances, survey(spark)).orderBy("turn").collect()
    assert [(r.turn, r.user_prompt, r.model_response) for r in out] == [(0, "prompt", "late"), (1, "p1", "r1")]
    assert out[0].age == "18-24 years old"


def wide_table(spark):
    columns = ["conversation_id", "assigned_lang"]
    values = {
        "c1": {"first": "response_b", "second": "response_a", "third": None, "fourth": "response_c"},
        "c2": {"first": "", "second": None, "third": None, "fourth": None},
        "c3": {"first": "response_d", "second": "NaN", "third": None, "fourth": None},
    }
    rows = []
    for conversation, labels in values.items():
        row = [conversation, "fr" if conversation == "c3" else "en"]
        for turn in TURNS:
            row += [f"{conversation} {turn}?" if labels[turn] or turn == "first" else None, labels[turn], f"f {turn}"]
            row += [f"{turn} {letter}" for letter in RESPONSE_LETTERS]
        rows.append(tuple(row))
    for turn in TURNS:
        columns += [f"{turn}_turn_prompt", f"{turn}_turn_preferred_response", f"{turn}_turn_feedback"]
        columns += [f"{turn}_turn_response_{letter}" for letter in RESPONSE_LETTERS]
    return spark.createDataFrame(rows, ", ".join(f"{c} STRING" for c in columns))


def test_wide_conversations_stop_at_first_missing_label(spark):
    out = {r.conversation_id: r.messages for r in prepare.wide_conversations(wide_table(spark)).collect()}
    assert [m.content for m in out["c1"]] == ["c1 first?", "first b", "c1 second?", "second a"]
    assert out["c2"] == []
    assert [m.content for m in out["c3"]] == ["c3 first?", "first d"]


def test_wide_utterances_equal_three_melts(spark, rows):
    wide = wide_table(spark)
    got = prepare.wide_utterances(wide, ["conversation_id"])
    expected = []
    for r in wide.filter("assigned_lang = 'en'").collect():
        for turn in TURNS:
            prompt, label = r[f"{turn}_turn_prompt"], r[f"{turn}_turn_preferred_response"]
            if prompt is not None:
                response = r[f"{turn}_turn_response_{label[-1]}"] if label else None
                expected.append((r.conversation_id, turn, prompt, response, f"f {turn}"))
    assert rows(got) == sorted(expected, key=repr)


@pytest.fixture
def many_ranges(spark):
    """Small ranges are not joined, so values are handed on between them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30), st.sampled_from(["user", "assistant", None])), max_size=40))
def test_collapse_keeps_run_starts(spark, many_ranges, data):
    unique = {(c, t): r for c, t, r in data}
    table = [(c, t, r) for (c, t), r in unique.items()]
    df = spark.createDataFrame(table, "conversation_id STRING, turn INT, role STRING")
    got = {(r.conversation_id, r.turn) for r in collapse_same_role(df).collect()}
    expected = set()
    for c in "ab":
        before = object()
        for turn, role in sorted((t, r) for cc, t, r in table if cc == c):
            if before.__class__ is object and role is None:
                pass  # a first turn without a role has no earlier role to differ from
            elif role != before:
                expected.add((c, turn))
            before = role
    assert got == expected


@pytest.mark.parametrize("first_missing", [0, 7, 63, 199, None])
def test_until_first_missing_across_ranges(spark, rows, many_ranges, first_missing):
    data = [("a", i, i != first_missing) for i in range(200)] + [("b", i, True) for i in range(5)] + [("c", 0, None)]
    data += [(None, i, i < 3) for i in range(6)]
    df = spark.createDataFrame(data, "conversation_id STRING, turn INT, ok BOOLEAN")
    got = until_first_missing(df, F.col("ok")).select("conversation_id", "turn")
    left = 200 if first_missing is None else first_missing
    expected = [("a", i) for i in range(left)] + [("b", i) for i in range(5)] + [(None, i) for i in range(3)]
    assert rows(got) == sorted(expected, key=repr)


def test_hot_key_with_a_sparse_order(spark, rows, many_ranges):
    """One key holds most rows, at times far apart; it lies in several ranges and no table of keys is made."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("conversation_id"),
        (F.timestamp_seconds(F.col("id") * 86_400 * 37)).alias("turn"), F.concat(F.lit("r"), F.floor(F.col("id") / 7) % 2).alias("role"), "id",
    )
    got = collapse_same_role(df)
    before = F.lag("role").over(Window.partitionBy("conversation_id").orderBy("turn"))
    expected = df.withColumn("before", before).filter(~F.col("role").eqNullSafe(F.col("before"))).select("id")
    assert rows(got.select("id")) == rows(expected)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    ranges = got.select(F.spark_partition_id().alias("p"), "conversation_id").filter("conversation_id = 'hot'").distinct()
    assert ranges.count() > 1


def test_scans_of_nothing(spark, many_ranges):
    df = spark.createDataFrame([], "conversation_id STRING, turn INT, role STRING")
    assert collapse_same_role(df).count() == 0 and until_first_missing(df, F.lit(True)).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_sums_before_equal_one_window(spark, rows, buckets):
    df = spark.range(200).select(
        (F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"), "id"
    )
    bucketed = by_value(df, "v", value_buckets(df, "v", buckets))
    got = sums_before(bucketed, ["k"], ["v", "id"], {"m": F.col("id")})
    window = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select("id", F.coalesce(F.sum("id").over(window), F.lit(0)).alias("m_before"))
    assert rows(got.select("id", "m_before")) == rows(expected)


def test_chosen_first_drops_groups_without_chosen_rows(spark, rows):
    df = spark.createDataFrame([(1, 1, "x", False), (2, 1, "y", True)], "k INT, o INT, v STRING, c BOOLEAN")
    assert rows(chosen_first(df, ["k"], "o", ["v"], F.col("c"))) == [(2, "y")]
