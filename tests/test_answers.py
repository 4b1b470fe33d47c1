from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnwise.config import INFERENCE_PROMPT, NEGATIVE_PHRASES, PREDICTION_KEYS, PREDICTION_LABELS
from turnwise.functions.answers import (
    answer_unless_mentioned,
    fill_prompt,
    predicted_label,
    score_amount,
    score_yes_no,
)
from turnwise.functions.structs import field_or_default, pick_by_label
from turnwise.functions.text import text_features
from turnwise.operators.classification import confusion_matrix
from turnwise.operators.joins import cross_prompts, label_by_key, pending_questions
from turnwise.operators.regression import standardise
from turnwise.plans.inference import inference_scores, inferred_labels
from turnwise.plans.prepare import features_per_conversation, utterance_features
from turnwise.plans.disparity import baselines, disparity, outcomes, overview
from turnwise.schemas import ANSWERS, QUESTIONS
from turnwise.sources.requests import build_requests, request_key, write_requests
from turnwise.sources.stages import load_stage, save_stage
from turnwise.sources.tables import read_csv, read_responses
from turnwise.streaming.incremental import (
    resume_answers,
    stored_questions,
    sufficient_statistics,
    update_statistics,
)


def value(spark, column, schema, *data):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_score_yes_no(spark):
    answers = [("Yes",), ("yes",), (" Yes",), (None,), ("no",)]
    assert value(spark, score_yes_no(F.col("a"), F.lit("yes")), "a STRING", *answers) == [1, 1, 0, 0, 0]
    assert value(spark, score_yes_no(F.col("a"), F.lit("yes"), trim=True), "a STRING", *answers) == [1, 1, 1, 0, 0]


def test_score_amount(spark):
    answers = [("$85,000 per year",), ("between 70,000 and 90,000",), ("85.5k",), ("no digits",), ("",), (None,), ("\n7",)]
    assert value(spark, score_amount(F.col("a")), "a STRING", *answers) == [85000.0, 70000.0, 85.0, None, None, None, 7.0]


def test_predicted_label(spark):
    content = [
        ('{"Age": "55+ years old", "English proficiency": "Non-Native speaker"}',),
        ("English proficiency: Non-Native speaker, maybe Native speaker",),
        ('{"Age": "unknown"}',),
        (None,),
    ]
    column = predicted_label(
        F.col("c"), PREDICTION_KEYS["english_proficiency"], PREDICTION_LABELS["english_proficiency"]
    )
    assert value(spark, column, "c STRING", *content) == ["Non-Native speaker", "Non-Native speaker", None, None]
    ethnicity = predicted_label(F.col("c"), "Race/Ethnicity", PREDICTION_LABELS["ethnicity"])
    said = ('{"Religion": "White", "Race/Ethnicity": "Black"}',)
    assert value(spark, ethnicity, "c STRING", said) == ["Black"]


def test_answer_unless_mentioned(spark):
    questions = [(f"so {NEGATIVE_PHRASES[0]}?",), ("what now?",), (None,)]
    column = answer_unless_mentioned(F.col("q"), NEGATIVE_PHRASES)
    assert value(spark, column, "q STRING", *questions) == ["no", "yes", "yes"]


def test_field_or_default_and_pick(spark):
    df = spark.createDataFrame([((1,),), ((None,),), (None,)], "s STRUCT<x: INT>")
    got = [r[0] for r in df.select(field_or_default(F.col("s"), "x", -1)).collect()]
    assert sorted(got, key=repr) == [-1, 1, None]
    picked = pick_by_label(F.col("l"), {"a": F.lit("A"), "b": F.lit("B")})
    assert value(spark, picked, "l STRING", ("response_b",), (None,), ("response_z",)) == ["B", None, None]


def test_fill_prompt_keeps_markers_in_the_text(spark):
    text = "user: {conversation} \\1 $2"
    filled = value(spark, fill_prompt(INFERENCE_PROMPT, F.col("t")), "t STRING", (text,))[0]
    assert filled == INFERENCE_PROMPT.replace("{conversation}", text, 1)


@pytest.mark.parametrize("limit", [1000, 3])
def test_cross_prompts_pairs_everything(spark, limit):
    conversations = spark.range(20).withColumnRenamed("id", "conversation_id")
    questions = spark.range(7).select(F.col("id").alias("q_id"), F.concat(F.lit("q"), "id").alias("question"))
    got = cross_prompts(conversations, questions, limit=limit, salts=4)
    pairs = {(r.conversation_id, r.q_id, r.question) for r in got.collect()}
    assert got.count() == 140
    assert pairs == {(c, q, f"q{q}") for c in range(20) for q in range(7)}
    assert cross_prompts(conversations, questions.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [1 << 21, 30])
def test_label_by_key_in_one_shard_or_many(spark, chars):
    texts = ["the red fox runs home tonight", "ab", "", None, "a red fox", "x" * 50 + "needle in hay" + "y" * 50, "the red fo"]
    keys = ["the red fox runs", "the red fox runs home", "ab", "needle in hay", "zebra crossing", "b"]
    questions = spark.createDataFrame(list(enumerate(texts)), "i INT, question STRING")
    key_rows = spark.createDataFrame([(k,) for k in keys], "key STRING")
    got = {r.i: r.correct_answer for r in label_by_key(questions, key_rows, shard_chars=chars).collect()}
    expected = {i: "yes" if t is not None and any(k in t for k in keys) else "no" for i, t in enumerate(texts)}
    assert got == expected


def test_label_by_key_of_many_keys(spark):
    """More than a million characters of keys; keys inside each other; no keys; the empty key."""
    keys = spark.range(60_000).select(F.concat(F.lit("key "), F.sha1(F.col("id").cast("string"))).alias("key"))
    held = F.concat(F.lit("... key "), F.sha1((F.col("id") * 7).cast("string")), F.lit(" ..."))
    texts = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, held).otherwise("... key none").alias("question"))
    got = {r.id: r.correct_answer for r in label_by_key(texts, keys).collect()}
    assert got == {i: "yes" if i % 3 == 0 else "no" for i in range(200)}
    assert label_by_key(texts, keys.limit(0)).filter("correct_answer = 'yes'").count() == 0
    empty = spark.createDataFrame([("",), (None,)], "key STRING")
    assert label_by_key(texts, empty).filter("correct_answer = 'yes'").count() == 200


def test_label_by_key_moves_no_text(spark):
    keys = spark.createDataFrame([("a",)], "key STRING")
    texts = spark.createDataFrame([(1, "xay")], "i INT, question STRING")
    plan = label_by_key(texts, keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pending_questions_null_keys(spark):
    questions = spark.createDataFrame([("q_0",), ("q_1",)], "q_id STRING")
    answers = spark.createDataFrame([("q_1",), ("q_1",), (None,)], "q_id STRING")
    assert [r.q_id for r in pending_questions(questions, answers).collect()] == ["q_0"]


def test_resume_answers(spark, tmp_path):
    path = str(tmp_path / "answers")
    schema = "conversation_id INT, answer STRING, q_id STRING"
    questions = spark.createDataFrame([("q_0",), ("q_1",)], "q_id STRING")
    asked = []

    def answer(pending):
        asked.append(sorted(r.q_id for r in pending.collect()))
        return pending.select(F.lit(1).alias("conversation_id"), F.lit("yes").alias("answer"), "q_id")

    resume_answers(questions.limit(1), path, schema, answer)
    resume_answers(questions, path, schema, answer)
    resume_answers(questions, path, schema, answer)
    assert asked == [["q_0"], ["q_1"], []]
    assert stored_questions(spark, path, schema).count() == 2


def test_statistics_add_and_remove(spark, rows):
    df = spark.createDataFrame([("a", float(i * i % 17), i % 3) for i in range(30)], "k STRING, v DOUBLE, part INT")
    of = lambda *p: sufficient_statistics(df.filter(F.col("part").isin(*p)), ["k"], "v")
    added = update_statistics(of(0), of(1, 2), ["k"])
    assert rows(added, 6) == rows(of(0, 1, 2), 6)
    removed = update_statistics(of(0, 1, 2), of(2), ["k"], remove=True)
    assert rows(removed, 6) == rows(of(0, 1), 6)
    assert update_statistics(of(1), of(1), ["k"], remove=True).count() == 0


def test_requests_and_responses_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("c 1", 'user: say "hi"\nassistant: ü')], "conversation_id STRING, conversation_text STRING")
    path = str(tmp_path / "requests")
    write_requests(build_requests(texts, "m", template="<{conversation}>"), path)
    line = spark.read.text(path).first().value
    assert '"custom_id":"request-c 1"' in line and '"reasoning":{"enabled":false}' in line
    out = tmp_path / "responses.jsonl"
    out.write_text('{"custom_id":"request-c 1","response":{"body":{"choices":[{"message":{"content":"A"}},{"message":{"content":"B"}}]}}}\n'
                   '{"custom_id":"request-c 2","response":{"body":{"choices":[]}}}\n')
    got = read_responses(spark, str(out)).withColumn("id", request_key(F.col("custom_id")))
    assert {r.id: r.content for r in got.collect()} == {"c 1": "A", "c 2": None}


def test_stage_partitions_and_ignore(spark, tmp_path, rows):
    path = str(tmp_path / "stage")
    df = spark.createDataFrame([("m", "legal", 1), ("n", "legal", 2)], "model STRING, domain STRING, v INT")
    save_stage(df, path)
    save_stage(df.limit(0), path, mode="ignore")
    loaded = load_stage(spark, path)
    assert rows(loaded.select("model", "v")) == [("m", 1), ("n", 2)]
    assert "PartitionFilters: [isnotnull(model" in loaded.filter("model = 'm'")._jdf.queryExecution().toString()


def test_csv_with_line_breaks(spark, tmp_path):
    file = tmp_path / "prompts.csv"
    file.write_text('id,prompts,extra\n1,"a ""quoted"", two\nlines",x\n')
    got = read_csv(spark, str(file), "id INT, prompts STRING, extra STRING", ["id", "prompts"], multiline=True)
    assert [tuple(r) for r in got.collect()] == [(1, 'a "quoted", two\nlines')]


def study(spark):
    questions = spark.createDataFrame(
        [("q_0", "?", "yes", "Yes", "legal"), ("q_1", "?", "no", "yes", "legal"), ("q_2", "?", None, "$60,000", "salary")],
        QUESTIONS,
    )
    answers = []
    for c in range(8):
        answers += [
            ("m", "d", "plain", f"c{c}", "q_0", "Yes" if c % 2 else "no"),
            ("m", "d", "plain", f"c{c}", "q_1", None if c == 3 else "No"),
            ("m", "d", "plain", f"c{c}", "q_2", "none" if c == 0 else f"${c},000"),
        ]
    return questions, spark.createDataFrame(answers, ANSWERS)


def test_outcomes_and_baselines(spark, rows):
    questions, answers = study(spark)
    got = {(r.conversation_id, r.domain): r.outcome for r in outcomes(answers, questions, ["model", "conversation_id"]).collect()}
    assert got[("c0", "legal")] == 50.0 and got[("c1", "legal")] == 100.0 and got[("c3", "legal")] == 50.0
    assert got[("c5", "salary")] == 5000.0 and ("c0", "salary") not in got
    base = baselines(questions.withColumn("model", F.lit("m")))
    assert rows(base) == [("m", "legal", 50.0), ("m", "salary", 60000.0)]
    some = baselines(questions.withColumn("model", F.lit("m")), excluded=["q_1"])
    assert ("m", "legal", 100.0) in rows(some)


def test_outcomes_use_the_bank_of_the_model(spark):
    questions = spark.createDataFrame(
        [("m1", None, "q", "legal", "yes"), ("m2", None, "q", "legal", "no")],
        "model STRING, condition STRING, q_id STRING, domain STRING, correct_answer STRING",
    )
    answers = spark.createDataFrame(
        [("m1", None, "c", "q", "Yes"), ("m2", None, "c", "q", "No")],
        "model STRING, condition STRING, conversation_id STRING, q_id STRING, answer STRING",
    )
    got = {r.model: r.outcome for r in outcomes(answers, questions, ["model", "conversation_id"]).collect()}
    assert got == {"m1": 100.0, "m2": 100.0}
    with pytest.raises(Exception, match="question listed twice"):
        outcomes(answers, questions.union(questions), ["model", "conversation_id"]).collect()


def test_null_keys_are_keys(spark):
    labels = spark.createDataFrame([(None, "a", "a"), (None, "a", "b"), ("k", "b", "b")], "k STRING, t STRING, p STRING")
    counts = {(r.k, r.true, r.predicted): r.n for r in confusion_matrix(labels, ["k"], "t", "p").collect()}
    assert counts[(None, "a", "a")] == 1 and counts[(None, "a", "b")] == 1 and counts[("k", "b", "b")] == 1
    values = spark.createDataFrame([(None, 1.0), (None, 3.0)], "k STRING, v DOUBLE")
    state = sufficient_statistics(values, ["k"], "v")
    assert [(r.k, r.n, r["mean"]) for r in update_statistics(state, state, ["k"]).collect()] == [(None, 4, 2.0)]
    assert standardise(values, ["v"], ["k"]).count() == 2


def test_resume_keeps_models_apart(spark, tmp_path):
    schema = "model STRING, q_id STRING, answer STRING"
    answer = lambda q: q.select("model", F.lit("yes").alias("answer"), "q_id")
    path = str(tmp_path / "answers")
    for model in ("a", "b", "b"):
        bank = spark.createDataFrame([(model, "q1"), (model, "q2")], "model STRING, q_id STRING")
        resume_answers(bank, path, schema, answer, batches=2)
    assert sorted(r.model for r in spark.read.parquet(path).collect()) == ["a", "a", "b", "b"]


def test_disparity_overview(spark):
    data = [(f"c{i}", "annotator", i % 2 and "A" or "B", 10.0 * (i % 2) + i * 0.01, "legal") for i in range(20)]
    data += [("x", "annotator", "Other", 1e9, "legal"), ("y", "annotator", None, 1e9, "legal")]
    df = spark.createDataFrame(data, "conversation_id STRING, model STRING, annotator_age STRING, outcome DOUBLE, domain STRING")
    row = overview(disparity(df, ["model", "domain"], ["annotator_age"])).first()
    assert row.demo == "age" and row["diff"] and row.n_groups == 2 and row.n_total == 20
    assert abs(row.diff_mean - 10.01) < 1e-9


def test_text_features(spark):
    text = "The cat sat. The hmm 42 dogs ran!"
    df = spark.createDataFrame([(0, text, "en"), (1, "", "en"), (2, text, "it"), (3, text, "xx")], "i INT, user_prompt STRING, lang STRING")
    got = {r.i: r for r in text_features(df, "user_prompt", {"en": ["the"]}, F.col("lang")).collect()}
    r = got[0]
    assert (r.num_tokens_user_prompt, r.num_sents_user_prompt) == (10, 2)
    assert (r.num_unique_lemmas_user_prompt, r.num_stop_words_user_prompt, r.num_punctuation_user_prompt) == (9, 2, 2)
    assert r.avg_sent_len_user_prompt == 3.5 and r.type_to_token_ratio_user_prompt == 0.9
    assert r.avg_num_syllables_user_prompt == 1.0
    assert abs(r.flesch_reading_ease_user_prompt - (206.835 - 1.015 * 3.5 - 84.6)) < 1e-9
    assert got[1].avg_sent_len_user_prompt is None and got[1].num_tokens_user_prompt == 0
    assert got[2].num_stop_words_user_prompt == 0 and got[2].flesch_reading_ease_user_prompt is not None
    assert got[3].avg_num_syllables_user_prompt is None and got[3].flesch_reading_ease_user_prompt is None


def test_label_inference(spark):
    content = {
        1: '{"Age": "18-34 years old", "Gender": "Female"}',
        2: "Age: 55+ years old, Gender: Male",
        3: '{"Age": "35-54 years old", "Gender": "Male"}',
        4: "no idea",
    }
    responses = spark.createDataFrame([(f"request-{i}", c) for i, c in content.items()], "custom_id STRING, content STRING")
    data = [(1, "25-34 years old", "Female"), (2, "65+ years old", "Prefer not to say"), (3, "55-64 years old", "Male"), (4, "65+ years old", "Male")]
    people = spark.createDataFrame(data, "conversation_id BIGINT, age STRING, gender STRING")
    labels = {d: PREDICTION_LABELS[d] for d in ("age", "gender")}
    rows_ = inferred_labels(responses, people, labels=labels)
    got = sorted((r.conversation_id, r.demo, r.true, r.predicted) for r in rows_.collect())
    assert got == [
        ("1", "age", "18-34 years old", "18-34 years old"), ("1", "gender", "Female", "Female"),
        ("2", "age", "55+ years old", "55+ years old"),
        ("3", "age", "55+ years old", "35-54 years old"), ("3", "gender", "Male", "Male"),
    ]
    scores = {r.demo: r for r in inference_scores(rows_).collect()}
    assert abs(scores["age"].f1 - 2 / 3) < 1e-12 and abs(scores["age"].majority_f1 - 2 / 3) < 1e-12
    assert scores["gender"].f1 == 1.0 and scores["gender"].majority_f1 == 0.5


def test_inference_scores_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def guess(label):
        made.add(1)
        return label if label == "a" else "b"

    data = [(str(i), demo, "abc"[i % 3]) for i in range(30) for demo in ("age", "gender")]
    rows_ = spark.createDataFrame(data, "conversation_id STRING, demo STRING, true STRING")
    rows_ = rows_.withColumn("predicted", F.udf(guess, "string")("true"))
    scores = {r.demo: r for r in inference_scores(rows_).collect()}
    assert made.value == len(data)
    for r in scores.values():
        assert abs(r.f1 - 2 / 3) < 1e-12 and abs(r.majority_f1 - 1 / 3) < 1e-12 and r.majority_better


def test_features_per_conversation(spark):
    data = [
        ("c1", 0, "f", "jobs", "One two.", "Yes.", "polite", 0.5),
        ("c1", 1, "f", "jobs", "One two three four.", "", "impolite", 0.7),
        ("c2", 0, None, "jobs", "x", "y", "neutral", 0.1),
    ]
    utterances = spark.createDataFrame(
        data,
        "conversation_id STRING, turn INT, gender STRING, topic STRING, user_prompt STRING, model_response STRING, "
        "politeness_user_prompt STRING, s_neutral_user_prompt DOUBLE",
    )
    features = utterance_features(utterances, {"en": ["one"]})
    row = features_per_conversation(features, ["gender"]).collect()
    assert len(row) == 1 and row[0].conversation_id == "c1" and "s_neutral_user_prompt" not in row[0]
    assert row[0].num_tokens_user_prompt == 4.0 and row[0].politeness_user_prompt == 0.5
    assert row[0].num_stop_words_user_prompt == 1.0 and row[0].avg_sent_len_model_response == 1.0
