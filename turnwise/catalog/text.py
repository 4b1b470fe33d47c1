"""Scalar functions, nested turns and text features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from turnwise.catalog.registry import OUTCOMES, query, rounded, sql_hash_mod
from turnwise.functions import turns as nested
from turnwise.functions.answers import (
    answer_unless_mentioned,
    extract_label,
    fill_prompt,
    score_amount,
    score_yes_no,
)
from turnwise.functions.numeric import percent_change, ratio
from turnwise.functions.sampling import hash_mod
from turnwise.functions.text import text_features
from turnwise.operators.importance import short_name
from turnwise.operators.joins import attach_topics
from turnwise.operators.lexicon import category_rates, category_rates_long, concreteness
from turnwise.operators.scoring import best_label, score_batch, scores_to_columns
from turnwise.operators.turns import nest_turns
from turnwise.plans.prepare import recode_politeness
from turnwise.sources.requests import request_key
from turnwise.sources.tables import spread

WITH_OUT = f"WITH {OUTCOMES} "


@query(
    "str1_literal_replace",
    """SELECT conv_id, turn, replace(role, 'assistant', 'model') AS role, replace(text, ',', '') AS text
    FROM conversations""",
)
def _(t):
    return t.conversations.select(
        "conv_id",
        "turn",
        F.replace("role", F.lit("assistant"), F.lit("model")).alias("role"),
        F.replace("text", F.lit(","), F.lit("")).alias("text"),
    )


@query(
    "str2_score_yes_no",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 0 WHEN lower(upper(event_type)) = 'view' THEN 1
      ELSE 0 END AS score FROM events""",
)
def _(t):
    answer = F.when(F.col("event_type") != "click", F.upper("event_type"))
    return t.events.select("event_id", score_yes_no(answer, F.lit("view")).alias("score"))


@query(
    "str3_score_amount",
    """SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '^[^0-9]*([0-9]+)', 1), '')
      AS DOUBLE) AS amount FROM documents""",
)
def _(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", score_amount(F.col("text")).alias("amount"))


@query(
    "str4_extract_label",
    WITH_OUT
    + """SELECT conversation_id, CASE WHEN segment = 'BUILDING' THEN 'BUILDING'
      WHEN region IN ('ASIA', 'EUROPE') THEN region END AS label FROM out""",
)
def _(t):
    said = F.concat_ws(" / ", "segment", "region", "status")
    label = extract_label(said, ["ASIA", "EUROPE", "BUILDING"])
    return t.outcomes.select("conversation_id", label.alias("label"))


@query(
    "str5_answer_unless_mentioned",
    """SELECT doc_id, CASE WHEN contains(text, 'tion') OR contains(text, 'keit') THEN 'no' ELSE 'yes' END AS key
    FROM documents""",
)
def _(t):
    key = answer_unless_mentioned(F.col("text"), ["tion", "keit"])
    return spread(t.documents.select("doc_id", "text")).select("doc_id", key.alias("key"))


@query(
    "str6_parse_id",
    "SELECT c_custkey, CAST(split_part(c_name, '#', 2) AS BIGINT) AS id, c_custkey AS request FROM customer",
)
def _(t):
    request = request_key(F.concat(F.lit("request-"), "c_custkey")).cast("bigint")
    return t.customer.select(
        "c_custkey",
        F.split_part("c_name", F.lit("#"), F.lit(2)).cast("bigint").alias("id"),
        request.alias("request"),
    )


@query(
    "str7_name_parts",
    """SELECT p_partkey, right(p_brand, 1) AS last, starts_with(p_name, 's') AS is_s,
      contains(p_name, 'ring') AS is_ring, left('name of ' || p_name || ' ' || p_type || ' ' || p_brand, 20) AS short,
      left(p_brand || ' ' || p_name || ' is a part of the type ' || p_type, 50) AS stripped FROM part""",
)
def _(t):
    named = F.concat(F.lit("name of "), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand")
    feature = F.concat(
        F.lit("dummy_"), "p_brand", F.lit(" "), "p_name", F.lit(" is a part of the type "), "p_type"
    )
    return t.part.select(
        "p_partkey",
        F.right("p_brand", F.lit(1)).alias("last"),
        F.startswith("p_name", F.lit("s")).alias("is_s"),
        F.contains("p_name", F.lit("ring")).alias("is_ring"),
        F.left(named, F.lit(20)).alias("short"),
        short_name(feature).alias("stripped"),
    )


@query(
    "str8_prompt_template",
    """SELECT conv_id, turn, 'Conversation: "' || text || '"' || chr(10) || 'Answer:' AS prompt FROM conversations""",
)
def _(t):
    template = 'Conversation: "{conversation}"\nAnswer:'
    return t.conversations.select("conv_id", "turn", fill_prompt(template, F.col("text")).alias("prompt"))


def _histories(t):
    """Nested histories; every third assistant turn was not chosen."""
    turns = t.turns.select(
        "conversation_id",
        "turn",
        F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"),
        "content",
        ((F.col("role") == "assistant") & (F.col("turn") % 3 != 0)).alias("if_chosen"),
    )
    return nest_turns(turns, fields=["role", "content", "if_chosen"])


_CHOSEN = """chosen AS (SELECT conv_id, turn, role, text FROM conversations
  WHERE role = 'user' OR (role = 'assistant' AND turn % 3 <> 0))"""


@query(
    "arr1_select_turns",
    f"""WITH {_CHOSEN} SELECT conv_id AS conversation_id,
      CAST(count(c.turn) AS INT) AS n_turns, string_agg(c.role, ',' ORDER BY c.turn) AS roles
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN chosen c USING (conv_id) GROUP BY 1""",
)
def _(t):
    kept = nested.to_messages(nested.select_turns(F.col("turns")))
    return _histories(t).select("conversation_id", kept.alias("m")).select(
        "conversation_id",
        F.size("m").alias("n_turns"),
        F.nullif(F.array_join(F.transform("m", lambda x: x["role"]), ","), F.lit("")).alias("roles"),
    )


@query(
    "arr2_typed_messages",
    f"""WITH {_CHOSEN} SELECT conv_id AS conversation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos,
      role, 'text' AS type, text FROM chosen""",
)
def _(t):
    typed = nested.to_messages(nested.select_turns(F.col("turns")), typed=True)
    return (
        _histories(t)
        .select("conversation_id", F.posexplode(typed).alias("pos", "m"))
        .select(
            "conversation_id",
            "pos",
            "m.role",
            F.col("m.content")[0]["type"].alias("type"),
            F.col("m.content")[0]["text"].alias("text"),
        )
    )


@query(
    "arr3_turns_from_columns",
    WITH_OUT
    + """, r AS (
      SELECT conversation_id, 0 AS round, segment AS prompt, CASE status WHEN 'F' THEN region ELSE topic END AS response FROM out
      UNION ALL SELECT conversation_id, 1, region, CASE status WHEN 'F' THEN region ELSE topic END FROM out WHERE status <> 'P'
      UNION ALL SELECT conversation_id, 2, topic, CASE status WHEN 'F' THEN region ELSE topic END FROM out WHERE status = 'O')
    SELECT conversation_id, CAST(2 * round AS INT) AS pos, 'user' AS role, prompt AS content FROM r
    UNION ALL SELECT conversation_id, CAST(2 * round + 1 AS INT), 'assistant', response FROM r""",
)
def _(t):
    label = F.when(F.col("status") == "F", "response_a").otherwise("response_b")
    prompts = {"first": "segment", "second": "region", "third": "topic", "fourth": "segment"}
    stops = {
        "first": label,
        "second": F.when(F.col("status") != "P", label),
        "third": F.when(F.col("status") == "O", label).otherwise(""),
        "fourth": F.lit(None).cast("string"),
    }
    wide = t.outcomes.select(
        "conversation_id",
        *[F.col(c).alias(f"{turn}_turn_prompt") for turn, c in prompts.items()],
        *[c.alias(f"{turn}_turn_preferred_response") for turn, c in stops.items()],
        *[
            F.col("region" if letter == "a" else "topic").alias(f"{turn}_turn_response_{letter}")
            for turn in prompts
            for letter in "abcd"
        ],
    )
    messages = nested.turns_from_columns()
    return wide.select("conversation_id", F.posexplode(messages).alias("pos", "m")).select(
        "conversation_id", "pos", "m.role", "m.content"
    )


@query(
    "arr4_with_prompt",
    """SELECT conv_id AS conversation_id, CAST(count(*) + 2 AS INT) AS n, 'system' AS first_role,
      'Why ' || conv_id || '?' AS last FROM conversations GROUP BY 1""",
)
def _(t):
    question = F.concat(F.lit("Why "), "conversation_id", F.lit("?"))
    full = nested.with_prompt(F.col("turns"), question, "Be fair.")
    return nest_turns(t.turns).select("conversation_id", full.alias("m")).select(
        "conversation_id",
        F.size("m").alias("n"),
        F.col("m")[0]["role"].alias("first_role"),
        F.element_at("m", -1)["content"].alias("last"),
    )


@query(
    "arr5_conversation_text",
    """SELECT conv_id AS conversation_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY 1""",
)
def _(t):
    text = nested.conversation_text(F.col("turns"))
    return nest_turns(t.turns).select("conversation_id", text.alias("text"))


@query(
    "arr6_element_and_sizes",
    """SELECT doc_id, words[1] AS first, CAST(len(words) AS INT) AS n,
      CAST(len(list_distinct(words)) AS INT) AS n_distinct
    FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)""",
)
def _(t):
    words = F.split("text", " ")
    return t.documents.select(
        "doc_id",
        words[0].alias("first"),
        F.size(words).alias("n"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
    )


@query(
    "jsn1_path_and_text",
    r"""SELECT event_id, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k,
      '{"id":' || event_id || ',"type":"' || event_type || '"}' AS json FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("json"),
    )


@query(
    "mth1_ratio",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio FROM lineitem""",
)
def _(t):
    value = F.round(ratio(F.col("l_extendedprice"), F.col("l_tax")), 4)
    return t.lineitem.select("l_orderkey", "l_linenumber", value.alias("ratio"))


@query(
    "mth2_arithmetic",
    """SELECT c_custkey, round(abs(c_acctbal - 5000), 6) AS gap, round(sqrt(abs(c_acctbal)), 6) AS root,
      round(100 * (c_acctbal - (c_nationkey + 1)) / (c_nationkey + 1), 5) AS change FROM customer""",
)
def _(t):
    balance, base = F.col("c_acctbal"), F.col("c_nationkey") + 1
    return t.customer.select(
        "c_custkey",
        F.round(F.abs(balance - 5000), 6).alias("gap"),
        F.round(F.sqrt(F.abs(balance)), 6).alias("root"),
        F.round(percent_change(balance, base), 5).alias("change"),
    )


# Short stop lists for the languages of the test documents.
STOP_WORDS = {
    "en": ["the", "and", "that", "on", "in", "it", "as", "for", "was", "with", "are", "from"],
    "fr": ["le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui"],
    "de": ["die", "der", "das", "und", "in", "den", "von", "zu", "mit", "ist", "nicht"],
}

_TOKENIZED = r"""tok AS (
  SELECT doc_id, lang, text,
    regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS tokens,
    list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'),
      lambda x: regexp_full_match(x, '\p{L}+')) AS words,
    len(regexp_extract_all(text, '[^.!?\s][^.!?]*')) AS sents
  FROM documents)"""
_SYLLABLES = r"""syl AS (
  SELECT *, list_sum(list_transform(words, lambda w:
    greatest(1, len(regexp_extract_all(lower(w), '[aeiouyàáâäæèéêëìíîïòóôöœùúûüýÿ]+'))))) AS syllables
  FROM tok)"""


def _features(t):
    return text_features(
        spread(t.documents.select("doc_id", "lang", F.col("text").alias("user_prompt"))),
        "user_prompt",
        STOP_WORDS,
        F.col("lang"),
    )


@query(
    "txt1_sentences_and_tokens",
    f"""WITH {_TOKENIZED} SELECT doc_id, CAST(sents AS INT) AS num_sents_user_prompt,
      CAST(len(tokens) AS INT) AS num_tokens_user_prompt FROM tok""",
)
def _(t):
    return _features(t).select("doc_id", "num_sents_user_prompt", "num_tokens_user_prompt")


@query(
    "txt2_sentence_length",
    f"""WITH {_TOKENIZED} SELECT doc_id, round(len(words) / nullif(sents, 0), 6) AS avg_sent_len_user_prompt
    FROM tok""",
)
def _(t):
    return _features(t).select("doc_id", *rounded("avg_sent_len_user_prompt"))


@query(
    "txt3_distinct_tokens",
    f"""WITH {_TOKENIZED}, u AS (
      SELECT doc_id, tokens, len(list_distinct(list_transform(tokens, lambda x: lower(x)))) AS n FROM tok)
    SELECT doc_id, CAST(n AS INT) AS num_unique_lemmas_user_prompt,
      round(n / nullif(len(tokens), 0), 6) AS type_to_token_ratio_user_prompt FROM u""",
)
def _(t):
    return _features(t).select(
        "doc_id", "num_unique_lemmas_user_prompt", *rounded("type_to_token_ratio_user_prompt")
    )


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "txt4_stop_words",
    f"""WITH {_TOKENIZED} SELECT doc_id, CAST(CASE lang
      {' '.join(f"WHEN '{code}' THEN len(list_filter(tokens, lambda x: list_contains({_sql_list(words)}, lower(x))))"
                for code, words in STOP_WORDS.items())}
      ELSE 0 END AS INT) AS num_stop_words_user_prompt FROM tok""",
)
def _(t):
    return _features(t).select("doc_id", "num_stop_words_user_prompt")


@query(
    "txt5_punctuation",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]+')) AS INT)
      AS num_punctuation_user_prompt FROM documents""",
)
def _(t):
    return _features(t).select("doc_id", "num_punctuation_user_prompt")


@query(
    "txt6_syllables",
    f"""WITH {_TOKENIZED}, {_SYLLABLES} SELECT doc_id,
      CASE WHEN lang IN ('en', 'it', 'fr') THEN round(syllables / nullif(len(words), 0), 6) END
        AS avg_num_syllables_user_prompt FROM syl""",
)
def _(t):
    return _features(t).select("doc_id", *rounded("avg_num_syllables_user_prompt"))


@query(
    "txt7_reading_ease",
    f"""WITH {_TOKENIZED}, {_SYLLABLES}, r AS (
      SELECT doc_id, lang, len(words) / nullif(sents, 0) AS wps, syllables / nullif(len(words), 0) AS spw FROM syl)
    SELECT doc_id, round(CASE lang WHEN 'en' THEN 206.835 - 1.015 * wps - 84.6 * spw
      WHEN 'fr' THEN 207.0 - 1.015 * wps - 73.6 * spw END, 6) AS flesch_reading_ease_user_prompt FROM r""",
)
def _(t):
    return _features(t).select("doc_id", *rounded("flesch_reading_ease_user_prompt"))


# Lexicon: the words of the question bank, rated by their length, in one category per first letter
# of the alphabet's two halves.
def _lexicon(t):
    found = t.benchmark.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    ).distinct()
    half = F.when(F.lower("word") < "n", "early").otherwise("late")
    return found.select("word", half.alias("category"), (F.length("word") / 8.0).alias("weight"))


_LEXICON = r"""lex AS (
  SELECT word, CASE WHEN lower(word) < 'n' THEN 'early' ELSE 'late' END AS category, length(word) / 8.0 AS weight
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM benchmark))"""


@query(
    "txt8_concreteness",
    f"""WITH {_TOKENIZED}, {_LEXICON}, w AS (
      SELECT doc_id, unnest(words) AS word FROM tok WHERE lang = 'en'),
    s AS (SELECT doc_id, sum(weight) AS total FROM w JOIN lex USING (word) GROUP BY 1)
    SELECT t.doc_id, CASE WHEN lang = 'en' THEN round(coalesce(total, 0) / nullif(len(words), 0), 6) END
      AS avg_concreteness_user_prompt
    FROM tok t LEFT JOIN s ON t.doc_id = s.doc_id""",
)
def _(t):
    docs = spread(t.documents.select("doc_id", "lang", F.col("text").alias("user_prompt")))
    rates = concreteness(docs, ["doc_id"], "user_prompt", _lexicon(t), F.col("lang") == "en")
    return rates.select("doc_id", *rounded("avg_concreteness_user_prompt"))


@query(
    "txt9_category_rates",
    f"""WITH {_TOKENIZED}, {_LEXICON}, w AS (SELECT doc_id, unnest(tokens) AS word FROM tok),
    s AS (SELECT doc_id, count(*) FILTER (WHERE category = 'early') AS early,
            count(*) FILTER (WHERE category = 'late') AS late FROM w JOIN lex USING (word) GROUP BY 1)
    SELECT t.doc_id, round(coalesce(early, 0) / nullif(len(tokens), 0), 6) AS user_prompt_liwc_early,
      round(coalesce(late, 0) / nullif(len(tokens), 0), 6) AS user_prompt_liwc_late
    FROM tok t LEFT JOIN s ON t.doc_id = s.doc_id""",
)
def _(t):
    docs = spread(t.documents.select("doc_id", "lang", F.col("text").alias("user_prompt")))
    rates = category_rates(docs, ["doc_id"], "user_prompt", _lexicon(t), ["early", "late"])
    return rates.select("doc_id", *rounded("user_prompt_liwc_early", "user_prompt_liwc_late"))


@query(
    "txt9_category_rates_long",
    f"""WITH {_TOKENIZED}, {_LEXICON}, w AS (
      SELECT doc_id, len(tokens) AS n, unnest(tokens) AS word FROM tok)
    SELECT doc_id, category, round(count(*) / min(n), 6) AS rate FROM w JOIN lex USING (word) GROUP BY 1, 2""",
)
def _(t):
    docs = spread(t.documents.select("doc_id", "lang", F.col("text").alias("user_prompt")))
    rates = category_rates_long(docs, ["doc_id"], "user_prompt", _lexicon(t))
    return rates.select("doc_id", "category", *rounded("rate"))


@query(
    "txt10_politeness",
    """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.75 WHEN 'error' THEN 0.0
      ELSE 0.5 END AS DOUBLE) AS politeness FROM events""",
)
def _(t):
    label = (
        F.when(F.col("event_type") == "click", "polite")
        .when(F.col("event_type") == "view", "somewhat polite")
        .when(F.col("event_type") == "error", "impolite")
        .otherwise("neutral")
    )
    return t.events.select("event_id", recode_politeness(label).alias("politeness"))


@query(
    "txt11_features_by_language",
    f"""WITH {_TOKENIZED}, {_SYLLABLES} SELECT lang, count(*) AS n,
      count(CASE WHEN lang IN ('en', 'it', 'fr') AND len(words) > 0 THEN 1 END) AS n_syllables,
      count(CASE WHEN lang IN ('en', 'it', 'fr') AND len(words) > 0 AND sents > 0 THEN 1 END) AS n_reading_ease
    FROM syl GROUP BY 1""",
)
def _(t):
    return _features(t).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("avg_num_syllables_user_prompt").alias("n_syllables"),
        F.count("flesch_reading_ease_user_prompt").alias("n_reading_ease"),
    )


@query(
    "txt12_topics_of_texts",
    """SELECT d.doc_id AS conversation_id, lang, n_name AS topic FROM documents d
    JOIN labels l ON d.doc_id = l.doc_id JOIN nation ON n_nationkey = d.n_chars % 25""",
)
def _(t):
    facts = t.documents.select(F.col("doc_id").alias("conversation_id"), "lang")
    topic_of = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 25).cast("int").alias("cluster_id")
    )
    names = t.nation.select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("gpt_description")
    )
    return attach_topics(facts, topic_of, names)


@query(
    "udf1_row_expressions",
    f"""SELECT o_orderkey, {sql_hash_mod('o_orderkey', 1, 10)} < 5 AS low,
      CASE WHEN o_totalprice > 100000 THEN upper(o_orderstatus) ELSE lower(o_orderstatus) END AS status
    FROM orders""",
)
def _(t):
    big = F.col("o_totalprice") > 100000
    return t.orders.select(
        "o_orderkey",
        (hash_mod(F.col("o_orderkey"), 1, 10) < 5).alias("low"),
        F.when(big, F.upper("o_orderstatus")).otherwise(F.lower("o_orderstatus")).alias("status"),
    )


def _load_length_scorer():
    """Stands for a classifier: shares of vowels and of spaces."""

    def score(texts: pd.Series) -> pd.DataFrame:
        size = texts.str.len()
        return pd.DataFrame(
            {
                "scores": [
                    {"joy": float(a), "calm": float(b)}
                    for a, b in zip(texts.str.count("[aeiou]") / size, texts.str.count(" ") / size)
                ]
            }
        )

    return score


@query(
    "udf2_score_batch",
    """SELECT doc_id, round(joy, 6) AS e_joy_text, round(calm, 6) AS e_calm_text, NULL::DOUBLE AS e_fear_text,
      CASE WHEN joy > calm THEN 'joy' ELSE 'calm' END AS label
    FROM (SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) / length(text) AS joy,
            len(regexp_extract_all(text, ' ')) / length(text) AS calm FROM documents)""",
)
def _(t):
    docs = spread(t.documents.select("doc_id", "text"))
    scored = score_batch(docs, "text", _load_length_scorer, "scores MAP<STRING, DOUBLE>", ["doc_id"])
    labelled = scored.withColumn("label", best_label(F.col("scores")))
    columns = scores_to_columns(labelled, "scores", ["joy", "calm", "fear"], "e_", "text")
    return columns.select(
        "doc_id", *rounded("e_joy_text", "e_calm_text"), "e_fear_text", "label"
    )
