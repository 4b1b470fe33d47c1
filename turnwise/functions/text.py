"""Text features as column expressions on a rule tokenizer.

A token is a run of letters, digits and underscores, or one other visible character. A sentence
is a stretch between sentence marks that holds a visible character.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import ratio

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"^\p{L}+$"
SENTENCE = r"[^.!?\s][^.!?]*"
PUNCTUATION = r"[^\p{L}\p{N}_\s]+"
VOWELS = "[aeiouyàáâäæèéêëìíîïòóôöœùúûüýÿ]+"

# Constants of the published reading ease formulas (base, per sentence, per word).
READING_EASE = {
    "en": (206.835, 1.015, 84.6),
    "fr": (207.0, 1.015, 73.6),
    "it": (217.0, 1.3, 60.0),
}

# Languages with syllable features, and with concreteness.
SYLLABLE_LANGUAGES = ["en", "it", "fr"]
CONCRETENESS_LANGUAGES = ["en"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: t.rlike(WORD))


def num_sents(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE))


def num_punctuation(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PUNCTUATION))


def num_unique(token_array: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.size(F.array_distinct(F.transform(token_array, F.lower)))


def num_stop_words(token_array: Column, language: Column, stop_words: Mapping[str, Sequence[str]]) -> Column:
    """Tokens on the list of their language; 0 for a language without a list."""
    counted = F.lit(0)
    for code, listed in stop_words.items():
        hits = F.size(F.filter(token_array, _is_listed(listed)))
        counted = F.when(language == code, hits).otherwise(counted)
    return counted


def _is_listed(words: Sequence[str]):
    return lambda token: F.lower(token).isin(*words)


def num_syllables(word_array: Column) -> Column:
    """Vowel groups over all words; a word without a vowel has one syllable."""
    joined = F.lower(F.array_join(word_array, " "))
    silent = F.filter(word_array, lambda w: ~F.lower(w).rlike(VOWELS))
    return F.regexp_count(joined, F.lit(VOWELS)) + F.size(silent)


def reading_ease(language: Column, n_words: Column, n_sents: Column, n_syllables: Column) -> Column:
    score = F.lit(None).cast("double")
    for code, (base, per_sentence, per_word) in READING_EASE.items():
        value = (
            F.lit(base)
            - F.lit(per_sentence) * ratio(n_words, n_sents)
            - F.lit(per_word) * ratio(n_syllables, n_words)
        )
        score = F.when(language == code, value).otherwise(score)
    return score


def text_features(
    df: DataFrame,
    side: str,
    stop_words: Mapping[str, Sequence[str]],
    language: Column | None = None,
) -> DataFrame:
    """Append ``<feature>_<side>`` columns for the text column ``side``.

    A feature that does not exist for the row's language is null.
    """
    language = F.lit("en") if language is None else language
    text = F.col(side)
    counted = (
        df.withColumn("_tokens", tokens(text))
        .withColumn("_words", words(F.col("_tokens")))
        .withColumns(
            {
                f"num_tokens_{side}": F.size("_tokens"),
                f"num_sents_{side}": num_sents(text),
                f"num_unique_lemmas_{side}": num_unique(F.col("_tokens")),
                f"num_punctuation_{side}": num_punctuation(text),
                f"num_stop_words_{side}": num_stop_words(F.col("_tokens"), language, stop_words),
                "_n_words": F.size("_words"),
                "_n_syllables": F.when(
                    language.isin(*SYLLABLE_LANGUAGES), num_syllables(F.col("_words"))
                ),
            }
        )
    )
    n_words, n_sents = F.col("_n_words"), F.col(f"num_sents_{side}")
    return counted.withColumns(
        {
            f"avg_sent_len_{side}": ratio(n_words, n_sents),
            f"type_to_token_ratio_{side}": ratio(
                F.col(f"num_unique_lemmas_{side}"), F.col(f"num_tokens_{side}")
            ),
            f"avg_num_syllables_{side}": ratio(F.col("_n_syllables"), n_words),
            f"flesch_reading_ease_{side}": reading_ease(
                language, n_words, n_sents, F.col("_n_syllables")
            ),
        }
    ).drop("_tokens", "_words", "_n_words", "_n_syllables")
