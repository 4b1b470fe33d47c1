"""Scores and labels read out of free-text answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: everything up to the first run of digits.
FIRST_AMOUNT = r"^[^0-9]*([0-9]+)"


def score_yes_no(answer: Column, key: Column, trim: bool = False) -> Column:
    """1 where the answer equals the key but for case, else 0 (a null answer scores 0)."""
    given = F.trim(answer) if trim else answer
    return F.coalesce((F.lower(given) == key).cast("int"), F.lit(0))


def score_amount(answer: Column) -> Column:
    """The first integer in the text once commas are gone, or null."""
    digits = F.regexp_extract(F.replace(answer, F.lit(","), F.lit("")), FIRST_AMOUNT, 1)
    # No match yields an empty string, which is no number.
    return digits.try_cast("double")


def extract_label(text: Column, labels: Sequence[str]) -> Column:
    """The label mentioned first, or null."""
    pattern = "(" + "|".join(re.escape(label) for label in labels) + ")"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def predicted_label(content: Column, key: str, labels: Sequence[str]) -> Column:
    """The label under its JSON key; where the text is not that JSON, the label mentioned first."""
    value = F.get_json_object(content, f"$['{key}']")
    return F.coalesce(F.when(value.isin(*labels), value), extract_label(content, labels))


def mentions_any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def answer_unless_mentioned(question: Column, phrases: Sequence[str]) -> Column:
    """``yes`` for a question holding none of the phrases, else ``no``."""
    return F.when(mentions_any(question, phrases), "no").otherwise("yes")


def fix_typos(text: Column, typos: dict[str, str]) -> Column:
    for wrong, right in typos.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def fill_prompt(template: str, text: Column, marker: str = "{conversation}") -> Column:
    """The template around the text. The marker occurs once, and the text is never searched."""
    before, after = template.split(marker)
    return F.concat(F.lit(before), text, F.lit(after))
