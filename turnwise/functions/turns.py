"""Array expressions on nested conversations (array of {role, content, …} structs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.config import RESPONSE_LETTERS, TURNS
from turnwise.functions.structs import pick_by_label


def select_turns(history: Column) -> Column:
    """User turns, and the model turns that were chosen."""
    return F.filter(
        history, lambda t: (t["role"] == "user") | F.coalesce(t["if_chosen"], F.lit(False))
    )


def message(role: Column, content: Column, typed: bool) -> Column:
    if typed:
        content = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
    return F.struct(role.alias("role"), content.alias("content"))


def chat_role(role: Column) -> Column:
    return F.replace(role, F.lit("model"), F.lit("assistant"))


def to_messages(turns: Column, typed: bool = False) -> Column:
    """{role, content} messages; with ``typed`` the content is a list of {type, text}."""
    return F.transform(turns, lambda t: message(chat_role(t["role"]), t["content"], typed))


def collapse_same_role(turns: Column) -> Column:
    """Drop a turn whose role equals that of the turn before it in the given array."""
    return F.filter(
        turns,
        lambda t, i: (i == 0) | ~t["role"].eqNullSafe(F.get(turns, i - 1)["role"]),
    )


def turns_from_columns(names: Sequence[str] = TURNS, typed: bool = False) -> Column:
    """User and assistant messages from the wide table, ending before the first turn without a
    preferred response (null, empty or NaN)."""
    pairs = []
    for name in names:
        label = F.col(f"{name}_turn_preferred_response")
        response = pick_by_label(
            label, {a: F.col(f"{name}_turn_response_{a}") for a in RESPONSE_LETTERS}
        )
        pairs.append(
            F.struct(
                missing(label).alias("missing"),
                F.array(
                    message(F.lit("user"), F.col(f"{name}_turn_prompt"), typed),
                    message(F.lit("assistant"), response, typed),
                ).alias("messages"),
            )
        )
    rounds = F.array(*pairs)
    return F.flatten(F.transform(until_first_missing(rounds), lambda r: r["messages"]))


def missing(label: Column) -> Column:
    return label.isNull() | label.isin("", "NaN")


def until_first_missing(rounds: Column) -> Column:
    """The array up to, not including, its first element flagged as missing."""
    stop = F.array_position(F.transform(rounds, lambda r: r["missing"]), True)
    return F.when(stop == 0, rounds).otherwise(F.slice(rounds, F.lit(1), (stop - 1).cast("int")))


def with_prompt(
    turns: Column, question: Column, system: str | None = None, typed: bool = False
) -> Column:
    """The conversation with the question as its last user turn, behind an optional system turn."""
    asked = F.array(message(F.lit("user"), question, typed))
    if system is None:
        return F.concat(turns, asked)
    first = F.array(message(F.lit("system"), F.lit(system), typed))
    return F.concat(first, turns, asked)


def conversation_text(turns: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n"
    )
