"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every whole text. Their values' hashes are counted over the corpus by
distinct repository and owner: a value that many owners hold is a copied example, one that few owners
hold looks live. Base kinds are always reported; the method adds spans of further kinds (bearer
tokens, signed web tokens, private key blocks by their body) where their value looks live.

Only DataFrame functions are used. A row's place in a text is the sum of the lengths of the pieces
and matches before it, in code points. Texts are read once; only candidates are shuffled, and counts
combine by (value, owner, repository), then (value, owner), then value, so that an example that
stands in a third of all documents is a few rows at each step.

Null and empty texts have no spans. Null owners and repositories count as one. Repeated rows are
reported each, and count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import stored

_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN_VALUE = 6
_PRIVATE = "PRIVATE\\x20KEY-----"
#: A private key block with its body as the group: all up to the END line, or where that is missing the
#: header fields and base64 lines that follow.
PRIVATE_BEGIN = rf"-----BEGIN\x20[A-Z\x20]*{_PRIVATE}"
PRIVATE_END = rf"-----END\x20[A-Z\x20]*{_PRIVATE}"
WHOLE_BODY = r"[^-]*+(?:-(?!----)[^-]*+)*+"
AT_END = r"(?=\s*+\z)"
CUT_BODY = (
    r"(?:\s*+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++"
    rf"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|{AT_END}))?+)?+"
)
PRIVATE_BLOCK = rf"{PRIVATE_BEGIN}({WHOLE_BODY}(?={PRIVATE_END})|{CUT_BODY})(?:{PRIVATE_END})?"
#: What a private key's body is without: its value is the same however its lines are broken.
BREAKS = r"\s|\\[nr]"
#: Kinds in the order of reports: name, pattern, group of the value, least length of the value.
KINDS = [
    ("assign", f"({_KEYS})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, ASSIGN_VALUE),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "[0-9a-f]{24,}", 0, 0),
    ("bearer", r"Bearer\x20+([A-Za-z0-9+/_.=-]{16,})", 1, 0),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private", PRIVATE_BLOCK, 1, 0),
]
BASE = 3
#: A value that more owners than this hold is a copied example.
LIVE_OWNERS = 2


def _matches(text: Column, rank: int) -> Column:
    """Leftmost non-overlapping matches of one kind: struct(start, rank, end, value)."""
    kind, pattern, group, least = KINDS[rank]
    wholes = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = wholes if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind == "private":
        # A key is the same however its lines are broken; a header without a body is its own value.
        bodies = F.transform(values, lambda body: F.regexp_replace(body, BREAKS, ""))
        values = F.zip_with(wholes, bodies, lambda whole, body: F.when(body == "", whole).otherwise(body))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    triples = F.arrays_zip(gaps.alias("gap"), wholes.alias("whole"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")

    def step(done, x):
        start = done["at"] + x["gap"]
        end = start + F.length(x["whole"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value")
        )
        longer = F.length(x["value"]) >= least
        found = F.when(longer, F.concat(done["found"], F.array(span))).otherwise(done["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    # The piece after the last match has no match beside it.
    walk = F.aggregate(
        F.filter(triples, lambda x: x["whole"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda done: done["found"],
    )
    # split() and the other two passes are only made where there is something to find.
    return F.when(F.regexp_like(text, F.lit(pattern)), walk).otherwise(empty)


def find_candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind."""
    return F.array_sort(F.concat(*(_matches(text, rank) for rank in range(len(KINDS)))))


def label(span: Column) -> Column:
    """``kind:start:end``"""
    names = F.array(*(F.lit(name) for name, *_ in KINDS))
    return F.concat_ws(":", F.get(names, span["rank"]), span["start"], span["end"])


def scan_secrets(docs: DataFrame, repository: str, owner: str, live_owners: int = LIVE_OWNERS) -> DataFrame:
    """``doc_id`` and ``candidates``, one row for each row of ``docs``.

    A candidate has ``start``, ``rank`` (its kind's place in KINDS), ``end``, ``value``, ``repositories``
    and ``owners`` (how many hold the value) and ``live``. Candidates are in order of start, then kind.
    """
    scanned = stored(
        docs.select(
            "doc_id", F.monotonically_increasing_id().alias("_row"),
            F.col(repository).cast("string").alias("_repository"), F.col(owner).cast("string").alias("_owner"),
            find_candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found"),
        ),
        "candidates",
    )
    single = scanned.filter(F.size("found") > 0).select(
        "_row", "_repository", "_owner", F.explode("found").alias("c")
    ).withColumn("_hash", F.sha2(F.col("c.value"), 256))
    held = single.groupBy("_hash", "_owner", "_repository").agg(F.lit(1).alias("one"))
    held = held.groupBy("_hash", "_owner").agg(F.count("*").alias("n"))
    held = held.groupBy("_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    judged = single.join(held, "_hash").groupBy("_row").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "c.start", "c.rank", "c.end", "c.value", "repositories", "owners",
                    (F.col("owners") <= live_owners).alias("live"),
                )
            )
        ).alias("candidates")
    )
    rows = scanned.select("doc_id", "_row").join(judged, "_row", "left")
    none = F.array().cast(judged.schema["candidates"].dataType)
    return rows.select("doc_id", F.coalesce("candidates", none).alias("candidates"))


def _of_kind(rank: int):
    return lambda c: c["rank"] == rank


def report(found: DataFrame) -> DataFrame:
    """Counts, base digest and spans of each document of ``scan_secrets``."""
    base = F.filter("candidates", lambda c: c["rank"] < BASE)
    kept = F.filter("candidates", lambda c: (c["rank"] < BASE) | c["live"])
    counts = [
        F.array_size(F.filter("candidates", _of_kind(rank))).cast("bigint").alias(f"n_{KINDS[rank][0]}")
        for rank in range(BASE)
    ]
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(kept).alias("spans"),
        F.size(F.filter("candidates", lambda c: c["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("candidates", lambda c: ~c["live"])).cast("bigint").alias("n_copied"),
    )
