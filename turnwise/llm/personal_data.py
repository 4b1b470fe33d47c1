"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

1.  *Proposals.* Each kind has a pattern; its leftmost non-overlapping matches are proposed. A match that
    fails what follows is dropped, and the search goes on behind it.
2.  *Validators.* Card numbers pass Luhn, account numbers (IBAN) mod-97 and the length of their country,
    parts of an address stay below 256, social security numbers lie in ranges that are given out.
3.  *Context.* A span starts from the score of its kind. A word that names the kind within 40 code
    points on either side raises it, one that names another kind of number lowers it.

Spans of the base kinds (the first four) are always reported, with their score. The method adds spans of
further kinds whose score reaches THRESHOLD and that overlap no base span.

A text is read once, in Arrow batches, and no row is shuffled. The time is linear in the text: the
patterns' repeats are bounded or possessive, and an address is found from its ``@``. Null and empty texts
have no spans; repeated rows are reported each; only the named text column is read, and a column that
has the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of reports, with the score that each starts from.
KINDS = {
    "email": 70, "ip": 50, "card": 60, "phone": 60,
    "iban": 70, "pan": 40, "ssn": 40, "national": 30,
}
NAMES = list(KINDS)
BASE = 4
THRESHOLD = 50
#: What a word near a span adds to or takes from its score, and how many code points count as near.
WEIGHT = 25
NEAR = 40

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
PATTERNS = {
    "email": r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "pan": r"[0-9]{4}(?:[\x20-]?[0-9]{4}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "national": r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}",
}
#: One part of an address: at most 255, zeros before it allowed.
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDRESS = PART + r"(?:\." + PART + "){3}"
#: Areas, groups and serials that are never given out.
UNUSED_SSN = "(?:000|666|9[0-9][0-9])-.*|.*-00-.*|.*-0000"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Words that name a kind (texts are English, German, French and Spanish).
CONTEXT = {
    "email": "e-?mails?|mails?|contact|kontakt|courriel|correo|write|reach",
    "ip": "ip|address|adresse|host|server|serveur|servidor|login|client",
    "card": "cards?|karte|kreditkarte|carte|tarjeta|credit|debit|visa|mastercard|amex",
    "phone": "phone|tel|telephone|telefon|telefono|call|mobile|mobil|handy|fax",
    "iban": "iban|account|konto|compte|cuenta|bank|banque|banco|transfer",
    "pan": "cards?|karte|kreditkarte|carte|tarjeta|credit|debit|visa|mastercard|amex",
    "ssn": "ssn|social|security|sozialversicherung",
    "national": "phone|tel|telephone|telefon|telefono|call|mobile|mobil|handy|fax",
}
#: Words of numbers that are nobody's.
DENIAL = "version|isbn|issn|doi|release|build|invoice|order|ticket|sample|example|dummy"


def whole_words(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


_PATTERNS = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_NEAR = {kind: re.compile(whole_words(words)) for kind, words in CONTEXT.items()}
_DENIED = re.compile(whole_words(DENIAL))
_ADDRESS = re.compile(ADDRESS)
_UNUSED = re.compile(UNUSED_SSN)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    own = [ord(c) - 48 for c in reversed(digits)]
    return (sum(own[::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def mod_97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(match: str) -> str:
    return match.replace(" ", "").replace("-", "")


def _bounded(text: str, start: int, end: int, inside: str) -> bool:
    """No character of the kind stands right before or after."""
    return not (start and text[start - 1] in inside) and not (end < len(text) and text[end] in inside)


_NUMBER = "0123456789"
_NAME = _NUMBER + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in _PATTERNS["email"].finditer(text):
        at = match.start()
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        if local:
            yield at - local, match.end()
            done = match.end()
        else:
            done = at + 1


def _account(text: str, match: re.Match) -> tuple[int, int] | None:
    """The proposal up to the length of its country, where what is left passes."""
    start, found = match.start(), match.group()
    length = IBAN_LENGTHS.get(found[:2])
    if length is None:
        return None
    end = start + length + ((length - 1) // 4 if found[4] == " " else 0)
    if end > match.end() or not _bounded(text, start, end, _NAME):
        return None
    return (start, end) if mod_97(text[start:end].replace(" ", "")) else None


def _valid(kind: str, text: str, match: re.Match) -> bool:
    found = match.group()
    if kind == "ip":
        return _ADDRESS.fullmatch(found) is not None
    if kind == "card":
        digits = _digits(found)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= sum(c in _NUMBER for c in found) <= 15
    if kind == "pan":
        return _bounded(text, *match.span(), _NUMBER) and luhn(_digits(found))
    if kind == "ssn":
        return _bounded(text, *match.span(), _NAME + "-") and _UNUSED.fullmatch(found) is None
    return _bounded(text, *match.span(), _NUMBER + "+")


def _confirmed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from _emails(text)
        return
    for match in _PATTERNS[kind].finditer(text):
        if kind == "iban":
            span = _account(text, match)
            if span:
                yield span
        elif _valid(kind, text, match):
            yield match.span()


def score_of(kind: str, text: str, start: int, end: int) -> int:
    before = text[max(0, start - NEAR) : start].translate(_LOWER)
    after = text[end : end + NEAR].translate(_LOWER)
    named = _NEAR[kind].search(before) or _NEAR[kind].search(after)
    denied = _DENIED.search(before) or _DENIED.search(after)
    return KINDS[kind] + WEIGHT * (named is not None) - WEIGHT * (denied is not None)


def find_spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind: base ones, and added ones that score high enough."""
    if not text:
        return []
    found = []
    for rank, kind in enumerate(NAMES[:BASE]):
        for start, end in _confirmed(kind, text):
            found.append((start, rank, end, score_of(kind, text, start, end)))
    taken = _merged(sorted((start, end) for start, _, end, _ in found))
    for rank in range(BASE, len(NAMES)):
        at = 0
        for start, end in _confirmed(NAMES[rank], text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            score = score_of(NAMES[rank], text, start, end)
            if score >= THRESHOLD:
                found.append((start, rank, end, score))
    return [dict(zip(("start", "rank", "end", "score"), span)) for span in sorted(found)]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans in order, overlapping ones joined."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


SPAN = "struct<start:bigint,rank:int,end:bigint,score:int>"
_SPANS = pa.list_(
    pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("score", pa.int32())])
)


def personal_spans(text: Column) -> Column:
    """``find_spans`` as a column."""

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(value) for value in texts.to_pylist()], _SPANS)

    return spans(text)


def _redacted(text: str | None) -> str | None:
    if not text:
        return text
    out, done = [], 0
    spans = find_spans(text)
    for start, end in _merged([(s["start"], s["end"]) for s in spans]):
        kind = next(NAMES[s["rank"]] for s in spans if s["start"] == start)
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join(out) + text[done:]


def scan_personal(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of spans: start, rank (the kind's place in NAMES), end and score."""
    return docs.withColumn(into, personal_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind; spans that overlap are one, of the first's
    kind. Null and empty texts stay as they are."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([_redacted(value) for value in texts.to_pylist()], pa.string())

    return docs.withColumn(text, redacted(F.col(text)))


def label(span: Column) -> Column:
    """``kind:start:end``"""
    return F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), span["rank"]), span["start"], span["end"])


def report(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts, base digest, spans and their scores of each document of ``scan_personal``."""
    base = F.filter(spans, lambda s: s["rank"] < BASE)
    joined = lambda some: F.array_join(F.transform(some, label), ",")
    of_rank = lambda rank: F.filter(spans, lambda s: s["rank"] == rank)
    counts = [
        F.array_size(of_rank(rank)).cast("bigint").alias(f"n_{kind}")
        for rank, kind in enumerate(NAMES[:BASE])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
