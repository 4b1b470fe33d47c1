"""One query for each operator of this subpackage, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import UPPER, WORD, table
from turnwise.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` and describe each document from what they hold."""
    import public_tokenizers

    from turnwise.llm.token_blocks import read_token_digests, write_token_files

    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_token_blocks")
def op3(spark, folder):
    return token_digests(spark, table(spark, folder, "documents"))


#: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query(
    "op8_url_cascade",
    r"""
    WITH parts AS (
      SELECT page_id, url,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    hosts AS (
      SELECT page_id, url,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    listed AS (SELECT host FROM hosts WHERE host <> '' GROUP BY host HAVING NOT bool_or(starts_with(url, 'https://'))),
    ruled AS (
      SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM hosts)
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
           WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""",
)
def op8(spark, folder):
    """Block list: hosts none of whose pages has an https url."""
    from turnwise.llm.url_cascade import build_cascade, host_of, judge_urls

    pages = table(spark, folder, "pages")
    plain = pages.select(host_of(F.col("url")).alias("host"), F.col("url").startswith("https://").alias("safe"))
    universe = plain.groupBy("host").agg((~F.bool_or("safe")).alias("listed"))
    return judge_urls(pages, URL_RULES, build_cascade(universe, "host", "listed"))


MIX_LEVELS = ["domain", "lang", "source"]
#: Integer weights by name; all others have the second value.
MIX_WEIGHTS = {
    "domain": ({"d0": 4, "d1": 3, "d2": 2}, 1),
    "lang": ({"en": 4, "de": 3}, 2),
    "source": ({"src0": 3, "src1": 2}, 1),
}
MIX_EPOCHS = 2
MIX_SHARE = (3, 5)
MIX_SEED = 17


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a document is its source's number modulo 4."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("bigint")
    return docs.withColumn("domain", F.concat(F.lit("d"), (number % 4).cast("string")))


def weight_of(level: str) -> Column:
    named, other = MIX_WEIGHTS[level]
    chosen = F.lit(other)
    for name, weight in named.items():
        chosen = F.when(F.col(level) == name, weight).otherwise(chosen)
    return chosen


def _mix_sql() -> str:
    steps = [
        "base AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), '') AS domain,"
        " coalesce(lang, '') AS lang, coalesce(source, '') AS source,"
        r" CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS HUGEINT) AS n FROM documents)",
        f"leaves AS (SELECT domain, lang, source, sum(n)::HUGEINT AS n, sum(n)::HUGEINT * {MIX_EPOCHS} AS capacity FROM base GROUP BY ALL)",
        f"given0 AS (SELECT (sum(n)::HUGEINT * {MIX_SHARE[0]}) // {MIX_SHARE[1]} AS given FROM leaves)",
    ]
    for depth, level in enumerate(MIX_LEVELS):
        path, parents = ", ".join(MIX_LEVELS[: depth + 1]), MIX_LEVELS[:depth]
        named, other = MIX_WEIGHTS[level]
        weight = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in named.items())
        family = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN given{depth} USING ({', '.join(parents)})" if parents else "CROSS JOIN given0"
        steps += [
            f"nodes{depth} AS (SELECT * FROM (SELECT {path}, sum(capacity)::HUGEINT AS capacity,"
            f" (CASE {weight} ELSE {other} END)::HUGEINT AS weight FROM leaves GROUP BY ALL) {join})",
            f"open{depth} AS (SELECT *, capacity * (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT"
            f" <= weight * (given - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT) AS filled"
            f" FROM nodes{depth} WINDOW w AS ({family} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level}))",
            f"given{depth + 1} AS (SELECT {path}, CASE WHEN filled THEN capacity ELSE"
            f" (weight * (given - (sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({family}))::HUGEINT))"
            f" // (sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({family}))::HUGEINT END AS given FROM open{depth})",
        ]
    return "WITH " + ",\n".join(steps) + f""",
    plan AS (SELECT *, CASE WHEN n > 0 THEN given // n ELSE 0 END AS full_epochs,
                    CASE WHEN n > 0 THEN given % n ELSE 0 END AS rest FROM leaves JOIN given3 USING (domain, lang, source)),
    placed AS (SELECT b.*, full_epochs, rest, sum(b.n) OVER (
        PARTITION BY domain, lang, source
        ORDER BY md5('{MIX_SEED}#' || CAST(full_epochs AS VARCHAR) || coalesce('#' || CAST(doc_id AS VARCHAR), ''))
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b.n AS before
      FROM base b JOIN plan USING (domain, lang, source)),
    epochs AS (SELECT unnest(range({MIX_EPOCHS + 1})) AS epoch)
    SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens,
      CAST(CASE WHEN epoch < full_epochs THEN n ELSE least(n, rest - before) END AS BIGINT) AS taken
    FROM placed, epochs WHERE epoch < full_epochs OR (epoch = full_epochs AND before < rest)"""


@query("op10_budget_mix", _mix_sql())
def op10(spark, folder):
    from turnwise.llm.budget_mix import mix

    docs = with_domain(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))
    weights = {level: weight_of(level) for level in MIX_LEVELS}
    rows = mix(docs, MIX_LEVELS, weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return rows.select(
        "doc_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in MIX_LEVELS),
        F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), F.col("_taken").alias("taken"),
    )


def _secrets_sql() -> str:
    from turnwise.llm import secrets as own

    def re2(pattern: str) -> str:
        """The same strings in RE2's words, which has neither possessive repeats nor lookaheads."""
        for repeat in "*+?}":
            pattern = pattern.replace(repeat + "+", repeat)
        return pattern.replace(r"\s", r"[\x09-\x0D\x20]")

    BASE, KINDS, LIVE_OWNERS = own.BASE, own.KINDS, own.LIVE_OWNERS
    finds = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        wholes, values = f"regexp_extract_all(text, {p})", f"regexp_extract_all(text, {p}, {group})"
        if kind == "private":
            cut = own.CUT_BODY.replace(own.AT_END, r"\s*\z")
            end = own.PRIVATE_END
            p = f"'{own.PRIVATE_BEGIN}(?:((?:-{{0,4}}[^-])*){end}|({re2(cut)})(?:{end})?)'"
            # A body cut off by the text's end is without the spaces that RE2 must take along.
            spaces = r"[\x09-\x0D\x20]+$"
            trimmed = (
                f"CASE WHEN regexp_matches(x, '(Proc-Type|DEK-Info):[^\\r\\n]*$') THEN x ELSE regexp_replace(x, '{spaces}', '') END"
            )
            wholes = f"list_transform(regexp_extract_all(text, {p}), lambda x: {trimmed})"
            bodies = f"list_zip({wholes}, regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2))"
            body = f"regexp_replace(coalesce(nullif(z[2], ''), z[3], ''), '{re2(own.BREAKS)}', '', 'g')"
            values = f"list_transform({bodies}, lambda z: coalesce(nullif({body}, ''), z[1]))"
        finds.append(
            f"""SELECT row, doc_id, source, '{kind}' AS kind, {rank} AS rank, starts[i] AS s, starts[i] + length(wholes[i]) AS e, vals[i] AS value
            FROM (SELECT *, list_transform(range(1, len(wholes) + 1), lambda i:
                    (list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                     + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda g: length(g))), 0))::BIGINT) AS starts
                  FROM (SELECT row, doc_id, source, string_split_regex(text, {p}) AS gaps,
                          {wholes} AS wholes, {values} AS vals
                        FROM d WHERE regexp_matches(text, {p}))),
                 unnest(range(1, len(wholes) + 1)) AS t(i)
            WHERE length(vals[i]) >= {least}"""
        )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
    c AS ({" UNION ALL ".join(finds)}),
    held AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM c GROUP BY value),
    j AS (SELECT c.*, owners <= {LIVE_OWNERS} AS live, kind || ':' || s || ':' || e AS label FROM c JOIN held USING (value)),
    g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
            count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(label, ',' ORDER BY s, rank) FILTER (rank < {BASE}), '') AS base,
            coalesce(string_agg(label, ',' ORDER BY s, rank) FILTER (rank < {BASE} OR live), '') AS spans,
            count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
      coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (row)"""


@query("op1_secret_ownership", _secrets_sql())
def op1(spark, folder):
    """A document is a repository's one file, and its source the owner."""
    from turnwise.llm.secrets import report, scan_secrets

    return report(scan_secrets(table(spark, folder, "documents"), "doc_id", "source"))


_BENCH_WORDS = (
    r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)


@query(
    "op6_decontamination",
    f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_BENCH_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + 9], ' ') AS g
           FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT row, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS g
           FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n)),
    h AS (SELECT row, pos, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
    p AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY row),
    i AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN p USING (row) LEFT JOIN i USING (row)""",
)
def op6(spark, folder):
    from turnwise.llm.decontamination import find_leaks

    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select(
        "doc_id", "n_words", F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def judge_toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``docs`` with its severity, by a model of the labelled documents of the folder."""
    from turnwise.llm.toxicity import fit_on_labels, score_severity

    model = fit_on_labels(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return score_severity(docs, model)


@query("op2_toxicity")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge_toxicity(spark, docs, folder).select("doc_id", "severity", "p_toxic", "toxic")


@query("op9_kneser_ney")
def op9(spark, folder):
    from turnwise.llm.kneser_ney import score_documents, train

    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2
    model = train(docs.filter(~held_out), spark)
    return score_documents(docs, held_out, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op5_fragment_join")
def op5(spark, folder):
    from turnwise.llm.fragment_join import similar_documents

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = similar_documents(docs, size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query(
    "op4_product_quantisation",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON r = a),
    c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM c LEFT JOIN n USING (vec_id)""",
)
def op4(spark, folder):
    from turnwise.llm.product_quantisation import similar_vectors

    return similar_vectors(table(spark, folder, "embeddings"), 0.98)


@query("op7_suffix_dedup")
def op7(spark, folder):
    from turnwise.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, folder, "documents").select("doc_id", "text"))


def _personal_sql() -> str:
    from turnwise.llm import personal_data as own

    def match_sql(kind: str) -> str:
        """Proposals of one kind, without what RE2 has no word for and does not need."""
        pattern = own.PATTERNS[kind].replace("(?<![0-9])", "").replace("++", "+")
        return (f"[{own.LOCAL}]+" if kind == "email" else "") + pattern

    near = lambda words: "'" + own.whole_words(words) + "'"
    digits = "replace(replace(m, ' ', ''), '-', '')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1"
        f" THEN reverse({digits})[i]::INT ELSE (2 * reverse({digits})[i]::INT) // 10 + (2 * reverse({digits})[i]::INT) % 10 END)) % 10 = 0"
    )
    lengths = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in own.IBAN_LENGTHS.items()) + "}"
    account = "replace(substr(text, s + 1, e - s), ' ', '')"
    mod_97 = (
        f"list_reduce(list_concat([0], list_transform(string_split(substr({account}, 5) || substr({account}, 1, 4), ''),"
        " lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),"
        " lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97) = 1"
    )
    outside = lambda inside: (
        f"NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END, '[{inside}]')"
        f" AND NOT regexp_matches(substr(text, e + 1, 1), '[{inside}]')"
    )
    checks = {
        "email": "true", "ip": f"regexp_full_match(m, '{own.ADDRESS}')",
        "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}",
        "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15",
        "iban": f"e <= s + length(m) AND {outside('0-9A-Za-z')} AND {mod_97}",
        "pan": f"{outside('0-9')} AND {luhn}",
        "ssn": f"{outside('0-9A-Za-z-')} AND NOT regexp_full_match(m, '{own.UNUSED_SSN}')",
        "national": outside("0-9+"),
    }
    finds = []
    for rank, (kind, prior) in enumerate(own.KINDS.items()):
        p = "'" + match_sql(kind) + "'"
        end = "s + length(m)"
        if kind == "iban":
            length = f"{lengths}[substr(m, 1, 2)]"
            end = f"s + {length} + CASE WHEN substr(m, 5, 1) = ' ' THEN ({length} - 1) // 4 ELSE 0 END"
        finds.append(
            f"""SELECT row, {rank} AS rank, s, e, '{kind}:' || s || ':' || e AS label,
              {prior} + CASE WHEN regexp_matches(pre, {near(own.CONTEXT[kind])}) OR regexp_matches(post, {near(own.CONTEXT[kind])}) THEN {own.WEIGHT} ELSE 0 END
                - CASE WHEN regexp_matches(pre, {near(own.DENIAL)}) OR regexp_matches(post, {near(own.DENIAL)}) THEN {own.WEIGHT} ELSE 0 END AS score
            FROM (SELECT *, translate(substr(text, greatest(s - {own.NEAR}, 0) + 1, least(s, {own.NEAR})), '{UPPER}', '{UPPER.lower()}') AS pre,
                    translate(substr(text, e + 1, {own.NEAR}), '{UPPER}', '{UPPER.lower()}') AS post
                  FROM (SELECT *, {end} AS e
                        FROM (SELECT row, text, wholes[i] AS m,
                                (list_sum(list_transform(gaps[1:i], lambda g: length(g)))
                                 + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda g: length(g))), 0))::BIGINT AS s
                              FROM (SELECT row, text, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS wholes
                                    FROM d WHERE regexp_matches(text, {p})), unnest(range(1, len(wholes) + 1)) AS t(i)))
                  WHERE e IS NOT NULL AND {checks[kind]})"""
        )
    counts = ", ".join(f"count(*) FILTER (rank = {rank}) AS n_{kind}" for rank, kind in enumerate(own.NAMES[: own.BASE]))
    names = [f"n_{kind}" for kind in own.NAMES[: own.BASE]]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    c AS ({" UNION ALL ".join(finds)}),
    kept AS (SELECT * FROM c WHERE rank < {own.BASE} OR (score >= {own.THRESHOLD} AND NOT EXISTS (
      SELECT 1 FROM c b WHERE b.row = c.row AND b.rank < {own.BASE} AND b.s < c.e AND c.s < b.e))),
    g AS (SELECT row, {counts}, string_agg(label, ',' ORDER BY s, rank) FILTER (rank < {own.BASE}) AS base,
            string_agg(label, ',' ORDER BY s, rank) AS spans, string_agg(score::VARCHAR, ',' ORDER BY s, rank) AS scores
          FROM kept GROUP BY row)
    SELECT doc_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in names)}, sha256(coalesce(base, '')) AS base_sha256,
      coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (row)"""


@query("op11_personal_data", _personal_sql())
def op11(spark, folder):
    from turnwise.llm.personal_data import report, scan_personal

    return report(scan_personal(table(spark, folder, "documents").select("doc_id", "text")))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a text that repeats its own words from some place on, for a tenth of all ids."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.floor(key / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = seed % n
        p = 1 + F.floor((n - a) / (3 + seed % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        copied = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.array_join(F.when(n > 0, copied).otherwise(words), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    # As the argument of a function the words are found once, not once for each place.
    text = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.withColumn("text", F.when(key % 10 == 0, text).otherwise(F.col("text")))


@query("op12_periodic_runs")
def op12(spark, folder):
    from turnwise.llm.periodic_runs import find_runs, report

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return report(find_runs(with_planted_periods(docs)))


def _divergence_sql() -> str:
    from turnwise.llm.source_divergence import MIN_DOCUMENTS, PARTS, TOP_TERMS

    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS text FROM documents),
    t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCUMENTS}),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c,
        1 + ({PARTS}::HUGEINT * (coalesce(c, 0) + 1)) // (n + v)::HUGEINT AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    whole AS (SELECT lang, term, 1 + ({PARTS}::HUGEINT * (sum(c)::HUGEINT + 1)) // (n + v)::HUGEINT AS q
      FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) USING (lang) GROUP BY lang, term, n, v),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
      FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    WHERE part = 'pair' OR rank <= {TOP_TERMS}"""


@query("op13_source_divergence", _divergence_sql())
def op13(spark, folder):
    from turnwise.llm.source_divergence import audit

    return audit(table(spark, folder, "documents").select("text", "lang", "source"))
