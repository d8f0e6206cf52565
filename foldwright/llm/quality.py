"""Quality by weak supervision (operator 3), with DataFrame functions alone.

Rules vote for (1) or against (-1) a document or abstain (0). Documents within the base limits are counted by their votes, at most 3 ** rules
patterns; on these counts expectation-maximisation estimates each rule's accuracy on good and on bad documents and the
share of good ones. A document's posterior probability of being good decides, in place of passing every rule.

Defined results: null and blank texts have no words, fail the base limits and get all counts 0; repeated rows give
repeated results; a null id stays null; with no documents nothing is estimated and the result is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import SPACE, saved, table, words_of

SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OTHERS = ["_lines", "_letters", "_bare", "_kinds", "_stops"]
ROUNDS = 20

#: (name, votes against, votes for), SQL over the features that Spark and DuckDB both read.
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 50", "n_words >= 80"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 14 * n_words", "word_chars >= 3 * n_words AND word_chars <= 11 * n_words"),
    ("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    ("lines", "n_dup_lines * 10 > 3 * _lines", "n_dup_lines * 10 <= _lines"),
    ("repeats", "n_repeat_words * 10 > 3 * n_words", "n_repeat_words * 10 <= n_words"),
    ("letters", "_letters * 10 < 8 * word_chars", "_letters * 100 >= 90 * word_chars"),
    ("bare", "_bare * 10 > n_words", "_bare * 50 <= n_words"),
    ("kinds", "_kinds * 10 < n_words AND n_words < 5000", "_kinds * 4 >= n_words OR n_words >= 5000"),
    ("stops", "_stops * 100 < n_words", "_stops * 40 >= n_words AND _stops * 2 <= n_words"),
]


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, the five counts of FEATURES and those of OTHERS for each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    df = df.select("_id", "_text", words_of(F.col("_text")).alias("_words"), lines.alias("_line"))
    df = df.select("*", F.size("_words").alias("_n"))
    gram = lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    df = df.withColumn("_grams", F.when(F.col("_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))), gram))))
    same = lambda x, k: x["h"] == F.get("_grams", k)["h"]
    twice = F.filter("_grams", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    df = df.withColumn("_twice", twice)
    inside = F.array_distinct(F.flatten(F.transform("_twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    count = lambda c: F.length(c).cast("long")
    bare = F.regexp_replace("_text", SPACE, "")
    return df.select(
        "_id",
        F.col("_n").cast("long").alias("n_words"),
        count(bare).alias("word_chars"),
        (count(F.col("_text")) - count(F.translate("_text", SYMBOLS, ""))).alias("n_symbols"),
        (F.size("_line") - F.size(F.array_distinct("_line"))).cast("long").alias("n_dup_lines"),
        F.greatest(F.coalesce(F.size(inside), F.lit(0)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_line").cast("long").alias("_lines"),
        count(F.regexp_replace("_text", r"[^\p{L}]", "")).alias("_letters"),
        F.size(F.filter("_words", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("_bare"),
        F.size(F.array_distinct("_words")).cast("long").alias("_kinds"),
        (count(F.col("_text")) - count(F.translate("_text", ".!?", ""))).alias("_stops"),
    )


def votes(rules: list[tuple[str, str, str]] = RULES) -> list[Column]:
    return [F.expr(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"_v_{name}") for name, bad, good in rules]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Share of good documents, and each rule's accuracy on good and on bad ones, by expectation-maximisation over counts of vote patterns.

    The limits keep votes for from speaking against: accuracies on good ones from 0.55 to 0.98, on bad ones from one
    minus that to 0.98, the share from 0.1 to 0.95. Pseudo-counts are ten votes.
    """
    share, on_good, on_bad = 0.85, [0.9] * rules, [0.5] * rules
    for _ in range(rounds):
        total, good = 0.0, 0.0
        sums = [[0.0] * 4 for _ in range(rules)]  # right and cast on good ones, right and cast on bad ones
        for vote, n in patterns:
            p = 1 / (1 + math.exp(-evidence(vote, share, on_good, on_bad)))
            total += n
            good += n * p
            for x, v in zip(sums, vote, strict=True):
                if v:
                    x[0] += n * p * (v > 0)
                    x[1] += n * p
                    x[2] += n * (1 - p) * (v < 0)
                    x[3] += n * (1 - p)
        share = min(0.95, max(0.1, (good + 8.5) / (total + 10)))
        on_good = [min(0.98, max(0.55, (x[0] + 9) / (x[1] + 10))) for x in sums]
        on_bad = [min(0.98, max(1 - a, (x[2] + 5) / (x[3] + 10))) for x, a in zip(sums, on_good, strict=True)]
    return share, on_good, on_bad


def weights(a: float, b: float) -> tuple[float, float]:
    """Log odds that a vote for and a vote against add."""
    return math.log(a / (1 - b)), math.log((1 - a) / b)


def evidence(vote: tuple[int, ...], share: float, on_good: list[float], on_bad: list[float]) -> float:
    return math.log(share / (1 - share)) + sum(weights(a, b)[v < 0] for v, a, b in zip(vote, on_good, on_bad, strict=True) if v)


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``_id``, the features, base_failed, posterior and kept for each document."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = saved(features(docs, id_col=id_col, text_col=text_col).select("*", *votes(rules), base.alias("base_failed")), "quality")
    names = [f"_v_{name}" for name, _, _ in rules]
    patterns = sorted((tuple(r[n] for n in names), r["count"]) for r in found.where("NOT base_failed").groupBy(*names).count().collect())  # 3 ** rules at most
    share, on_good, on_bad = estimate(patterns, len(rules))
    z = F.lit(math.log(share / (1 - share)))
    for n, a, b in zip(names, on_good, on_bad, strict=True):
        plus, minus = weights(a, b)
        z = z + F.when(F.col(n) > 0, plus).when(F.col(n) < 0, minus).otherwise(0.0)
    out = found.withColumn("posterior", 1 / (1 + F.exp(-z)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), *FEATURES, "base_failed", "kept")


def _oracle() -> str:
    """The same in DuckDB's SQL: features, votes, and the rounds of expectation-maximisation one after another."""
    space, n = r"[\x20\x09-\x0D]", len(RULES)
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN -1 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}" for i, (_, bad, good) in enumerate(RULES))
    names = ", ".join(f"v{i}" for i in range(n))
    steps = ["p0 AS MATERIALIZED (SELECT CAST(0.85 AS DOUBLE) AS s, " + ", ".join(f"CAST(0.9 AS DOUBLE) AS a{i}, CAST(0.5 AS DOUBLE) AS b{i}" for i in range(n)) + ")"]
    z = "ln(s / (1 - s)) + " + " + ".join(f"CASE WHEN v{i} > 0 THEN ln(a{i} / (1 - b{i})) WHEN v{i} < 0 THEN ln((1 - a{i}) / b{i}) ELSE 0 END" for i in range(n))
    for k in range(1, ROUNDS + 1):
        on_good = ", ".join(f"least(0.98, greatest(0.55, (sum(CASE WHEN v{i} > 0 THEN c * p ELSE 0 END) + 9) / (sum(CASE WHEN v{i} <> 0 THEN c * p ELSE 0 END) + 10))) AS a{i}" for i in range(n))
        on_bad = ", ".join(f"(sum(CASE WHEN v{i} < 0 THEN c * (1 - p) ELSE 0 END) + 5) / (sum(CASE WHEN v{i} <> 0 THEN c * (1 - p) ELSE 0 END) + 10) AS b{i}" for i in range(n))
        limits = ", ".join(f"a{i}, least(0.98, greatest(1 - a{i}, b{i})) AS b{i}" for i in range(n))
        steps.append(f"p{k} AS MATERIALIZED (SELECT s, {limits} FROM (SELECT least(0.95, greatest(0.1, (sum(c * p) + 8.5) / (sum(c) + 10))) AS s, {on_good}, {on_bad} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM pats, p{k - 1})))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, u.w, u.i FROM d, LATERAL (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT list_filter(regexp_split_to_array(t, '{space}+'), lambda q: q <> '') AS x)) u),
g AS (SELECT r, i, w, lead(w, 1) OVER q AS w1, lead(w, 2) OVER q AS w2 FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS c FROM g WHERE w2 IS NOT NULL) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, count(DISTINCT w) AS kinds, count(*) FILTER (WHERE NOT regexp_matches(w, '\pL')) AS bare FROM w GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE length(regexp_replace(l, '{space}+', '', 'g')) > 0 GROUP BY r),
f AS MATERIALIZED (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '{space}+', '', 'g')) AS word_chars,
 length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(ln.n - ln.k, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words,
 coalesce(ln.n, 0) AS _lines, length(regexp_replace(t, '[^\pL]', '', 'g')) AS _letters, coalesce(kinds, 0) AS _kinds, coalesce(bare, 0) AS _bare, length(t) - length(translate(t, '.!?', '')) AS _stops
 FROM d LEFT JOIN wc USING (r) LEFT JOIN ln USING (r) LEFT JOIN cover USING (r)),
v AS MATERIALIZED (SELECT *, {vote} FROM f),
pats AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS c FROM v WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND post >= 0.5 AS kept FROM (
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({z}))) AS post FROM v, p{ROUNDS})"""


ORACLE_SQL = _oracle()
