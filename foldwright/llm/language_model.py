"""Stupid-backoff language-model scores (operator 4).

A word scores count(n-gram) / count(history) for the longest n-gram that the corpus has, times ``factor`` for each order given
up; for single words count / all words. A document's score is the sum of the logarithms.

``scored`` takes the documents as their own corpus, so every n-gram of theirs has a count and a word gives up an order only
where its text has too few words before it. Then a document's sum is one of weights times log(count) over its n-grams:
one for each n-gram of the full order, minus one for each history. So it is relational: n-grams are exploded to rows (n-gram,
document, weight, times), partitioned by hash, given their n-gram's count and summed by document. The count table and its join
to the n-grams share one exchange, as a sum over each n-gram: a join of both costs twice the disk and half as much CPU
again, beyond the limits. Ranges of the hashes go in waves, whose files go one after another, so all n-grams never
lie on disk together. Rows are summed by document and n-gram, and those without a weight by batch, before they move; so an
n-gram has a row for each document that it counts in, which spill where they are many.

``scored_by`` scores documents by another corpus, word by word, and backs off where an n-gram has no count.

Defined results: null texts and texts without words have 0 words, a sum of 0 and a null mean; repeated rows are documents
of their own and count; a null id stays null; an empty table gives an empty result. Words that a corpus doesn't have
score as if it had them once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import WORD, forget, saved, table
from foldwright.llm.ngram_join import SPACES, STEP, _batches
from foldwright.llm.hashing import inverse_powers, mixed, prefix_hashes, span_hash


def words_of_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, one after another, and each text's number of words."""
    raws = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8) if raws else np.zeros(0, np.uint8)
    edge = np.diff(np.concatenate([[True], SPACES[raw]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums, _ = prefix_hashes(raw, 5)
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    owner = np.searchsorted(first, begin, side="right") - 1
    return span_hash(sums, inverse_powers(len(raw)), begin, end), np.bincount(owner, minlength=len(raws))


def grams(word: np.ndarray, count: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; 0 where the text has too few words before."""
    place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for n in range(1, order + 1):
        h = np.full(len(word), n, dtype=np.uint64)
        for k in range(n - 1, -1, -1):
            h = mixed(h * STEP + np.concatenate([np.zeros(min(k, len(word)), np.uint64), word[: max(0, len(word) - k)]]))
        out.append(np.where(place >= n - 1, np.maximum(h, 1), 0).astype(np.uint64))
    return out


def weights(count: np.ndarray, order: int) -> list[np.ndarray]:
    """How often log(count) of each order's n-gram at each word enters its text's score."""
    place = 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.repeat(count, count)
    used, after = np.minimum(place, order), np.minimum(place + 1, order) - 1  # the word's n-gram; the next word's history
    return [(used == n).astype(np.int64) - ((place < size) & (after == n)) for n in range(1, order + 1)]


EXPLODED = "_gram long, _row long, _weight long, _times long"


def exploded(texts: DataFrame, order: int, wave: int, waves: int, batch_chars: int = 1_500_000) -> DataFrame:
    """Rows of EXPLODED for the n-grams of all orders in one of ``waves`` ranges of hashes; ``texts``: _row, _text.

    N-grams of a document that have no weight in its score are summed over a batch, without ``_row``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for begin, part in _batches(batch, 1, batch_chars):
                word, count = words_of_texts(part)
                owner = np.repeat(np.arange(len(part)), count)
                found = []
                for h, w in zip(grams(word, count, order), weights(count, order), strict=True):
                    here = np.flatnonzero((h > 0) & ((h >> np.uint64(32)) * np.uint64(waves) >> np.uint64(32) == wave))
                    found.append((h[here], np.where(w[here] != 0, owner[here], -1), w[here]))
                gram, doc, weight = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.argsort(gram, kind="stable")  # documents come in order
                gram, doc, weight = gram[by], doc[by], weight[by]
                new = np.ones(len(gram), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(gram)))
                total = np.add.reduceat(weight, first) if len(first) else weight
                doc = doc[first]
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(rows[begin + np.maximum(doc, 0)], mask=doc < 0), pa.array(total), pa.array(times.astype(np.int64))], names=[c.split()[0] for c in EXPLODED.split(", ")])

    return texts.mapInArrow(run, EXPLODED)


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, factor: float = 0.4, waves: int = 5) -> DataFrame:
    """(_id, n_words, log_score) of each row, by the counts of all rows."""
    n_words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id"), n_words.alias("n_words"))
    texts = saved(texts, "texts")
    sums: DataFrame | None = None
    for wave in range(waves):
        part = exploded(texts.select("_row", "_text"), order, wave, waves)
        # the range's count table and its join to the n-grams, over one exchange: each row gets its n-gram's total
        met = part.withColumn("_count", F.sum("_times").over(Window.partitionBy("_gram"))).where("_weight <> 0")
        own = saved(met.groupBy("_row").agg(F.sum(F.col("_weight") * F.log("_count")).alias("_sum")), "sums")
        sums = own if sums is None else sums.unionByName(own)
    all_words = texts.agg(F.sum("n_words")).first()[0] or 1
    # the first word's denominator, and the orders that the first words give up
    given_up = sum((F.when(F.col("n_words") >= i, float(order - i)).otherwise(0.0) for i in range(1, order)), F.lit(0.0))
    start = F.when(F.col("n_words") > 0, given_up * math.log(factor) - math.log(all_words)).otherwise(0.0)
    total = sums.groupBy("_row").agg(F.sum("_sum").alias("_sum"))
    return texts.select("_row", "_id", "n_words").join(total, "_row", "left").select("_id", "n_words", (F.coalesce("_sum", F.lit(0.0)) + start).alias("log_score"))


def scored_by(docs: DataFrame, corpus: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, factor: float = 0.4) -> DataFrame:
    """(_id, n_words, log_score) of each row of ``docs``, by the counts of ``corpus``: every word's n-grams and histories are
    joined to the count table, and the longest one that it has scores the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for begin, part in _batches(batch, 1, 300_000):
                word, count = words_of_texts(part)
                place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
                row = rows[begin + np.repeat(np.arange(len(part)), count)]
                size = np.repeat(count, count)
                for n, h in enumerate(grams(word, count, order), 1):
                    for kind, at in ((0, h > 0), (1, (h > 0) & (place + 1 < size) & (n < order))):  # the word's own; the next one's history
                        k = int(at.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(row[at]), pa.array(place[at] + kind), pa.array(np.full(k, n + kind, np.int32)), pa.array(np.full(k, kind, np.int32))], names=["_gram", "_row", "_place", "_n", "_kind"])

    base = corpus.select(F.lit(0).cast("long").alias("_row"), F.col(text_col).alias("_text"))
    counts = saved(exploded(base, order, 0, 1).groupBy("_gram").agg(F.sum("_times").alias("_count")), "counts")
    all_words = corpus.agg(F.sum(F.regexp_count(text_col, F.lit(WORD)))).first()[0] or 1
    texts = saved(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id")), "texts")
    rows = texts.select("_row", "_text").mapInArrow(run, "_gram long, _row long, _place long, _n int, _kind int").join(counts, "_gram", "left")
    of = lambda n, kind: F.max(F.when((F.col("_n") == n) & (F.col("_kind") == kind), F.coalesce("_count", F.lit(0))))
    each = rows.groupBy("_row", "_place").agg(*(of(n, kind).alias(f"_{kind}_{n}") for n in range(1, order + 1) for kind in (0, 1) if (n, kind) != (1, 1)))
    value = F.log(F.greatest("_0_1", F.lit(1)) / F.lit(float(all_words))) + (order - 1) * math.log(factor)
    for n in range(2, order + 1):
        value = F.when(F.col(f"_0_{n}") > 0, F.log(F.col(f"_0_{n}") / F.col(f"_1_{n}")) + (order - n) * math.log(factor)).otherwise(value)
    total = each.groupBy("_row").agg(F.count("*").alias("n_words"), F.sum(value).alias("_sum"))
    return texts.select("_row", "_id").join(total, "_row", "left").select("_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("_sum", F.lit(0.0)).alias("log_score"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return out.select(F.col("_id").alias("doc_id"), "n_words", F.round("log_score", 4).alias("log_score"), mean.alias("mean_log_score"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda q: q <> '') AS x FROM documents),
w AS MATERIALIZED (SELECT r, u.w, u.i FROM d, LATERAL (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i) u),
g AS MATERIALIZED (SELECT r, i, w, lag(w, 1) OVER q AS b, lag(w, 2) OVER q AS a FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, a, b, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER (PARTITION BY b, w) AS c2, count(*) OVER (PARTITION BY a, b, w) AS c3 FROM g),
h AS (SELECT *, lag(c1) OVER q AS h1, lag(c2) OVER q AS h2, (SELECT count(*) FROM w) AS n FROM c WINDOW q AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, count(*) AS n_words, sum(CASE WHEN a IS NOT NULL THEN ln(c3) - ln(h2) WHEN b IS NOT NULL THEN ln(c2) - ln(h1) + ln(0.4) ELSE ln(c1) - ln(n) + 2 * ln(0.4) END) AS s FROM h GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(s, 0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(s / n_words, 6) END AS mean_log_score FROM d LEFT JOIN s USING (r)"""
