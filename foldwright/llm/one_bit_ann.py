"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 2).

Vectors go to the cell of their nearest centroid; the residual, randomly rotated, is kept as its signs (packed bits), its
length and its alignment with the signs. A query's inner product with a vector is estimated from the packed bits (population
counts against the bit planes of the query, rounded to eight bits) and these scalars, with an error bound; only vectors
whose upper bound reaches the query's bar are reranked by the exact inner product on the original vectors in double
precision.

The bar comes first: in each of the query's ``probes`` best cells the 2 k best estimates are scored exactly, and the k-th best
of all of them is a score that k vectors reach. It then holds for all cells of the query. A cell is skipped only when its
largest residual proves that no vector in it reaches the bar; a query without k scores has no bar and meets every row. So
no cell is left out unproven, and where residuals are long the work is that of reading all codes for each query.

Centroids and the rotation are fitted on at most ``SAMPLE`` rows; every vector is indexed. Of rows with equal vectors the k + 1
smallest ids are (more can't be among a query's k). Cells are packed in blocks of about BLOCK rows, larger cells split,
and queries in as many groups as they need, so a cell with any share of all rows spreads over tasks.

Defined results: rows with a null id, and vectors that are null, empty, zero, of another length than most of the sample or
with a null or non-finite component, take no part; of rows repeating a query's id the least vector is the query, and
no row with this id is its candidate; equal scores are ranked by id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import saved, sized, small_table, table

SAMPLE = 20_000
BLOCK = 16_000  # rows that meet a group of queries, about
GROUP = 4000  # queries of a group, about
PLANES = 8  # bits of a query's rounded components


@dataclass
class Codebook:
    centroids: np.ndarray
    rotation: np.ndarray


def fit(sample: np.ndarray, cells: int, seed: int = 2, rounds: int = 12) -> Codebook:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)
        count = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    d = sample.shape[1]
    q, r = np.linalg.qr(rng.standard_normal((d, d)))
    return Codebook(centroids, q * np.sign(np.diag(r)))


def nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * v @ centroids.T, axis=1)


def encode(v: np.ndarray, cell: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths of the residuals, and their alignments (1 for residuals of no length)."""
    x = (v - book.centroids[cell]) @ book.rotation
    length = np.sqrt((x**2).sum(axis=1))
    signs = x > 0
    align = np.abs(x).sum(axis=1) / np.maximum(length, 1e-300) / np.sqrt(v.shape[1])
    return np.packbits(signs, axis=1), length, np.where(length > 0, align, 1.0)


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words."""
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def estimate(q: np.ndarray, centroid: np.ndarray, book: Codebook, bits: np.ndarray, length: np.ndarray, align: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of queries and coded vectors of one cell, and bounds of their errors."""
    d = q.shape[1]
    x = q @ book.rotation
    low, step = x.min(axis=1), np.maximum(np.ptp(x, axis=1), 1e-300) / (2**PLANES - 1)
    level = np.rint((x - low[:, None]) / step[:, None]).astype(np.int64)
    codes = _words(bits)
    met = np.zeros((len(q), len(codes)), dtype=np.int32)  # sum of the levels where the code has a one
    for b in range(PLANES):
        plane = _words(np.packbits((level >> b & 1).astype(bool), axis=1))
        for w in range(codes.shape[1]):
            met += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    on = low[:, None] * ones[None] + step[:, None] * met
    dot = (2 * on - (low * d + step * level.sum(axis=1))[:, None]) / np.sqrt(d)
    slip = np.abs(x - low[:, None] - step[:, None] * level).sum(axis=1) / np.sqrt(d)  # most that rounding the query adds
    scale = length / align
    est = (q @ centroid)[:, None] + dot * scale[None]
    spread = length * np.sqrt(np.maximum(0, 1 - align**2)) / align * eps / np.sqrt(max(1, d - 1))
    return est, np.sqrt((q**2).sum(axis=1))[:, None] * spread[None] + slip[:, None] * scale[None] + 1e-9


def chosen(est: np.ndarray, err: np.ndarray, own: np.ndarray, least: np.ndarray | None, k: int) -> np.ndarray:
    """Which pairs are scored exactly: upper bounds that reach ``least``; without bars the 2 k best estimates."""
    if least is not None:
        return (est + err >= least[:, None]) & ~own
    est = np.where(own, -np.inf, est)
    if est.shape[1] > 2 * k:
        return (est >= np.partition(est, -2 * k, axis=1)[:, -2 * k, None]) & ~own
    return ~own


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best."""
    by = np.lexsort((vec, -score, query))
    q = query[by]
    first = np.searchsorted(q, q, side="left")
    return by[np.arange(len(by)) - first < k]


def reachable(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a cell (its largest residual ``radius``, -1 if it is empty) can hold a vector that scores ``least`` with a query."""
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    most = q @ centroids.T + size * radius[None]
    slack = 1e-9 * size * (np.sqrt((centroids**2).sum(axis=1)) + radius)[None]  # far above what rounding adds
    return (radius >= 0)[None] & ~(most + slack < least[:, None])


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 20, probes: int = 16, eps: float = 2.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` (on ``_id``) holds; ``probes``: cells that give the bar."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    n = rows.count()
    some = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(max(1, n // (4 * SAMPLE)))) == 0  # so tasks send about four times the sample together
    sample = [np.array(r["_v"]) for r in rows.where(some).orderBy(F.xxhash64("_id", F.lit(2)), "_id").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.bincount([len(v) for v in sample])
    dim = int(sizes.argmax())
    rows = rows.where(F.size("_v") == dim)
    book = fit(np.stack([v for v in sample if len(v) == dim]), max(1, min(4096, int(n**0.5 / 2))))
    shared = spark.sparkContext.broadcast(book)  # at most 4096 centroids
    n_cells = len(book.centroids)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["_v"])
                cell = nearest(v, shared.value.centroids)
                bits, length, align = encode(v, cell, shared.value)
                yield pd.DataFrame({"_id": b["_id"], "_v": b["_v"], "_cell": cell.astype(np.int32), "_bits": [x.tobytes() for x in bits], "_length": length, "_align": align})

    equal = Window.partitionBy("_v")
    few = rows.withColumn("_r", F.dense_rank().over(equal.orderBy("_id"))).where(F.col("_r") <= k + 1).drop("_r")
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("_v", "_id").orderBy("_id"))).where(F.col("_r") <= k).drop("_r")
    coded = saved(few.mapInPandas(index, "_id long, _v array<double>, _cell int, _bits binary, _length double, _align double"), "codes")
    queries = rows if is_query is None else rows.where(is_query)
    queries = saved(queries.groupBy("_id").agg(F.min("_v").alias("_v")).select("_id", "_v"), "queries")
    groups = max(1, -(-queries.count() // GROUP))

    size, radius = np.zeros(n_cells, np.int64), np.full(n_cells, -1.0)
    for r in coded.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_length").alias("radius")).collect():  # at most 4096 rows
        size[r["_cell"]], radius[r["_cell"]] = r["n"], r["radius"]
    first, times = placed(size, BLOCK)
    grid = small_table(spark, list(zip(range(n_cells), first.tolist(), times.tolist(), strict=True)), "_c int, _first long, _times long")
    block = F.col("_first") + F.pmod(F.xxhash64("_id", F.lit(3)), F.col("_times"))
    left = coded.join(sized(grid, n_cells), F.col("_cell") == F.col("_c")).withColumn("_block", block).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("_c", "_first", "_times")

    def met(asked: DataFrame, bar: bool) -> DataFrame:
        """The k best of each query in the cells that it asks for: the probed ones, else those that can reach ``_least``."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                q = np.stack(b["_v"])
                if bar:
                    open_ = reachable(q, shared.value.centroids, radius, b["_least"].to_numpy())
                else:
                    score = np.where(radius >= 0, q @ shared.value.centroids.T, -np.inf)
                    open_ = np.zeros(score.shape, dtype=bool)
                    np.put_along_axis(open_, np.argsort(-score, axis=1, kind="stable")[:, :probes], True, axis=1)
                    open_ &= radius >= 0
                row, cell = np.nonzero(open_)
                copies = times[cell]
                at = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, cell, blk = np.repeat(row, copies), np.repeat(cell, copies), np.repeat(first[cell], copies) + at
                by = np.lexsort((cell, blk, row))
                row, cell, blk = row[by], cell[by], blk[by]
                cut = np.flatnonzero((row[1:] != row[:-1]) | (blk[1:] != blk[:-1])) + 1
                head = np.concatenate([[0], cut])[: len(row)]
                yield pd.DataFrame({"_id": b["_id"].to_numpy()[row[head]], "_v": b["_v"].to_numpy()[row[head]], "_least": b["_least"].to_numpy()[row[head]], "_block": blk[head], "_cells": np.split(cell.astype(np.int32), cut) if len(row) else []})

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b):
                a = a.sort_values("_cell")
                v, v_id, cell = np.stack(a["_v"]), a["_id"].to_numpy(), a["_cell"].to_numpy()
                bits, length, align = np.stack([np.frombuffer(x, np.uint8) for x in a["_bits"]]), a["_length"].to_numpy(), a["_align"].to_numpy()
                q, q_id, least = np.stack(b["_v"]), b["_id"].to_numpy(), b["_least"].to_numpy()
                asks = np.concatenate(b["_cells"].to_list())
                who = np.repeat(np.arange(len(b)), [len(c) for c in b["_cells"]])[np.argsort(asks, kind="stable")]
                asks = np.sort(asks)
                for c in np.unique(cell):
                    here = slice(*np.searchsorted(cell, [c, c + 1]))
                    for some in np.array_split(w := who[slice(*np.searchsorted(asks, [c, c + 1]))], -(-max(1, len(w)) * (here.stop - here.start) // 1_000_000)):
                        if not len(some):
                            continue
                        est, err = estimate(q[some], shared.value.centroids[c], shared.value, bits[here], length[here], align[here], eps)
                        i, j = np.nonzero(chosen(est, err, v_id[here][None] == q_id[some][:, None], least[some] if bar else None, k))
                        score = np.concatenate([(v[here][j[z : z + 100_000]] * q[some][i[z : z + 100_000]]).sum(axis=1) for z in range(0, len(i), 100_000)]) if len(i) else np.zeros(0)
                        keep = best_of(i, v_id[here][j], score, k)
                        out.append((some[i[keep]], v_id[here][j[keep]], score[keep]))
            query, vec, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            keep = best_of(query, vec, score, k)
            return pd.DataFrame({"query_id": b["_id"].to_numpy()[query[keep]] if len(keep) else np.zeros(0, np.int64), "vec_id": vec[keep], "score": score[keep]})

        right = asked.mapInPandas(route, "_id long, _v array<double>, _least double, _block long, _cells array<int>").withColumn("_s", F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(groups)).cast("int"))
        return left.groupBy("_block", "_s").cogroup(right.groupBy("_block", "_s")).applyInPandas(meet, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    nearest_cells = ranked(met(queries.withColumn("_least", F.lit(float("-inf"))), bar=False))
    bars = saved(nearest_cells.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("_least")), "bars")
    asked = queries.join(bars, "_id", "left").select("_id", "_v", F.coalesce("_least", F.lit(float("-inf"))).alias("_least"))
    return ranked(met(asked, bar=True))


def placed(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and the number of its blocks: large cells have their own, the others share in order."""
    first, times = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    block, filled = 0, 0
    for c, n in enumerate(size.tolist()):
        if n > most:
            block += filled > 0
            first[c], times[c] = block, -(-n // most)
            block, filled = block + int(times[c]), 0
        else:
            if filled + n > most:
                block, filled = block + 1, 0
            first[c], filled = block, filled + n
    return first, times


def op2_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), is_query=F.col("_id") % 20 == 0)
