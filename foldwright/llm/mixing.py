"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 5).

Equal blocks of words are allotted to sources by highest quotients of their targets, then to each source's shards by
highest quotients of the shards' sizes. A shard's words, its documents in seeded order, form one axis cut into blocks;
its quota covers whole passes over the axis and a seeded, evenly spread choice of blocks for the rest.

Defined results: null texts and texts without words have size 0 and nothing is taken of them; a null source is a source
of its own; repeated rows are documents of their own; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import WORD, saved, sized, small_table, table

CELLS = 1024  # most shards of a source
LONG = 100_000  # most documents of a source that one task chooses from, long ones first


def apportion(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 * seats so far + 1); ties to the earlier."""
    w = np.asarray(weights, dtype=float)
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return [0] * len(w)
    q = np.floor(w * (seats / w.sum()) + 0.5).astype(np.int64)  # one divisor for all: these are highest quotients already
    short = seats - int(q.sum())
    if short > 0:
        heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(w, q, strict=True)) if x > 0]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heapq.heappop(heap)
            q[i] += 1
            heapq.heappush(heap, (-w[i] / (2 * q[i] + 1), i))
    elif short < 0:
        heap = [(x / (2 * k - 1), -i) for i, (x, k) in enumerate(zip(w, q, strict=True)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            q[-i] -= 1
            if q[-i]:
                heapq.heappush(heap, (w[-i] / (2 * q[-i] - 1), i))
    return q.tolist()


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """All sizes shared by weight; no share above ``most`` times its size, the excess reshared by weight."""
    out = [0.0] * len(sizes)
    rest, open_ = float(sum(sizes)), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in above)
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_turns(n: int) -> list[float]:
    return [float(i % 3 + 1) for i in range(n)]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weigh: Callable[[int], list[float]] = by_turns, most: int = 3, block: int = 16, shard_words: int = 32_768, seed: int = 5) -> DataFrame:
    """One row a document: ``_id, _source, _text_hash``, size, source_size, target, taken and passes (whole ones).

    ``weigh``: weights of so many sources, in order of code points, null last. The driver sees one row a source.
    """
    slim = saved(sizes_of(docs, id_col, text_col, source_col), "mix")
    return in_blocks(slim, weigh, most, block, shard_words, seed).select("_id", "_source", "_text_hash", "size", "source_size", "target", "taken", "passes")


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(text_col).alias("_text_hash"), n_words(F.col(text_col)).alias("size"))


def in_blocks(slim: DataFrame, weigh: Callable[[int], list[float]], most: int, block: int, shard_words: int, seed: int) -> DataFrame:
    """Rows (_id, _source, _text_hash, size) with what the method takes of each: blocks go to sources, then to their shards, by
    highest quotients, and a shard's quota chooses seeded blocks. Adds _at, _shard, source_size, target, taken and passes.
    """
    spark = slim.sparkSession
    order = F.xxhash64(F.lit(seed), "_id", "_text_hash")
    slim = slim.withColumn("_order", order).withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(CELLS)).cast("int"))
    sources = slim.groupBy("_source").agg(F.sum("size").alias("n")).orderBy(F.col("_source").asc_nulls_last()).collect()
    sizes = [r["n"] for r in sources]
    goal = targets(sizes, weigh(len(sizes)), most)
    seats = apportion(goal, round(sum(sizes) / block))
    rows = [(r["_source"], i, n, t, q, max(1, min(CELLS, -(-n // shard_words)))) for i, (r, n, t, q) in enumerate(zip(sources, sizes, goal, seats, strict=True))]
    names = sized(small_table(spark, rows, "_name string, _at long, source_size long, target double, _seats long, _shards long"), len(rows))
    placed = slim.join(names, F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_shard", F.floor(F.col("_cell") * F.col("_shards") / CELLS).cast("int"))

    def share(part: pd.DataFrame) -> pd.DataFrame:
        """Quotas of one source's shards, CELLS rows at most."""
        part = part.sort_values("_shard")
        return pd.DataFrame({"_at": part["_at"], "_shard": part["_shard"], "_words": part["_words"], "_quota": apportion(part["_words"].tolist(), int(part["_seats"].iloc[0]))})

    shards = placed.groupBy("_at", "_shard").agg(F.sum("size").alias("_words"), F.first("_seats").alias("_seats"))
    quotas = shards.groupBy("_at").applyInPandas(share, "_at long, _shard int, _words long, _quota long")
    axis = Window.partitionBy("_at", "_shard").orderBy("_order", "_id", "size")
    placed = placed.withColumn("_end", F.sum("size").over(axis.rowsBetween(Window.unboundedPreceding, 0)))
    out = placed.join(quotas, ["_at", "_shard"]).withColumn("_want", F.least(F.col("_quota") * block, most * F.col("_words")))
    some = F.col("_words") > 0
    out = out.withColumn("passes", F.when(some, F.floor(F.col("_want") / F.col("_words"))).otherwise(0).cast("long"))
    out = out.withColumn("_n", F.ceil(F.col("_words") / block)).withColumn("_r", F.round((F.col("_want") - F.col("passes") * F.col("_words")) / block).cast("long"))
    out = out.withColumn("_u", F.when(some, F.pmod(F.xxhash64(F.lit(seed + 2), "_at", "_shard"), F.col("_n"))).otherwise(0))

    def chosen(b: Column) -> Column:
        """Chosen blocks before block b."""
        return F.when(some, F.floor((b * F.col("_r") + F.col("_u")) / F.col("_n"))).otherwise(0)

    def words(x: Column) -> Column:
        """Words of chosen blocks before position x."""
        b = F.floor(x / block)
        return chosen(b) * block + (chosen(b + 1) - chosen(b)) * (x - b * block)

    begin = F.col("_end") - F.col("size")
    taken = (F.col("passes") * F.col("size") + words(F.col("_end")) - words(begin)).cast("long")
    return out.select("_id", "_source", "_text_hash", "size", "_order", "_at", "_shard", "source_size", "target", taken.alias("taken"), "passes")


def chosen_whole(weight: np.ndarray, part: np.ndarray, later: int = 0, later_part: float = 0.0) -> np.ndarray:
    """Which documents to take whole, given long ones first, where blocks take ``part`` of the words of each: to get as many
    words as the parts have, with those of documents that come ``later``.

    By the running remainder, unless what is left to take would then be below zero or more than the documents after it hold.
    """
    take, carry = np.zeros(len(weight), dtype=bool), 0.0
    after, left = int(weight.sum()) + later, float(part.sum()) + later_part
    for i, (w, p) in enumerate(zip(weight.tolist(), part.tolist(), strict=True)):
        after -= w
        carry += p
        over, under = max(0.0, w - left), max(0.0, left - after)
        if over <= under if over or under else 2 * carry >= w:
            take[i] = True
            carry -= w
            left -= w
    return take


def whole(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weigh: Callable[[int], list[float]] = by_turns, most: int = 3, block: int = 16, shard_words: int = 1_048_576, seed: int = 5) -> DataFrame:
    """(_id, _source, _text_hash, _times): how often to take each document whole, by the blocks that ``mix`` takes of it.

    The quotas of sources and shards and the seeded blocks are those of the method. Whole passes go to all documents. What the chosen
    blocks hold of the words beyond is rounded to whole documents by a running remainder: first those of at least
    1 / LONG of their source's words, longest first, and then the shorter ones, by shard, which take up what these left. A source
    whose words all lie in documents too long for its target keeps its shortest one. Rows repeating id, source and text are
    one document as long as all of them; texts without words are taken once. The driver sees one row a source.
    """
    spark = docs.sparkSession
    slim = sizes_of(docs, id_col, text_col, source_col)
    slim = saved(slim.groupBy("_id", "_source", "_text_hash").agg(F.sum("size").alias("size")), "whole")
    kinds = dict(slim.dtypes)
    placed = in_blocks(slim, weigh, most, block, shard_words, seed).where("size > 0").withColumn("_part", (F.col("taken") - F.col("passes") * F.col("size")).cast("double"))
    placed = saved(placed.withColumn("_long", F.col("size") * LONG >= F.col("source_size")), "placed")
    names = "_at", "_target", "_words", "_part", "_later", "_later_part", "_passes"
    of = lambda c, long: F.coalesce(F.sum(F.when(F.col("_long") == long, F.col(c))), F.lit(0))
    sources = placed.groupBy("_at").agg(F.first("target"), of("size", True), of("_part", True).cast("double"), of("size", False), of("_part", False).cast("double"), F.max("passes")).toDF(*names).collect()

    def choose(part: pa.Table) -> pa.Table:
        weight, order, text = (part.column(c).to_numpy() for c in ("size", "_order", "_text_hash"))
        part = part.take(pa.array(np.lexsort((text, order, -weight))))
        weight, some = part.column("size").to_numpy(), part.column("_part").to_numpy()
        later, later_part, alone = (part.column(c)[0].as_py() for c in ("_later", "_later_part", "_alone"))
        take = chosen_whole(weight, some, later, later_part)
        take[-1] |= alone and not take.any()
        return part.select(["_id", "_source", "_text_hash", "_at", "size"]).append_column("_times", pa.array(part.column("passes").to_numpy() + take.astype(np.int64))).append_column("_extra", pa.array(take))

    def taken(part: DataFrame, keys: list[str], rows: list[tuple], ddl: str) -> DataFrame:
        part = part.join(sized(small_table(spark, rows, f"_at long, {ddl}"), len(rows)), "_at")
        return part.groupBy(*keys).applyInArrow(choose, f"_id {kinds['_id']}, _source {kinds['_source']}, _text_hash long, _at long, size long, _times long, _extra boolean")

    known = [(r["_at"], r["_later"], r["_later_part"], r["_later"] == 0 and r["_passes"] == 0 and r["_target"] > 0) for r in sources]
    out = taken(placed.where("_long"), ["_at"], known, "_later long, _later_part double, _alone boolean")
    short = [r for r in sources if r["_later"]]
    if short:
        out = saved(out, "long")
        got = {r["_at"]: r["n"] for r in out.where("_extra").groupBy("_at").agg(F.sum("size").alias("n")).collect()}
        # the words that the long ones left or took too many, over the shorter ones by what blocks leave or take of each
        rows = []
        for r in short:
            left = r["_part"] - got.get(r["_at"], 0)
            free = r["_later"] - r["_later_part"]
            rows.append((r["_at"], min(1.0, left / free) if left > 0 and free > 0 else 0.0, max(0.0, 1 + left / r["_later_part"]) if left < 0 and r["_later_part"] > 0 else 1.0))
        some = F.col("_part") * F.col("_less") + (F.col("size") - F.col("_part")) * F.col("_more")
        rest = placed.where("NOT _long").join(sized(small_table(spark, rows, "_at long, _more double, _less double"), len(rows)), "_at").withColumn("_part", some)
        out = out.unionByName(taken(rest, ["_at", "_shard"], [(r["_at"], 0, 0.0, False) for r in short], "_later long, _later_part double, _alone boolean"))
    empty = slim.where("size = 0").select("_id", "_source", "_text_hash", F.lit(1).cast("long").alias("_times"))
    return out.select("_id", "_source", "_text_hash", "_times").unionByName(empty)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")
