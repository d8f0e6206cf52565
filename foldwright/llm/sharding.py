"""Shards by a consistent-hash ring with virtual nodes and bounded loads (operator 6), with built-in functions alone.

The ring has ``cells`` places; each shard owns ``virtual`` of them, and a key belongs to the first owned place at or
after its own. Keys are counted by cell, so the driver sees at most cells * 8 counts. A shard takes the keys that belong to
it in ring order until it is full; keys beyond continue clockwise to the next shard with room. With ``slack`` 0 the
rooms are the row counts shared out evenly, so counts differ by one at most; with more slack fewer keys move.

Keys of a cell are numbered in GROUPS groups, to which rows that are equal are dealt too.

Defined results: a null text has no bytes and the checksum of the empty text; a row without an id is placed by its text;
repeated rows each get a slot; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import saved, sized, small_table, table, utf8

GROUPS = 8  # in which the keys of a cell are numbered


def ring(shards: int, virtual: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard), by cell; a place that is taken passes to the next free one."""
    taken: dict[int, int] = {}
    for v in range(virtual):
        for s in range(shards):
            at = xxhash.xxh64_intdigest(f"{s}:{v}") % cells
            while at in taken:
                at = (at + 1) % cells
            taken[at] = s
    return sorted(taken.items())


def flow(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first key, end, shard, first slot) such that no shard gets more than its room.

    Keys go home first, cell by cell; what is over then walks clockwise.
    """
    places = [c for c, _ in nodes]
    used = [0] * len(room)
    out, over = [], []
    for cell in sorted(counts):
        home = bisect_left(places, cell) % len(nodes)
        shard = nodes[home][1]
        n = min(counts[cell], room[shard] - used[shard])
        if n:
            out.append((cell, 0, n, shard, used[shard]))
            used[shard] += n
        if n < counts[cell]:
            over.append((cell, n, home))
    for cell, done, home in over:
        at = home
        while done < counts[cell]:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            n = min(counts[cell] - done, room[shard] - used[shard])
            if n:
                out.append((cell, done, done + n, shard, used[shard]))
                used[shard] += n
                done += n
    return out


def rooms(rows: int, shards: int, slack: float) -> list[int]:
    """Room of each shard; together at least ``rows``."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, virtual: int = 64, cells: int = 4096, slack: float = 0.0) -> DataFrame:
    """One row a document: ``_id``, size, text_crc32, shard, slot, and whether it moved on from a full shard."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(utf8(F.col(text_col))).alias("text_crc32"))
    home = F.when(F.col("_id").isNotNull(), F.xxhash64("_id")).otherwise(F.xxhash64("text_crc32", "size", F.lit(1)))
    salt = F.monotonically_increasing_id() % 1024
    slim = saved(slim.withColumn("_cell", F.pmod(home, F.lit(cells))).withColumn("_group", F.pmod(F.xxhash64("_id", "text_crc32", "size", salt), F.lit(GROUPS))), "shards")
    counted = sorted((r["_cell"], r["_group"], r["count"]) for r in slim.groupBy("_cell", "_group").count().collect())
    base, total = [], {}
    for cell, group, n in counted:
        base.append((cell, group, total.get(cell, 0)))
        total[cell] = total.get(cell, 0) + n
    nodes = ring(shards, virtual, cells)
    parts = flow(total, nodes, rooms(sum(total.values()), shards, slack))
    places = [c for c, _ in nodes]
    parts = [(*p, nodes[bisect_left(places, p[0]) % len(nodes)][1] != p[3]) for p in parts]
    first = small_table(spark, base, "_c long, _g long, _base long")
    where = sized(small_table(spark, parts, "_c2 long, _from long, _to long, shard int, _slot long, moved boolean"), len(parts))
    key = F.row_number().over(Window.partitionBy("_cell", "_group").orderBy("_id", "text_crc32", "size")) - 1
    numbered = slim.withColumn("_k", key).join(sized(first, len(base)), (F.col("_cell") == F.col("_c")) & (F.col("_group") == F.col("_g"))).withColumn("_k", F.col("_k") + F.col("_base"))
    out = numbered.join(where, (F.col("_cell") == F.col("_c2")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    return out.select("_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_k") - F.col("_from")).alias("slot"), "moved")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")
