"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and gives it to the
next. All stages but the last return the columns of ``docs``. Columns of other names than doc_id, text, lang, source and
n_chars pass through unchanged. Nulls, empty and repeated rows are handled as the operators' docstrings say; a
document of which a stage leaves no text goes, one that came without text stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from foldwright.llm.common import heaps_trimmed, saved, sized, table

#: No SQL expresses training, suffix sorting and packing; tests hold the stages against brute force.
ORACLE_SQL = None

WORDS, PERCENT = 5, 80  # near copies: shingles of five words, a similarity of 0.8


def trimmed(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage on executors that have first given back the heap of earlier ones: their Python workers need it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        heaps_trimmed(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``_row``, whatever their columns are called, beside ``columns``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(c.alias(n) for n, c in columns.items()))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


@trimmed
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3. The field learns from the labelled rows outside the held-out quarter."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=toxicity.fold_of(F.col("_id")) != 2)
    names, out = {c.lower() for c in docs.columns}, "_toxicity"
    while out in names:
        out += "_"
    return toxicity.tag(docs, model, out_col=out).where(F.col(f"{out}.score") < 0.3).select(*(F.col(f"`{c}`") for c in docs.columns))


@trimmed
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; of rows repeating id and text, one.

    Where ids repeat, a row is known by a hash of its id and text (64 bits), so it goes only where its text links. Rows
    without an id are held against each other, not against the rest, and the smallest hash stays; without words they all stay.
    """
    named, other = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        left = one_of_each(carried(named, _key=F.col("doc_id").cast("long")), repeated=False)
    else:
        left = one_of_each(carried(named, _key=F.xxhash64("doc_id", "text")))
    if not other.isEmpty():
        blank = mixing.n_words(F.col("text")) == 0
        left = left.unionByName(one_of_each(carried(other.where(~blank), _key=F.xxhash64("text")))).unionByName(carried(other.where(blank), _key=F.lit(0).cast("long")))
    return restored(left, docs)


def one_of_each(rows: DataFrame, repeated: bool = True) -> DataFrame:
    """One row of each component of near copies: of the smallest id, then of the smallest key. Not ``repeated``: keys are ids."""
    found = saved(ngram_join.linked(rows.select("_key", F.col("_row.text").alias("text")), id_col="_key", words=WORDS, percent=PERCENT), "linked")
    moved = found.where("_id <> _component").select("_id", "_component").distinct()
    if not repeated:
        gone = saved(moved.select(F.col("_id").alias("_gone")), "gone")
        return rows.join(sized(gone, gone.count(), 200_000), F.col("_key") == F.col("_gone"), "left_anti")
    members = saved(moved.unionByName(moved.select(F.col("_component").alias("_id"), "_component").distinct()), "members")
    n = members.count()
    ids = rows.select(F.col("_key").alias("_id"), F.col("_row.doc_id").alias("doc_id")).join(sized(members, n, 200_000), "_id").select("_component", F.struct("doc_id", F.col("_id").alias("key")).alias("own"))
    ids = saved(ids, "copies")
    stays = ids.groupBy("_component").agg(F.min("own").alias("stays"))
    gone = saved(ids.join(stays, "_component").where("own.key <> stays.key").select(F.col("own.key").alias("_gone")).distinct(), "gone")
    left = rows.join(sized(gone, gone.count(), 200_000), F.col("_key") == F.col("_gone"), "left_anti")
    if found.groupBy("_id").count().where("count > 1").isEmpty():
        return left
    return left.dropDuplicates(["_key"])


@trimmed
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; characters stay whole."""
    carried = {c: f"_carried_{i}_" for i, c in enumerate(c for c in docs.columns if c != "text")}
    slim = docs.select(F.col("doc_id").alias("_doc_"), F.col("text"), *(F.col(f"`{c}`").alias(x) for c, x in carried.items()), F.col("text").isNotNull().alias("_had_text_"))
    keep = [*carried.values(), "_had_text_"]
    out = suffix_dedup.kept_parts(suffix_dedup.deduplicated(slim, id_col="_doc_", carry=keep), keep, with_kept=True, whole_chars=True)
    out = out.where((F.length("kept") > 0) | (F.col("n_removed") == 0)).withColumn("_new_", F.when(F.col("_had_text_"), F.decode("kept", "UTF-8")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("_new_")).otherwise(F.col(carried.get("n_chars", "_new_"))).cast("long")
    new = {"text": F.col("_new_")} | ({"n_chars": n_chars} if "n_chars" in carried else {})
    return out.select(*(new.get(c, F.col(carried.get(c, c))).alias(c) for c in docs.columns))


@trimmed
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the method's seeded blocks take its words, rounded to whole times so that each source's
    words come near its target; so some go.

    Texts without words have no weight in the mix and stay once. Rows repeating id, source and text are taken equally often.
    """
    plan = mixing.whole(docs).where("_times > 0")
    own = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_text_hash"))
    joined = carried(docs, _own=F.xxhash64("text")).join(plan, own)
    return restored(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))), docs)


@trimmed
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place, and the ids."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
