"""Suffix-array deduplication of byte strings (operator 1).

Finds every string of ``LENGTH`` bytes that also starts earlier: in a document with a smaller id, or earlier in the same.

Suffixes are taken at anchors that the bytes themselves determine: in each string of LENGTH bytes, the place of the
smallest hash of GRAM bytes. Equal strings have equal anchors, so a suffix at an anchor with the bytes before it (a
stretch) stands for all strings with this anchor. Anchors that occur once end there. Equal stretches are aggregated before
anything is sorted, first by each task among those it has met, then by key: they are told by 121 bits of digest, and the
earliest stands for all. What is left at anchors with different stretches around them is suffix-sorted: sampled splitters
range-partition it by the gram at the anchor, so equal strings lie in one bucket. A gram with more stretches than a bucket
holds is wide: it is split by its further bytes (then the bytes before the anchor, so no common suffix overfills a bucket).
Each bucket sorts by multikey quicksort, common prefixes of neighbours group equal strings, whose bytes are compared, and
groups of wide grams that reach an end of their bucket are compared across buckets.

A task that meets an anchor's gram with a second stretch says so once, and deals further ones by stretch, of equal ones the
first, so neither a phrase in many contexts nor a repeated one gathers in one task.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing; a null id comes after all others; rows that
repeat an id are separate documents in order of a hash of their texts; rows that repeat both id and text count as one
document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import released, saved, sized, table
from foldwright.llm.hashing import MIX, PRIME, inverse_powers, mixed, powers, prefix_hashes, span_hash

LENGTH = 100
GRAM = 30
WINDOW = LENGTH - GRAM + 1  # grams in a string, and so most strings in a stretch
RIGHT = LENGTH  # most bytes of a suffix that matter
LEFT = WINDOW - 1  # most bytes before it
NO_ID = np.iinfo(np.int64).max
SEEN = 100_000  # stretches a task remembers


def stretches(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """All stretches of texts that lie one after another in ``raw``: text number, first string's place in its text,
    strings, anchor's distance from there, hash of the anchor's gram, and of all bytes (its low bits: the strings)."""
    if len(raw) < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "rel", "gram", "body")}
    inverse = inverse_powers(len(raw))
    sums, _ = prefix_hashes(raw, 1)
    at = np.arange(len(raw) - GRAM + 1)
    grams = span_hash(sums, inverse, at, at + GRAM)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    low, width = key, 1  # smallest key in windows of doubling width
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(key) - WINDOW + 1], low[WINDOW - width : WINDOW - width + len(key) - WINDOW + 1])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(size)), np.maximum(0, size - LENGTH + 1))
    place = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(0, size - LENGTH + 1)) - np.maximum(0, size - LENGTH + 1), np.maximum(0, size - LENGTH + 1))
    where = begin[text] + place
    anchor = anchor[where]
    new = np.ones(len(where), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(where)))
    sums2, _ = prefix_hashes(raw, 2)
    body = span_hash(sums2, inverse, where[first], where[first] + n + LENGTH - 1)
    rel = anchor[first] - where[first]
    body = (mixed(body + rel.astype(np.uint64)) & ~np.uint64(127)) | n.astype(np.uint64)
    return {"text": text[first], "start": place[first], "n": n, "rel": rel, "gram": grams[anchor[first]].view(np.int64), "body": body.view(np.int64)}


NORMAL, LATER, MANY, MARK = range(4)  # kinds of rows: as they come; an earlier equal one is known; the gram has others; only a sign of that
SCAN = "_gram long, _body long, _id long, _hash long, _start int, _n int, _rel int, _kind int"


def scan(docs: DataFrame, batch_bytes: int = 200_000) -> DataFrame:
    """Stretches of the texts of ``docs`` (_id, _hash, _text) by kind, as far as a task knows: it remembers the first
    stretch of each gram, and where others start. A worker takes about 200 bytes for each byte of a part, and for each SEEN some 400."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, tuple[int, int, int]]] = {}
        others: dict[tuple[int, int], tuple[int, int, int]] = {}  # by gram and body
        told: set[int] = set()
        for whole in batches:
            for ids, hashes, texts in _parts(whole, batch_bytes):
                raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
                size = np.array([len(t) for t in texts], dtype=np.int64)
                s = stretches(raw, np.cumsum(size) - size, size)
                doc, hsh = ids[s["text"]], hashes[s["text"]]
                kind, marks = np.full(len(doc), NORMAL, dtype=np.int32), []
                for i, (gram, body, me) in enumerate(zip(s["gram"].tolist(), s["body"].tolist(), zip(doc.tolist(), hsh.tolist(), s["start"].tolist(), strict=True), strict=True)):
                    first = seen.get(gram)
                    if first is None or first[0] == body and me < first[1]:
                        seen[gram] = body, me
                    elif first[0] != body:
                        twin = others.get((gram, body))
                        if twin is not None and me > twin:
                            kind[i] = LATER
                            continue
                        kind[i], others[gram, body] = MANY, me
                        if gram not in told:
                            told.add(gram)
                            marks.append(i)
                    elif me > first[1]:
                        kind[i] = LATER
                if len(seen) + len(others) > SEEN:
                    seen.clear()
                    others.clear()
                    told.clear()
                every = np.concatenate([np.arange(len(doc)), np.array(marks, dtype=np.int64)])
                kind = np.concatenate([kind, np.full(len(marks), MARK, dtype=np.int32)])
                body = np.where(kind == MARK, ~s["body"][every], s["body"][every])
                yield pa.RecordBatch.from_arrays([pa.array(s["gram"][every]), pa.array(body), pa.array(doc[every]), pa.array(hsh[every]), *(pa.array(s[c][every].astype(np.int32)) for c in ("start", "n", "rel")), pa.array(kind)], names=[c.split()[0] for c in SCAN.split(", ")])
        seen.clear()
        others.clear()
        released()

    return docs.mapInArrow(run, SCAN)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    ids, hashes = (np.array(batch.column(i).to_pylist(), dtype=np.int64) for i in (0, 1))
    begin, size, texts = 0, 0, []
    for i, t in enumerate(batch.column(2)):
        texts.append((t.as_py() or "").encode())
        size += len(texts[-1])
        if size >= most:
            yield ids[begin : i + 1], hashes[begin : i + 1], texts
            begin, size, texts = i + 1, 0, []
    if texts:
        yield ids[begin:], hashes[begin:], texts


def keys_of(content: list[bytes], rel: np.ndarray) -> np.ndarray:
    """Sort keys: the suffix from the anchor, then the bytes before it from right to left; both padded."""
    out = np.zeros((len(content), RIGHT + LEFT + 6), dtype=np.uint8)
    for i, (c, r) in enumerate(zip(content, rel.tolist(), strict=True)):
        right, left = c[r : r + RIGHT], c[:r][::-1][:LEFT]
        out[i, : len(right)] = np.frombuffer(right, np.uint8)
        out[i, RIGHT : RIGHT + len(left)] = np.frombuffer(left, np.uint8)
    return out


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way partition by one word at a time, equal rows by the next word."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth >= words.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 32:
            order[low:high] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        x = words[part, depth]
        pivot = np.sort(x[:: max(1, len(x) // 31)])[len(x[:: max(1, len(x) // 31)]) // 2]
        less, equal = x < pivot, x == pivot
        a, b = int(less.sum()), int(equal.sum())
        order[low:high] = np.concatenate([part[less], part[equal], part[~less & ~equal]])
        todo += [(low, low + a, depth), (low + a, low + a + b, depth + 1), (low + a + b, high, depth)]
    return order


FOUND = "_id long, _hash long, _start int, _n int, _k1 long, _k2 long"


def resolve(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, n: np.ndarray, rel: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Strings of a bucket's stretches that start earlier elsewhere in it, as runs; strings that may have equals in other
    buckets (of ``wide`` grams, with the right part of the bucket's first or last suffix) with two hashes instead."""
    order = multikey_quicksort(keys.view(">u8"))
    keys, ids, hashes, start, n, rel, wide = (x[order] for x in (keys, ids, hashes, start, n, rel, wide))
    differ = keys[1:, :RIGHT] != keys[:-1, :RIGHT]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), RIGHT)  # prefix shared with the row before
    near = np.zeros(len(keys), dtype=np.int64)  # prefix shared with an end of the bucket
    for end in (0, -1) if wide.any() else ():
        d = keys[:, :RIGHT] != keys[end, :RIGHT]
        near = np.maximum(near, np.where(d.any(axis=1), d.argmax(axis=1), RIGHT) * wide)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[np.lexsort((start + rel, hashes, ids))] = np.arange(len(keys))
    h1, h2 = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
    may = near >= GRAM  # right parts have as much
    slot = np.cumsum(may) - 1
    sums1 = np.zeros((int(may.sum()), RIGHT + 1), np.uint64)
    sums1[:, 1:] = np.cumsum(mixed(keys[may, :RIGHT].astype(np.uint64) + np.uint64(1)) * powers(RIGHT)[:-1], axis=1)
    late_row, late_at, open_row, open_at, open1, open2 = [], [], [], [], [], []
    for o in range(LEFT + 1):
        if o:
            byte = keys[:, RIGHT + o - 1].astype(np.uint64) + np.uint64(1)
            h1, h2 = h1 * PRIME + mixed(byte), h2 * MIX + mixed(byte + np.uint64(7))
        has = np.flatnonzero((o <= rel) & (o > rel - n))
        if not has.size:
            continue
        right = LENGTH - o
        group = np.concatenate([[0], np.cumsum(common < right)])[has].astype(np.uint64)
        key = mixed(h1[has] + group * MIX) ^ h2[has]
        by = np.lexsort((rank[has], key))
        again = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        a, b = has[by[again + 1]], has[by[again]]
        equal = (group[by[again + 1]] == group[by[again]]) & (keys[a, RIGHT : RIGHT + o] == keys[b, RIGHT : RIGHT + o]).all(axis=1)
        dup = np.zeros(len(has), dtype=bool)
        dup[by[again[equal] + 1]] = True
        late = has[dup]
        late_row.append(late)
        late_at.append(start[late] + rel[late] - o)
        across = has[~dup & (near[has] >= right)]
        if across.size:
            open_row.append(across)
            open_at.append(start[across] + rel[across] - o)
            sums = sums1[slot[across], right]
            open1.append(mixed(h1[across] ^ mixed(sums)))
            open2.append(mixed(h2[across] + sums * PRIME + np.uint64(o)))
    row, at = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (late_row, late_at))
    by = np.lexsort((at, row))
    row, at = row[by], at[by]
    head = np.ones(len(row), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(row)))
    row2, at2 = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (open_row, open_at))
    k1, k2 = (np.concatenate([np.zeros(0, np.uint64), *x]).astype(np.uint64).view(np.int64) for x in (open1, open2))
    every = np.concatenate([row[first], row2])
    return {"_id": ids[every], "_hash": hashes[every], "_start": np.concatenate([at[first], at2]).astype(np.int32), "_n": np.concatenate([count, np.zeros(len(row2), np.int64)]).astype(np.int32), "_k1": np.concatenate([np.zeros(len(first), np.int64), k1]), "_k2": np.concatenate([np.zeros(len(first), np.int64), k2])}


def sorted_suffixes(texts: DataFrame, rest: DataFrame, buckets: int) -> DataFrame:
    """Rows of FOUND for stretches ``rest`` (_id, _hash, _start, _n, _rel, _wide); ``texts``: _id, _hash, _raw."""
    begin = F.col("_start") + 1
    full = rest.join(texts, ["_id", "_hash"]).select("_id", "_hash", "_start", "_n", "_rel", "_wide", F.substring("_raw", begin, F.col("_n") + LENGTH - 1).alias("_content"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                key = keys_of([bytes(c) for c in b["_content"]], b["_rel"].to_numpy())
                yield b.drop(columns="_content").assign(_key=[k.tobytes() for k in key])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts)
            keys = np.frombuffer(b"".join(b["_key"]), dtype=np.uint8).reshape(len(b), -1)
            yield pd.DataFrame(resolve(*(b[c].to_numpy().astype(np.int64) for c in ("_id", "_hash", "_start", "_n", "_rel")), b["_wide"].to_numpy().astype(bool), keys))
        released()

    # Spark samples the keys of all suffixes for the splitters; all stretches of a gram that isn't wide have one key
    placed = full.mapInPandas(place, "_id long, _hash long, _start int, _n int, _rel int, _wide boolean, _key binary")
    by = F.when(F.col("_wide"), F.col("_key")).otherwise(F.substring("_key", 1, GRAM))
    return placed.repartitionByRange(buckets, by).mapInPandas(run, FOUND)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, bucket_rows: int = 40_000) -> DataFrame:
    """``_id`` (NO_ID for null), ``_no_id``, ``_raw`` (the text's bytes), ``_cut``: the runs of strings to remove, and the columns ``carry``."""
    spark = docs.sparkSession
    given, text_hash = F.col(id_col).cast("long"), F.xxhash64(text_col)
    # null ids come after an id of the same number
    own_hash = F.when(given.isNull(), text_hash.bitwiseAND(F.lit(int(NO_ID)))).when(given == int(NO_ID), text_hash.bitwiseOR(F.lit(-int(NO_ID) - 1))).otherwise(text_hash)
    rows = docs.select(F.coalesce(given, F.lit(int(NO_ID))).alias("_id"), own_hash.alias("_hash"), given.isNull().alias("_no_id"), F.col(text_col).alias("_text"), *(carry or []))
    unique = rows.select("_id", "_hash", "_text")
    if not unique.groupBy("_id", "_hash").count().where("count > 1").isEmpty():
        unique = saved(unique.dropDuplicates(["_id", "_hash"]), "unique")
    met = scan(unique.where(F.length("_text") >= LENGTH // 4))
    # stretches with an earlier equal one need no partner; those of grams that have others meet their equals alone
    part = F.when(F.col("_kind") == LATER, F.xxhash64("_id", "_start")).when(F.col("_kind") == MANY, F.xxhash64("_gram", "_body")).otherwise(F.col("_gram"))
    dealt = met.withColumn("_part", part).withColumn("_alone", F.when(F.col("_kind") == MARK, NORMAL).otherwise(F.col("_kind")))
    gram = Window.partitionBy("_part", "_alone")
    body = Window.partitionBy("_part", "_alone", "_body").orderBy("_id", "_hash", "_start")
    me = F.struct("_id", "_hash", "_start")
    seen = dealt.withColumn("_many", (F.col("_kind") == MANY) | (F.min("_body").over(gram) != F.max("_body").over(gram))).withColumn("_gone", (F.col("_kind") == LATER) | (F.first(me).over(body) != me))
    rest = saved(seen.where((F.col("_kind") != MARK) & (F.col("_gone") | F.col("_many"))).select("_id", "_hash", "_start", "_n", "_rel", "_gone", F.when(~F.col("_gone"), F.col("_gram")).alias("_gram")), "stretches")
    left = rest.where("NOT _gone")
    n = left.count()
    wide = saved(left.groupBy("_gram").count().where(F.col("count") > bucket_rows).select("_gram", F.lit(True).alias("_wide")), "wide")  # n / bucket_rows at most
    left = left.join(sized(wide, wide.count()), "_gram", "left").withColumn("_wide", F.coalesce("_wide", F.lit(False)))
    buckets = max(1, -(-n // bucket_rows), min(n // 500, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    raw = F.encode(F.coalesce("_text", F.lit("")), "UTF-8").alias("_raw")
    found = saved(sorted_suffixes(unique.select("_id", "_hash", raw), left, buckets), "found")
    across = found.where("_n = 0").withColumn("_k", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_id", "_hash", "_start"))).where("_k > 1").select("_id", "_hash", "_start", F.lit(1).alias("_n"))
    gone = rest.where("_gone").select("_id", "_hash", "_start", "_n").unionByName(found.where("_n > 0").select("_id", "_hash", "_start", "_n")).unionByName(across)
    cut = gone.groupBy("_id", "_hash").agg(F.collect_list(F.struct("_start", "_n")).alias("_cut"))
    return rows.select("_id", "_hash", "_no_id", raw, *(carry or [])).join(cut, ["_id", "_hash"], "left").select("_id", "_hash", "_no_id", "_raw", "_cut", *(carry or []))


def kept_parts(df: DataFrame, keep: list[str], with_kept: bool, whole_chars: bool = False) -> DataFrame:
    """Applies ``_cut`` to ``_raw``: the columns ``keep``, counts, digest, removed spans and, if asked for, what is left.

    ``whole_chars``: a character that a span removes in part stays.
    """
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>", *(["kept binary"] if with_kept else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, cut in zip(batch.column("_raw"), batch.column("_cut"), strict=True):
                raw, spans = raw.as_py(), []
                for start, end in sorted((c["_start"], c["_start"] + c["_n"] - 1 + LENGTH) for c in cut.as_py() or []):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                if whole_chars:
                    spans = [s for s in (_inward(raw, a, b) for a, b in spans) if s[0] < s[1]]
                left, at = [], 0
                for a, b in spans:
                    left.append(raw[at:a])
                    at = b
                left = b"".join([*left, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"begin": a, "end": b} for a, b in spans], left))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            k = 6 if with_kept else 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(columns[i], type=kinds[i]) for i in range(k))], names=[*keep, *names[:k]])

    return df.mapInArrow(run, schema)


def _inward(raw: bytes, begin: int, end: int) -> list[int]:
    while begin < end and raw[begin] & 0xC0 == 0x80:
        begin += 1
    while begin < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return [begin, end]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = kept_parts(deduplicated(docs), ["_id", "_no_id"], with_kept=False)
    return out.select(F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
