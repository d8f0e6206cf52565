"""N-gram Jaccard self-join by token-combination prefixes, and its components (operator 10).

A token is the hash of a shingle. Equal sets collapse into one class first. Tokens are ordered rare ones first. Of two
similar sets the k smallest shared tokens lie in both prefixes extended by k. Rare tokens of the prefix are indexed singly.
Frequent ones (a global class) fall into g buckets by hash and are indexed by the pairs within a bucket; with k = g + 1 two
shared tokens meet in one bucket, so no pair of similar sets is missed. g grows with the set, which keeps its pairs in
proportion to its size.

Links only matter between components, so rounds with a leader of each key first join what is plainly near. Then sets
that share a key in different components meet if sizes and 256-bit parities of the sets allow a link, and are verified on
whole sets. A key with more than HOT members is not met pair by pair. It is split by the sizes of the sets first, as similar
sets have similar sizes. What still has more than HOT members is split by further tokens: its members are
compared with one leader, and two that link are either both linked to the leader, or share a token of their differences
from it. Prefixes of these differences (rare ones first) are the new keys. So a large group of near copies, linked or not,
emits neither all its pairs nor loses a link.

Defined results: null texts and texts without words have no shingles, no links and themselves as component; a null id
has no links and a null component; rows that repeat an id count as linked; repeated rows get the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.common import forget, released, saved, sized, table
from foldwright.llm.hashing import inverse_powers, mixed, prefix_hashes, span_hash

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
STEP = np.uint64(0xA0761D6478BD642F)
HOT = 1000  # most members of a key that meet pair by pair
CHARS = 500_000  # characters that a worker handles at once
WAVE = 32_000_000  # bytes of sets that pairs may move at once; or an eighth of all sets, if that is more
PARITY = ["_b0", "_b1", "_b2", "_b3"]  # of the set's tokens, by 256 places


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets, one after another, each sorted; and their sizes."""
    raws = [(t or "").encode().lower() for t in texts]  # of bytes, lower() changes A-Z alone
    raw = np.frombuffer(b" ".join([*raws, b""]), dtype=np.uint8) if raws else np.zeros(0, np.uint8)
    blank = SPACES[raw]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums, _ = prefix_hashes(raw, 3)
    word = span_hash(sums, inverse_powers(len(raw)), begin, end)
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    doc = np.searchsorted(first, begin, side="right") - 1
    count = np.bincount(doc, minlength=len(raws))
    full = np.flatnonzero(doc[: max(0, len(doc) - words + 1)] == doc[words - 1 :]) if len(doc) >= words else np.zeros(0, np.int64)
    gram = np.full(len(full), words, dtype=np.uint64)
    for k in range(words):
        gram = mixed(gram * STEP + word[full + k])
    owner = doc[full]
    short = np.flatnonzero((count > 0) & (count < words))
    if short.size:
        at = np.cumsum(count) - count
        few = count[short].astype(np.uint64)
        own = few.copy()
        for k in range(words - 1):
            own = np.where(few > k, mixed(own * STEP + word[np.minimum(at[short] + k, len(word) - 1)]), own)
        gram, owner = np.concatenate([gram, own]), np.concatenate([owner, short])
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], np.bincount(owner[new], minlength=len(raws))


class Scheme:
    """Prefix lengths and index keys for a similarity of percent / 100."""

    def __init__(self, percent: int, frequent: np.ndarray) -> None:
        self.percent = percent
        order = np.argsort(frequent)
        self.frequent, self.ranks = frequent[order], order  # given rarest first

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        """Place among the frequent tokens, -1 for rare ones."""
        at = np.searchsorted(self.frequent, tokens)
        out = np.full(len(tokens), -1)
        inside = at < len(self.frequent)
        hit = np.flatnonzero(inside)[self.frequent[at[inside]] == tokens[inside]]
        out[hit] = self.ranks[at[hit]]
        return out

    def prefix(self, n: int, k: int) -> int:
        """Tokens of a set of n that hold the k smallest which it shares with a similar set."""
        return min(n, n + self.percent * n // -100 + k)

    def buckets(self, n: int) -> int:
        """Buckets of frequent tokens where the smaller of two sets has n: a power of two that grows with n."""
        most = min(max(1, (n + self.percent * n // -100) // 4), max(1, -(self.percent * n // -100) - 1))
        return 1 << (most.bit_length() - 1)

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """Index keys, and the number of frequent tokens in the prefix of one."""
        n = len(tokens)
        if not n:
            return tokens, 0
        rank = self.rank(tokens)
        order = np.lexsort((tokens, rank))
        first = order[: self.prefix(n, 1)]
        often = int((rank[first] >= 0).sum())
        out = [tokens[first[: len(first) - often]]]
        if n * self.percent < 300:  # so few may share one token alone
            out.append(tokens[first[len(first) - often :]])
        g, last = self.buckets(-(self.percent * n // -100)), self.buckets(n)
        while g <= last:  # those of the smaller set of any similar two
            common = order[: self.prefix(n, g + 1)]
            common = tokens[common[rank[common] >= 0]]
            bucket = mixed(common ^ STEP) >> np.uint64(40) & np.uint64(g - 1)
            by = np.lexsort((common, bucket))
            common, bucket = common[by], bucket[by]
            for d in range(1, len(common)):
                low = np.flatnonzero(bucket[d:] == bucket[:-d])
                if not low.size:
                    break
                out.append(mixed(common[low] * STEP + mixed(common[low + d])))
            g *= 2
        return np.unique(np.concatenate(out)), often


def parities(tokens: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each set the parity of its tokens at each of 256 places, as four numbers.

    Places where two sets differ are at most as many as tokens in which they differ.
    """
    place = mixed(tokens) >> np.uint64(56)
    bit = np.uint64(1) << (place & np.uint64(63))
    has = np.flatnonzero(sizes > 0)
    out = np.zeros((4, len(sizes)), dtype=np.uint64)
    if has.size:
        begin = (np.cumsum(sizes) - sizes)[has]
        for k in range(4):
            out[k, has] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), begin)
    return [x.view(np.int64) for x in out]


def _batches(batch: pa.RecordBatch, at: int, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    begin, size, part = 0, 0, []
    for i, t in enumerate(batch.column(at)):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= chars:
            yield begin, part
            begin, size, part = i + 1, 0, []
    if part:
        yield begin, part


def frequent_tokens(docs: DataFrame, words: int, most: int = 100_000, share: float = 0.0002, least: int = 40) -> np.ndarray:
    """Tokens in about ``share`` of all texts or more (``least`` texts at least), rarest first; ``most`` of them at most.

    It decides the order of tokens and how they are indexed, not which pairs are found. Counts are of tokens met three times
    in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            parts = []
            for _, texts in _batches(batch, 1, CHARS):
                tokens, sizes = shingle_sets(texts, words)
                t, c = np.unique(tokens, return_counts=True)
                keep = c >= max(3, share * len(sizes))
                parts.append((t[keep].view(np.int64), c[keep]))
                n += len(sizes)
            t, c = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(t, 0)), pa.array(np.append(c, 0).astype(np.int64)), pa.array(np.append(np.zeros(len(t)), n).astype(np.int64))], names=["t", "c", "docs"])
        released()

    met = docs.mapInArrow(run, "t long, c long, docs long").groupBy("t").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    met = saved(met, "frequent")
    total = met.agg(F.sum("docs")).first()[0] or 0
    rows = met.where(F.col("c") >= max(least, share * total)).orderBy(F.desc("c"), "t").limit(most).collect()
    return np.array([r["t"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def sketched(docs: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    """(_id, n, _d1, _d2, _keys, _often, _b0.._b3): set size, digest of the set, index keys, frequent prefix tokens and parities of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            ids = batch.column(0)
            for begin, texts in _batches(batch, 1, CHARS):
                tokens, sizes = shingle_sets(texts, words)
                parts = np.split(tokens, np.cumsum(sizes)[:-1])
                d1, d2 = _digests(parts)
                keys, often = zip(*(s.keys(p) for p in parts), strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), pa.array(sizes.astype(np.int64)), pa.array(d1), pa.array(d2), pa.array([k.tobytes() for k in keys], type=pa.binary()), pa.array(often, pa.int64()), *map(pa.array, parities(tokens, sizes))], names=["_id", "n", "_d1", "_d2", "_keys", "_often", *PARITY])
        released()

    return docs.mapInArrow(run, "_id long, n long, _d1 long, _d2 long, _keys binary, _often long, _b0 long, _b1 long, _b2 long, _b3 long")


def exploded(classes: DataFrame) -> DataFrame:
    """(_key, _id) from (_id, _keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k.as_py() or b"", dtype=np.int64) for k in batch.column("_keys")]
            count = np.array([len(k) for k in keys], dtype=np.int64)
            for begin in range(0, len(keys), 2000):
                part, times = keys[begin : begin + 2000], count[begin : begin + 2000]
                row = pa.array(np.repeat(np.arange(begin, begin + len(part)), times))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *part])), batch.column("_id").take(row)], names=["_key", "_id"])

    return classes.select("_id", "_keys").mapInArrow(run, "_key long, _id long")


def banded(index: DataFrame, sizes: DataFrame, percent: int, hot: int) -> DataFrame:
    """(_key, _id, _times, _guest) from (_key, _id, _times): keys of more than ``hot`` members are split by size.

    A set is in the band of its size and a guest in the next lower one. Of two similar sets the larger is in the band of the smaller
    or in the next, so they meet in one group, once, if two guests don't count. ``sizes``: (_id, n).
    """
    width = max(1e-6, 1.001 * math.log(100 / percent))  # a little wide, so that rounding loses none
    band = F.floor(F.ln("n") / width)
    rows = index.where(F.col("_times") > hot).join(sizes, "_id").select("_id", "_key", F.posexplode(F.array(band, band - 1)).alias("_guest", "_band"))
    rows = rows.select(F.xxhash64("_key", "_band").alias("_key"), "_id", (F.col("_guest") == 1).alias("_guest"))
    times = rows.groupBy("_key").agg(F.count("*").alias("_times"), F.min("_guest").alias("_none")).where("_times > 1 AND NOT _none").drop("_none")
    few = index.where(F.col("_times") <= hot).withColumn("_guest", F.lit(False))
    return few.unionByName(rows.join(times, "_key"))


def difference(x: np.ndarray, lead: np.ndarray, scheme: Scheme) -> tuple[bool, np.ndarray, int]:
    """Whether two sets link; their difference, in the order of ``lead``'s differences, as far as any set that links
    with x can need it; and how many of it a set must index.

    Say x and y link and share a token of their differences d(x), d(y) from the lead, and y does not link to the lead. They
    share o = (|d(x)| + |d(y)| - |x ^ y|) / 2 of these tokens, where |x ^ y| is at most t = |x| (1 - s) / s for a
    similarity s. As |d(y)| > (1 - s) |y + lead| and |x ^ y| <= (1 - s) |x + y|, o > (|d(x)| - (1 - s) m) / 2 with m the tokens
    of x outside y and lead, at most t; that many x must index. If y does link to the lead, o >= |d(x)| - t still holds.
    """
    rest = 100 - scheme.percent
    new, gone = np.setdiff1d(x, lead, assume_unique=True), np.setdiff1d(lead, x, assume_unique=True)
    linked = 100 * (len(x) - len(new)) >= scheme.percent * (len(lead) + len(new))
    size, most = len(new) + len(gone), rest * len(x) // scheme.percent
    need = max(1, size - most, -(-(100 * size - rest * min(len(new), most)) // 200))
    # rare tokens first: new rare ones; missing frequent ones; what many have and the lead hasn't; the lead's own
    tokens, rank = np.concatenate([new, gone]), np.concatenate([scheme.rank(new), scheme.rank(gone)])
    there = np.arange(size) >= len(new)
    kind = np.where(there, np.where(rank >= 0, 1, 3), np.where(rank >= 0, 2, 0))
    order = np.lexsort((tokens, np.where(there, -rank, rank), kind))
    index = size - need + 1
    return linked, tokens[order[: index if linked else max(index, size - max(1, size - most) + 1)]], index


def split(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """(_id, _lead, _linked, _key, _own) from pairs (_id, _lead): for each a row without key, and one for each key of the
    difference; _own: the set indexes the key, else it only looks for others there."""
    shared = sets.sparkSession.sparkContext.broadcast(scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads, rows = batch.column("_lead").to_numpy(), []
            for x, y, lead in zip(batch.column("_x"), batch.column("_y"), leads.view(np.uint64), strict=True):
                linked, tokens, index = difference(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)), shared.value)
                with np.errstate(over="ignore"):
                    rows.append((linked, mixed(mixed(tokens) + lead * STEP), index))
            n = np.array([1 + len(k) for _, k, _ in rows], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(len(rows)), n))
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.concatenate([np.zeros(0, np.uint64), *(np.append(np.uint64(0), k) for _, k, _ in rows)]).view(np.int64)
            linked, index = (np.repeat(np.array([r[i] for r in rows], dtype=t), n) for i, t in ((0, bool), (2, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_lead").take(row), pa.array(linked), pa.array(key, mask=place == 0), pa.array(place <= index)], names=["_id", "_lead", "_linked", "_key", "_own"])

    x = sets.select("_id", F.col("_set").alias("_x"))
    y = sets.select(F.col("_id").alias("_lead"), F.col("_set").alias("_y")).join(pairs.select("_lead").distinct(), "_lead", "left_semi")
    if (y.agg(F.sum(F.octet_length("_y"))).first()[0] or 0) <= 32_000_000:  # then no set moves once more for each of its leaders
        y = F.broadcast(y)
    return pairs.join(x, "_id").join(y, "_lead").select("_id", "_lead", "_x", "_y").mapInArrow(run, "_id long, _lead long, _linked boolean, _key long, _own boolean")


def verified(pairs: DataFrame, sets: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The pairs (_a, _b) whose whole sets, of _a in ``sets`` and of _b in ``others``, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b")], names=["_a", "_b"]).filter(pa.array(ok, type=pa.bool_()))
        released()

    x = sets.select(F.col("_id").alias("_a"), F.col("_set").alias("_x"))
    y = others.select(F.col("_id").alias("_b"), F.col("_set").alias("_y"))
    return pairs.join(x, "_a").join(y, "_b").select("_a", "_b", "_x", "_y").mapInArrow(run, "_a long, _b long")


def in_waves(pairs: DataFrame, sets: DataFrame, waves: int) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """The pairs in so many parts, each with the sets of its _a and those that hold all of its _b."""
    if waves == 1:
        yield pairs, sets, sets
        return
    for w in range(waves):
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(waves)) == w  # noqa: B023, E731
        part = pairs.where(of("_a"))
        others = saved(part.select(F.col("_b").alias("_id")).distinct(), "others")
        yield part, sets.where(of("_id")), sets.join(sized(others, others.count(), 200_000), "_id", "left_semi")
        forget(others)


def components(links: DataFrame) -> DataFrame:
    """(_a, _b): each id with a link to a smaller one, and the smallest that it reaches; by large and small stars.

    Smallest neighbours come from partial sums and joins, so a hub's links need not meet in one task.
    """
    edges = saved(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).where("_u <> _v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        low = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_m", "_u").alias("_m"))
        large = saved(both.where("_v > _u").join(low, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct(), "large")
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").where("_v <> _m").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        old, edges = edges, saved(small.unionByName(least.select("_u", F.col("_m").alias("_v"))).where("_u <> _v").distinct(), "edges")
        forget(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("_u").alias("_a"), F.col("_v").alias("_b"))
        mark = now


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, rounds: int = 2, hot: int = HOT) -> DataFrame:
    """(_id, n, _component) for each row; texts link when 100 * intersection >= percent * union of their shingle sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    scheme = Scheme(percent, frequent_tokens(texts, words))
    sketch = saved(sketched(texts, words, scheme), "sketch")
    known = sketch.where("_id IS NOT NULL AND n > 0")
    alone = saved(sketch.where("_id IS NULL OR n = 0").select("_id", "n", F.col("_id").alias("_component")), "alone")
    # a class is known by a number; its texts by the least id and the digest of the set
    classes = known.groupBy("_d1", "_d2", "n").agg(F.min("_id").alias("_least"), *(F.max(c).alias(c) for c in ("_keys", "_often", *PARITY)))
    keyed = saved(classes.withColumn("_id", F.monotonically_increasing_id()), "keyed")
    classes = saved(keyed.drop("_keys"), "classes")
    members = saved(known.select(F.col("_id").alias("_doc"), "_d1", "_d2", "n").join(classes.select("_d1", "_d2", "n", "_id"), ["_d1", "_d2", "n"]).select("_doc", "n", "_id"), "members")
    at_once = max(WAVE, known.agg(F.sum("n")).first()[0] or 0)
    forget(sketch)  # keys are most of what is stored, and go as soon as the index is made
    repeats = saved(members.groupBy("_doc").agg(F.min("_id").alias("_b"), F.max("_id").alias("_high"), F.count("*").alias("_c")).where("_c > 1"), "repeats")
    unique = repeats.isEmpty()
    times = saved(exploded(keyed).groupBy("_key").agg(F.count("*").alias("_times")).where("_times > 1"), "times")
    stored = saved(exploded(keyed).join(times, "_key"), "index")
    forget(keyed, times)
    if not stored.where(F.col("_times") > hot).isEmpty():
        whole, stored = stored, saved(banded(stored, classes.select("_id", "n"), percent, hot), "banded")
        forget(whole)
        index = stored
    else:
        index = stored.withColumn("_guest", F.lit(False))
    of_hot = index.groupBy("_id").agg(F.sum((F.col("_times") > hot).cast("long")).alias("_hot"))
    need = saved(classes.select("_id", F.col("n").alias("_n"), "_often", *PARITY).join(of_hot, "_id"), "need")
    n_need = need.count()
    spare = [stored, need]  # tables that the result doesn't read
    label = need.withColumn("_component", F.col("_id"))

    def bounded(a: str, b: str) -> Column:
        """Whether sizes and parities allow the rows named so to link."""
        n, m = F.col(f"{a}._n"), F.col(f"{b}._n")
        differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARITY), F.lit(0))
        return (F.col(f"{a}._component") != F.col(f"{b}._component")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ * (100 + percent) <= (n + m) * (100 - percent))

    def least(a: str, b: str) -> Column:
        """Keys that two linked texts share at least.

        Of two prefixes, the one that ends first shares with the other text what it shares with its prefix; the rest of the text
        can't add more than its length. Frequent tokens are not indexed singly, and hot keys not met here.
        """
        n, m = F.col(f"{a}._n"), F.col(f"{b}._n")
        both = lambda c: F.least(f"{a}.{c}", f"{b}.{c}")
        return F.ceil((n + m) * percent / (100 + percent)) - (F.ceil(F.greatest(n, m) * percent / 100) - 1) - both("_often") - both("_hot")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = saved(classes.select("_id", F.col("_least").alias("_doc"), "_d1", "_d2").join(ids.distinct(), "_id", "left_semi"), "ids")
        rows = texts.withColumnRenamed("_id", "_doc").join(sized(ids, ids.count(), 200_000), "_doc").select("_id", "_text", "_d1", "_d2")
        sets = _sets(rows, words)
        sets = saved(sets if unique else sets.dropDuplicates(["_id"]), "sets")
        forget(ids)
        return sets

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link; sets are made for their texts alone and go again."""
        pairs = saved(pairs, "pairs")
        sets = sets_of(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")))
        n, bytes_ = sets.agg(F.count("*"), F.sum(F.octet_length("_set"))).first()
        waves = -(-pairs.count() * (bytes_ or 0) // (max(1, n) * at_once)) or 1  # a set moves once for each of its pairs
        new = _union(saved(verified(*part, percent), "links") for part in in_waves(pairs, sets, waves))
        forget(pairs, sets)
        return new

    def apart_of(led: DataFrame) -> DataFrame:
        sets = sets_of(led.select("_id").unionByName(led.select(F.col("_lead").alias("_id"))))
        spare.append(rows := saved(split(led, sets, scheme), "apart"))
        forget(sets)
        return rows

    links: DataFrame | None = None

    def grown(new: DataFrame) -> DataFrame:
        """Labels after more links; links between components are enough."""
        nonlocal links
        links = components(new if links is None else links.unionByName(new))
        spare.append(out := saved(need.join(links.select(F.col("_a").alias("_id"), F.col("_b").alias("_component")), "_id", "left").withColumn("_component", F.coalesce("_component", "_id")), "labels"))
        return out

    def mixed_keys(rows: DataFrame, *columns: str) -> DataFrame:
        """The rows of keys whose members lie in several components, with all of their labels, or these columns; keys by waves."""
        waves = -(-rows.count() * 16 // at_once) or 1
        return _union(mixed_keys_of(rows.where(F.pmod(F.xxhash64("_key"), F.lit(waves)) == w) if waves > 1 else rows, columns) for w in range(waves))

    def mixed_keys_of(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        own = rows.join(sized(label.select("_id", "_component"), n_need, 200_000), "_id").groupBy("_key")
        several = own.agg(F.min("_component").alias("_low"), F.max("_component").alias("_high")).where("_low <> _high").select("_key")
        rows = rows.join(several, "_key").join(sized(label, n_need, 200_000), "_id")
        spare.append(rows := saved(rows.select(*columns) if columns else rows, "met"))
        return rows

    if not unique:  # rows that repeat an id are linked
        twice = repeats.where("_b <> _high").select("_doc", "_b")
        label = grown(saved(members.join(twice, "_doc").where("_id <> _b").select(F.col("_id").alias("_a"), "_b").distinct(), "links"))
    if n_need:
        for r in range(rounds):  # a head start only: what follows is exact
            now = index.join(sized(label, n_need, 200_000), "_id")
            # the first leader has the most frequent tokens, so that a group's original leads it
            turn = F.struct(F.col("_often") if r == 0 else F.lit(0), F.xxhash64("_id", F.lit(r)))
            lead = now.groupBy("_key").agg(F.max_by(F.struct(*label.columns), turn).alias("_lead"), F.min("_component").alias("_low"), F.max("_component").alias("_high")).where("_low <> _high").select("_key", "_lead")
            met = now.select("_key", F.struct(*label.columns).alias("_own")).join(lead, "_key").where(bounded("_own", "_lead"))
            pairs = met.groupBy(F.col("_own._id").alias("_a"), F.col("_lead._id").alias("_b")).agg(F.count("*").alias("_shared"), F.first(least("_own", "_lead") + F.least("_own._hot", "_lead._hot")).alias("_least"))
            best = F.row_number().over(Window.partitionBy("_a").orderBy(F.desc("_shared"), "_b"))
            pairs = pairs.where("2 * _shared >= _least").withColumn("_turn", best).where("_turn <= 2").select("_a", "_b").distinct()
            new = checked(pairs)
            if new.isEmpty():
                break
            label = grown(new)

        apart: DataFrame | None = None
        groups = mixed_keys(index.where(F.col("_times") > hot), "_key", "_id", "_often", "_hot")
        if not groups.isEmpty():
            # the member with the most hot keys leads: of near copies, one that has what most have
            lead = groups.groupBy("_key").agg(F.max_by("_id", F.struct("_hot", "_often", F.xxhash64("_id"))).alias("_lead"))
            led = saved(groups.select("_key", "_id").join(lead, "_key").where("_id <> _lead").select("_id", "_lead").distinct(), "led")
            moved = led.join(sized(need.select("_id", "_n"), n_need, 200_000), "_id").agg(F.sum("_n")).first()[0] or 0
            waves = -(-8 * moved // at_once) or 1  # a set moves once for each of its leaders
            apart = _union(apart_of(led.where(F.pmod(F.xxhash64("_lead"), F.lit(waves)) == w) if waves > 1 else led) for w in range(waves))
            forget(led)
            new = saved(apart.where("_key IS NULL AND _linked").select(F.col("_id").alias("_a"), F.col("_lead").alias("_b")), "links")
            label = grown(new) if not new.isEmpty() else label

        now = mixed_keys(index.where(F.col("_times") <= hot).drop("_times"))
        two = (F.col("x._id") < F.col("y._id")) & bounded("x", "y")
        pairs = now.alias("x").join(now.alias("y"), (F.col("x._key") == F.col("y._key")) & two & ~(F.col("x._guest") & F.col("y._guest")))
        pairs = pairs.groupBy(F.col("x._id").alias("_a"), F.col("y._id").alias("_b")).agg(F.count("*").alias("_shared"), F.first(least("x", "y")).alias("_least")).where("_shared >= _least").select("_a", "_b")
        if apart is not None:
            rest = mixed_keys(apart.where("_key IS NOT NULL").drop("_lead"))
            # of two, one at least does not link to the lead; it may look where it does not index
            roles = (~F.col("x._linked") | ~F.col("y._linked")) & (F.col("x._own") | F.col("y._own")) & (F.col("x._own") | F.col("y._linked")) & (F.col("y._own") | F.col("x._linked"))
            more = rest.alias("x").join(rest.alias("y"), (F.col("x._key") == F.col("y._key")) & two & roles)
            pairs = pairs.unionByName(more.select(F.col("x._id").alias("_a"), F.col("y._id").alias("_b"))).distinct()
        new = checked(pairs)
        if not new.isEmpty():
            grown(new)
    forget(*spare)
    lowest = classes.select("_id", "_least")
    if links is not None:
        rooted = lowest.join(links.select(F.col("_a").alias("_id"), F.col("_b").alias("_root")), "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
        lowest = rooted.select("_id", "_root").join(rooted.groupBy("_root").agg(F.min("_least").alias("_least")), "_root").select("_id", "_least")
    whole = members.join(lowest, "_id").select(F.col("_doc").alias("_id"), "n", F.col("_least").alias("_component"))
    return whole.unionByName(alone)


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, list(parts))


def _digests(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    digest = [xxhash.xxh3_128_intdigest(p.tobytes()) for p in parts]
    return tuple(np.array([d >> k & (2**64 - 1) for d in digest], dtype=np.uint64).view(np.int64) for k in (0, 64))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(_id, _set) from (_id, _text, _d1, _d2): the sets with the digest that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in _batches(batch, 1, CHARS):
                tokens, sizes = shingle_sets(part, words)
                parts = np.split(tokens, np.cumsum(sizes)[:-1])
                d1, d2 = _digests(parts)
                asked = [batch.column(c).slice(begin, len(part)).to_numpy() for c in (2, 3)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(part)), pa.array([p.tobytes() for p in parts], type=pa.binary())], names=["_id", "_set"])
                yield out.filter(pa.array((d1 == asked[0]) & (d2 == asked[1])))
        released()

    return texts.mapInArrow(run, "_id long, _set binary")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_component").alias("component_id"))
