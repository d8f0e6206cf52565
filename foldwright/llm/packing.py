"""Best-fit packing by exact-complement hashing (operator 7).

Only the number of pieces of each length decides a packing, so the plan is made on that histogram (at most ``capacity``
entries): availability counts index single, pair and triple length sums; for each length, longest first, combinations
that exactly fill its gap are consumed as often as they are available; what is left is packed best fit, longest first.
Pieces of one length are then numbered and placed by the plan's ranges of numbers.

Defined results: a null text counts as empty and still gives one piece, the end token; repeated rows are packed each for
itself; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.common import saved, slices, table

SEEN = 400_000  # segments whose ids a worker remembers
_workers: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The byte-level pre-tokenizer never joins a character that is no white space with a space after it, so a text is
    encoded segment by segment and segments seen before are looked up. Texts in which white space comes right before
    a space are encoded whole.

    ``ranks``: (file, pattern) of the same vocabulary in the form of byte ranks, whose library merges rare words several
    times faster to the same ids; without it everything goes through ``tokenizers``.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None) -> None:
        self.model = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            with open(ranks[0], "rb") as lines:
                self.fast = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
        self.known: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of text behind each token
        for word, i in vocabulary.items():
            self.width[i] = len(word)
        self.mixed = re.compile(r"\s ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], at_once: int = 2000) -> None:
        """Remembers the ids of segments; those that a space may follow are encoded in long runs and cut apart by bytes."""
        odd = [s for s in new if s[0] != " " or s[-1].isspace() or any(x in s for x in self.special)]
        self.known.update(zip(odd, self._encode(odd) if odd else [], strict=True))
        rest = set(odd)
        runs = [s for s in new if s not in rest]
        for begin in range(0, len(runs), at_once):
            run = runs[begin : begin + at_once]
            text = "".join(run)
            ids = np.array(self.fast.encode_ordinary(text) if self.fast else self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(s.encode()) for s in run])) + 1
            raw, begin = ids.tobytes(), 0
            for s, end in zip(run, ends.tolist(), strict=True):
                self.known[s] = raw[4 * begin : 4 * end]
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        whole, cut = [], []
        for i, t in enumerate(texts):
            out.append(b"")
            if not t:
                continue
            if t[0] == " " or self.mixed.search(t):
                whole.append(i)
            else:
                head, *rest = t.split(" ")
                cut.append((i, [head, *[f" {x}" for x in rest]]))
        for i, x in zip(whole, self._encode([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = x
        new = list({s for _, parts in cut for s in parts if s not in self.known})
        if len(self.known) + len(new) > SEEN:
            self.known.clear()
            new = list({s for _, parts in cut for s in parts})
        self._learn(new)
        for i, parts in cut:
            out[i] = b"".join([self.known[s] for s in parts])
        return out


def encoder(path: str, ranks: tuple[str, str] | None) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path, ranks)
    return _workers[path]


def tokenize(docs: DataFrame, tokenizer_path: str, *, ranks: tuple[str, str] | None = None, text_col: str = "text", capacity: int = 1024, end_id: int = 2, batch_chars: int = 1_000_000) -> DataFrame:
    """One row a piece: the columns of ``docs`` but the text, and piece, start, length and ids (binary, ``<u4``)."""
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer_path, ranks)
        for whole in batches:
            for batch in slices(whole, at, batch_chars):
                ids = [x + end for x in work.encode(batch.column(at).to_pylist())]
                row, piece, start, length, part = [], [], [], [], []
                for i, x in enumerate(ids):
                    n = len(x) // 4
                    first = (n - 1) % capacity + 1
                    for k, (a, b) in enumerate([(0, first), *((a, a + capacity) for a in range(first, n, capacity))]):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        part.append(x[4 * a : 4 * b])
                kept = [batch.column(j).take(pa.array(row, type=pa.int64())) for j in range(batch.num_columns) if j != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(part, pa.binary())], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


@dataclass
class Pattern:
    """So many sequences, each of ``times`` pieces of each length."""

    sequences: int
    items: list[tuple[int, int]]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """A packing of so many pieces of each length (1 to capacity)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[Pattern] = []

    def consume(lengths: Iterable[int]) -> bool:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            out.append(Pattern(n, sorted(need.items(), reverse=True)))
            for x, k in need.items():
                left[x] -= n * k
        return n > 0

    consume([capacity])
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if left[a] and left[gap]:
            consume([a, gap])
        if left[a]:  # pairs: both halves of a sum must be available
            high = np.arange(-(-gap // 2), gap)
            for b in high[(left[high] > 0) & (left[gap - high] > 0)][::-1].tolist():
                if left[a] and left[b] and left[gap - b]:
                    consume([a, b, gap - b])
        if left[a]:  # triples: a third length beside an indexed pair sum
            for b in np.flatnonzero(left[: max(0, gap - 1)])[::-1].tolist():
                if not left[a]:
                    break
                if not left[b] or 3 * b < gap:
                    continue
                c = np.arange(-(-(gap - b) // 2), min(b, gap - b - 1) + 1)
                for x in c[(left[c] > 0) & (left[gap - b - c] > 0)][::-1].tolist():
                    if left[a] and left[b] and left[x] and left[gap - b - x]:
                        consume([a, b, x, gap - b - x])
    while (rest := np.flatnonzero(left)).size:
        a = int(rest[-1])
        need, gap = {a: 1}, capacity - a
        n = int(left[a])
        while gap > 0:
            fits = rest[: np.searchsorted(rest, gap, side="right")]
            fits = fits[left[fits] > np.array([need.get(int(x), 0) for x in fits])]
            if not fits.size:
                break
            b = int(fits[-1])
            used = need.get(b, 0)
            times = max(1, min(gap // b, int(left[b]) // n - used))
            need[b] = used + times
            n = min(n, int(left[b]) // need[b])
            gap -= times * b
        out.append(Pattern(n, sorted(need.items(), reverse=True)))
        for x, k in need.items():
            left[x] -= n * k
    return out


def ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by length: (length, first number, end, first sequence, offset, pieces of the length in a sequence)."""
    out, used, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, times in p.items:
            first = used.get(length, 0)
            out.append((length, first, first + p.sequences * times, sequence, offset, times))
            used[length] = first + p.sequences * times
            offset += length * times
        sequence += p.sequences
    return out


def pack(pieces: DataFrame, *, order: list[str], capacity: int = 1024, salts: int = 64) -> DataFrame:
    """``pieces`` (a table that reads the same twice, with ``length``) with sequence_id and offset.

    Pieces of a length are numbered in ``salts`` groups by a hash of the columns ``order``, so a frequent length spreads
    over that many tasks. The driver sees counts by length and group (capacity * salts rows at most) and sends back
    the groups' first numbers and the plan's ranges.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = sorted((r["length"], r["_salt"], r["count"]) for r in salted.groupBy("length", "_salt").count().collect())
    total: dict[int, int] = {}
    base = []
    for length, salt, n in counts:
        base.append((length, salt, total.get(length, 0)))
        total[length] = total.get(length, 0) + n
    rows = ranges(plan(total, capacity))
    first = spark.createDataFrame(base, "_l long, _s int, _base long")
    where = spark.createDataFrame(rows, "_l long, _from long, _to long, _sequence long, _offset long, _times long")
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    numbered = salted.withColumn("_k", number).join(first, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).drop("_l", "_s").withColumn("_k", F.col("_k") + F.col("_base"))
    if len(rows) <= 100_000:  # a few ranges for each length; the check keeps odd plans out of memory
        where = F.broadcast(where)
    k = F.col("_k") - F.col("_from")
    out = numbered.join(where, (F.col("length") == F.col("_l")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    return out.select(*pieces.columns, (F.col("_sequence") + F.floor(k / F.col("_times"))).cast("long").alias("sequence_id"), (F.col("_offset") + k % F.col("_times") * F.col("length")).cast("long").alias("offset"))


def id_digest(ids: Column) -> Column:
    return F.crc32(ids)


def packed(docs: DataFrame, tokenizer_path: str, *, ranks: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places; ``keep_ids=False`` keeps the ids' crc32 alone and so moves no text."""
    pieces = tokenize(docs.select(id_col, text_col), tokenizer_path, ranks=ranks, text_col=text_col, capacity=capacity, end_id=end_id).withColumn("ids_crc32", id_digest(F.col("ids")))
    pieces = saved(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, order=[id_col, "piece", "ids_crc32"], capacity=capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
