"""Token counts by overlap resynchronisation (operator 9).

Texts longer than ``chunk`` characters are encoded in overlapping chunks. Each chunk's tokens come with offsets; two
neighbours are spliced at a token boundary that both have inside their overlap and that is proven stable: the two
characters beside it stand next to each other in no piece of the vocabulary, so no merge, whatever the context, can
cross it, and the tokens on either side don't depend on the other. Where an overlap holds no such boundary it is
doubled, at last up to the whole text. Counts therefore equal those of one encoding of the whole text. A chunk whose
tokens don't cover its bytes (another model may normalise text) has the text encoded whole.

Defined results: a null text counts as empty, an empty text has no tokens; repeated rows give repeated results; a null
id stays null. Strings that look like special tokens are ordinary text, the library's default.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.common import mapped, table

MARK = "▁"  # what the library writes for a space


class UnalignedError(Exception):
    """The tokens of a chunk don't cover its bytes one for one."""


class PieceCounter:
    """Counts tokens of whole texts under one sentencepiece model."""

    def __init__(self, path: str, chunk: int = 8192, overlap: int = 256) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        single = [self.model.is_byte(i) for i in range(n)]
        #: bytes of text that a token covers; the mark stands for one space
        self.width = np.array([1 if b else len(p.replace(MARK, " ").encode()) for p, b in zip(names, single, strict=True)])
        self.joined = {(x, y) for p, b in zip(names, single, strict=True) if not b for q in (p.replace(MARK, " "),) for x, y in zip(q, q[1:], strict=False)}
        #: the library puts a space before each text it encodes, or doesn't
        self.lead = int(self.width[self.model.encode("a")].sum()) - 1
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        return (text[at - 1], text[at]) not in self.joined

    def ends(self, text: str) -> np.ndarray:
        """Ends of the tokens of a chunk, in characters; -1 for ends inside a character."""
        ends = np.cumsum(self.width[self.model.encode(text)]) - self.lead
        if len(ends) and ends[-1] != len(text.encode()):  # a model that normalises text or drops spaces
            raise UnalignedError
        if not text.isascii():
            heads = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
            place = np.where(np.append(heads, True), np.append(np.cumsum(heads) - 1, len(text)), -1)
            ends = np.where(ends >= 0, place[ends], -1)
        return ends

    def count(self, text: str) -> int:
        if len(text) > self.chunk:
            try:
                return self._spliced(text.replace(MARK, " "))
            except UnalignedError:
                self.widened += 1
        return len(self.model.encode(text))

    def _spliced(self, text: str) -> int:
        total, cut, begin = 0, 0, 0  # tokens up to the last splice; the splice; the current chunk's begin
        stop = min(len(text), self.chunk + self.overlap)
        ends = self.ends(text[begin:stop])
        while stop < len(text):
            after, overlap = stop - self.overlap, self.overlap
            until = min(len(text), after + self.chunk + self.overlap)
            while True:
                follow = self.ends(text[after:until])
                both = np.intersect1d(ends[ends > 0] + begin, follow[follow > 0] + after)
                both = both[(both > max(after, cut)) & (both < stop)]
                splice = next((int(b) for b in both[::-1] if self.stable(text, int(b))), None)
                if splice is not None or stop == len(text):
                    break
                self.widened += 1
                overlap *= 2
                stop = min(len(text), after + overlap)
                until = min(len(text), max(until, stop + self.chunk))
                ends = self.ends(text[begin:stop])
            if splice is None:  # widened up to the end of the text
                break
            total += self._between(ends, begin, cut, splice)
            cut, begin, stop, ends = splice, after, until, follow
        return total + self._between(ends, begin, cut, len(text))

    @staticmethod
    def _between(ends: np.ndarray, begin: int, low: int, high: int) -> int:
        """Tokens that end after ``low`` and up to ``high``; both are ends of tokens or of the text."""
        last = len(ends) if high - begin >= (ends[-1] if len(ends) else 0) else int(np.flatnonzero(ends == high - begin)[0]) + 1
        first = 0 if low <= begin and low == 0 else int(np.flatnonzero(ends == low - begin)[-1]) + 1
        return last - first


_counters: dict[tuple, PieceCounter] = {}


def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    key = (path, chunk, overlap)
    if key not in _counters:
        _counters[key] = PieceCounter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, model_path: str, *, text_col: str = "text", out_col: str = "n_tokens", chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """``docs`` with ``out_col`` (a name that they don't have); texts are counted where they lie, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path, chunk, overlap)
        for batch in batches:
            once = {t: 0 for t in batch.column(at).to_pylist() if t}
            for t in once:
                once[t] = c.count(t)
            counts = pa.array([once[t] if t else 0 for t in batch.column(at).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, f"c{batch.num_columns}"])

    return mapped(docs, run, [T.StructField(out_col, T.LongType())])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
