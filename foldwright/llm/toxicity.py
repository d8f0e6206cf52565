"""Toxicity by a linear-chain conditional random field (operator 8).

Two labels a token, clean and toxic. Token labels come from labelled documents: in a toxic document a token is
toxic when one of its letter features speaks for toxic documents strongly enough. The field's weights maximise the
penalised likelihood of these sequences. Scoring runs forward-backward over every token of the whole text; the
marginals give a document's score and the character offsets of its toxic spans.

Defined results: null and empty texts, and texts without a token, have no spans and the score of zero evidence. Rows
may repeat; each gets its own result. A null id stays null. Without training rows of both classes every score is 0.

Training reads at most ``max_docs`` labelled rows of each class of at most ``max_chars`` characters each; scoring has
no bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.common import mapped, released, slices, table

TOKEN = re.compile(r"[^\W_]+")
CUT = 64  # tokens in a training sequence
BLOCK = 32  # tokens in a block of the two-level recursion

SCHEMA = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_toxic_tokens", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))),
    ]
)


@dataclass
class Field:
    """Trained weights: of letter features, of the four transitions, and of the document score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # clean-clean, clean-toxic, toxic-clean, toxic-toxic
    score: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        out = ahocorasick.Automaton()
        for f, w in self.weights.items():
            out.add_word(f, (len(f), w))
        out.make_automaton()
        return out


def features(word: str) -> list[str]:
    """The letter groups of four to six of a word, with its ends marked."""
    s = f"^{word}$"
    return [s[i : i + n] for n in (4, 5, 6) for i in range(len(s) - n + 1)]


def evidence(words: list[str], bias: float, matcher: ahocorasick.Automaton | None) -> np.ndarray:
    """For each word the bias and the weights of its features; one pass over all letters, work only where features match."""
    out = np.full(len(words), bias)
    if matcher is not None and words:
        found = [(end, *x) for end, x in matcher.iter(f"^{'$^'.join(words)}$")]
        if found:
            end, size, w = (np.array(x) for x in zip(*found, strict=True))
            start = np.cumsum([0, *(len(x) + 2 for x in words)])
            at = np.searchsorted(start, end, side="right") - 1
            whole = end - size + 1 >= start[at]
            np.add.at(out, at[whole], w[whole])
    return out


def tokens(text: str | None) -> list[str]:
    """Words in lower case, in the places that TOKEN has them in the text itself."""
    found = TOKEN.findall(text) if text else []
    return " ".join(found).lower().split(" ") if found else []


def marginals(e: np.ndarray, lengths: np.ndarray, trans: tuple[float, ...], block: int = BLOCK) -> np.ndarray:
    """Probability of the toxic label for each token; ``e``: evidence of all documents' tokens, one after another.

    Exact: products of the 2x2 step matrices within blocks, then over each document's blocks, then within blocks again.
    """
    out = np.zeros(len(e))
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return out
    a00, a01, a10, a11 = (math.exp(x) for x in trans)
    n_blocks = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    token = np.arange(len(e)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = np.repeat(first[:-1], lengths) + token // block, token % block
    x = np.ones((block, first[-1]))
    on = np.zeros((block, first[-1]), dtype=bool)
    x[col, row], on[col, row] = np.exp(np.clip(e, -30, 30)), True
    full = on.all(axis=1)

    p = [np.ones(first[-1]), np.zeros(first[-1]), np.zeros(first[-1]), np.ones(first[-1])]
    for j in range(block):
        q = [p[0] * a00 + p[1] * a10, (p[0] * a01 + p[1] * a11) * x[j], p[2] * a00 + p[3] * a10, (p[2] * a01 + p[3] * a11) * x[j]]
        total = q[0] + q[1] + q[2] + q[3]
        q = [v / total for v in q]
        p = q if full[j] else [np.where(on[j], b, a) for a, b in zip(p, q, strict=True)]
    order = np.argsort(-n_blocks, kind="stable")
    begin, count = first[:-1][order], n_blocks[order]
    live = [int(n) for n in np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")]
    f0, f1 = np.ones(first[-1]), np.zeros(first[-1])  # forward vector before each block
    for k in range(1, int(count[0])):
        to = begin[: live[k]] + k
        at = to - 1
        g0, g1 = f0[at] * p[0][at] + f1[at] * p[2][at], f0[at] * p[1][at] + f1[at] * p[3][at]
        f0[to], f1[to] = g0 / (g0 + g1), g1 / (g0 + g1)
    b0, b1 = np.ones(first[-1]), np.ones(first[-1])  # backward vector after each block
    for k in range(int(count[0]) - 2, -1, -1):
        has = begin[: live[k + 1]]  # documents with a block after this one
        at, to = has + k + 1, has + k
        g0, g1 = p[0][at] * b0[at] + p[1][at] * b1[at], p[2][at] * b0[at] + p[3][at] * b1[at]
        b0[to], b1[to] = g0 / (g0 + g1), g1 / (g0 + g1)
    ahead = np.empty((2, block, first[-1]))
    for j in range(block):
        g0, g1 = f0 * a00 + f1 * a10, (f0 * a01 + f1 * a11) * x[j]
        total = g0 + g1
        f0, f1 = (g0 / total, g1 / total) if full[j] else (np.where(on[j], g0 / total, f0), np.where(on[j], g1 / total, f1))
        ahead[0, j], ahead[1, j] = f0, f1
    p1 = np.empty((block, first[-1]))
    for j in range(block - 1, -1, -1):
        u, v = ahead[0, j] * b0, ahead[1, j] * b1
        p1[j] = v / (u + v)
        g0, g1 = a00 * b0 + a01 * x[j] * b1, a10 * b0 + a11 * x[j] * b1
        total = g0 + g1
        b0, b1 = (g0 / total, g1 / total) if full[j] else (np.where(on[j], g0 / total, b0), np.where(on[j], g1 / total, b1))
    return p1[col, row]


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: log(1 + expected toxic tokens), and the largest marginal."""
    out = np.zeros((len(lengths), 2))
    if has := np.flatnonzero(lengths > 0).tolist():
        begin = (np.cumsum(lengths) - lengths)[has]
        out[has, 0] = np.log1p(np.add.reduceat(p, begin))
        out[has, 1] = np.maximum.reduceat(p, begin)
    return out


def unlike(docs: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """Without near copies of earlier texts: those that share one of their four smallest hashes of three words."""
    seen: set[int] = set()
    out = []
    for words, y in docs:
        own = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))})[:4]
        if words and not seen.intersection(own):
            out.append((words, y))
        seen.update(own)
    return out


def speaking(docs: list[tuple[list[str], int]], least: float) -> tuple[set[str], dict[str, list[str]]]:
    """The features that speak for toxic documents, and those of each word.

    A feature speaks when its log odds reach ``least`` and its log likelihood ratio exceeds what the best of as many
    features without meaning would reach.
    """
    met: Counter = Counter()  # toxic documents by feature
    of: dict[str, list[str]] = {}
    for words, label in docs:
        own = set(words)
        for w in own:
            of.setdefault(w, [])
        if label:
            met.update({f for w in own for f in features(w)})
    often = {f: k for f, k in met.items() if k >= 3}
    clean: Counter = Counter()
    for words, label in docs:
        if not label:
            clean.update({f for w in set(words) for f in features(w) if f in often})
    n = [sum(1 for _, y in docs if y == k) for k in (0, 1)]
    chance = math.log(max(2, len(met)))
    out = set()
    for f, k in often.items():
        other = clean[f]
        odds = math.log((k + 0.5) / (n[1] + 1)) - math.log((other + 0.5) / (n[0] + 1))
        share = n[1] / (n[0] + n[1])
        ratio = k * math.log(k / ((k + other) * share)) + (other * math.log(other / ((k + other) * (1 - share))) if other else 0)
        if odds >= least and ratio >= chance:
            out.add(f)
    return out, {w: [f for f in features(w) if f in out] for w in of}


def train(rows: list[tuple[str | None, int]], least: float = 2.5, rounds: int = 40, penalty: float = 0.02) -> Field:
    """The field for labelled texts (0 clean, 1 toxic)."""
    one: dict[str, str] = {}  # of each word, else most of the memory
    docs = [([one.setdefault(w, w) for w in tokens(t)], int(y)) for t, y in rows]
    if {y for _, y in docs} != {0, 1}:
        return Field()
    docs = unlike(docs)
    strong, of = speaking(docs, least)
    names = {f: i for i, f in enumerate(sorted(strong))}
    types = {w: i for i, w in enumerate(of)}
    hot = {w: any(f in strong for f in fs) for w, fs in of.items()}
    pairs = [(types[w], names[f]) for w, fs in of.items() for f in fs if f in names]
    ti, fi = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
    cut = [(words[i : i + CUT], y) for words, y in docs for i in range(0, len(words), CUT)]
    ids, gold = np.full((CUT, len(cut)), -1), np.zeros((CUT, len(cut)))
    for b, (words, y) in enumerate(cut):
        ids[: len(words), b] = [types[w] for w in words]
        if y:
            gold[: len(words), b] = [hot[w] for w in words]
    on = ids >= 0
    flat, lengths = ids.T[on.T], on.sum(axis=0)
    y = gold.T[on.T]
    start = np.cumsum(lengths) - lengths
    before = np.concatenate([[0.0], y[:-1]])
    before[start] = 0
    seen = np.array([[(1 - before) @ (1 - y), (1 - before) @ y], [before @ (1 - y), before @ y]])
    w, bias, trans = np.zeros(len(names)), -2.0, np.zeros((2, 2))
    m, v = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    for r in range(1, rounds + 1):
        by_type = bias + np.bincount(ti, weights=w[fi], minlength=len(types)) if len(ti) else np.full(len(types), bias)
        e = by_type[flat]
        p, pair = _pairs(e, ids, on, trans)
        diff = np.bincount(flat, weights=y - p, minlength=len(types))
        grad = np.concatenate([(np.bincount(fi, weights=diff[ti], minlength=len(names)) if len(ti) else w) / 50 - penalty * w, [diff.sum() / 50 - penalty * bias], ((seen - pair) / 50 - penalty * trans).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.3 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        w, bias, trans = w + step[:-5], bias + step[-5], trans + step[-4:].reshape(2, 2)
    out = Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-4}, float(bias), tuple(float(x) for x in trans.ravel()))
    e = evidence([x for words, _ in docs for x in words], out.bias, out.matcher())
    n = np.array([len(words) for words, _ in docs])
    x = summary(marginals(e, n, out.trans), n)
    out.score = _logistic(x, np.array([label for _, label in docs], dtype=float))
    return out


def _pairs(e: np.ndarray, ids: np.ndarray, on: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transition counts of the training sequences."""
    t, b = ids.shape
    x = np.ones((t, b))
    x.T[on.T] = np.exp(np.clip(e, -30, 30))
    a = np.exp(trans)
    f = np.zeros((t + 1, 2, b))
    f[0, 0] = 1
    for j in range(t):
        g = np.stack([f[j, 0] * a[0, 0] + f[j, 1] * a[1, 0], (f[j, 0] * a[0, 1] + f[j, 1] * a[1, 1]) * x[j]])
        f[j + 1] = np.where(on[j], g / g.sum(axis=0), f[j])
    back, p, pair = np.ones((2, b)), np.zeros((t, b)), np.zeros((2, 2))
    for j in range(t - 1, -1, -1):
        joint = f[j + 1] * back
        p[j] = joint[1] / joint.sum(axis=0)
        right = np.stack([back[0], x[j] * back[1]])
        both = f[j][:, None] * a[:, :, None] * right[None]
        pair += (both / both.sum(axis=(0, 1)) * on[j]).sum(axis=2)
        g = np.stack([a[0, 0] * right[0] + a[0, 1] * right[1], a[1, 0] * right[0] + a[1, 1] * right[1]])
        back = np.where(on[j], g / g.sum(axis=0), back)
    return p.T[on.T], pair


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 0.05) -> tuple[float, float, float]:
    """Penalised logistic regression by Newton's method: constant and two slopes."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(3)
        w = w + np.linalg.solve(h, z.T @ (y - p) - penalty * w)
    return tuple(float(v) for v in w)


def score_texts(texts: list[str | None], model: Field, matcher: ahocorasick.Automaton | None) -> list[dict]:
    """Score, counts and toxic spans (marginal of a half or more; neighbouring toxic tokens join) of each text."""
    found = [tokens(t) for t in texts]
    e = np.concatenate([np.zeros(0), *(evidence(words, model.bias, matcher) for words in found)])
    n = np.array([len(words) for words in found], dtype=np.int64)
    p = marginals(e, n, model.trans)
    c, s, mx = model.score
    z = summary(p, n)
    score = 1 / (1 + np.exp(-np.clip(c + s * z[:, 0] + mx * z[:, 1], -50, 50)))
    begin = np.cumsum(n) - n
    out = []
    for i, text in enumerate(texts):
        own = p[begin[i] : begin[i] + n[i]]
        hits = np.flatnonzero(own >= 0.5)
        spans: list[dict] = []
        if len(hits):
            where = [m.span() for m in TOKEN.finditer(text)]
            last = -2
            for h in hits.tolist():
                if h == last + 1:
                    spans[-1] |= {"end": where[h][1], "p": max(spans[-1]["p"], float(own[h]))}
                else:
                    spans.append({"begin": where[h][0], "end": where[h][1], "p": float(own[h])})
                last = h
        out.append({"score": float(score[i]), "n_tokens": int(n[i]), "n_toxic_tokens": len(hits), "spans": spans})
    return out


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", use: Column | None = None, max_docs: int = 700, clean_ratio: int = 3, max_chars: int = 12_000) -> Field:
    """Trains on labelled rows for which ``use`` holds (all if None).

    ``max_docs``: most toxic rows; ``clean_ratio`` times as many clean ones; the first in hash order of texts of at most
    ``max_chars`` characters. The driver thus holds at most (1 + clean_ratio) * max_docs * max_chars characters.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    if use is not None:
        known = known.where(use)
    known = known.withColumn("_h", F.xxhash64(F.col("_id"), F.lit(8)))
    rare = known.where("_y = 1").orderBy("_h", "_id").limit(max_docs)
    rest = known.where("_y = 0").orderBy("_h", "_id").limit(clean_ratio * max_docs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= max_chars)
    # at most (1 + clean_ratio) * max_docs rows of two numbers; of rows that repeat an id one counts, the least
    rows = texts.join(F.broadcast(rare.unionByName(rest).select("_id", "_y")), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_y").alias("_y")).collect()
    return train([(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_text"] or ""))])


def tag(docs: DataFrame, model: Field, *, text_col: str = "text", out_col: str = "toxicity", chunk_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with the columns of SCHEMA in a struct ``out_col`` (a name that they don't have); every whole text is scored where it lies, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, bounded by fit's sample
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value.matcher()
        kind = pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("n_toxic_tokens", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])
        for whole in batches:
            for batch in slices(whole, at, chunk_chars):
                out = score_texts(batch.column(at).to_pylist(), shared.value, matcher)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=kind)], names=[*batch.schema.names, f"c{batch.num_columns}"])
        released()

    return mapped(docs, run, [T.StructField(out_col, SCHEMA)])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), use=fold_of(F.col("_id")) != 2)
    score = F.col("toxicity.score")
    return tag(docs, model).select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.col("toxicity.n_toxic_tokens").alias("n_toxic_tokens"), F.col("toxicity.spans").alias("spans"))
