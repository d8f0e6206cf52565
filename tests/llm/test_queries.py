"""Each registered query over a small folder: columns, types, and its rows against brute force."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
import tokenizers

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]
from test_text_operators import brute_components, brute_removed

from foldwright.llm.queries import QUERIES


def documents(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def run(spark, name, folder, types):
    out = QUERIES[name](spark, folder)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in types} == types
    return [r.asDict() for r in out.select(*types).collect()]


def test_suffix_dedup(spark, sf_dir):
    got = {r["doc_id"]: r for r in run(spark, "op1_suffix_dedup", sf_dir, {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})}
    data = sorted(documents(sf_dir))
    assert len(got) == len(data)
    for (i, t), gone in zip(data, brute_removed([t or "" for _, t in data]), strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        want = {"doc_id": i, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": runs, "kept_sha256": hashlib.sha256(raw[~gone].tobytes()).hexdigest()}
        assert got[i] == want


def test_nearest_neighbours(spark):
    folder = "/root/testdata/sf0.01"
    got = defaultdict(list)
    for r in sorted(run(spark, "op2_one_bit_ann", folder, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    t = pq.read_table(f"{folder}/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=float)
    hits = asked = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (v * v[i]).sum(axis=1)
        s[i] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        rows = got.pop(int(ids[i]))
        assert [r for r, *_ in rows] == list(range(1, 21)) and all(abs(x - s[ids == j][0]) < 1e-12 for _, j, x in rows)
        hits += len({j for _, j, _ in rows} & set(want.tolist()))
        asked += 20
    assert not got and hits >= 0.95 * asked


def test_mixing(spark, sf_dir):
    got = run(spark, "op5_mixing", sf_dir, {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t in documents(sf_dir))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["target"], r["source_size"]].append(r["taken"])
    assert all(abs(sum(taken) - target) <= 32 for (target, _), taken in by.items())


def test_sharding(spark, sf_dir):
    types = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = run(spark, "op6_sharding", sf_dir, types)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents(sf_dir))
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_packing(spark, sf_dir):
    types = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got, places = defaultdict(list), defaultdict(list)
    for r in run(spark, "op7_packing", sf_dir, types):
        got[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    data, total = documents(sf_dir), 0
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (i, _), x in zip(data, model.encode_batch([t or "" for _, t in data], add_special_tokens=False), strict=True):
        ids, at = np.array([*x.ids, 2], dtype="<u4"), 0
        for k, r in enumerate(sorted(got.pop(i), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
        total += at
    assert not got
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(places) <= -(-total // 1024) * 1.02 + 1


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in run(spark, "op8_toxicity", folder, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})}
    assert set(got) == {i for i, _ in documents(folder)}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    hits = []
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    for row in labels:
        if row["doc_id"] in got and got[row["doc_id"]]["held_out"] and row["toxic"] is not None:
            hits.append(got[row["doc_id"]]["predicted"] == row["toxic"])
    assert len(hits) > 20 and np.mean(hits) > 0.93  # the table mislabels some


def test_token_counts(spark, sf_dir):
    got = Counter(map(tuple, (r.values() for r in run(spark, "op9_token_counts", sf_dir, {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}))))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in documents(sf_dir):
        n = len(model.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert got == want


def test_ngram_join(spark, sf_dir):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op10_ngram_join", sf_dir, {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})}
    assert got == brute_components(documents(sf_dir), 4, 85)
