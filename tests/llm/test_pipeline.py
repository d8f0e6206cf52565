"""Each stage against a brute-force version, and the whole run."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]
from test_row_operators import _labelled
from test_text_operators import brute_components, brute_removed

import corpus_pipeline as pipeline
from foldwright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, _id string, _hash string, _h int, kept string"


def _rows():
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(60))
    texts = [t for t, _ in _labelled()]
    clean = [" ".join(f"c{rng.randint(0, 3000)}" for _ in range(80)) for _ in range(40)]
    clean += [clean[0], clean[1] + " more", passage + " " + clean[2][:200], clean[3][:150] + " " + passage]
    rows = [*((i, t, "en", f"s{i % 3}", len(t), 1) for i, t in enumerate(texts)), *((1000 + i, t, "en", f"s{i % 2}" if i % 5 else None, len(t), 1) for i, t in enumerate(clean)), (2000, None, None, None, None, None), (2001, "", "en", "s1", 0, 1), (None, "alone " + clean[4], "en", "s1", 5, 1)]
    return [(*r, "x", None, 1, "y") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(_labelled())], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    labels = {i: y for i, (_, y) in enumerate(_labelled())}
    left = {r["doc_id"] for r in kept["toxicity"]}
    assert left == {r[0] for r in _rows()} - {i for i, y in labels.items() if y}

    data = [(r["doc_id"], r["text"]) for r in kept["toxicity"] if r["doc_id"] is not None]
    component = brute_components(data, 5, 80)
    want = {i for i, _ in data if component[i][1] == i} | {None}
    assert {r["doc_id"] for r in kept["near_copies"]} == want and len(kept["near_copies"]) == len(want)

    ordered = sorted(kept["near_copies"], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    gone = brute_removed([r["text"] or "" for r in ordered])
    texts = {}
    for r, g in zip(ordered, gone, strict=True):
        text = None if r["text"] is None else np.frombuffer(r["text"].encode(), np.uint8)[~g].tobytes().decode()
        if text or not g.any():
            texts[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in kept["repeated_passages"]} == texts

    times, rows = Counter(r["doc_id"] for r in kept["mixing"]), {r["doc_id"]: r for r in kept["repeated_passages"]}
    assert max(times.values()) <= 3 and set(times) <= set(rows) and {2000, 2001} <= set(times)
    by = defaultdict(int)
    for r in kept["mixing"]:
        assert r["text"] == rows[r["doc_id"]]["text"]
        by[r["source"]] += len((r["text"] or "").split())
    assert all(by[s] > 0 for s in {r["source"] for r in rows.values() if r["text"]})

    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for r in kept["packing"]:
        ids[r["doc_id"]] += len(np.frombuffer(bytes(r["ids"]), "<u4"))
    assert ids == Counter({i: n * (len(model.encode(rows[i]["text"] or "", add_special_tokens=False).ids) + 1) for i, n in times.items()})


def test_near_copies_tell_rows_not_ids(spark, folder):
    rng = random.Random(13)
    text = [" ".join(f"n{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(1, text[0]), (2, text[0] + " more"), (2, text[1]), (2, text[2]), (2, text[2] + " more"), (2, text[1])]  # id 2: a copy of 1, and texts of its own
    rows += [(0, text[3]), (5, text[3]), (5, text[4]), (4, text[4]), (9, None), (9, None), (9, text[7])]
    rows += [(None, text[5]), (None, text[5]), (None, text[5] + " more"), (None, text[6]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "x", None, 1, "y") for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, docs, folder).collect())
    assert all(n == 1 for n in got.values())
    fixed = {(1, text[0]), (2, text[1]), (0, text[3]), (4, text[4]), (9, None), (9, text[7]), (None, text[6]), (None, None), (None, "")}
    assert fixed <= set(got)
    free = sorted(set(got) - fixed, key=lambda x: x[0] is None)
    assert [(i, t.removesuffix(" more")) for i, t in free] == [(2, text[2]), (None, text[5])]


@pytest.mark.parametrize("long", [100_000, 20])
def test_mixing_comes_near_targets(spark, folder, monkeypatch, long):
    monkeypatch.setattr(mixing, "LONG", long, raising=False)  # of few, most documents are chosen by shard
    rng = random.Random(12)
    sizes = {"a": [2000] * 40 + [rng.randint(5, 60) for _ in range(200)], "b": [30_000, 20_000, *(rng.randint(5, 60) for _ in range(900))], "c": [rng.randint(50, 150) for _ in range(900)], "d": [20_000]}
    rows = [(s, n) for s, part in sizes.items() for n in part]
    docs = spark.createDataFrame([(i, " ".join(["w"] * (n - 1) + [f"x{i}"]), "en", s, 1, 1, "x", None, 1, "y") for i, (s, n) in enumerate(rows)], SCHEMA)
    goal = dict(zip(sizes, mixing.targets([sum(p) for p in sizes.values()], mixing.by_turns(4), 3), strict=True))
    kept = pipeline.mix_sources(spark, docs, folder).select("source", "doc_id", "text").collect()
    got = Counter()
    for r in kept:
        got[r["source"]] += len(r["text"].split())
    assert all(abs(got[s] - goal[s]) <= 0.002 * goal[s] + 30 for s in "abc"), (got, goal)
    assert got["d"] in {20_000, 40_000} and abs(got["d"] - goal["d"]) <= 20_000  # one document: whole or gone
    assert max(Counter(r["doc_id"] for r in kept).values()) <= 3


def test_mixing_follows_quotas_and_blocks(spark, monkeypatch):
    seats, apportion = [], mixing.apportion
    monkeypatch.setattr(mixing, "apportion", lambda weights, n: seats.append(apportion(weights, n)) or seats[-1])
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 90))), "abc"[i % 7 % 3]) for i in range(400)] + [(400, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r["_id"]: r["_times"] for r in mixing.whole(docs).collect()}
    assert len(seats) == 1 and len(seats[0]) == 4  # blocks go to all sources, that without words included
    mixed = {r["_id"]: r for r in mixing.mix(docs, shard_words=1_048_576).collect()}
    assert all(0 <= times[i] - r["passes"] <= 1 for i, r in mixed.items() if r["size"]) and times[400] == 1
    for s in "abc":
        own = [r for r in mixed.values() if r["_source"] == s]
        assert abs(sum(times[r["_id"]] * r["size"] - r["taken"] for r in own)) <= 45


def test_a_source_of_one_long_text_stays(spark, folder):
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "en", s, 1, 1, "x", None, 1, "y") for i, (s, n) in enumerate([("a", 10_000), ("b", 9_000)])], SCHEMA)
    assert {r["source"] for r in pipeline.mix_sources(spark, docs, folder).select("source").collect()} == {"a", "b"}


def test_columns_of_any_name_pass(spark, folder):
    names = ["_gone", "_toxicity", "_mix_id_", "_row", "_key", "_id", "_source", "_times", "_text_hash", "_own", "kept", "a.b", "_doc_", "_n"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 30 OR doc_id > 995 OR doc_id IS NULL")
    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for _, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert {tuple(r)[5:] for r in got.collect()} == {tuple(range(len(names)))}


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_stages_give_heap_back(spark, folder):
    """Each stage has executors collect their garbage first; with a local master that is the JVM at hand."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        before = full()
        stage(spark, docs, folder)
        assert full() > before, name
