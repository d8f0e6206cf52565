import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

sys.path[:0] = [str(Path(__file__).resolve().parent)]
from fixtures import docs, empty, rows

from foldwright.llm import language_model, ngram_join, packing, quality, suffix_dedup, token_counts

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# --- operator 1


def brute_removed(texts):
    """texts in order -> (removed flags) of strings of 100 bytes that start earlier."""
    seen, out = set(), []
    for t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        out.append(gone)
    return out


def removed(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, extra string").repartition(3)
    out = suffix_dedup.kept_parts(suffix_dedup.deduplicated(df, bucket_rows=40), ["_id"], with_kept=True)
    return out.collect()


def test_suffix_dedup_equals_brute_force(spark):
    data = [(i, t, "x") for i, t, *_ in rows() if i is not None and i not in (3,)]
    want = {i: (t or "", g) for (i, t, _), g in zip(sorted(data), brute_removed([t or "" for _, t, _ in sorted(data)]), strict=True)}
    got = {r["_id"]: r for r in removed(spark, data)}
    assert set(got) == set(want)
    for i, (t, gone) in want.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(raw), int(gone.sum())), i
        assert got[i]["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        assert got[i]["kept_sha256"] == hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def test_suffix_dedup_splits_buckets_and_compares_across(spark):
    """One passage in many contexts, at offsets that differ: equal right parts lie in several buckets."""
    import random

    rng = random.Random(5)
    shared = "".join(rng.choice("abcd") for _ in range(120))
    data = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) + shared[rng.randint(0, 15) :] + "".join(rng.choice("xyz") for _ in range(60)), "x") for i in range(300)]
    gone = brute_removed([t for _, t, _ in data])
    got = {r["_id"]: r["n_removed"] for r in removed(spark, data)}
    assert got == {i: int(g.sum()) for (i, _, _), g in zip(data, gone, strict=True)}


def test_suffix_dedup_repeated_rows_nulls_and_nothing(spark):
    text = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(4))
    got = removed(spark, [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, None, None)])
    assert sorted((r["_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 0), (suffix_dedup.NO_ID, len(text))]
    assert removed(spark, []) == []


def test_suffix_dedup_of_a_phrase_in_many_contexts(spark, monkeypatch):
    """A gram with many stretches, met by several tasks that forget, with copies among them; the largest id and no id."""
    import random

    monkeypatch.setattr(suffix_dedup, "SEEN", 50)
    rng = random.Random(8)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(110))
    text = lambda k: "".join(rng.choice("qrstuvwxyz") for _ in range(k))
    data = [text(rng.randint(0, 60)) + phrase + text(rng.randint(0, 60)) for _ in range(80)]
    data = [(i, t, "x") for i, t in enumerate([*data, *data[:20], *data[:5]])]
    data += [(suffix_dedup.NO_ID, data[0][1] + "q", "x"), (None, data[0][1] + "qz", "x")]
    gone = brute_removed([t for _, t, _ in data])
    got = {(r["_id"], r["n_bytes"]): r["n_removed"] for r in removed(spark, data)}
    assert got == {(suffix_dedup.NO_ID if i is None else i, len(t)): int(g.sum()) for (i, t, _), g in zip(data, gone, strict=True)}


def test_suffix_dedup_compares_across_buckets_only_for_wide_grams(spark, monkeypatch):
    """Phrases in many contexts and several buckets: a gram's stretches lie in one bucket, unless they are more than it holds."""
    import random

    rng = random.Random(3)
    text = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    phrases = [text(120, "abcdefgh") for _ in range(8)]
    data = [(i, text(rng.randint(0, 60), "qrs") + phrases[i % 8][rng.randint(0, 10) :] + text(rng.randint(20, 60), "qrs")) for i in range(320)]
    want = {i: int(g.sum()) for (i, _), g in zip(data, brute_removed([t for _, t in data]), strict=True)}
    df, kept = spark.createDataFrame(data, "doc_id long, text string").repartition(3), {}
    save = suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "saved", lambda df, name: kept.setdefault(name, save(df, name)))
    for bucket_rows, across in ((80, False), (10, True)):
        kept.clear()
        out = suffix_dedup.kept_parts(suffix_dedup.deduplicated(df, bucket_rows=bucket_rows), ["_id"], with_kept=False)
        assert {r["_id"]: r["n_removed"] for r in out.collect()} == want
        assert kept["stretches"].where("NOT _gone").count() > 2 * bucket_rows
        assert (kept["found"].where("_n = 0").count() > 0) == across


def test_suffix_dedup_scan_knows_later_copies_of_any_stretch(spark):
    """Of a stretch that a task meets again it deals the first by the stretch, also where the gram was first met with another."""
    phrase = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(2))
    data = [(0, 0, "x" * 40 + phrase + "y" * 40)] + [(i, i, "z" * 40 + phrase + "w" * 40) for i in range(1, 30)]
    met = suffix_dedup.scan(spark.createDataFrame(data, "_id long, _hash long, _text string").coalesce(1)).where(f"_kind = {suffix_dedup.MANY}")
    assert met.count() > 0
    assert met.groupBy("_gram", "_body").count().where("count > 1").isEmpty()


def test_suffix_dedup_scan_takes_little_memory():
    """A worker's part of a batch is small, whatever the batch is."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    texts = ["".join(hashlib.sha256(bytes([i, k])).hexdigest() for k in range(80)) for i in range(250)]
    ids = pa.array(range(len(texts)), pa.int64())
    run = suffix_dedup.scan(SimpleNamespace(mapInArrow=lambda run, _: run))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["_id", "_hash", "_text"])]))) > 0
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_suffix_dedup_string_that_ends_with_its_gram_meets_its_equal_across_buckets():
    """Its right part is the gram alone; the bucket's first suffix is of another wide gram."""
    gram, other, left = b"g" * 30, b"a" * 30, [bytes([65 + k]) * 70 for k in range(5)]

    def found(content):
        k, rel = len(content), np.full(len(content), 70)
        got = suffix_dedup.resolve(np.arange(k), np.arange(k), np.zeros(k, np.int64), np.full(k, 2), rel, np.ones(k, dtype=bool), suffix_dedup.keys_of(content, rel))
        return {(int(a), int(b)) for i, n, s, a, b in zip(*(got[c] for c in ("_id", "_n", "_start", "_k1", "_k2")), strict=True) if (i, n, s) == (1, 0, 0)}

    one = found([left[0] + other + b"a", left[1] + gram + b"m", left[2] + gram + b"z"])
    assert len(one) == 1
    assert one == found([left[3] + gram + b"b", left[1] + gram + b"n", left[4] + gram + b"y"])


def test_multikey_quicksort():
    w = np.random.default_rng(1).integers(0, 3, (700, 4)).astype(">u8")
    assert (w[suffix_dedup.multikey_quicksort(w)] == w[np.lexsort(w.T[::-1])]).all()


def test_kept_characters_stay_whole(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, "x" + t), (2, t)], "doc_id long, text string")
    out = suffix_dedup.kept_parts(suffix_dedup.deduplicated(df), ["_id"], with_kept=True, whole_chars=True)
    assert all(bytes(r["kept"]).decode() is not None for r in out.collect())


# --- operator 3


def test_quality_features_equal_brute_force(spark):
    got = Counter(tuple(r) for r in quality.features(docs(spark)).select("_id", *quality.FEATURES).collect())
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        repeated = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(repeated))] += 1
    assert got == want


def test_quality_verdicts(spark):
    good = [(i, " ".join(f"word{i}x{k}" if k % 12 else f"end{i}{k}." for k in range(120))) for i in range(60)]
    junk = [(100 + i, " ".join(f"wo{i}r{k}&&&" if k % 2 else "|" for k in range(120))) for i in range(12)]
    short = [(200, "too short"), (201, None), (202, "")]
    out = {r["_id"]: r for r in quality.judged(spark.createDataFrame([*good, *junk, *short], "doc_id long, text string")).collect()}
    assert all(out[i]["kept"] for i, _ in good)
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i, _ in junk)
    assert all(out[i]["base_failed"] and not out[i]["kept"] for i, _ in short)
    assert quality.judged(empty(spark)).count() == 0


# --- operator 4


def brute_scores(seqs, corpus):
    """Stupid backoff with 3-grams, by the words of a corpus; a word that it doesn't have counts once."""
    from math import log

    counts = [Counter(tuple(w[k : k + n]) for w in corpus for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(map(len, corpus)) or 1

    def score(w):
        s = 0.0
        for k in range(len(w)):
            for n in (3, 2, 1):
                here = counts[n - 1][tuple(w[k - n + 1 : k + 1])] if k >= n - 1 else 0
                if n == 1 or here >= 1:
                    before = counts[n - 2][tuple(w[k - n + 1 : k])] if n > 1 else total
                    s += log(max(1, here) / before) + (3 - n) * log(0.4)
                    break
        return round(s, 3)

    return [score(w) for w in seqs]


def test_language_model_equals_brute_force(spark):
    data = [(i, t) for i, t, *_ in rows()]
    seqs = [words(t) for _, t in data]
    want = Counter((i, len(w), s) for (i, _), w, s in zip(data, seqs, brute_scores(seqs, seqs), strict=True))
    for got in (language_model.scored(docs(spark), waves=2), language_model.scored_by(docs(spark), docs(spark))):
        assert Counter((r["_id"], r["n_words"], round(r["log_score"], 3) + 0.0) for r in got.collect()) == want
    assert language_model.scored(empty(spark)).count() == 0


def test_language_model_backs_off(spark):
    corpus = ["a b c a b d", "b c e", "a"]
    texts = ["a b c", "a b e", "x b c e", "c x", "", None, "a b c e a b d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["_id"]: (r["n_words"], round(r["log_score"], 3)) for r in language_model.scored_by(df, spark.createDataFrame([(t,) for t in corpus], "text string")).collect()}
    want = brute_scores([words(t) for t in texts], [words(t) for t in corpus])
    assert got == {i: (len(words(t)), s) for i, (t, s) in enumerate(zip(texts, want, strict=True))}


# --- operator 7


def test_packing_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    for ranks in (None, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        out = packing.packed(docs(spark), path, ranks=ranks).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in out:
            pieces[r["doc_id"]].append(r)
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for text_id, text in {i: t for i, t, *_ in rows() if i is not None and i != 3}.items():
            ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
            own = sorted(pieces[text_id], key=lambda r: r["piece"])
            assert np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in own]).tolist() == ids
            assert all(r["length"] == 1024 for r in own[1:]) and [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(pieces[3]) == 2 and sum(r["length"] for r in out) <= 1024 * len(sequences) < sum(r["length"] for r in out) + 1024 * 3
    assert packing.packed(empty(spark), path).count() == 0


def test_ids_equal_the_library_on_all_documents(spark):
    """Every text of the table, odd strings between its words, and runs of white space."""
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    work = packing.Encoder(path, (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    model, rng = tokenizers.Tokenizer.from_file(path), random.Random(2)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    odd = ["<|endoftext|>", "  ", "\t", "\n\n", " \n ", "'s", "it'll", "123", "4567 89", "\u00a0", "\u3000", "\u0301", "\u200d", "\U0001f600", "ß", "日本", "...", "$%", "\r\n", "a", " "]
    for t in texts[::4]:
        parts = t[:400].split(" ")
        for _ in range(6):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(odd))
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for begin in range(0, len(texts), 500):
        part = texts[begin : begin + 500]
        want = [np.array(x.ids, dtype="<u4").tobytes() for x in model.encode_batch(part, add_special_tokens=False)]
        assert work.encode(part) == want


def test_plan_uses_all_pieces():
    import random

    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([1, 2, 7, 64, 256])
        counts = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
        patterns, got = packing.plan(counts, cap), Counter()
        for p in patterns:
            assert p.sequences > 0 and sum(n * k for n, k in p.items) <= cap
            for n, k in p.items:
                got[n] += k * p.sequences
        assert got == Counter(counts)


def test_plan_fills_exactly_what_can_be_filled():
    assert sum(p.sequences for p in packing.plan({60: 10, 40: 10, 50: 4, 30: 2, 20: 2}, 100)) == 13


# --- operator 9


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(docs(spark), path, chunk=200, overlap=16).collect())
    assert got == Counter((i, len(model.encode(t or ""))) for i, t, *_ in rows())
    assert token_counts.count_tokens(empty(spark), path).count() == 0


@pytest.mark.parametrize("letters", [["a", "b", "the ", " ", "\n", "é", "日", "ing", "▁", "😀", "<s>", "Ω", "1"], ["a"], ["a", "b"], [" "], ["日", "本", "é"]])
def test_splices_equal_one_encoding(letters):
    import random

    rng = random.Random(len(letters))
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, c = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path, chunk=50, overlap=8)
    for _ in range(150):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        assert c.count(t) == len(model.encode(t))


# --- operator 10


def brute_components(data, n, percent):
    sets = []
    for i, t in data:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            same = len(x & y)
            if x and y and 100 * same >= percent * (len(x) + len(y) - same):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    import random

    rng = random.Random(n)
    data = [(i, t) for i, t, *_ in rows() if i is not None and i != 3]
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    for i in range(70):  # near copies of near copies: chains and a group past the limit of frequent tokens
        copy = base[:]
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        data.append((1000 + i, " ".join(copy)))
        if i % 20 == 0:
            base = copy
    want = brute_components(data, n, percent)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in data], "doc_id long, text string, _key string, n int").repartition(3)
    assert {r["_id"]: (r["n"], r["_component"]) for r in ngram_join.linked(df, words=n, percent=percent).collect()} == want


def test_ngram_join_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, t), (2, t), (None, t), (7, None), (8, ""), (9, "one"), (10, "One")], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.linked(df).select("_id", "n", "_component").collect())
    assert got == Counter({(5, 27, 2): 2, (2, 27, 2): 1, (None, 27, None): 1, (7, 0, 7): 1, (8, 0, 8): 1, (9, 1, 9): 1, (10, 1, 9): 1})
    assert ngram_join.linked(empty(spark)).count() == 0


def test_ngram_join_splits_hot_keys(spark):
    """Groups of near copies of which most don't link, a passage in many texts, and ids that repeat."""
    import random

    rng = random.Random(3)
    data = []
    for size, most, n in ((160, 9, 90), (60, 30, 400)):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        for _ in range(size):
            copy = base[:]
            for _ in range(rng.randint(0, most)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[f"e{rng.randint(0, 10**6)}"], [], [copy[at], f"e{rng.randint(0, 30)}"]])
            data.append((len(data), " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(50))
    for _ in range(90):
        data.append((len(data), " ".join(f"o{rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))) + " " + passage + " " + " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12)))))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r["_id"]: (r["n"], r["_component"]) for r in ngram_join.linked(df, words=5, percent=80, hot=6, rounds=1).collect()} == brute_components(data, 5, 80)
    own = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, own), (2, own + " more"), (2, passage), (3, passage + " more"), (4, "else"), (4, "else")], "doc_id long, text string")
    assert {(r["_id"], r["n"], r["_component"]) for r in ngram_join.linked(df).collect()} == {(1, 37, 1), (2, 38, 1), (2, 47, 1), (3, 48, 1), (4, 1, 4)}


def test_differences_from_a_leader_lose_no_link():
    """Of two sets that link, both link to the leader or their keys meet as the join asks."""
    rng = np.random.default_rng(4)
    for percent in (85, 80, 60):
        met = 0
        for _ in range(3000):
            lead = rng.choice(10**6, rng.integers(5, 60), replace=False).astype(np.uint64)
            base = np.union1d(rng.choice(lead, rng.integers(1, len(lead) + 1), replace=False), rng.choice(10**6, rng.integers(0, 15), replace=False).astype(np.uint64))
            x, y = (np.union1d(base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])], rng.choice(10**6, rng.integers(0, 5), replace=False).astype(np.uint64)) for _ in range(2))
            same = len(np.intersect1d(x, y))
            if not same or 100 * same < percent * (len(x) + len(y) - same):
                continue
            scheme = ngram_join.Scheme(percent, rng.permutation(np.union1d(lead, base))[: rng.integers(0, 40)])
            (lx, kx, ix), (ly, ky, iy) = (ngram_join.difference(v, np.sort(lead), scheme) for v in (x, y))
            if lx and ly:
                continue
            met += 1
            a, b = (set(k.tolist()) for k in (kx, ky))
            own_a, own_b = set(kx[:ix].tolist()), set(ky[:iy].tolist())
            assert (own_a & own_b) if not lx and not ly else (a & own_b) if ly else (own_a & b)
            g = scheme.buckets(min(len(x), len(y)))
            assert set(scheme.keys(x)[0].tolist()) & set(scheme.keys(y)[0].tolist()), (len(x), len(y), g)
        assert met > 100


def test_parities_bound_differences():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(60)]
    bits = np.stack(ngram_join.parities(np.concatenate(sets), np.array([len(s) for s in sets])))
    for i in range(60):
        for j in range(60):
            assert np.bitwise_count((bits[:, i] ^ bits[:, j]).view(np.uint64)).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_ngram_join_frees_keys_and_verifies_in_waves(spark, monkeypatch):
    alive, at_pairs, waves = set(), [], []
    save, forget = ngram_join.saved, ngram_join.forget

    def saved(df, name):
        out = save(df, name)
        out.called = name
        alive.add(name)
        if name == "pairs":
            at_pairs.append(set(alive))
        waves.append(name)
        return out

    def forgotten(*tables):
        alive.difference_update(t.called for t in tables)
        forget(*tables)

    monkeypatch.setattr(ngram_join, "saved", saved)
    monkeypatch.setattr(ngram_join, "forget", forgotten)
    monkeypatch.setattr(ngram_join, "WAVE", 1, raising=False)
    rng = np.random.default_rng(15)
    data = []
    for i in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for k in range(4):
            data.append((4 * i + k, " ".join([*base, *(f"e{x}" for x in rng.integers(0, 10**6, k))])))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["_id"]: (r["n"], r["_component"]) for r in ngram_join.linked(df).collect()} == brute_components(data, 4, 85)
    assert at_pairs and all(not {"sketch", "keyed", "times"} & x for x in at_pairs)
    assert waves.count("links") > waves.count("pairs")


def test_ngram_join_splits_hot_keys_by_size_first(spark, monkeypatch):
    """Passages in texts of several lengths make large keys; their members are not all held against a leader."""
    compared = []
    split = ngram_join.split
    monkeypatch.setattr(ngram_join, "split", lambda pairs, *rest: compared.append(pairs.count()) or split(pairs, *rest))
    rng = np.random.default_rng(16)
    passages = [" ".join(f"p{k}x{i}" for i in range(40)) for k in range(16)]
    data = []
    for i in range(400):
        base = [passages[k] for k in sorted(rng.choice(16, (1, 2, 4, 8)[i % 4], replace=False))]
        data.append((i, " ".join([*base, *(f"e{x}" for x in rng.integers(0, 10**6, i % 3))])))
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    got = {r["_id"]: (r["n"], r["_component"]) for r in ngram_join.linked(df, hot=75, rounds=0).collect()}
    assert got == brute_components(data, 4, 85)
    assert sum(compared) == 0
