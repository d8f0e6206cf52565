"""Small tables with the odd cases: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, piece int, _id string, _key string"
WORDS = "alpha beta gamma delta omega kappa sigma theta lambda zeta rho tau".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(60, 150)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " tail", passage + " " + prose(rng, 30), prose(rng, 30) + "\n" + passage, passage]
    texts += [None, "", " \n\t ", "one", "two words", "é日本 " * 60, "ab" * 700, " ".join(["same"] * 400), prose(rng, 20_000), "a\n b  c <|endoftext|> d "]
    edited = texts[2].split(" ")
    edited[10] = "changed"
    texts.append(" ".join(edited))
    out = [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t), i, 0.5, 7, "x", None) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[5], "en", "s1", 1, 1, 0.5, 7, "x", None), (None, None, None, None, None, None, None, None, None, None)]


def docs(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
