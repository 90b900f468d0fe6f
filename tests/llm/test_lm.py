import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grove.llm import lm as M
from grove.llm.common import fold, fold_of


def learned(docs):
    return docs.withColumn("learn", fold(F.col("doc_id")) != 1)


def toks(text):
    return (text or "").encode().lower().split() + [None]


@pytest.fixture(scope="module")
def rows(documents, edges):
    return [(r.doc_id, r.text) for r in documents.collect()] + [(r.doc_id, r.text) for r in edges.collect()]


def brute(spark, rows):
    """Counts, weights and scores of the whole model in plain Python."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r[0] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(10)).alias("h")).collect() if r[1] == 0}
    role = [0 if i is None or fold_of(i) == 1 else 2 if i in gone else 1 for i, _ in rows]
    texts = [toks(t) for _, t in rows]

    def model(which):
        uni, two, docs = Counter(), Counter(), 0
        for r, t in zip(role, texts):
            if r in which:
                docs += 1
                uni.update(t)
                two.update(zip(["start", *t], t))
        return uni, two, docs

    def estimates(m, t):
        uni, two, docs = m
        n, v = sum(uni.values()), len(uni)
        for a, w in zip(["start", *t], t):
            c = docs if a == "start" else uni[a]
            yield 0 if not c else min(M.BUCKETS - 1, int(math.log2(c)) + 1), two[a, w] / max(c, 1), uni[w] / max(n, 1), 1 / (v + 1)

    kept, every = model({1}), model({1, 2})
    ev = [e for r, t in zip(role, texts) if r == 2 for e in estimates(kept, t)]
    cells = pd.DataFrame([(b, 1.0, f2, f1) for b, f2, f1, _ in ev], columns=["b", "n", "f2", "f1"])
    weights = M.learn_weights(cells, 1 / (len(kept[0]) + 1))
    n, v = sum(every[0].values()), len(every[0])
    out = []
    for (i, _), r, t in zip(rows, role, texts):
        score = sum(math.log10(weights[b] @ [f2, f1, f0]) for b, f2, f1, f0 in estimates(every, t))
        base = sum(math.log10((every[0][w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, r == 0, len(t), sum(every[0][w] > 0 for w in t), n, base, score))
    return out


def test_against_brute_force(spark, rows):
    """Small blocks and ranges, so that counts meet across many of them."""
    df = learned(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = [tuple(r) for r in M.score_texts(df, block_chars=20_000, range_keys=1000).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(brute(spark, rows), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3)  # the grid of events rounds the weights


def test_probabilities_sum_to_one(spark, documents):
    """Over the vocabulary and one unknown word, after any known context."""
    _, _, tot = M.counted(documents.select("doc_id", "text", F.lit(1).alias("role")), block_chars=10 ** 9)
    assert tot["n"] == tot["n0"] and tot["d"] == documents.count()
    w = M.learn_weights(pd.DataFrame({"b": [3], "n": [5.0], "f2": [0.1], "f1": [0.01]}), 1 / (tot["v0"] + 1))
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all()
    counts = Counter(x for r in documents.collect() for x in toks(r.text))
    assert tot["n"] == sum(counts.values()) and tot["v"] == len(counts)
    pairs = Counter((a, b) for r in documents.collect() for a, b in zip(toks(r.text), toks(r.text)[1:]))
    a = max((x for x in counts if x), key=counts.get)
    f2 = sum(c for (x, _), c in pairs.items() if x == a) / counts[a]
    assert f2 == pytest.approx(1.0)  # so a2 + a1 + a0 * (V + 1) / (V + 1) = 1


def test_expectation_maximisation_finds_the_mixture():
    r = np.random.default_rng(0)
    f = r.dirichlet([0.3, 0.3], 4000)
    n = np.where(r.random(4000) < 0.7, f[:, 0], f[:, 1]) * 100
    cells = pd.DataFrame({"b": 4, "n": n, "f2": f[:, 0], "f1": f[:, 1]})
    w = M.learn_weights(cells, 1e-9)

    def value(a):
        return (n * np.log(a * f[:, 0] + (1 - a) * f[:, 1] + 1e-300)).sum()

    best = max(np.linspace(0.01, 0.99, 99), key=value)
    assert abs(w[4][0] - best) < 0.02


def test_held_out_text_is_better_than_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = M.score_texts(learned(docs)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert p[0] > p[1]


def test_nothing_to_learn(spark, edges, no_docs):
    out = M.score_texts(edges.withColumn("learn", F.lit(False))).collect()
    assert len(out) == edges.count() and all(r.score == 0 and r.train_tokens == 0 and r.held_out for r in out)
    assert M.score_texts(no_docs.withColumn("learn", F.lit(True))).count() == 0
