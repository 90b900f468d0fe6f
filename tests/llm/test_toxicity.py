from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grove.llm import toxicity as T
from grove.llm.common import fold, fold_of

MID = "/root/testdata/sf0.1"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    return (rank[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", "toxic")
    model = T.fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    test = docs.join(labels.where(fold(F.col("doc_id")) == 0), "doc_id")
    p = T.score_documents(test, model).select("score", "predicted", "toxic").toPandas()
    y = p["toxic"].to_numpy()
    assert auc(p["score"].to_numpy(), y) > 0.97
    assert p["predicted"][y == 0].mean() < 0.02
    assert p["predicted"][y == 1].mean() > 0.8


def test_features_are_exact_ngrams():
    text = "The Idiot"
    h = np.unique(T.ngram_hashes(text))
    kept = np.unique(np.concatenate([T.ngram_hashes("idiot"), T.ngram_hashes("zzz")]))
    m = T.ToxicityModel(kept, np.ones(len(kept)), 0.0)
    assert set(m.hashes[m.features(text)]) == set(h) & set(kept)
    assert m.depth >= 1


def test_log_count_ratio_and_fit():
    """A separating feature gets a positive weight, a useless one none."""
    index = np.array([0, 1, 0, 1, 1, 1])
    indptr = np.array([0, 2, 4, 5, 6])
    w, b = T.fit_logistic(indptr, index, np.array([2.0, 0.1]), np.array([1, 1, 0, 0]), 1e-3, 300)
    assert w[0] > 1 and abs(w[1]) < w[0] / 5 and b < 0


def test_edges(spark, edges, no_docs, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100002, 1), (None, 1), (5, None), (999999, 0)],
                                   "doc_id long, toxic int")
    model = T.fit(documents.unionByName(edges.select("doc_id", "text")), labels)
    out = T.score_documents(edges, model)
    rows = out.collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.kept for r in rows} == {"e"} and out.columns.count("score") == 1
    bias = 1 / (1 + np.exp(-model.bias))
    assert all(r.score == pytest.approx(bias) for r in rows if not r.text)
    assert T.score_documents(no_docs, model).count() == 0


@pytest.mark.parametrize("toxic,want", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_one_class(spark, documents, toxic, want):
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    m = T.fit(documents, labels)
    assert m.score("any") == pytest.approx(want)


def test_fold():
    assert {fold_of(i) for i in range(100)} == set(range(5)) and fold_of(None) is None


def test_against_a_plain_version(spark, documents):
    """Counts by dictionaries of strings, a dense fit, scores as plain sums."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    texts = {r.doc_id: (r.text or "")[:600] for r in documents.collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    y = {r.doc_id: int(r.toxic == 1) for r in labels.collect() if r.doc_id in texts and r.toxic is not None}
    assert len(set(y.values())) == 2

    def grams(t):
        t = f" {''.join(c.lower() if 'A' <= c <= 'Z' else c for c in t)} " if t else ""
        return {t[i:i + n] for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)}

    sets = {d: grams(t) for d, t in texts.items()}
    p, q = Counter(), Counter()
    for d, v in y.items():
        (p if v else q).update(sets[d])
    kept = sorted(g for g in set(p) | set(q) if p[g] + q[g] >= 4)
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    r = np.array([np.log((p[g] + 1) / (n1 + 2) / ((q[g] + 1) / (n0 + 2))) for g in kept])
    ids = sorted(y)
    x = np.array([[g in sets[d] for g in kept] for d in ids]) * r
    truth = np.array([y[d] for d in ids])
    share = np.where(truth == 1, 0.5 / n1, 0.5 / n0)
    w, m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, 151):
        g = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - truth)
        grad = np.append(x.T @ g + 5e-3 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weight = dict(zip(kept, w[:-1] * r))
    model = T.fit(docs, labels, n_features=10_000_000)
    for row in T.score_documents(docs, model).collect():
        z = w[-1] + sum(weight.get(g, 0.0) for g in sets[row.doc_id])
        assert row.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_one_row_of_a_labelled_doc_id_teaches(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    more = documents.selectExpr("doc_id", "concat('zz ', text) as text")
    both = [documents.unionByName(more).repartition(7), more.unionByName(documents).unionByName(documents)]
    rows = [sorted(map(tuple, T.training_rows(d, labels, 50).collect())) for d in both]
    assert rows[0] == rows[1] and len({r[0] for r in rows[0]}) == len(rows[0])
