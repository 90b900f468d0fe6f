import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from grove.llm import decontam as D
from grove.llm import packing as K
from grove.llm.common import fold, read
from grove.llm.toxicity import fit
from llm.test_linededup import brute as brute_lines
from llm.test_neardup import brute as brute_near

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage."""
    docs, out = read(spark, DIR, "documents"), []
    for _, stage in P.STAGES:
        from grove.llm.common import stored
        docs = stored(stage(spark, docs, DIR), "test-stage")
        out.append(docs)
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_shape(spark, steps):
    documents = read(spark, DIR, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for df in steps[:-1]:
        assert df.dtypes == documents.dtypes
    assert P.ORACLE_SQL is None


def test_toxicity_stage(spark, steps):
    docs, labels = read(spark, DIR, "documents"), read(spark, DIR, "labels")
    model = fit(docs, labels.select("doc_id", "toxic").where(fold(F.col("doc_id")) != 0))
    assert rows(steps[0]) == [(i, t) for i, t in rows(docs) if model.score(t) < 0.5]


def test_line_stage(steps):
    import hashlib
    want = {(i, h) for i, _, _, h in brute_lines(rows(steps[0]))}
    got = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows(steps[1])}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in steps[1].collect())


def test_near_stage(steps):
    want = {d for d, _, _, kept in brute_near(rows(steps[1]), 5, 80) if kept}
    assert {i for i, _ in rows(steps[2])} == want


def test_decontamination_stage(spark, steps):
    items = [D.tokens(r.text) for r in read(spark, DIR, "benchmark").collect()]

    def runs(h, n):
        return {h[i:i + n].tobytes() for i in range(len(h) - n + 1)}

    long_runs = set().union(*(runs(t, 13) for t in items))
    short_runs = set().union(*(runs(t, 6) for t in items))
    kept = {i for i, _ in rows(steps[3])}
    for i, t in rows(steps[2]):
        h = D.tokens(t)
        if runs(h, 13) & long_runs:
            assert i not in kept
        elif not runs(h, 6) & short_runs:
            assert i in kept


def test_packing_stage(spark, steps):
    import public_tokenizers
    texts = dict(rows(steps[3]))
    enc = K.encoder(public_tokenizers.path("word_bpe_49k.json"))
    sizes = dict(zip(texts, (len(x) // 4 + 1 for x in enc.encode([t or "" for t in texts.values()]))))
    got = steps[4].toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == sizes
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all() and g["length"].sum() <= 4096


def test_run(spark, steps):
    key = ["doc_id", "piece"]
    a, b = (x.select("doc_id", "piece", "start", "length", "ids_crc32").toPandas().sort_values(key, ignore_index=True)
            for x in (P.run(spark, DIR), steps[4]))
    assert a.equals(b)


def test_stages_bear_empty_and_null_rows(spark):
    schema = read(spark, DIR, "documents").schema
    odd = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
           (3, "some words of a text", None, None, None)]
    for data in ([], odd):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES:
            out = stage(spark, docs, DIR)
            docs = spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)
        assert docs.count() == len(data)  # nothing here is toxic, repeated as a text with words, or leaked
