import hashlib

import numpy as np
import pytest

from grove.llm import linededup as L


def brute(rows):
    holders = {}
    for i, t in rows:
        for k in L.keys_of(t, 10):
            if k:
                holders.setdefault(k, set()).add(L.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        me = L.NO_ID if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, L.keys_of(t, 10)) if not k or len(holders[k]) < 2 or me == min(holders[k])]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest())
                   for r in df.collect()), key=str)


SHARED = [(1, "A shared line here\nown one of doc 1"), (2, "  a SHARED line here\t\nshort\nshort"), (0, "x\nA shared line here"),
          (3, "short"), (3, "A shared line here"), (None, "a shared line here\nÄshared line"), (9, "äshared line\nÄshared line")]


@pytest.mark.parametrize("max_bits", [1 << 30, L.SEGMENT])
def test_against_brute_force(spark, documents, edges, max_bits):
    rows = [tuple(r) for r in documents.collect()] + [(r.doc_id, r.text) for r in edges.collect()] + SHARED
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(L.dedup_lines(df, max_bits=max_bits)) == brute(rows)


def test_a_full_filter_changes_nothing(spark, documents, monkeypatch):
    """With every bit set all keys are suspected; the exact step decides alone."""
    rows = [tuple(r) for r in documents.collect()]
    monkeypatch.setattr(L, "twice_filter", lambda docs, bits, n: np.full(bits // 8, 255, np.uint8))
    assert got(L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_partial_filters_merge_over_several_levels(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 3)
    rows = [tuple(r) for r in documents.collect()] + SHARED
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    assert got(L.dedup_lines(df)) == brute(rows)


def test_few_suspects(spark, documents):
    """Keys of one document hardly ever look repeated."""
    docs = documents.where("text is not null")
    bits = L.filter_bits(docs, 10, 1 << 30)
    twice = L.twice_filter(docs.repartition(8), bits, 10)
    assert np.unpackbits(twice).mean() < 0.2


def test_other_columns_and_empty(edges, no_docs):
    out = L.dedup_lines(edges)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("n_lines") == 1
    assert {r.kept for r in out.collect()} == {"e"}
    assert L.dedup_lines(no_docs).count() == 0
