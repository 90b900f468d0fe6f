import itertools

import numpy as np
import pytest

from grove.llm import decontam as D

ITEM = [f"w{i}" for i in range(40)]
ITEMS = [(1, " ".join(ITEM)), (2, "short item of seven words only here"), (3, ""), (4, None), (5, " ".join(ITEM)),
         (None, " ".join(f"n{i}" for i in range(20)))]


def frame(spark, rows, name):
    return spark.createDataFrame([(*r, "e") for r in rows], f"{name} long, text string, matched string")


def pairs(df):
    return sorted(((r.doc_id, r.item_id, r.start, r.length, r.matched) for r in df.collect()), key=str)


def test_planted(spark):
    changed = [w if i % 9 != 4 else "changed" for i, w in enumerate(ITEM)]
    docs = [(10, "before " * 30 + " ".join(ITEM) + " after"), (11, "x " + " ".join(ITEM).upper().replace(" ", "!! ")),
            (12, "a b c " + " ".join(changed) + " z"), (13, " ".join(ITEM[:12])), (14, "clean text with none of it " * 20),
            (15, "so: Short item, of seven words only here."), (16, None), (17, ""), (None, " ".join(ITEM)),
            (18, " ".join(f"n{i}" for i in range(20)))]
    got = pairs(D.overlaps(frame(spark, docs, "doc_id"), frame(spark, ITEMS, "item_id")))
    want = [(10, 1, 30, 40, 40), (10, 5, 30, 40, 40), (11, 1, 1, 40, 40), (11, 5, 1, 40, 40), (15, 2, 1, 7, 7),
            (18, None, 0, 20, 20), (None, 1, 0, 40, 40), (None, 5, 0, 40, 40)]
    assert [g for g in got if g[0] != 12] == sorted(want, key=str)
    tolerant = [g for g in got if g[0] == 12]
    assert len(tolerant) == 2 and all(m >= 30 and n > m for *_, n, m in tolerant)
    kept = D.decontaminate(frame(spark, docs, "doc_id"), frame(spark, ITEMS, "item_id")).collect()
    assert sorted(r.doc_id for r in kept) == [13, 14, 16, 17]


def brute(texts, items, min_tokens, penalty):
    """All diagonals of all pairs; the best run by enumeration."""
    out = set()
    for d, text in texts:
        h = D.tokens(text)
        for i, item in items:
            t = D.tokens(item)
            if not len(t):
                continue
            for shift in range(-len(t) + 1, len(h)):
                a, b = max(0, shift), min(len(h), shift + len(t))
                equal = h[a:b] == t[a - shift:b - shift]
                if equal.sum() < min(min_tokens, len(t)):
                    continue
                best = low = total = 0.0
                at = lowest = 0
                for k, e in enumerate(equal):
                    total += 1.0 if e else -penalty
                    if total < low:
                        low, at = total, k + 1
                    if total - low > best:
                        best, lowest, end = total - low, at, k + 1
                if best and equal[lowest:end].sum() >= min(min_tokens, len(t)):
                    out.add((d, i))
    return out


def test_against_all_diagonals(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(12)
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = [(r.doc_id, r.text) for r in documents.collect() if r.text and len(r.text) < 4000]
    rng = np.random.default_rng(0)
    for k, (_, t) in enumerate(items):
        words = t.split()
        for at in rng.choice(len(words), len(words) // 12, replace=False):
            words[at] = "changed"
        texts.append((5000 + k, "some words before " + " ".join(words)))
    got = {(r.doc_id, r.item_id) for r in D.overlaps(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(texts, items, D.MIN_TOKENS, 2.0)
    assert got == want
    assert {(5000 + k, i) for k, (i, t) in enumerate(items) if len(t.split()) >= 16} <= got


def unseeded(masks, min_tokens=13, penalty=2):
    """A run that counts as an overlap, of any length, in which no mask finds a seed; None if there is none.
    A run never scores below 0 from its start and ends at a new maximum, so its state is the
    last tokens, the score, the highest score and the equal tokens so far; all states are visited."""
    wide = max(map(len, masks)) - 1
    seeds = [int(m, 2) for m in masks]
    known = {(0, 0, 0, 0)}
    todo = [(state, "") for state in known]
    for (last, score, top, equal), run in todo:
        assert len(run) < 500
        after = [((last << 1) & ((1 << wide) - 1), score - penalty, top, equal)] if score >= penalty else []
        now = (last << 1) | 1
        if all(now & m != m for m in seeds):
            equal = min(equal + 1, min_tokens)
            if score + 1 > top and equal == min_tokens:
                return run + "1"
            after.append((now & ((1 << wide) - 1), score + 1, max(top, score + 1), equal))
        for state in after:
            if state not in known:
                known.add(state)
                todo.append((state, run + "01"[state[1] > score]))
    return None


def test_every_overlap_of_any_length_has_a_seed():
    assert unseeded(("11111111", "1101100101011", "1110010110100111", "1011010001110101")) is not None
    assert unseeded(D.MASKS) is None


@pytest.mark.parametrize("size,changes", [(13, 0), (15, 2), (16, 3), (18, 4)])
def test_all_changes_of_short_items(size, changes):
    words = [f"w{i}" for i in range(size)]
    block = D.BenchmarkBlock([(1, " ".join(words))], D.MASKS, D.MIN_TOKENS)
    for at in itertools.combinations(range(size), changes):
        text = " ".join("changed" if i in at else w for i, w in enumerate(words))
        assert len(block.overlaps(text, 2.0)) == len(brute([(1, text)], [(1, " ".join(words))], D.MIN_TOKENS, 2.0))


@pytest.mark.parametrize("period", range(4, 13))
def test_periodic_changes(period):
    words = [f"w{i}" for i in range(200)]
    block = D.BenchmarkBlock([(1, " ".join(words))], D.MASKS, D.MIN_TOKENS)
    text = " ".join("changed" if i % period == period - 1 else w for i, w in enumerate(words))
    whole = 200 // period * period  # up to two equal words behind the last change do not count
    (_, start, _, matched), = block.overlaps(text, 2.0)
    assert start == 0 and matched >= whole - 200 // period


def test_random_changes_against_all_diagonals():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    block = D.BenchmarkBlock([(1, " ".join(words))], D.MASKS, D.MIN_TOKENS)
    for _ in range(1500):
        text = " ".join("changed" if x < 0.2 else w for w, x in zip(words, rng.random(30)))
        assert len(block.overlaps(text, 2.0)) == len(brute([(1, text)], [(1, " ".join(words))], D.MIN_TOKENS, 2.0))


def test_blocks_give_the_same(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert pairs(D.overlaps(documents, bench)) == pairs(D.overlaps(documents, bench, block_tokens=300))


def test_edges(spark, edges, no_docs):
    bench = frame(spark, ITEMS, "item_id")
    assert D.overlaps(edges, bench).count() == 0
    assert D.overlaps(no_docs, bench).count() == 0
    assert D.decontaminate(edges, bench).columns == edges.columns
    assert D.decontaminate(edges, spark.createDataFrame([], "item_id long, text string")).count() == edges.count()


@pytest.mark.parametrize("mask", D.MASKS)
def test_masks_ignore_places(mask):
    h = D.tokens(" ".join(ITEM[:len(mask)]))
    for i, on in enumerate(mask):
        other = h.copy()
        other[i] ^= np.uint64(1)
        assert (D.seed_hashes(other, mask) == D.seed_hashes(h, mask)).all() == (on == "0")
