import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from grove.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def fill_of(lengths, bins):
    return np.bincount(bins, weights=lengths)


@pytest.mark.parametrize("seed", range(6))
def test_pack_lengths_valid_and_near_bound(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, int(r.integers(1, 400)))
    bins, offsets = P.pack_lengths(lengths, 100)
    fill = fill_of(lengths, bins)
    assert fill.max() <= 100 and set(bins) == set(range(bins.max() + 1))
    for b in range(bins.max() + 1):
        i = np.flatnonzero(bins == b)
        i = i[np.argsort(offsets[i])]
        assert offsets[i[0]] == 0
        assert (offsets[i][1:] == offsets[i][:-1] + lengths[i][:-1]).all()
    big = int((lengths > 50).sum())
    assert len(fill) <= 1.04 * max(-(-lengths.sum() // 100), big) + 1


def test_improve_empties_a_bin_by_exchange():
    # fills 90, 70, 40: best possible is two bins of 100 through one exchange
    lengths = np.array([50, 40, 60, 10, 40])
    bins = np.array([0, 0, 1, 1, 2])
    out = P.improve(lengths, bins, 100)
    assert fill_of(lengths, out).max() <= 100
    assert len(set(out)) == 2


def test_improve_increases_squared_fill():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 60, 200)
    bins = np.arange(200) // 2
    out = P.improve(lengths, bins, 120)
    before, after = fill_of(lengths, bins), fill_of(lengths, out)
    assert after.max() <= 120 and (after ** 2).sum() > (before ** 2).sum()
    assert (after > 0).sum() < (before > 0).sum()


def can_improve(lengths, bins, capacity):
    """Whether one or two documents of a bin can move or be exchanged for one, by enumeration."""
    fill = fill_of(lengths, bins).astype(int)
    held = [sorted(set(lengths[bins == b].tolist())) for b in range(len(fill))]
    for a in np.flatnonzero((fill > 0) & (fill < capacity)):
        mine = lengths[bins == a].tolist()
        sums = set(mine) | {x + y for k, x in enumerate(mine) for y in mine[k + 1:]}
        for b in np.flatnonzero((fill > 0) & (fill < capacity)):
            if a != b and any(0 < s - y <= capacity - fill[b] and fill[b] + s - y > fill[a]
                              for s in sums for y in (0, *held[b])):
                return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_improve_ends_where_no_bin_can_improve(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(20, 41, 300)
    out = P.improve(lengths, P.best_fit(lengths, 100), 100)
    fill = fill_of(lengths, out)
    assert fill.max() <= 100
    assert (fill > 0).sum() == -(-lengths.sum() // 100) or not can_improve(lengths, out, 100)


def test_improve_searches_all_bins_of_a_shard():
    # best-fit makes 15,296 sequences of these, a search of 2,000 tries 15,115
    lengths = np.random.default_rng(1).integers(800, 1601, 50_000)
    out = P.improve(lengths, P.best_fit(lengths, 4096), 4096)
    assert fill_of(lengths, out).max() <= 4096
    assert len(set(out.tolist())) <= 14_759


def test_pieces_equal_direct_tokenizer(spark):
    texts = ["", None, "Hello  world\n\nIt's fine\t<|endoftext|> 12 ab́c", "x" * 9000,
             "a b " * 3000, "\x1f z  q İstanbul Σς", "end\n"]
    rows = [(i, t, "extra", 5) for i, t in enumerate(texts)] + [(1, None, "again", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, piece long")
    out = P.pack_documents(docs, PATH, capacity=512, with_ids=True).toPandas()
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        got = out[out.doc_id == i].sort_values("piece")
        if i == 1:
            assert len(got) == 2 and (got.length == 1).all()
            continue
        assert list(got.start) == list(range(0, len(ids), 512))
        for row in got.itertuples():
            part = np.array(ids[row.start:row.start + row.length], dtype="<u4").tobytes()
            assert row.ids_crc32 == zlib.crc32(part) and bytes(row.ids) == part
    use = out.groupby("sequence_id").length.sum()
    assert use.max() <= 512
    assert len(use) <= -(-out.length.sum() // 512) + 1
    seqs = P.sequences(spark.createDataFrame(out)).toPandas()
    assert dict(zip(seqs.sequence_id, seqs.ids.map(len))) == {k: 4 * v for k, v in use.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack_documents(docs, PATH).count() == 0


def test_rules_of_the_tokenizer_are_checked(spark):
    """A tokenizer that keeps spaces and letter case is fed whole texts."""
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert P.cuts_at_spaces(PATH) and not P.cuts_at_spaces(other)
    texts = ["a b c", "Hello World, it is fine.", "", None, "  two  spaces\n\n", "İstanbul \U0001F600 <|endoftext|>", "x" * 9000]
    tok = Tokenizer.from_file(other)
    tok.encode_special_tokens = True
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in P.token_pieces(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), other, capacity=1 << 20, with_ids=True).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}


def test_small_partitions_fill_all_shards(spark, tmp_path):
    """Partitions of one or two pieces are dealt to all shards, not to the first."""
    spark.range(600).selectExpr("id as doc_id", "0 as piece", "1L + id % 7 as length", "id as ids_crc32").repartition(
        300).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a partition a file
    try:
        packed = P.pack(spark.read.parquet(str(tmp_path / "p")), 20, shard_items=150).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    per_shard = (packed["sequence_id"] // (1 << 32)).value_counts()
    assert len(packed) == 600 and len(per_shard) == 4 and per_shard.max() < 250
