"""Best-fit packing of token sequences, improved by swaps.

``token_pieces`` tokenises whole texts and cuts only documents that are
longer than a sequence; ``pack`` places the pieces.  Rows are dealt evenly
to shards of about ``shard_items`` pieces (three numbers each, so a shard
is small at any input size); a shard packs best-fit in falling length and then
searches locally: documents move, or are exchanged one for one or two for
one, from the emptiest sequence into fuller ones whenever that increases the
sum of squared fills, until sequences become empty.  A shard stops at its
lower bound ceil(tokens / capacity), so the whole result is at most the
shards' rounding above the global bound.

Defined results: a null or empty text is the end token alone; repeated rows
are packed as often as they occur; ties are broken by (doc_id, piece, crc);
an empty table gives an empty result; further columns of the input are
ignored.  A piece longer than the capacity raises.  Any tokenizer file works:
one whose rules allow it is fed distinct words, others whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import hold, lower_az, only, sliced, stored

CAPACITY = 4096
END_ID = 1
WORDS = 1_200_000  # words and stems a Python worker remembers, at most; a caller short of memory may ask for fewer


_PUNCT = ".,!?;:%$#*&|"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

# fixed values: the rules under which a text may be cut at spaces (see ChunkEncoder)
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_spaces(path: str) -> bool:
    """Whether the tokenizer file has just the rules that ``ChunkEncoder`` relies on."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    cut = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    return ((rules["normalizer"] or {}).get("normalizers") == _NORMALIZERS and rules["post_processor"] is None
            and rules["model"]["type"] == "BPE" and rules["model"]["dropout"] is None and len(cut) == 2
            and cut[0].get("pattern") == {"Regex": _WORDS} and (cut[0]["behavior"], cut[0]["invert"]) == ("Removed", True)
            and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"])


class TextEncoder:
    """Token ids of whole texts as little-endian uint32 bytes, for any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # control strings in texts are plain text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            yield array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes()


class Recent:
    """The words used last, in two generations of at most ``half`` words (or one
    batch): a word used again moves to the younger one; when that is full, the
    older is forgotten."""

    def __init__(self, half: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = half
        hold("packing", self.young, self.old)

    def missing(self, words: set[str]) -> list[str]:
        """Words to be learned; the others are in ``young`` afterwards."""
        if len(self.young) + len(words) > self.half:
            self.young, self.old = self.old, self.young
            self.young.clear()
        young, old, out = self.young, self.old, []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            else:
                out.append(w)
        return out


class ChunkEncoder:
    """Token ids of a text as little-endian uint32 bytes, by distinct words.

    Under the rules that ``cuts_at_spaces`` checks, a tokenizer never joins
    characters across a space or a line feed, nor a letter with punctuation
    behind it, and it lower-cases.  So a text is the concatenation of its
    chunks between spaces, a chunk that of its stem and its closing
    punctuation; both are tokenised once and remembered, the ``limit`` last
    used of each.
    """

    def __init__(self, path: str, limit: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # control strings in texts are plain text
        # a stem of lower-case letters alone needs neither normalising nor cutting
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chunks, self.stems = Recent(limit // 2), Recent(limit // 2)

    def learn(self, new: list[str]) -> None:
        """Adds chunks, all of which are available afterwards."""
        cut = {}
        for c in new:
            low = c.lower() if c.isascii() or max(c) <= "\xff" else lower_az(c)
            stem = low.rstrip(_PUNCT)
            cut[c] = (stem, low[len(stem):]) if stem and stem[-1] in _LETTERS else (low, "")
        missing = self.stems.missing({x for pair in cut.values() for x in pair})
        stems = self.stems.young
        plain = [x for x in missing if not x.strip(_LETTERS)]
        for tok, texts in ((self.bare, plain), (self.tok, list(set(missing).difference(plain)))):
            for i in range(0, len(texts), 20_000):
                part = texts[i:i + 20_000]
                for c, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
                    stems[c] = array("I", e.ids).tobytes()
        for c, (stem, tail) in cut.items():
            self.chunks.young[c] = stems[stem] + stems[tail] if tail else stems[stem]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 64):
            split = [t.replace("\n", " ").split(" ") for t in texts[i:i + 64]]
            self.learn(self.chunks.missing(set().union(*split)))
            known = self.chunks.young
            for chunks in split:
                yield b"".join([known[c] for c in chunks])


_ENCODERS: dict[tuple[str, int], ChunkEncoder | TextEncoder] = {}


def encoder(path: str, words: int = WORDS) -> ChunkEncoder | TextEncoder:
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = ChunkEncoder(path, words) if cuts_at_spaces(path) else TextEncoder(path)
    return _ENCODERS[path, words]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if
    asked for, the ids themselves (little-endian uint32 bytes)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        enc = encoder(tokenizer, words)
        for b in sliced(batches):
            cols: list[list] = [[] for _ in names]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row = [doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    for col, v in zip(cols, row + [part] * with_ids):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, fields + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, longest first, each into the bin it fills best.
    Bins wait by their gap; an integer's bits tell which gaps exist."""
    bins = np.empty(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                gaps ^= 1 << gap
        else:
            gap, b, made = capacity, made, made + 1
        bins[i] = b
        if gap > n:
            waiting[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return bins


class _Places:
    """Underfull bins by what one exchange leaves: for a bin of room r and each
    length y in it (and y = 0, for a mere move), the weight t = y + r that fits
    in place of y.  ``low[t]`` is the least such y, or ``none``."""

    def __init__(self, capacity: int):
        self.none = capacity + 1
        self.low = np.full(capacity + 1, self.none, dtype=np.int64)
        self.bits = [0] * (capacity + 1)  # an integer's bits tell which y exist
        self.bins: dict[tuple[int, int], dict[int, None]] = {}

    def put(self, b: int, room: int, held: dict[int, list[int]]) -> None:
        if room and held:
            for y in (0, *held):
                self.bins.setdefault((y + room, y), {})[b] = None
                self.bits[y + room] |= 1 << y
                self.low[y + room] = min(self.low[y + room], y)

    def take(self, b: int, room: int, held: dict[int, list[int]]) -> None:
        if room and held:
            for y in (0, *held):
                t = y + room
                among = self.bins[t, y]
                del among[b]
                if not among:
                    del self.bins[t, y]
                    left = self.bits[t] = self.bits[t] ^ (1 << y)
                    self.low[t] = (left & -left).bit_length() - 1 if left else self.none

    def least(self, width: int) -> np.ndarray:
        """Least y over t in [s, s + width) for each s."""
        out, have = self.low.copy(), 1
        while have < width:
            step = min(have, width - have)
            if step >= len(out):
                break
            out[:-step] = np.minimum(out[:-step], out[step:])
            have += step
        return out


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search among underfull bins, until none can improve.

    Net weight d goes from a source of fill a to a bin of fill b only if
    b + d <= capacity and b + d > a, which increases the sum of squared fills;
    so the search ends.  From the emptiest bin on, one or two documents move,
    or are exchanged for one, where d is greatest, then where they fit best.
    A bin without such a step waits until all have been tried; the search ends
    at the lower bound or when every bin was tried since the last step.  A try
    costs the distinct lengths of a bin and a pass over ``capacity`` numbers,
    whatever the number of pieces."""
    bins = bins.copy()
    held: list[dict[int, list[int]]] = [{} for _ in range(int(bins.max(initial=-1)) + 1)]
    for i, (b, n) in enumerate(zip(bins.tolist(), lengths.tolist())):
        held[b].setdefault(n, []).append(i)
    fill = np.bincount(bins, weights=lengths, minlength=len(held)).astype(np.int64).tolist()
    least, live = -(-int(lengths.sum()) // capacity), sum(f > 0 for f in fill)
    places = _Places(capacity)
    for b, f in enumerate(fill):
        places.put(b, capacity - f, held[b])

    def queue() -> list[tuple[int, int]]:
        return [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]

    waiting, stepped = queue(), False
    heapify(waiting)
    while live > least:
        if not waiting:
            if not stepped:
                break
            waiting, stepped = queue(), False
            heapify(waiting)
            continue
        f, a = heappop(waiting)
        if fill[a] != f:
            continue  # changed since it was queued; queued anew then
        places.take(a, capacity - f, held[a])
        one = np.array(sorted(held[a]), dtype=np.int64)
        twice = np.array([n for n in one.tolist() if len(held[a][n]) > 1], dtype=np.int64)
        i, j = np.triu_indices(len(one), 1)
        sums = np.concatenate([one, one[i] + one[j], 2 * twice])
        gain = sums - places.least(capacity - f)[sums]
        k = int(np.argmax(gain))
        d, s = int(gain[k]), int(sums[k])
        if d <= 0:
            places.put(a, capacity - f, held[a])
            continue
        t = s + int(np.argmin(places.low[s:s + capacity - f]))
        y = s - d
        b = next(iter(places.bins[t, y]))
        places.take(b, capacity - fill[b], held[b])
        m = k - len(one)
        out = [s] if m < 0 else [int(one[i[m]]), int(one[j[m]])] if m < len(i) else [s // 2, s // 2]
        for n, x, z in [(n, a, b) for n in out] + [(y, b, a)] * (y > 0):
            item = held[x][n].pop()
            if not held[x][n]:
                del held[x][n]
            held[z].setdefault(n, []).append(item)
            bins[item] = z
        fill[a] -= d
        fill[b] += d
        live -= fill[a] == 0
        stepped = True
        for x in (a, b):
            places.put(x, capacity - fill[x], held[x])
            if 0 < fill[x] < capacity:
                heappush(waiting, (fill[x], x))
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; bins are numbered from 0 without gaps."""
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.r_[True, np.diff(bins[order]) > 0] if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, starts, 0)) if len(order) else starts
    offsets = np.empty(len(lengths), dtype=np.int64)
    offsets[order] = starts - base
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_items: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces`` (doc_id, piece,
    length, ids_crc32 and any further columns)."""
    n = pieces.count()
    shards = max(1, -(-n // shard_items))
    cols = pieces.columns

    def place(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = pack_lengths(g["length"].to_numpy(), capacity)
        out = g[cols].copy()
        out["sequence_id"] = (int(key[0]) << 32) + bins.astype(np.int64)
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    # every partition starts at a shard of its own, so that small ones don't all fill the first
    start = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(shards))
    dealt = pieces.withColumn("_shard", (F.monotonically_increasing_id() + start) % F.lit(shards))
    return dealt.groupBy("_shard").applyInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Tokenise, cut and pack all ``docs`` (doc_id, text)."""
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids, words), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence from pieces packed with their ids: one row
    per sequence_id, at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
