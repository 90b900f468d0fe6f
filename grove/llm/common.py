"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.session import new_work_path

#: ASCII white space; every word rule of this subpackage splits on it alone.
WS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, prefix: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared checkpoint folder and reads
    it back: the lineage is cut and a lost executor costs no recomputation
    of what came before."""
    spark = df.sparkSession
    path = new_work_path(spark, prefix)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text.  ``bytes.split`` splits on exactly the six
    ASCII white-space characters (``str.split`` would take more)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_az(text: str) -> str:
    """Lower-cases A-Z only, as the word contracts ask."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5, the split into learning and held-out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5)


def fold_of(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


_HELD: dict[str, list[dict]] = {}


def hold(owner: str, *caches: dict) -> None:
    """Registers the caches an operator keeps in a Python worker."""
    _HELD.setdefault(owner, []).extend(caches)


def only(owner: str) -> None:
    """Empties the caches of all other operators: a worker that Spark uses again
    for another stage holds those of one operator at a time."""
    for name, caches in _HELD.items():
        if name != owner:
            for c in caches:
                c.clear()


def release() -> None:
    """Gives memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU C library, which alone keeps it
        pass


def lean(owner: str):
    """A ``mapInArrow`` step that leaves a small worker: Spark keeps more workers than
    an executor has cores, uses them in turn, and each would go on holding its
    caches and what its largest batch took."""
    def wrap(fn):
        @functools.wraps(fn)
        def run(batches: Iterator) -> Iterator:
            only(owner)
            try:
                yield from fn(batches)
            finally:
                for c in _HELD.get(owner, ()):
                    c.clear()
                release()
        return run
    return wrap


def sliced(batches: Iterator, rows: int = 512) -> Iterator:
    """Batches in slices, so that few texts are Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (SplitMix64), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit xxhash of words, remembered per worker up to ``limit`` words."""

    def __init__(self, owner: str, limit: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit
        hold(owner, self.known)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest as h
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            v = known.get(w)
            if v is None:
                v = h(w)
                if len(w) <= 64:
                    known[w] = v
            out.append(v)
        return np.array(out, dtype=np.uint64)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes, in order (with fewer words,
    of the whole sequence as one; without words, none)."""
    if not len(h):
        return h
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * _M2 + h[i:i + m])
    return out
