"""URL verdicts from memory-mapped sorted digest arrays.

A filter is a set of entries (host, path prefix, verdict).  ``build`` sorts
their 64-bit xxhash keys and stores the full strings beside them; tasks write the
files, Spark hands them to every executor and the workers memory-map them, so all
workers of a machine share one copy.  A url is probed for each suffix of its host and
each path length that entries have, by vectorised binary search, and every hit is
confirmed against the stored string.

An entry fits its host and all subdomains, if the url's path starts with the
entry's path.  The longest entry (host and path together) wins; of equally long
ones the longer host, then block.  Entries over ``block_bytes`` are cut into
several arrays that are probed one after the other, so memory is bounded at
any number of entries and none is left out.

Defined results: a null url or one without ``://`` has empty host and path
and no rule; where no entry fits the ``default`` verdict holds; repeated
entries count once; repeated rows are judged each; an empty table or an
empty set of entries gives no rows or the default; other columns stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import lower_az, stored
from grove.session import new_work_path

BLOCK_BYTES = 64 << 20
_MAGIC = np.uint64(0x75726C73)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return lower_az(rest[:end]), tail[:stop]


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


def build(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """The digest array of (host, path, verdict) entries as one block of bytes:
    header, path lengths, sorted keys, string ends, verdicts, strings."""
    from xxhash import xxh64_intdigest
    chosen: dict[bytes, int] = {}
    for host, path, verdict in entries:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict must be allow or block, not {verdict!r}")
        k = _key(lower_az(host), path)
        chosen[k] = chosen.get(k, 0) | (verdict == "block")
    items = sorted((xxh64_intdigest(k), k, v) for k, v in chosen.items())
    lens = sorted({len(k.split(b"\0", 1)[1].decode("utf-8", "surrogatepass")) for k in chosen})
    head = np.array([_MAGIC, len(items), len(lens)], dtype="<u8")
    return b"".join([
        head.tobytes(), np.array(lens, dtype="<u8").tobytes(),
        np.array([h for h, _, _ in items], dtype="<u8").tobytes(),
        np.cumsum([0, *(len(k) for _, k, _ in items)]).astype("<u8").tobytes(),
        np.array([v for _, _, v in items], dtype="u1").tobytes(),
        *(k for _, k, _ in items)])


class DigestArray:
    """A built array, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        magic, n, m = (int(x) for x in raw[:24].view("<u8"))
        if magic != int(_MAGIC):
            raise ValueError("not a digest array")
        at = 24
        self.lens = [int(x) for x in raw[at:at + 8 * m].view("<u8")]
        at += 8 * m
        self.keys = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.verdicts = raw[at:at + n]
        self.strings = raw[at + n:]

    def find(self, probes: list[bytes]) -> list[int]:
        """Index of each probe's entry, or -1.  Entries of one hash follow each
        other, so a collision is settled by the strings."""
        from xxhash import xxh64_intdigest
        n = len(self.keys)
        out = [-1] * len(probes)
        if not n or not probes:
            return out
        h = np.array([xxh64_intdigest(p) for p in probes], dtype=np.uint64)
        pos = np.searchsorted(self.keys, h)
        hit = np.flatnonzero(self.keys[np.minimum(pos, n - 1)] == h)
        for i in hit.tolist():
            j = int(pos[i])
            while j < n and self.keys[j] == h[i]:
                if self.strings[int(self.ends[j]):int(self.ends[j + 1])].tobytes() == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str], whole: bool = False) -> list[tuple[str, str, int] | None]:
        """The winning (host, path, is block) of each url, or None.  ``whole``: an
        entry names one address, its host and whole path, or with an empty path a
        host and its subdomains."""
        probes, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            labels = host.split(".")
            if whole and path:
                probes.append(_key(host, path))
                owner.append(i)
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in (0,) if whole else self.lens:
                    if n <= len(path):
                        probes.append(_key(suffix, path[:n]))
                        owner.append(i)
        best: list[tuple[str, str, int] | None] = [None] * len(hosts)
        for i, probe, j in zip(owner, probes, self.find(probes)):
            if j >= 0:
                host, path = probe.decode("utf-8", "surrogatepass").split("\0", 1)
                mine = (host, path, int(self.verdicts[j]))
                best[i] = mine if best[i] is None else max(best[i], mine, key=rank)
        return best


def rank(x: tuple[str, str, int]) -> tuple[int, int, int]:
    return len(x[0]) + len(x[1]), len(x[0]), x[2]


_OPEN: dict[str, DigestArray] = {}


def opened(name: str) -> DigestArray:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(name))
    return _OPEN[name]


def arrays_of(entries: DataFrame, block_bytes: int) -> list[str]:
    """Names (for ``SparkFiles``) of digest arrays of all ``entries`` (host, path,
    verdict): each is built by a task from about ``block_bytes`` of rows, dealt by
    hash, and written under the shared folder; no entry passes through the driver."""
    spark = entries.sparkSession
    e = entries.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict"))).distinct()
    e = stored(e, "url-entries")
    size = e.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 48)).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    folder = new_work_path(spark, "digests")

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        where, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        where.create_dir(path, recursive=True)
        name = f"{folder.rsplit('/', 1)[-1]}-{key[0]}"
        mine = f"{path}/.{name}-{uuid.uuid4().hex}"
        with where.open_output_stream(mine) as out:  # under its name once it is whole: tasks may run twice
            out.write(build(zip(g["host"], g["path"], g["verdict"])))
        where.move(mine, f"{path}/{name}")
        return pd.DataFrame({"name": [name]})

    part = F.pmod(F.xxhash64("host", "path"), F.lit(parts)).alias("part")
    names = sorted(r["name"] for r in e.select("*", part).groupBy("part").applyInPandas(write, "name string").collect())
    for n in names:
        spark.sparkContext.addFile(f"{folder}/{n}")
    return names


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, default: str = "allow",
               url: str = "url", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds host, path, rule (host and path of the winning rule, else null) and
    verdict to ``pages``: the rule's, else that of the winning entry of
    ``listed`` (addresses and hosts, see ``DigestArray.judge``), else ``default``."""
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in clash]
    out = pages.select(*keep)
    sets = [arrays_of(e, block_bytes) for e in (rules, listed) if e is not None]

    def winners(names: list[str], hosts: list[str], paths: list[str], whole: bool) -> list[tuple[str, str, int] | None]:
        if not names:
            return [None] * len(hosts)
        found = [opened(n).judge(hosts, paths, whole) for n in names]
        return [max((x for x in row if x), key=rank, default=None) for row in zip(*found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(u) for u in b.column(b.schema.get_field_index(url)).to_pylist()]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            best = winners(sets[0], hosts, paths, False)
            rule, final = [x and x[0] + x[1] for x in best], best
            if len(sets) > 1:
                final = [x or y for x, y in zip(best, winners(sets[1], hosts, paths, True))]
            new = [hosts, paths, rule, [default if x is None else ("allow", "block")[x[2]] for x in final]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, pa.string()) for c in new)],
                names=[*b.schema.names, "host", "path", "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(run, f"{schema}, host string, path string, rule string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path by Spark expressions (the same rules as ``split_url``)."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def thin_pages(pages: DataFrame, least_words: int = 150, url: str = "url", html: str = "html") -> DataFrame:
    """Block entries for every host and path under which no page of ``pages`` has
    ``least_words`` words outside its tags (a null page has none)."""
    host, path = host_and_path(F.col(url))
    text = F.regexp_replace(F.coalesce(F.col(html).cast("string"), F.lit("")), "<[^>]*>", " ")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    seen = pages.select(host.alias("host"), path.alias("path"), words.alias("words")).where(F.col("host") != "")
    return seen.groupBy("host", "path").agg(F.max("words").alias("words")).where(F.col("words") < least_words).select(
        "host", "path", F.lit("block").alias("verdict"))
