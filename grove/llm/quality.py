"""Quality rules: line labelling by a linear-chain conditional random field.

Each line with a word is content or boilerplate.  Emission scores are linear in
line features (``line_features``), transitions link neighbouring lines, and
Viterbi decoding finds the best labelling of the whole document; the share of
word characters in content lines decides.

The field is trained by maximum likelihood (forward-backward) on labelled
documents, at most ``max_per_class`` of each quality, chosen by a hash of doc_id.
All lines of a document carry its label, and documents are spliced in turn
into training sequences, so that changes of label are learned too.

Defined results: null and empty texts have no words and fail the base rules; null
labels are ignored, the largest label of a document counts; without labels of
both classes every line is content; of several rows of one labelled doc_id the
one whose features' bytes are least teaches; repeated rows get equal results;
other columns stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import WS, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
N_FEATURES = 16


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in WS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WS)]
    repeats = 0
    n = len(words)
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            marked = bytearray(n)
            ones = b"\1" * WINDOW
            for i, w in enumerate(windows):
                first = seen.setdefault(w, i)
                if first != i:
                    marked[first:first + WINDOW] = ones
                    marked[i:i + WINDOW] = ones
            repeats = sum(marked)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def line_features(text: str | None) -> tuple[np.ndarray, list[int]]:
    """Feature rows of the lines with a word, and their word characters."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = [w for w in line.replace("\t", " ").split(" ") if w.strip(WS)]
        if not words:
            continue
        chars = sum(map(len, words))
        symbols = sum(line.count(c) for c in SYMBOLS)
        letters = sum(map(str.isalpha, line))
        distinct = len(set(words)) / len(words)
        same = sum(a == b for a, b in zip(words, words[1:])) / len(words)
        up = line.upper() == line and line.lower() != line
        ends = line.rstrip(WS)[-1]
        marks = line.count("!") + line.count("?")
        rows.append((1.0, min(len(words), 200) / 100, np.log1p(len(words)) / 4, min(chars / len(words), 30) / 10,
                     symbols / chars, min(1.0, 5 * symbols / chars), letters / chars, distinct, same, float(up),
                     float(ends in ".!?"), float(ends == "."), min(1.0, marks / len(words)),
                     min(1.0, 4 * line.count("|") / len(words)), min(1.0, (line.count(",") + line.count(".")) / len(words)),
                     float(line in seen)))
        sizes.append(chars)
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES), sizes


@dataclass
class LineField:
    """Emission weights (features x 2) and transition scores (2 x 2); label 1
    is content."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> list[int]:
        """The best label sequence; of equal ones, content."""
        if not len(x):
            return []
        score = (x @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0]
        back = []
        for e0, e1 in score[1:]:
            from0, from1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + e0, (b + m11 if from1 else a + m01) + e1
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def content_share(self, text: str | None) -> float:
        x, sizes = line_features(text)
        total = sum(sizes)
        return sum(s for s, y in zip(sizes, self.viterbi(x)) if y) / total if total else 0.0


def log_likelihood(emit: np.ndarray, move: np.ndarray, x: np.ndarray, y: np.ndarray,
                   length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded sequences x (n, T, features) with labels y and its
    gradients, by the forward-backward algorithm in log space."""
    n, t_max, _ = x.shape
    s = x @ emit
    on = np.arange(t_max)[None, :] < length[:, None]
    fwd, bwd = np.empty((n, t_max, 2)), np.zeros((n, t_max, 2))
    fwd[:, 0] = s[:, 0]
    for t in range(1, t_max):
        step = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + s[:, t]
        fwd[:, t] = np.where(on[:, t, None], step, fwd[:, t - 1])
    for t in range(t_max - 2, -1, -1):
        nxt = s[:, t + 1] + bwd[:, t + 1]
        step = np.stack([np.logaddexp(move[k, 0] + nxt[:, 0], move[k, 1] + nxt[:, 1]) for k in (0, 1)], axis=1)
        bwd[:, t] = np.where(on[:, t + 1, None], step, 0.0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    node = np.exp(fwd + bwd - z[:, None, None]) * on[..., None]
    truth = np.eye(2)[y] * on[..., None]
    both = on[:, 1:]
    edge = np.exp(fwd[:, :-1, :, None] + move + (s + bwd)[:, 1:, None, :] - z[:, None, None, None])
    edge *= both[..., None, None]
    seen = truth[:, :-1, :, None] * truth[:, 1:, None, :] * both[..., None, None]
    value = (s * truth).sum() + (move * seen.sum((0, 1))).sum() - z[length > 0].sum()
    return value, np.einsum("ntf,ntk->fk", x, truth - node), (seen - edge).sum((0, 1))


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], l2: float = 1e-3, steps: int = 200,
              width: int = 32) -> LineField:
    """Maximum likelihood over (features, labels) sequences; they are cut into
    runs of ``width`` lines."""
    runs = [(x[i:i + width], y[i:i + width]) for x, y in sequences for i in range(0, len(x), width)]
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not runs:
        return LineField(emit, move)
    x = np.zeros((len(runs), width, N_FEATURES))
    y, length = np.zeros((len(runs), width), dtype=int), np.array([len(r[0]) for r in runs])
    for k, (a, b) in enumerate(runs):
        x[k, :len(a)], y[k, :len(b)] = a, b
    m, v = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    scale = 1 / length.sum()
    for t in range(1, steps + 1):
        _, ge, gm = log_likelihood(emit, move, x, y, length)
        g = np.append(scale * ge.ravel() - l2 * emit.ravel(), scale * gm.ravel() - l2 * move.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g ** 2
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        emit = emit + step[:-4].reshape(emit.shape)
        move = move + step[-4:].reshape(2, 2)
    return LineField(emit, move)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 1500) -> LineField:
    """Learns from ``labels`` (doc_id, quality)."""
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("y"))
    h = F.xxhash64("doc_id")
    picked = [lab.where(c).orderBy(h, "doc_id").limit(max_per_class) for c in (F.col("y") == 1, F.col("y") != 1)]
    both = picked[0].unionByName(picked[1])  # at most 2 * max_per_class rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    sample = texts.join(F.broadcast(both), "doc_id").select("doc_id", (F.col("y") == 1).cast("int").alias("y"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [line_features(t)[0].astype("<f4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    made = sample.mapInArrow(features, "doc_id long, y int, x binary").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    rows = stored(made, "line-features").toPandas().sort_values("doc_id")
    if rows["y"].nunique() < 2:
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    order = rows["doc_id"].map(lambda d: (d * 0x9E3779B97F4A7C15) % (1 << 64) / 2.0 ** 64)
    good = [(np.frombuffer(b, "<f4").reshape(-1, N_FEATURES), y) for _, y, b in sorted(zip(order, rows["y"], rows["x"]))]
    spliced = [(np.concatenate([x for x, _ in part]), np.concatenate([np.full(len(x), y) for x, y in part]))
               for part in (good[i:i + 4] for i in range(0, len(good), 4))]
    return fit_field(spliced)


def quality(docs: DataFrame, model: LineField, min_share: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, content_share and kept."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            base = [base_counts(t) for t in texts]
            failed = [base_failed(c[0], c[4]) for c in base]
            share = [shared.value.content_share(t) for t in texts]
            kept = [not f and s >= min_share for f, s in zip(failed, share)]
            counts = [pa.array([c[i] for c in base], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *counts, pa.array(failed, pa.bool_()), pa.array(share, pa.float64()), pa.array(kept, pa.bool_())],
                names=[*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                           "n_repeat_words long, base_failed boolean, content_share double, kept boolean")
