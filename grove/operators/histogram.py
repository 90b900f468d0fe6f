"""Routing and split histograms, A1-A6.

A forest being trained lives on the driver as a small node table (bounded
by trees x 2^depth and cut into chunks by ``max_memory_mb``); each level it
is shipped to executors as flat NumPy arrays in a broadcast variable.

One ``mapInArrow`` pass per level and chunk does, per Arrow batch: bin the
raw feature values with the frozen thresholds (P13/P14), draw the bag
weight of every (row, tree) from the row key (B3), route every row down
every tree (A1/A2), and add its weight into a per-partition buffer indexed
by (frontier node, feature, bin, channel) (A3/A4).  Only non-zero cells
leave the task, so the shuffle carries partial aggregates, never
rows x trees x features; ``groupBy(...).sum`` finishes the merge (A5).
Stored leaf histograms from an earlier version are unioned in before the
merge (A6).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions import hashing as H
from grove.operators.sampling import SEED_BAG, SEED_SUBSET
from grove.operators.splits import Splits, bins_np

NODE_KEY = ["tree_id", "node_id"]
FLUSH_ENTRIES = 4_000_000  # most pending histogram updates of a task (~64 MB)
FLUSH_LEAST = 262_144  # pending updates of a task whose buffer has fewer cells (~4 MB)


def flush_entries_for(cells: int) -> int:
    """Pending updates before they go into a buffer of ``cells``: about as many as it
    has cells, so that they take no more memory than it and a flush costs no more
    than the updates."""
    return min(FLUSH_ENTRIES, max(FLUSH_LEAST, cells))


def tree_key(tree_id, born_version):
    """Identity of a tree's randomness: a replaced tree gets fresh draws."""
    return np.asarray(born_version, dtype=np.int64) * 1000003 + np.asarray(tree_id, dtype=np.int64)


def channels(num_classes: int) -> int:
    return 3 if num_classes == 0 else num_classes


def hist_columns(num_classes: int) -> list[str]:
    return [f"s{c}" for c in range(channels(num_classes))]


@dataclass
class FlatForest:
    """Nodes of some trees as flat arrays for vectorised descent."""

    tree_ids: np.ndarray      # trees routed in this pass
    roots: np.ndarray         # index of each tree's root
    feature: np.ndarray       # int32 per node
    thr: np.ndarray           # int32: continuous split -> left iff bin <= thr
    is_cat: np.ndarray        # bool
    catmask: np.ndarray       # bool [node, max_arity]: category goes left
    left: np.ndarray
    right: np.ndarray
    split: np.ndarray         # bool: internal node
    node_id: np.ndarray       # int64
    node_tree: np.ndarray     # int32

    @staticmethod
    def build(nodes: "pd.DataFrame", tree_ids: Sequence[int], max_arity: int) -> "FlatForest":
        import pandas as pd  # noqa: F401
        sub = nodes[nodes.tree_id.isin(list(tree_ids))].reset_index(drop=True)
        n = len(sub)
        pos = {(int(t), int(i)): k for k, (t, i) in enumerate(zip(sub.tree_id, sub.node_id))}
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        split = np.zeros(n, bool)
        feat = np.zeros(n, np.int32)
        thr = np.zeros(n, np.int32)
        is_cat = np.zeros(n, bool)
        cm = np.zeros((n, max(1, max_arity)), bool)
        for k, r in enumerate(sub.itertuples(index=False)):
            if not r.is_leaf and r.feature >= 0:
                lk = pos.get((int(r.tree_id), 2 * int(r.node_id)))
                rk = pos.get((int(r.tree_id), 2 * int(r.node_id) + 1))
                if lk is None or rk is None:
                    continue
                split[k] = True
                left[k], right[k] = lk, rk
                feat[k] = int(r.feature)
                cats = r.left_categories
                if cats is not None and len(cats) > 0 and r.split_idx < 0:
                    is_cat[k] = True
                    cm[k, np.asarray(cats, dtype=np.int64)] = True
                else:
                    thr[k] = int(r.split_idx)
        roots = np.array([pos[(int(t), 1)] for t in tree_ids], dtype=np.int64)
        return FlatForest(np.asarray(tree_ids, np.int64), roots, feat, thr, is_cat, cm, left,
                          right, split, sub.node_id.to_numpy(np.int64),
                          sub.tree_id.to_numpy(np.int32))

    def route(self, t_pos: int, bins: np.ndarray) -> np.ndarray:
        """A1: node index reached by each row in tree ``t_pos``."""
        n = bins.shape[0]
        cur = np.full(n, self.roots[t_pos], dtype=np.int64)
        rows = np.arange(n)
        while True:
            s = self.split[cur]
            if not s.any():
                return cur
            f = self.feature[cur]
            b = bins[rows, f]
            cat_left = self.catmask[cur, np.minimum(b, self.catmask.shape[1] - 1)]
            go_left = np.where(self.is_cat[cur], cat_left, b <= self.thr[cur])
            nxt = np.where(go_left, self.left[cur], self.right[cur])
            cur = np.where(s, nxt, cur)


def bin_matrix(batch: pa.RecordBatch, names: Sequence[str], splits: Splits,
               arity: Sequence[int], on_missing: str = "error") -> np.ndarray:
    """P13/P14 over an Arrow batch -> int32 [rows, features]."""
    out = np.empty((batch.num_rows, len(names)), dtype=np.int32)
    for f, name in enumerate(names):
        col = batch.column(name)
        v = col.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if col.null_count:
            v = np.where(np.asarray(col.is_null()), np.nan, v)
        miss = np.isnan(v)
        if miss.any() and on_missing == "error":
            raise ValueError(f"feature {name}: {int(miss.sum())} null or NaN values")
        if arity[f] == 0:
            out[:, f] = bins_np(v, splits.thresholds[f])
        else:
            a = int(arity[f])
            iv = np.where(miss, a - 1, v)
            bad = (iv < 0) | (iv >= a) | (iv != np.floor(iv))
            if bad.any():
                raise ValueError(f"feature {name}: category outside [0, {a})")
            out[:, f] = iv.astype(np.int32)
    return out


def histogram_pass(data: DataFrame, names: Sequence[str], arity: Sequence[int],
                   splits: Splits, num_classes: int, forest: FlatForest,
                   born: dict[int, int], frontier: Sequence[tuple[int, int]],
                   subset_k: int, num_trees_bag: int, subsampling_rate: float,
                   seed: int, label: str = "label", weight: str | None = None,
                   on_missing: str = "error", flush_entries: int = None,
                   draw_mod: int | None = None) -> DataFrame:
    """A3-A5: merged histogram of the frontier nodes over ``data``.  With
    ``draw_mod`` a tree's draws are those of its number modulo that.

    Returns wide rows (tree_id, node_id, feature, bin, s0..s{C-1})."""
    spark = data.sparkSession
    F_ = len(names)
    B = int(max(splits.num_bins)) if splits.num_bins else 1
    C = channels(num_classes)
    fr_tree = np.array([t for t, _ in frontier], dtype=np.int64)
    fr_node = np.array([i for _, i in frontier], dtype=np.int64)
    fr_born = np.array([born[int(t)] for t in fr_tree], dtype=np.int64)
    fr_draw = fr_tree % draw_mod if draw_mod else fr_tree
    # frontier position of every node index of the flat forest
    fpos = np.full(len(forest.node_id), -1, dtype=np.int64)
    lookup = {(int(t), int(i)): k for k, (t, i) in enumerate(zip(forest.node_tree, forest.node_id))}
    for p, (t, i) in enumerate(frontier):
        fpos[lookup[(int(t), int(i))]] = p
    # Feature subset per frontier node, keyed by the tree's birth version
    if subset_k >= F_:
        mask = np.ones((len(frontier), F_), dtype=bool)
    else:
        mask = np.zeros((len(frontier), F_), dtype=bool)
        for bv in np.unique(fr_born):
            sel = fr_born == bv
            from grove.operators.sampling import feature_subset_mask_np
            mask[sel] = feature_subset_mask_np(fr_draw[sel], fr_node[sel], F_, subset_k, seed,
                                               int(bv))
    in_frontier = set(fr_tree.tolist())
    trees_in = [t for t in forest.tree_ids if int(t) in in_frontier]
    t_pos = {int(t): k for k, t in enumerate(forest.tree_ids)}
    payload = {
        "forest": forest, "fpos": fpos, "mask": mask, "fr_tree": fr_tree, "fr_node": fr_node,
        "splits": splits, "trees": [
            (int(t), t_pos[int(t)], int(tree_key(t % draw_mod if draw_mod else t, born[int(t)])))
            for t in trees_in],
    }
    bc = spark.sparkContext.broadcast(payload)
    names = list(names)
    arity = list(arity)
    size = len(frontier) * F_ * B * C
    regression = num_classes == 0
    flush_at = int(flush_entries or flush_entries_for(size))

    def fn(batches):
        p = bc.value
        fo: FlatForest = p["forest"]
        acc = np.zeros(size, dtype=np.float64)
        idx_parts, w_parts = [], []
        pending = 0

        def flush():
            # pending (cell, weight) pairs go into the buffer in one bincount;
            # flushing at a fixed count bounds task memory whatever the
            # number of trees and features
            nonlocal pending
            if idx_parts:
                acc[:] += np.bincount(np.concatenate(idx_parts), weights=np.concatenate(w_parts),
                                      minlength=size)
                idx_parts.clear()
                w_parts.clear()
            pending = 0

        for rb in batches:
            if rb.num_rows == 0:
                continue
            bins = bin_matrix(rb, names, p["splits"], arity, on_missing)
            keys = rb.column("rk").to_numpy(zero_copy_only=False).astype(np.int64)
            y = rb.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
            w0 = (rb.column(weight).to_numpy(zero_copy_only=False).astype(np.float64)
                  if weight else np.ones(rb.num_rows))
            for tid, tp, tk in p["trees"]:
                u = H.uniform_np(SEED_BAG + seed, np.int64(tk), keys)
                w = H.bag_weight_np(u, num_trees_bag, subsampling_rate) * w0
                drawn = np.flatnonzero(w > 0)  # only these rows go down the tree
                fp = p["fpos"][fo.route(tp, bins[drawn])]
                sel = drawn[fp >= 0]
                if not len(sel):
                    continue
                fps, ws, bs, ys = fp[fp >= 0], w[sel], bins[sel], y[sel]
                msk = p["mask"][fps]
                for f in range(F_):
                    m = msk[:, f]
                    if not m.any():
                        continue
                    base = ((fps[m] * F_ + f) * B + bs[m, f]) * C
                    if regression:
                        yy = ys[m]
                        idx_parts += [base, base + 1, base + 2]
                        w_parts += [ws[m], ws[m] * yy, ws[m] * yy * yy]
                        pending += 3 * len(base)
                    else:
                        idx_parts.append(base + ys[m].astype(np.int64))
                        w_parts.append(ws[m])
                        pending += len(base)
                    if pending >= flush_at:
                        flush()
        flush()
        cells = acc.reshape(-1, C)
        nz = np.nonzero(np.any(cells != 0, axis=1))[0]
        if len(nz) == 0:
            return
        b = nz % B
        f = (nz // B) % F_
        fp = nz // (B * F_)
        cols = {"tree_id": pa.array(p["fr_tree"][fp].astype(np.int32)),
                "node_id": pa.array(p["fr_node"][fp]),
                "feature": pa.array(f.astype(np.int32)), "bin": pa.array(b.astype(np.int32))}
        for c in range(C):
            cols[f"s{c}"] = pa.array(cells[nz, c])
        yield pa.RecordBatch.from_pydict(cols)

    schema = ("tree_id int, node_id bigint, feature int, bin int, "
              + ", ".join(f"s{c} double" for c in range(C)))
    cols = ["rk", label] + ([weight] if weight else []) + names
    partial = data.select(*cols).mapInArrow(fn, schema)
    # The Arrow step combined rows per partition.  Its partials meet by cell
    # first, so that a root's (partitions x features x bins) rows spread over all
    # cells; the merged cells, features x bins per node, then go to their node.
    # Hash partitioning on (tree_id, node_id) serves the split windows (tree,
    # node, feature) and the per-node choice: no further shuffles.
    n = max(1, min(len(frontier), spark.sparkContext.defaultParallelism * 2))
    return merge_histograms([partial], num_classes).repartition(n, "tree_id", "node_id")


def merge_histograms(parts: Sequence[DataFrame], num_classes: int) -> DataFrame:
    """Sum cells over partitions and over stored + new histograms."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    sc = hist_columns(num_classes)
    return u.groupBy("tree_id", "node_id", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in sc])


def to_long(hist: DataFrame, num_classes: int) -> DataFrame:
    """Wide histogram -> (tree_id, node_id, feature, bin, class, w), no zeros."""
    sc = hist_columns(num_classes)
    arr = F.array(*[F.struct(F.lit(c).alias("class"), F.col(s).alias("w"))
                    for c, s in enumerate(sc)])
    return (hist.select("tree_id", "node_id", "feature", "bin", F.explode(arr).alias("_c"))
            .select("tree_id", "node_id", "feature", "bin", "_c.class", "_c.w")
            .where(F.col("w") != 0))
