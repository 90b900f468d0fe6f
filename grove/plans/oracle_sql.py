"""SQL (DuckDB dialect) for the oracle side of the registered queries.

These builders restate each operator's definition in plain SQL - GROUP BY,
window functions, joins - independently of the Spark implementation: the
stride thresholds use a range join and MIN instead of the Spark plan's
explode, and trees are grown level by level with one CTE per level.
"""

from __future__ import annotations

from grove.functions import hashing as H
from grove.functions import impurity as I
from grove.operators.sampling import (SEED_BAG, SEED_BATCH, SEED_ERF, SEED_SAMPLE,
                                      SEED_SUBSET)


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def hash_u(alias: str, seed: int, values: list[str]) -> tuple[str, str]:
    """(select items, uniform expression) for a chain hash."""
    items = ", ".join(H.chain_select_items(alias, seed, values))
    return items, H.uniform_sql(alias)


def long_sql(base: str, features: list[str], extra: str = "") -> str:
    """(rk, label, feature, v) from a fixture subquery."""
    parts = [f"SELECT rk, label{extra}, {i} AS feature, CAST({f} AS DOUBLE) AS v FROM ({base})"
             for i, f in enumerate(features)]
    return " UNION ALL ".join(parts)


def sample_sql(base: str, max_bins: int, seed: int = 0) -> str:
    """B2: rows of ``base`` kept by the quantile sample."""
    req = max(max_bins * max_bins, 10000)
    items, u = hash_u("sh", SEED_SAMPLE + seed, ["rk"])
    return (f"SELECT * EXCLUDE (sh, sh_s0, sh_s1) FROM (SELECT *, {items}, count(*) OVER () AS _n "
            f"FROM ({base})) WHERE {u} < CASE WHEN {req} < _n THEN CAST({req} AS DOUBLE) / _n "
            f"ELSE 1.0 END")


def thresholds_sql(long: str, num_splits: int) -> str:
    """Q2 + Q3 over (feature, v) rows -> (feature, split_idx, threshold)."""
    S = int(num_splits)
    return f"""
    WITH vc AS (SELECT feature, v, count(*) AS n FROM ({long}) WHERE v IS NOT NULL AND NOT isnan(v)
                GROUP BY feature, v),
    r AS (SELECT feature, v, n,
                 row_number() OVER (PARTITION BY feature ORDER BY v) AS j,
                 sum(n) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS c,
                 sum(n) OVER (PARTITION BY feature) AS tot,
                 count(*) OVER (PARTITION BY feature) AS m FROM vc),
    ks AS (SELECT DISTINCT r.feature, k.k FROM r, range(1, {S + 1}) k(k) WHERE r.m > {S}),
    f AS (SELECT ks.feature, ks.k, min(r.j) AS fk FROM ks JOIN r ON r.feature = ks.feature
          AND r.j >= 2 AND (2 * r.c - r.n) * {S + 1} > 2 * ks.k * r.tot GROUP BY ks.feature, ks.k),
    e AS (SELECT feature, k, k + max(fk - k) OVER (PARTITION BY feature ORDER BY k
          ROWS UNBOUNDED PRECEDING) AS jk FROM f)
    SELECT feature, CAST(j - 1 AS INTEGER) AS split_idx, v AS threshold FROM r WHERE m <= {S}
    UNION ALL
    SELECT e.feature, CAST(e.k - 1 AS INTEGER) AS split_idx, r.v AS threshold
    FROM e JOIN r ON r.feature = e.feature AND r.j = e.jk - 1 WHERE e.jk <= r.m
    """


def binned_sql(long: str, th: str, extra: str = "") -> str:
    """bin = number of thresholds below the value."""
    return (f"SELECT l.rk, l.label{extra}, l.feature, CAST(count(t.threshold) AS INTEGER) AS bin "
            f"FROM ({long}) l LEFT JOIN ({th}) t ON t.feature = l.feature AND t.threshold < l.v "
            f"GROUP BY ALL")


def nbins_sql(th: str, num_features: int) -> str:
    return (f"SELECT f.feature, CAST(count(t.threshold) + 1 AS INTEGER) AS nb FROM "
            f"range({num_features}) f(feature) LEFT JOIN ({th}) t ON t.feature = f.feature "
            f"GROUP BY f.feature")


def candidates_sql(hist: str, nb: str, kind: str, channels: int, min_inst: float = 1.0) -> str:
    """T1/T2 for continuous features: (tree_id, node_id, feature, bin, left
    and right stats, counts, gain, valid) from (tree_id, node_id, feature,
    bin, s0..) histogram rows."""
    S = [f"s{c}" for c in range(channels)]
    cum = ", ".join(f"sum({s}) OVER (PARTITION BY tree_id, node_id, feature ORDER BY bin "
                    f"ROWS UNBOUNDED PRECEDING) AS l{c}" for c, s in enumerate(S))
    tot = ", ".join(f"sum({s}) OVER (PARTITION BY tree_id, node_id, feature) AS t{c}"
                    for c, s in enumerate(S))
    L = [f"l{c}" for c in range(channels)]
    T = [f"t{c}" for c in range(channels)]
    R = [f"(t{c} - l{c})" for c in range(channels)]
    if kind == "variance":
        nl, nt = "l0", "t0"
    else:
        nl, nt = "(" + " + ".join(L) + ")", "(" + " + ".join(T) + ")"
    nr = f"({nt} - {nl})"
    gain = (f"{I.impurity_sql(kind, T)} - ({nl} / {nt}) * {I.impurity_sql(kind, L)} "
            f"- ({nr} / {nt}) * {I.impurity_sql(kind, R)}")
    return f"""
    SELECT *, {gain} AS gain, {nl} AS left_count, {nr} AS right_count,
           ({nl} >= {float(min_inst)} AND {nr} >= {float(min_inst)}) AS valid
    FROM (SELECT *, {cum}, {tot} FROM ({hist}) h JOIN ({nb}) n USING (feature))
    WHERE bin < nb - 1"""


def forest_sql(base: str, features: list[str], *, num_trees: int, max_depth: int,
               max_bins: int = 32, subset_k: int | None = None, seed: int = 0,
               rate: float = 1.0, kind: str = "gini", num_classes: int = 2,
               erf: bool = False) -> dict:
    """Grows a forest in SQL with the engine's definitions (B2 sample, Q3
    thresholds, B3 bag weights, B4 subsets, T1-T5, T7-T9) for continuous
    features.  Returns named CTE texts: th, binned, nodes, and a WITH
    prefix ``with`` defining all of them."""
    F_ = len(features)
    k = F_ if subset_k is None else subset_k
    C = 3 if num_classes == 0 else num_classes
    ctes = []
    ctes.append(("base", base))
    ctes.append(("th", thresholds_sql(long_sql(sample_sql("SELECT * FROM base", max_bins, seed),
                                               features), max_bins - 1)))
    ctes.append(("nb", nbins_sql("SELECT * FROM th", F_)))
    ctes.append(("binned", binned_sql(long_sql("SELECT * FROM base", features), "SELECT * FROM th")))
    items, u = hash_u("bh", SEED_BAG + seed, ["t.tree_id", "b.rk"])
    wexpr = H.bag_weight_sql(u, num_trees, rate)
    ctes.append(("bag", f"SELECT rk, tree_id, w FROM (SELECT b.rk, b.label, t.tree_id, {items}, "
                        f"CAST({wexpr} AS DOUBLE) AS w FROM (SELECT rk, label FROM base) b, "
                        f"range({num_trees}) t(tree_id)) WHERE w > 0"))
    ctes.append(("lab", "SELECT rk, label FROM base"))
    if kind == "variance":
        chan = ["g.w", "g.w * l.label", "g.w * l.label * l.label"]
    else:
        chan = [f"CASE WHEN l.label = {c} THEN g.w ELSE 0.0 END" for c in range(C)]
    # level 0: every bagged row at the root
    ctes.append(("a0", "SELECT rk, tree_id, CAST(1 AS BIGINT) AS node_id FROM bag"))
    node_parts = []
    for lvl in range(max_depth + 1):
        a = f"a{lvl}"
        # B4 feature subsets of the frontier nodes
        sitems, su = hash_u("fh", SEED_SUBSET + seed, ["0", "n.tree_id", "n.node_id", "f.feature"])
        ctes.append((f"sub{lvl}", f"SELECT tree_id, node_id, feature FROM (SELECT n.tree_id, "
                                  f"n.node_id, f.feature, {sitems}, row_number() OVER (PARTITION BY "
                                  f"n.tree_id, n.node_id ORDER BY {su}, f.feature) AS r FROM "
                                  f"(SELECT DISTINCT tree_id, node_id FROM {a}) n, "
                                  f"range({F_}) f(feature)) WHERE r <= {k}"))
        sums = ", ".join(f"sum({c}) AS s{i}" for i, c in enumerate(chan))
        ctes.append((f"h{lvl}", f"SELECT a.tree_id, a.node_id, b.feature, b.bin, {sums} FROM {a} a "
                                f"JOIN bag g ON g.rk = a.rk AND g.tree_id = a.tree_id "
                                f"JOIN lab l ON l.rk = a.rk "
                                f"JOIN binned b ON b.rk = a.rk "
                                f"JOIN sub{lvl} s ON s.tree_id = a.tree_id AND s.node_id = a.node_id "
                                f"AND s.feature = b.feature GROUP BY ALL"))
        cand = candidates_sql(f"SELECT * FROM h{lvl}", "SELECT * FROM nb", kind, C)
        if erf:
            eitems, eu = hash_u("eh", SEED_ERF + seed, ["0", "tree_id", "node_id", "feature"])
            cand = (f"SELECT * EXCLUDE (rr, kk), kk AS bin FROM (SELECT *, row_number() OVER "
                    f"(PARTITION BY tree_id, node_id, feature ORDER BY bin DESC) AS rr FROM "
                    f"(SELECT * EXCLUDE (eh, eh_s0, eh_s1, eh_s2, eh_s3, eh_s4), "
                    f"CAST(floor({eu} * (nb - 1)) AS INTEGER) AS kk FROM "
                    f"(SELECT *, {eitems} FROM ({cand}))) WHERE bin <= kk) WHERE rr = 1")
        ctes.append((f"c{lvl}", cand))
        tsum = ", ".join(f"sum(s{c}) AS t{c}" for c in range(C))
        ctes.append((f"nt{lvl}", f"SELECT tree_id, node_id, arg_min(struct_pack({', '.join(f't{c}' for c in range(C))}), feature) AS tot "
                                 f"FROM (SELECT tree_id, node_id, feature, {tsum} FROM h{lvl} "
                                 f"GROUP BY ALL) GROUP BY ALL"))
        ctes.append((f"b{lvl}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, "
                                f"node_id ORDER BY gain DESC, feature, bin) AS rn FROM c{lvl} "
                                f"WHERE valid AND gain >= 0.0) WHERE rn = 1"))
        split = f"(b.gain IS NOT NULL AND b.gain > 0 AND {lvl} < {max_depth})"
        st = ", ".join(f"n.tot.t{c} AS c{c}" for c in range(C))
        ctes.append((f"n{lvl}", f"SELECT n.tree_id, n.node_id, NOT {split} AS is_leaf, "
                                f"CASE WHEN {split} THEN b.feature ELSE -1 END AS feature, "
                                f"CASE WHEN {split} THEN b.bin ELSE -1 END AS split_idx, "
                                f"CASE WHEN {split} THEN b.gain ELSE 0.0 END AS gain, {st} "
                                f"FROM nt{lvl} n LEFT JOIN b{lvl} b ON b.tree_id = n.tree_id "
                                f"AND b.node_id = n.node_id"))
        node_parts.append(f"SELECT * FROM n{lvl}")
        if lvl < max_depth:
            ctes.append((f"a{lvl + 1}", f"SELECT a.rk, a.tree_id, a.node_id * 2 + CASE WHEN "
                                        f"x.bin > n.split_idx THEN 1 ELSE 0 END AS node_id "
                                        f"FROM {a} a JOIN n{lvl} n ON n.tree_id = a.tree_id AND "
                                        f"n.node_id = a.node_id AND NOT n.is_leaf "
                                        f"JOIN binned x ON x.rk = a.rk AND x.feature = n.feature"))
    ctes.append(("nodes", " UNION ALL ".join(node_parts)))
    with_ = "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes)
    return {"with": with_, "channels": C}


def route_sql(binned: str, nodes: str, max_depth: int, keys: str = "rk") -> str:
    """M1: leaf reached by each row in each tree, level by level."""
    q = f"SELECT r.{keys}, t.tree_id, CAST(1 AS BIGINT) AS node_id FROM (SELECT DISTINCT {keys} FROM ({binned})) r, (SELECT DISTINCT tree_id FROM ({nodes})) t"
    for _ in range(max_depth):
        q = (f"SELECT p.{keys}, p.tree_id, CASE WHEN n.is_leaf THEN p.node_id ELSE p.node_id * 2 + "
             f"CASE WHEN x.bin > n.split_idx THEN 1 ELSE 0 END END AS node_id FROM ({q}) p "
             f"JOIN ({nodes}) n ON n.tree_id = p.tree_id AND n.node_id = p.node_id "
             f"LEFT JOIN ({binned}) x ON x.{keys} = p.{keys} AND x.feature = n.feature")
    return q


def grown_forest_sql(base0: str, base1: str, features: list[str], *, num_trees: int, max_depth: int,
                     max_bins: int = 32, subset_k: int | None = None, seed: int = 0, kind: str = "gini",
                     num_classes: int = 2) -> str:
    """Version 1 of a forest whose trees all grow: version 0 from ``base0``, then
    its leaves reopen with the histograms of both batches merged, and one more
    level is allowed.  Nodes made on the way keep the class weights of their
    parent's split and are split by the rows of ``base1`` alone.  Returns a WITH
    query text that ends in a CTE ``grown`` of the node table."""
    k, C, deep = (len(features) if subset_k is None else subset_k), num_classes, max_depth + 1
    first = forest_sql(base0, features, num_trees=num_trees, max_depth=max_depth, max_bins=max_bins,
                       subset_k=subset_k, seed=seed, kind=kind, num_classes=num_classes)
    lvl = "CAST(floor(log2({0}.node_id) + 1e-9) AS INTEGER)"
    ctes = [("base1", base1), ("binned1", binned_sql(long_sql("SELECT * FROM base1", features), "SELECT * FROM th"))]
    items, u = hash_u("bh", SEED_BAG + seed, ["t.tree_id", "b.rk"])
    ctes.append(("bag1", f"SELECT rk, tree_id, w, label FROM (SELECT b.rk, b.label, t.tree_id, {items}, CAST("
                         f"{H.bag_weight_sql(u, num_trees, 1.0)} AS DOUBLE) AS w FROM base1 b, range({num_trees}) t(tree_id)) "
                         f"WHERE w > 0"))
    # rows of both batches at the leaves of version 0
    ctes.append(("at0", " UNION ALL ".join(
        f"SELECT a.rk, a.tree_id, a.node_id, g.w, l.label FROM a{i} a JOIN n{i} n USING (tree_id, node_id) "
        f"JOIN bag g ON g.rk = a.rk AND g.tree_id = a.tree_id JOIN lab l ON l.rk = a.rk WHERE n.is_leaf"
        for i in range(max_depth + 1))))
    ctes.append(("leaf1", route_sql("SELECT * FROM binned1", "SELECT * FROM nodes", max_depth)))
    ctes.append(("at1_0", "SELECT r.rk, r.tree_id, r.node_id, g.w, g.label FROM leaf1 r JOIN bag1 g USING (rk, tree_id)"))
    sums = ", ".join(f"sum(CASE WHEN a.label = {c} THEN a.w ELSE 0.0 END) AS s{c}" for c in range(C))
    stats = ", ".join(f"c{c}" for c in range(C))

    def imp(x: list[str]) -> str:
        return I.impurity_sql(kind, x)

    ctes.append(("f0", "SELECT tree_id, node_id, false AS created, " + ", ".join(
        f"CAST(0.0 AS DOUBLE) AS c{c}" for c in range(C)) + " FROM nodes WHERE is_leaf"))
    for s in range(deep + 1):
        sitems, su = hash_u("fh", SEED_SUBSET + seed, ["0", "n.tree_id", "n.node_id", "f.feature"])
        ctes.append((f"us{s}", f"SELECT tree_id, node_id, feature FROM (SELECT n.tree_id, n.node_id, f.feature, {sitems}, "
                               f"row_number() OVER (PARTITION BY n.tree_id, n.node_id ORDER BY {su}, f.feature) AS r "
                               f"FROM f{s} n, range({len(features)}) f(feature)) WHERE r <= {k}"))
        rows = [f"SELECT a.*, b.feature, b.bin FROM at1_{s} a JOIN binned1 b USING (rk)"]
        if s == 0:
            rows.append("SELECT a.*, b.feature, b.bin FROM at0 a JOIN binned b USING (rk)")
        ctes.append((f"uh{s}", f"SELECT a.tree_id, a.node_id, a.feature, a.bin, {sums} FROM ({' UNION ALL '.join(rows)}) a "
                               f"JOIN us{s} u USING (tree_id, node_id, feature) GROUP BY ALL"))
        ctes.append((f"uc{s}", candidates_sql(f"SELECT * FROM uh{s}", "SELECT * FROM nb", kind, C)))
        tsum = ", ".join(f"sum(s{c}) AS t{c}" for c in range(C))
        ctes.append((f"ut{s}", f"SELECT tree_id, node_id, arg_min(struct_pack({', '.join(f't{c}' for c in range(C))}), feature) "
                               f"AS tot FROM (SELECT tree_id, node_id, feature, {tsum} FROM uh{s} GROUP BY ALL) GROUP BY ALL"))
        ctes.append((f"ub{s}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node_id ORDER BY gain DESC, "
                               f"feature, bin) AS rn FROM uc{s} WHERE valid AND gain >= 0.0) WHERE rn = 1"))
        # a made node is judged by its parent's class weights, a reopened one by the merged totals
        own = [f"CASE WHEN f.created THEN f.c{c} ELSE coalesce(t.tot.t{c}, 0.0) END" for c in range(C)]
        left, right = [f"b.l{c}" for c in range(C)], [f"(b.t{c} - b.l{c})" for c in range(C)]
        gain = (f"CASE WHEN f.created THEN {imp([f'f.c{c}' for c in range(C)])} - b.left_count / (b.left_count + b.right_count) * "
                f"{imp(left)} - b.right_count / (b.left_count + b.right_count) * {imp(right)} ELSE b.gain END")
        ctes.append((f"uv{s}", f"SELECT f.tree_id, f.node_id, {', '.join(f'{o} AS c{c}' for c, o in enumerate(own))}, b.feature AS bf, "
                               f"b.bin AS bb, {gain} AS g, {', '.join(f'b.l{c} AS l{c}, b.t{c} - b.l{c} AS r{c}' for c in range(C))}, "
                               f"{lvl.format('f')} AS lvl FROM f{s} f LEFT JOIN ut{s} t USING (tree_id, node_id) "
                               f"LEFT JOIN ub{s} b ON b.tree_id = f.tree_id AND b.node_id = f.node_id"))
        split = f"(g IS NOT NULL AND g > 0 AND lvl < {deep})"
        ctes.append((f"un{s}", f"SELECT tree_id, node_id, NOT {split} AS is_leaf, CASE WHEN {split} THEN bf ELSE -1 END AS feature, "
                               f"CASE WHEN {split} THEN bb ELSE -1 END AS split_idx, CASE WHEN {split} THEN g ELSE 0.0 END AS gain, "
                               f"{stats} FROM uv{s}"))
        kids = [f"SELECT tree_id, node_id * 2 + {side} AS node_id, true AS created, " + ", ".join(
            f"{x}{c} AS c{c}" for c in range(C)) + f" FROM uv{s} WHERE {split}" for side, x in ((0, "l"), (1, "r"))]
        ctes.append((f"f{s + 1}", " UNION ALL ".join(kids)))
        ctes.append((f"at1_{s + 1}", f"SELECT a.rk, a.tree_id, a.node_id * 2 + CASE WHEN x.bin > n.split_idx THEN 1 ELSE 0 END "
                                     f"AS node_id, a.w, a.label FROM at1_{s} a JOIN un{s} n USING (tree_id, node_id) "
                                     f"JOIN binned1 x ON x.rk = a.rk AND x.feature = n.feature WHERE NOT n.is_leaf"))
    ctes.append(("grown", f"SELECT tree_id, node_id, is_leaf, feature, split_idx, gain, {stats} FROM nodes WHERE NOT is_leaf UNION ALL "
                 + " UNION ALL ".join(f"SELECT * FROM un{s}" for s in range(deep + 1))))
    return first["with"] + ",\n" + ",\n".join(f"{n} AS ({q})" for n, q in ctes)
