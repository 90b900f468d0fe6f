import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from grove.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, none string, cost string, kinds string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "e", "e", "e") for r in rows], SCHEMA).repartition(parts)


def kind_of(initial, fault):
    return (initial if initial in ("s", "u", "a") else "x") + {"": "-", "truncated": "t"}.get(fault, "d")


def all_edits(kinds, longest):
    """The best (cost, audit) of every string of edits, tried one by one."""
    found = None
    for n in range(len(kinds), longest + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(kinds):
                continue
            cost, at, roles = 0, 0, ""
            for e in edits:
                if e == "I":
                    cost, roles = cost + 5, roles + "?"
                    continue
                initial, fault = kinds[at]
                at += 1
                if e == "D":
                    cost += 2
                elif fault == "d":
                    break
                else:
                    cost += (e == "R") + 5 * (fault == "t")
                    roles += initial if e == "K" else "?"
            else:
                body = roles[1:] if roles[:1] == "s" else roles  # a new turn takes the role that is due
                if all(c in ("?", "ua"[i % 2]) for i, c in enumerate(body)) and len(body) % 2 == 0 and (body or not roles):
                    found = min(found or (1 << 30, ""), (cost, "".join(edits)))
    return found


def test_cells_against_all_edits():
    rng = np.random.default_rng(1)
    options = [i + f for i in "suax" for f in "-td"]
    for n, tries in ((0, 1), (1, 12), (2, 60), (3, 60), (4, 25)):
        for t in range(tries):
            kinds = [options[t]] if n == 1 else [options[i] for i in rng.integers(0, len(options), n)]
            assert R.best(R.parse([(k, 1) for k in kinds])) == all_edits(kinds, min(n + 4, 7)), kinds


def full_cyk(kinds):
    """All spans and all splits under S -> P | Y P | empty, P -> Q | Q P, Q -> U A, with
    insertions and deletions as symbols of their own."""
    n = len(kinds)
    add = lambda x, y: (x[0] + y[0], x[1] + y[1])
    cells = {}

    def put(cell, symbol, entry):
        if symbol not in cell or entry < cell[symbol]:
            cell[symbol] = entry
            return True
        return False

    rules = [("E", "E", "E"), ("Q", "U", "A"), ("P", "Q", "P"), ("S", "Y", "P")] + [
        r for x in "UAYQP" for r in ((x, "E", x), (x, x, "E"))]
    for length in range(n + 1):
        for i in range(n - length + 1):
            cell = cells[i, i + length] = {}
            if length == 0:
                cell |= {"E": (0, ""), "U": (5, "I"), "A": (5, "I")}
            if length == 1:
                initial, fault = kinds[i]
                put(cell, "E", (2, "D"))
                if fault != "d":
                    late = 5 * (fault == "t")
                    for symbol, s in (("U", "u"), ("A", "a"), ("Y", "s")):
                        if initial == s:
                            put(cell, symbol, (late, "K"))
                        if s != "s":
                            put(cell, symbol, (late + 1, "R"))
            more = True
            while more:  # rules with an empty part may use this very cell
                more = False
                for k in range(i, i + length + 1):
                    for x, y, z in rules:
                        left, right = cells.get((i, k), {}), cells.get((k, i + length), {})
                        if y in left and z in right:
                            more |= put(cell, x, add(left[y], right[z]))
                if "Q" in cell:
                    more |= put(cell, "P", cell["Q"])
                if "P" in cell:
                    more |= put(cell, "S", cell["P"])
                if "E" in cell:
                    more |= put(cell, "S", cell["E"])
    return cells[0, n]["S"]


def test_cells_against_all_splits():
    rng = np.random.default_rng(2)
    options = [i + f for i in "sua" for f in "---td"]
    for n in [*range(10), 14, 18]:
        for _ in range(6):
            kinds = [options[i] for i in rng.integers(0, len(options), n)]
            assert R.best(R.parse([(k, 1) for k in kinds])) == full_cyk(kinds), kinds


def by_rows(kinds):
    """The automaton row by row, for long conversations."""
    close = lambda e: R.joined(tuple(e[q] if p == 0 else None for p in range(4) for q in range(4)), R.inserted())[:4]
    now = close([(0, ""), None, None, None])
    for k in kinds:
        cell = R.row_cell(k)
        now = tuple(R.least((now[p][0] + cell[4 * p + q][0], now[p][1] + cell[4 * p + q][1]) for p in range(4)
                            if now[p] and cell[4 * p + q]) for q in range(4))
    return min(x for x in (now[0], now[3]) if x)


def brute(rows, ids):
    convs = {c: [] for c in ids}
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = []
    for c, rs in convs.items():
        rs.sort()
        dates = [t for d, t, _, _ in rs if d]
        seen, faults = set(), []
        for _, _, role, text in rs:
            said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[2][:1] for r in rs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        kinds = [kind_of(i, f) for i, f in zip(initials, faults)]
        cost, audit = full_cyk(kinds) if len(kinds) < 14 else by_rows(kinds)
        it, lines, due = iter(rs), [], 0
        for e in audit:
            _, _, role, text = next(it) if e != "I" else (0, 0, "", "")
            if e == "D":
                continue
            if e == "K":
                due = 0 if role[0] in "sa" else 1
            else:
                role, due = ("user", 1) if due == 0 else ("assistant", 0)
            lines.append(f"{role}:{text}")
        out.append((c, max(dates) - min(dates) + 1 - len(set(dates)) if dates else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, ids):
    d = R.repair_digests(frame(spark, rows), spark.createDataFrame([(c,) for c in ids], "conv_id long"))
    return sorted((tuple(r) for r in d.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                              "repaired_sha256").collect()), key=str)


def chats(rng, convs=60):
    rows = []
    roles = ["user", "assistant", "system", "user", "assistant", "assistant", None, "", "usher", "tool"]
    texts = ["Yes.", "no", "What? ", "", " \n", None, "a.\x85", "İ!\t\x0b", "stop", "x.y"]
    for c in range(convs):
        turn = int(rng.integers(-3, 3))
        for _ in range(int(rng.integers(0, 11))):
            good = rng.random() < 0.6
            rows.append((c, None if rng.random() < 0.05 else turn, roles[int(rng.integers(0, 2 if good else 10))],
                         f"{rng.integers(99)}." if good else texts[int(rng.integers(0, 10))]))
            turn += int(rng.integers(0, 3))
    rows += [(None, 1, "user", "hi."), (None, 2, "assistant", "ho."), (None, None, "system", "be good.")]
    rows += [(500, 1, "user", "long " * 60_000 + "."), (500, 2, "assistant", "y.")]
    rows += [(501, 7, "user", "again.")] * 40 + [(502, None, None, None)] * 3
    return rows


@pytest.mark.parametrize("piece", [4096, 3])
def test_against_brute_force(spark, monkeypatch, piece):
    """Also with pieces of three rows, so that conversations meet over many."""
    monkeypatch.setattr(R, "PIECE", piece)
    rows = chats(np.random.default_rng(5))
    ids = list(range(61)) + [None, 500, 501, 502]
    assert got(spark, rows, ids) == brute(rows, ids)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 100)
    rng = np.random.default_rng(6)
    rows = [(1, int(t), ["user", "assistant", "assistant"][t % 3], ["ok.", f"{t}.", f"{t}"][int(rng.integers(0, 3))]) for t in range(3000)]
    rows += [(c, t, ["user", "assistant"][t], "z.") for c in range(2, 40) for t in (0, 1)]
    ids = range(1, 40)
    assert got(spark, rows, ids) == brute(rows, ids)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)] + [(None, 1, None, None), (3, None, None, None)]
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            want += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in R.damaged(frame(spark, rows)).collect())


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "q?"), (1, 2, "user", ""), (1, 3, "assistant", "a.")]
    out = R.repaired_turns(R.repair_pieces(frame(spark, rows))).orderBy("part", "turn").collect()
    assert [(r.role, r.text) for r in out] == [("user", "q?"), ("assistant", "a.")]


def test_empty(spark):
    assert got(spark, [], []) == []
    assert got(spark, [], [4]) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
