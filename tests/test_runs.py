"""Hunks against difflib, as-of joins against loops, runs as multisets."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.operators import asof, hunks, runs

SECTION = "run_id string, body string"
FINDING = "run_id string, path string, start_line int, end_line int, title string"


def edit(r, lines):
    out = []
    for x in lines:
        out += [x] if r.random() > 0.25 else []
        out += [f"new {r.randint(0, 9)}"] * r.choice([0, 0, 0, 1, 3])
    return out


def diff_of(a, b, path="f.py", n=3):
    return "".join(difflib.unified_diff([x + "\n" for x in a], [x + "\n" for x in b], f"a/{path}", f"b/{path}", n=n))


def survivors(body):
    """Old to new line numbers by walking the diff."""
    out, old, new = {}, 1, 1
    for x in body.split("\n")[2:]:
        if x.startswith("@@"):
            a, b = x.split()[1:3]
            (o, on), (m, mn) = ((int(y[1:].split(",")[0]), int(y.split(",")[1]) if "," in y else 1) for y in (a, b))
            o, m = o + (on == 0), m + (mn == 0)
            while old < o:
                out[old] = new
                old, new = old + 1, new + 1
            assert (old, new) == (o, m)
        elif x.startswith(" "):
            out[old] = new
            old, new = old + 1, new + 1
        elif x.startswith("-"):
            old += 1
        elif x.startswith("+"):
            new += 1
    while old < 400:
        out[old] = new
        old, new = old + 1, new + 1
    return out


@pytest.mark.parametrize("hot_rows", [asof.HOT_ROWS, 10])
def test_findings_survive_as_difflib_says(spark, hot_rows):
    r = random.Random(4)
    bodies, findings, want = [], [], {}
    for k in range(60):
        a = [f"line {r.randint(0, 20)}" for _ in range(r.choice([0, 1, 2, 10, 60, 120]))]
        b = edit(r, a) if r.random() > 0.1 else []
        body = diff_of(a, b, f"f{k}.py", r.choice([0, 1, 3, 500]))
        bodies.append(("r", body))
        lines = survivors(body)
        for i in range(1, len(a) + 3):
            end = i + r.choice([0, 0, 1, 3, -i])
            findings.append(("r", f"f{k}.py", i, end, f"t{i}"))
            if not body:  # no change: everything stays
                want[f"f{k}.py", i] = (i, max(i, end))
            else:
                kept = [lines[x] for x in range(i, max(i, end) + 1) if x in lines]
                want[f"f{k}.py", i] = (kept[0], kept[-1]) if kept else (None, None)
    s, f = spark.createDataFrame(bodies, SECTION), spark.createDataFrame(findings, FINDING)
    got = {(x["path"], x["start_line"]): x for x in hunks.carry(f, s, hot_rows=hot_rows).collect()}
    assert len(got) == len(findings)
    for k, (start, end) in want.items():
        assert (got[k]["new_start"], got[k]["new_end"], got[k]["survives"]) == (start, end, start is not None), k


def test_renamed_deleted_and_untouched_files(spark):
    renamed = "diff --git a/x.py b/y.py\nsimilarity index 90%\nrename from x.py\nrename to y.py\n--- a/x.py\n+++ b/y.py\n@@ -1,2 +1,3 @@ def f():\n a\n+--- a/no.py\n b\n\\ No newline at end of file\n"
    moved = "diff --git a/m.py b/n.py\nsimilarity index 100%\nrename from m.py\nrename to n.py\n"
    gone = "diff --git a/z.py b/z.py\n--- a/z.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-a\n-b\n"
    new = "diff --git a/w.py b/w.py\n--- /dev/null\n+++ b/w.py\n@@ -0,0 +1 @@\n+a\n"
    s = spark.createDataFrame([("r", x) for x in (renamed, moved, gone, new)] + [("q", gone), ("r", ""), ("r", None)], SECTION)
    f = spark.createDataFrame([("r", p, i, i, "t") for p in ("x.py", "m.py", "z.py", "w.py", "no.py") for i in (0, 1, 2)] + [(None, "x.py", 1, 1, "t"), ("r", None, 1, 1, "t"), ("r", "x.py", None, None, "t")], FINDING)
    got = {(x["run_id"], x["path"], x["start_line"]): (x["new_path"], x["new_start"], x["survives"]) for x in hunks.carry(f, s).collect()}
    assert got["r", "x.py", 1] == ("y.py", 1, True) and got["r", "x.py", 2] == ("y.py", 3, True) and got["r", "m.py", 2] == ("n.py", 2, True)
    assert got["r", "z.py", 1] == (None, None, False) and got["r", "w.py", 1] == ("w.py", 1, True) and got["r", "no.py", 2] == ("no.py", 2, True)
    assert got["r", "x.py", 0] == (None, None, False)  # no line
    assert got[None, "x.py", 1] == ("x.py", 1, True) and got["r", None, 1] == (None, 1, True) and len(got) == 18
    h = s.select(F.explode(hunks.hunks_of(F.col("body"))).alias("h")).select("h.*").collect()
    assert sorted((x["old_start"], x["old_len"], x["new_start"], x["new_len"], x["context"], len(x["lines"])) for x in h) == [(0, 0, 1, 1, "", 1), (1, 2, 0, 0, "", 2), (1, 2, 0, 0, "", 2), (1, 2, 1, 3, "def f():", 3)]
    assert hunks.carry(f, s.where("false")).where("survives and new_start = start_line").count() == 17
    assert hunks.carry(f.where("false"), s).count() == 0


def test_stable_ids_follow_the_text(spark):
    a = [f"line {i}" for i in range(30)]
    b = ["new"] * 4 + a
    s = lambda x, n=500: spark.createDataFrame([("r", diff_of(x, [*x, "end"], n=n))], SECTION)
    f = lambda at: spark.createDataFrame([("r", "f.py", at, at, "t")], FINDING)
    one = lambda at, x, n=500: hunks.with_stable_ids(f(at), s(x, n)).first()["stable_id"]
    assert one(7, a) == one(11, b) != one(7, b)
    assert one(7, a, 0) == one(7, b, 0)  # not shown: by number


def loop_asof(left, right, strict):
    out = []
    for i, k, t in left:
        before = [(rt, tie, v) for rk, rt, tie, v in right if None not in (k, t, rk, rt) and rk == k and (rt < t if strict else rt <= t)]
        out.append((i, max(before)[2] if before else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_rows, ranges", [(10**6, 256), (20, 8), (1, 50)])
def test_asof_by_a_loop(spark, strict, hot_rows, ranges):
    r = random.Random(9)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    time = lambda: r.choice([None] + [r.randint(0, 60)] * 20)
    left = [(i, key(), time()) for i in range(400)]
    right = [(key(), time(), i, r.choice([None, i, i])) for i in range(150)]
    ours = spark.createDataFrame(left, "i int, k string, t int")
    theirs = spark.createDataFrame(right, "k string, at int, tie int, v int")
    got = asof.asof_join(ours, theirs, ["k"], "t", "at", {"v": "v", "tie": "found"}, ties=["tie"], strict=strict, hot_rows=hot_rows, ranges=ranges)
    rows = got.collect()
    assert got.columns == ["i", "k", "t", "v", "found"] and sorted((x["i"], x["v"]) for x in rows) == loop_asof(left, right, strict)
    # no key: everything is one
    alone = asof.asof_join(ours, theirs, [], "t", "at", {"v": "v"}, ties=["tie"], strict=strict, hot_rows=hot_rows, ranges=ranges).collect()
    assert sorted((x["i"], x["v"]) for x in alone) == loop_asof([(i, 0, t) for i, _, t in left], [(0, t, i, v) for _, t, i, v in right], strict)


def test_asof_of_empty_tables_and_clashes(spark):
    a = spark.createDataFrame([(1, "k", 5)], "i int, k string, t int")
    assert asof.asof_join(a, a.where("false"), ["k"], "t", "t", {"i": "j"}).first()["j"] is None
    assert asof.asof_join(a.where("false"), a, ["k"], "t", "t", {"i": "j"}).count() == 0
    with pytest.raises(ValueError, match="i"):
        asof.asof_join(a, a, ["k"], "t", "t", {"t": "i"})


def test_runs_are_multisets(spark):
    r = random.Random(6)
    rows = lambda n: [(r.choice(["p", "q", None]), r.choice("xyz"), "c") for _ in range(n)]
    x, y = rows(60), rows(45)
    b, a = (spark.createDataFrame(z, "path string, title string, category string") for z in (x, y))
    cx, cy = Counter(x), Counter(y)
    for f, want in ((runs.new_findings, cy - cx), (runs.fixed_findings, cx - cy), (runs.kept_findings, cx & cy)):
        assert Counter(map(tuple, f(b, a).collect())) == want
    got = {tuple(t)[:3]: tuple(t)[3:] for t in runs.changes(b, a).collect()}
    assert got == {k: (cx[k], cy[k], (cy - cx)[k], (cx - cy)[k], (cx & cy)[k]) for k in cx | cy}
    assert runs.totals(runs.changes(b, a.where("false")), []).first().asDict() == {"n_new": 0, "n_fixed": 60, "n_kept": 0}
