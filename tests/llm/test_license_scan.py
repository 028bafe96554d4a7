"""Retrieval by bands against sketching every window, the bound on misses, groups of templates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import license_scan as ls


def damaged(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randint(0, 99)}" for w in words]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 80))]
        name = rng.choice(sorted(ls.TEMPLATES))
        own += damaged(rng, ls.TEMPLATES[name].split(), rng.choice([0, 0, 0.01, 0.03, 0.1])) * rng.choice([1, 1, 2])
        rows.append((i, " ".join(own + [f"w{rng.randint(0, 400)}" for _ in range(30)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_retrieval_equals_all_sketches(spark, texts):
    base, probes = ls.sketched(spark, ls.TEMPLATES)
    lengths = sorted(r["k"] for r in base.select("k").distinct().collect())
    found = ls.retrieved(ls.probed(texts, lengths, probes, base), base)
    got = {tuple(r) for r in found.select("doc_id", "license", "win").collect()}
    # every window of every text, all its bands, joined with the templates' bands
    every = texts.select("doc_id", ls.words(F.col("text")).alias("w")).crossJoin(base.select("license", "k", "step", "width", "sketch"))
    every = every.withColumn("hs", F.transform(ls.shingles_of(F.col("w"), F.col("k")), ls.hash_of_shingle)).where(F.size("hs") > 0)
    every = every.withColumn("win", F.explode(F.expr("sequence(0, (size(hs) - 1) div step)"))).withColumn("own", F.expr("slice(hs, int(win * step) + 1, width)"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(ls.BANDS - 1)), lambda b: F.array(*[F.array_min(F.transform("own", lambda h: ls.value(b, r, h))) for r in range(ls.ROWS)]))
    met = every.withColumn("ours", bands).where("arrays_overlap(transform(ours, (x, i) -> struct(i, x)), transform(sketch, (x, i) -> struct(i, x)))")
    want = {(r["doc_id"], r["license"], r["win"]) for r in met.select("doc_id", "license", "win").collect()}
    assert got == want and len(want) > 100


def test_bound_holds(spark):
    """Windows that hold just enough of a template share a band at least as often as promised."""
    for m in (1, 2, 3, 7, 8, 16, 40, 163, 1600, 10**6):
        assert ls.collision_bound(m) >= 1 - 5e-7
    m, bands, trials = 40, 3, 600
    need, _, width = ls.geometry(m)
    rng = random.Random(1)
    rows = []
    for i in range(trials):
        t = [rng.getrandbits(63) for _ in range(m)]
        rows.append((i, t, t[:need] + [rng.getrandbits(63) for _ in range(width - need)]))
    sets = spark.createDataFrame(rows, "i int, t array<long>, w array<long>")
    sketch = lambda c: F.array(*[F.struct(F.lit(b), *[F.array_min(F.transform(c, lambda h: ls.value(F.lit(b), r, h))) for r in range(ls.ROWS)]) for b in range(bands)])
    share = sets.where(F.arrays_overlap(sketch("t"), sketch("w"))).count() / trials
    bound = ls.collision_bound(m, bands)
    assert share >= bound - 3 * math.sqrt(bound * (1 - bound) / trials)


def test_groups_of_templates_give_the_same(texts):
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(ls.scan(texts))
    assert want and rows(ls.scan(texts, group_bytes=600)) == want
    more = ls.TEMPLATES | {"again": ls.TEMPLATES["mit-line"], "none": " . "}
    assert {r[1] for r in rows(ls.scan(texts, more))} - {r[1] for r in want} == {"again"}
