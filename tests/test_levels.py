"""Cubes with sketches, moving spans, sessions of tables and streams, and a hot file."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gristmill.operators import consensus, rollups
from gristmill.streaming.sessions import sessions

START = datetime(2024, 1, 1)


def test_cube_estimates_keep_to_their_bounds(spark):
    rows = spark.range(60_000).select(F.expr("concat('r', id % 3)").alias("run_id"), F.expr("if(id % 5 = 0, null, id % 5)").alias("kind"), F.expr("pmod(xxhash64(id), 20000)").alias("path"), F.expr("cast(pmod(xxhash64(id, 1), 1000) as int)").alias("line"))
    base = rollups.base_rollup(rows, ["run_id", "kind"], "path", "line")
    # two days' tables joined are one
    halves = [rollups.base_rollup(rows.where(c), ["run_id", "kind"], "path", "line") for c in ("path < 9000", "path >= 9000")]
    got = {tuple(r)[:3]: r for r in rollups.cube_of(base, ["run_id", "kind"]).collect()}
    joined = {tuple(r)[:3]: r for r in rollups.cube_of(halves[0].unionByName(halves[1]), ["run_id", "kind"]).collect()}
    want = {tuple(r)[:3]: r for r in rows.cube("run_id", "kind").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.countDistinct("path").alias("d"), F.percentile("line", 0.5).alias("m"), F.min("line").alias("lo")).collect()}
    assert got.keys() == joined.keys() == want.keys() and len(want) == 24
    for k, w in want.items():
        for g in (got[k], joined[k]):
            assert g["n"] == w["n"] and g["least"] == w["lo"]
            # four standard deviations of 1.04 / sqrt(4096), and the rank error of a sketch of 200 numbers
            assert abs(g["n_distinct"] - w["d"]) <= 0.066 * w["d"] and abs(g["q_0_5"] - w["m"]) <= 0.04 * 1000


def test_cube_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", "p", None)], "k string, path string, line int")
    got = {(r["k"], r["level"]): (r["n"], r["least"], r["n_distinct"], r["q_0_5"]) for r in rollups.cube_of(rollups.base_rollup(rows, ["k"], "path", "line"), ["k"]).collect()}
    assert got == {("a", 0): (2, None, 1, None), (None, 1): (2, None, 1, None)}
    assert rollups.cube_of(rollups.base_rollup(rows.where("false"), ["k"], "path", "line"), ["k"]).where("n > 0").count() == 0


def test_recent_counts_by_a_loop(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), START + timedelta(hours=r.choice([0, 1, 24, 167, 168, 169, r.randint(0, 500)]))) for _ in range(300)] + [("a", None)]
    got = {(x["k"], x["t"]): x["n_recent"] for x in rollups.recent_counts(spark.createDataFrame(rows, "k string, t timestamp_ntz"), ["k"], "t").collect()}
    assert got == {(k, t): sum(k == j and u is not None and t - timedelta(days=7) <= u <= t for j, u in rows) for k, t in rows if t}


def plain_sessions(events, gap):
    out = Counter()
    for k in {k for k, t in events if k is not None and t is not None}:
        start = last = None
        n = 0
        for t in sorted(t for j, t in events if j == k and t is not None):
            if last is not None and t - last < gap:
                n, last = n + 1, t
                continue
            if last is not None:
                out[k, start, last + gap, n] += 1
            start, last, n = t, t, 1
        out[k, start, last + gap, n] += 1
    return out


def test_sessions_of_a_table_and_a_stream(spark, tmp_path):
    r = random.Random(5)
    gap = timedelta(minutes=30)
    parts = [[(r.choice(["u", "v", None]), START + timedelta(hours=12 * i, minutes=r.randint(0, 400))) for _ in range(40)] for i in range(3)]
    # one batch of events that are late but not too late, and at the end of one that is
    parts[1] += [("u", START + timedelta(minutes=380)), ("v", None)]
    frame = lambda x: spark.createDataFrame(x, "k string, ts timestamp").coalesce(1)
    every = [e for p in parts for e in p]
    batch = Counter(map(tuple, sessions(frame(every), ["k"]).collect()))
    assert batch == plain_sessions(every, gap)
    too_late = ("u", START - timedelta(days=9))
    src = str(tmp_path / "in")
    for i, part in enumerate([*parts, [too_late, ("end", START + timedelta(days=30))], [("end", START + timedelta(days=60))]]):
        frame(part).write.mode("append").parquet(f"{src}/{i}")
        (tmp_path / "in" / f"{i}").touch()
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = sessions(stream, ["k"], late="20 hours").writeStream.format("memory").queryName("own_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = Counter(map(tuple, spark.table("own_sessions").where("k <> 'end'").collect()))
    assert got == batch  # the event behind the watermark is left out, all others are there


@pytest.mark.parametrize("length", ["id % 7", "100 + id % 20000"])
def test_a_hot_file_costs_in_proportion(spark, length):
    rows = spark.range(100_000).select(F.lit("r").alias("run_id"), F.expr("cast(id % 3 as int)").alias("model_idx"), F.expr("cast(id as int)").alias("ord"), F.lit("hot.go").alias("path"), F.expr("concat('title ', id % 11)").alias("title"), F.lit("bug").alias("category"), F.expr("cast(id % 16 as int)").alias("start_line"), F.expr(f"cast(id % 16 + {length} as int)").alias("end_line"))
    began = time.time()
    merged = consensus.merge(rows)
    got = merged.groupBy("model_idx").agg(F.count_if("is_consensus").alias("n")).collect()
    assert sum(r["n"] for r in got) > 60_000 and time.time() - began < 90
