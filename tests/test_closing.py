"""Sessions closed by an event or a timeout: a loop, tables cut into blocks, and a stream with late events."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gristmill.streaming.closing import closed_sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, ts timestamp, event_id long, kind string"


def plain(events, gap):
    out, last = [], {}
    for k, ts, i, kind in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: (e[0], e[1], e[2] or 0, e[3] == "end")):
        s = last.get(k)
        if s is None or s[4] or ts - s[2] >= timedelta(seconds=gap):
            s = last[k] = [k, ts, ts, 0, False]
            out.append(s)
        s[2:] = [ts, s[3] + 1, kind == "end"]
    return Counter(tuple(s) for s in out)


def rows(n, seed=5, span=20_000):
    r = random.Random(seed)
    time = lambda: START + timedelta(seconds=r.choice([r.randint(0, span), r.randint(0, span // 100) * 100]))
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), time() if r.random() > 0.03 else None, i if i % 40 else None, r.choice(["view"] * 9 + ["end", None])) for i in range(n)]


def given(df):
    utc = lambda t: t.astimezone(timezone.utc)
    return Counter((x["k"], utc(x["session_start"]), utc(x["last_event"]), x["n_events"], x["closed"]) for x in df.collect())


@pytest.mark.parametrize("block", [86400, 700, 1])
def test_a_table_equals_a_loop(spark, block):
    events = rows(700)
    df = spark.createDataFrame(events, SCHEMA).repartition(7)
    for gap in (60, 300):
        assert given(closed_sessions(df, ["k"], F.col("kind") == "end", gap_seconds=gap, block_seconds=block)) == plain(events, gap)
    assert closed_sessions(df.where("false"), ["k"], F.col("kind") == "end").count() == 0


def test_a_stream_equals_a_table(spark, tmp_path):
    """Files out of order by less than the watermark allows, then one event that is too late and one that ends it all."""
    events = [e for e in rows(500) if e[1] is not None]
    ordered = sorted(events, key=lambda e: e[1])
    r = random.Random(2)
    batches = [ordered[i : i + 60] for i in range(0, len(ordered), 60)]
    for i in range(len(batches) - 1):  # some of each come one batch later
        late = [e for e in batches[i] if r.random() < 0.3]
        batches[i] = [e for e in batches[i] if e not in late]
        batches[i + 1] = late + batches[i + 1]
    end = START + timedelta(days=3)
    batches += [[("end", end, 1, "view")], [("a", START + timedelta(seconds=5), 10_000, "end"), ("end", end + timedelta(days=3), 2, "view")], [("end", end + timedelta(days=6), 3, "view")]]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, batch in enumerate(batches):
        lines = [json.dumps({"k": k, "ts": t.isoformat(), "event_id": e, "kind": kind}) for k, t, e, kind in batch]
        (folder / f"{i:03}.json").write_text("\n".join(lines))
        stamp = 1_700_000_000 + i
        import os

        os.utime(folder / f"{i:03}.json", (stamp, stamp))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    sessions = closed_sessions(stream, ["k"], F.col("kind") == "end", gap_seconds=300, late="2 hours")
    q = sessions.writeStream.format("memory").queryName("own_closed").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert given(spark.table("own_closed").where("k <> 'end'")) == plain(events, 300)
