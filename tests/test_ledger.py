"""Reviews that fail and are resumed: what is asked how often, what is kept, what a job that dies leaves."""

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ledger as lg
from gristmill.sources.providers import ProviderError, Response

ONE = '[{"severity":"high","category":"bug","title":"seen %s","message":"m","suggestion":"","confidence":0.5,"path":"f.py","startLine":1,"endLine":2,"tags":[]}]'


class Recorder:
    """Notes each call in a folder; refuses, answers junk or breaks down where a prompt says so."""

    name = "recorder"

    def __init__(self, folder, bad=(), junk=(), breaks=()):
        self.folder, self.bad, self.junk, self.breaks = folder, bad, junk, breaks

    def review(self, request):
        last = request.user_prompt.strip().split()[-1]
        if last in self.breaks:
            raise RuntimeError("the task dies")
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(last)
        if last in self.bad:
            raise ProviderError(f"no {last}")
        return Response("junk" if last in self.junk else ONE % last, 7)


def requests(spark, words):
    rows = [(f"r{i}", 0, "system", f"about {w}" if w is not None else None, 100) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "run_id string, chunk_idx int, system_prompt string, user_prompt string, max_tokens int")


def calls(folder):
    return Counter(open(os.path.join(folder, x)).read() for x in os.listdir(folder))


@pytest.fixture
def place(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), "file://" + str(tmp_path / "ledger")


def test_what_failed_is_asked_again_and_nothing_else(spark, place):
    folder, path = place
    book = lg.Ledger(spark, path)
    words = ["a", "b", "c", "d", "a", "a"]
    rounds = [(("b", "c", "d"), ()), (("c",), ("d", "junk")), (("c",), ()), (("c",), ())]
    want = [{"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 1, "b": 2, "c": 2, "d": 2}, None, None]
    for (bad, junk), n in zip(rounds, want):
        out = {r["run_id"]: r for r in lg.resume(requests(spark, words), lambda _: Recorder(folder, bad, junk), "p:m", book).collect()}
        assert len(out) == 6
        if n:
            assert {k: v for k, v in calls(folder).items() if k in "abcd"} == {k: v for k, v in n.items() if k in "abcd"}
    got = calls(folder)
    assert (got["a"], got["b"], got["c"], got["d"]) == (1, 2, 3, 3)  # c has had its three attempts
    assert [out[f"r{i}"]["attempts"] for i in range(6)] == [1, 2, 3, 3, 1, 1] and [out[f"r{i}"]["answered"] for i in range(6)] == [True, True, False, True, True, True]
    assert out["r2"]["error"] == "ProviderError: no c" and out["r2"]["content"] is None and out["r3"]["error"] is None and out["r3"]["content"] == ONE % "d"
    # another model, and another limit, are other requests
    lg.resume(requests(spark, ["a"]), lambda _: Recorder(folder), "p:other", book)
    lg.resume(requests(spark, ["a"]).withColumn("max_tokens", F.lit(5)), lambda _: Recorder(folder), "p:m", book)
    assert calls(folder)["a"] == 3


def test_a_job_that_dies_keeps_its_earlier_waves(spark, place):
    folder, path = place
    book, words, waves = lg.Ledger(spark, path), [f"w{i}" for i in range(24)], 6
    keyed = requests(spark, words).select("user_prompt", F.pmod(F.xxhash64(lg.request_key("p:m")), F.lit(waves)).alias("w")).collect()
    turn = {r["user_prompt"].split()[-1]: r["w"] for r in keyed}
    fatal = max(words, key=turn.get)
    assert turn[fatal] > 0
    with pytest.raises(Exception, match="the task dies"):
        lg.resume(requests(spark, words), lambda _: Recorder(folder, breaks=(fatal,)), "p:m", book, waves=waves)
    safe = [w for w in words if turn[w] < turn[fatal]]
    before = calls(folder)
    out = lg.resume(requests(spark, words), lambda _: Recorder(folder), "p:m", book, waves=waves)
    assert out.where("answered").count() == 24
    after = calls(folder)
    assert safe and all(before[w] == after[w] == 1 for w in safe) and after[fatal] == 1


def test_awkward_requests(spark, place):
    folder, path = place
    book = lg.Ledger(spark, path)
    assert lg.resume(requests(spark, ["x"]).where("false"), lambda _: Recorder(folder), "p:m", book).count() == 0 and book.attempts().count() == 0
    none = requests(spark, ["x", None]).where("user_prompt is null")

    class Blank:
        name = "blank"

        def review(self, request):
            return Response("[]")

    assert [tuple(r) for r in lg.resume(none, lambda _: Blank(), "p:m", book).select("run_id", "answered", "attempts", "content").collect()] == [("r1", True, 1, "[]")]
    # a provider that can't be made is an error of each request
    out = lg.resume(requests(spark, ["y"]), refuse, "p:m", book).first()
    assert (out["answered"], out["attempts"], out["error"]) == (False, 1, "ProviderError: no key")


def refuse(label):
    raise ProviderError("no key")


def test_best_effort_gives_what_there_is(spark, place):
    folder, path = place
    diffs = [("r", k, f"f{k}.py", f"diff --git a/f{k}.py b/f{k}.py\n--- a/f{k}.py\n+++ b/f{k}.py\n@@ -1 +1 @@\n-a\n+b w{k}\n") for k in range(4)]
    parts = spark.createDataFrame(diffs, "run_id string, section_ord int, path string, body string")

    class Half:
        name = "half"

        def __init__(self, bad):
            self.bad = bad

        def review(self, request):
            k = next(k for k in range(4) if f"+b w{k}" in request.user_prompt)
            if k in self.bad:
                raise ProviderError(f"no {k}")
            return Response(ONE % k)

    book = lg.Ledger(spark, path)
    for bad in ((1, 3), (3,)):
        found, failed = lg.best_effort(parts, lambda _: Half(bad), "p:m", book, chunk_bytes=100)
        assert {r["title"] for r in found.findings.collect()} == {f"seen {k}" for k in range(4) if k not in bad}
        assert [r["error"] for r in failed.orderBy("chunk_idx").collect()] == [f"ProviderError: no {k}" for k in bad]
    assert failed.first()["attempts"] == 2


def test_texts_are_not_written_again_each_round(spark, tmp_path):
    from gristmill.sources.shared import shared_base

    def written():
        base = shared_base(spark).removeprefix("file://")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names)

    texts = "concat('about ', id, ' ', sha2(cast(id as string), 512), sha2(cast(id + 100 as string), 512), sha2(cast(-id as string), 512))"
    each = spark.range(3000).selectExpr("cast(id as string) as run_id", "0 as chunk_idx", "'system' as system_prompt", f"repeat({texts}, 8) as user_prompt", "100 as max_tokens")
    each.write.parquet(path := str(tmp_path / "requests"))
    each, book = spark.read.parquet(path), lg.Ledger(spark, "file://" + str(tmp_path / "ledger"))
    before = written()
    for now in (1, 2):
        out = lg.resume(each, lambda _, now=now: Never(now), "p:m", book)
    assert {tuple(r) for r in out.select("answered", "attempts", "error").distinct().collect()} == {(False, 2, "ProviderError: not in round 2")} and out.count() == 3000
    assert written() - before < 1_000_000  # keys and attempts only


class Never:
    name = "never"

    def __init__(self, now):
        self.now = now

    def review(self, request):
        raise ProviderError(f"not in round {self.now}")


def test_few_tasks_for_many_requests(spark, tmp_path):
    from gristmill.operators import review as rv

    assert [rv.tasks_for(n, 6) for n in (0, 1, 16, 17, 160, 20_000, 600_000, 3_000_000)] == [1, 1, 1, 2, 10, 128, 147, 733]
    assert rv.tasks_for(20_000, 100) == 400 and rv.tasks_for(100, 100) == 7
    each = spark.range(6000).selectExpr("cast(id as string) as run_id", "0 as chunk_idx", "'s' as system_prompt", "cast(id as string) as user_prompt", "9 as max_tokens")
    assert rv.ask(each, lambda _: Never(1), ["m"]).rdd.getNumPartitions() == 128
    lg.resume(each, lambda _: Never(1), "p:m", lg.Ledger(spark, "file://" + str(tmp_path / "ledger")))
    assert len([f for f in os.listdir(tmp_path / "ledger") if f.endswith(".parquet")]) <= 128


def test_in_turn():
    from concurrent.futures import ThreadPoolExecutor

    from gristmill.operators.review import in_turn

    begun = []

    def work(i):
        begun.append(i)
        if i == 5:
            raise RuntimeError("five")
        return {"i": i}

    with ThreadPoolExecutor(4) as workers:
        assert in_turn(lambda i: {"i": i}, 1000, workers, 4) == [{"i": i} for i in range(1000)] and in_turn(work, 0, workers, 4) == []
        with pytest.raises(RuntimeError, match="five"):
            in_turn(work, 100_000, workers, 4)
    assert len(begun) < 100_000
