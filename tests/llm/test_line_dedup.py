"""Batches in and out of an index of many shards, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import line_dedup as ld


def plain(docs, least=10):
    """docs: (doc_id, text) to sorted (doc_id, text that stays)."""
    order = lambda i: (i is None, i or 0)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = {}
    for i, text in docs:
        for x in (text or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    first = {k: min(ids, key=order) for k, ids in held.items() if len(k) >= least and len(ids) > 1}
    return sorted(((i, "\n".join(x for x in (t or "").split("\n") if first.get(key(x), i) == i)) for i, t in docs), key=str)


@pytest.mark.parametrize("shard_lines", [ld.SHARD_LINES, 3])
def test_batches_in_and_out(spark, shard_lines, monkeypatch):
    monkeypatch.setattr(ld, "MOST_FOLDERS", 3)
    rng = random.Random(4)
    line = lambda: rng.choice(["", "short", f"a line number {rng.randint(0, 40)}", f" A LINE number {rng.randint(0, 40)}\t", "the line that nearly all of them hold"])
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("k").alias("keys"), F.lit("i").alias("id"), F.lit(1).alias("n_lines"))
    make = lambda ids: [(i, "\n".join(line() for _ in range(rng.randint(1, 6))) if i is None or i % 9 else None) for i in ids]
    index, now = ld.LineIndex(spark, shard_lines=shard_lines), []

    def agrees():
        out = index.dedup(frame(now))
        assert out.columns == ["doc_id", "text", "keys", "id", "n_lines", "n_dropped"]
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == plain(now)

    for ids in ([20, 21, 22, 20, None], [*range(5, 19)], [], [*range(40, 75)], [None, 3]):
        batch = make(ids)
        before = {f for f in index.filters.values()} if index.shards else set()
        index.insert(frame(batch))
        now += batch
        if not ids:
            assert before == set(index.filters.values())
    agrees()
    for gone in ([20, 5], [None, 99]):
        index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = [r for r in now if r[0] not in gone]
        agrees()
    if shard_lines == 3:
        assert index.shards > 8 and len(index.filters) > 8


def test_only_touched_shards_change(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = ld.LineIndex(spark, shard_lines=4).insert(frame([(i, f"line of document {i}\nline of document {i + 1}") for i in range(40)]))
    held, counts = dict(index.filters), dict(index.counts.folders)
    index.insert(frame([(100, "line of document 7")])).delete(frame([(100, "")]).select("doc_id"))
    changed = [s for s in held if held[s] != index.filters[s]]
    assert len(changed) <= 1 and len(index.counts.folders) > 1
    old = next(iter(counts))
    assert len(index.counts.folders[old]) == len(counts[old]) - 1


def test_rows_without_ids_are_spread_by_text(spark):
    rng = random.Random(8)
    texts = [f"a line of many {i % 7}\nown line number {i}\nA line of null ids" for i in range(300)]
    docs = [(i if i < 20 else None, t) for i, t in enumerate(texts)] + [(None, None), (None, ""), (None, texts[40]), (None, texts[3]), (ld.NO_ID, "a line of null ids\nown line number 3")]
    rng.shuffle(docs)
    out = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    plainly = plain([(None if i == ld.NO_ID else i, t) for i, t in docs])
    assert sorted(((None if r["doc_id"] == ld.NO_ID else r["doc_id"], r["text"]) for r in out.collect()), key=str) == plainly
    # what only rows without ids hold is one document's and stays
    alone = ld.dedup_lines(spark.createDataFrame([(None, "the same long line")] * 3, "doc_id long, text string"))
    assert [r["text"] for r in alone.collect()] == ["the same long line"] * 3


def test_keys_are_left_out_either_way(spark):
    from gristmill.llm.common import materialize, without

    rows = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(40)], "k long, v long")
    keys = materialize(spark.createDataFrame([(1,), (4,), (9,), (None,)], "k long"), "keys")
    few, many = (sorted(map(tuple, without(rows, keys, "k", most).collect()), key=str) for most in (100, 0))
    assert few == many == sorted((tuple(r) for r in rows.collect() if r["k"] not in (1, 4)), key=str)
