"""Awkward rows through each stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = ["score", "held_out", "lang_pred", "n_lines", "n_dropped", "row", "w", "sig", "keys", "doc", "n_hit"]
    return docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in clash])


@pytest.fixture(scope="module")
def awkward(spark, base):
    """Null and repeated ids, null, empty, wordless and long texts, with the columns of base."""
    like = base.limit(1)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = [(None, f"leaking {bench}"), (7_000_001, f"the leak {bench}"), (7_000_001, "nothing but a clean text of this very id"), (None, "a clean text that has no id at all"), (7_000_002, None), (7_000_003, ""), (7_000_004, "12 ! 3"), (7_000_005, "the and of " * 40_000), (None, None)]
    rows = spark.createDataFrame(texts, "i long, t string").withColumn("i", F.col("i").cast("long"))
    return rows.crossJoin(like).select(*[F.col("i").alias(c) if c == "doc_id" else F.col("t").alias(c) if c == "text" else F.col(c) for c in base.columns])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_rows(spark, base, awkward, k):
    name, stage = cp.STAGES[k]
    docs = base.unionByName(awkward)
    out = stage(spark, docs, SF)
    if k < 4:
        assert out.columns == docs.columns
        # what an operator names like a column of ours is ours
        assert out.where("doc_id < 7000000 and score <> concat('score', doc_id) or w <> concat('w', doc_id) and doc_id < 7000000").count() == 0
    rows = out.collect()
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 7_000_000}
    assert stage(spark, docs.where("false"), SF).count() == 0
    texts = [(r["doc_id"], r["text"]) for r in rows] if k < 4 else []
    if k == 0:
        assert all(t and t.strip() for _, t in texts) and not any(i == 7_000_004 for i, _ in texts)
    if k == 3:
        assert not any(t and t.startswith(("leaking", "the leak")) for _, t in texts)
        assert (7_000_001, "nothing but a clean text of this very id") in texts and (None, "a clean text that has no id at all") in texts and (7_000_002, None) in texts
    if k in (2, 4):
        assert sum(r["doc_id"] is None for r in rows) == 3


def test_run_leaves_no_scratch(spark):
    from gristmill.llm.common import shared_base

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_base(spark))
    names = lambda: {s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    before = names()
    assert cp.run(spark, SF).count() > 0
    assert all(n.startswith("stage-") for n in names() - before)
