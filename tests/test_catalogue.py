import os

import pytest

from gristmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(same, name):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["replay_review", "review_errors"])
def test_many_documents_are_asked_in_few_tasks(spark, name, tmp_path):
    import duckdb

    from gristmill.sources.shared import shared_base

    sf, out = str(tmp_path), str(tmp_path / "out")
    spark.range(1, 5001).selectExpr("id as doc_id", "concat('text ', id) as text").write.parquet(f"{sf}/documents.parquet")
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
        want = con.sql(catalogue.oracle_sql()[name])
        names, rows = want.columns, sorted(map(tuple, want.fetchall()))
    tables = lambda: set(os.listdir(shared_base(spark).removeprefix("file://")))
    before = tables()
    catalogue.queries()[name](spark, sf).write.parquet(out)
    assert sorted(tuple(r[c] for c in names) for r in spark.read.parquet(out).collect()) == rows and len(rows) == 5000
    written = [out] if name == "replay_review" else [os.path.join(shared_base(spark).removeprefix("file://"), t) for t in tables() - before]
    assert [sum(f.endswith(".parquet") for f in os.listdir(t)) <= 128 for t in written] == [True]
