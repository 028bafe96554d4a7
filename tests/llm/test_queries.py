"""op queries against their SQL, or a brute-force version."""

import hashlib
import json
import os

import pytest

from gristmill.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(same, name):
    same(q.queries()[name], q.oracle_sql()[name])


def tiktoken_encoder():
    import base64

    import public_tokenizers as P
    import tiktoken

    path, pattern = q.tokenizer()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    assert P.PATTERN == pattern
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def digests(encoder, text):
    ids = encoder.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op6_equals_the_library(spark):
    e = tiktoken_encoder()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op6_bpe(spark, SF).collect()}
    assert got == {i: digests(e, t) for i, t in texts.items()}


def test_op3_law(spark):
    rows = q.op3_hilbert_shards(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import zlib

    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 1
    assert sorted(sizes) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1 and len(rows) == len(texts)


def test_op4_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in q.op4_language_id(spark, SF).collect() if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(lang[r["doc_id"]] == r["lang_pred"] for r in rows)
    assert len(rows) > 20 and right / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline_by_brute_force(spark):
    """Stage 1 by a plain PPM, 2 to 4 in SQL, 5 by the library."""
    import corpus_pipeline as cp
    import duckdb
    from test_lang_id import expected

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    known = {i for i, _, lang, score in expected(rows) if lang != "und" and score >= cp.LEAST_SCORE}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t, _ in rows if i in known])
    con.sql(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    lines = q.SQL_LINES.replace("sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256", "coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text")
    con.sql(f"create table d2 as select doc_id, text from ({lines}) where regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
    con.sql("drop table documents")
    con.sql("create table documents as select * from d2")
    keep = con.sql(f"select doc_id from ({q.SQL_NGRAM}) where doc_id = component_id").fetchall()
    con.execute("delete from documents where doc_id not in (select unnest(?))", [[r[0] for r in keep]])
    clean = con.sql(f"select d.doc_id, d.text from documents d join ({q.sql_decontam()}) x on x.doc_id = d.doc_id where not contaminated").fetchall()
    e = tiktoken_encoder()
    want = {i: digests(e, t) for i, t in clean}
    got = {r["doc_id"]: tuple(r)[1:] for r in cp.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_registered():
    assert sorted(q.queries()) == sorted([f"op{n}_{x}" for n, x in enumerate("license_scan ngram_jaccard hilbert_shards language_id decontamination bpe url_filter warc quality_rules line_dedup lexical_search lm_scoring periodic_runs".split(), 1)] + ["pipeline"])
    assert json.dumps(sorted(q.oracle_sql())) and os.path.exists(q.tokenizer()[0])
