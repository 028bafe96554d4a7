"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator, and what only an operator's own interface shows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontam, lang_id, license_scan, line_dedup, ngram_join, quality, sharding, url_filter, warc
from gristmill.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n string, w string, row string, keys string, score string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, None, None, None), (2, "", "en", "s"), (3, "one two", "en", None), (4, LONG, "fr", "s"), (4, LONG, "fr", "s"), (5, LONG + " end", "fr", "t"), (None, "one two", None, None), (6, "ONE two\n\n \n", "en", "s"), (7, "!!! 12", "en", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(docs, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    n = 30_000 - 4
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, n, 4), (4, n, 4), (5, n + 1, 4), (None, 1, 3), (6, 1, 3), (7, 1, 7)], key=str)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_by_brute_force(spark):
    random.seed(5)
    base = [[random.choice("abcdefghij") + str(random.randint(0, 9)) for _ in range(60)] for _ in range(3)]
    texts = [[w if random.random() > random.choice([0.01, 0.03, 0.06]) else "z" + str(random.randint(0, 99)) for w in random.choice(base)] for _ in range(120)]
    sets = [{tuple(t[i : i + 5]) for i in range(56)} for t in texts]
    comp = list(range(120))
    for _ in range(120):
        for i in range(120):
            for j in range(120):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        break
    while True:
        old = comp[:]
        for i in range(120):
            for j in range(120):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = min(comp[i], comp[j])
        if comp == old:
            break
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp)) and len(set(comp)) < 120


def test_line_dedup(spark, docs, empty):
    d = spark.createDataFrame([(1, "A long line here\nx"), (2, " a LONG line here \ny"), (3, "a long line here"), (3, "a long line here"), (None, "a long line here\nnull one"), (4, None)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark).insert(d)
    text = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert text(index.dedup(d)) == sorted([(1, "A long line here\nx"), (2, "y"), (3, ""), (3, ""), (None, "null one"), (4, "")], key=str)
    # deleting the first holder gives its line to the next one; inserting it again takes it back
    rest = d.where("doc_id is null or doc_id <> 1")
    index.delete(d.where("doc_id = 1"))
    assert dict(text(index.dedup(rest)))[2] == " a LONG line here \ny"
    index.insert(d.where("doc_id = 1"))
    assert dict(text(index.dedup(d)))[2] == "y"
    assert line_dedup.dedup_lines(docs).count() == len(ROWS) and line_dedup.dedup_lines(empty).count() == 0


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(20_000)]
    h = line_dedup.CuckooFilter.hashes(keys)
    f = line_dedup.CuckooFilter.build(h[:15_000])
    assert f.contains(h[:15_000]).all() and f.contains(h[15_000:]).mean() < 0.01
    f.delete(h[:5_000])
    assert f.contains(h[5_000:15_000]).all() and f.contains(h[:5_000]).mean() < 0.01


def test_bpe_round_trip(docs, empty):
    path, pattern = tokenizer()
    rows = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert len(rows) == len(ROWS) and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows)
    assert bpe.encode_digests(empty, path, pattern).count() == 0


def test_language_id(docs, empty):
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify_documents(docs).collect()}
    assert got[1] == got[2] == got[7] == "und" and got[4] in ("en", "fr")
    assert lang_id.identify_documents(empty).count() == 0
    assert {r["lang_pred"] for r in lang_id.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ppm_costs_by_hand():
    """Method C with escapes, for one language and contexts of one byte."""
    data = np.frombuffer(b"\nabab", np.uint8)
    counts = {}
    for n in (1, 2):
        k, c = np.unique(lang_id.grams(data, n)[1:], return_counts=True)
        counts[n] = k, c[:, None].astype(float)
    m = lang_id.PPM.train(counts, ["x"], 1)
    # a once after a line break, b twice after a, never z after b; order 0 has a and b twice each
    first, b_after_a, z_after_b = np.log2(2 / 1), np.log2(3 / 2), np.log2(2 / 1) + np.log2(6 / 2) + 8
    assert m.lengths([b"ab"])[0, 0] == pytest.approx(first + b_after_a)
    assert m.lengths([b"abz"])[0, 0] == pytest.approx(first + b_after_a + z_after_b)
    assert m.lengths([b"abz", b"ab"])[1, 0] == pytest.approx(first + b_after_a)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, empty, limit):
    bench = spark.createDataFrame([(1, LONG), (2, "Two"), (3, None), (None, "one"), (4, "w7 w8 w9 w10 w11")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in decontam.decontaminate(docs, bench, limit).collect()}
    assert got[1, 0] == (0, []) and got[3, 2] == (1, ["2"]) and got[4, 30_000] == (30_000, ["1", "4"]) and got[5, 30_001] == (30_000, ["1", "4"])
    assert decontam.decontaminate(empty, bench, limit).count() == 0
    assert decontam.decontaminate(docs, bench.where("false"), limit).where("contaminated").count() == 0


def test_license_scan(spark, docs, empty):
    text = "x " * 500 + license_scan.TEMPLATES["mit-grant"].replace("merge", "join").upper() + " y" * 500
    got = license_scan.scan(spark.createDataFrame([(1, text), (1, text), (2, "all RIGHTS, reserved"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "mit-grant"), (1, "mit-grant"), (2, "all-rights-reserved")]
    assert all(r["matched"] >= 0.75 * r["total"] and r["word_from"] < r["word_to"] for r in got)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(empty).count() == 0 and license_scan.scan(docs, {}).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 4).collect()
    sizes = [sum(r["shard"] == s for r in rows) for s in range(4)]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1 and sharding.shard_documents(empty).count() == 0


def test_hilbert_curve_is_a_walk(spark):
    """All cells once, each next to the one before."""
    side = spark.range(512).select(*[((F.col("id") / F.lit(8**k)).cast("long") % 8).alias(f"d{k}") for k in range(3)])
    rows = side.withColumn("h", sharding.hilbert_index([F.col(f"d{k}") for k in range(3)], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(rows, rows[1:]))


def test_urls(spark):
    u = [(1, None, "h"), (2, "no scheme", "h"), (3, "http://WWW.Example.com/en/70?x", "h"), (4, "http://a.com/en/", "h"), (5, "http://com/en/x", "h"), (6, "http://notcom/en/", "h"), (6, "http://notcom/en/", "h"), (7, "x://b.example.net/de/81#f", "h"), (8, "x://", "h")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(u, "page_id long, url string, host string"), url_filter.RULES).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/70", "example.com/en/7", "allow"), 4: ("a.com", "/en/", "com/en/", "block"), 5: ("com", "/en/x", "com/en/", "block"), 6: ("notcom", "/en/", None, "allow"), 7: ("b.example.net", "/de/81", "example.net/de/8", "block"), 8: ("", "", None, "allow")}
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "k", "v")], "page_id long, url string, keys string, best string")
    assert url_filter.filter_urls(pages, []).collect()[0].asDict() == {"page_id": 1, "url": "http://a.com/x", "keys": "k", "best": "v", "host": "a.com", "path": "/x", "rule": None, "verdict": "allow"}
    assert url_filter.filter_urls(pages, [("block", "com", "/x"), ("block", "com", "/x")]).first()["verdict"] == "block"
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [("block", "com", "/x"), ("allow", "com", "/x")])


@pytest.mark.parametrize("max_bytes", [8 << 20, 60])
def test_urls_by_brute_force(spark, max_bytes):
    """A long list in one part and in many."""
    random.seed(2)
    hosts = [f"h{i % 9}.d{i % 31}.{t}" for i in range(120) for t in ("com", "org")] + ["com", "d3.org", "x" * 3000 + ".com"]
    rules = list({(h, p): (random.choice(["block", "allow"]), h, p) for h in random.sample(hosts, 90) for p in random.sample(["", "/a", "/a/b", "/c/"], 2)}.values())
    urls = [f"http://{random.choice(['', 'w.'])}{random.choice(hosts)}{random.choice(['', '/', '/a', '/a/b/c', '/c/d?e'])}" for _ in range(300)]

    def want(url):
        rest = url.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0]
        path = rest[len(host) :].split("?")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    rows = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, max_bytes=max_bytes).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == {i: want(u) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"), url_filter.hashed(F.col("id").cast("string")).alias("k")).select("key", "k.h", "k.g")
    listed = keys.where("key < '2'").select("h", "g")
    c = url_filter.build_cascade(listed, keys.select("h", "g"), 3000, bits_per_key=2, hashes=1)
    rows = keys.collect()
    h, g = (np.array([r[x] for r in rows], np.int64).view(np.uint64) for x in ("h", "g"))
    assert len(c.levels) > 2 and c.contains(h, g).tolist() == [r["key"] < "2" for r in rows]


@pytest.mark.parametrize("limit", [warc.BROADCAST_BYTES, 0])
def test_warc(spark, limit):
    big = "é" * 200
    p = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nX: y", big), (4, "", None), (5, "u", "short"), (6, "about:blank", "short"), (None, "http://ü/%0D a", big), (7, "u", "x" * 300_000), (5, "u", "short"), (5, "u", "short")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in p], "page_id long, url string, html string, digest string, size string")
    index = warc.write_warc(frame.repartition(3), broadcast_bytes=limit)
    rows = warc.read_warc(index, range_bytes=500, with_payload=True).collect()
    assert len(rows) == len(p) and {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows} == {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)}
    want = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in p}
    assert all(r["payload_digest"] == want[r["page_id"]] for r in rows)
    assert sorted(map(str, ((r["page_id"], r["url"]) for r in rows))) == sorted(map(str, ((i, u) for i, u, _ in p)))
    one = warc.read_warc(index.where("page_id = 7"), with_payload=True).collect()
    assert len(one) == 1 and len(one[0]["payload"]) == 300_000
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_archives_are_warc(spark, tmp_path):
    """What the standard asks of every record, read without our index."""
    import gzip
    import re

    big = "x" * 150
    rows = [(1, "http://a/", big), (2, None, big), (None, "http://é/", "short"), (1, "http://a/", big)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), "file://" + str(tmp_path), date="2024-01-02T03:04:05Z")
    data = b"".join(gzip.open(f).read() for f in tmp_path.iterdir())
    ids, at = [], 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and fields["WARC-Date"] == "2024-01-02T03:04:05Z" and fields["WARC-Type"] in ("response", "revisit")
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"]) and ":" in fields["WARC-Target-URI"]
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To-Target-URI"] == "http://a/" and fields["WARC-Refers-To-Date"]
        ids.append(fields["WARC-Record-ID"])
        at += len(head) + 4 + int(fields["Content-Length"]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert at == len(data) and len(set(ids)) == len(rows)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1), (4, 1), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality.quality_filter(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(r["base_failed"] for r in rows if r["doc_id"] not in (4, 5)) and all(r["kept"] for r in rows if r["doc_id"] == 4)
    assert quality.quality_filter(empty, labels).count() == 0 and quality.quality_filter(docs, labels.where("false")).count() == len(ROWS)


def test_binomial_bound(spark):
    from math import comb

    for k, n, p in [(0, 10, 0.1), (3, 200, 0.05), (1, 5000, 0.004)]:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("v")).first()["v"]
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_reject_few_good_documents(spark):
    """Noisy documents in a clean stratum of 4000 labelled ones: a cutoff is found, and it spares the good."""
    rows = [(i, "en", " ".join(f"word{i}x{j}" + ("#" if i % 10 == 0 else "") for j in range(25))) for i in range(4400)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    out = quality.quality_filter(d, labels)
    assert out.where("kept and doc_id % 10 = 0").count() == 0 and out.where("not kept and doc_id % 10 <> 0").count() == 0


@pytest.mark.parametrize("strata", [quality.MAX_BROADCAST_STRATA, 0])
def test_cutoffs_act_on_the_tables(spark, strata, monkeypatch):
    """What the comparison with SQL sees is the method's work: rows that only a cutoff rejects."""
    monkeypatch.setattr(quality, "MAX_BROADCAST_STRATA", strata)
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    docs = read("documents")
    out = quality.quality_filter(docs.withColumn("n_lines", F.lit("x")).withColumn("__level", F.lit(1)).drop("__level"), read("labels"))
    assert set(docs.columns) - {"text"} < set(out.columns)
    rows = out.select("doc_id", "base_failed", "kept", "rejected_by").collect()
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 20
    good = {r["doc_id"] for r in read("labels").where("quality = 1").collect()}
    assert sum(bool(r["rejected_by"]) for r in rows if r["doc_id"] in good) <= 0.05 * len(good)


def test_labels_count_once(spark):
    """Many labels of few documents bound nothing; a document with both labels is not good."""
    text = lambda i: " ".join(f"word{i}x{j}" + ("#" if i % 2 == 0 else "") for j in range(25))
    d = spark.createDataFrame([(i, "en", text(i)) for i in range(20)], "doc_id long, lang string, text string")
    many = spark.range(400).select((F.col("id") % 20).alias("doc_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(1).alias("quality"))
    assert quality.quality_filter(d, many).where("not kept").count() == 0
    both = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.quality_filter(d, both).where("not kept").count() == 0
