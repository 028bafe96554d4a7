"""PPM of order 3 written plainly, against the query's predictions and scores."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import lang_id
from gristmill.llm import queries as q

SF = "/root/testdata/sf0.001"
ORDER = 3


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


class Tree:
    """Next bytes after each context of up to ORDER bytes."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            t = b"\n" * ORDER + t
            for i in range(ORDER, len(t)):
                for n in range(ORDER + 1):
                    self.after[t[i - n : i]][t[i]] += 1

    def bits(self, context, byte):
        cost = 0.0
        for n in range(ORDER, -1, -1):
            seen = self.after.get(context[ORDER - n :])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                return cost - math.log2(seen[byte] / (total + kinds))
            cost -= math.log2(kinds / (total + kinds))
        return cost + 8

    def length(self, text, memo):
        t = b"\n" * ORDER + text
        out = 0.0
        for i in range(ORDER, len(t)):
            key = t[i - ORDER : i + 1]
            if key not in memo:
                memo[key] = self.bits(key[:-1], key[-1])
            out += memo[key]
        return out


def expected(rows):
    """rows: (doc_id, text, lang) to doc_id: (held_out, language, score)."""
    out_of = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
    texts = defaultdict(list)
    for i, text, lang in rows:
        if not out_of(i) and text is not None and lang is not None:
            texts[lang].append(lowered(text))
    trees = {lang: (Tree(t), {}) for lang, t in sorted(texts.items())}
    want = []
    for i, text, _ in rows:
        if not trees or not text or not re.search(r"[^\W\d_]", text):
            want.append((i, out_of(i), "und", 0.0))
            continue
        bits = {lang: tree.length(lowered(text), memo) for lang, (tree, memo) in trees.items()}
        best = min(bits, key=bits.get)
        want.append((i, out_of(i), best, 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values())))
    return sorted(want, key=str)


def compare(found, want):
    found = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in found), key=str)
    assert len(found) == len(want)
    for got, w in zip(sorted(found, key=lambda r: str(r[:2])), sorted(want, key=lambda r: str(r[:2]))):
        assert got[:3] == w[:3] and got[3] == pytest.approx(w[3], abs=1e-6)


def test_query_equals_plain_ppm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = expected([(r["doc_id"], r["text"], r["lang"]) for r in docs])
    assert len({w[2] for w in want}) >= 4
    compare(q.op4_language_id(spark, SF).collect(), want)


def test_awkward_rows_equal_plain_ppm(spark):
    rows = [(i, f"{a} {i % 3} {a[::-1]}" * (1 + i % 4), lang) for i, (a, lang) in enumerate([("the cat is", "en"), ("le chat est", "fr"), ("Die KATZE ist", "de")] * 12)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 3", "fr"), (103, "ça été", None), (None, "the cat", "en"), (3, "le chat est", "fr"), (104, "the " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit("x").alias("score"), F.lit("y").alias("held_out"), F.lit("z").alias("lang_pred"))
    compare(lang_id.identify_documents(df).collect(), expected(rows))


def test_any_language_name(spark):
    names = ["EN", "en", "n", "gram", "a`b", "c.d", "", "lang", "h"]
    rows = [(i, f"{chr(97 + i % 9) * 3} {chr(98 + i % 9)}x {i // 9 % 2}", names[i % 9]) for i in range(90)]
    compare(lang_id.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect(), expected(rows))


def test_null_ids_are_sampled_like_others(spark):
    rows = [(None, f"word{i} the cat", "en") for i in range(4000)] + [(7, "le chat", "fr")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df, sample_docs=100)
    # strings of four bytes of about 100 texts of 4000, and of the one French text or none
    starts = sum(len(np.unique(lang_id.grams(np.frombuffer(t.encode(), np.uint8), 4))) for _, t, _ in rows[:1])
    assert 0 < len(model.cost[4]) < 200 * starts and model.languages == ["en", "fr"]
    whole = lang_id.train(df)
    assert len(whole.cost[4]) > len(model.cost[4])


def test_long_texts_teach_nothing_and_are_scored(spark):
    rows = [(i, "the cat is on the mat", "en") for i in range(5)] + [(i, "le chat est sur le tapis", "fr") for i in range(5, 10)] + [(11, "le chat " * 30_000, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df, text_bytes=1000)
    assert not model.cost[1][:, 2].any() or (model.cost[1][:, 2] > 7).all()
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(df, model).collect()}
    assert got[11] == "fr" and got[0] == "en"
