"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ``order`` bytes. In a context seen T times with d
different next bytes, a byte seen c times costs -log2(c / (T + d)); one not seen costs the escape
-log2(d / (T + d)) and is then coded in the context one byte shorter, down to a flat 1/256. Contexts
never seen cost nothing to leave. The statistics are frozen after training, so each string of
order + 1 bytes has one exact cost per language. These are resolved once: a node's row holds its
cost in every language, a context's row what escaping from it costs, and a text's code length is the
sum over its bytes of the longest node found plus the escapes above it. Numpy does that for a batch
of documents at once. ASCII capitals are lower-cased.

Training is on a bounded sample: of each language about ``sample_docs`` documents and ``sample_bytes`` bytes at most, chosen by a hash of
doc_id and text among those of at most ``text_bytes``; rows equal in both (null ids are equal) teach once. All strings of their whole texts count, so that the code
lengths are those of the trees. The model's size follows the sample, not the corpus. Everything else sees all rows and whole texts.

Score: the posterior 2**-length of the best language over the sum (even priors). ``und`` with score 0
is given to a null text, one without a letter, and to all texts if nothing could be learned. Ties go
to the first language by name. Documents without lang or text teach nothing. Languages are told apart as they are written and go by
numbers: any name will do. Texts are scored whole in blocks of about ``BLOCK`` bytes or one text; an empty table
gives an empty result. Other columns pass through, but for lang_pred, score and held_out, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

LETTER = re.compile(r"[^\W\d_]")
#: Bytes of text that are scored at once.
BLOCK = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEED = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """At i, the n bytes that end at i as a number (with length, so that strings of zeros differ)."""
    out = np.zeros(len(data), np.uint64)
    for k in range(n):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out | np.uint64(n << 56)


class Table:
    """Open addressing over uint64 keys, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), (keys * SEED >> self.shift).astype(np.int64)
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = np.flatnonzero(self.rows[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.rows[at[won]], self.keys[at[won]] = rest[won], keys[rest[won]]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, at = rest[left], (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = (keys * SEED >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.rows[at] >= 0))
        at = at[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.rows[at[hit]]
            on = ~hit & (self.rows[at] >= 0)
            open_, at = open_[on], at[on]
        return out


@dataclass
class PPM:
    """cost[n]: a row per known string of n bytes, a column per language; leave[n]: the same for escapes from contexts of n bytes."""

    languages: list[str]
    order: int
    nodes: dict[int, Table]
    cost: dict[int, np.ndarray]
    contexts: dict[int, Table]
    leave: dict[int, np.ndarray]
    flat: np.ndarray

    @classmethod
    def train(cls, counts: dict[int, tuple[np.ndarray, np.ndarray]], languages: list[str], order: int) -> PPM:
        """counts[n]: distinct strings of n bytes (as grams) and a matrix of their counts by language, for n up to order + 1."""
        nodes, cost, contexts, leave = {}, {}, {}, {}
        flat = None
        for n in range(1, order + 2):
            keys, c = counts.get(n, (np.zeros(0, np.uint64), np.zeros((0, len(languages)))))
            # a context's key is its string without the last byte, one shorter
            ctx = ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64((n - 1) << 56)
            own, at = np.unique(ctx, return_inverse=True)
            total, kinds = np.zeros((len(own), len(languages))), np.zeros((len(own), len(languages)))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(c / (total + kinds)[at]) if len(keys) else c
            if n == 1:
                flat = escape[0] + 8.0 if len(own) else np.full(len(languages), 8.0)
                below = flat[None, :]
            else:
                low = ((keys & np.uint64((1 << (8 * (n - 1))) - 1))) | np.uint64((n - 1) << 56)
                below = cost[n - 1][nodes[n - 1].find(low)]  # the end of a counted string was counted too
            nodes[n], contexts[n - 1] = Table(keys), Table(own)
            cost[n] = np.where(c > 0, known, escape[at] + below) if len(keys) else np.zeros((0, len(languages)))
            leave[n - 1] = escape
        return cls(languages, order, nodes, cost, contexts, leave, flat)

    def lookup(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Cost of the last byte of each string of n bytes, by language."""
        out = np.zeros((len(keys), len(self.languages)))
        rest = np.arange(len(keys))
        while n and len(rest):
            row = self.nodes[n].find(keys)
            hit = row >= 0
            out[rest[hit]] += self.cost[n][row[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if n > 1 and len(rest):
                ctx = ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64((n - 1) << 56)
                at = self.contexts[n - 1].find(ctx)
                out[rest[at >= 0]] += self.leave[n - 1][at[at >= 0]]
                keys = (keys & np.uint64((1 << (8 * (n - 1))) - 1)) | np.uint64((n - 1) << 56)
            n -= 1
        out[rest] += self.flat
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (not empty), by language."""
        n = self.order + 1
        # each text starts after a line break, so that it does not depend on its neighbours
        data = LOWER[np.frombuffer(b"\n" * self.order + (b"\n" * self.order).join(texts), np.uint8)]
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + self.order) - sizes
        row = self.nodes[n].find(keys := grams(data, n))
        miss = np.flatnonzero(row < 0)
        each = self.cost[n][row] if len(self.cost[n]) else np.zeros((len(data), len(self.languages)))
        if len(miss):
            again, back = np.unique(keys[miss], return_inverse=True)
            each[miss] = self.lookup(again, n)[back]
        edges = np.stack([starts, starts + sizes], 1).ravel()
        padded = np.vstack([each, np.zeros((1, each.shape[1]))])
        return np.add.reduceat(padded, edges, axis=0)[::2]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        ask = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        block: list[tuple[int, bytes]] = []
        held = 0

        def score() -> None:
            for (i, _), bits in zip(block, self.lengths([b for _, b in block])):
                best = int(np.argmin(bits))
                out[i] = self.languages[best], float(1 / np.sum(np.exp2(np.maximum(bits[best] - bits, -1000))))
            block.clear()

        for i in ask:
            block.append((i, texts[i].encode()))
            held += len(block[-1][1])
            if held >= BLOCK:
                score()
                held = 0
        if block:
            score()
        return out


def train(examples: DataFrame, order: int = 3, sample_docs: int = 1500, sample_bytes: int = 32 << 20, text_bytes: int = 1 << 20) -> PPM:
    """A model from (doc_id, text, lang); see the module for the bounds."""
    rows = examples.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("b"))
    fits = F.col("b") <= text_bytes
    sizes = rows.groupBy("lang").agg(F.count_if(fits).alias("n"), F.sum(F.when(fits, F.col("b"))).alias("b")).collect()  # a row for each language
    if not sizes:
        return PPM([], order, {}, {}, {}, {}, np.zeros(0))
    languages = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(sample_docs / max(1, r["n"]), sample_bytes / max(1, r["b"] or 0))))])
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(fits & (unit < F.element_at(share, F.col("lang")))).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.setdefault(lang, []).append(text.as_py().encode())
        for lang, own in texts.items():
            data = LOWER[np.frombuffer((b"\n" * order).join([b"", *own]), np.uint8)]
            # the line breaks before each text are its first contexts, not bytes of it
            steps = np.zeros(len(data) + 1, np.int8)
            ends = np.cumsum([len(t) + order for t in own])
            np.add.at(steps, ends - [len(t) for t in own], 1)
            np.add.at(steps, ends, -1)
            inside = np.cumsum(steps[:-1], dtype=np.int8) > 0
            for n in range(1, order + 2):
                keys, c = np.unique(grams(data, n)[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(keys), x, np.int32)) for x in (number[lang], n)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "gram", "c"])

    per_gram = sample.select("lang", "text").mapInArrow(count, "lang int, n int, gram long, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    per_gram = materialize(per_gram, "ppm-counts")
    counts = {}
    for n in range(1, order + 2):
        own = per_gram.where(F.col("n") == n).select("gram", "lang", "c").toArrow()  # strings of the sample's texts
        keys, at = np.unique(own.column("gram").to_numpy().view(np.uint64), return_inverse=True)
        c = np.zeros((len(keys), len(languages)))
        c[at, own.column("lang").to_numpy()] = own.column("c").to_numpy()
        counts[n] = keys, c
    return PPM.train(counts, languages, order)


def identify(documents: DataFrame, model: PPM) -> DataFrame:
    """documents with lang_pred and score, from the text alone."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # as large as the strings of the sample

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    # or a filter on the result would run it a second time, in workers of its own
    predict = predict.asNondeterministic()
    columns = [c for c in documents.columns if c not in ("lang_pred", "score")]
    return documents.select(*columns, predict("text").alias("__p")).select(*columns, "__p.lang_pred", "__p.score")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_documents(documents: DataFrame) -> DataFrame:
    """documents with held_out, lang_pred and score, learned from the documents that are not held out."""
    model = train(documents.where(~held_out()))
    return identify(documents.drop("held_out"), model).withColumn("held_out", held_out())
