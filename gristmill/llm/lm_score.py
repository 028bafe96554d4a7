"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

1. *Chunks*: tasks cut the texts into chunks of about ``CHUNK_BYTES`` (or one longer text), number the words of each and write them as a table: texts are split once.
   A text is start, start, its words and one end.
2. *Filter*: each chunk sends its distinct n-grams of up to ``order`` words, with their counts in its training texts, to the shards of their hashes. A shard adds them up. It keeps the
   exact counts of single tokens, and a Bloom filter for longer n-grams: one whose count reaches the j-th entry of ``LEVELS`` (about 1.4 times as
   much each) is inserted as the events 1 to j. An n-gram's count is read by asking for event 1, 2, ... until one is missing, and stands for the middle of its
   level. Filters never miss an event; one that was not inserted is seen with a chance of about 0.5 %.
3. *Score*: p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), and with a context h, p(w | h) = (c(h w) + m p(w | shorter h)) / (c(h) + m). A count is
   never taken for larger than those of its parts, so every p is at most 1.

The filter follows the corpus. While its size, bounded by what chunks have counted, is at most ``BROADCAST_BYTES``, all shards are broadcast and each worker asks its own
copy. Beyond, a shard answers the chunks that have sent it n-grams, and their answers are joined with them. Both ways ask the same filters, so scores are the same.
A shard takes the n-grams of ``SHARD_BYTES`` of text; a word that every text has comes once from each chunk.

Words are runs of anything but ASCII white space, A-Z lower-cased, told apart by 64 bits of hash (longer n-grams within a shard by 40). A null or empty text is just an end. Without training texts
all counts are 0 and every probability is 1. Rows are scored each, also where ids repeat or are null (for what is held out, a null id counts as an empty one). Texts are scored
whole. An empty table gives an empty result. Columns other than those asked for are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize
from gristmill.llm.ngram_join import BACK, PLACE, STEP, U, mix
from gristmill.llm.tokens import BLANK, blocks, hashed_words

#: The weight m of the shorter context.
WEIGHT = 4.0
#: Least counts of the levels, up to 2 ** 62.
LEVELS = np.unique(np.ceil(2.0 ** (np.arange(125) / 2)).astype(np.int64))
#: What a level stands for; none is 0.
VALUES = np.r_[0.0, LEVELS / 2 + np.r_[LEVELS[1:] - 1, LEVELS[-1]] / 2]
BITS_PER_EVENT, HASHES = 12, 5
SHARD_BYTES, LEAST_SHARDS, CHUNK_BYTES = 8 << 20, 8, 4 << 20
BROADCAST_BYTES = 64 << 20
#: What of the hash of a longer n-gram tells it apart in its shard.
UPPER = ~U(0xFFFFFF)
START, END = mix(np.array([1, 2], np.uint64) * STEP)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, all first bytes first, compressed: sorted and small ones take little."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


@dataclass(frozen=True)
class Chunk:
    """Texts whose words are numbered: vocab has the hash of each number, ids the numbers of all tokens, sizes how many each text has (with two starts and an end)."""

    vocab: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Chunk:
        words, n = hashed_words(texts, BLANK)
        out = np.full(len(words) + 3 * len(n), START, np.uint64)
        out[np.cumsum(n + 3) - 1] = END
        out[np.arange(len(words)) + np.repeat(3 * np.arange(len(n)) + 2, n)] = words
        return cls(*np.unique(out, return_inverse=True), n + 3)

    @classmethod
    def read(cls, vocab: bytes, ids: bytes, sizes: bytes) -> Chunk:
        return cls(unpacked(vocab), *(unpacked(x).astype(np.int64) for x in (ids, sizes)))

    def grams(self, order: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By n: places of the last words of all n-grams, which of the distinct ones each is, and the hashes of those. Starts are no single tokens."""
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        at = np.flatnonzero(place > 1)
        own, which = np.unique(self.ids[at], return_inverse=True)
        out = {1: (at, which, self.vocab[own])}
        before, keys = self.ids, self.vocab
        for n in range(2, order + 1):
            at = np.flatnonzero(place >= n - 1)
            pairs, which = np.unique(before[at - 1] * len(self.vocab) + self.ids[at], return_inverse=True)
            keys = mix(keys[pairs // len(self.vocab)] * PLACE[0] + self.vocab[pairs % len(self.vocab)] * PLACE[1] + U(n))
            before = np.zeros(len(self.ids), np.int64)
            before[at] = which
            out[n] = at, which, keys
        return out

    def texts(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def chunks_of(rows: DataFrame, order: int) -> DataFrame:
    """The table of chunks of rows (kept, text, trains): chunk, a random name; kept and trains of its texts; vocab, ids and sizes; most, the bytes that its n-grams take in filters at most (an event for each)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1, CHUNK_BYTES):
            one = Chunk.of(batch.column(1))
            ends = pa.array([0, batch.num_rows], pa.int32())
            kept, trains = (pa.ListArray.from_arrays(ends, batch.column(i)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65]), kept, trains, *(pa.array([packed(x)]) for x in (one.vocab, one.ids, one.sizes)), pa.array([16 * len(one.vocab) + (order - 1) * len(one.ids) * BITS_PER_EVENT // 8])], ["chunk", "kept", "trains", "vocab", "ids", "sizes", "most"])

    kind = rows.schema["kept"].dataType.simpleString()
    # a table, as a task that ran again would name its chunks anew
    return materialize(rows.mapInArrow(cut, f"chunk long, kept array<{kind}>, trains array<boolean>, vocab binary, ids binary, sizes binary, most long"), "lm-chunks")


def spread(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of their keys, in order of the keys."""
    own = (keys % U(shards)).astype(np.int64)
    order = np.lexsort((keys, own))
    some, first = np.unique(own[order], return_index=True)
    yield from zip(some.tolist(), np.split(order, first[1:]))


def counted(chunks: DataFrame, order: int, shards: int, unseen: bool) -> DataFrame:
    """(shard, chunk, n, keys, counts): each chunk's distinct n-grams and how often its training texts have them. unseen: also those that they don't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, trains, *own = (c[i].as_py() for c in batch.columns)
                chunk = Chunk.read(*own)
                taught = np.array(trains)[chunk.texts()]
                for n, (at, which, keys) in chunk.grams(order).items():
                    c = np.bincount(which[taught[at]], minlength=len(keys))
                    if not unseen:
                        keys, c = keys[c > 0], c[c > 0]
                    rows = [(s, name, n, packed(keys[x] if n == 1 else keys[x] & UPPER), packed(c[x])) for s, x in spread(keys, shards)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["shard", "chunk", "n", "keys", "counts"])

    return chunks.select("chunk", "trains", "vocab", "ids", "sizes").mapInArrow(run, "shard int, chunk long, n int, keys binary, counts binary")


def events(keys: np.ndarray, level: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Bits of the event that each n-gram's count reaches a level, in filters of so many bits."""
    with np.errstate(over="ignore"):
        up, down = U(level) * STEP, U(level) * BACK
    h, g = mix(keys + up), mix(keys ^ down) | U(1)
    for j in range(HASHES):
        yield ((h + U(j) * g) >> U(32)) * bits >> U(32)


def added(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts, if that is over 0."""
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each = [(unpacked(k), unpacked(c).astype(np.int64)) for k, c in zip(rows["keys"], rows["counts"])]
    keys, c = (np.concatenate([x[x_c > 0] for x, x_c in pairs]) for pairs in (each, [(c, c) for _, c in each]))
    order = np.argsort(keys)
    keys, c = keys[order], c[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(c, first) if len(first) else c


def shard_row(rows: pd.DataFrame) -> dict:
    """The filter of a shard, as words, and the exact counts of its single tokens."""
    tokens, c1 = added(rows[rows["n"] == 1])
    keys, c = added(rows[rows["n"] > 1])
    top = np.searchsorted(LEVELS, c, "right")
    bits = max(64, -(-int(top.sum()) * BITS_PER_EVENT // 64) * 64)
    on = np.zeros(bits, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        for p in events(keys[top >= level], level, U(bits)):
            on[p] = True
    return {"shard": int(rows["shard"].iloc[0]), "words": np.packbits(on, bitorder="little").tobytes(), "tokens": tokens.tobytes(), "counts": c1.tobytes(), "n_tokens": len(tokens), "total": int(c1.sum())}


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([shard_row(rows)])


@dataclass(frozen=True)
class Shards:
    """Filters of some shards: base and bits say where each one's bits are; the tokens of all are sorted."""

    shards: int
    words: np.ndarray
    base: np.ndarray
    bits: np.ndarray
    tokens: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list, shards: int) -> Shards:
        words = np.frombuffer(b"".join(r["words"] for r in rows), np.uint8)
        size = np.array([len(r["words"]) for r in rows], np.int64)
        base, bits = np.zeros(shards, np.uint64), np.zeros(shards, np.uint64)
        which = [r["shard"] for r in rows]
        base[which], bits[which] = 8 * (np.cumsum(size) - size).astype(np.uint64), 8 * size.astype(np.uint64)
        tokens = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["tokens"], np.uint64) for r in rows)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in rows)])
        order = np.argsort(tokens)
        return cls(shards, words, base, bits, tokens[order], counts[order])

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        return np.where(self.tokens[at] == keys, self.counts[at], 0)

    def level(self, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many events of each n-gram are in its shard's filter, in a row from the first."""
        base, bits = self.base[own], self.bits[own]
        rest = np.flatnonzero(bits > 0)
        out = np.zeros(len(keys), np.int64)
        for level in range(1, len(LEVELS) + 1):
            ok = np.ones(len(rest), bool)
            for p in events(keys[rest], level, bits[rest]):
                p = p + base[rest]
                ok &= (self.words[p >> U(3)] >> (p & U(7)).astype(np.uint8) & 1).astype(bool)
            rest = rest[ok]
            if not len(rest):
                break
            out[rest] = level
        return out

    def answer(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Counts of single tokens, levels of longer n-grams."""
        return self.exact(keys) if n == 1 else self.level(keys & UPPER, (keys % U(self.shards)).astype(np.int64))


@dataclass(frozen=True)
class Totals:
    """N, V and the number of training texts."""

    total: int
    kinds: int
    texts: int


def scores(chunk: Chunk, found: dict[int, np.ndarray], order: int, totals: Totals) -> list[pa.Array]:
    """Of each text: n_tokens, n_known, base_score, score. found: by n, the answer for each distinct n-gram."""
    grams = chunk.grams(order)
    at, which, _ = grams[1]
    known = found[1][which]
    own = chunk.texts()[at]
    p = (known + 0.1) / (totals.total + 0.1 * (totals.kinds + 1))
    base = np.log10(p)
    shorter = known.astype(float)
    # the count of each context: of a start, all training texts; then what the n-gram before was
    context = np.full(len(chunk.ids), float(totals.texts))
    context[at] = shorter
    for n in range(2, order + 1):
        count = np.zeros(len(chunk.ids))
        count[grams[n][0]] = VALUES[found[n]][grams[n][1]]
        h = context[at - 1]
        c = np.minimum(np.minimum(count[at], shorter), h)
        p = (c + WEIGHT * p) / (h + WEIGHT)
        context, shorter = count, c
    sums = lambda x: np.bincount(own, x, len(chunk.sizes))
    return [pa.array(x) for x in (chunk.sizes - 2, sums(known > 0).astype(np.int64), sums(base), sums(np.log10(p)))]


NAMES = ["kept", "n_tokens", "n_known", "base_score", "score"]


def score_texts(documents: DataFrame, trains: Column, keep: list[str], order: int = 2, broadcast_bytes: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns of keep, and n_tokens, n_known, train_tokens, base_score and score of each row's text, learned from the rows where trains holds."""
    rows = documents.select(F.struct(*keep).alias("kept"), "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    kind = f"kept {rows.schema['kept'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    size, texts = rows.agg(F.sum(F.octet_length("text") + 3), F.count_if("trains")).first()
    shards = max(LEAST_SHARDS, -(-(size or 0) // shard_bytes))
    chunks = chunks_of(rows, order)
    if (chunks.agg(F.sum("most")).first()[0] or 0) <= broadcast_bytes:
        model = counted(chunks, order, shards, unseen=False).groupBy("shard").applyInPandas(build_shard, "shard int, words binary, tokens binary, counts binary, n_tokens long, total long")
        model = materialize(model, "lm-filter").collect()  # at most broadcast_bytes
        totals = Totals(sum(r["total"] for r in model), sum(r["n_tokens"] for r in model), texts)
        sent = documents.sparkSession.sparkContext.broadcast(Shards.of(model, shards))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    chunk = Chunk.read(*(c[i].as_py() for c in batch.columns[1:]))
                    found = {n: sent.value.answer(keys, n) for n, (_, _, keys) in chunk.grams(order).items()}
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, *scores(chunk, found, order, totals)], NAMES)

        out = chunks.select("kept", "vocab", "ids", "sizes").mapInArrow(run, kind)
        total = totals.total
    else:
        out, total = answered_by_shards(chunks, order, shards, texts, kind)
    return out.select("kept.*", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def answered_by_shards(chunks: DataFrame, order: int, shards: int, texts: int, kind: str) -> tuple[DataFrame, int]:
    """Scores of the chunks' texts, and N: each shard builds its filter and answers the chunks whose n-grams it has got."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        row = shard_row(rows)
        own = Shards.of([row | {"shard": 0}], 1)
        each = []
        for k, n in zip(rows["keys"], rows["n"]):
            keys = unpacked(k)
            each.append(packed(own.exact(keys) if n == 1 else own.level(keys, np.zeros(len(keys), np.int64))))
        out = pd.DataFrame({"chunk": rows["chunk"], "shard": rows["shard"], "n": rows["n"], "found": each, "total": None, "kinds": None})
        return pd.concat([out, pd.DataFrame([{"chunk": None, "shard": row["shard"], "n": 0, "found": None, "total": row["total"], "kinds": row["n_tokens"]}])])

    told = counted(chunks, order, shards, unseen=True).groupBy("shard").applyInPandas(answer, "chunk long, shard int, n int, found binary, total long, kinds long")
    told = materialize(told, "lm-answers")
    n, v = told.agg(F.sum("total"), F.sum("kinds")).first()
    totals = Totals(n or 0, v or 0, texts)
    told = told.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "n", "found")).alias("told"))  # a chunk's own answers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.read(*(c[i].as_py() for c in batch.columns[1:4]))
                answers = {(x["shard"], x["n"]): x["found"] for x in batch.column(4)[i].as_py()}
                found = {}
                for n, (_, _, keys) in chunk.grams(order).items():
                    found[n] = np.zeros(len(keys), np.int64)
                    for s, at in spread(keys, shards):
                        found[n][at] = unpacked(answers[s, n])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, *scores(chunk, found, order, totals)], NAMES)

    both = chunks.select("chunk", "kept", "vocab", "ids", "sizes").join(told, "chunk").select("kept", "vocab", "ids", "sizes", "told")
    return both.mapInArrow(score, kind), totals.total


def held_out() -> Column:
    """Whether crc32 of the id as text (null: empty) is a multiple of 10."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_documents(documents: DataFrame, order: int = 2, broadcast_bytes: int = BROADCAST_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document, learned from those that are not held out."""
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return score_texts(rows, ~F.col("held_out"), ["doc_id", "held_out"], order, broadcast_bytes, shard_bytes)
