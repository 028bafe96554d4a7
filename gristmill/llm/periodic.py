"""Periodic runs of words by bit-parallel lags.

The words of a text get numbers; bit b of all numbers is one big integer, the plane b. A plane XORed with itself shifted by q
has a one wherever words q apart differ in that bit, and the OR over all planes a one wherever they differ. Runs of period q are its
long stretches of zeros: the inverted integer is ANDed with itself shifted, by doubling steps, until a one stands only where a long enough stretch begins.

A run has at least ``REPEATS`` periods, so a multiple of q lies within its first q words, and from there on two periods of words are equal to those q later. Only
lags for which that holds somewhere, by sums of hashes, go through the planes (n/1 + n/2 + n/3 + ... comparisons at most, so long texts cost little more
than in proportion). A place inside a known run whose period divides q shows nothing new and doesn't count: that q has the same stretch. The hashes only choose lags; the
planes find the runs.

Words are runs of anything but ASCII white space, as they stand. A null or empty text has no words and no runs. Texts are read whole; each is judged alone,
so hot sources, repeated rows and ids and null ids change nothing. An empty table gives an empty result. Other columns pass through,
but for runs, n_words and collapsed, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BLANKS, split_words
from gristmill.llm.ngram_join import Powers, U, mix

#: A run has so many words and so many periods at least.
WORDS, REPEATS = 6, 4
#: Comparisons made at once to choose lags.
PAIRS = 1 << 21


def planes(ids: np.ndarray, kinds: int) -> list[int]:
    """Bit i of plane b is bit b of ids[i]."""
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, (kinds - 1).bit_length()))]


def ones(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def stretches(bits: list[int], n: int, q: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of n words in which words q apart are equal, if they are long enough."""
    apart = 0
    for plane in bits:
        apart |= plane ^ (plane >> q)
    same = ~apart & ((1 << (n - q)) - 1)
    least, have = max(WORDS, REPEATS * q) - q, 1
    while have < least and same:
        step = min(have, least - have)
        same &= same >> step
        have += step
    if not same:
        return []
    first, last = ones(same & ~(same << 1), n), ones(same & ~(same >> 1), n)
    return [(int(s), int(e - s + least + q)) for s, e in zip(first, last)]


def lags(ids: np.ndarray):
    """(q, places): lags with multiples of q where two periods of words equal those q later."""
    n = len(ids)
    up, _ = Powers.upto(n + 1)
    run = np.r_[U(0), np.cumsum(mix(ids.astype(np.uint64)) * up[:n], dtype=np.uint64)]
    every = np.arange(1, n // REPEATS + 1)
    sizes = n // every - 2
    part = np.cumsum(sizes) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(every)]
    for a, b in zip(cuts, cuts[1:]):
        k = sizes[a:b]
        q = np.repeat(every[a:b], k)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)) * q
        hit = (run[at + 2 * q] - run[at]) * up[q] == run[at + 3 * q] - run[at + q]
        q, at = q[hit], at[hit]
        new = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
        for i, j in zip(new, [*new[1:], len(q)]):
            yield int(q[i]), at[i:j]


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < WORDS:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    bits: list[int] | None = None
    found: dict[tuple[int, int], int] = {}
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q, at in lags(ids):
        for p, (start, end) in known.items():
            if q % p == 0:
                i = np.searchsorted(start, at, "right") - 1
                at = at[(i < 0) | (end[i] < at + 3 * q)]
        if not len(at):
            continue
        bits = bits or planes(ids, len(numbers))
        # a stretch that a shorter lag has found already has that period
        new = [x for x in stretches(bits, len(ids), q) if x not in found]
        found |= dict.fromkeys(new, q)
        if new:
            known[q] = np.array([s for s, _ in new]), np.array([s + k for s, k in new])
    return sorted((s, k, q) for (s, k), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: of a run its first period does, if no other run takes it."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def collapse_runs(documents: DataFrame) -> DataFrame:
    """documents with n_words, runs (array of start, length, period) and collapsed, the words left joined by a space."""
    kind = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf(kind)
    def collapse(texts: pa.Array) -> pa.Array:
        n, runs, left = [], [], []
        for text in texts:
            words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space
            own = runs_of(words)
            n.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), x)) for x in own])
            left.append(b" ".join(w for w, ok in zip(words, kept_words(len(words), own)) if ok) if own else b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(left, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    collapse = collapse.asNondeterministic()  # or it may run once for each field
    rest = [c for c in documents.columns if c not in ("n_words", "runs", "collapsed")]
    return documents.select(*rest, collapse("text").alias("__c")).select(*rest, "__c.*")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id (null: empty) is a multiple of 10, the text's tail repeats a few words: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    rows = documents.select("doc_id", "text", F.when(h % 10 == 0, split_words(F.col("text"), BLANKS)).alias("w"), g.alias("g"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail: Column = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
