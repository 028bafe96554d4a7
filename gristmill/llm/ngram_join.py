"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. All sets follow one global order,
rare shingles first. Two sets with 100 * intersection >= 75 * union share, for each l >= 1, at least l shingles of
their first n - ceil(0.75 n) + l. Each document picks its own l, lengthening its prefix while the estimated cost
of its candidates falls (after Wang, Li and Feng, "Can we beat the prefix filtering?", 2012); a pair must share as many
prefix shingles as the smaller l of the two before its whole sets are compared.

1. *Profile*: one pass makes each set's size and signature (equal sets are one class from here on) and counts
   all shingles of the corpus into a count sketch of ``CELLS`` cells. Any fixed order is correct; the sketch
   makes it a good one. Its size is constant, so it can be broadcast.
2. *Prefixes*: a second pass hands prefix entries, packed, to buckets by shingle. A list of two classes gives
   that pair. A longer list gives its star: each class with the one whose shingles are the most common, as a source
   that others were copied from. A shingle that the sketch counts over ``HOT_ENTRIES`` times has its list cut by the classes' hash into as many parts as
   that takes. Each part names the class whose shingles are the most common in it, and the best of these is joined with the whole list for its star: no list fills a task.
3. *Verify*: a bitmap of each set, the parities of its shingles' counts by cell, bounds the difference of two sets from below and so
   rejects most pairs that don't link, and no others. A third pass writes the sets of the classes in the pairs left; pairs are
   joined with them and compared.
4. *Contract*: connected components of the links (alternating large and small stars, distributed). A long list
   within one component is done. In the others, each class looks for classes of larger components, in as many of its
   shortest lists as it takes to meet all that share enough prefix shingles; a pair is made in the first list that its
   seeker shares with the other (told by 32 bits of the shingle's hash). A pair inside a component
   is not compared: it cannot change a component.

Classes are told apart by 128 bits: where two sets share the 64 bits that name them, the second gets another name.

So groups of copies cost in proportion to their rows, and components are exact (up to collisions of the
hashes, of which 40 bits are compared: about 1e-6 for two documents of a thousand words). Nulls and texts without words have no shingles, link with nothing
and are their own component; a null doc_id (or 2 ** 63 - 1, which counts as one) never names a component unless all its documents have null ids.
Repeated rows are equal sets, an empty table gives an empty result, and texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, without

WORDS = 5
CELLS = 1 << 21
CHUNKS = 64
#: Largest l, and the cost of comparing two sets in entries of prefix lists.
MOST_SHARED, COMPARE_COST = 8, 8.0
#: Prefix entries in a bucket, about, and those a task holds before it hands them on.
BUCKET_ENTRIES, FLUSH_ENTRIES, LEAST_BUCKETS = 1_000_000, 1_000_000, 32
#: Entries of one shingle's list, about, that a bucket takes; pivots of longer lists are broadcast up to so many.
HOT_ENTRIES, BROADCAST_PIVOTS = 20_000, 100_000
#: Bits of the filter that says which classes' sets are needed.
FILTER_BITS = 1 << 24

#: A null id, after all others.
NO_ID = (1 << 63) - 1

U = np.uint64
with np.errstate(over="ignore"):
    BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    STEP, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    PLACE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 2 * WORDS, dtype=np.uint64) | U(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class Powers:
    """Powers of STEP and BACK, as far as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up = np.cumprod(np.r_[U(1), np.full(size - 1, STEP)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[U(1), np.full(size - 1, BACK)], dtype=np.uint64)
        return cls.up, cls.down


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (see the module)."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)  # lower() of bytes is A-Z only
    blank = np.r_[True, BLANK[data], True]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = Powers.upto(len(data) + 1)
    run = np.r_[U(0), np.cumsum(BYTE[data] * up[: len(data)], dtype=np.uint64)]
    words = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(words)
    if n < WORDS:
        return mix(np.sum(words * PLACE[WORDS : WORDS + n], dtype=np.uint64, keepdims=True) + U(n))
    out = words[: n - WORDS + 1] * PLACE[0]
    for k in range(1, WORDS):
        out = out + words[k : n - WORDS + 1 + k] * PLACE[k]
    return np.unique(mix(out))


def signature(own: np.ndarray) -> int:
    """Of the set, as a signed long."""
    return int(mix(np.sum(mix(own + STEP), dtype=np.uint64, keepdims=True) + U(len(own))).view(np.int64)[0])


def second_name(own: np.ndarray) -> int:
    """64 more bits of the set."""
    return int(mix(np.sum(mix(own ^ BACK), dtype=np.uint64, keepdims=True) ^ U(len(own))).view(np.int64)[0])


def class_name(own: np.ndarray, renamed: dict[int, dict[int, int]]) -> int:
    sig = signature(own)
    return renamed[sig].get(second_name(own), sig) if sig in renamed else sig


def cell(own: np.ndarray) -> np.ndarray:
    return (own >> U(64 - (CELLS - 1).bit_length())).astype(np.int64)


def required(n: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def prefix(own: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, the number l of its shingles that a partner must share, and how common its shingles are."""
    n = len(own)
    seen = counts[cell(own)]
    order = np.lexsort((own, seen))
    base = n - required(n)
    most = min(MOST_SHARED, n - base)
    read = np.cumsum(np.maximum(seen[order[: base + most]] - noise, 0.0))[base:]
    share = np.arange(1, most + 1)
    cost = read + COMPARE_COST * read / share
    best = int(np.argmin(cost))
    return own[order[: base + best + 1]], best + 1, int(1000 * np.log2(seen + 1.0).mean())


def packed(own: np.ndarray) -> bytes:
    """The upper five bytes of each sorted hash; where that is shorter, how many hashes have each first byte and then four bytes of each."""
    upper = own >> U(24)
    heads = np.bincount((upper >> U(32)).astype(np.int64), minlength=256)
    if len(own) > 256 and heads.max() < 256:
        return b"\x01" + heads.astype(np.uint8).tobytes() + upper.astype(np.uint32).tobytes()
    return b"\x00" + five(own)


def unpacked(data) -> np.ndarray:
    """The hashes of packed(), of which the lower three bytes are 0."""
    data = np.frombuffer(data, np.uint8)
    if not data[0]:
        return from_five(data[1:])
    heads = np.repeat(np.arange(256, dtype=np.uint64), data[1:257])
    return heads << U(56) | np.frombuffer(data[257:].tobytes(), np.uint32).astype(np.uint64) << U(24)


def five(hashes: np.ndarray) -> bytes:
    """The upper five bytes of each hash."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def from_five(data) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, all first bytes first: small ones compress well then."""
    return numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def parities(own: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as shingles, a power of two: whether an odd number of them fall on a bit."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount(((own >> U(24)) & U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int) -> bool:
    """Whether two sets of na and nb shingles may link: as many shingles as their bitmaps differ in bits are in one set only. The larger bitmap is folded to the smaller one's size."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = int(np.bitwise_count(x ^ y).sum())
    return 7 * apart <= na + nb  # 7 i >= 3 (x + y), and x + y - 2 i is at least apart


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 7 * same >= 3 * (len(a) + len(b))  # 100 i >= 75 (x + y - i)


def profile(documents: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
    """(doc_id, n, sig, sig2, bits) of all documents; the sketch's counts; their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        names = ["doc_id", "n", "sig", "sig2", "bits", "chunk", "counts"]
        some = False
        for batch in batches:
            n, sig, sig2, bits = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py())
                n.append(len(own))
                sig.append(signature(own) if len(own) else None)
                sig2.append(second_name(own) if len(own) else None)
                bits.append(parities(own) if len(own) else None)
                np.add.at(counts, cell(own), 1)
                some = some or len(own) > 0
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(sig2, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if some:
            size = CELLS // CHUNKS
            packed = [zlib.compress(planes(counts[i * size : (i + 1) * size]), 1) for i in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(CHUNKS, pa.int64())] * 4, pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sig long, sig2 long, bits binary, chunk int, counts binary")
    rows = materialize(rows, "shingle-profile")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // CHUNKS, np.uint64)
        for x in pdf["counts"]:
            total += from_planes(zlib.decompress(x))
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    # CHUNKS rows of constant size
    parts = rows.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    counts = np.zeros(CELLS, np.uint32)
    for r in parts:
        counts[r["chunk"] * (CELLS // CHUNKS) :][: CELLS // CHUNKS] = np.frombuffer(r["counts"], np.uint32)
    return rows.where("chunk is null").select("doc_id", "n", "sig", "sig2", "bits"), counts, float(counts.mean())


def told_apart(docs: DataFrame) -> tuple[DataFrame, dict[int, dict[int, int]]]:
    """docs with sets that share a sig under names of their own; by sig and sig2 what was renamed (of n sets about n * n / 2 ** 65)."""
    twice = docs.where("n > 0").groupBy("sig").agg(F.min("sig2").alias("lo"), F.max("sig2").alias("hi")).where("lo <> hi").select("sig", "lo")
    twice = materialize(twice, "shingle-names")
    if twice.isEmpty():
        return docs.drop("sig2"), {}
    others = docs.join(twice, "sig").where("sig2 <> lo").select("sig", "sig2").distinct().withColumn("name", F.xxhash64("sig", "sig2"))
    renamed: dict[int, dict[int, int]] = {}
    for r in others.collect():
        renamed.setdefault(r["sig"], {})[r["sig2"]] = r["name"]
    docs = docs.join(others, ["sig", "sig2"], "left").withColumn("sig", F.coalesce("name", "sig")).drop("name", "sig2")
    return materialize(docs.select("doc_id", "n", "sig", "bits"), "shingle-profile"), renamed


def prefix_lists(documents: DataFrame, counts: np.ndarray, noise: float, entries: int, renamed: dict[int, dict[int, int]], hot_entries: int) -> DataFrame:
    """Rows of kind 'pair' (a, b, shared: shingles of one bucket that only these two have in their prefixes), 'star' (a, b: one is the pivot), 'entry' (class a in the longer list of shingle b) and 'centre' (class a is the pivot of a part of the list of shingle b; shared: how common its shingles are); n: sizes, l: shares."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(counts)  # CELLS numbers
    buckets = max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            at = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[0]) for h in held])
            docs = np.array([(h[1], h[2], h[3]) for h in held], np.int64)
            bucket = (tokens % U(buckets)).astype(np.int64)
            parts = sent.value[cell(tokens)] // hot_entries
            hot = np.flatnonzero(parts)
            part = docs[at[hot], 0].view(np.uint64) % (parts[hot].astype(np.uint64) + U(1))
            home = bucket[hot]
            # parts of long lists go to buckets of their own numbers, below 0
            bucket[hot] = -1 - ((mix(tokens[hot] + part * STEP)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = []

            def add(b: int, own: np.ndarray, homes: bytes | None) -> None:
                who, times = np.unique(at[own], return_counts=True)  # at[own] ascends
                rows.append((b, five(tokens[own]), planes(times), docs[who, 0].tobytes(), planes(docs[who, 1]), planes(docs[who, 2]), homes))

            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if len(own := order[cuts[b] : cuts[b + 1]]):
                    add(b, own, None)
            where = np.full(len(tokens), 0, np.uint64)
            which = where.copy()
            where[hot], which[hot] = home.astype(np.uint64), part
            for b in np.unique(bucket[hot]):
                own = np.sort(hot[bucket[hot] == b])
                add(int(b), own, (where[own] | which[own] << U(32)).tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], ["bucket", "tokens", "times", "sigs", "sizes", "shares", "homes"])

        n = 0
        for batch in batches:
            for text in batch.column(0):
                own = shingles(text.as_py())
                if not len(own) or (sig := class_name(own, renamed)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sig)
                some, share, common = prefix(own, sent.value, noise)
                held.append((some, sig, len(own), common * 16 + share))
                n += len(some)
                if n >= FLUSH_ENTRIES:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, sigs, sizes, shares, parts = [], [], [], [], []
        # the lower bytes, which aren't sent, give way to the bucket (of a part of a long list: the bucket of the whole one)
        bucket = int(pdf["bucket"].iloc[0])
        for own, times, sig, size, common, home in zip(pdf["tokens"], pdf["times"], pdf["sigs"], pdf["sizes"], pdf["shares"], pdf["homes"]):
            times = from_planes(times)
            home = np.frombuffer(home, np.uint64) if bucket < 0 else np.full(len(own) // 5, bucket, np.uint64)
            tokens.append(from_five(own) | home & U(0xFFFFFFFF))
            parts.append(home >> U(32))
            sigs.append(np.repeat(np.frombuffer(sig, np.int64), times))
            sizes.append(np.repeat(from_planes(size).astype(np.int64), times))
            shares.append(np.repeat(from_planes(common).astype(np.int64), times))
        t, s, n, share, part = (np.concatenate(x) for x in (tokens, sigs, sizes, shares, parts))
        order = np.lexsort((s, part, t))
        t, s, n, share, part = t[order], s[order], n[order], share[order], part[order]
        once = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]  # a class is in one part of a list
        t, s, n, share, part = t[once], s[once], n[once], share[once], part[once]
        first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (part[1:] != part[:-1])])
        length = np.diff(np.r_[first, len(t)])
        common, share = share >> 4, share & 15
        out = []

        def rows(kind: str, a, b, shared, i, j) -> None:
            if len(i):
                out.append(pd.DataFrame({"kind": kind, "a": a, "b": b, "shared": shared, "na": n[i], "nb": n[j], "la": share[i], "lb": share[j]}))

        # s is sorted inside a list, so a < b
        i = first[length == 2] if bucket >= 0 else first[:0]
        order = np.lexsort((s[i + 1], s[i]))
        i = i[order]
        new = np.flatnonzero(np.r_[True, (s[i][1:] != s[i][:-1]) | (s[i + 1][1:] != s[i + 1][:-1])]) if len(i) else i
        rows("pair", s[i[new]], s[i[new] + 1], np.diff(np.r_[new, len(i)]), i[new], i[new] + 1)
        big = np.repeat((length > 2) | (bucket < 0), length)
        if big.any():
            at = np.flatnonzero(big)
            rows("entry", s[at], t[at].view(np.int64), 0, at, at)
            top = np.maximum.reduceat(common, first)
            is_top = common == np.repeat(top, length)
            pivot = np.minimum.reduceat(np.where(is_top, np.arange(len(t)), len(t)), first)
            if bucket < 0:
                rows("centre", s[pivot], t[pivot].view(np.int64), common[pivot], pivot, pivot)
            p = np.repeat(pivot, length)[at] if bucket >= 0 else at
            near = (p != at) & (4 * np.minimum(n[at], n[p]) >= 3 * np.maximum(n[at], n[p]))
            lo, hi = np.minimum(at, p)[near], np.maximum(at, p)[near]
            _, one = np.unique(np.stack([s[lo], s[hi]], 1), axis=0, return_index=True) if len(lo) else (None, lo)
            rows("star", s[lo[one]], s[hi[one]], 0, lo[one], hi[one])
        names = ["kind", "a", "b", "shared", "na", "nb", "la", "lb"]
        return pd.concat(out)[names] if out else pd.DataFrame({c: pd.Series([], dtype=object if c == "kind" else "int64") for c in names})

    packed = documents.select("text").mapInArrow(emit, "bucket int, tokens binary, times binary, sigs binary, sizes binary, shares binary, homes binary")
    return packed.groupBy("bucket").applyInPandas(lists, "kind string, a long, b long, shared long, na long, nb long, la long, lb long")


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit filter over first_id: of constant size, however many rows there are."""
    spot = f"pmod(xxhash64(first_id), {FILTER_BITS})"
    words = ids.groupBy(F.expr(f"shiftright({spot}, 6)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({spot}, 64) as int))")).alias("v")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return bits.view(np.uint64)


def likely(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes without those whose bitmaps differ in too many bits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]))
            yield batch.filter(pa.array([may_link(*r) for r in rows], pa.bool_())).select(["a", "b"])

    side = lambda c: classes.select(F.col("sig").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n{c}"))
    # by the same way at every size
    both = pairs.select("a", "b").hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "bits_a", "bits_b", "na", "nb")
    return materialize(both.mapInArrow(compare, "a long, b long"), "shingle-pairs")


def verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame, renamed: dict[int, dict[int, int]]) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets link. Their sets are made again from each class's smallest document.

    The class with more partners (a pivot) becomes b, so that few sets travel on that side. A bit filter for either
    side tells the tasks whose sets are needed there; what passes by chance meets nothing in the joins.
    """
    pairs = likely(classes, pairs)
    ids = classes.select("sig", F.coalesce("first_id", F.lit(NO_ID)).alias("first_id"))
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).groupBy("sig").agg(F.count("*").alias("d")).join(ids, "sig")
    named = pairs.join(ends.toDF("a", "da", "fa"), "a").join(ends.toDF("b", "db", "fb"), "b")
    turn = F.col("da") > F.col("db")
    named = named.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("fa", "fb"), ("fb", "fa"))])
    named = materialize(named, "shingle-pairs")
    sent = documents.sparkSession.sparkContext.broadcast([id_bits(named.select(F.col(c).alias("first_id"))) for c in ("fa", "fb")])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(1).to_numpy()
            sides = [((bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & U(1)).astype(bool) for bits in sent.value]
            hit = np.flatnonzero(sides[0] | sides[1])
            texts, ids = batch.column(2), batch.column(0)
            for k in range(0, len(hit), 256):
                own = [(int(i), shingles(texts[int(i)].as_py())) for i in hit[k : k + 256]]
                own = [(i, x) for i, x in own if len(x)]
                at = np.array([i for i, _ in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py() for i, _ in own], pa.int64()), pa.array([class_name(x, renamed) for _, x in own], pa.int64()), pa.array([packed(x) for _, x in own], pa.binary()), *[pa.array(side[at]) for side in sides]], ["doc_id", "sig", "own", "is_a", "is_b"])

    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    made = documents.select(doc_id.alias("doc_id"), F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS)).alias("spot"), "text").mapInArrow(sets, "doc_id long, sig long, own binary, is_a boolean, is_b boolean")
    made = materialize(made, "shingle-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [linked(unpacked(x[i].as_buffer()), unpacked(y[i].as_buffer())) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    side = lambda c: made.where(f"is_{c}").select(F.col("doc_id").alias(f"f{c}"), F.col("sig").alias(c), F.col("own").alias(f"own_{c}"))
    # by the same way at every size
    both = named.hint("merge").join(side("a"), ["a", "fa"]).select("b", "fb", "a", "own_a").hint("merge").join(side("b"), ["b", "fb"]).select("a", "b", "own_a", "own_b")
    return materialize(both.mapInArrow(compare, "a long, b long"), "shingle-links")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) with comp the smallest node of its component, for all nodes of links (a, b)."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def must_share(na: str, nb: str, la: str, lb: str) -> Column:
    """Prefix shingles that two linked sets share at least. Behind one of the prefixes lie ceil(0.75 n) - l shingles, of which all may be shared."""
    whole = f"(3 * ({na} + {nb}) + 6) div 7"
    return F.expr(f"greatest(least({la}, {lb}), {whole} - greatest((3 * {na} + 3) div 4 - {la}, (3 * {nb} + 3) div 4 - {lb}))")


def jaccard_components(documents: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of documents."""
    docs, counts, noise = profile(documents)
    docs, renamed = told_apart(docs)
    classes = materialize(docs.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.first("bits").alias("bits")), "shingle-classes")
    entries = classes.agg(F.sum(F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 2).alias("e")).first()["e"] or 0
    found = materialize(prefix_lists(documents, counts, noise, int(entries), renamed, hot_entries), "prefix-lists")
    entries = found.where("kind = 'entry'").select(F.col("b").alias("token"), F.col("a").alias("sig"), F.col("na").alias("n"), F.col("la").alias("l"))
    stars = found.where("kind = 'star'").select("a", "b", "na", "nb", "la", "lb")
    # the centres of a list's parts, and of them the one that a single list would have as its pivot
    centres = found.where("kind = 'centre'").select(F.col("b").alias("token"), F.struct(F.col("a").alias("s"), F.col("na").alias("n"), F.col("la").alias("l")).alias("y"), "shared")
    tops = materialize(centres.groupBy("token").agg(F.max_by("y", F.struct("shared", F.bitwise_not("y.s"))).alias("y")), "shingle-pivots")
    tops = F.broadcast(tops) if tops.count() <= BROADCAST_PIVOTS else tops
    ends = entries.select("token", F.struct(F.col("sig").alias("s"), "n", "l").alias("x")).join(tops, "token").where("x.s <> y.s and 4 * least(x.n, y.n) >= 3 * greatest(x.n, y.n)")
    ends = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    stars = stars.unionByName(ends.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.col("x.l").alias("la"), F.col("y.l").alias("lb")))
    stars = stars.distinct().withColumn("shared", F.lit(None).cast("long"))
    twos = found.where("kind = 'pair'").groupBy("a", "b", "na", "nb", "la", "lb").agg(F.sum("shared").alias("shared"))
    # a class's shingles in longer lists, as short hashes (collisions only raise what two seem to share), and how many it has in lists of two
    longer = entries.groupBy("sig").agg(F.collect_set(F.expr("cast(hash(token) % 32768 as smallint)")).alias("own"), F.count("*").alias("k"))
    two = twos.select(F.col("a").alias("sig"), "shared").union(twos.select("b", "shared")).groupBy("sig").agg(F.sum("shared").alias("s"))
    held = longer.join(two, "sig", "full").select("sig", F.coalesce("own", F.array().cast("array<smallint>")).alias("own"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("s", F.lit(0)).alias("s"))
    held = materialize(held, "shingle-lists")
    pairs = twos.unionByName(stars).groupBy("a", "b", "na", "nb", "la", "lb").agg(F.coalesce(F.max("shared"), F.lit(0)).alias("shared"))
    pairs = pairs.join(held.toDF("a", "own_a", "ka", "sa"), "a").join(held.toDF("b", "own_b", "kb", "sb"), "b")
    met = F.size(F.array_intersect("own_a", "own_b")) + F.greatest(F.col("ka") - F.size("own_a"), F.col("kb") - F.size("own_b")) + F.col("shared")
    pairs = materialize(pairs.where(met >= must_share("na", "nb", "la", "lb")).select("a", "b"), "shingle-pairs")
    links = verified(documents, classes, pairs, renamed)
    comps = components(links)

    # of two components the smaller one's classes look for the larger one's
    sized = comps.join(comps.groupBy("comp").agg(F.count("*").alias("w")), "comp").select(F.col("node").alias("sig"), "comp", "w")
    left = entries.join(sized, "sig", "left").withColumn("comp", F.struct(F.coalesce("w", F.lit(1)).alias("w"), F.coalesce("comp", "sig").alias("c"))).drop("w")
    lists = left.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("major"), F.count("*").alias("size"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("l").alias("ll")).where("least <> major").drop("least")
    # as a table of its own, so that the join with it can split a shingle that very many classes have
    left = left.join(materialize(lists, "shingle-open"), "token")
    left, sizes = left.drop("major", "size", "lo", "hi", "ll"), left
    # of k open lists, a class that must share m shingles with any partner in them meets each in any k - m + 1: the shortest serve.
    # must_share rises and then falls with the partner's size, so its least value lies at the ends of the list's sizes (2 off for rounding)
    ends = [must_share("n", f"greatest(least({e}, (4 * n) div 3), (3 * n + 3) div 4)", "l", "ll") for e in ("lo", "hi")]
    own = Window.partitionBy("sig")
    every = sizes.withColumn("m", F.greatest(F.least("l", "ll"), F.least(*ends) - 2)).join(held.select("sig", "s"), "sig")
    every = every.withColumn("m", F.min("m").over(own) - F.col("s")).withColumn("open", F.count("*").over(own))
    # what has too few open lists to meet anyone goes
    every = every.where("open >= m").withColumn("seeks", F.col("comp") < F.col("major")).withColumn("k", F.count_if("seeks").over(own))
    turn = own.orderBy(F.desc("seeks"), "size", "token")
    # only open lists can be shared by classes of two components: own has a class's, by 32 bits, in the order in which it seeks.
    # A pair that shares several is made in the first of them: what its seeker has looked at before must not be the other one's
    every = every.withColumn("i", F.row_number().over(turn)).withColumn("own", F.collect_list(F.expr("hash(token)")).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    every = every.withColumn("seeks", F.expr("seeks and i <= k - greatest(m, 1) + 1")).withColumn("lack", F.col("open") - F.size(F.array_distinct("own")))
    every = materialize(every.select(*left.columns, "s", "lack", "own", "i", "seeks"), "open-lists")
    minor = every.where("seeks").drop("seeks")
    left = every.drop("seeks", "i").join(materialize(minor.select("token").distinct(), "shingle-sought"), "token", "left_semi")
    x, y = minor.alias("x"), left.alias("y")
    met = (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp"))
    met = met & (4 * F.least("x.n", "y.n") >= 3 * F.greatest("x.n", "y.n")) & ~F.arrays_overlap(F.slice("x.own", F.lit(1), F.col("x.i") - 1), "y.own")
    met = met & (F.size(F.array_intersect("x.own", "y.own")) + F.greatest("x.lack", "y.lack") + F.least("x.s", "y.s") >= must_share("x.n", "y.n", "x.l", "y.l"))
    more = x.join(y, met).select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "shingle-pairs")
    if not more.isEmpty():
        new = verified(documents, classes, more, renamed)
        if not new.isEmpty():
            comps = components(links.union(new))

    named = classes.drop("bits").join(comps.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "comp").select("sig", "component_id")
    out = docs.drop("bits").join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one document of each component: the smallest doc_id. Rows that repeat a doc_id are one document; null ids stay."""
    gone = materialize(jaccard_components(documents).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without(documents, gone, "doc_id")
