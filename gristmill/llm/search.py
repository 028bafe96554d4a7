"""Ranked lexical search by windowed bucket scoring.

*Index*: each task numbers the documents it reads and cuts them into windows of ``WINDOW`` numbers (or fewer, where their texts take over ``WINDOW_BYTES``). A window's postings
- term, number, occurrences - are written sorted by term, with the documents' ids and lengths: no shuffle, and a table in the shared folder that any number of searches read. Totals of
documents and terms and each query term's number of documents are sums over it.

*Search*: queries are broadcast in blocks of ``QUERY_BYTES`` at most, one pass over the index each. A task goes through its windows. For each query it adds what the postings
of its terms score to an array of the window's numbers, small enough for the cache, ORs their bit sets into one of the numbers it has touched, and harvests those that beat
what a heap of the k best so far holds. The heaps of all tasks, k rows for a query each, are ranked at the end.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased, told apart by 64 bits of hash. The score sums, over a query's terms with repeats, w * ((10**9 * tf) div (1000 * tf + 8 * m)), w = floor(1000 ln((2 N + 2) / (2 df + 1))), m =
25 + (75 * n * N) div L, in whole numbers but for the logarithm.

Null and empty texts have no terms; they aren't counted in N and never found, and queries without terms find nothing. Rows are ranked each, also where they are equal or
ids repeat; equal scores go by id, null ids last. A term's hot list is spread over windows like any other; texts are read whole. Queries that share an id are ranked each (by row);
a null item_id stays. Empty tables give an empty result. Columns other than the id and text of either table are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize
from gristmill.llm.ngram_join import from_planes, planes
from gristmill.llm.tokens import NO_TERM, blocks, hashed_words

WINDOW, WINDOW_BYTES = 1 << 13, 16 << 20
QUERY_BYTES = 4 << 20
#: After all ids.
NO_ID = (1 << 63) - 1


def postings(terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct terms, how many documents have each, the documents' numbers by term, and their occurrences."""
    own, number = np.unique(terms, return_inverse=True)
    pairs, times = np.unique(number * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
    return own, np.bincount(pairs // len(sizes), minlength=len(own)), pairs % len(sizes), times


INDEX = "doc_ids array<bigint>, sizes binary, n_docs long, n_terms long, terms binary, dfs binary, docs binary, tfs binary"


def build_index(documents: DataFrame) -> DataFrame:
    """The index of documents (doc_id, text): a row for each window. n_docs counts those with terms, n_terms all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        terms: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def window() -> pa.RecordBatch:
            t, n = np.concatenate(terms), np.concatenate(sizes)
            own, dfs, docs, tfs = postings(t, n)
            row = [[pa.concat_arrays(ids).to_pylist()], [planes(n)], [int((n > 0).sum())], [len(t)], [own.tobytes()], [planes(dfs)], [planes(docs)], [planes(tfs)]]
            for x in (ids, terms, sizes):
                x.clear()
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["doc_ids", "sizes", "n_docs", "n_terms", "terms", "dfs", "docs", "tfs"])

        for batch in blocks(batches, 1):
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                if ids and (held + part.nbytes > WINDOW_BYTES or sum(map(len, ids)) + part.num_rows > WINDOW):
                    yield window()
                    held = 0
                t, n = hashed_words(part.column(1), NO_TERM)
                ids.append(part.column(0))
                terms.append(t)
                sizes.append(n)
                held += part.nbytes
        if ids:
            yield window()

    return materialize(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "search-index")


@dataclass(frozen=True)
class Queries:
    """terms: all distinct ones, sorted; of each query, which of them it has and how often; w: what each is worth."""

    terms: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]
    w: np.ndarray
    n_docs: int
    n_terms: int


def where(terms: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in terms and in known (both sorted) of those in both."""
    at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
    hit = np.flatnonzero(known[at] == terms) if len(known) else np.zeros(0, np.int64)
    return hit, at[hit]


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each term is: as many numbers as the queries have terms."""
    sent = index.sparkSession.sparkContext.broadcast(terms)  # of one block of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, which = where(sent.value, np.frombuffer(batch.column(0)[i].as_buffer(), np.uint64))
                total[at] += from_planes(batch.column(1)[i].as_buffer())[which]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    found = index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Heaps:
    """The k best documents of each query so far, as (score, -id), the worst first."""

    def __init__(self, n: int, k: int):
        self.k, self.best = k, [[] for _ in range(n)]

    def harvest(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        heap = self.best[query]
        if len(heap) == self.k:
            good = score >= heap[0][0]
            score, ids = score[good], ids[good]
        if len(score) > self.k:
            # of equals at the border all stay: their ids decide
            good = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[good], ids[good]
            order = np.lexsort((ids, -score))[: self.k]
            score, ids = score[order], ids[order]
        for one in zip(score.tolist(), (-ids).tolist()):
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            else:
                heapq.heappushpop(heap, one)


def score_window(queries: Queries, heaps: Heaps, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, dfs: np.ndarray, docs: np.ndarray, tfs: np.ndarray) -> None:
    """One window: postings of each query term are scored once, then scattered for each query that has it."""
    m = 25 + 75 * sizes * queries.n_docs // max(1, queries.n_terms)
    upto = np.cumsum(dfs)
    lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    mark = np.zeros(len(ids), bool)
    for term, at in zip(*where(queries.terms, terms)):
        span = slice(upto[at] - dfs[at], upto[at])
        d, tf = docs[span], tfs[span]
        mark[d] = True
        lists[int(term)] = d, queries.w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[d])), np.packbits(mark)
        mark[d] = False
    total, touched = np.zeros(len(ids), np.int64), np.zeros(len(np.packbits(mark)), np.uint8)
    for query, (own, times) in enumerate(queries.own):
        for term, k in zip(own.tolist(), times.tolist()):
            if term in lists:
                d, each, bits = lists[term]
                total[d] += k * each
                touched |= bits
        if touched.any():
            at = np.flatnonzero(np.unpackbits(touched, count=len(ids)))
            score = total[at]
            heaps.harvest(query, score[score > 0], ids[at[score > 0]])
            total[at] = 0
            touched[:] = 0


def blocks_of_queries(queries: DataFrame, query_bytes: int) -> Iterator[DataFrame]:
    """queries (query, text) in parts of about query_bytes of text, by a hash of their number."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // query_bytes)
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i)


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, rank, doc_id and score of the k best documents for each of queries (query, text), query being a distinct number."""
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = index.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    for block in blocks_of_queries(queries.select("query", "text"), query_bytes):
        asked = block.toArrow()  # query_bytes about, or one query
        each = [np.unique(hashed_words(pa.array([t], pa.string()), NO_TERM)[0], return_counts=True) for t in asked.column("text").to_pylist()]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in each)]))
        df = document_counts(index, terms)
        w = np.floor(1000 * np.log((2 * (n_docs or 0) + 2) / (2 * df + 1))).astype(np.int64)
        own = Queries(terms, [(np.searchsorted(terms, t), c) for t, c in each], w, n_docs or 0, n_terms or 0)
        out = out.unionByName(best_of(index, own, asked.column("query").to_numpy(), k))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def best_of(index: DataFrame, queries: Queries, names: np.ndarray, k: int) -> DataFrame:
    """query, doc_id, score: each task's best k for each query."""
    sent = index.sparkSession.sparkContext.broadcast(queries)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(names), k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.fill_null(NO_ID).to_numpy()
                sizes, dfs, docs, tfs = (from_planes(batch.column(c)[i].as_buffer()).astype(np.int64) for c in (1, 3, 4, 5))
                score_window(sent.value, heaps, ids, sizes, np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), dfs, docs, tfs)
        rows = [(int(names[q]), None if -d == NO_ID else -d, s) for q, heap in enumerate(heaps.best) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["query", "doc_id", "score"])

    return index.select("doc_ids", "sizes", "terms", "dfs", "docs", "tfs").mapInArrow(run, "query long, doc_id long, score long")


def search_documents(documents: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents for each row of items (item_id, text)."""
    queries = materialize(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "search-queries")
    found = search(build_index(documents), queries, k, query_bytes)
    return found.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
