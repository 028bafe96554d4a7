"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

A ``LineIndex`` keeps, cut into shards by the keys' hash, the exact postings (key, doc_id), the exact
reference counts (key, refs, first_doc, last_doc) and one cuckoo filter a shard with the keys that
two documents share. Inserting appends postings and adds counts; deleting documents subtracts them,
finds the new first holder of the keys they touched and takes keys that are no longer shared out of
the filters, so that a line another document had lost to a deleted one comes back. Either rewrites only
counts and filters of the shards that its keys fall into (a deletion their postings too); all others stay as they are.

A key is a line stripped of white space at both ends and lower-cased (A-Z), hashed to 128 bits; keys
under ``min_chars`` code points do not count. Deduplicating asks the filters first - they say no for
nearly all lines - and the exact counts for the rest. Postings lie in files by shard, so a task that reads some loads the filter of that
shard from the shared folder: one at a time, whatever their number. A line that a third of all documents hold makes a shard large; its postings are
written in many files, which many tasks read.

Nulls and ties: null and empty text is one empty line. A document is a doc_id: rows that repeat one
lose the same lines, and a line is shared when at least two different ids hold it. Null ids count as
one document that comes after all others (as does the id 2 ** 63 - 1, which is the same); their rows are looked up and joined text by text, so that they share no task. Texts are split whole, in slices of 512 documents. An empty table gives
an empty result. Other columns pass through unchanged, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import materialize, open_store, shared_folder

#: Lines of a shard, about; with more than four times as many in the mean, shards are cut anew.
SHARD_LINES = 8_000_000
#: Folders of one table before it is written as one again.
MOST_FOLDERS = 16
STRIP = b" \t\n\x0b\x0c\r"
#: Null ids as a number after all others.
NO_ID = (1 << 63) - 1


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A key for each line, None where the line is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        line = line.strip(STRIP).lower()
        long = len(line) >= 4 * min_chars or len(line) >= min_chars and len(line.decode()) >= min_chars
        out.append(xxhash.xxh3_128_digest(line) if long else None)
    return out


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; numpy does all but the last few insertions."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        size = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / 4 / 0.8))))
        self.table = np.zeros((size, 4), np.uint16) if table is None else table

    @staticmethod
    def hashes(keys: list[bytes] | np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0].copy()

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = np.maximum(h >> np.uint64(48), 1).astype(np.uint16)
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return fp, first, self.other(first, fp)

    def other(self, at, fp):
        return at ^ ((np.asarray(fp).astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if the filter is too full; the caller then builds a larger one from the exact table."""
        fp, at, _ = self.places(h)
        for _ in range(4):
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
            free = self.table[at] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[fits, rank[fits]]
            self.table[at[fits], slot] = fp[fits]
            fp, at = fp[~fits], at[~fits]
            at = self.other(at, fp)
        turn = 0
        for f, i in zip(fp.tolist(), at.tolist()):
            for _ in range(500):
                row = self.table[i]
                if (empty := np.flatnonzero(row == 0)).size:
                    row[empty[0]] = f
                    break
                turn += 1
                f, row[turn % 4] = int(row[turn % 4]), f
                i = int(self.other(i, f))
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        for f, a, b in zip(*[x.tolist() for x in self.places(h)]):
            for i in (a, b):
                if (held := np.flatnonzero(self.table[i] == f)).size:
                    self.table[i, held[0]] = 0
                    break

    @classmethod
    def build(cls, h: np.ndarray) -> CuckooFilter:
        n = len(h)
        while True:
            out = cls(n)
            if out.insert(h):
                return out
            n = 2 * max(n, 4)


def shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 1] % np.uint64(shards)).astype(np.int32)


class ShardTable:
    """A table with a column shard in the shared folder: folders, and the shards whose rows are read from each (one number per shard comes to the driver)."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.name, self.schema = spark, name, schema
        self.folders: dict[str, set[int]] = {}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """Rows of some shards (all, if not said); no other shard's files are opened."""
        out = None
        for folder, own in self.folders.items():
            if own := own if only is None else own & only:
                one = self.spark.read.schema(f"{self.schema}, shard int").parquet(folder).where(F.col("shard").isin(sorted(own)))
                out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], f"{self.schema}, shard int") if out is None else out

    def shards(self) -> set[int]:
        return set().union(*self.folders.values())

    def write(self, rows: DataFrame) -> tuple[str, set[int]]:
        folder = shared_folder(self.spark, self.name)
        # large shards are split over files, small ones share a task
        rows.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(folder)
        return folder, {r["shard"] for r in self.spark.read.schema(f"{self.schema}, shard int").parquet(folder).select("shard").distinct().collect()}

    def append(self, rows: DataFrame) -> set[int]:
        """Add rows; the shards they are in."""
        folder, own = self.write(rows)
        self.folders[folder] = own
        if len(self.folders) > MOST_FOLDERS:
            folder, every = self.write(self.read())
            self.folders = {folder: every}
        return own

    def replace(self, rows: DataFrame, touched: set[int]) -> None:
        """Rows in place of all that these shards held."""
        folder, own = self.write(rows)
        self.folders = {f: s - touched for f, s in self.folders.items() if s - touched} | {folder: own}


class LineIndex:
    """See the module. All state is in tables and filter files; each change writes new ones."""

    def __init__(self, spark: SparkSession, min_chars: int = 10, shard_lines: int = SHARD_LINES):
        self.spark, self.min_chars, self.shard_lines = spark, min_chars, shard_lines
        self.lines = self.shards = 0

    def start(self, shards: int) -> None:
        self.shards = shards
        self.postings = ShardTable(self.spark, "line-postings", "key binary, doc_id long")
        self.counts = ShardTable(self.spark, "line-counts", "key binary, refs long, first_doc long, last_doc long, turned boolean")
        #: The file of each shard's filter.
        self.filters: dict[int, str] = {}

    def keys_of(self, documents: DataFrame) -> DataFrame:
        """Distinct (key, doc_id) of each row, with the key's shard."""
        least, shards = self.min_chars, self.shards

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out_ids, out = batch.column(1).to_pylist(), [], []
                for i, text in zip(ids, batch.column(0)):
                    own = set(line_keys(text.as_py(), least)) - {None}
                    out += own
                    out_ids += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(out_ids, pa.int64()), pa.array(shards_of(out, shards))], ["key", "doc_id", "shard"])

        ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
        return documents.select("text", ids.alias("doc_id")).mapInArrow(keys, "key binary, doc_id long, shard int")

    @staticmethod
    def counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    def insert(self, documents: DataFrame) -> LineIndex:
        breaks = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "\n", ""))
        self.lines += documents.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1)).first()[0] or 0
        if not self.shards:
            self.start(max(8, -(-self.lines // self.shard_lines)))
        elif self.lines > 4 * self.shards * self.shard_lines:
            self.cut_anew()
        new = ShardTable(self.spark, "line-batch", "key binary, doc_id long")
        touched = new.append(self.keys_of(documents))
        self.postings.folders |= new.folders
        self.add(new.read(), touched)
        return self

    def add(self, postings: DataFrame, touched: set[int]) -> None:
        """Counts and filters of new postings."""
        parts = ["shard", "key", "refs", "first_doc", "last_doc"]
        added = self.counted(postings).select(*parts, F.lit(False).alias("was"))
        before = self.counts.read(touched & self.counts.shards()).select(*parts, (F.col("first_doc") < F.col("last_doc")).alias("was"))
        rows = before.unionByName(added).groupBy("shard", "key").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.max("was").alias("was")) if self.counts.folders else added
        self.counts.replace(rows.select(*parts, (~F.col("was") & (F.col("first_doc") < F.col("last_doc"))).alias("turned")), touched)
        self.change(self.counts.read(touched).where("turned").select("shard", "key", F.lit(True).alias("put")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take out all rows of these ids (column doc_id)."""
        if not self.shards:
            return self
        gone = materialize(doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct(), "line-gone")
        keys = materialize(self.postings.read().join(gone, "doc_id", "left_semi").select("shard", "key").distinct(), "line-touched")
        touched = {r["shard"] for r in keys.select("shard").distinct().collect()}
        before = self.counts.read(touched)
        self.postings.replace(self.postings.read(touched).join(gone, "doc_id", "left_anti"), touched)
        again = materialize(self.counted(self.postings.read(touched).join(keys, ["shard", "key"], "left_semi")), "line-counts")
        shared = lambda df: df.where("first_doc < last_doc").select("shard", "key")
        lost = materialize(shared(before.join(keys, ["shard", "key"], "left_semi")).join(shared(again), ["shard", "key"], "left_anti").withColumn("put", F.lit(False)), "line-lost")
        self.counts.replace(before.join(keys, ["shard", "key"], "left_anti").unionByName(again.withColumn("turned", F.lit(False))), touched)
        self.change(lost)
        return self

    def cut_anew(self) -> None:
        """More shards: all tables are written again, which happens each time the lines have grown fourfold."""
        old, shards = self.postings.read(), -(-self.lines // self.shard_lines)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shards_of(batch.column(0).to_pylist(), shards))], ["key", "doc_id", "shard"])

        self.start(shards)
        touched = self.postings.append(old.select("key", "doc_id").mapInArrow(again, "key binary, doc_id long, shard int"))
        self.add(self.postings.read(), touched)

    def change(self, keys: DataFrame) -> None:
        """Put keys into the filters of their shards or take them out. A filter that is full is built anew from its shard's counts."""
        folder, held = shared_folder(self.spark, "line-filters"), dict(self.filters)

        def save(shard: int, table: np.ndarray) -> str:
            store, at = open_store(folder)
            store.create_dir(at, recursive=True)
            # a task that runs again writes another file: only what it returns is read
            name = f"{shard}-{np.random.default_rng().integers(1 << 62):x}.cuckoo"
            with store.open_output_stream(f"{at}/{name}", compression=None) as sink:
                sink.write(table.tobytes())
            return f"{folder}/{name}"

        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            shard, put = int(pdf["shard"].iloc[0]), pdf["put"].to_numpy(bool)
            into, out = (CuckooFilter.hashes(list(pdf["key"][x])) for x in (put, ~put))
            if shard in held:
                f = CuckooFilter(table=loaded(held[shard]).copy())
                f.delete(out)
                ok = f.insert(into)
            else:
                f, ok = CuckooFilter.build(into), True
            return pd.DataFrame({"shard": [shard], "file": [save(shard, f.table) if ok else None]})

        made = {r["shard"]: r["file"] for r in keys.groupBy("shard").applyInPandas(apply, "shard int, file string").collect()}
        self.filters |= {s: f for s, f in made.items() if f}
        if full := {s for s, f in made.items() if not f}:
            for s in full:
                self.filters.pop(s, None)
            self.change(self.counts.read(full).where("first_doc < last_doc").select("shard", "key", F.lit(True).alias("put")))

    def maybe_shared(self, postings: DataFrame) -> DataFrame:
        """Postings that pass the filter of their shard."""
        files = dict(self.filters)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now: tuple[int, CuckooFilter | None] = -1, None
            for batch in batches:
                shard, keep = batch.column("shard").to_numpy(), np.zeros(batch.num_rows, bool)
                h = CuckooFilter.hashes(batch.column("key").to_pylist())
                for s in np.unique(shard).tolist():
                    if s not in files:
                        continue
                    if now[0] != s:
                        now = s, CuckooFilter(table=loaded(files[s]))
                    at = np.flatnonzero(shard == s)
                    keep[at] = now[1].contains(h[at])
                yield batch.filter(pa.array(keep))

        return postings.select("key", "doc_id", "shard").mapInArrow(probe, "key binary, doc_id long, shard int")

    def drops(self, postings: DataFrame, touched: set[int]) -> DataFrame:
        """doc_id and the keys that it must lose. Rows without an id are not among them."""
        first = self.counts.read(touched).where("first_doc < last_doc").select("shard", "key", "first_doc")
        lost = self.maybe_shared(postings.where(F.col("doc_id") < NO_ID)).join(first, ["shard", "key"]).where("doc_id > first_doc")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def drops_of_nameless(self, texts: DataFrame) -> DataFrame:
        """As drops, for texts without an id, named by their hash (as doc_id): what any document shares with them they lose, so each text is looked up for itself."""
        batch = ShardTable(self.spark, "line-nameless", "key binary, doc_id long")
        touched = batch.append(self.keys_of(texts))
        shared = self.counts.read(touched).where("first_doc < last_doc").select("shard", "key")
        return self.maybe_shared(batch.read()).join(shared, ["shard", "key"]).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def dedup(self, documents: DataFrame, whole: bool = False) -> DataFrame:
        """documents (all of them in the index) with the text that stays, n_lines (before) and n_dropped. whole: they are all that the index holds, so its postings serve."""
        if not self.shards:
            self.insert(documents.where("false"))
        table = self.postings
        if not whole:
            table = ShardTable(self.spark, "line-batch", "key binary, doc_id long")
            table.append(self.keys_of(documents))
        ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
        drops = self.drops(table.read(), table.shards()).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("hash"), "keys")
        nameless = documents.where(ids == NO_ID).select("text", F.xxhash64("text").alias("doc_id"))
        if some := not nameless.isEmpty():
            drops = drops.unionByName(self.drops_of_nameless(nameless).select(F.lit(NO_ID).alias("id"), F.col("doc_id").alias("hash"), "keys"))
        drops = materialize(drops, "line-drops")
        least = self.min_chars
        rest = [c for c in documents.columns if c not in ("n_lines", "n_dropped", "text")]
        kinds = documents.schema
        doc = T.StructType([kinds[c] for c in rest])
        schema = T.StructType([T.StructField("doc", doc), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
                kept, lines, dropped = [], [], []
                for t, k in zip(batch.column("text"), batch.column("keys")):
                    t, gone = t.as_py() or "", set(k.as_py() or ())
                    n = t.count("\n") + 1
                    stay = [x for x, own in zip(t.split("\n"), line_keys(t, least)) if own not in gone] if gone else None
                    lines.append(n)
                    dropped.append(0 if stay is None else n - len(stay))
                    kept.append(t if stay is None else "\n".join(stay))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc", "text", "n_lines", "n_dropped"])

        # rows without an id are spread by their texts
        hashed = F.when(ids == NO_ID, F.xxhash64("text")).otherwise(0).alias("hash")
        on = ["id", "hash"] if some else ["id"]
        joined = documents.select(F.struct(*rest).alias("doc"), "text", ids.alias("id"), hashed).drop(*({"hash"} - set(on)))
        joined = joined.join(drops.select(*on, "keys").hint("merge"), on, "left")
        out = joined.select("doc", "text", "keys").mapInArrow(strip, schema)
        return out.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def loaded(file: str) -> np.ndarray:
    store, at = open_store(file)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), np.uint16).reshape(-1, 4)


def dedup_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    return LineIndex(documents.sparkSession, min_chars).insert(documents).dedup(documents, whole=True)
