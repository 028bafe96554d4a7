"""Greedy packing of sections into byte-bounded chunks.

Sections are added in order while they fit; one that is larger than the bound has a chunk of its own.
This is sequential within a run, so runs are the unit of parallel work: a run's section *sizes*
are folded inside the JVM into chunk numbers, and only those meet the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import fixed


def chunk_numbers(sizes: Column, max_bytes: int) -> Column:
    """For an array of sizes, the chunk of each, from 0."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["used"] > 0) & (acc["used"] + size > max_bytes)
        chunk = F.when(opens, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(opens, size.cast("long")).otherwise(acc["used"] + size)
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


#: Sections folded at once in a run; beyond, the fold's growing list is quadratic and a task walks the run instead.
FOLD_SECTIONS = 10_000


def assign_chunks(sections: DataFrame, max_bytes: int, order: str = "section_ord", size: str = "n_bytes", run: str = "run_id") -> DataFrame:
    """sections with chunk_idx. max_bytes of 0 or less means 100 000."""
    bound = max_bytes if max_bytes > 0 else fixed.CHUNK_TRIGGER_BYTES
    slim = sections.select(run, F.col(order).alias("o"), F.col(size).alias("n"))
    runs = slim.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("s"))
    small = runs.where(F.size("s") <= FOLD_SECTIONS).select(run, F.explode(F.arrays_zip(F.col("s.o").alias("o"), chunk_numbers(F.col("s.n"), bound).alias("c"))).alias("x")).select(run, "x.o", "x.c")

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = used = 0
                out = []
                for r in rows:
                    if used and used + r["n"] > bound:
                        chunk, used = chunk + 1, 0
                    used += r["n"]
                    out.append(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), batch.schema.field(0).type), pa.array([r["o"] for r in rows], batch.schema.field(1).type.value_type.field(0).type), pa.array(out, pa.int32())], [run, "o", "c"])

    kinds = dict(slim.dtypes)
    large = runs.where(F.size("s") > FOLD_SECTIONS).mapInArrow(walk, f"`{run}` {kinds[run]}, o {kinds['o']}, c int")
    numbered = small.unionByName(large).select(run, F.col("o").alias(order), F.col("c").cast("int").alias("chunk_idx"))
    return sections.join(numbered, [run, order])


def build_chunks(sections: DataFrame, max_bytes: int) -> DataFrame:
    """(run_id, chunk_idx, diff, files) from sections."""
    packed = assign_chunks(sections, max_bytes).groupBy("run_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("section_ord", "body", "path"))).alias("s"))
    return packed.select("run_id", "chunk_idx", F.array_join("s.body", "").alias("diff"), F.filter("s.path", lambda p: p != "").alias("files"))
