"""Sharding along a Hilbert curve [native].

Each metadata dimension - a number or a string - becomes the number of quantiles, taken over all rows and whole
values, that lie below it: a value with a third of all rows takes a third of the axis. The bins give one index on a Hilbert curve. Rows
sorted by that index are cut into runs of equal row counts, so that a shard covers a compact box and min/max statistics
prune files in every dimension.

Global ranks come without a global sort: the rows of each curve cell are counted (at most
2 ** (bits * dimensions) cells), cells are dealt into lanes by a hash of the row's key, so that a
cell with a third of all rows is many groups, and counts are summed first over cells, then over the
lanes of each cell. Only then are rows numbered, inside a lane. Quantiles of strings come from the counts of
distinct values, ranked within ranges of values.

Nulls: a null dimension is the lowest value, a null text has size 1 and CRC 0, a null key hashes
like any other and sorts first. Equal keys are ordered by size and CRC; rows equal in all of that
are interchangeable. Repeated rows are placed each. Texts of any length count as their size only. An empty table gives an empty result.
Other columns of the input stay out of shard_documents and are all written by write_shards; columns there that are named
like the new ones (hilbert, shard, slot, part) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize

LANE_ROWS = 50_000
#: Distinct strings of a dimension that one task ranks, about.
RANKED_VALUES = 100_000


def number_cuts(df: DataFrame, column: str, bits: int) -> list[int]:
    """Quantiles of a long column, one for each border between bins."""
    return df.agg(F.percentile_approx(column, [i / 2**bits for i in range(1, 2**bits)], 10_000)).first()[0] or []


def string_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """As number_cuts, for whole strings and without an approximation."""
    per = materialize(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")), "shard-values")
    values, total = per.agg(F.count("*"), F.sum("n")).first()
    if not values:
        return []
    # ranges of values keep their order, so only the ranges' sums need a running total
    placed = materialize(per.repartitionByRange(max(1, -(-values // RANKED_VALUES)), "v").withColumn("part", F.spark_partition_id()), "shard-ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before"))  # a row per range
    own = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(F.broadcast(before), "part").withColumn("hi", F.col("before") + F.sum("n").over(own))
    # the i-th cut is the smallest value up to which at least i / 2 ** bits of the rows lie
    spans = ranked.select("v", F.expr(f"((hi - n) * {1 << bits}) div {total} + 1").alias("lo"), F.expr(f"least((hi * {1 << bits}) div {total}, {(1 << bits) - 1})").alias("hi"))
    cuts = spans.where("lo <= hi").select(F.explode(F.sequence("lo", "hi")).alias("i"), "v").groupBy("i").agg(F.min("v").alias("v"))
    return [r["v"] for r in sorted(cuts.collect(), key=lambda r: r["i"])]  # a row per border


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the curve of a point whose axes are ints below 2 ** bits.

    Skilling's transform ("Programming the Hilbert curve", 2004) as one fold over (bit, axis) steps.
    """
    n, names = len(axes), [f"x{i}" for i in range(len(axes))]
    start = F.struct(*[a.cast("long").alias(c) for a, c in zip(axes, names)])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(acc: Column, step: Column) -> Column:
        q, low = step["q"], step["q"] - 1
        own = F.element_at(F.array(*[acc[c] for c in names]), step["i"] + 1)
        high = own.bitwiseAND(q) != 0
        swap = acc["x0"].bitwiseXOR(own).bitwiseAND(low)
        first = F.when(high, acc["x0"].bitwiseXOR(low)).otherwise(acc["x0"].bitwiseXOR(swap))
        rest = [F.when((step["i"] == k) & ~high, acc[c].bitwiseXOR(swap)).otherwise(acc[c]) for k, c in enumerate(names) if k]
        return F.struct(*[x.alias(c) for x, c in zip([first, *rest], names)])

    def interleave(acc: Column) -> Column:
        gray = [acc["x0"]]
        for c in names[1:]:
            gray.append(gray[-1].bitwiseXOR(acc[c]))
        turn = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(gray[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for k, g in enumerate(gray):
                bit = F.shiftright(g.bitwiseXOR(turn), b).bitwiseAND(F.lit(1))
                out = out + F.shiftleft(bit, b * n + (n - 1 - k))
        return out

    if bits > 1:
        return F.aggregate(steps, start, undo, interleave)
    return interleave(start)


def with_hilbert(df: DataFrame, dims: dict[str, Column], bits: int = 5) -> DataFrame:
    """df with hilbert (long). dims: name to a long or string Column."""
    names = list(dims)
    df = df.select("*", *[c.alias(f"__d_{n}") for n, c in dims.items()])
    kinds = dict(df.dtypes)

    def bin_of(name: str) -> Column:
        d = f"__d_{name}"
        cuts = string_cuts(df, d, bits) if kinds[d] == "string" else number_cuts(df, d, bits)
        bounds = F.array(*[F.lit(v) for v in cuts]).cast(f"array<{kinds[d]}>")
        return F.size(F.filter(bounds, lambda b: b < F.col(d)))  # a null is below all

    return df.withColumn("hilbert", hilbert_index([bin_of(n) for n in names], bits)).drop(*[f"__d_{n}" for n in names])


def hilbert_shards(df: DataFrame, key: str, dims: dict[str, Column], n_shards: int, tie: list[str], bits: int = 5) -> DataFrame:
    """df with hilbert (long), shard (int) and slot (long, gapless from 0 in each shard); counts differ by one at most.

    dims: see with_hilbert. tie: columns that order rows of one lane after the key.
    """
    df = materialize(with_hilbert(df, dims, bits), "hilbert")  # read three times below
    total = df.count()
    lanes = max(1, -(-total // LANE_ROWS))
    # at least 64 lanes, so that tasks share even a cell of a small table
    df = df.withColumn("__lane", F.pmod(F.xxhash64(F.col(key)), F.lit(max(64, lanes))))
    per_lane = df.groupBy("hilbert", "__lane").agg(F.count("*").alias("__n"))
    per_cell = per_lane.groupBy("hilbert").agg(F.sum("__n").alias("__n"))  # bounded by the grid, whatever the rows
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.select("hilbert", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__cell"))
    within = Window.partitionBy("hilbert").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_lane.join(cells, "hilbert").select("hilbert", "__lane", (F.col("__cell") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__start"))
    order = Window.partitionBy("hilbert", "__lane").orderBy(key, *tie)
    ranked = df.join(starts, ["hilbert", "__lane"]).withColumn("__r", F.col("__start") + F.row_number().over(order) - 1)
    if not total:
        return ranked.withColumn("shard", F.lit(0)).withColumn("slot", F.col("__r")).drop("__lane", "__start", "__r")
    ranked = ranked.withColumn("shard", F.expr(f"cast((__r * {n_shards}) div {total} as int)"))
    return ranked.withColumn("slot", F.expr(f"__r - (shard * {total}L + {n_shards - 1}) div {n_shards}")).drop("__lane", "__start", "__r")


def metadata(documents: DataFrame, *more: str) -> DataFrame:
    """What orders documents: no text."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *more)


def shard_documents(documents: DataFrame, n_shards: int = 8, *more: str) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, more columns, hilbert, shard and slot; dimensions: language, source, size. The text stays out of the shuffle."""
    dims = {c: F.col(c) for c in ("lang", "source", "size")}
    return hilbert_shards(metadata(documents, *more), "doc_id", dims, n_shards, ["size", "text_crc32"])


def write_shards(documents: DataFrame, path: str, n_shards: int = 8, file_rows: int = 100_000) -> None:
    """Write all rows of documents, a folder per shard and in it one per run of file_rows neighbours on the curve: readers prune by the files' min/max.

    Rows are named by their place in a written copy, so that repeated and null ids are rows like any other. Texts are shuffled twice.
    """
    columns = [c for c in documents.columns if c not in ("hilbert", "shard", "slot", "part")]
    rows = materialize(documents.select(*columns).withColumn("__row", F.monotonically_increasing_id()), "shard-input")
    placed = shard_documents(rows, n_shards, "__row").select("__row", "hilbert", "shard", "slot", F.floor(F.col("slot") / file_rows).alias("part"))
    parts = n_shards * max(1, -(-rows.count() // (n_shards * file_rows)))
    out = rows.join(placed, "__row").drop("__row").repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "slot")
    out.write.partitionBy("shard", "part").parquet(path)
