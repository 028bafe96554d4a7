"""As-of join: each row with the last row of another table that is not after it.

Both tables are put below each other and sorted by key and time, and the last right row is carried down to the left ones: one shuffle, no pairs. A key
with over ``HOT_ROWS`` rows is cut into ``RANGES`` ranges of time of about as many rows each, so that several tasks sort it; what the ranges before one leave is carried over to its first rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.shared import materialize

HOT_ROWS, RANGES = 2_000_000, 256


def hot_bounds(rows: DataFrame, hot_rows: int, ranges: int) -> DataFrame | None:
    """(__k, __bounds): for each hot key the times at which it is cut; None if there is none."""
    hot = rows.groupBy("__k").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("__k")
    hot = materialize(hot, "asof-hot")
    if hot.isEmpty():
        return None
    cuts = F.percentile_approx("__t", [i / ranges for i in range(1, ranges)], 100 * ranges)
    return materialize(rows.join(hot, "__k").groupBy("__k").agg(F.array_distinct(cuts).alias("__bounds")), "asof-bounds")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, right_time: str, take: dict[str, str], ties: list[str | Column] = (), strict: bool = False, hot_rows: int = HOT_ROWS, ranges: int = RANGES) -> DataFrame:
    """left with columns of the last right row of the same key whose time is not later (strict: earlier).

    take: new names of right's columns. Of right rows with one time the last by ties counts, so ties should tell them apart. A left row without such a row, or with a null key or time, gets
    nulls; right rows with null keys or times are no one's. on may be empty: all rows are of one key then.
    """
    if clash := set(take.values()) & set(left.columns):
        raise ValueError(f"left has columns named {', '.join(sorted(clash))}")
    key = F.struct(*[F.col(c) for c in on]) if on else F.struct(F.lit(0).alias("one"))
    found = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in ties], F.lit(0).alias("__0"))
    ours = left.select(key.alias("__k"), F.col(time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__left"))
    theirs = right.where(F.col(right_time).isNotNull()).select(key.alias("__k"), F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), order.alias("__ties"), found.alias("__right"))
    for c in on:
        theirs = theirs.where(F.col(f"__k.{c}").isNotNull())
    rows = ours.unionByName(theirs, allowMissingColumns=True)
    bounds = hot_bounds(rows.select("__k", "__t"), hot_rows, ranges)
    if bounds is None:
        parts = ["__k"]
    else:
        parts = ["__k", "__range"]
        before = F.size(F.filter("__bounds", lambda b: b < F.col("__t")))
        rows = rows.join(bounds, "__k", "left").withColumn("__range", F.when(F.col("__bounds").isNull() | F.col("__t").isNull(), 0).otherwise(before)).drop("__bounds")
    upto = Window.partitionBy(*parts).orderBy("__t", "__side", "__ties").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__last", F.last("__right", ignorenulls=True).over(upto)).where(F.col("__left").isNotNull())
    if bounds is not None:
        last = rows.groupBy(*parts).agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__ties"))).alias("__right"))
        earlier = Window.partitionBy("__k").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        start = last.withColumn("__start", F.last("__right", ignorenulls=True).over(earlier)).where("__range > 0 and __start is not null").select(*parts, "__start")
        out = out.join(start, parts, "left").withColumn("__last", F.coalesce("__last", "__start"))
    asked = F.col("__t").isNotNull()
    for c in on:
        asked = asked & F.col(f"__k.{c}").isNotNull()
    return out.select(*[F.col("__left")[c].alias(c) for c in left.columns], *[F.when(asked, F.col("__last")[n]).alias(n) for n in take.values()])
