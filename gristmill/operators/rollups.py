"""Aggregates at several levels, and over moving spans of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts of distinct values err by about 1.04 / sqrt(2 ** LG_NODES) (one standard deviation).
LG_NODES = 12


def base_rollup(findings: DataFrame, by: list[str], distinct: str, measure: str) -> DataFrame:
    """The one pass over the data: for each combination of by, a count, sums and extremes, and sketches of distinct and measure that can be joined again.

    Rows of a hot combination combine in the tasks that read them. A table of these can be kept and added to by day.
    """
    value = F.col(measure).cast("double")
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.hll_sketch_agg(distinct, LG_NODES).alias("kinds"), F.kll_sketch_agg_double(value).alias("values"))


def cube_of(base: DataFrame, by: list[str], quantiles: list[float] = (0.5, 0.9)) -> DataFrame:
    """All levels of base_rollup(): by (null where a level leaves a column out), level (grouping_id), n, least, most, n_distinct (estimated) and q_<quantile> (estimated; null without values)."""
    values = F.kll_merge_agg_double("values")
    rows = base.cube(*by).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_sketch_estimate(F.hll_union_agg("kinds")).alias("n_distinct"), values.alias("__values"))
    known = F.col("least").isNotNull()
    each = [F.when(known, F.kll_sketch_get_quantile_double("__values", F.lit(float(q)))).alias(f"q_{q:g}".replace(".", "_")) for q in quantiles]
    return rows.select(*by, "level", "n", "least", "most", "n_distinct", *each)


def recent_counts(findings: DataFrame, by: list[str], time: str, span: str = "7 days") -> DataFrame:
    """(by, time, n_recent): how many rows each key has in the span that ends at each of its times, that time's rows included.

    Rows of one key and time are counted first, so the window sorts one row for each of them; null times have no span and are left out.
    """
    each = findings.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.count("*").alias("__n"))
    keys = ", ".join(f"`{c}`" for c in by)
    return each.select(*by, time, F.expr(f"sum(__n) over (partition by {keys} order by `{time}` range between interval {span} preceding and current row)").alias("n_recent"))
