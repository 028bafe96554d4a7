"""What changed between two runs: findings that are new, fixed or kept, as multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.hunks import carry

#: What makes two findings of different runs the same, where nothing else is said.
SAME = ["path", "title", "category"]


def new_findings(before: DataFrame, after: DataFrame, key: list[str] = SAME) -> DataFrame:
    """Keys of after beyond those of before, each as often as it occurs more."""
    return after.select(*key).exceptAll(before.select(*key))


def fixed_findings(before: DataFrame, after: DataFrame, key: list[str] = SAME) -> DataFrame:
    return before.select(*key).exceptAll(after.select(*key))


def kept_findings(before: DataFrame, after: DataFrame, key: list[str] = SAME) -> DataFrame:
    """Keys of both, each as often as both have it."""
    return before.select(*key).intersectAll(after.select(*key))


def changes(before: DataFrame, after: DataFrame, key: list[str] = SAME) -> DataFrame:
    """A row for each key: n_before, n_after, n_new, n_fixed, n_kept. Counts combine before the only shuffle, so a hot key is one row a task; nulls are equal."""
    side = lambda x, b: x.select(*key, F.lit(b).alias("__b"), F.lit(1 - b).alias("__a"))
    rows = side(before, 1).unionByName(side(after, 0)).groupBy(*key).agg(F.sum("__b").alias("n_before"), F.sum("__a").alias("n_after"))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0).cast("long"))
    return rows.select(*key, "n_before", "n_after", more("n_after", "n_before").alias("n_new"), more("n_before", "n_after").alias("n_fixed"), F.least("n_before", "n_after").alias("n_kept"))


def totals(changed: DataFrame, by: list[str | Column]) -> DataFrame:
    return changed.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_new", "n_fixed", "n_kept")])


def changes_across(before: DataFrame, after: DataFrame, sections: DataFrame, key: list[str] = ("path", "title", "start_line")) -> DataFrame:
    """changes() of findings on either side of a diff: those before it are carried to its new side first; what it deletes is fixed."""
    moved = carry(before, sections)
    moved = moved.withColumn("path", F.coalesce("new_path", "path")).withColumn("start_line", F.when(F.col("survives"), F.col("new_start")))
    return changes(moved, after, list(key))
