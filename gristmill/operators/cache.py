"""Answers kept by content hash: lookup with an age limit, misses, appending, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.schemas import CACHE_ENTRY


def fresh(created_at: Column, now: Column, ttl_seconds: int) -> Column:
    """By the reader's age limit; none if it is 0 or less."""
    return F.lit(True) if ttl_seconds <= 0 else F.unix_timestamp(now) - F.unix_timestamp(created_at) <= ttl_seconds


def lookup(requests: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """requests (with key) and the newest fresh response, null for a miss."""
    newest = entries.where(fresh(F.col("created_at"), now, ttl_seconds) & F.col("response").isNotNull()).groupBy("key").agg(F.max_by("response", "created_at").alias("response"))
    return requests.join(newest, "key", "left")


def misses(requests: DataFrame, entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return requests.join(entries.where(fresh(F.col("created_at"), now, ttl_seconds) & F.col("response").isNotNull()), "key", "left_anti")


def stats(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("response")), F.lit(0)).alias("total_bytes"), F.count_if(~fresh(F.col("created_at"), now, ttl_seconds)).alias("expired"))


class ResultCache:
    """A Parquet table of entries, by day of creation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(T.StructType([*CACHE_ENTRY.fields, T.StructField("day", T.DateType())])).parquet(self.path).drop("day")
        except AnalysisException:
            return self.spark.createDataFrame([], CACHE_ENTRY)

    def put(self, entries: DataFrame) -> None:
        entries.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], CACHE_ENTRY).withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(self.path)
