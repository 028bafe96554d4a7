"""What the operators share: the shared folder, materialised tables, ASCII words in native SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources.shared import materialize, scratch, shared_base, shared_folder  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of words: space and \x09 to \x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def open_store(uri: str):
    """File system and path for a URI of any store that pyarrow knows; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is that for pure ASCII, and much faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, delimiters: str) -> Column:
    """Words between runs of the delimiter class; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), delimiters), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A set of keys up to this many rows is broadcast, at some 60 bytes a row.
BROADCAST_KEYS = 500_000


def without(rows: DataFrame, keys: DataFrame, on: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """rows whose column on is not among keys (distinct, as a table; null is among none). Few keys are broadcast, so that texts stay where they are; many are met by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, on, "left_anti")
