"""Diff sections: splitting, paths, filters, byte budgets and synthetic diffs, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import fixed, globs
from gristmill.functions.expr import truncate_bytes, trim_space

#: Before each line that starts a section; UNIX line ends only (flag d), as a lone \r ends no line.
HEADER = r"(?dm)(?=^diff --git)"
PATH = r"(?dm)^\+\+\+ b/(.*)$"


def section_path(body: Column) -> Column:
    """'' for deletions, binaries and text before the first header."""
    return F.regexp_extract(body, PATH, 1)


def split_sections(diffs: DataFrame, diff: str = "diff", drop_blank: bool = False) -> DataFrame:
    """A row (…, section_ord, path, body, n_bytes) per section. Every line ends in a line feed, so the last section gains one.

    drop_blank leaves out sections of white space only, as chunking does.
    """
    keep = [c for c in diffs.columns if c != diff]
    parts = F.filter(F.split(F.concat(F.col(diff), F.lit("\n")), HEADER, -1), lambda x: x != "")
    rows = diffs.select(*keep, F.posexplode(parts).alias("section_ord", "body"))
    rows = rows.select(*keep, "section_ord", section_path(F.col("body")).alias("path"), "body", F.octet_length("body").alias("n_bytes"))
    return rows.where(trim_space(F.col("body")) != "") if drop_blank else rows


def diff_files(diff: Column) -> Column:
    """Paths of a diff, distinct, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(diff, F.lit(PATH), 1), lambda p: p != ""))


def exclude_sections(sections: DataFrame, exclude: list[str], recursive: bool = False) -> DataFrame:
    """Without sections whose path matches; those without a path stay."""
    return sections.where((F.col("path") == "") | ~globs.matches_any(F.col("path"), exclude, recursive=recursive))


def exclude_files(files: Column, exclude: list[str]) -> Column:
    return F.filter(files, lambda p: ~globs.matches_any(p, exclude))


def include_paths(rows: DataFrame, include: list[str], path: str = "path") -> DataFrame:
    """No list, or one with **/*, lets everything in."""
    return rows if not include or "**/*" in include else rows.where(globs.matches_any(F.col(path), include))


def limit_diff(diff: Column, max_bytes: int) -> Column:
    """The first max_bytes bytes and a notice; after all filters."""
    cut = F.concat(truncate_bytes(diff, max_bytes), F.lit(f"\n... [diff truncated at {max_bytes} bytes]\n"))
    return F.when(F.octet_length(diff) > max_bytes, cut).otherwise(diff) if max_bytes > 0 else diff


def needs_chunking(diff: Column) -> Column:
    return F.octet_length(diff) > fixed.CHUNK_TRIGGER_BYTES


def is_blank(diff: Column) -> Column:
    return trim_space(diff) == ""


def added_diff(path: Column, content: Column) -> Column:
    """A diff that adds all of content as a new file."""
    lines = F.split(content, "\n", -1)
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"))


def budget_prefix(files: DataFrame, max_bytes: int, size: str, order: str, run: str = "run_id") -> DataFrame:
    """Each run's files in order up to the first that exceeds the budget; that one and all after it go. One task a run, as the order is the run's."""
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return files.withColumn("bytes_so_far", F.sum(size).over(upto)).where(F.col("bytes_so_far") <= max_bytes)


def codebase_sections(files: DataFrame, max_bytes: int, include: list[str], exclude: list[str]) -> DataFrame:
    """Sections for whole files (run_id, path, content binary, length): no binaries, none over 1 MiB, then the budget on section bytes."""
    files = include_paths(files.where(F.col("length") <= fixed.FILE_BYTES), include)
    files = files.where(~globs.matches_any(F.col("path"), exclude)).where(~is_binary(F.col("content")))
    rows = files.select("run_id", "path", added_diff(F.col("path"), F.decode("content", "UTF-8")).alias("body"))
    return budget_prefix(rows.withColumn("n_bytes", F.octet_length("body")), max_bytes, "n_bytes", "path")


def numbered(sections: DataFrame) -> DataFrame:
    """sections with section_ord in path order. One task a run, as packing goes through a run in order; only paths and numbers are sorted with their bodies within a byte budget."""
    return sections.withColumn("section_ord", F.row_number().over(Window.partitionBy("run_id").orderBy("path")) - 1)


def is_binary(content: Column) -> Column:
    """A NUL among the first 8000 bytes: git's own guess, not its diff's verdict."""
    return F.locate("\0", F.decode(F.substring(content, 1, 8000), "ISO-8859-1")) > 0
