"""Hunks of a diff: which lines survive and where they go, so that findings keep their identity when lines move.

A section's hunks become its line map: stretches of old lines that stay, each with the shift to its new numbers; the last one is open. Findings look their lines up in it by an as-of join, which
makes no pairs however many findings and stretches a file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import trim_space
from gristmill.operators.asof import asof_join
from gristmill.sources.shared import materialize

HUNK = r"(?dm)(?=^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
HEADER = r"(?d)\A@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)"
#: End of an open stretch.
LAST = (1 << 31) - 1


def hunks_of(body: Column) -> Column:
    """Hunks of a section in order: old_start, old_len, new_start, new_len, context (what follows the header), lines (each with its mark)."""
    def parse(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, HEADER, i)
        length = lambda i: F.when(part(i) == "", 1).otherwise(part(i).cast("int"))
        lines = F.slice(F.split(F.regexp_replace(text, r"\n+\z", ""), "\n", -1), 2, 1 << 30)
        return F.struct(part(1).cast("int").alias("old_start"), length(2).alias("old_len"), part(3).cast("int").alias("new_start"), length(4).alias("new_len"), part(5).alias("context"), F.filter(lines, lambda x: ~x.startswith("\\")).alias("lines"))

    return F.transform(F.filter(F.split(body, HUNK, -1), lambda x: x.startswith("@@ -")), parse)


def first_line(start: Column, length: Column) -> Column:
    """Number of a hunk's first line on one side; a side without lines names the line before."""
    return F.when(length == 0, start + 1).otherwise(start)


def blocks_of(lines: Column) -> Column:
    """Runs of kept and of changed lines: kept, how many, and how many of a changed run's are old and new."""
    marks = F.array_join(F.transform(lines, lambda x: F.when(x == "", " ").otherwise(F.substring(x, 1, 1))), "")
    count = lambda x, mark: F.char_length(x) - F.char_length(F.replace(x, F.lit(mark), F.lit("")))
    return F.transform(F.regexp_extract_all(marks, F.lit("([ ]+|[-+]+)"), 1), lambda x: F.struct((count(x, "+") + count(x, " ")).alias("new"), (count(x, "-") + count(x, " ")).alias("old"), x.startswith(" ").alias("kept")))


def line_map_of(body: Column) -> Column:
    """Stretches (old_from, old_to, shift) of old lines that stay, in order."""
    void = F.array().cast("array<struct<old_from:int,old_to:int,shift:int>>")
    at = lambda old, new, out: F.struct(old.cast("int").alias("old"), new.cast("int").alias("new"), out.alias("out"))
    stretch = lambda a, b, shift: F.array(F.struct(a.cast("int").alias("old_from"), b.cast("int").alias("old_to"), shift.cast("int").alias("shift")))

    def block(s: Column, b: Column) -> Column:
        return at(s["old"] + b["old"], s["new"] + b["new"], F.when(b["kept"], F.concat(s["out"], stretch(s["old"], s["old"] + b["old"] - 1, s["new"] - s["old"]))).otherwise(s["out"]))

    def hunk(s: Column, h: Column) -> Column:
        old, new = first_line(h["old_start"], h["old_len"]), first_line(h["new_start"], h["new_len"])
        before = F.when(s["old"] < old, F.concat(s["out"], stretch(s["old"], old - 1, s["new"] - s["old"]))).otherwise(s["out"])
        return F.aggregate(blocks_of(h["lines"]), at(old, new, before), block)

    whole = F.aggregate(hunks_of(body), at(F.lit(1), F.lit(1), void), hunk)
    return F.transform(F.array(whole), lambda s: F.concat(s["out"], stretch(s["old"], F.lit(LAST), s["new"] - s["old"])))[0]


def paths_of(body: Column) -> tuple[Column, Column]:
    """Old and new path; '' on a side on which the file isn't there."""
    head = F.regexp_extract(body, r"(?ds)\A(.*?)(?:\n@@ |\z)", 1)
    part = lambda p: F.regexp_extract(head, p, 1)
    moved = head.rlike(r"(?dm)^rename from ")
    old = F.when(moved, part(r"(?dm)^rename from (.*)$")).otherwise(part(r"(?dm)^--- a/(.*)$"))
    return old, F.when(moved, part(r"(?dm)^rename to (.*)$")).otherwise(part(r"(?dm)^\+\+\+ b/(.*)$"))


def line_maps(sections: DataFrame) -> DataFrame:
    """(run_id, old_path, new_path, old_from, old_to, shift, next_from, next_shift): stretches of all sections (run_id, body); a deleted file has none that stays. next: the stretch after it."""
    old, new = paths_of(F.col("body"))
    rows = sections.select("run_id", old.alias("old_path"), new.alias("new_path"), line_map_of(F.col("body")).alias("m")).where("old_path <> ''")
    # before the first line, so that each line of a changed file finds something
    first = F.array(F.struct(F.lit(-LAST).alias("old_from"), F.lit(-LAST).alias("old_to"), F.lit(0).alias("shift")))
    each = rows.withColumn("m", F.when(F.col("new_path") == "", first).otherwise(F.concat(first, "m")))
    each = each.select("run_id", "old_path", "new_path", F.explode(F.transform("m", lambda x, i: F.struct(x.alias("x"), F.get("m", i + 1).alias("y")))).alias("s"))
    return each.select("run_id", "old_path", "new_path", "s.x.*", F.col("s.y.old_from").alias("next_from"), F.col("s.y.shift").alias("next_shift"))


def carry(findings: DataFrame, sections: DataFrame, **how) -> DataFrame:
    """findings (run_id, path, start_line, end_line, ...) of the old side with new_path, new_start, new_end and survives, on the new side of the diff in sections (run_id, body).

    A finding survives if a line of its range does; its new range runs from the first such line to the last one. An end before the start counts as the start. In a file that the diff doesn't
    change everything stays; the lines of a deleted one are gone (nulls).
    """
    maps = materialize(line_maps(sections).withColumnRenamed("old_path", "path").withColumn("seen", F.lit(True)), "line-maps")
    rows = findings.withColumn("__end", F.greatest("start_line", "end_line"))
    take = lambda p, names: {c: f"__{p}_{c}" for c in names}
    rows = asof_join(rows, maps, ["run_id", "path"], "start_line", "old_from", take("s", ["seen", "new_path", "old_to", "shift", "next_from", "next_shift"]), **how)
    rows = asof_join(rows, maps, ["run_id", "path"], "__end", "old_from", take("e", ["old_to", "shift"]), **how)
    kept = F.col("start_line") <= F.col("__s_old_to")
    start = F.when(kept, F.col("start_line") + F.col("__s_shift")).when(F.col("__s_next_from") <= F.col("__end"), F.col("__s_next_from") + F.col("__s_next_shift"))
    end = F.least("__end", "__e_old_to") + F.col("__e_shift")
    changed = F.col("__s_seen").isNotNull()
    rows = rows.withColumn("new_start", F.when(changed, start).otherwise(F.col("start_line"))).withColumn("new_end", F.when(~changed, F.col("__end")).when(F.col("new_start").isNotNull(), end))
    rows = rows.withColumn("survives", F.col("new_start").isNotNull()).withColumn("new_path", F.when(F.col("survives"), F.when(changed, F.col("__s_new_path")).otherwise(F.col("path"))))
    return rows.select(*findings.columns, "new_path", *[F.col(c).cast("int").alias(c) for c in ("new_start", "new_end")], "survives")


def new_lines(sections: DataFrame) -> DataFrame:
    """(run_id, path, line, text): lines of the new side that hunks show."""
    _, new = paths_of(F.col("body"))
    rows = sections.select("run_id", new.alias("path"), F.explode(hunks_of(F.col("body"))).alias("h")).where("path <> ''")
    shown = F.filter("h.lines", lambda x: ~x.startswith("-"))
    rows = rows.select("run_id", "path", first_line(F.col("h.new_start"), F.col("h.new_len")).alias("at"), F.posexplode(shown).alias("i", "text"))
    return rows.select("run_id", "path", (F.col("at") + F.col("i")).alias("line"), F.substring("text", 2, 1 << 30).alias("text"))


def with_stable_ids(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """findings with stable_id: of path, title and the text of their first line as the diff shows it, so that it stays when lines move.

    Of several findings with one title on equal lines of a file each has the same id; a line that no hunk shows is told by its number.
    """
    texts = new_lines(sections).groupBy("run_id", "path", F.col("line").alias("start_line")).agg(F.min("text").alias("__text"))
    rows = findings.join(texts, ["run_id", "path", "start_line"], "left")
    context = F.coalesce(F.concat(F.lit("="), trim_space(F.col("__text"))), F.col("start_line").cast("string"))
    return rows.select(*findings.columns, F.substring(F.sha2(F.concat_ws(":", "path", "title", context), 256), 1, 16).alias("stable_id"))
