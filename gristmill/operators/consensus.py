"""Multi-source consensus: findings of several models that mean the same place and problem.

A finding f of model i marks, in each later model j, the first finding that matches it, and both count as
found by more than one model. Two ranges of lines overlap if the start of one lies in the other. So each range becomes the few dyadic blocks that make it up, and each
start the blocks that hold it: a range and a start in it share just one block. In a block only the first finding of each model, title
and category can be a first match, and all with one title and category match alike. So blocks are reduced to these before anything is paired: a hot file costs in proportion to its findings,
whatever their ranges, and pairs are of different titles at one place only.

A range can be inverted (an end of 0 is common). It overlaps a range that holds both its ends, and no other; such findings are paired as they are, where a range holds their end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import dyadic_nodes, dyadic_path, lines_overlap, same_problem, trim_space, words_of
from gristmill.operators.findings import dedupe
from gristmill.sources.shared import materialize

KEYS = ["run_id", "model_idx", "ord"]
PLACE = ["run_id", "path", "level", "node"]
SAID = ["model_idx", "title", "category"]


def worded(rows: DataFrame) -> DataFrame:
    """rows with what titles are compared by."""
    key = F.lower(trim_space(F.col("title")))
    return rows.withColumn("title_key", key).withColumn("title_words", words_of(key))


def blocks_of(findings: DataFrame) -> DataFrame:
    """A row for each block of each finding. role: range (makes up its lines), start (holds its first line) or end (of an inverted range: holds its end)."""
    rows = findings.select(*KEYS, "path", "start_line", "end_line", "title", "category")
    # no block of a file is larger than its longest range
    length = F.when(F.col("start_line") <= F.col("end_line"), F.col("end_line").cast("long") - F.col("start_line") + 1)
    tops = rows.groupBy("run_id", "path").agg(F.floor(F.log2(F.max(length).cast("double"))).cast("int").alias("top")).where("top is not null")
    of = lambda role, nodes: F.transform(nodes, lambda n: F.struct(F.lit(role).alias("role"), n["level"].alias("level"), n["node"].alias("node")))
    plain = F.concat(of("range", dyadic_nodes(F.col("start_line"), F.col("end_line"))), of("start", dyadic_path(F.col("start_line"), F.col("top"))))
    blocks = F.when(F.col("start_line") <= F.col("end_line"), plain).when(F.col("start_line") > F.col("end_line"), of("end", dyadic_path(F.col("end_line"), F.col("top"))))
    each = rows.join(tops, ["run_id", "path"]).select("run_id", "path", *SAID, "ord", "start_line", "end_line", F.explode(blocks).alias("__b"))
    return each.select("__b.*", "run_id", "path", *SAID, "ord", "start_line", "end_line")


def first_last(x: str, y: str, name: str) -> tuple[Column, Column]:
    """A column of that of x and y whose model comes first, and of the other one."""
    turn = F.col(f"{x}.model_idx") < F.col(f"{y}.model_idx")
    return F.when(turn, F.col(f"{x}.{name}")).otherwise(F.col(f"{y}.{name}")), F.when(turn, F.col(f"{y}.{name}")).otherwise(F.col(f"{x}.{name}"))


def meeting(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of x and y of different models in one block that mean one problem."""
    cond = F.when(F.col("x.model_idx") < F.col("y.model_idx"), same_problem("x", "y")).when(F.col("x.model_idx") > F.col("y.model_idx"), same_problem("y", "x"))
    for c in reversed(PLACE):
        cond = (F.col(f"x.{c}") == F.col(f"y.{c}")) & cond
    return x.alias("x").join(y.alias("y"), cond)


def matches(findings: DataFrame) -> DataFrame:
    """(run_id, fm, fo, gm, go): finding f marks g, the first match in a later model."""
    blocks = materialize(blocks_of(findings), "consensus-blocks")
    firsts = blocks.where("role <> 'end'").groupBy("role", *PLACE, *SAID).agg(F.min("ord").alias("ord"))
    met = meeting(*(worded(firsts.where(F.col("role") == r)) for r in ("range", "start")))
    said = {c: first_last("x", "y", c) for c in ("role", *SAID, "ord")}
    met = met.select(*[F.col(f"x.{c}").alias(c) for c in PLACE], *[said[c][0].alias(c) for c in ("role", *SAID)], said["model_idx"][1].alias("gm"), said["ord"][1].alias("go"))
    met = met.groupBy("role", *PLACE, *SAID, "gm").agg(F.min("go").alias("go"))
    # titles and categories were grouped, nulls too
    cond = F.lit(True)
    for c in ("role", *PLACE, *SAID):
        cond = cond & (F.col(f"b.{c}").eqNullSafe(F.col(f"m.{c}")) if c in ("title", "category") else F.col(f"b.{c}") == F.col(f"m.{c}"))
    plain = blocks.alias("b").join(met.alias("m"), cond).select("b.run_id", F.col("b.model_idx").alias("fm"), F.col("b.ord").alias("fo"), "m.gm", "m.go")
    overlap = lines_overlap(*(F.col(c) for c in ("x.start_line", "x.end_line", "y.start_line", "y.end_line")))
    inverted = meeting(worded(blocks.where("role = 'end'")), worded(blocks.where("role = 'range' and start_line < end_line"))).where(overlap)
    (fm, gm), (fo, go) = said["model_idx"], said["ord"]
    inverted = inverted.select(F.col("x.run_id").alias("run_id"), fm.alias("fm"), fo.alias("fo"), gm.alias("gm"), go.alias("go"))
    # the first match is a minimum: partial aggregation, no window, repeats of a pair do not matter
    return plain.unionByName(inverted).groupBy("run_id", "fm", "fo", "gm").agg(F.min("go").alias("go"))


def merge(findings: DataFrame) -> DataFrame:
    """findings with is_consensus and consensus_first (it speaks for its place and category in the consensus list)."""
    met = materialize(matches(findings), "consensus-matches")  # read from either side
    marked = met.select("run_id", F.col("fm").alias("model_idx"), F.col("fo").alias("ord")).unionByName(met.select("run_id", F.col("gm").alias("model_idx"), F.col("go").alias("ord"))).distinct()
    rows = findings.join(marked.withColumn("__m", F.lit(True)), KEYS, "left").withColumn("is_consensus", F.coalesce("__m", F.lit(False))).drop("__m")
    place = ["run_id", "path", "start_line", "category"]
    speakers = dedupe(rows.where("is_consensus").select(*place, "model_idx", "ord"), place, ["model_idx", "ord"])
    speakers = speakers.select(*KEYS).withColumn("__s", F.lit(True))
    return rows.join(speakers, KEYS, "left").withColumn("consensus_first", F.coalesce("__s", F.lit(False))).drop("__s")


def compare_counts(merged: DataFrame) -> DataFrame:
    """By run: models, findings, consensus (deduplicated) and by label the unique ones."""
    return merged.groupBy("run_id", "model_idx").agg(F.count("*").alias("n_total"), F.count_if(F.col("consensus_first")).alias("n_consensus"), F.count_if(~F.col("is_consensus")).alias("n_unique"))
