"""Findings: parsing model answers, identity, deduplication, overrides, ranking, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import fixed
from gristmill.functions.expr import finding_id, meets_threshold, rule_id, sarif_level, severity_rank, trim_space, whole_json

#: What orders findings of a run when nothing else does.
POSITION = ["model_idx", "chunk_idx", "ord"]


def strip_fence(content: Column) -> Column:
    """Without one ``` fence: the first line, and the last if it is a fence too. An empty fence is an empty list. What begins and ends as a list has none, and no space to trim."""
    text = trim_space(content)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A```[^\n]*\n?", ""), r"(?s)\n?[^\S\n]*```[^\S\n]*\z", "")
    body = trim_space(F.when(text.startswith("```"), body).otherwise(text))
    return F.when(content.startswith("[") & content.endswith("]"), content).when(body == "", F.when(text.startswith("```"), F.lit("[]")).otherwise(F.lit(""))).otherwise(body)


#: JSON type of each field; integers are numbers without a fraction.
KINDS = {"severity": "STRING", "category": "STRING", "title": "STRING", "message": "STRING", "suggestion": "STRING", "path": "STRING", "confidence": "NUMBER", "startLine": "INT", "endLine": "INT", "tags": "ARRAY"}


#: An element of an answer: as it is meant, and each field as it is in the JSON text.
TYPES = {"STRING": "string", "NUMBER": "double", "INT": "int", "ARRAY": "array<string>"}
TYPED = f"array<struct<{', '.join(f'{k}: {TYPES[v]}' for k, v in KINDS.items())}>>"
ITEMS = f"array<struct<{', '.join(f'{k}: variant' for k in KINDS)}>>"
#: The common schema of elements that have known fields of the right types and no others.
FITTING = {"STRING": "STRING|VOID", "NUMBER": r"BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT|VOID", "INT": "BIGINT|VOID", "ARRAY": "ARRAY<STRING>|VOID"}
FIELD = f"(?:{'|'.join(f'{k}: (?:{FITTING[v]})' for k, v in KINDS.items())})"
PLAIN = rf"\AARRAY<OBJECT<{FIELD}(?:, {FIELD})*>>\z"


def typed_items(items: Column) -> Column:
    """ITEMS as TYPED if the known fields of all elements have the right JSON types (or are absent or null); else null. Numbers beyond their type are null."""

    def fits(x: Column) -> Column:
        ok = x.isNotNull()
        for name, want in KINDS.items():
            part = F.schema_of_variant(x[name])
            good = {"STRING": part == "STRING", "NUMBER": part.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "INT": part == "BIGINT", "ARRAY": part.isin("ARRAY<STRING>", "ARRAY<VOID>")}[want]
            ok = ok & (part.isNull() | (part == "VOID") | good)
        return F.coalesce(ok, F.lit(False))

    whole = lambda x: F.struct(*[F.try_variant_get(x[k], "$", TYPES[v]).alias(k) for k, v in KINDS.items()])
    return F.when(F.forall(items, fits), F.transform(items, whole))


def answer_items(text: Column) -> Column:
    """The elements of a JSON array of objects whose known fields have the right types, as TYPED; null for anything else. The text null has none.

    One look at the schema that all elements have in common judges most answers; only where that leaves a doubt (other fields, mixed or missing types) each field of each element is judged.
    """

    def judged(w: Column) -> Column:
        plain = F.when(F.schema_of_variant(w).rlike(PLAIN), F.try_variant_get(w, "$", TYPED))
        # bound by a transform, as an expression in a lambda is made as often as it is named
        whole = F.get(F.transform(F.array(plain), lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), p)), 0)
        return F.coalesce(whole, typed_items(F.try_variant_get(w, "$", ITEMS)))

    found = F.get(F.transform(F.array(whole_json(text)), judged), 0)
    return F.when(text == "null", F.array().cast(TYPED)).otherwise(found)


def valid_answer(text: Column) -> Column:
    """null, or an array of objects whose known fields have the right JSON types."""
    return answer_items(text).isNotNull()


def parse_findings(answers: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Canonical findings of valid answers, and the invalid answers. Absent fields are '' or 0, as in the wire format."""
    # exploded, as what an explode makes is made once, however often it is read
    rows = answers.withColumn("__items", F.explode(F.transform(F.array(strip_fence(F.col(content))), answer_items)))
    keep = [c for c in answers.columns if c != content]
    each = rows.where("__items is not null").select(*keep, F.posexplode("__items").alias("ord", "f"))
    value = lambda c, absent: F.coalesce(F.col(f"f.{c}"), absent)
    text = {c: value(c, F.lit("")) for c in ("severity", "category", "title", "message", "suggestion", "path")}
    found = each.select(*keep, "ord", *[v.alias(k) for k, v in text.items()], value("confidence", F.lit(0.0)).alias("confidence"), value("startLine", F.lit(0)).alias("start_line"), value("endLine", F.lit(0)).alias("end_line"), value("tags", F.array().cast("array<string>")).alias("tags"))
    names = [*keep, "ord", "id", *text, "confidence", "start_line", "end_line", "tags"]
    found = found.withColumn("id", finding_id(F.col("path"), F.col("title"), F.col("start_line"))).select(*names)
    return found, rows.where("__items is null").drop("__items")


def raw_json(findings: DataFrame) -> Column:
    """A finding back as wire JSON; what the wire has no field for is lost."""
    return F.to_json(F.struct("severity", "category", "title", "message", "suggestion", "confidence", "path", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "tags"))


def dedupe(findings: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; min_by instead of a window, so that hot keys combine before the shuffle."""
    rest = [c for c in findings.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return findings.groupBy(*key).agg(first.alias("__f")).select(*[c if c in key else F.col(f"__f.{c}").alias(c) for c in findings.columns])


def dedupe_by_id(findings: DataFrame) -> DataFrame:
    return dedupe(findings, ["run_id", "id"], [c for c in POSITION if c in findings.columns])


def rank_order(columns: list[str]) -> list[Column]:
    """Severity from high to low, path, line, then position (the reference order leaves ties open)."""
    return [severity_rank(F.col("severity")).desc(), F.col("path").asc(), F.col("start_line").asc(), *[F.col(c).asc() for c in POSITION if c in columns]]


def sort_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("run_id", *rank_order(findings.columns))


def top_k(findings: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The first k of each run; all if k is 0 or less. The rank limit is pushed below the shuffle by Spark."""
    if k <= 0:
        return findings
    w = Window.partitionBy("run_id").orderBy(*(order or rank_order(findings.columns)))
    return findings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def override_severity(findings: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severity by category where the rules say so; identities do not hold the severity and stay."""
    if not overrides:
        return findings
    table = F.create_map(*[F.lit(x) for pair in sorted(overrides.items()) for x in pair])
    return findings.withColumn("severity", F.coalesce(F.element_at(table, F.col("category")), F.col("severity")))


def counts(prefix: str = "n_") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{s}") for s in reversed(fixed.SEVERITIES)]


def summarize(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts by severity, the highest one ('' if none is known) and the number of findings."""
    top = F.max_by("severity", severity_rank(F.col("severity")))
    high = F.max(severity_rank(F.col("severity")))
    return findings.groupBy(*by).agg(*counts(), F.when(high > 0, top).otherwise(F.lit("")).alias("highest"), F.count("*").alias("n_findings"))


def gate(findings: DataFrame, threshold: str, by: list[str]) -> DataFrame:
    """Exit code 1 where any finding meets the threshold, else 0."""
    hit = F.bool_or(meets_threshold(F.col("severity"), F.lit(threshold)))
    return findings.groupBy(*by).agg(F.when(hit, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"))


def per_commit(findings: DataFrame, max_findings: int) -> DataFrame:
    """One report over many commits: the earliest commit keeps a finding, shas are cut to seven characters, then ranked and limited."""
    first = dedupe(findings, ["run_id", "id"], ["commit_ord", *[c for c in POSITION if c in findings.columns]])
    return top_k(first.withColumn("commit", F.substring("commit", 1, 7)), max_findings)


def sarif_rules(findings: DataFrame, prefix: str) -> DataFrame:
    """(run_id, rule_id, name, text, level, rule_ord): each rule as its first finding has it."""
    rows = findings.withColumn("rule_id", rule_id(prefix, F.col("category"), F.col("title"))).withColumn("level", sarif_level(F.col("severity")))
    position = [c for c in POSITION if c in findings.columns]
    first = dedupe(rows.select("run_id", "rule_id", "category", "title", "level", *position), ["run_id", "rule_id"], position)
    return first.select("run_id", "rule_id", F.col("category").alias("name"), F.col("title").alias("text"), "level", *position)


def split_inline(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with inline_line: the line for a comment in the diff, null for those that belong in the body.

    files: (run_id, path) of the diff. A finding needs a known path and a line (its end, else its start).
    """
    line = F.when(F.col("end_line") != 0, F.col("end_line")).otherwise(F.col("start_line"))
    known = files.select("run_id", "path").distinct().withColumn("__in", F.lit(True))
    rows = findings.join(known, ["run_id", "path"], "left")
    return rows.withColumn("inline_line", F.when(F.col("__in") & (F.col("path") != "") & (line != 0), line)).drop("__in")
