"""All registered queries by name, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import expr, fixed, globs
from gristmill.operators import asof, banned, cache, consensus, findings, hunks, ledger, pack, prompts, rollups, runs, schema, sections
from gristmill.operators.review import ask, errors_of, requests_for
from gristmill.sources.providers import ProviderError, Replay, Request, Response
from gristmill.sources.shared import materialize, shared_folder
from gristmill.streaming import closing, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Findings of three "models" made from events; the same text runs in Spark and DuckDB.
FINDINGS = """select cast(event_id as bigint) as seq, cast(event_id % 3 as int) as model_idx,
  case event_type when 'error' then 'high' when 'purchase' then 'medium' else 'low' end as severity,
  case event_type when 'error' then 'bug' when 'purchase' then 'security' when 'click' then 'performance' when 'view' then 'style' else 'docs' end as category,
  concat(event_type, ' anomaly ', case when value > 20 then 'large value' when value > 5 then 'mid range' else 'tiny' end) as title,
  concat('u', cast(user_id as varchar(20)), '.go') as path,
  cast(event_id % 400 as int) as start_line, cast(event_id % 400 + event_id % 7 as int) as end_line, ts
from events"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture with a run per week of events and explicit order columns."""
    f = spark.sql(FINDINGS.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return f.withColumn("run_id", F.concat(F.lit("r"), F.col("seq") % 5)).withColumn("chunk_idx", F.lit(0)).withColumn("ord", F.col("seq")).withColumn("id", expr.finding_id(F.col("path"), F.col("title"), F.col("start_line")))


F1 = f"""f as (select *, concat('r', seq % 5) as run_id, substr(sha256(concat_ws(':', path, title, start_line)), 1, 16) as id from ({FINDINGS}))"""
RANK = "case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end"
LEVEL = "case severity when 'high' then 'error' when 'medium' then 'warning' else 'note' end"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_redact(column: str) -> str:
    for p in fixed.SECRETS:
        column = f"regexp_replace({column}, {lit(p)}, '{fixed.PLACEHOLDER}', 'g')"
    return column


def sql_hits(redacted: str) -> str:
    return f"cast((length({redacted}) - length(replace({redacted}, '{fixed.PLACEHOLDER}', ''))) / {len(fixed.PLACEHOLDER)} as bigint)"


# -- redaction ----------------------------------------------------------------------------------------

@query(f"select doc_id, redacted, {sql_hits('redacted')} as n_hits from (select doc_id, {sql_redact('text')} as redacted from documents)")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", expr.redact(F.col("text")).alias("redacted"))
    return d.withColumn("n_hits", expr.hit_count(F.col("redacted")))


@query(f"select page_id, sha256(r) as redacted_sha256, {sql_hits('r')} as n_hits from (select page_id, {sql_redact('html')} as r from pages)")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", expr.redact(F.col("html")).alias("r"))
    return p.select("page_id", F.sha2("r", 256).alias("redacted_sha256"), expr.hit_count(F.col("r")).alias("n_hits"))


@query(f"select conv_id, turn, sha256(r) as redacted_sha256, {sql_hits('r')} as n_hits from (select conv_id, turn, {sql_redact('text')} as r from conversations)")
def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", expr.redact(F.col("text")).alias("r"))
    return c.select("conv_id", "turn", F.sha2("r", 256).alias("redacted_sha256"), expr.hit_count(F.col("r")).alias("n_hits"))


POLICY = ["**/src1*", "lang/**", "**/.env"]


@query(f"""with p as (select doc_id, text, concat('data/', source) as path from documents)
select doc_id, case when regexp_full_match(path, 'src1[^/]*') or regexp_full_match(path, '[^/]*/src1[^/]*') or regexp_full_match(split_part(path, '/', -1), 'src1[^/]*') then {lit(fixed.PATH_PLACEHOLDER)} else {sql_redact('text')} end as content from p""")
def redact_path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("data/"), "source"))
    return d.select("doc_id", expr.redact_content(F.col("text"), F.col("path"), POLICY).alias("content"))


@query(f"select lang, cast(count(*) filter (where n > 0) as bigint) as n_docs, cast(sum(n) as bigint) as n_hits from (select lang, {sql_hits('r')} as n from (select lang, {sql_redact('text')} as r from documents)) group by lang")
def secret_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", expr.hit_count(expr.redact(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.sum("n").alias("n_hits"))


# -- paths, languages, repositories -------------------------------------------------------------------

@query("""with p as (select page_id, regexp_extract(url, '^https?://([^?#]*)', 1) as path from pages)
select page_id, path from p where (regexp_full_match(path, '[^/]*/en/[^/]*') or regexp_full_match(path, '[^/]*/de/[^/]*')) and not (regexp_full_match(path, '[^/]*/7[^/]*') or regexp_full_match(split_part(path, '/', -1), '7[^/]*') or regexp_full_match(path, '7[^/]*'))""")
def glob_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"))
    return sections.include_paths(p, ["*/en/*", "*/de/*"]).where(~globs.matches_any(F.col("path"), ["**/7*"]))


@query(r"""with u as (select page_id, regexp_replace(url, '\.git$', '') as url from pages)
select page_id, nullif(regexp_extract(url, 'https?://[^/]+/([^/]+)/([^/.\s]+)', 1), '') as owner, nullif(regexp_extract(url, 'https?://[^/]+/([^/]+)/([^/.\s]+)', 2), '') as repo from u""")
def repo_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", expr.repo_of_url(F.col("url")).alias("r")).select("page_id", "r.owner", "r.repo")


SUFFIXES = list(fixed.LANGUAGES)
SUFFIX_SQL = f"[{', '.join(lit(s) for s in SUFFIXES)}]"


@query(f"select doc_id, case {' '.join(f'when suffix = {lit(k)} then {lit(v)}' for k, v in fixed.LANGUAGES.items())} end as language, coalesce(case {' '.join(f'when suffix = {lit(k)} then {lit(v)}' for k, v in fixed.FENCES.items())} end, '') as fence from (select doc_id, {SUFFIX_SQL}[doc_id % {len(SUFFIXES)} + 1] as suffix from documents)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/f"), F.col("doc_id"), F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(expr.languages_of(F.array(path)), 0).alias("language"), expr.fence_language(path).alias("fence"))


@query("select doc_id, instr(s, ':') > 1 and instr(s, ':') < length(s) as ok, case when instr(s, ':') > 1 and instr(s, ':') < length(s) then split_part(s, ':', 1) end as provider, case when instr(s, ':') > 1 and instr(s, ':') < length(s) then substr(s, instr(s, ':') + 1) end as model from (select doc_id, concat(case when doc_id % 3 = 0 then '' else lang end, case when doc_id % 5 = 0 then '' else ':' end, source) as s from documents)")
def model_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 5 == 0, "").otherwise(":"), "source")
    m = table(spark, sf_dir, "documents").select("doc_id", expr.model_spec(s).alias("m"))
    return m.select("doc_id", F.col("m").isNotNull().alias("ok"), "m.provider", "m.model")


# -- findings -----------------------------------------------------------------------------------------

@query(f"with {F1} select seq, id from f")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("seq", "id")


@query(f"with {F1} select seq, row_number() over (partition by run_id order by {RANK} desc, path, start_line, model_idx, seq) as pos from f")
def severity_rank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = found(spark, sf_dir)
    return f.select("seq", F.row_number().over(Window.partitionBy("run_id").orderBy(*findings.rank_order(f.columns))).cast("long").alias("pos"))


@query(f"with {F1} select run_id, id, seq, severity from f qualify row_number() over (partition by run_id, id order by model_idx, seq) = 1")
def dedupe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedupe_by_id(found(spark, sf_dir)).select("run_id", "id", "seq", "severity")


@query(f"with {F1} select seq, id, case category when 'security' then 'high' when 'docs' then 'none' else severity end as severity from f")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.override_severity(found(spark, sf_dir), {"security": "high", "docs": "none"}).select("seq", "id", "severity")


@query(f"with {F1} select run_id, seq, severity, path from f qualify row_number() over (partition by run_id order by {RANK} desc, path, start_line, model_idx, seq) <= 50")
def top_k_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.top_k(found(spark, sf_dir), 50).select("run_id", "seq", "severity", "path")


@query(f"with {F1} select run_id, model_idx, count(*) filter (where severity = 'high') as n_high, count(*) filter (where severity = 'medium') as n_medium, count(*) filter (where severity = 'low') as n_low, arg_max(severity, {RANK}) as highest, count(*) as n_findings from f group by all")
def summary_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summarize(found(spark, sf_dir), ["run_id", "model_idx"])


@query(f"with {F1} select path, t as threshold, case when t not in ('', 'none') and max({RANK}) >= case t when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 0 end then 1 else 0 end as exit_code from f, (values ('low'), ('medium'), ('high'), ('none'), ('odd')) v(t) group by path, t")
def gate_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in ("low", "medium", "high", "none", "odd")])))
    hit = F.bool_or(expr.meets_threshold(F.col("severity"), F.col("threshold")))
    return f.groupBy("path", "threshold").agg(F.when(hit, 1).otherwise(0).alias("exit_code"))


#: Title words of DuckDB.
W = "list_filter(regexp_split_to_array(lower(trim({0})), '\\s+'), lambda w: w <> '')"
SIM = f"(lower(trim(f.title)) = lower(trim(g.title)) or contains(lower(trim(f.title)), lower(trim(g.title))) or contains(lower(trim(g.title)), lower(trim(f.title))) or 2 * len(list_filter({W.format('f.title')}, lambda w: list_contains({W.format('g.title')}, w))) > least(len({W.format('f.title')}), len({W.format('g.title')})))"
CONSENSUS = f"""x as (select *, 1 as one from ({FINDINGS})),
p as (select f.seq as fs, g.seq as gs, row_number() over (partition by f.seq, g.model_idx order by g.seq) as rn
  from x f join x g on f.path = g.path and f.model_idx < g.model_idx and f.start_line <= g.end_line and g.start_line <= f.end_line
  and ({SIM} or (f.category = g.category and list_has_any({W.format('f.title')}, {W.format('g.title')})))),
m as (select fs as seq from p where rn = 1 union select gs from p where rn = 1),
c as (select x.*, m.seq is not null as is_consensus from x left join m on m.seq = x.seq),
s as (select seq from c where is_consensus qualify row_number() over (partition by path, start_line, category order by model_idx, seq) = 1),
r as (select c.*, s.seq is not null as consensus_first from c left join s on s.seq = c.seq)"""


def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).withColumn("run_id", F.lit("r"))


@query(f"with {CONSENSUS} select seq, model_idx, is_consensus, consensus_first from r where consensus_first or not is_consensus")
def consensus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.merge(one_run(spark, sf_dir)).where("consensus_first or not is_consensus").select("seq", "model_idx", "is_consensus", "consensus_first")


@query(f"with {CONSENSUS} select 'r' as run_id, model_idx, count(*) as n_total, count(*) filter (where consensus_first) as n_consensus, count(*) filter (where not is_consensus) as n_unique from r group by model_idx")
def consensus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.compare_counts(consensus.merge(one_run(spark, sf_dir)))


@query(f"with {F1} select id, seq, commit, severity, pos from (select *, row_number() over (order by {RANK} desc, path, start_line, model_idx, seq) as pos from (select *, substr(sha256(cast(cast(ts as date) as varchar)), 1, 7) as commit from f qualify row_number() over (partition by id order by cast(ts as date), model_idx, seq) = 1)) where pos <= 100")
def per_commit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.to_date("ts")
    f = one_run(spark, sf_dir).withColumn("commit_ord", F.datediff(day, F.lit("1970-01-01"))).withColumn("commit", F.sha2(day.cast("string"), 256))
    out = findings.per_commit(f, 100)
    # a hundred rows
    return out.select("id", "seq", "commit", "severity", F.row_number().over(Window.partitionBy("run_id").orderBy(*findings.rank_order(out.columns))).cast("long").alias("pos"))


@query(f"with {F1}, r as (select *, concat_ws('/', 'gristmill', category, substr(sha256(concat_ws('/', category, title)), 1, 8)) as rule_id from f) select run_id, rule_id, category as name, title as text, {LEVEL} as level, seq as first_seq from r qualify row_number() over (partition by run_id, rule_id order by model_idx, seq) = 1")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.sarif_rules(found(spark, sf_dir), "gristmill").select("run_id", "rule_id", "name", "text", "level", F.col("ord").alias("first_seq"))


@query(f"with {F1} select seq, concat_ws('/', 'gristmill', category, substr(sha256(concat_ws('/', category, title)), 1, 8)) as rule_id, {LEVEL} as level, title as message, path as uri, start_line, end_line from f")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    return f.select("seq", expr.rule_id("gristmill", F.col("category"), F.col("title")).alias("rule_id"), expr.sarif_level(F.col("severity")).alias("level"), F.col("title").alias("message"), F.col("path").alias("uri"), "start_line", "end_line")


@query(f"with {F1} select seq, case when path in (select concat('u', cast(c_custkey as varchar), '.go') from customer where c_custkey % 3 = 0) then case when end_line <> 0 then end_line when start_line <> 0 then start_line end end as inline_line from f")
def pr_inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.lit("r").alias("run_id"), F.concat(F.lit("u"), "c_custkey", F.lit(".go")).alias("path"))
    return findings.split_inline(one_run(spark, sf_dir), files).select("seq", "inline_line")


@query(f"with {F1} select seq, severity, path, start_line, id from f")
def parse_findings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings to wire JSON, one answer per run and model, and back."""
    f = found(spark, sf_dir).withColumn("message", F.col("seq").cast("string")).withColumn("suggestion", F.lit("")).withColumn("confidence", F.lit(0.5)).withColumn("tags", F.array(F.lit("t")))
    rows = f.select((F.col("seq") % 997).alias("run_id"), "seq", findings.raw_json(f).alias("j"))
    answers = rows.groupBy("run_id").agg(F.concat(F.lit("```json\n["), F.array_join(F.collect_list("j"), ","), F.lit("]\n```")).alias("content"))
    ok, _ = findings.parse_findings(answers)
    return ok.select(F.col("message").cast("long").alias("seq"), "severity", "path", "start_line", "id")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def parse_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- sections, packing, budgets -----------------------------------------------------------------------

@query("""with recursive d as (select source, doc_id, row_number() over (partition by source order by doc_id) as n, octet_length(encode(text)) as b from documents),
r as (select source, doc_id, n, 0 as chunk_idx, b as used from d where n = 1
  union all select d.source, d.doc_id, d.n, case when r.used > 0 and r.used + d.b > 5000 then r.chunk_idx + 1 else r.chunk_idx end, case when r.used > 0 and r.used + d.b > 5000 then d.b else r.used + d.b end from r join d on d.source = r.source and d.n = r.n + 1)
select source, doc_id, chunk_idx from r""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("n_bytes"))
    return pack.assign_chunks(d, 5000, order="doc_id", run="source").select("source", "doc_id", "chunk_idx")


@query("select source, doc_id, cast(s as bigint) as bytes_so_far from (select source, doc_id, sum(octet_length(encode(text))) over (partition by source order by doc_id) as s from documents) where s <= 50000")
def byte_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("n_bytes"))
    return sections.budget_prefix(d, 50_000, "n_bytes", "doc_id", run="source").select("source", "doc_id", "bytes_so_far")


@query("""with s as (select doc_id, concat('d', doc_id, '.py') as path, concat('diff --git a/d', doc_id, '.py b/d', doc_id, '.py', chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/d', doc_id, '.py', chr(10), '@@ -0,0 +1,', len(string_split(text, chr(10))), ' @@', chr(10), '+', replace(text, chr(10), chr(10) || '+'), chr(10), chr(10)) as body from documents)
select doc_id, 0 as section_ord, path, sha256(body) as body_sha256, cast(octet_length(encode(body)) as int) as n_bytes from s""")
def synthetic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as added files, split again into sections."""
    path = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py"))
    d = table(spark, sf_dir, "documents").select("doc_id", sections.added_diff(path, F.col("text")).alias("diff"))
    s = sections.split_sections(d)
    return s.select("doc_id", "section_ord", "path", F.sha2("body", 256).alias("body_sha256"), "n_bytes")


#: Whole characters of the first 200 bytes.
WHOLE = "list_max(list_filter(range(0, 201), lambda c: octet_length(encode(left(text, c))) <= 200))"


@query(f"""with c as (select doc_id, text, octet_length(encode(text)) as n, left(text, {WHOLE}) as whole from documents)
select doc_id, sha256(case when n > 200 then concat(whole, case when octet_length(encode(whole)) < 200 then chr(65533) else '' end, chr(10), '... [diff truncated at 200 bytes]', chr(10)) else text end) as limited_sha256, n > 100000 as chunked, trim(text) = '' as blank from c""")
def truncate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(sections.limit_diff(text, 200), 256).alias("limited_sha256"), sections.needs_chunking(text).alias("chunked"), sections.is_blank(text).alias("blank"))


EXCLUDE = ["vendor/**", "*.gen.py"]
PATHS = "case doc_id % 3 when 0 then concat('vendor/d', doc_id, '.py') when 1 then concat('d', doc_id, '.gen.py') else concat('lib/d', doc_id, '.py') end"


@query(f"with p as (select doc_id, {PATHS} as path from documents) select doc_id, path, 'other.py' as other from p where doc_id % 3 = 2 union all select doc_id, 'other.py' as path, 'other.py' as other from p")
def excluded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and another file as a diff; its sections and its list of files without what is excluded."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATHS).alias("p"))
    other = F.lit("other.py")
    d = d.select("doc_id", "p", F.concat(sections.added_diff(F.col("p"), F.col("text")), sections.added_diff(other, F.lit("x"))).alias("diff"))
    d = d.withColumn("files", sections.exclude_files(sections.diff_files(F.col("diff")), EXCLUDE)).drop("p")
    kept = sections.exclude_sections(sections.split_sections(d), EXCLUDE)
    return kept.select("doc_id", "path", F.element_at("files", -1).alias("other")).where(F.array_contains("files", F.col("path")))


@query("select doc_id, concat('a', doc_id, '.py,b', doc_id, '.py') as files from documents")
def files_of_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a diff with three sections of two files."""
    a, b = (F.concat(F.lit(x), F.col("doc_id"), F.lit(".py")) for x in "ab")
    diff = F.concat(sections.added_diff(a, F.col("text")), sections.added_diff(b, F.lit("x")), sections.added_diff(a, F.lit("y")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(sections.diff_files(diff), ",").alias("files"))


@query("""with p as (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from documents)
select doc_id, cast(len(p) as bigint) as n_parts, sha256(coalesce(array_to_string(p, '|'), '')) as parts_sha256 from p""")
def comma_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", expr.split_comma(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.sha2(F.array_join("p", "|"), 256).alias("parts_sha256"))


@query(f"select doc_id, {' or '.join(f'contains(text, {lit(m)})' for m in fixed.CODE_MARKS)} as code, doc_id % 5 = 0 as is_binary from documents")
def code_and_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like code; a NUL early or late in their bytes."""
    nul = F.lit("\0")
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a"), nul, "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.repeat(F.lit("x"), F.lit(8000)), nul)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", expr.looks_like_code(F.col("text")).alias("code"), sections.is_binary(F.encode(content, "UTF-8")).alias("is_binary"))


@query(f"""with {F1}, g as (select run_id, severity, count(*) as n_findings, min(path) as first_path from f group by all)
select *, case severity {' '.join(f'when {lit(k)} then {lit(v)}' for k, v in fixed.TEXT_ICONS.items())} else '[?]' end as icon, case severity {' '.join(f'when {lit(k)} then {lit(v)}' for k, v in fixed.MARKDOWN_ICONS.items())} else ':white_circle:' end as mark from g""")
def severity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = found(spark, sf_dir).groupBy("run_id", "severity").agg(F.count("*").alias("n_findings"), F.min("path").alias("first_path"))
    return g.withColumn("icon", expr.icon(F.col("severity"))).withColumn("mark", expr.icon(F.col("severity"), markdown=True))


# -- cache, prompts, models ---------------------------------------------------------------------------

NOW, TTL = "2024-02-01 00:00:00", 86_400 * 14
ENTRIES = "select sha256(concat_ws(':', 'p', 'm', cast(event_id % 1500 as varchar))) as key, concat('answer ', event_id) as response, ts as created_at from events"


def cache_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    entries = e.select(expr.cache_key(F.lit("p"), F.lit("m"), (F.col("event_id") % 1500).cast("string")).alias("key"), F.concat(F.lit("answer "), "event_id").alias("response"), F.col("ts").alias("created_at"), F.lit(TTL).alias("ttl"))
    asked = table(spark, sf_dir, "documents").select("doc_id", expr.cache_key(F.lit("p"), F.lit("m"), F.col("doc_id").cast("string")).alias("key"))
    return asked, entries


@query(f"with e as ({ENTRIES}), n as (select key, arg_max(response, created_at) as response from e where epoch(timestamp '{NOW}') - floor(epoch(created_at)) <= {TTL} group by key) select doc_id, n.response, n.key is not null as hit from (select doc_id, sha256(concat_ws(':', 'p', 'm', cast(doc_id as varchar))) as key from documents) d left join n on n.key = d.key")
def cache_lookup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, entries = cache_tables(spark, sf_dir)
    out = cache.lookup(asked, entries, F.lit(NOW).cast("timestamp"), TTL)
    return out.select("doc_id", "response", F.col("response").isNotNull().alias("hit"))


@query(f"with e as ({ENTRIES}) select count(*) as entries, cast(sum(octet_length(encode(response))) as bigint) as total_bytes, count(*) filter (where epoch(timestamp '{NOW}') - floor(epoch(created_at)) > {TTL}) as expired from e")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(cache_tables(spark, sf_dir)[1], F.lit(NOW).cast("timestamp"), TTL)


RULES = prompts.Rules(["security", "tests"], {"style": "low", "bug": "high"}, [("R1", "No secrets.")])


@query(f"select doc_id, sha256(concat('Review this diff.', chr(10), chr(10), 'Report at most 10 findings.', chr(10), 'Findings of severity high or higher matter most.', chr(10), 'Languages: Python', chr(10), {lit(RULES.text())}, chr(10), '--- BEGIN DIFF ---', chr(10), text, chr(10), '--- END DIFF ---', chr(10))) as prompt_sha256 from documents")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py")))
    p = prompts.prompt(F.col("text"), files, max_findings=10, fail_on="high", rules=RULES)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(p, 256).alias("prompt_sha256"))


@query("""select doc_id, sha256(concat('Review these source files.', chr(10), chr(10), 'Report at most 20 findings.', chr(10), 'Report at most 3 findings for a file.', chr(10),
  case when doc_id % 2 = 0 then concat('Languages: Go', chr(10)) else '' end, chr(10), '--- BEGIN FILES ---', chr(10), text, chr(10), '--- END FILES ---', chr(10))) as prompt_sha256 from documents""")
def codebase_prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts about whole files, with a limit by file; files of an unknown kind name no language."""
    files = F.array(F.concat(F.lit("d"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".go").otherwise(".unknown")))
    p = prompts.prompt(F.col("text"), files, "codebase", max_findings=20, per_file=3)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(p, 256).alias("prompt_sha256"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a diff of one chunk."""
    path = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), F.lit(0).alias("chunk_idx"), sections.added_diff(path, F.col("text")).alias("diff"), F.array(path).alias("files"))


ANSWER = '[{"severity":"low","category":"docs","title":"seen","message":"m","suggestion":"","confidence":0.5,"path":"d.py","startLine":1,"endLine":2,"tags":[]}]'


@query(f"select cast(doc_id as varchar) as run_id, 0 as chunk_idx, 0 as ord, substr(sha256('d.py:seen:1'), 1, 16) as id, 'low' as severity, 'seen' as title, 'd.py' as path, 1 as start_line, 2 as end_line from documents")
def replay_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, asked of a replaying provider: redaction, prompts, calls, parsing."""
    asked = ask(requests_for(document_chunks(spark, sf_dir), prompts.DIFF_SYSTEM, lambda d, f: prompts.prompt(d, f)), lambda label: Replay(default=ANSWER), ["replay"])
    ok, _ = findings.parse_findings(asked.select("run_id", "chunk_idx", "content"))
    return ok.select("run_id", "chunk_idx", "ord", "id", "severity", "title", "path", "start_line", "end_line")


class Faulty:
    """Refuses every 13th document, answers junk to every 11th and again to every 22nd when asked to mend it."""

    name = "faulty"

    def review(self, request: Request) -> Response:
        i = int(re.search(r"\bd(\d+)\b", request.user_prompt)[1])
        if i % 13 == 0:
            raise ProviderError("refused")
        asked_again = not request.user_prompt.startswith("Review")
        return Response(f"junk about d{i}" if i % (22 if asked_again else 11) == 0 else ANSWER)


@query("""select cast(doc_id as varchar) as run_id, case when doc_id % 13 = 0 then 'ProviderError' when doc_id % 22 = 0 then 'InvalidAnswer' else 'none' end as error,
  case when doc_id % 13 = 0 or doc_id % 22 = 0 then 0 else 1 end as n_findings from documents""")
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a provider that fails: what was refused, what was mended, what stayed invalid."""
    asked = ask(requests_for(document_chunks(spark, sf_dir), prompts.DIFF_SYSTEM, lambda d, f: prompts.prompt(d, f)), lambda label: Faulty(), ["faulty"])
    asked = materialize(asked, "answers")
    ok, _ = findings.parse_findings(asked.where("error is null").select("run_id", "content"))
    failed = errors_of(asked).select("run_id", F.substring_index("error", ":", 1).alias("error"), F.lit(0).alias("n_findings"))
    return ok.groupBy("run_id").agg(F.count("*").cast("int").alias("n_findings")).select("run_id", F.lit("none").alias("error"), "n_findings").unionByName(failed)


class Flaky:
    """Refuses a document in its first i % 5 rounds."""

    name = "flaky"

    def __init__(self, now: int):
        self.now = now

    def review(self, request: Request) -> Response:
        if int(re.search(r"\bd(\d+)\b", request.user_prompt)[1]) % 5 >= self.now:
            raise ProviderError(f"not in round {self.now}")
        return Response(ANSWER)


@query("""select cast(doc_id as varchar) as run_id, doc_id % 5 < 3 as answered, cast(least(doc_id % 5 + 1, 3) as int) as attempts, case when doc_id % 5 >= 3 then 'ProviderError: not in round 3' end as error from documents""")
def resumed_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, asked of a flaky provider in three rounds that share a ledger: each request until it is answered."""
    book = ledger.Ledger(spark, shared_folder(spark, "ledger"))
    requests = materialize(requests_for(document_chunks(spark, sf_dir), prompts.DIFF_SYSTEM, lambda d, f: prompts.prompt(d, f)), "resumed-requests")
    for now in (1, 2, 3):
        out = ledger.resume(requests, lambda label, now=now: Flaky(now), "flaky:m", book)
    return out.select("run_id", "answered", "attempts", "error")


# -- runs over time, moved lines ----------------------------------------------------------------------

#: Lines of documents that an edit deletes, and before which it puts a new one: all but the middle of long texts.
EDITED = "(n <= 30 or i < 12 or i >= n - 12)"
DELETED, PRECEDED = f"{EDITED} and (i * 7 + doc_id) % 5 = 0", f"{EDITED} and (i + doc_id) % 4 = 1"
LINES = f"""d as (select doc_id, concat('d', doc_id, '.py') as path, string_split(text, chr(10)) as l from documents),
e as (select doc_id, path, len(l) as n, unnest(range(len(l))) as i from d),
k as (select *, {DELETED} as gone, i + 1 - sum(case when {DELETED} then 1 else 0 end) over w + sum(case when {PRECEDED} then 1 else 0 end) over w as pos from e window w as (partition by doc_id order by i rows unbounded preceding)),
kept as (select doc_id, path, i + 1 as line, cast(pos as int) as pos from k where not gone),
f as (select doc_id, path, i + 1 as start_line, least(n, i + 1 + doc_id % 4) as end_line, concat('t', i % 4) as title from k where i % 3 = doc_id % 3)"""


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, doc_id, n, path, body): the edit of each document as a diff of one hunk, or of two if it is long."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l")).withColumn("n", F.size("l"))
    change = lambda cond: F.expr(f"transform(sequence(0, n - 1), i -> {cond})")
    d = d.withColumn("gone", change(DELETED)).withColumn("new", change(PRECEDED))

    def hunk(first, count, shift):
        own = F.transform(F.slice("l", first + 1, count), lambda x, i: F.concat(F.when(F.get("new", first + i), F.concat(F.lit("+new before "), x, F.lit("\n"))).otherwise(""), F.when(F.get("gone", first + i), "-").otherwise(" "), x, F.lit("\n")))
        more = grown(first, count)
        start = F.when(count + more == 0, first + shift).otherwise(first + 1 + shift)
        return F.concat(F.lit("@@ -"), (first + 1).cast("string"), F.lit(","), count.cast("string"), F.lit(" +"), start.cast("string"), F.lit(","), (count + more).cast("string"), F.lit(" @@ of a document\n"), F.array_join(own, ""))

    def grown(first, count):
        true = lambda c: F.size(F.filter(F.slice(c, first + 1, count), lambda x: x))
        return true("new") - true("gone")

    zero, n, ends = F.lit(0), F.col("n"), F.lit(12)
    two = F.concat(hunk(zero, ends, zero), hunk(n - 12, ends, grown(zero, ends)))
    path = F.concat(F.lit("d"), "doc_id", F.lit(".py"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"))
    # a table, as several scans of it follow
    return materialize(d.select(F.lit("r").alias("run_id"), "doc_id", "n", path.alias("path"), F.concat(head, F.when(n > 30, two).otherwise(hunk(zero, n, zero))).alias("body")), "diffs")


def old_findings(diffs: DataFrame) -> DataFrame:
    """A finding on every third line, over one to four lines."""
    line = F.expr("filter(sequence(0, n - 1), i -> i % 3 = doc_id % 3)")
    rows = diffs.select("run_id", "doc_id", "n", "path", F.explode(line).alias("i"))
    return rows.select("run_id", "doc_id", "path", (F.col("i") + 1).alias("start_line"), F.least("n", (F.col("i") + 1 + F.col("doc_id") % 4).cast("int")).alias("end_line"), F.concat(F.lit("t"), F.col("i") % 4).alias("title"))


@query(f"""with {LINES}
select f.doc_id, f.start_line, f.end_line, min(kept.pos) as new_start, max(kept.pos) as new_end, count(kept.pos) > 0 as survives
from f left join kept on kept.doc_id = f.doc_id and kept.line between f.start_line and f.end_line group by f.doc_id, f.start_line, f.end_line""")
def carried_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents, carried over an edit by its hunks."""
    diffs = edited(spark, sf_dir)
    return hunks.carry(old_findings(diffs), diffs).select("doc_id", "start_line", "end_line", "new_start", "new_end", "survives")


@query(f"""with {LINES},
m as (select f.doc_id, f.title, min(kept.pos) as line from f left join kept on kept.doc_id = f.doc_id and kept.line between f.start_line and f.end_line group by f.doc_id, f.title, f.start_line, f.end_line),
g as (select doc_id, concat('t', pos % 4) as title, pos as line from kept where pos % 2 = 0 union all select doc_id, concat('t', pos % 4) as title, pos as line from kept where pos % 6 = 0),
b as (select doc_id, title, line, count(*) as n from m group by all), a as (select doc_id, title, line, count(*) as n from g group by all),
c as (select coalesce(b.doc_id, a.doc_id) as doc_id, coalesce(b.n, 0) as x, coalesce(a.n, 0) as y from b full join a on a.doc_id = b.doc_id and a.title = b.title and a.line is not distinct from b.line)
select doc_id, cast(sum(greatest(y - x, 0)) as bigint) as n_new, cast(sum(greatest(x - y, 0)) as bigint) as n_fixed, cast(sum(least(x, y)) as bigint) as n_kept from c group by doc_id""")
def changes_over_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run finds on the edited documents, some of it twice, against what the first one found, lines moved: new, fixed and kept by document."""
    diffs = edited(spark, sf_dir)
    lines = diffs.select("run_id", "path", F.explode(hunks.line_map_of(F.col("body"))).alias("m"), "n").where("m.old_from <= n")
    at = lines.select("run_id", "path", F.explode(F.sequence(F.col("m.old_from"), F.least("m.old_to", "n"))).alias("old"), "m.shift").select("run_id", "path", (F.col("old") + F.col("shift")).alias("start_line"))
    at = at.withColumn("title", F.concat(F.lit("t"), F.col("start_line") % 4))
    after = at.where("start_line % 2 = 0").unionByName(at.where("start_line % 6 = 0"))
    out = runs.changes_across(old_findings(diffs), after, diffs)
    return runs.totals(out, [F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id")])


@query(f"""with {LINES},
s as (select doc_id, i, case when gone then null else l end as text from (select k.*, d.l[i + 1] as l from k join d on d.doc_id = k.doc_id where k.n <= 30 or i < 12 or i >= k.n - 12)),
g as (select kept.doc_id, kept.pos, concat('t', kept.pos % 4) as title, s.text from kept join s on s.doc_id = kept.doc_id and s.i = kept.line - 1)
select doc_id, pos as start_line, title, substr(sha256(concat('d', doc_id, '.py:', title, ':=', regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 16) as stable_id from g""")
def stable_finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the lines that an edit keeps: their identity is that of the line's text, wherever it has moved."""
    diffs = edited(spark, sf_dir)
    shown = diffs.withColumn("i", F.explode(F.expr(f"filter(sequence(0, n - 1), i -> {EDITED})"))).select("run_id", "doc_id", "path", (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"))
    moved = hunks.carry(shown, diffs).where("survives").select("run_id", "doc_id", "path", F.col("new_start").alias("start_line"), F.concat(F.lit("t"), F.col("new_start") % 4).alias("title"))
    return hunks.with_stable_ids(moved, diffs).select("doc_id", "start_line", "title", "stable_id")


@query(f"""with {F1}, b as (select path, title, category from f where run_id = 'r0'), a as (select path, title, category from f where run_id = 'r1'),
u as (select 'new' as kind, * from (select * from a except all select * from b) union all select 'fixed' as kind, * from (select * from b except all select * from a) union all select 'kept' as kind, * from (select * from a intersect all select * from b))
select kind, path, title, category, count(*) as n from u group by all""")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one run against those of another, with how often each occurs."""
    f = found(spark, sf_dir)
    c = runs.changes(f.where("run_id = 'r0'"), f.where("run_id = 'r1'"))
    each = c.select("path", "title", "category", F.explode(F.create_map(F.lit("new"), "n_new", F.lit("fixed"), "n_fixed", F.lit("kept"), "n_kept")).alias("kind", "n"))
    return each.where("n > 0").select("kind", "path", "title", "category", "n")


@query(f"""with {F1}, b as (select path, title, category from f where run_id = 'r0'), a as (select path, title, category from f where run_id = 'r1')
select *, count(*) as n from (select * from a except all select * from b) group by all""")
def new_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    return runs.new_findings(f.where("run_id = 'r0'"), f.where("run_id = 'r1'")).groupBy(*runs.SAME).agg(F.count("*").alias("n"))


HIGH = "select path, ts, max(seq) as seq, arg_max(title, seq) as title from f where severity = 'high' group by path, ts"


@query(f"with {F1}, h as ({HIGH}) select f.seq, h.seq as last_high, h.title as last_title, epoch_us(f.ts) - epoch_us(h.ts) as since_us from f asof left join h on f.path = h.path and f.ts >= h.ts")
def last_high_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with the last one of high severity in its file up to then."""
    f = found(spark, sf_dir)
    out = asof.asof_join(f, f.where("severity = 'high'"), ["path"], "ts", "ts", {"seq": "last_high", "title": "last_title", "ts": "last_ts"}, ties=["seq"])
    return out.select("seq", "last_high", "last_title", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))).alias("since_us"))


@query("with p as (select ts, max(event_id) as event_id from events where event_type = 'purchase' group by ts) select e.event_id, p.event_id as last_purchase from events e asof left join p on e.ts > p.ts")
def last_purchase_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last purchase of anyone before it: one key, cut into ranges of time."""
    e = table(spark, sf_dir, "events")
    return asof.asof_join(e, e.where("event_type = 'purchase'"), [], "ts", "ts", {"event_id": "last_purchase"}, ties=["event_id"], strict=True, hot_rows=2_000, ranges=64).select("event_id", "last_purchase")


# -- levels, spans and sessions -----------------------------------------------------------------------

@query(f"with {F1} select run_id, severity, category, grouping_id(run_id, severity, category) as level, cast(count(*) as bigint) as n, cast(min(start_line) as double) as least, cast(max(start_line) as double) as most, true as close from f group by cube (run_id, severity, category)")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by run, severity, category and all levels above, from one pass; close: whether estimates at the top keep to their bounds."""
    f = found(spark, sf_dir)
    out = rollups.cube_of(rollups.base_rollup(f, ["run_id", "severity", "category"], "path", "start_line"), ["run_id", "severity", "category"])
    close = (F.col("n_distinct") <= 1.1 * F.col("n") + 1) & F.col("q_0_5").between(F.col("least"), F.col("most")) & (F.col("q_0_5") <= F.col("q_0_9"))
    return out.select("run_id", "severity", "category", F.col("level").cast("long").alias("level"), "n", "least", "most", close.alias("close"))


@query(f"with {F1} select path, epoch_us(ts) as at_us, cast(max(n) as bigint) as n_recent from (select path, ts, count(*) over (partition by path order by ts range between interval 7 days preceding and current row) as n from f) group by path, ts")
def recent_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings a file has in the seven days up to each of its findings."""
    out = rollups.recent_counts(found(spark, sf_dir), ["path"], "ts")
    return out.select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "n_recent")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 12 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as i from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 43200000000 as end_us, count(*) as n_events from s group by user_id, i""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: events less than twelve hours apart."""
    out = sessions.sessions(table(spark, sf_dir, "events"), ["user_id"], gap="12 hours")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "n_events")


@query("""with g as (select user_id, ts, event_id, event_type = 'purchase' as ends, lag(ts) over w as before, lag(event_type = 'purchase') over w as ended from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(case when before is null or ended or ts - before >= interval 12 hours then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as i from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as last_us, count(*) as n_events, bool_or(ends) as closed from s group by user_id, i""")
def purchase_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which a purchase closes, or twelve hours without any event."""
    out = closing.closed_sessions(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase", gap_seconds=12 * 3600)
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("last_event").alias("last_us"), "n_events", "closed")


# -- rules and schemas --------------------------------------------------------------------------------

WORDS_OF = "regexp_extract_all({0}, '[A-Za-z]+')"


@query(f"""with p as (select cast(item_id as varchar) as id, array_to_string(list_slice({WORDS_OF.format('text')}, 3, 5), '[^A-Za-z]+') as p from benchmark where len({WORDS_OF.format('text')}) >= 5),
q as (select id, p from p union all select concat(id, 'i'), concat('(?i)', p, '[^A-Za-z]') from p union all select 'digits', '[0-9]{{6}}')
select doc_id, array_to_string(list_sort(list(id) filter (where regexp_matches(coalesce(text, ''), p))), ',') as banned from documents, q group by doc_id, text""")
def banned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which patterns each document matches: three words of each benchmark item in a row, with and without regard to case, and one without any fixed part."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), words.alias("w")).where(F.size("w") >= 5)
    rows = rows.select("id", F.array_join(F.slice("w", 3, 3), "[^A-Za-z]+").alias("p")).collect()  # with_banned bounds them
    patterns = [(r["id"], r["p"]) for r in rows] + [(r["id"] + "i", f"(?i){r['p']}[^A-Za-z]") for r in rows] + [("digits", "[0-9]{6}")]
    out = banned.with_banned(table(spark, sf_dir, "documents").select("doc_id", "text"), patterns, "text")
    return out.select("doc_id", F.when(F.size("banned") > 0, F.array_join("banned", ",")).alias("banned"))


@query("""select doc_id, concat_ws('|', case when doc_id % 3 = 0 then '$[0].title: is missing' end, case when doc_id % 5 = 0 then '$[0].severity: is not one of low, medium, high' end,
  case when doc_id % 7 = 0 then '$[0].confidence: is more than 1' end, case when doc_id % 11 = 0 then '$[0].startLine: is not of type integer' end, case when doc_id % 13 = 0 then '$[0].tags[1]: is not of type string' end) as violations from documents""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about documents, spoilt in five ways, under the schema of answers."""
    bad = lambda n, a, b: F.when(F.col("doc_id") % n == 0, a).otherwise(b)
    title = F.concat(F.lit(',"title":'), F.to_json(F.struct(F.coalesce(F.col("text"), F.lit("")).alias("t"))).substr(6, 1 << 30))
    title = F.concat(F.lit(',"title":"t","message":'), F.regexp_replace(title, r'(?s)\A,"title":(.*)\}\z', "$1"))
    parts = [F.lit('[{"path":"p","severity":'), bad(5, '"dire"', '"high"'), bad(3, "", title), F.lit(',"confidence":'), bad(7, "1.5", "0.5"), F.lit(',"startLine":'), bad(11, '"7"', "7"), F.lit(',"tags":["a",'), bad(13, "1", '"b"'), F.lit("]}]")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(schema.violations(F.concat(*parts), schema.ANSWER), "|").alias("violations"))
