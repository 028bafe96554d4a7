"""The queries op1 to op13 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontam, lang_id, license_scan, line_dedup, lm_score, ngram_join, periodic, quality, search, sharding, url_filter, warc
from gristmill.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenizer() -> tuple[str, str]:
    """Path of the installed vocabulary and its pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse_runs(periodic.planted(table(spark, sf_dir, "documents")))
    # the longest, then the first, then that of the shortest period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.withColumn("top", top).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_ngram_jaccard, op3_hilbert_shards, op4_language_id, op5_decontamination, op6_bpe, op7_url_filter, op8_warc, op9_quality_rules, op10_line_dedup, op11_lexical_search, op12_lm_scoring, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Words of operators 1 and 5 in DuckDB.
SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL_FIELDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def sql_license() -> str:
    rows = ", ".join(f"({literal(k)}, {literal(v)})" for k, v in sorted(license_scan.TEMPLATES.items()))
    return f"""
with t0(license, text) as (values {rows}),
t1 as (select license, {SQL_WORDS.format("text")} as w from t0),
t2 as (select license, w, cast(least(len(w), 5) as int) as k from t1 where len(w) > 0),
t3 as (select distinct license, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as s from (select license, w, k, unnest(range(1, len(w) - k + 2)) as i from t2)),
t4 as (select *, l + s - 1 as width from (select *, greatest(1, l // 8) as s from (select license, k, count(*) as m, count(*) + count(*) // 4 as l from t3 group by 1, 2))),
d as (select doc_id, {SQL_WORDS.format("text")} as w from documents),
p as (select doc_id, len(w) as n, w, unnest(range(0, len(w))) as i from d),
g as (select doc_id, n, i, k, list_aggregate(w[i + 1:i + k], 'string_agg', ' ') as s from p, (select distinct k from t4) where i + k <= n),
h as (select g.doc_id, g.n, g.i, g.s, t4.license, t3.k, t4.m, t4.s as step, t4.width, unnest(range(greatest(0, cast(ceil((i - width + 1) / t4.s) as bigint)), i // t4.s + 1)) as win from g join t3 on g.s = t3.s and g.k = t3.k join t4 on t4.license = t3.license),
v as (select doc_id, license, k, m, n, step, width, win, count(distinct s) as matched from h group by all),
r as (select *, row_number() over (partition by doc_id, license order by matched desc, win) as rn from v where matched >= 0.75 * m)
select doc_id, license, cast(matched as bigint) as matched, cast(m as bigint) as total, cast(win * step as bigint) as word_from, cast(least(win * step + width + k - 1, n) as bigint) as word_to from r where rn = 1"""


SQL_NGRAM = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(c) from r where r.doc_id = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id"""


def sql_decontam() -> str:
    return f"""
with d as (select doc_id, {SQL_WORDS.format("text")} as w from documents),
b as (select cast(item_id as varchar) as item_id, {SQL_WORDS.format("text")} as w from benchmark),
bw as (select distinct item_id, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from (select item_id, w, cast(least(len(w), 10) as int) as k from b where len(w) > 0))),
dw as (select doc_id, i, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)),
h as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.s = bw.s and dw.k = bw.k),
n as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + k)) as pos from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.ids, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 as contaminated
from d left join n on n.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""


def sql_urls() -> str:
    rules = ", ".join(f"({literal(v)}, {literal(h)}, {literal(p)})" for v, h, p in url_filter.RULES)
    return f"""
with r(verdict, h, p) as (values {rules}),
u as (select page_id, case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
k as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
f as (select k.page_id, r.verdict, r.h || r.p as rule, row_number() over (partition by k.page_id order by length(r.h || r.p) desc, r.h || r.p desc) as rn from k join r on (k.host = r.h or suffix(k.host, '.' || r.h)) and starts_with(k.path, r.p))
select k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, 'allow') as verdict from k left join f on f.page_id = k.page_id and f.rn = 1"""


SQL_WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when p.n >= 100 and p.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
  case when p.n >= 100 and p.page_id <> f.first_id then f.first_id end as refers_to
from p left join f on f.d = p.d"""


def sql_quality(risk: float = 0.05, delta: float = 0.05) -> str:
    """The signals by brute force; the bound by a sum of binomial terms."""
    n = quality.LEVELS
    level = {s: " + ".join(f"case when {rule.format(c=c)} then 0 else 1 end" for c in grid) for s, (rule, grid) in quality.SIGNALS.items()}
    used = ", ".join(f"count(*) filter (where y = 0 and lv_{s} < {n}) >= greatest(count(*) filter (where y = 0) * {quality.CATCH}::double, 1) and count(*) filter (where y = 1 and lv_{s} = 0) <= count(*) filter (where y = 1) * {risk}::double as use_{s}" for s in level)
    own = ", ".join(f"case when use_{s} then lv_{s} end" for s in level)
    bad = " or ".join(f"coalesce(use_{s} and lv_{s} <= level, false)" for s in level)
    return f"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text, {SQL_FIELDS.format("text")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
win as (select doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from dup) group by 1),
q0 as (select d.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals, len(l) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d left join rep on rep.doc_id = d.doc_id),
q as (select *, {", ".join(f"{x} as lv_{s}" for s, x in level.items())} from q0),
lab as (select q.*, y from q join (select doc_id, min(quality) as y from labels group by 1) using (doc_id) where y in (0, 1)),
u as (select stratum, {used} from lab group by 1 having count(*) filter (where y = 1) > 0),
g as (select lab.stratum, least({n}, {own}) as own from lab join u on u.stratum = lab.stratum where y = 1),
k as (select g.stratum, t, count(*) as n, count(*) filter (where own <= t) as k from g, range({n}) as r(t) group by 1, 2),
ok as (select stratum, t from k where k < n * {risk} and list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) <= {delta} / ((select count(*) from u) * {quality.SETS})),
c as (select stratum, max(t) as level from ok group by 1),
j as (select q.*, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {bad} as bad from q left join u on u.stratum = q.stratum left join c on c.stratum = q.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept from j"""


SQL_LINES = r"""
with l as (select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as i from documents)),
f as (select key, min(doc_id) as first_doc from l where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select l.doc_id, l.i, l.line, f.key is not null and l.doc_id <> f.first_doc as gone from l left join f on f.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""


#: Terms of operator 11 in DuckDB.
SQL_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL_SEARCH = f"""
with t as (select doc_id, row_number() over () as r, {SQL_TERMS} as w from documents),
q as (select item_id, r, term, count(*) as k from (select item_id, r, unnest({SQL_TERMS}) as term from (select *, row_number() over () as r from benchmark)) group by all),
s as (select count(*) filter (where len(w) > 0) as big_n, cast(sum(len(w)) as bigint) as l from t),
p as (select r, term, count(*) as tf from (select r, unnest(w) as term from t) where term in (select term from q) group by all),
f as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as w from p, s group by term, big_n),
m as (select r, doc_id, 100 - 75 + ((75 * len(w) * big_n) // l) as m from t, s where len(w) > 0),
x as (select q.item_id, q.r, m.doc_id, cast(sum(q.k * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) as bigint) as score from q join p on p.term = q.term join f on f.term = q.term join m on m.r = p.r group by q.item_id, q.r, m.doc_id, m.r)
select item_id, cast(row_number() over (partition by r order by score desc, doc_id) as int) as rank, doc_id, score from x where score > 0 qualify rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """Operators 3 (any cut of a curve satisfies the law), 4, 6, 12 and 13 (DuckDB has no CRC) and the pipeline have none: see tests/llm."""
    return {"op1_license_scan": sql_license(), "op2_ngram_jaccard": SQL_NGRAM, "op5_decontamination": sql_decontam(), "op7_url_filter": sql_urls(), "op8_warc": SQL_WARC, "op9_quality_rules": sql_quality(), "op10_line_dedup": SQL_LINES, "op11_lexical_search": SQL_SEARCH}
