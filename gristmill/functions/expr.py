"""Scalar functions as Column expressions: all run inside the JVM, none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import fixed, globs


def mapped(value: Column, table: dict[str, str | int], default: str | int | None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


# -- text ---------------------------------------------------------------------------------------------

def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end (trim() knows only the space)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words_of(text: Column) -> Column:
    """Non-empty runs between Unicode white space."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def truncate_bytes(text: Column, n: int) -> Column:
    """The first n bytes; a character that is cut becomes U+FFFD."""
    return F.when(F.octet_length(text) > n, F.call_function("make_valid_utf8", F.substring(text.cast("binary"), 1, n).cast("string"))).otherwise(text)


def split_comma(text: Column, trim: bool = True) -> Column:
    """Parts between commas, trimmed and non-empty; trim=False keeps them as they are."""
    parts = F.split(text, ",", -1)
    return F.filter(F.transform(parts, trim_space), lambda x: x != "") if trim else parts


def percent(share: Column) -> Column:
    """A confidence as whole per cent, halves to the even number."""
    return F.format_string("%.0f%%", F.bround(share * 100, 0))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most width bytes, broken at white space only; a text that fits is one line as it is."""
    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.octet_length(last) + 1 + F.octet_length(w) <= width
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w)))

    return F.when(F.octet_length(text) <= width, F.array(text)).otherwise(F.aggregate(words_of(text), F.array().cast("array<string>"), step))


def whole_json(text: Column) -> Column:
    """The value of a JSON text as a variant, null being the JSON null; SQL null for any other text. The parser itself says nothing of what follows the first value."""
    parts = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit(',"b":0}'))), "$", "map<string,variant>")
    value = lambda m: F.when((F.size(m) == 2) & F.map_contains_key(m, "a") & F.map_contains_key(m, "b"), F.coalesce(m["a"], F.parse_json(F.lit("null"))))
    return F.get(F.transform(F.array(parts), value), 0)


# -- severities ---------------------------------------------------------------------------------------

def severity_rank(severity: Column) -> Column:
    return mapped(severity, {s: i + 1 for i, s in enumerate(fixed.SEVERITIES)}, 0)


def meets_threshold(severity: Column, threshold: Column) -> Column:
    """False for an empty threshold or 'none'; an unknown one is met by everything."""
    return ~threshold.isin("", "none") & (severity_rank(severity) >= severity_rank(threshold))


def sarif_level(severity: Column) -> Column:
    return mapped(severity, fixed.SARIF_LEVELS, "note")


def icon(severity: Column, markdown: bool = False) -> Column:
    return mapped(severity, fixed.MARKDOWN_ICONS, ":white_circle:") if markdown else mapped(severity, fixed.TEXT_ICONS, "[?]")


# -- identifiers --------------------------------------------------------------------------------------

def finding_id(path: Column, title: Column, start_line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, title, start_line.cast("string")), 256), 1, 16)


def cache_key(provider: Column, model: Column, diff: Column, prompt_hash: Column | None = None) -> Column:
    """Of the diff alone, or with everything else that shapes the answer when prompt_hash is given."""
    return F.sha2(F.concat_ws(":", provider, model, diff, *([prompt_hash] if prompt_hash is not None else [])), 256)


def rule_id(prefix: str, category: Column, title: Column) -> Column:
    return F.concat_ws("/", F.lit(prefix), category, F.substring(F.sha2(F.concat_ws("/", category, title), 256), 1, 8))


# -- redaction ----------------------------------------------------------------------------------------

def redact(text: Column) -> Column:
    """All patterns in turn, each on what the one before has left; a text that holds no pattern's fixed part is left alone by one look."""
    return F.when(text.rlike(fixed.SECRET_PARTS), reduce(lambda t, p: F.regexp_replace(t, p, fixed.PLACEHOLDER), fixed.SECRETS, text)).otherwise(text)


def redact_content(text: Column, path: Column, path_globs: list[str], secrets: bool = True) -> Column:
    """Everything for a path under policy, else the secrets (if they are to be)."""
    return F.when(globs.matches_any(path, path_globs, whole_rest=False), F.lit(fixed.PATH_PLACEHOLDER)).otherwise(redact(text) if secrets else text)


def hit_count(redacted: Column) -> Column:
    return (F.size(F.split(redacted, r"\[REDACTED\]", -1)) - 1).cast("long")


# -- languages ----------------------------------------------------------------------------------------

def suffix_lookup(path: Column, table: dict[str, str]) -> Column:
    """By the last dotted suffix; null if unknown."""
    return mapped(F.regexp_extract(path, r"(\.[^./]*)\z", 1), table, None)


def languages_of(paths: Column) -> Column:
    """Distinct language names of an array of paths, in order of appearance."""
    return F.array_distinct(F.filter(F.transform(paths, lambda p: suffix_lookup(p, fixed.LANGUAGES)), lambda x: x.isNotNull()))


def fence_language(path: Column) -> Column:
    return F.coalesce(suffix_lookup(path, fixed.FENCES), F.lit(""))


def looks_like_code(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in fixed.CODE_MARKS])


# -- references to models and repositories ------------------------------------------------------------

def model_spec(spec: Column) -> Column:
    """provider and model around the first colon; null unless both are there."""
    pattern = r"(?s)\A([^:]+):(.+)\z"
    return F.when(spec.rlike(pattern), F.struct(F.regexp_extract(spec, pattern, 1).alias("provider"), F.regexp_extract(spec, pattern, 2).alias("model")))


def repo_of_url(url: Column) -> Column:
    """owner and repo of a remote URL (https, then ssh); null if it is neither."""
    bare = F.regexp_replace(url, r"\.git\z", "")
    return F.coalesce(*[F.when(bare.rlike(p), F.struct(F.regexp_extract(bare, p, 1).alias("owner"), F.regexp_extract(bare, p, 2).alias("repo"))) for p in fixed.REMOTES])


def merge_base_range(rev: Column, merge_base: bool) -> Column:
    """Two dots become three at the first place, unless three are there."""
    return F.when(~rev.contains("..."), F.regexp_replace(rev, r"\A(.*?)\.\.", "$1...")).otherwise(rev) if merge_base else rev


# -- matching of findings -----------------------------------------------------------------------------

def lines_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def title_similar(a: Column, b: Column) -> Column:
    """Equal, one within the other, or over half of the shorter one's words shared (words of a count as often as they occur)."""
    a, b = F.lower(trim_space(a)), F.lower(trim_space(b))
    return similar(a, b, words_of(a), words_of(b))


def similar(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """title_similar of trimmed, lower-cased titles and their words."""
    shared = F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))
    return (a == b) | a.contains(b) | b.contains(a) | ((F.size(wa) > 0) & (F.size(wb) > 0) & (2 * shared > F.least(F.size(wa), F.size(wb))))


def any_shared_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(words_of(F.lower(a)), words_of(F.lower(b)))


def same_problem(f: str, g: str) -> Column:
    """Whether titles and categories under the aliases f and g mean one problem; both have title_key (trimmed, lower-cased) and title_words."""
    c = lambda x: (F.col(f"{f}.{x}"), F.col(f"{g}.{x}"))
    (tf, tg), (wf, wg), (cf, cg) = c("title_key"), c("title_words"), c("category")
    return similar(tf, tg, wf, wg) | ((cf == cg) & F.arrays_overlap(wf, wg))


# -- intervals ----------------------------------------------------------------------------------------

def dyadic_nodes(lo: Column, hi: Column) -> Column:
    """The fewest blocks (level, node) of 2 ** level numbers each, from node * 2 ** level on, that make up lo to hi: two a level at most. None if hi is smaller."""
    lo, hi = lo.cast("long"), hi.cast("long")
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    shift = lambda x, level: F.call_function("shiftright", x, level)

    def at(level: Column) -> Column:
        left, right = -shift(-lo, level), shift(hi + 1, level)
        block = lambda ok, node: F.when((left < right) & ok, F.struct(level.alias("level"), node.alias("node")))
        return F.array_compact(F.array(block(odd(left), left), block(odd(right), right - 1)))

    levels = F.when(lo <= hi, F.sequence(F.lit(0), F.floor(F.log2((hi - lo + 1).cast("double"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(levels, at))


def dyadic_path(x: Column, top: Column) -> Column:
    """The blocks of all levels up to top that hold x."""
    return F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", x.cast("long"), level).alias("node")))
