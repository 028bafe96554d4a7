"""Asking models from executors, and the whole review as one plan.

Requests are made by ``requests_for``, which redacts first unless told not to. Calls run in partitions (``tasks_for``) with ``pool`` threads each, so
what is open at once is bounded by the tasks that run together times pool (fewer ``tasks`` bound it further). Answers are written to the shared folder
before anything reads them, so that no later stage repeats a paid call; only a task that is lost repeats its own.

A request that a provider refuses, or whose answer is invalid even after a repair, is a row with an error. ``review`` and ``compare`` raise
the error of the first such request; batch users read them with ``errors_of`` instead.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import cache_key, redact, redact_content
from gristmill.operators import cache as kept
from gristmill.operators import consensus, prompts, sections
from gristmill.operators import findings as fd
from gristmill.operators.pack import build_chunks
from gristmill.schemas import RESPONSE
from gristmill.sources.providers import AuthError, ProviderError, Request, Reviewer
from gristmill.sources.shared import materialize

#: A task makes so many calls at least and at most. Between them there are TASKS tasks, or TASKS_PER_CORE for each core if that is more: a task costs a
#: tenth of a second and more besides its calls, and each is a row of every shuffle before it, so their number must not follow the input from the start.
CALLS_PER_TASK, MOST_PER_TASK = 16, 4096
TASKS, TASKS_PER_CORE = 128, 4
#: Answers that a task holds before it hands them on.
HELD = 256
REPAIR = "Your last answer could not be read as the JSON array that was asked for: {why}.\n\nAnswer again with the corrected JSON array and nothing else.\n\nThe last answer:\n{answer}"


class InvalidAnswer(ProviderError):
    """Not what was asked for, also after a repair."""


@dataclass
class Outcome:
    """Findings, and the time that models took, summed over all calls."""

    findings: DataFrame
    llm_ms: int


def requests_for(chunks: DataFrame, system: str, builder: Callable[[Column, Column], Column], max_tokens: int = 8192, secrets: bool = True) -> DataFrame:
    """A request per chunk (run_id, chunk_idx, diff, files); builder makes the prompt of the (redacted) diff and the files."""
    body = redact(F.col("diff")) if secrets else F.col("diff")
    return chunks.select("run_id", "chunk_idx", F.lit(system).alias("system_prompt"), builder(body, F.col("files")).alias("user_prompt"), F.lit(max_tokens).alias("max_tokens"))


def refuse(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def once(pairs: list[tuple[str, object]]) -> dict:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def problem(content: str) -> str:
    """What is wrong with an answer; '' for a valid one (as findings.valid_answer judges it)."""
    text = content.strip()
    if text.startswith("```"):
        lines = text.split("\n")[1:]
        text = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines).strip() or "[]"
    try:
        found = json.loads(text, parse_constant=refuse, object_pairs_hook=once)
    except (ValueError, RecursionError) as e:
        return str(e)
    if found is None:
        return ""
    if not isinstance(found, list):
        return "it is no array"
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    fits = {"STRING": lambda v: isinstance(v, str), "NUMBER": number, "INT": whole, "ARRAY": lambda v: isinstance(v, list) and (all(isinstance(x, str) for x in v) or all(x is None for x in v))}
    for i, x in enumerate(found):
        if not isinstance(x, dict):
            return f"element {i} is no object"
        for name, kind in fd.KINDS.items():
            if x.get(name) is not None and not fits[kind](x[name]):
                return f"field {name} of element {i} has the wrong type"
    return ""


def tasks_for(calls: int, cores: int) -> int:
    each = -(-calls // max(TASKS, TASKS_PER_CORE * cores))
    return max(1, -(-calls // min(max(each, CALLS_PER_TASK), MOST_PER_TASK)))


def in_turn(work: Callable[[int], dict], n: int, workers: ThreadPoolExecutor, pool: int) -> list[dict]:
    """work of 0 to n - 1, by threads that each take the next number; none begins another one after a failure."""
    turn, out = iter(range(n)), [None] * n

    def go() -> None:
        try:
            for i in turn:
                out[i] = work(i)
        except BaseException:
            for _ in turn:
                pass
            raise

    for done in [workers.submit(go) for _ in range(min(pool, n))]:
        done.result()
    return out


def ask(requests: DataFrame, make: Callable[[str], Reviewer], labels: list[str], tasks: int | None = None, pool: int = 4, repair: bool = True, dealt: bool = False) -> DataFrame:
    """Each request to each model; an invalid answer is asked for once more. Errors are rows (content null), not failures. dealt: requests lie in their tasks' partitions already."""

    def call(row: dict, client: Reviewer | ProviderError) -> dict:
        start, out = time.monotonic(), {"content": None, "tokens_used": 0, "error": None}
        try:
            if isinstance(client, ProviderError):
                raise client
            answer = client.review(Request(row["system_prompt"], row["user_prompt"], row["max_tokens"]))
            out["tokens_used"] = answer.tokens_used
            if (why := problem(answer.content)) and repair:
                answer = client.review(Request(row["system_prompt"], REPAIR.format(why=why, answer=answer.content), row["max_tokens"]))
                out["tokens_used"] += answer.tokens_used
                why = problem(answer.content)
            if why:
                raise InvalidAnswer(f"invalid answer: {why}")
            out["content"] = answer.content
        except ProviderError as e:
            out["error"] = f"{'AuthError' if isinstance(e, AuthError) else type(e).__name__}: {e}"
        return {k: row[k] for k in ("run_id", "chunk_idx", "label")} | out | {"llm_ms": int(1000 * (time.monotonic() - start))}

    arrow = pa.schema([("run_id", pa.string()), ("chunk_idx", pa.int32()), ("label", pa.string()), ("content", pa.string()), ("tokens_used", pa.int32()), ("llm_ms", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients: dict[str, Reviewer | ProviderError] = {}
        for label in labels:  # before any thread needs one
            try:
                clients[label] = make(label)
            except ProviderError as e:
                clients[label] = e
        with ThreadPoolExecutor(pool) as workers:
            for batch in batches:
                for k in range(0, batch.num_rows, HELD):
                    part = batch.slice(k, HELD)
                    columns = dict(zip(part.schema.names, part.columns))

                    def asked(i: int, columns: dict = columns) -> dict:
                        row = {c: v[i].as_py() for c, v in columns.items()}  # one at a time: a part may hold large diffs
                        return call(row, clients[row["label"]])

                    yield pa.RecordBatch.from_pylist(in_turn(asked, part.num_rows, workers, pool), schema=arrow)

    each = requests.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    if dealt:
        return each.mapInArrow(run, RESPONSE)
    tasks = tasks or tasks_for(requests.count() * len(labels), requests.sparkSession.sparkContext.defaultParallelism)
    return each.repartition(tasks, "run_id", "chunk_idx", "label").mapInArrow(run, RESPONSE)


def errors_of(answers: DataFrame) -> DataFrame:
    """run_id, chunk_idx, label and error of the requests that failed."""
    return answers.where("error is not null").select("run_id", "chunk_idx", "label", "error")


def raise_first(answers: DataFrame, labels: list[str]) -> None:
    """The error of the lowest (model, run, chunk), if there is any."""
    turn = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    first = errors_of(answers).orderBy(turn, "run_id", "chunk_idx").limit(1).collect()
    if first:
        kind, _, text = first[0]["error"].partition(": ")
        where = f"{first[0]['label']}, chunk {first[0]['chunk_idx']}"
        raise {"AuthError": AuthError, "InvalidAnswer": InvalidAnswer}.get(kind, ProviderError)(f"{where}: {text}")


def sections_of(diffs: DataFrame, exclude: list[str] = ()) -> DataFrame:
    return sections.exclude_sections(sections.split_sections(diffs.select("run_id", "diff"), drop_blank=True), list(exclude))


def requests_of(parts: DataFrame, kind: str = "diff", chunk_bytes: int = 500_000, max_findings: int = 50, rules: prompts.Rules | None = None, redact_paths: list[str] = (), secrets: bool = True, fail_on: str = "none", per_file: int = 0) -> DataFrame:
    """Requests for sections (run_id, section_ord, path, body) under path policy, packed into chunks; written once, as counting, looking up and asking all read them."""
    body = redact_content(F.col("body"), F.col("path"), list(redact_paths), secrets)
    parts = parts.select("run_id", "section_ord", "path", body.alias("body")).withColumn("n_bytes", F.octet_length("body"))
    system = prompts.CODEBASE_SYSTEM if kind == "codebase" else prompts.DIFF_SYSTEM
    build = lambda d, f: prompts.prompt(d, f, kind, max_findings=max_findings, per_file=per_file, fail_on=fail_on, rules=rules)
    return materialize(requests_for(build_chunks(parts, chunk_bytes), system, build, secrets=secrets), "review-requests")


def answered(requests: DataFrame, make: Callable[[str], Reviewer], label: str, store: kept.ResultCache | None = None, ttl_seconds: int = 0, **how) -> DataFrame:
    """Answers to all requests: those that the cache holds, and those of the model to the others, which the cache then holds if they are valid."""
    if store is None:
        return materialize(ask(requests, make, [label], **how), "review-answers")
    provider, _, model = label.partition(":")
    prompt = F.sha2(F.concat_ws("\n", "system_prompt", "user_prompt"), 256)
    keyed = requests.withColumn("key", cache_key(F.lit(provider), F.lit(model), prompt))
    looked = kept.lookup(keyed, store.entries(), F.current_timestamp(), ttl_seconds)
    good = F.col("response").isNotNull() & fd.valid_answer(fd.strip_fence(F.col("response")))  # what else the cache holds is asked for again
    looked = materialize(looked.withColumn("hit", F.coalesce(good, F.lit(False))), "review-looked")
    asked = materialize(ask(looked.where("not hit").select(requests.columns), make, [label], **how), "review-answers")
    new = asked.where("error is null").join(keyed.select("run_id", "chunk_idx", "key"), ["run_id", "chunk_idx"])
    store.put(new.select("key", F.col("content").alias("response"), F.current_timestamp().alias("created_at"), F.lit(ttl_seconds).alias("ttl")))
    hits = looked.where("hit").select("run_id", "chunk_idx", F.lit(label).alias("label"), F.col("response").alias("content"), F.lit(0).alias("tokens_used"), F.lit(0).cast("long").alias("llm_ms"), F.lit(None).cast("string").alias("error"))
    return hits.unionByName(asked)


def latency(answers: DataFrame) -> int:
    return answers.agg(F.sum("llm_ms")).first()[0] or 0


def found_in(answers: DataFrame, labels: list[str]) -> DataFrame:
    """Findings with model_idx, the place of the label."""
    ok = answers.withColumn("model_idx", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("int"))
    found, bad = fd.parse_findings(ok.select("run_id", "chunk_idx", "model_idx", "content"))
    wrong = bad.limit(1).collect()
    if wrong:  # what passed in the task must pass here
        raise InvalidAnswer(f"chunk {wrong[0]['chunk_idx']}: invalid answer")
    return found


def review(parts: DataFrame, make: Callable[[str], Reviewer], label: str, max_findings: int = 50, rules: prompts.Rules | None = None, store: kept.ResultCache | None = None, ttl_seconds: int = 0, how: dict | None = None, **asking) -> Outcome:
    """Sections to ranked findings: redact, pack, ask (or remember), parse, deduplicate, override, limit."""
    requests = requests_of(parts, max_findings=max_findings, rules=rules, **asking)
    answers = answered(requests, make, label, store, ttl_seconds, **(how or {}))
    raise_first(answers, [label])
    found = fd.dedupe_by_id(found_in(answers, [label]))
    return Outcome(fd.top_k(fd.override_severity(found, rules.severity_overrides if rules else {}), max_findings), latency(answers))


def compare(parts: DataFrame, make: Callable[[str], Reviewer], labels: list[str], max_findings: int = 50, rules: prompts.Rules | None = None, how: dict | None = None, **asking) -> tuple[Outcome, DataFrame]:
    """As review, by several models: what two mean once, what one alone means as it is. Also the counts by model. Answers are not repaired and not cached."""
    answers = materialize(ask(requests_of(parts, max_findings=max_findings, rules=rules, **asking), make, labels, repair=False, **(how or {})), "review-answers")
    raise_first(answers, labels)
    # a place in all answers of a model: chunk by chunk
    place = Window.partitionBy("run_id", "model_idx").orderBy("chunk_idx", "ord")
    found = found_in(answers, labels).withColumn("ord", F.row_number().over(place) - 1)
    merged = materialize(consensus.merge(found), "review-compared")
    shown = merged.where("consensus_first or not is_consensus")
    # consensus first, then each model's own
    order = [F.col("is_consensus").desc(), *fd.rank_order(merged.columns)]
    return Outcome(fd.top_k(shown, max_findings, order), latency(answers)), consensus.compare_counts(merged)
