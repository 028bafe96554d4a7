"""Extension: reviews that can be resumed. What was answered is kept, and only what failed, or was never reached, is asked again.

A ledger is a table of attempts that only grows. A request is named by its model and what it says, so that equal requests are asked once, whatever runs and
chunks they belong to, and a run over changed diffs asks only for what has changed. An answer that stays invalid after its repair is a failed attempt.

Requests are asked in waves, each appended when it is through: a job that dies loses the answers of one wave at most. Two jobs that resume one ledger
at the same time may ask for the same; both attempts are kept and the later answer counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import findings as fd
from gristmill.operators.prompts import Rules
from gristmill.operators.review import Outcome, ask, found_in, latency, requests_of, tasks_for
from gristmill.sources.providers import Reviewer
from gristmill.sources.shared import materialize

ATTEMPT = "key string, attempt int, content string, tokens_used int, llm_ms long, error string, asked_at timestamp"


class Ledger:
    """Attempts as a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def attempts(self) -> DataFrame:
        try:
            return self.spark.read.schema(ATTEMPT).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ATTEMPT)

    def append(self, attempts: DataFrame) -> None:
        attempts.write.mode("append").parquet(self.path)


def request_key(label: str) -> Column:
    """Of a request's columns; a null prompt is an empty one."""
    parts = [F.lit(label), *[F.coalesce(F.col(c), F.lit("")) for c in ("system_prompt", "user_prompt")], F.col("max_tokens").cast("string")]
    # each with its length: no two requests run together to the same text
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def standing(attempts: DataFrame) -> DataFrame:
    """(key, answered, attempts, content, llm_ms, error): one row for each request that was ever made. error is the last one; null once there is an answer."""
    good, at = F.col("error").isNull(), F.struct("asked_at", "attempt")
    answered = F.max(good)
    last = F.max_by("error", F.when(~good, at))
    return attempts.groupBy("key").agg(answered.alias("answered"), F.count("*").cast("int").alias("attempts"), F.max_by("content", F.when(good, at)).alias("content"), F.sum("llm_ms").alias("llm_ms"), F.when(~answered, last).alias("error"))


def due(keys: DataFrame, known: DataFrame, max_attempts: int) -> DataFrame:
    """(key, attempt) of each key that has neither an answer nor max_attempts attempts; attempt is the number of the next."""
    open_ = keys.select("key").distinct().join(known.select("key", "answered", "attempts"), "key", "left").where("not coalesce(answered, false)")
    return open_.select("key", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt")).where(F.col("attempt") <= max_attempts)


def texts_of(requests: DataFrame, todo: DataFrame, label: str, tasks: int) -> DataFrame:
    """todo with what one of the requests of its key says, as requests of their own (a request is its key to the models' side, and its attempt a chunk), in tasks partitions.

    Texts are shuffled once: to where they are joined, made single and asked.
    """
    said = requests.select(request_key(label).alias("key"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("system_prompt", "user_prompt")], "max_tokens").repartition(tasks, "key")
    one = said.join(todo.repartition(tasks, "key"), "key").dropDuplicates(["key"])
    return one.select(F.col("key").alias("run_id"), F.col("attempt").alias("chunk_idx"), "system_prompt", "user_prompt", "max_tokens")


def resume(requests: DataFrame, make: Callable[[str], Reviewer], label: str, ledger: Ledger, max_attempts: int = 3, waves: int = 1, tasks: int | None = None, **how) -> DataFrame:
    """Ask what is due once and give each request (run_id, chunk_idx) with how it stands: answered, attempts, content, llm_ms, error.

    Nothing is raised for requests that fail; calling again asks them again, until max_attempts. llm_ms is that of all attempts. tasks, how: as of review.ask.
    """
    keys = materialize(requests.select("run_id", "chunk_idx", request_key(label).alias("key")), "ledger-requests")
    todo = materialize(due(keys, standing(ledger.attempts()), max_attempts), "ledger-due")
    calls = todo.count()
    tasks = tasks or tasks_for(-(-calls // waves), ledger.spark.sparkContext.defaultParallelism)
    named = texts_of(requests, todo, label, tasks)
    if waves > 1 and calls:
        named = materialize(named, "ledger-texts")
    for wave in range(waves if calls else 0):
        mine = named.where(F.pmod(F.xxhash64("run_id"), F.lit(waves)) == wave) if waves > 1 else named
        answers = ask(mine, make, [label], tasks=tasks, dealt=waves == 1, **how)
        ledger.append(answers.select(F.col("run_id").alias("key"), F.col("chunk_idx").alias("attempt"), "content", "tokens_used", "llm_ms", "error", F.current_timestamp().alias("asked_at")))
    return keys.join(standing(ledger.attempts()), "key", "left").drop("key")


def best_effort(parts: DataFrame, make: Callable[[str], Reviewer], label: str, ledger: Ledger, max_findings: int = 50, rules: Rules | None = None, max_attempts: int = 3, waves: int = 1, how: dict | None = None, **asking) -> tuple[Outcome, DataFrame]:
    """As review.review, from what was answered by now; and run_id, chunk_idx, attempts, error of what was not."""
    requests = requests_of(parts, max_findings=max_findings, rules=rules, **asking)
    stood = materialize(resume(requests, make, label, ledger, max_attempts, waves, **(how or {})), "ledger-answers")
    answers = stood.where("answered").withColumn("label", F.lit(label))
    found = fd.override_severity(fd.dedupe_by_id(found_in(answers, [label])), rules.severity_overrides if rules else {})
    return Outcome(fd.top_k(found, max_findings), latency(stood)), stood.where("not answered").select("run_id", "chunk_idx", "attempts", "error")
