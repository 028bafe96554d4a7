"""Quality rules with risk-controlled thresholds [native].

Signals of a text are compared with cutoffs that a labelled holdout has to justify. Every signal has a fixed grid of
``LEVELS`` cutoffs from mild to strict. In a stratum (the document's language) the rule of level t rejects what is
over the t-th cutoff of any signal in use there, so rules grow stricter with t. k_t of the n labelled good documents
would be rejected by it. If it rejected good documents at a rate above ``risk``, so few would be seen with a
probability of at most P(Binomial(n, risk) <= k_t); the level is valid when this exact bound is at most ``delta`` over the
number of strata and of sets of signals (Bonferroni). Levels are tested from mild to strict and testing ends at the first that is not valid
(a fixed sequence needs no further correction). The last valid level applies, none where the first one fails. So
with probability 1 - delta no stratum loses more than ``risk`` of its good documents.

A signal is in use in a stratum if its strictest cutoff catches at least ``CATCH`` of the documents labelled bad
there, and its mildest at most ``risk`` of the good ones: one that finds nothing or tells nothing apart does not hold up the others. As
every set of signals has its share of delta, that choice may look at the same labels.

Nulls and ties: a null text has no words; a null language is the stratum ''. A document is a doc_id: it counts once,
as good only if all its labels say so, and as rejected if any row of that id would be. Null ids and null labels
calibrate nothing. Repeated rows are judged each. Empty labels give no cutoffs, empty documents an empty result. Texts are judged whole, whatever
their length: work is linear but for the sorting of a text's windows. Other columns of documents pass through, but for
those named like the new ones, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BLANKS, materialize, split_words

WINDOW = 8
#: Share of the bad documents that a signal must catch to be in use.
CATCH = 0.05
#: Signal: (when its value is over a cutoff c, and the grid from mild to strict).
SIGNALS = {
    "symbols": ("100 * n_symbols > {c} * n_words", [200, 100, 50, 30, 20, 10, 5]),
    "dup_lines": ("100 * n_dup_lines > {c} * n_lines", [90, 80, 70, 60, 50, 40, 30]),
    "repeats": ("100 * n_repeat_words > {c} * n_words", [28, 26, 24, 22, 20, 15, 10]),
    "long_words": ("100 * word_chars > {c} * n_words", [1000, 900, 850, 800, 750, 700, 650]),
    "short_words": ("100 * word_chars < {c} * n_words", [250, 275, 300, 325, 350, 375, 400]),
    "capitals": ("100 * n_capitals > {c} * word_chars", [90, 80, 70, 60, 50, 40, 30]),
}
LEVELS = 7
#: Sets of signals that may be in use.
SETS = 2 ** len(SIGNALS) - 1
#: Strata up to this many rows of cutoffs are broadcast.
MAX_BROADCAST_STRATA = 10_000
COUNTED = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeat_words(windows: Column) -> Column:
    """Words in windows whose hash is there twice or more; windows: hashes in text order, window i starting at word i."""

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, j: (j >= 0) & (j < n) & (F.get(s, j)["h"] == x["h"])
        starts = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # the sorted windows are bound to a lambda's variable, so that they are made once
    once = F.element_at(F.transform(F.array(placed), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(once).cast("long")


def signals(documents: DataFrame) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = documents.columns
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = documents.select("*", split_words(text, BLANKS).alias("__w"), lines.alias("__l"))
    windows = F.when(F.size("__w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        *rest,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        windows.alias("__h"),
    )
    return step.withColumn("n_repeat_words", repeat_words(F.col("__h"))).drop("__h")


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series ten steps up."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return series - sum((F.log(x + i) for i in range(10)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact but for rounding; 1 where k is above the mean."""
    top = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log(1 - p)
    # from k down each term is a share of the one before; beyond so many of them nothing is left that a double holds
    many = F.least(k, (64 + 40 * F.sqrt(n)).cast("long"))
    steps = F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda d: k - d)).otherwise(F.array().cast("array<bigint>"))
    down = F.aggregate(steps, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * i / (n - i + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"] * i / (n - i + 1) * ((1 - p) / p)).alias("s")), lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * down)


def level_of(signal: str) -> Column:
    """The first level whose cutoff the document is over; LEVELS if there is none."""
    rule, grid = SIGNALS[signal]
    return F.lit(LEVELS) - sum((F.when(F.expr(rule.format(c=c)), 1).otherwise(0) for c in grid), F.lit(0))


def cutoffs(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, use_{signal} and level (the last valid one, null if there is none) from a row per labelled document: stratum, good, lv_{signal}."""
    labelled = materialize(labelled, "quality-labelled")
    catches = lambda s: F.count_if(~F.col("good") & (F.col(f"lv_{s}") < LEVELS)) >= F.greatest(F.count_if(~F.col("good")) * CATCH, F.lit(1))
    spares = lambda s: F.count_if(F.col("good") & (F.col(f"lv_{s}") == 0)) <= F.count_if("good") * risk
    used = [(catches(s) & spares(s)).alias(f"use_{s}") for s in SIGNALS]
    used = materialize(labelled.groupBy("stratum").agg(F.count_if("good").alias("n"), *used).where("n > 0"), "quality-signals-used")
    strata = max(1, used.count())
    own = F.least(F.lit(LEVELS), *[F.when(F.col(f"use_{s}"), F.col(f"lv_{s}")) for s in SIGNALS])
    good = labelled.where("good").join(small(used.drop("n"), strata), "stratum").withColumn("own", own)
    per = materialize(good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("own") <= t).alias(f"k_{t}") for t in range(LEVELS)]), "quality-counts")
    # k_t grows with t, so the levels before a valid one are valid too
    level = F.coalesce(*[F.when(binomial_tail(F.col(f"k_{t}"), F.col("n"), risk) <= delta / (strata * SETS), F.lit(t)) for t in range(LEVELS - 1, -1, -1)])
    return used.drop("n").join(per.select("stratum", level.alias("level")), "stratum")


def small(strata: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(strata) if rows <= MAX_BROADCAST_STRATA else strata


def quality_filter(documents: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """documents (without text) with the signals' counts, base_failed, rejected_by (signals) and kept."""
    out = [*COUNTED, "base_failed", "rejected_by", "kept"]
    rest = [c for c in documents.columns if c not in out and c != "text"]
    step = materialize(signals(documents.select(*rest, "text")).drop("text"), "quality-signals").withColumn("__stratum", F.coalesce("lang", F.lit("")))
    # ids that are no label's stay out: most documents have none
    label = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q in (0, 1)")
    own = step.select("doc_id", F.col("__stratum").alias("stratum"), *[level_of(s).alias(f"lv_{s}") for s in SIGNALS]).join(label, "doc_id")
    own = own.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), (F.max("q") == 1).alias("good"), *[F.min(f"lv_{s}").alias(f"lv_{s}") for s in SIGNALS])
    cuts = materialize(cutoffs(own.drop("doc_id"), risk, delta), "quality-cutoffs")
    cuts = small(cuts.select(F.col("stratum").alias("__stratum"), F.col("level").alias("__level"), *[F.col(f"use_{s}").alias(f"__use_{s}") for s in SIGNALS]), cuts.count())
    rejected = F.array_compact(F.array(*[F.when(F.col(f"__use_{s}") & (level_of(s) <= F.col("__level")), F.lit(s)) for s in SIGNALS]))
    step = step.join(cuts, "__stratum", "left").withColumn("rejected_by", rejected)
    step = step.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    return step.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select(*rest, *out)
