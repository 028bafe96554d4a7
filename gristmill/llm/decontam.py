"""Benchmark decontamination by winnowing [native].

Words of texts are hashed in k-grams; of every ``WINDOW - K + 1`` neighbouring hashes the smallest
(leftmost on ties) is kept as a fingerprint. Equal runs of ``WINDOW`` words choose equal fingerprints,
so joining those of documents and benchmark items finds every shared run of that length. Each hit is
compared word by word and extended both ways, up to where the next one takes over; runs shorter than ``WINDOW`` are given up. Items with
fewer words are one run each and are looked for by the hash of that many words, all such lengths in one more scan. Repeated words cost in proportion: windows
inside a stretch of one word keep few fingerprints, and an item's places with equal words around them are one.

The benchmark's words and fingerprints are broadcast while they take at most ``BROADCAST_BYTES``; beyond, documents'
words are first written to the shared folder and all joins shuffle. Only fingerprints and places meet in the join by fingerprint, whose
documents' side Spark may split where a passage is so common that its key is skewed.

Nulls and ties: a null text or one without words has no hits and hits nothing, whatever its id. Rows
are judged each, also where a doc_id repeats. An item_id that repeats counts once, a null one not.
Empty tables give empty or all-clean results. Texts are searched whole; a hit carries the words around it, never its text.
Other columns pass through where they are asked for by name (keep), else they are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, materialize, split_words

WINDOW, K = 10, 5
DELIMITERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), DELIMITERS)


def fingerprints(rows: DataFrame, k: int, span: int, keep_empty: bool, every: int = 0) -> DataFrame:
    """rows (with words w) to a row for each window of span k-grams: k, start and fp, the hash that the window keeps (the first smallest; null if the window before kept the same one).

    keep_empty: a row more for each input row, with start -1 and a null fp. Everything here is plain arithmetic on the words of one
    array, so it runs in one compiled loop; filtering is left to the join, which no null fp passes.

    Where one word is repeated, each window would keep a hash of its own. Of windows inside such a stretch (with a word to spare on either side) only each every-th keeps one, with every = 0 none:
    those at its ends meet whatever else the stretch would.
    """
    last = F.size("w") - k - span + 1
    first = -1 if keep_empty else 0
    steps = F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array(F.lit(-1)) if keep_empty else F.array().cast("array<int>"))
    # explode_outer: explode would add a filter that splits the text a second time
    rows = rows.select("*", F.explode_outer(steps).alias("start"))
    hashed = lambda j: F.xxhash64(*[F.get("w", F.col("start") + (j + i)) for i in range(k)])
    kept = rows.columns
    if span == 1:
        fp = F.when(F.col("start") >= 0, hashed(0))
        return rows.select(*kept, F.lit(k).alias("k"), F.lit(span).alias("n_grams"), fp.alias("fp"))
    rows = rows.select(*kept, *[hashed(j).alias(f"__h{j + 1}") for j in range(-1, span)])
    # the smallest of all but the window's last; it stays the choice unless it enters or leaves here
    inner = [f"__h{j}" for j in range(1, span)]
    rows = rows.select(*kept, "__h0", f"__h{span}", F.least(*inner).alias("__low"), F.greatest(*inner).alias("__high"))
    spare = F.get("w", F.col("start") + k + span - 1) == F.get("w", F.col("start"))
    same = (F.col("start") > 0) & (F.col("__low") == F.col("__high")) & (F.col("__h0") == F.col("__low")) & (F.col(f"__h{span}") == F.col("__low")) & F.coalesce(spare, F.lit(False))
    new = (F.col("start") == 0) | (F.col("__h0") <= F.col("__low")) | (F.col(f"__h{span}") < F.col("__low"))
    new = new & ~(same & (F.col("start") % every != 0) if every else same)
    fp = F.when((F.col("start") >= 0) & new, F.least("__low", f"__h{span}"))
    return rows.select(*kept, F.lit(k).alias("k"), F.lit(span).alias("n_grams"), fp.alias("fp"))


def around(first: str, words_: str, length: Column, name: str) -> list[Column]:
    """The words from WINDOW before first on, and where they begin. Rows carry these, never a whole text: a text's rows are buffered together."""
    base = F.greatest(F.col(first) - WINDOW, F.lit(0))
    return [base.alias(f"{name}_base"), F.slice(words_, base + 1, length + 2 * WINDOW).alias(name)]


def short_fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """As fingerprints, with a row for each place and each length of an item: its words are one k-gram."""
    steps = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    each = [F.when(F.col("start") + k <= F.size("w"), F.struct(F.lit(k).alias("k"), F.xxhash64(*[F.get("w", F.col("start") + i) for i in range(k)]).alias("fp"))) for k in lengths]
    kept = rows.columns
    rows = rows.select("*", F.explode_outer(steps).alias("start")).select(*kept, "start", F.explode(F.array(*each)).alias("g"))
    return rows.select(*kept, "start", "g.k", F.lit(1).alias("n_grams"), "g.fp")


def placed(rows: DataFrame) -> DataFrame:
    """rows (start, n_grams, k, fp, ctx, ctx_base) with at, the first word of the k-gram that was kept."""
    hashes = F.transform(F.sequence(F.lit(0), F.col("n_grams") - 1), lambda j: gram_hash(F.slice("ctx", F.col("start") - F.col("ctx_base") + j + 1, F.col("k")), F.col("k")))
    at = F.when(F.col("fp").isNotNull(), F.col("start") + F.array_position(hashes, F.col("fp")).cast("int") - 1).otherwise(-1)
    return rows.withColumn("at", at).drop("start", "n_grams")


def gram_hash(gram: Column, k: Column) -> Column:
    """As xxhash64 of the words one by one."""
    return F.coalesce(*[F.when(k == n, F.xxhash64(*[F.get(gram, F.lit(i)) for i in range(n)])) for n in range(1, WINDOW)])


def run_length(same: Column, most: Column) -> Column:
    """How many leading entries of a boolean array of length most are true."""
    stop = F.array_position(same, False)
    return F.when(most <= 0, 0).when(stop == 0, most).otherwise(stop - 1).cast("int")


def extended(hits: DataFrame, own: list[str]) -> DataFrame:
    """hits (own columns, n_words, k, at, item_id, m, item_at and the words around either) to own columns, n_words, span and hit_item.

    span is the equal run around the hit, up to a window's length to either side, if it is true and long enough; else it and hit_item are null.
    """
    i, j = F.col("at") - F.col("ctx_base"), F.col("item_at") - F.col("ictx_base")
    true = F.when(F.col("item_id").isNotNull() & (F.col("at") >= 0), F.slice("ctx", i + 1, F.col("k")) == F.slice("ictx", j + 1, F.col("k"))).otherwise(False)
    # fingerprints follow each other within a window, so pieces of a window's length around each cover the whole run in linear time
    right = F.least(F.least(F.col("n_words") - F.col("at"), F.col("m") - F.col("item_at")) - F.col("k"), F.lit(WINDOW)).cast("int")
    left = F.least("at", "item_at", F.lit(WINDOW))
    upto = lambda most: F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    after = F.transform(upto(right), lambda d: F.get("ctx", i + F.col("k") + d - 1) == F.get("ictx", j + F.col("k") + d - 1))
    ahead = F.transform(upto(left), lambda d: F.get("ctx", i - d) == F.get("ictx", j - d))
    runs = hits.select(*own, "n_words", "item_id", "m", "at", "k", F.when(true, run_length(after, right)).alias("r"), F.when(true, run_length(ahead, left)).alias("l"))
    lo, hi = F.col("at") - F.col("l"), F.col("at") + F.col("k") + F.col("r")
    fits = hi - lo >= F.least(F.lit(WINDOW), F.col("m"))
    return runs.select(*own, "n_words", F.when(fits, F.struct(lo.alias("lo"), hi.alias("hi"))).alias("span"), F.when(fits, F.col("item_id")).alias("hit_item"))


def covered(spans: Column) -> Column:
    """Words in the union of spans (lo, hi)."""
    first = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(s["hi"] - F.greatest(s["lo"], a["end"]), F.lit(0))).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), first, step, lambda a: a["n"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word runs lo to hi, which may overlap), items (ids as strings, sorted), contaminated; and the columns of keep, in a struct kept."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "bench-words")
    short = sorted(r["m"] for r in items.where(F.size("iw") < WINDOW).select(F.size("iw").alias("m")).distinct().collect())  # nine at most
    own = items.withColumnRenamed("iw", "w")
    # a gram of K words may be an item of K words or a part of a long one: they are kept apart
    prints = []
    for is_short in (False, True):
        one = short_fingerprints(own.where(F.size("w") < WINDOW), short).where(F.col("k") == F.size("w")) if is_short and short else fingerprints(own.where(F.size("w") >= WINDOW), K, WINDOW - K + 1, False)
        one = one.where("fp is not null").select("item", "k", "n_grams", "fp", "start", *around("start", "w", F.col("k") + F.col("n_grams"), "ctx"))
        # places of an item with equal words around them find the same: one stands for all
        left = F.least("at", F.lit(WINDOW)).alias("__left")
        near = F.slice("ctx", F.col("at") - F.col("ctx_base") - left + 1, left + F.col("k") + WINDOW).alias("__near")
        one = placed(one).groupBy("k", "fp", "item", left, near).agg(F.min("at").alias("item_at"))
        prints.append(materialize(one.select("k", "fp", "item", "item_at"), "bench-prints"))
        if not short:
            break
    sizes = items.agg(F.sum(F.expr("aggregate(iw, 64L, (n, x) -> n + octet_length(x) + 24)"))).first()[0] or 0
    small = sizes + 64 * sum(p.count() for p in prints) <= broadcast_bytes

    docs = documents.select("doc_id", words(F.col("text")).alias("w"), *([F.struct(*keep).alias("kept")] if keep else [])).withColumn("row", F.monotonically_increasing_id())
    if not small or short:
        docs = materialize(docs, "doc-words")
    own = ["row", "doc_id", *(["kept"] if keep else [])]
    hits = None
    for i, ours in enumerate(prints):
        if small:
            # the first pass brings a row for each document besides the hits, so that one scan does all
            rows = short_fingerprints(docs.drop("kept"), short) if i else fingerprints(docs, K, WINDOW - K + 1, keep_empty=True, every=WINDOW - K + 1)
            one = rows.join(F.broadcast(ours.drop("k") if i == 0 else ours), ["fp"] if i == 0 else ["fp", "k"], "inner" if i else "left").where((F.col("start") < 0) | F.col("item").isNotNull())
            one = one.join(F.broadcast(items), "item", "left")
            slices = [*around("start", "w", F.col("k") + F.col("n_grams"), "ctx"), *around("item_at", "iw", F.col("k"), "ictx")]
            more = [] if not keep else [F.when(F.col("start") < 0, F.col("kept")).alias("kept") if i == 0 else kept_null(docs)]
            one = one.select("row", "doc_id", *more, F.size("w").cast("long").alias("n_words"), "k", "n_grams", "start", "item_id", F.size("iw").alias("m"), "item_at", F.when(F.col("item").isNotNull(), F.col("fp")).alias("fp"), *slices)
            one = placed(one)
        else:
            # words travel once for each document and item, not for each hit
            slim = docs.select("row", "w")
            rows = short_fingerprints(slim, short) if i else fingerprints(slim, K, WINDOW - K + 1, keep_empty=False, every=WINDOW - K + 1)
            rows = rows.where("fp is not null").select("row", "k", "n_grams", "fp", "start", *around("start", "w", F.col("k") + F.col("n_grams"), "ctx"))
            met = placed(rows).select("row", "k", "at", "fp").join(ours, ["fp", "k"]).groupBy("row", "item").agg(F.collect_set(F.struct("k", "at", "item_at")).alias("h"))
            one = met.join(docs, "row").join(items, "item").select(*own, "w", "iw", "item_id", F.explode("h").alias("h")).select(*own, "w", "iw", "item_id", "h.*")
            more = [kept_null(docs)] if keep else []
            one = one.select("row", "doc_id", *more, F.size("w").cast("long").alias("n_words"), "k", "at", "item_id", F.size("iw").alias("m"), "item_at", *around("at", "w", F.col("k"), "ctx"), *around("item_at", "iw", F.col("k"), "ictx"))
        one = extended(one, own)
        hits = one if hits is None else hits.unionByName(one)
    if not small:
        void = "cast(null as struct<lo:int,hi:int>)"
        hits = hits.unionByName(docs.select(*own, F.size("w").cast("long").alias("n_words"), F.expr(void).alias("span"), F.expr("cast(null as string)").alias("hit_item")))
    per = hits.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *([F.first("kept", ignorenulls=True).alias("kept")] if keep else []), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("hit_item").alias("items"))
    per = per.withColumn("n_hit", covered(F.col("spans"))).withColumn("items", F.array_sort("items"))
    return per.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"), *(["kept"] if keep else []))


def kept_null(docs: DataFrame) -> Column:
    """No kept columns: the row that a document has besides its hits brings them."""
    return F.lit(None).cast(docs.schema["kept"].dataType).alias("kept")
