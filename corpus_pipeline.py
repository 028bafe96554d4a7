"""A training corpus from documents: language, lines, near copies, benchmark leaks, tokens.

Each stage reads what the one before it has written. All but the last return the columns of documents, also those that are
named like a column of an operator. Rows are judged one by one, so repeated and null ids are rows like any other where a stage does not say
otherwise. Texts are read whole in every stage. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontam, lang_id, line_dedup, ngram_join
from gristmill.llm.common import materialize, scratch, shared_folder, table, without
from gristmill.llm.queries import tokenizer

#: A language is accepted from this posterior on.
LEAST_SCORE = 0.5


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all columns of docs as the struct doc: no name of theirs can clash with an operator's."""
    return docs.select(*needed, F.struct(*docs.columns).alias("doc"))


def unpacked(rows: DataFrame, columns: list[str], **new) -> DataFrame:
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; lang becomes the predicted one.

    Null texts and texts without a letter have no language and go, as does everything where no row has a language to learn from. Equal texts are
    treated alike, whatever their ids.
    """
    found = lang_id.identify_documents(packed(docs, "doc_id", "text", "lang")).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return unpacked(found, docs.columns, lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those left without any word go (as do null and empty texts).

    A document is a doc_id here: rows that repeat one lose the same lines, null ids come after all others. n_chars, where it is there, follows the text.
    """
    out = line_dedup.dedup_lines(packed(docs, "doc_id", "text")).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **new)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows that repeat a doc_id are one document and stay or go together; rows with a null id stay, as nothing names them. Texts without words link with nothing.
    """
    return ngram_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    What decides is the text alone: rows of one id with different texts are judged apart, rows with null ids like all others. Null texts and those without words are clean.
    """
    keyed = docs.withColumn("__text", F.unhex(F.md5("text")))
    hit = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), keep=["__text"]).where("contaminated").select("kept.__text").distinct()
    return without(keyed, materialize(hit, "leaking-texts"), "__text").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, a row for each row; a null text has no ids."""
    return bpe.encode_digests(docs, *tokenizer())


STAGES = [("language ID", identify_language), ("line dedup", dedup_lines), ("n-gram Jaccard join", join_near_copies), ("benchmark decontamination", decontaminate), ("byte-level BPE", encode_tokens)]

#: Language models and byte-pair encoding are beyond SQL; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table documents; the rows of the last one.

    Each stage's output is a table in the shared folder, so that a lost executor costs no stage again; what a stage writes besides is deleted behind it.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage-{i}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
