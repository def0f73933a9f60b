"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and works on all that its predecessor kept.
All but the last return these columns; the last returns the tokens of the documents that are left. Stages are written to
the shared folder between each other, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm import bpe, common, decontaminate, language_id, line_dedup, minhash_dedup

#: Below this calibrated score the language is taken as unknown.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language stay: those without a letter, without text or with a score under LEAST_SCORE go.

    A null text goes; a null id or lang is judged by its text like any other; equal rows share their fate; an empty table stays
    empty; columns of docs called lang_pred, score or row pass through. With no labelled row to learn from all go.
    """
    model = language_id.train(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return language_id.identify(rows, model).where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut; a document of which nothing is left goes. n_chars follows the text.

    A null text stays null and stays; a null id comes after all others; equal rows lose the same lines; an empty table stays
    empty; columns of docs with the names of the operator's results pass through.
    """
    own = docs.select(F.struct(*[x for x in docs.columns if x != "text"]).alias("row"), "doc_id", "text")
    out = line_dedup.dedup_lines(own).where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    columns = {x: F.col("row")[x] for x in docs.columns if x != "text"}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(columns["n_chars"])
    return out.select(*["text" if x == "text" else columns[x].alias(x) for x in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows of one id are one node of the operator's graph: of those one stays, with the smallest text (then the smallest row as
    json). A null or wordless text and a null id are in no group and stay; an empty table stays empty; columns of docs with
    the names of the operator's results pass through.
    """
    ids = common.staged(minhash_dedup.dedup(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if("kept").alias("n")), "ids")
    gone = common.staged(ids.where("n = 0").select("doc_id"), "gone")  # fewer than stay, and of a size that the join knows
    out = docs.join(gone, docs.doc_id.cast("bigint") == gone.doc_id, "left_anti")
    several = ids.where("n > 1").select("doc_id")
    if several.isEmpty():
        return out
    several = common.staged(several, "several")
    own = out.doc_id.cast("bigint") == several.doc_id
    one = out.join(several, own, "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.to_json(F.struct(*docs.columns)))).alias("row"))
    return out.join(several, own, "left_anti").unionByName(one.select("row.*"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    A null or wordless text holds none and stays; ids play no part; equal rows share their fate; with an empty table of documents
    or items nothing goes; columns of docs with the names of the operator's results pass through.
    """
    out = decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))
    return out.where(F.size("starts") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), their number, and the digests of ids and of what they decode to.

    A null text has no ids; every row gives one, null and repeated ids too; other columns of docs are left out.
    """
    out = bpe.encode_decode(docs.select("doc_id", "text"))
    return out.select("doc_id", "ids", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", contamination), ("bpe", tokens)]
#: Training, component search and tokenisation are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.staged(docs, f"stage-{name}")
    return docs
