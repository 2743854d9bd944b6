"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and all that the stage before it kept. It is written as Parquet and read
again as the next one's docs; all but the last return the columns of documents.

All stages read whole texts, however long, and look at doc_id and text alone (the first also at the labels); other columns
pass through, whatever their names, and an empty table gives an empty one. What a stage does with nulls, empty texts,
repeats and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablegrid.llm import exact_dedup, packing, quality, queries, secrets, shared, simhash


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a score just at the threshold stays. Null and empty texts are scored
    like any other, rows without an id too, and rows that repeat an id each for itself."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays, and all rows that repeat it. Null and empty texts are
    equal. Rows without an id stay."""
    return shared.without(docs, exact_dedup.exact_dedup(docs).where("not kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of the smallest id. Null, empty and blank texts are one
    group; a pair at exactly the similarity is linked. Rows without an id stay; rows that repeat one stay or go together."""
    return simhash.near_dedup(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it give way to a mark, overlapping ones to one, and n_chars follows. Null texts
    stay null; rows without an id or that repeat one are each treated for themselves."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document becomes pieces in sequences; null and empty texts are the end id alone. Of equally full sequences
    the one that was left so last is taken. Rows without an id or that repeat one are packed one by one."""
    return packing.best_fit_pack(docs, packing.PackParams(queries.word_tokenizer()))


STAGES = [("quality", accept), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", hide_secrets), ("packing", pack)]

#: SQL can't express the classifier, the fingerprints and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
