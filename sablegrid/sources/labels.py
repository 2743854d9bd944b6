"""Label files: attribution that an organisation keeps beside the curated labels."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_address, text_field

LABELS = "address string, label string, category string, source string, confidence string, notes string"
BROKEN = "_broken"

log = logging.getLogger(__name__)


def label_files(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, broken) of label files: address and content (JSON) of each label, and the records that are no JSON.

    With lines, a file has one label a line, its address among its members, and is split over tasks; else it is one
    object whose member `labels` has a label for each address. A missing path gives empty tables and a warning; files
    that can't be read (cut short, not permitted) are passed over, so a bad file never stops a run.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    members = "address string" if lines else "labels map<string, string>"
    try:
        raw = reader.text(path, wholetext=not lines).where(F.trim("value") != "")
        read = raw.select("value", F.from_json("value", f"{members}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN}).alias("p"))
        good, broken = read.where(f"p.{BROKEN} is null"), read.where(f"p.{BROKEN} is not null").select(F.col("value").alias("record"))
        if lines:
            return good.select(text_field(F.col("value"), "address").alias("address"), F.col("value").alias("content")), broken
        return good.select(F.explode("p.labels").alias("address", "content")), broken
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("no label file at %s", path)
        return spark.createDataFrame([], "address string, content string"), spark.createDataFrame([], "record string")


def read_labels(spark: SparkSession, path: str, source: str = "override", lines: bool = True) -> DataFrame:
    """address, label, category, source, confidence, notes of label files; of an address named again the least row.

    Addresses are normalised. A row whose label or category is missing or no text, or that has no address, is passed
    over; a missing source is `source`.
    """
    rows, _ = label_files(spark, path, lines)
    text = lambda name: text_field(F.col("content"), name)
    read = rows.select(normalize_address(F.col("address")).alias("address"), text("label").alias("label"), text("category").alias("category"), F.coalesce(text("source"), F.lit(source)).alias("source"), text("confidence").alias("confidence"), text("notes").alias("notes"))
    return read.where("address is not null and label is not null and category is not null").groupBy("address").agg(F.min(F.struct("label", "category", "source", "confidence", "notes")).alias("l")).select("address", "l.*")


def overridden(labels: DataFrame, files: DataFrame) -> DataFrame:
    """labels with those of files in their place: an address that both name has the file's."""
    return files.unionByName(labels.join(files.select("address"), "address", "left_anti"))
