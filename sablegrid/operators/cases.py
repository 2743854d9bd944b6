"""Findings of investigations: latest state of an append-only log, case lists, ordering and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import normalize_address
from ..sources.ledger import CATEGORIES

def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """State of an append-only log: the last row of each key, unless it marks a deletion (column deleted)."""
    last = log.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
    return last.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in log.columns else last


def case_list(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_name").agg(F.count(F.lit(1)).alias("findings"), F.max("created_at").alias("last_at"))


def confidence_rank(confidence: Column) -> Column:
    level = F.lower(confidence)
    return F.when(level == "high", 0).when(level == "medium", 1).when(level == "low", 2).otherwise(3)


def case_order(findings: DataFrame) -> DataFrame:
    """Position of each finding in its case: by confidence, then time, then id."""
    w = W.partitionBy("case_name").orderBy(confidence_rank(F.col("confidence")), "created_at", "id")
    return findings.withColumn("position", F.row_number().over(w).cast("long"))


def import_labels(raw: DataFrame) -> DataFrame:
    """Well-formed labels with normalised addresses; accepted tells them from rows that are passed over."""
    good = F.col("address").isNotNull() & (F.trim("address") != "") & F.col("label").isNotNull() & F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    return raw.withColumn("accepted", good).withColumn("address", F.when(good, normalize_address(F.col("address"))).otherwise(F.col("address")))


def short_address(a: Column) -> Column:
    return F.when(F.length(a) > 20, F.concat(F.substring(a, 1, 10), F.lit("…"), F.right(a, F.lit(6)))).otherwise(a)


def report_lines(findings: DataFrame, generated_at: int, appendix: bool = True) -> DataFrame:
    """case_name, part, place, n, line: the reports of all cases in Markdown, line by line in the order of part, place, n.

    findings: id, case_name, title, detail, confidence, created_at (milliseconds), addresses and evidence (arrays). A
    report has its scope (findings, addresses, time) first, then findings by confidence and time, then an appendix of
    the whole addresses in the order in which they first come up. No case is gathered: lines are rows.
    """
    moment = lambda ms, form: F.date_format(F.timestamp_millis(ms.cast("long")), form)
    plural = lambda n, word, more: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise(more))
    stamp, at = F.lit(generated_at).cast("long"), F.coalesce("created_at", F.lit(generated_at))
    placed = case_order(findings)
    named = placed.select("case_name", "position", F.posexplode("addresses").alias("i", "address"))
    first = named.groupBy("case_name", "address").agg(F.min(F.struct("position", "i")).alias("at"))
    scope = placed.groupBy("case_name").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).join(first.groupBy("case_name").agg(F.count(F.lit(1)).alias("m")), "case_name", "left")
    many = F.coalesce("m", F.lit(0))
    about = F.concat(plural(F.col("n"), "finding", "s"), F.lit(" · "), plural(many, "address", "es"), F.lit(" · recorded "), moment(F.col("a"), "yyyy-MM-dd HH:mm"), F.lit(" – "), moment(F.col("b"), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    blank, none = F.lit(""), F.array().cast("array<string>")
    head = scope.select("case_name", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.array(F.concat(F.lit("# "), "case_name"), blank, about, blank).alias("lines"))
    listed = lambda title, rows, line: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(f"**{title}**"), blank), F.transform(rows, line), F.array(blank))).otherwise(none)
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    body = F.concat(
        F.array(F.concat(F.lit("## "), "title"), blank), F.when(has("confidence"), F.array(F.concat(F.lit("**Confidence:** "), "confidence"), blank)).otherwise(none),
        F.when(has("detail"), F.array(F.col("detail"), blank)).otherwise(none),
        listed("Addresses", F.coalesce("addresses", none), lambda a: F.concat(F.lit("- `"), short_address(a), F.lit("`"))), listed("Evidence", F.coalesce("evidence", none), lambda e: F.concat(F.lit("- "), e)),
    )
    out = head.unionByName(placed.select("case_name", F.lit(1).alias("part"), F.col("position").alias("place"), body.alias("lines")))
    if appendix:
        out = out.unionByName(first.select("case_name").distinct().select("case_name", F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.array(F.lit("## Appendix: full addresses"), blank).alias("lines")))
        order = F.row_number().over(W.partitionBy("case_name").orderBy("at"))
        out = out.unionByName(first.select("case_name", F.lit(2).alias("part"), order.cast("long").alias("place"), F.array(F.concat(F.lit("- `"), "address", F.lit("`"))).alias("lines")))
    foot = F.array(F.lit("---"), blank, F.concat(F.lit("_Generated at "), moment(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC._")))
    apart = F.when(many > 0, F.array(blank)).otherwise(none) if appendix else none
    out = out.unionByName(scope.select("case_name", F.lit(3).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(apart, foot).alias("lines")))
    return out.select("case_name", "part", "place", F.posexplode("lines").alias("n", "line"))


def case_report(findings: DataFrame, case_name: str, generated_at: int) -> str:
    """The report of one case as text, read line by line; what people noted on one case, so it fits the driver."""
    rows = report_lines(findings.where(F.col("case_name") == case_name), generated_at).orderBy("part", "place", "n").toLocalIterator()
    text = "\n".join(r.line for r in rows)
    return (text or f"# {case_name}\n\n_No findings recorded for this case yet._") + "\n"
