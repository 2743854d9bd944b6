"""Event aggregation: grouping with missing-value counts, ranking, distribution and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import numeric_paths
from ..sources.shared import written


def group_events(events: DataFrame, key: str, value: Column | None = None, scale: int = 1) -> DataFrame:
    """key, event_count, value_sum, missing_value_count. Rows with a null or empty key are not in any group.

    A group whose values are all missing sums to zero; without a value column the sum is null. A scale of zero is one.
    """
    keyed = events.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    v = F.lit(None).cast("long") if value is None else value
    total = F.coalesce(F.sum("v"), F.lit(0))
    if scale not in (0, 1):
        total = total / F.lit(scale)
    out = keyed.select(F.col(key).alias("key"), v.alias("v")).groupBy("key").agg(F.count(F.lit(1)).alias("event_count"), total.alias("value_sum"), F.sum(F.col("v").isNull().cast("long")).alias("missing_value_count"))
    return out if value is not None else out.withColumn("value_sum", F.lit(None).cast("long"))


def rank_groups(groups: DataFrame, metric: str = "value_sum", top: int = 20, ascending: bool = False) -> DataFrame:
    """The top groups by the metric, then by count, then by key (always ascending)."""
    way = F.asc if ascending else F.desc
    return groups.orderBy(way(metric), way("event_count"), F.asc("key")).limit(top)


def percentiles(values: DataFrame, column: str, ranks: dict[str, int]) -> DataFrame:
    """One row: nearest-rank percentiles of a whole-number column, with min, max and total; nulls if there are no rows.

    Equal values are one row with a count. Values are dealt to ranges; a range starts at the count of those before it,
    so only the ranges' counts meet in one task and each range is numbered by its own.
    """
    return _ranked(values.select(F.lit(column).alias("metric"), F.col(column).alias("v")), [column], ranks).drop("metric")


#: Leading bits of a number that name its range.
LEADING = 8


def value_range(v: Column) -> Column:
    """A number's range, in order: its sign, how many bits it has, and the first LEADING of them. A range is as wide as
    its numbers are large, so of heavy-tailed values each range has about as many, and no outlier fills one with all the
    others. There are 2 * 64 * 2 ** LEADING ranges at most."""
    size = F.abs(v.cast("decimal(20,0)"))  # the least long has no positive one
    bits = F.when(size == 0, 0).otherwise(F.floor(F.log2(size.cast("double"))) + 1)
    first = F.floor(size.cast("double") / F.pow(F.lit(2.0), F.greatest(bits - LEADING, F.lit(0))))
    return F.when(v < 0, -1).otherwise(1) * (bits * (1 << (LEADING + 2)) + first)


def _ranked(rows: DataFrame, metrics: list[str], ranks: dict[str, int]) -> DataFrame:
    """A row for each metric of rows (metric, v), all metrics in one pass. The counts of equal values are written once,
    for the ranges' counts and the numbering of the ranges that hold a rank both read them."""
    hist = written(rows.where("v is not null").groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("range", value_range(F.col("v")).cast("long")), "values")
    sizes = hist.groupBy("metric", "range").agg(F.sum("n").alias("held"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v") * F.col("n")).cast("long").alias("sum"))
    before = W.partitionBy("metric").orderBy("range").rowsBetween(W.unboundedPreceding, 0)  # a row a range
    every = W.partitionBy("metric")
    placed = sizes.withColumn("upto", F.sum("held").over(before)).withColumn("rows", F.sum("held").over(every))
    placed = placed.withColumns({"start": F.col("upto") - F.col("held"), "min": F.min("low").over(every), "max": F.max("high").over(every), "total": F.sum("sum").over(every)})
    at = {name: F.greatest(F.lit(1), F.ceil(F.col("rows") * p / 100.0)) for name, p in ranks.items()}
    wanted = F.array_distinct(F.array(*[r.cast("long") for r in at.values()]))
    holding = placed.where(F.exists(wanted, lambda r: (F.col("start") < r) & (r <= F.col("upto")))).drop("held", "low", "high", "sum", "upto")
    met = hist.join(F.broadcast(holding), ["metric", "range"])  # a range for each rank at most
    upto = F.sum("n").over(W.partitionBy("metric", "range").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("start")
    picks = [F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("n") < r), F.col("v"))).alias(name) for name, r in at.items()]
    found = met.withColumn("upto", upto).groupBy("metric").agg(F.min("min").alias("min"), *picks, F.max("max").alias("max"), F.max("total").alias("total"))
    return rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string").join(found, "metric", "left")


RANKS = {"p25": 25, "median": 50, "p75": 75, "p95": 95}


def distribution(groups: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a metric over all groups."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics]))
    return _ranked(groups.select(each.alias("x")).select("x.*"), metrics, RANKS)


def totals(events: DataFrame, key: str, budget: int | None = None) -> DataFrame:
    """One row: distinct_keys, events_aggregated, ungrouped_count, truncated (whether a budget cut the events)."""
    missing = F.col(key).isNull() | (F.col(key).cast("string") == "")
    seen = F.count(F.lit(1))
    cut = F.lit(False) if budget is None else seen > budget
    return events.agg(F.count_distinct(F.when(~missing, F.col(key))).alias("distinct_keys"), seen.alias("events_aggregated"), F.sum(missing.cast("long")).alias("ungrouped_count"), cut.alias("truncated"))


def discovery(events: DataFrame, top: int = 15) -> DataFrame:
    """type, event_count, first_sample (payload of the smallest seq that has one), numeric_fields of that sample."""
    first = F.min(F.when(F.col("payload").isNotNull(), F.struct("seq", "payload")))["payload"]
    found = events.groupBy("type").agg(F.count(F.lit(1)).alias("event_count"), first.alias("first_sample"))
    return numeric_fields(found, "first_sample").orderBy(F.desc("event_count"), "type").limit(top)


def numeric_fields(rows: DataFrame, column: str) -> DataFrame:
    """rows with numeric_fields: dotted paths of the number-like members of a JSON object at any depth, arrays passed
    over, sorted."""
    return rows.withColumn("numeric_fields", F.array_join(numeric_paths(F.col(column)), ","))
