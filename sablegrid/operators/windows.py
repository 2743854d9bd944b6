"""Per-key ordering: first and last rows, transitions, running sums, nearest neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


#: Parts that the rows of one key are cut in where rows are dealt to a number of tasks.
PARTS = 32


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int, owners: int | None = None) -> DataFrame:
    """The first n rows of each key. Spark cuts to n rows in each map task before the shuffle (window group limit).

    owners: tasks that take the rows, for tables that outgrow those of the session. Then each key is cut to PARTS * n rows
    first, in as many tasks, so that a key that holds most rows isn't one task.
    """
    first = lambda of, by: of.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    if owners is not None:
        each = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))).repartition(owners, *keys, "_part")
        rows = first(each, [*keys, "_part"]).drop("_part").repartition(owners, *keys)
    return first(rows, keys)


def transitions(versions: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Owner changes of each object in version order: object, from_owner, to_owner, at_version.

    Versions are cut into spans, so an object that holds most rows is many tasks; the first of a span follows the last
    of the object's span before.
    """
    cut = versions.select("object", "version", "owner", F.floor(F.col("version") / span).alias("_span"))
    ends = cut.groupBy("object", "_span").agg(F.max_by("owner", "version").alias("_end"))
    inherited = ends.select("object", "_span", F.lag("_end").over(W.partitionBy("object").orderBy("_span")).alias("_end"))
    w = W.partitionBy("object", "_span").orderBy("version")
    before = F.when(F.col("_n") == 1, F.col("_end")).otherwise(F.col("_lag"))
    met = cut.withColumn("_n", F.row_number().over(w)).withColumn("_lag", F.lag("owner").over(w)).join(inherited, ["object", "_span"])
    return met.withColumn("from_owner", before).where(F.col("from_owner").isNotNull() & (F.col("from_owner") != F.col("owner"))).select("object", "from_owner", F.col("owner").alias("to_owner"), F.col("version").alias("at_version"))


def select_until(rows: DataFrame, keys: list[str], amount: str, target: Column, order: list[Column], band: Column) -> DataFrame:
    """Rows in order until their sum reaches the target: those before which the sum was still short.

    Amounts are not negative. band is a whole number that never falls in the order: a band starts at the sum of those
    before it, bands that start at the target or beyond are dropped before any row is sorted, and each other band
    is sorted apart.
    """
    cut = rows.withColumn("_band", band)
    sums = cut.groupBy(*keys, "_band").agg(F.sum(amount).alias("_sum"))
    so_far = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0))
    starts = sums.select(*keys, "_band", (so_far - F.col("_sum")).alias("_start")).where(F.col("_start") < target)
    w = W.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = cut.join(starts, [*keys, "_band"]).withColumn("running", F.sum(amount).over(w) + F.col("_start"))
    return met.where(F.col("running") - F.col(amount) < target).select(*rows.columns, "running")


def as_of(rows: DataFrame, samples: DataFrame, keys: list[str], at: str, sample_at: str, values: list[str], span: int = 86_400) -> DataFrame:
    """rows with the values of the last sample of the same key at or before each row's time (nulls if there is none).

    Samples and rows are laid into one stream and each row takes the last sample before it. The stream is cut into
    spans of time, so a key that holds most rows is many tasks; what a span inherits from those before it comes
    from a table of each span's last sample.
    """
    carried = F.struct(F.col(sample_at).alias("at"), *values)
    bucket = F.floor(F.col("_t") / span)
    kind = samples.select(carried.alias("s")).schema["s"].dataType
    left = rows.withColumn("_row", F.lit(1)).withColumn("_sample", F.lit(None).cast(kind)).withColumn("_t", F.col(at))
    right = samples.select(*keys, carried.alias("_sample"), F.col(sample_at).alias("_t"), F.lit(0).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_span", bucket)
    ends = both.groupBy(*keys, "_span").agg(F.max_by("_sample", F.when(F.col("_row") == 0, F.col("_t"))).alias("_end"))
    past = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(past)).drop("_end")
    own = W.partitionBy(*keys, "_span").orderBy("_t", "_row").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_own", F.last("_sample", ignorenulls=True).over(own)).where("_row = 1").join(before, [*keys, "_span"], "left")
    last = met.withColumn("_last", F.coalesce("_own", "_before"))
    return last.select(*rows.columns, F.col("_last.at").alias("sample_at"), *[F.col(f"_last.{v}").alias(v) for v in values])


def nearest_checkpoint(events: DataFrame, targets: DataFrame, width: int = 3600) -> DataFrame:
    """For each target second: the seq of the event nearest in time, the smaller one on a tie.

    The last event at or before and the first after the target are all that can be nearest; both come from one pass.
    """
    t = events.select(micros(F.col("ts")).alias("us"), "seq").groupBy("us").agg(F.min("seq").alias("seq"))
    asked = targets.select((F.col("target") * 1_000_000).alias("us"), "target")
    both = t.withColumn("target", F.lit(None).cast("long")).unionByName(asked.withColumn("seq", F.lit(None).cast("long")))
    # a span's events meet in one task; its neighbours' ends are carried over so that no span is read as a whole twice
    span = F.floor(F.col("us") / (width * 1_000_000))
    ends = t.groupBy(span.alias("span")).agg(F.max(F.struct("us", "seq")).alias("last"), F.min(F.struct("us", "seq")).alias("first"))
    # what follows is what precedes in falling order: a frame that begins at the row would be read anew for each row
    past = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spans = both.select(span.alias("span")).distinct().join(ends, "span", "left").select(
        "span", F.last("last", ignorenulls=True).over(past("span")).alias("earlier"), F.last("first", ignorenulls=True).over(past(F.desc("span"))).alias("later")
    )  # one row a span
    own, seen, w = F.when(F.col("seq").isNotNull(), F.struct("us", "seq")), W.unboundedPreceding, W.partitionBy("span")
    up, down = w.orderBy("us", F.col("seq").asc_nulls_last()).rowsBetween(seen, 0), w.orderBy(F.desc("us"), F.col("seq").desc_nulls_first()).rowsBetween(seen, 0)
    near = both.withColumn("span", span).withColumn("before", F.last(own, ignorenulls=True).over(up)).withColumn("after", F.last(own, ignorenulls=True).over(down))
    found = near.where("target is not null").join(spans, "span", "left").select("target", "us", F.coalesce("before", "earlier").alias("b"), F.coalesce("after", "later").alias("a"))
    gap_b, gap_a = F.col("us") - F.col("b.us"), F.col("a.us") - F.col("us")
    return found.select("target", F.when(F.col("a").isNull() | (gap_b <= gap_a), F.col("b.seq")).otherwise(F.col("a.seq")).alias("seq"))
