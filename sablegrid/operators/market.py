"""Prices, order books, trades, candles and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import as_of, first_rows


def candles(trades: DataFrame, key: list[str], at: str, price: str, seconds: int, volume: Column | None = None) -> DataFrame:
    """open_at, open, high, low, close, volume per key and interval; `order` breaks ties of time."""
    start = (F.floor(F.col(at) / seconds) * seconds).alias("open_at")
    first, last = F.min(F.struct(at, "order", price))[price], F.max(F.struct(at, "order", price))[price]
    return trades.groupBy(*key, start).agg(first.alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last.alias("close"), (F.count(F.lit(1)) if volume is None else F.sum(volume)).alias("volume"))


def deviations(bars: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """bars with oracle (last price at or before the open) and deviation, ten-thousandths of a percent; both null
    where there is no oracle price above zero."""
    met = as_of(bars, oracle, keys, "open_at", "sample_at_s", ["oracle"])
    # whole numbers, rounded half away from zero, so every engine gives the same
    exact = F.expr("((close - oracle) * 1000000 + cast(sign(close - oracle) as bigint) * (oracle div 2)) div oracle")
    return met.withColumn("deviation", F.when(F.col("oracle") > 0, exact))


def deviation_summary(rows: DataFrame, threshold: int) -> DataFrame:
    """One row: points, weighted_sum and weight, mean (weighted by volume, unweighted where there is none; rounded half
    away from zero), max_abs and the earliest time of it, flagged."""
    d = F.col("deviation")
    known = rows.where("deviation is not null")
    rounded = lambda a, b: F.expr(f"cast(sign({a}) as bigint) * ((abs({a}) * 2 + {b}) div ({b} * 2))")
    mean = F.when(F.col("weight") > 0, rounded("weighted_sum", "weight")).when(F.col("points") > 0, rounded("plain", "points"))
    return known.agg(
        F.count(F.lit(1)).alias("points"), F.sum(d * F.col("volume")).alias("weighted_sum"), F.sum("volume").alias("weight"), F.sum(d).alias("plain"), F.max(F.abs(d)).alias("max_abs"),
        F.max(F.struct(F.abs(d).alias("a"), (-F.col("open_at")).alias("t")))["t"].alias("t"), F.count_if(F.abs(d) >= threshold).alias("flagged"),
    ).select("points", "weighted_sum", "weight", mean.alias("mean"), "max_abs", (-F.col("t")).alias("max_at"), "flagged")


def book_summary(levels: DataFrame, keys: list[str], depth: int = 10) -> DataFrame:
    """best_bid, best_ask, mid_x2 (twice the middle), spread, spread_bps, bid_depth, ask_depth, imbalance_ppm over the best levels of each side; a side
    that is missing leaves the spread null, not zero."""
    summed = levels.groupBy(*keys, "side", "price").agg(F.sum("qty").alias("qty"))
    best = first_rows(summed, [*keys, "side"], [F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")).asc()], depth)
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    out = best.groupBy(*keys).agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.coalesce(F.sum(F.when(bid, F.col("qty"))), F.lit(0)).alias("bid_depth"), F.coalesce(F.sum(F.when(ask, F.col("qty"))), F.lit(0)).alias("ask_depth"),
    )
    both = F.col("bid_depth") + F.col("ask_depth")
    out = out.withColumn("mid_x2", F.col("best_bid") + F.col("best_ask")).withColumn("spread_bps", F.expr("((best_ask - best_bid) * 20000) div nullif(best_bid + best_ask, 0)"))
    return out.withColumn("spread", F.col("best_ask") - F.col("best_bid")).withColumn("imbalance_ppm", F.when(both > 0, F.expr("((bid_depth - ask_depth) * 1000000) div (bid_depth + ask_depth)")))


def participation(trades: DataFrame, roles: list[str], key: str, volume: str) -> DataFrame:
    """address, trades, volume: each trade once for every address that has a role in it."""
    sides = trades.select(key, volume, F.explode(F.array_distinct(F.array(*roles))).alias("address")).where("address is not null")
    return sides.dropDuplicates([key, "address"]).groupBy("address").agg(F.count(F.lit(1)).alias("trades"), F.sum(volume).alias("volume"))


def portfolio(holdings: DataFrame, prices: DataFrame, key: str, by: str) -> DataFrame:
    """holdings with value_cents (null where the price is unknown) and the owner's total of known values."""
    valued = holdings.join(prices, key, "left").withColumn("value_cents", F.col("amount") * F.col("price"))
    totals = valued.groupBy(by).agg(F.coalesce(F.sum("value_cents"), F.lit(0)).alias("total_cents"))
    return valued.join(totals, by)


def pipeline_status(events: DataFrame, pipeline: str, behind: int = 600) -> DataFrame:
    """pipeline, latest_checkpoint, checkpoint_lag, time_lag_seconds, status: how far each pipeline is behind the newest
    of all; `behind` where it is by more than so many seconds. events: seq and us (microseconds)."""
    own = events.groupBy(F.col(pipeline).alias("pipeline")).agg(F.max("seq").alias("latest_checkpoint"), F.max("us").alias("us"))
    newest = own.agg(F.max("latest_checkpoint").alias("seq"), F.max("us").alias("newest"))  # one row
    lag = F.floor((F.col("newest") - F.col("us")) / 1_000_000)
    return own.crossJoin(F.broadcast(newest)).select("pipeline", "latest_checkpoint", (F.col("seq") - F.col("latest_checkpoint")).alias("checkpoint_lag"), lag.alias("time_lag_seconds"), F.when(lag > behind, "behind").otherwise("ok").alias("status"))
