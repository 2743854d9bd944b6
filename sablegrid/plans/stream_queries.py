"""Streaming twins of event queries, run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger, ctes
from ..streaming import keyed, twins
from .registry import query

EV = ctes("ev")


@query(EV + " SELECT seq, sender, cents FROM ev WHERE type = 'purchase' AND seq > 2000")
def stream_new_events(l: Ledger) -> DataFrame:
    rows = twins.new_events(twins.event_stream(l.spark, l.path), (F.col("type") == "purchase") & (F.col("seq") > 2000))
    return twins.to_table(l.spark, rows.select("seq", "sender", "cents"), "append")


@query(EV + " SELECT sender AS key, count(*) AS event_count, sum(cents)::BIGINT AS value_sum FROM ev GROUP BY 1")
def stream_aggregate_events(l: Ledger) -> DataFrame:
    return twins.to_table(l.spark, twins.sums_by(twins.event_stream(l.spark, l.path), "sender"), "complete")


@query(EV + " SELECT (epoch_us(ts) // 3600000000)::BIGINT AS hour, type, count(*) AS event_count, sum(cents)::BIGINT AS value_sum FROM ev GROUP BY 1, 2")
def stream_hourly_events(l: Ledger) -> DataFrame:
    rows = twins.to_table(l.spark, twins.sums_by_hour(twins.event_stream(l.spark, l.path)), "complete")
    return rows.select(F.floor(F.unix_seconds("hour") / 3600).alias("hour"), "type", "event_count", "value_sum")


_LATE = "(SELECT max(ts) FROM {0}) - INTERVAL 10 MINUTE"


@query(ctes("ver") + f""", s AS (SELECT * FROM ver WHERE ts <= {_LATE.format("ver")}), w AS (SELECT object, version, owner, lag(owner) OVER (PARTITION BY object ORDER BY version) AS before FROM s)
    SELECT object, before AS from_owner, owner AS to_owner, version AS at_version FROM w WHERE before <> owner""")
def stream_owner_changes(l: Ledger) -> DataFrame:
    """Owner changes of all versions that the watermark has passed, from state kept for each object."""
    e = twins.event_stream(l.spark, l.path)
    versions = e.select(F.col("sender").alias("object"), F.col("seq").alias("version"), F.col("type").alias("owner"), "ts")
    with keyed.keyed_state(l.spark):
        return twins.to_table(l.spark, keyed.owner_changes(versions), "append")


@query(EV + f""", p AS (SELECT sender % 5 AS pair, ts, seq, cents FROM ev WHERE type = 'purchase')
    SELECT pair, (epoch_us(ts) // 14400000000 * 4)::BIGINT AS hour, arg_min(cents, (ts, seq)) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, (ts, seq)) AS close, count(*) AS trades, sum(cents)::BIGINT AS volume
    FROM p GROUP BY 1, 2 HAVING (any_value(epoch_us(ts)) // 14400000000 + 1) * 14400000000 <= (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE) FROM p)""")
def stream_candles(l: Ledger) -> DataFrame:
    """Candles of four hours, each given once, when it is final."""
    e = twins.event_stream(l.spark, l.path).where("type = 'purchase'")
    trades = e.select((F.col("sender") % 5).alias("pair"), "ts", "seq", F.col("cents").alias("price"), F.col("cents").alias("size"))
    bars = twins.to_table(l.spark, keyed.candles(trades, "4h"), "append")
    return bars.select("pair", F.floor(F.unix_seconds("open_at") / 3600).alias("hour"), "open", "high", "low", "close", "trades", "volume")
