"""Queries over prices, books, trades, holdings and stakes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import market, windows
from ..sources.ledger import Ledger, cents, ctes
from .registry import query

EV = ctes("ev")


@query(EV + """, p AS (SELECT seq, sender, ts, cents FROM ev WHERE type = 'purchase'), v AS (SELECT sender, ts, max(cents) AS price FROM ev WHERE type = 'view' GROUP BY ALL)
    SELECT p.seq, p.sender, p.cents, v.price, (epoch_us(p.ts) // 1000000 - epoch_us(v.ts) // 1000000)::BIGINT AS price_age_sec, coalesce(epoch_us(p.ts) // 1000000 - epoch_us(v.ts) // 1000000 > 3600, false) AS price_stale FROM p ASOF LEFT JOIN v ON p.sender = v.sender AND p.ts >= v.ts""")
def asof_price(l: Ledger) -> DataFrame:
    e = l.events().withColumn("us", windows.micros(F.col("ts")))
    rows = e.where("type = 'purchase'").select("seq", "sender", "us", "cents")
    samples = e.where("type = 'view'").groupBy("sender", F.col("us").alias("at")).agg(F.max("cents").alias("price"))
    met = windows.as_of(rows, samples, ["sender"], "us", "at", ["price"], span=86_400_000_000)
    age = (F.floor(F.col("us") / 1_000_000) - F.floor(F.col("sample_at") / 1_000_000)).cast("long")
    return met.select("seq", "sender", "cents", "price", age.alias("price_age_sec"), F.coalesce(age > 3600, F.lit(False)).alias("price_stale"))


_BARS = EV + """, b AS (SELECT (epoch_us(ts) // 3600000000) * 3600 AS open_at, arg_min(cents, (ts, seq)) AS open, max(cents) AS high, min(cents) AS low, arg_max(cents, (ts, seq)) AS close, count(*) AS volume FROM ev WHERE type = 'purchase' GROUP BY 1),
    o AS (SELECT epoch_us(ts) // 1000000 AS s, arg_max(cents, (ts, seq)) AS oracle FROM ev WHERE type = 'view' GROUP BY 1),
    d AS (SELECT b.*, o.oracle, CASE WHEN o.oracle > 0 THEN (sign(close - o.oracle) * ((abs(close - o.oracle) * 1000000 + o.oracle // 2) // o.oracle))::BIGINT END AS deviation FROM b ASOF LEFT JOIN o ON b.open_at >= o.s)"""


def _bars(l: Ledger) -> DataFrame:
    e = l.events().withColumn("us", windows.micros(F.col("ts")))
    trades = e.where("type = 'purchase'").select(F.floor(F.col("us") / 1_000_000).alias("at_s"), F.struct("us", "seq").alias("order"), "cents", F.lit(0).alias("pair"))
    bars = market.candles(trades, ["pair"], "at_s", "cents", 3600)
    last = F.max(F.struct("us", "seq", "cents"))["cents"]
    oracle = e.where("type = 'view'").groupBy(F.lit(0).alias("pair"), F.floor(F.col("us") / 1_000_000).alias("sample_at_s")).agg(last.alias("oracle"))
    return market.deviations(bars, oracle, ["pair"])


@query(_BARS + " SELECT open_at::BIGINT AS open_at, open, high, low, close, volume, oracle, deviation FROM d")
def oracle_deviation(l: Ledger) -> DataFrame:
    return _bars(l).select("open_at", "open", "high", "low", "close", "volume", "oracle", "deviation")


@query(_BARS + " SELECT count(*) AS points, sum(deviation * volume)::BIGINT AS weighted_sum, sum(volume)::BIGINT AS weight, max(abs(deviation)) AS max_abs, arg_max(open_at, (abs(deviation), -open_at))::BIGINT AS max_at, count(*) FILTER (abs(deviation) >= 500000) AS flagged FROM d WHERE deviation IS NOT NULL")
def deviation_summary(l: Ledger) -> DataFrame:
    return market.deviation_summary(_bars(l), 500_000).drop("mean")


@query(_BARS + ", s AS (SELECT count(*) AS points, sum(deviation * volume)::BIGINT AS a, sum(volume)::BIGINT AS b, sum(deviation)::BIGINT AS c FROM d WHERE deviation IS NOT NULL) SELECT points, CASE WHEN b > 0 THEN (sign(a) * ((abs(a) * 2 + b) // (b * 2)))::BIGINT ELSE (sign(c) * ((abs(c) * 2 + points) // (points * 2)))::BIGINT END AS mean FROM s")
def deviation_mean(l: Ledger) -> DataFrame:
    return market.deviation_summary(_bars(l), 500_000).select("points", "mean")


@query("""WITH b AS (SELECT p_type AS pair, CASE l_returnflag WHEN 'A' THEN 'bid' ELSE 'ask' END AS side, round(l_extendedprice * 100)::BIGINT // l_quantity::BIGINT AS price, l_quantity::BIGINT AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'N')),
    s AS (SELECT pair, side, price, sum(qty)::BIGINT AS qty FROM b GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM s) t WHERE n <= 10),
    a AS (SELECT pair, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask, coalesce(sum(qty) FILTER (side = 'bid'), 0)::BIGINT AS bid_depth, coalesce(sum(qty) FILTER (side = 'ask'), 0)::BIGINT AS ask_depth FROM k GROUP BY 1)
    SELECT *, best_ask - best_bid AS spread, best_bid + best_ask AS mid_x2, trunc((best_ask - best_bid) * 20000.0 / (best_bid + best_ask))::BIGINT AS spread_bps, CASE WHEN bid_depth + ask_depth > 0 THEN trunc((bid_depth - ask_depth) * 1000000.0 / (bid_depth + ask_depth))::BIGINT END AS imbalance_ppm FROM a""")
def book_summary(l: Ledger) -> DataFrame:
    line = l.table("lineitem").where("l_returnflag in ('A', 'N')").join(l.parts(), F.col("l_partkey") == F.col("p_partkey"))
    levels = line.select(F.col("p_type").alias("pair"), F.when(F.col("l_returnflag") == "A", "bid").otherwise("ask").alias("side"), cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("qty"))
    return market.book_summary(levels.select("pair", "side", F.expr("c div qty").alias("price"), "qty"), ["pair"])


@query(ctes("bc") + ", t AS (SELECT DISTINCT digest, address FROM bc), v AS (SELECT digest, sum(cents)::BIGINT AS volume FROM bc WHERE cents > 0 GROUP BY 1) SELECT address, count(*) AS trades, sum(volume)::BIGINT AS volume FROM t JOIN v USING (digest) GROUP BY 1")
def trade_participation(l: Ledger) -> DataFrame:
    c = l.changes()
    volume = c.where("cents > 0").groupBy("digest").agg(F.sum("cents").alias("volume"))
    sides = c.groupBy("digest", F.ceil(F.col("ord") / 2).alias("line")).agg(F.min_by("address", "ord").alias("maker"), F.max_by("address", "ord").alias("taker"))
    return market.participation(sides.join(volume, "digest"), ["maker", "taker"], "digest", "volume")


_HELD = ctes("tx", "ln") + ", h AS (SELECT o_custkey AS owner, l_partkey AS item, sum(l_quantity)::BIGINT AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), px AS (SELECT p_partkey AS item, round(p_retailprice * 100)::BIGINT AS price FROM part)"


def _prices(l: Ledger) -> DataFrame:
    return l.table("part").select(F.col("p_partkey").alias("item"), cents("p_retailprice").alias("price"))


def _holdings(l: Ledger) -> DataFrame:
    line = l.table("lineitem").join(l.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.groupBy(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("amount"))


@query(_HELD + ", v AS (SELECT owner, h.item, amount, price, amount * price AS value_cents FROM h LEFT JOIN px ON h.item = px.item) SELECT *, coalesce(sum(value_cents) OVER (PARTITION BY owner), 0)::BIGINT AS total_cents FROM v")
def portfolio(l: Ledger) -> DataFrame:
    return market.portfolio(_holdings(l), _prices(l), "item", "owner").select("owner", "item", "amount", "price", "value_cents", "total_cents")


@query(_HELD + " SELECT h.item, sum(amount)::BIGINT AS supply, (sum(amount) * min(price))::BIGINT AS market_cap_cents FROM h LEFT JOIN px ON h.item = px.item GROUP BY 1")
def market_cap(l: Ledger) -> DataFrame:
    supply = l.table("lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("supply"))
    return supply.join(_prices(l), "item", "left").select("item", "supply", (F.col("supply") * F.col("price")).alias("market_cap_cents"))


_VAL = "WITH val AS (SELECT 'S' || s_suppkey AS address, round(s_acctbal * 100)::BIGINT AS stake, CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey * 100 END AS commission FROM supplier)"


def _validators(l: Ledger) -> DataFrame:
    k = F.col("s_suppkey")
    return l.table("supplier").select(F.concat(F.lit("S"), k).alias("address"), cents("s_acctbal").alias("stake"), F.when(k % 11 != 0, F.col("s_nationkey") * 100).alias("commission"))


@query(_VAL + " SELECT count(*) AS validators, sum(stake)::BIGINT AS total_stake, count(*) FILTER (stake < 0) AS negative FROM val")
def stake_totals(l: Ledger) -> DataFrame:
    return _validators(l).agg(F.count(F.lit(1)).alias("validators"), F.sum("stake").alias("total_stake"), F.count_if(F.col("stake") < 0).alias("negative"))


@query(_VAL + " SELECT * FROM val ORDER BY coalesce(commission, 10000), stake DESC, address LIMIT 20")
def validator_rank(l: Ledger) -> DataFrame:
    return _validators(l).orderBy(F.coalesce("commission", F.lit(10_000)), F.desc("stake"), "address").limit(20)


@query(_VAL + " SELECT * FROM val ORDER BY stake DESC, address LIMIT 20")
def validator_rank_by_stake(l: Ledger) -> DataFrame:
    return _validators(l).orderBy(F.desc("stake"), "address").limit(20)


@query(EV + """, o AS (SELECT sender AS pipeline, max(seq) AS latest_checkpoint, max(epoch_us(ts)) AS us FROM ev GROUP BY 1), n AS (SELECT max(latest_checkpoint) AS seq, max(us) AS newest FROM o)
    SELECT pipeline, latest_checkpoint, seq - latest_checkpoint AS checkpoint_lag, ((newest - us) // 1000000)::BIGINT AS time_lag_seconds, CASE WHEN (newest - us) // 1000000 > 600 THEN 'behind' ELSE 'ok' END AS status FROM o, n""")
def pipeline_status(l: Ledger) -> DataFrame:
    return market.pipeline_status(l.events().withColumn("us", windows.micros(F.col("ts"))), "sender")
