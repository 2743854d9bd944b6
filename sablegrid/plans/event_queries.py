"""Queries over events, names and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregate as agg
from ..operators import search, windows
from ..sources.ledger import SINKS, Ledger, ctes
from .registry import query

EV = ctes("ev")
GROUPS = EV + """, g AS (SELECT {key} AS key, count(*)::BIGINT AS event_count, coalesce(sum(cents), 0)::BIGINT AS value_sum, (count(*) - count(cents))::BIGINT AS missing_value_count FROM ev WHERE {key} IS NOT NULL AND {key}::VARCHAR <> '' GROUP BY 1)"""


@query(GROUPS.format(key="sender") + " SELECT * FROM g ORDER BY value_sum DESC, event_count DESC, key LIMIT 20")
def aggregate_events_by_sender(l: Ledger) -> DataFrame:
    return agg.rank_groups(agg.group_events(l.events(), "sender", F.col("cents")))


@query(GROUPS.format(key="type") + " SELECT * FROM g ORDER BY value_sum DESC, event_count DESC, key LIMIT 20")
def aggregate_events_by_type(l: Ledger) -> DataFrame:
    return agg.rank_groups(agg.group_events(l.events(), "type", F.col("cents")))


@query(GROUPS.format(key="sender") + " SELECT * FROM g ORDER BY value_sum, event_count, key LIMIT 20")
def aggregate_events_asc(l: Ledger) -> DataFrame:
    return agg.rank_groups(agg.group_events(l.events(), "sender", F.col("cents")), ascending=True)


@query(GROUPS.format(key="sender") + " SELECT key, event_count, NULL::BIGINT AS value_sum, event_count AS missing_value_count FROM g ORDER BY event_count DESC, key LIMIT 20")
def aggregate_events_by_count(l: Ledger) -> DataFrame:
    return agg.rank_groups(agg.group_events(l.events(), "sender"), metric="event_count")


_DIST = "SELECT '{m}' AS metric, min({m})::BIGINT AS min, quantile_disc({m}, 0.25)::BIGINT AS p25, quantile_disc({m}, 0.5)::BIGINT AS median, quantile_disc({m}, 0.75)::BIGINT AS p75, quantile_disc({m}, 0.95)::BIGINT AS p95, max({m})::BIGINT AS max, sum({m})::BIGINT AS total FROM g"


@query(GROUPS.format(key="sender") + " " + _DIST.format(m="value_sum") + " UNION ALL " + _DIST.format(m="event_count"))
def aggregate_events_distribution(l: Ledger) -> DataFrame:
    return agg.distribution(agg.group_events(l.events(), "sender", F.col("cents")), ["value_sum", "event_count"])


@query(EV + " SELECT count(DISTINCT sender)::BIGINT AS distinct_keys, count(*)::BIGINT AS events_aggregated, (count(*) - count(sender))::BIGINT AS ungrouped_count, count(*) > 5000 AS truncated FROM ev")
def aggregate_events_totals(l: Ledger) -> DataFrame:
    return agg.totals(l.events(), "sender", budget=5000)


@query(EV + " SELECT type, count(*)::BIGINT AS event_count, arg_min(payload, seq) AS first_sample, 'k' AS numeric_fields FROM ev GROUP BY type ORDER BY 2 DESC, 1 LIMIT 15")
def aggregate_events_discovery(l: Ledger) -> DataFrame:
    return agg.discovery(l.events())


@query(EV + " SELECT seq, sender, cents FROM ev WHERE type = 'purchase' AND seq > 1000 AND seq < 5000")
def scan_events(l: Ledger) -> DataFrame:
    return search.scan_events(l.events(), type="purchase", after=1000, before=5000).select("seq", "sender", "cents")


_LITERALS = ["1250", " 5 ", "", "abc", "5d", "1e3", "NaN", "Infinity", "-0.5", ".5", "5."]


@query(EV + ", t AS (SELECT seq::VARCHAR AS id, (payload->>'k')::DOUBLE AS number FROM ev UNION ALL SELECT * FROM (VALUES ('l0', 1250.0), ('l1', 5.0), ('l2', NULL), ('l3', NULL), ('l4', NULL), ('l5', 1000.0), ('l6', NULL), ('l7', NULL), ('l8', -0.5), ('l9', 0.5), ('l10', 5.0), ('bool', NULL), ('object', NULL), ('null', NULL), ('missing', NULL)) v(id, number)) SELECT id, number::DOUBLE AS number FROM t")
def numeric_path(l: Ledger) -> DataFrame:
    made = [(f"l{i}", '{"k": "%s"}' % s) for i, s in enumerate(_LITERALS)] + [("bool", '{"k": true}'), ("object", '{"k": {}}'), ("null", '{"k": null}'), ("missing", "{}")]
    rows = l.events().select(F.col("seq").cast("string").alias("id"), "payload").unionByName(l.spark.createDataFrame(made, "id string, payload string"))
    return rows.select("id", sc.numeric_path(F.col("payload"), "k").alias("number"))


@query(EV + " SELECT seq, 'k,n.m' AS numeric_fields FROM ev")
def numeric_fields(l: Ledger) -> DataFrame:
    nested = F.concat(F.lit('{"n": {"m": "7", "s": "x", "b": true}, "a": [1], "k": '), F.get_json_object("payload", "$.k"), F.lit("}"))
    return agg.numeric_fields(l.events().select("seq", nested.alias("payload")), "payload").select("seq", "numeric_fields")


@query(EV + """, e AS (SELECT epoch_us(ts) AS us, min(seq) AS seq FROM ev GROUP BY 1), h AS (SELECT unnest(range((SELECT min(us) // 3600000000 FROM e), (SELECT max(us) // 3600000000 + 2 FROM e))) * 3600 AS target),
    b AS (SELECT target, e.us AS bus, e.seq AS bseq FROM h ASOF LEFT JOIN e ON target * 1000000 >= e.us), a AS (SELECT target, e.us AS aus, e.seq AS aseq FROM h ASOF LEFT JOIN e ON target * 1000000 <= e.us)
    SELECT target::BIGINT AS target, CASE WHEN aus IS NULL OR target * 1000000 - bus <= aus - target * 1000000 THEN bseq ELSE aseq END AS seq FROM b JOIN a USING (target)""")
def time_to_checkpoint(l: Ledger) -> DataFrame:
    events = l.events()
    lo, hi = events.agg(F.min(windows.micros(F.col("ts"))), F.max(windows.micros(F.col("ts")))).first()
    hours = l.spark.range((lo or 0) // 3_600_000_000, (hi or 0) // 3_600_000_000 + 2) if lo is not None else l.spark.range(0)
    return windows.nearest_checkpoint(events, hours.select((F.col("id") * 3600).alias("target")))


@query(EV + " SELECT DISTINCT sender, '0x' || lpad(sender::VARCHAR, 64, '0') AS address FROM ev")
def normalize_address(l: Ledger) -> DataFrame:
    return l.events().select("sender").distinct().select("sender", sc.normalize_address(F.concat(F.lit(" 0X"), F.col("sender").cast("string"), F.lit(" "))).alias("address"))


@query(EV + " SELECT DISTINCT type, upper(type) AS symbol, type AS short FROM ev")
def coin_symbol(l: Ledger) -> DataFrame:
    t = l.events().select("type").distinct()
    return t.select("type", sc.coin_symbol(F.concat(F.lit("0x2::"), F.col("type"), F.lit("::"), F.upper("type"))).alias("symbol"), sc.coin_symbol(F.col("type")).alias("short"))


@query(EV + " SELECT seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE CAST(abs(cents) * 5 AS DOUBLE) / 1000000 END AS usd FROM ev")
def usd_value(l: Ledger) -> DataFrame:
    price = F.when(F.col("seq") % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(5.0))
    return l.events().select("seq", F.round(sc.usd_value(F.col("cents"), sc.coin_decimals(F.lit("0x1::usdc::USDC")), price), 6).alias("usd"))


@query(EV + """ SELECT DISTINCT cents // 100 AS dollars, CASE WHEN cents // 100 = 0 THEN '$0' WHEN cents // 100 < 1000 THEN '$' || (cents // 100) || '.00' WHEN cents // 100 < 1000000 THEN '$' || ((cents // 100 + 50) // 100 // 10) || '.' || ((cents // 100 + 50) // 100 % 10) || 'K' ELSE '$' || ((cents // 100 + 50000) // 100000 // 10) || '.' || ((cents // 100 + 50000) // 100000 % 10) || 'M' END AS said,
    CASE WHEN cents // 100 + 1 < 1000 THEN '$' || (cents // 100 + 1) || '.0M' ELSE '$' || ((cents // 100 + 51) // 100 // 10) || '.' || ((cents // 100 + 51) // 100 % 10) || 'B' END AS millions FROM ev WHERE cents >= 0""")
def format_usd(l: Ledger) -> DataFrame:
    whole = F.floor(F.col("cents") / 100)
    rows = l.events().where("cents >= 0").select(whole.alias("dollars")).distinct()
    return rows.select("dollars", sc.format_usd(F.col("dollars").cast("double")).alias("said"), sc.format_usd((F.col("dollars") + 1) * 1e6).alias("millions"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%bolt%' AND p_partkey > 100 ORDER BY 1 LIMIT 20")
def registry_search(l: Ledger) -> DataFrame:
    names = l.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.keyset_page(names.where(F.contains("name", F.lit("bolt"))), "id", 100, 20)


@query(EV + ", hot AS (SELECT * FROM ev WHERE seq >= 4000), cold AS (SELECT * FROM ev WHERE seq < 6000) SELECT seq, 'hot' AS store FROM hot UNION ALL SELECT seq, 'cold' FROM cold WHERE seq NOT IN (SELECT seq FROM hot)")
def hot_cold_read(l: Ledger) -> DataFrame:
    e = l.events()
    return search.hot_then_cold(e.where("seq >= 4000").select("seq", F.lit("hot").alias("store")), e.where("seq < 6000").select("seq", F.lit("cold").alias("store")), "seq")


@query("""WITH n AS (SELECT lower(p_name) AS low, min(p_partkey) AS id FROM part GROUP BY 1), q(term) AS (VALUES ('Red Bolt'), ('bolt'), ('gea'), ('nothing'), ('BLUE ROD')),
    m AS (SELECT term, n.id, n.low AS name, CASE WHEN low = lower(term) THEN 0 ELSE 1 END AS rank, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN low = lower(term) THEN 0 ELSE 1 END, low, n.id) AS r FROM q JOIN n ON contains(low, lower(term)))
    SELECT term, id, name, rank::INT AS rank FROM q LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (term)""")
def token_resolve(l: Ledger) -> DataFrame:
    names = l.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = l.spark.createDataFrame([(t,) for t in ("Red Bolt", "bolt", "gea", "nothing", "BLUE ROD")], "term string")
    return search.resolve_names(asked, names)


@query("SELECT p_partkey AS id, p_type AS type FROM part WHERE NOT contains(p_type, 'SMALL') AND NOT contains(p_type, 'PROMO')")
def nft_filter(l: Ledger) -> DataFrame:
    rows = l.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return rows.where(search.likely_collectible(F.col("type"), ("SMALL", "PROMO")))


@query("""WITH ids AS (SELECT p_partkey * 3 AS id FROM part), k AS (SELECT s_suppkey * 2 AS id, 0 AS n FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer UNION ALL SELECT p_partkey, 2 FROM part)
    SELECT ids.id, coalesce((['package', 'object', 'validator'])[min(n) + 1], 'wallet') AS kind FROM ids LEFT JOIN k ON ids.id = k.id GROUP BY ids.id""")
def identify_entity(l: Ledger) -> DataFrame:
    ids = l.table("part").select((F.col("p_partkey") * 3).alias("id"))
    kinds = [("package", l.table("supplier").select((F.col("s_suppkey") * 2).alias("id"))), ("object", l.table("customer").select(F.col("c_custkey").alias("id"))), ("validator", l.table("part").select(F.col("p_partkey").alias("id")))]
    return search.identify(ids, kinds)


def labels(l: Ledger) -> DataFrame:
    return search.precedence(l.label_layers(), "address", "layer").select("address", "category")


@query(ctes("layers") + " SELECT address, arg_min(category, layer) AS category, min(layer)::INT AS layer FROM layers GROUP BY address")
def label_precedence(l: Ledger) -> DataFrame:
    return search.precedence(l.label_layers(), "address", "layer").select("address", "category", "layer")


@query(ctes("lbl") + " SELECT 'S' || s_suppkey AS address, category, coalesce(category IN ('cex', 'bridge', 'mixer', 'malicious', 'burn'), false) AS is_sink FROM supplier LEFT JOIN lbl ON address = 'S' || s_suppkey")
def label_lookup(l: Ledger) -> DataFrame:
    s = l.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("address"))
    return s.join(labels(l), "address", "left").select("address", "category", F.coalesce(F.col("category").isin(*SINKS), F.lit(False)).alias("is_sink"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice * 100)::BIGINT WHEN p_partkey % 3 <> 0 THEN round(p_retailprice * 100)::BIGINT + 100 END AS price, concat_ws('+', CASE WHEN p_partkey % 5 <> 0 THEN 'a' END, CASE WHEN p_partkey % 3 <> 0 THEN 'b' END) AS source FROM part")
def price_merge(l: Ledger) -> DataFrame:
    p = l.table("part").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    a = p.withColumn("price", F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("price")))
    b = p.withColumn("price", F.when(F.col("id") % 3 != 0, F.col("price") + 100))
    return search.merge_prices(a, b, "id")


@query(EV + " SELECT seq, type FROM ev WHERE CASE WHEN seq % 10 = 0 THEN NULL ELSE seq END IS NULL OR seq > 9000")
def activity_since(l: Ledger) -> DataFrame:
    mark = F.when(F.col("seq") % 10 != 0, F.col("seq"))
    return search.activity_since(l.events(), mark, 9000).select("seq", "type")


@query(EV + ", c AS (SELECT sender, max(epoch_us(ts) // 1000000) AS measured_at, (sender % 3)::INT AS method_version FROM ev GROUP BY sender), n AS (SELECT max(measured_at) AS now FROM c) SELECT sender, measured_at::BIGINT AS measured_at FROM c, n WHERE method_version = 2 AND measured_at >= now - 7200")
def fanout_cache_valid(l: Ledger) -> DataFrame:
    seen = F.floor(windows.micros(F.col("ts")) / 1_000_000)
    cache = l.events().groupBy("sender").agg(F.max(seen).alias("measured_at"), F.first((F.col("sender") % 3).cast("int")).alias("method_version"))
    now = cache.agg(F.max("measured_at").alias("now"))
    return search.fresh(cache.crossJoin(F.broadcast(now)), F.col("now"), 7200, 2).select("sender", "measured_at")


@query(ctes("ver") + ", t AS (SELECT object, lag(owner) OVER (PARTITION BY object ORDER BY version) AS from_owner, owner AS to_owner, version AS at_version FROM ver) SELECT * FROM t WHERE from_owner <> to_owner")
def ownership_transitions(l: Ledger) -> DataFrame:
    return windows.transitions(l.versions())
