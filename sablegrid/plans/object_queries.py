"""Queries over objects, names, pools, types and the reads of single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cases, flows, objects, rules
from ..sources.ledger import Ledger, cents, ctes
from . import flow_queries, rule_queries
from .event_queries import labels
from .registry import ORACLES, query

_OBJ = """WITH obj AS (SELECT 'O' || p_partkey AS object_id, p_size::BIGINT AS version, 'C' || p_partkey % 50 AS owner, CASE p_partkey % 4 WHEN 0 THEN '0x2::coin::Coin<' || p_brand || '>' WHEN 1 THEN '0x5::dex_pool::Pool<' || p_brand || ', 0x2::coin::Coin<' || p_type || ',u8>>'
    WHEN 2 THEN '0x7::book::Pool<' || p_brand || '>' ELSE '0x9::' || lower(p_type) || '_set::Item' END AS type,
    '{"name":"' || p_name || '"' || CASE p_partkey % 3 WHEN 0 THEN ',"img_url":"i/' || p_partkey || '"' WHEN 1 THEN ',"description":7,"url":"u/' || p_partkey || '"' ELSE ',"description":"d"' END || ',"coin_a":"' || p_size || '","balance_b":"' || p_size * 2 || '","fee_rate":3,"taker_fee":5}' AS content,
    CASE WHEN p_partkey % 5 = 0 THEN '{"name":"D' || p_partkey || '","thumbnail":"t"}' END AS display FROM part)"""


def _objects(l: Ledger) -> DataFrame:
    k, text = F.col("p_partkey"), lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    c = F.col
    kind = (
        F.when(k % 4 == 0, text("0x2::coin::Coin<", c("p_brand"), ">")).when(k % 4 == 1, text("0x5::dex_pool::Pool<", c("p_brand"), ", 0x2::coin::Coin<", c("p_type"), ",u8>>"))
        .when(k % 4 == 2, text("0x7::book::Pool<", c("p_brand"), ">")).otherwise(text("0x9::", F.lower("p_type"), "_set::Item"))
    )
    more = F.when(k % 3 == 0, text(',"img_url":"i/', k, '"')).when(k % 3 == 1, text(',"description":7,"url":"u/', k, '"')).otherwise(',"description":"d"')
    content = text('{"name":"', c("p_name"), '"', more, ',"coin_a":"', c("p_size"), '","balance_b":"', c("p_size") * 2, '","fee_rate":3,"taker_fee":5}')
    shown = F.when(k % 5 == 0, text('{"name":"D', k, '","thumbnail":"t"}'))
    return l.table("part").select(text("O", k).alias("object_id"), c("p_size").cast("long").alias("version"), text("C", k % 50).alias("owner"), kind.alias("type"), content.alias("content"), shown.alias("display"))


@query(ctes("ver") + " SELECT object AS object_id, max(version) AS version, arg_max(owner, version) AS owner FROM ver GROUP BY 1")
def object_read(l: Ledger) -> DataFrame:
    return objects.read(l.versions().select(F.col("object").alias("object_id"), "version", "owner"))


@query(ctes("ver") + " SELECT object AS object_id, version, owner FROM ver WHERE version = 40")
def object_read_version(l: Ledger) -> DataFrame:
    return objects.read(l.versions().select(F.col("object").alias("object_id"), "version", "owner"), version=40)


_TEXT = "CASE WHEN json_type({0}, '$.{1}') = 'VARCHAR' THEN {0}->>'$.{1}' END"
_IMAGE = lambda j: ", ".join(_TEXT.format(j, f) for f in scalars.IMAGE_FIELDS)


@query(_OBJ + f" SELECT object_id, coalesce({_TEXT.format('display', 'name')}, {_TEXT.format('content', 'name')}) AS name, coalesce({_TEXT.format('display', 'description')}, {_TEXT.format('content', 'description')}) AS description, coalesce({_IMAGE('display')}, {_IMAGE('content')}) AS image_url FROM obj")
def object_display(l: Ledger) -> DataFrame:
    return objects.display(_objects(l))


@query(_OBJ + " SELECT object_id, type, version FROM obj WHERE owner = 'C7' AND starts_with(type, '0x5::') AND object_id > 'O1' ORDER BY object_id LIMIT 50")
def owned_objects(l: Ledger) -> DataFrame:
    return objects.owned(_objects(l), "C7", "0x5::", "O1").select("object_id", "type", "version")


@query(_OBJ + " SELECT object_id, type, owner FROM obj WHERE NOT starts_with(type, '0x2::coin::Coin<')")
def non_coin_objects(l: Ledger) -> DataFrame:
    return _objects(l).where(~F.startswith("type", F.lit("0x2::coin::Coin<"))).select("object_id", "type", "owner")


@query("SELECT l_orderkey AS parent_id, l_linenumber::BIGINT AS name, l_partkey AS value FROM lineitem WHERE l_orderkey = 33")
def child_rows(l: Ledger) -> DataFrame:
    return l.table("lineitem").where("l_orderkey = 33").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").cast("long").alias("name"), F.col("l_partkey").alias("value"))


@query(ctes("bc", "cmd", "tx") + " SELECT digest, sender, status, day, (SELECT count(*) FROM cmd WHERE digest = 33) AS commands, (SELECT coalesce(sum(cents), 0)::BIGINT FROM bc WHERE digest = 33 AND address = sender) AS sender_cents FROM tx WHERE digest = 33")
def transaction_read(l: Ledger) -> DataFrame:
    tx = l.transactions().where("digest = 33")
    calls = l.commands().where("digest = 33").agg(F.count(F.lit(1)).alias("commands"))
    own = l.changes().where("digest = 33 and address = sender").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("sender_cents"))
    return tx.crossJoin(F.broadcast(calls)).crossJoin(F.broadcast(own))  # one row each


@query(ctes("tx", "bc") + " SELECT digest, sender, day FROM tx WHERE (sender = 'C7' OR digest IN (SELECT digest FROM bc WHERE address = 'C7')) AND digest < 900000 ORDER BY digest DESC LIMIT 50")
def history_page(l: Ledger) -> DataFrame:
    touched = l.changes().where("address = 'C7'").select("digest").unionByName(l.transactions().where("sender = 'C7'").select("digest")).distinct()
    return l.transactions().join(touched, "digest", "left_semi").where("digest < 900000").select("digest", "sender", "day").orderBy(F.desc("digest")).limit(objects.page_size(None))


@query("SELECT '0x5::' || lower(p_type) || '::' || p_type AS coin, p_type AS symbol, 9 AS decimals, count(*) AS items, sum(p_size)::BIGINT AS supply FROM part GROUP BY p_type")
def coin_info(l: Ledger) -> DataFrame:
    coin = F.concat(F.lit("0x5::"), F.lower("p_type"), F.lit("::"), F.col("p_type"))
    rows = l.table("part").groupBy(coin.alias("coin")).agg(F.count(F.lit(1)).alias("items"), F.sum("p_size").cast("long").alias("supply"))
    return rows.select("coin", scalars.coin_symbol(F.col("coin")).alias("symbol"), scalars.coin_decimals(F.col("coin")).alias("decimals"), "items", "supply")


@query(_OBJ + " SELECT type, count(*) AS objects, count(DISTINCT owner) AS owners FROM obj GROUP BY 1")
def token_catalogue(l: Ledger) -> DataFrame:
    return _objects(l).groupBy("type").agg(F.count(F.lit(1)).alias("objects"), F.count_distinct("owner").alias("owners"))


@query(ctes("ev") + " SELECT (epoch_us(ts) // 86400000000)::BIGINT AS epoch, min(seq) AS first_checkpoint, max(seq) AS last_checkpoint, count(*) AS events FROM ev GROUP BY 1")
def chain_epochs(l: Ledger) -> DataFrame:
    return l.events().groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("epoch")).agg(F.min("seq").alias("first_checkpoint"), F.max("seq").alias("last_checkpoint"), F.count(F.lit(1)).alias("events"))


@query(ctes("ev") + " SELECT seq, sender, type FROM ev WHERE seq = 5 OR seq = (SELECT max(seq) FROM ev)")
def checkpoint_read(l: Ledger) -> DataFrame:
    last = l.events().agg(F.max("seq").alias("last"))
    return l.events().crossJoin(F.broadcast(last)).where("seq = 5 or seq = last").select("seq", "sender", "type")  # the last is one row


@query(ctes("ev") + " SELECT type, max(seq) AS latest_checkpoint, count(*) AS events FROM ev GROUP BY 1")
def latest_checkpoint(l: Ledger) -> DataFrame:
    return l.events().groupBy("type").agg(F.max("seq").alias("latest_checkpoint"), F.count(F.lit(1)).alias("events"))


_NAMES = "nm AS (SELECT 'S' || s_suppkey AS address, lower(s_name) || '.name' AS name FROM supplier WHERE s_nationkey <> 3)"


def _names(l: Ledger) -> DataFrame:
    return l.table("supplier").where("s_nationkey <> 3").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("address"), F.concat(F.lower("s_name"), F.lit(".name")).alias("name"))


@query("WITH " + _NAMES + ", a AS (SELECT DISTINCT lower(s_name) || '.name' AS name FROM supplier) SELECT name, address, address IS NOT NULL AS found FROM a LEFT JOIN nm USING (name)")
def resolve_forward(l: Ledger) -> DataFrame:
    return objects.names_of(l.table("supplier").select(F.concat(F.lower("s_name"), F.lit(".name")).alias("name")).distinct(), _names(l), "name", "address")


@query("WITH " + _NAMES + ", a AS (SELECT DISTINCT 'S' || l_suppkey AS address FROM lineitem) SELECT address, name, name IS NOT NULL AS found FROM a LEFT JOIN nm USING (address)")
def resolve_reverse(l: Ledger) -> DataFrame:
    return objects.names_of(l.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("address")).distinct(), _names(l), "address", "name")


_BOUND = ctes("ev") + ", b AS (SELECT seq, CASE seq % 6 WHEN 0 THEN seq::VARCHAR WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN ' Now ' WHEN 3 THEN 'soon' WHEN 4 THEN '' END AS bound FROM ev)"


@query(_BOUND + " SELECT seq, CASE WHEN bound IS NULL OR bound = '' THEN 'none' WHEN regexp_full_match(trim(bound), '[0-9]+') THEN 'checkpoint' WHEN lower(trim(bound)) = 'now' THEN 'now' WHEN try_cast(trim(bound) AS TIMESTAMP) IS NOT NULL THEN 'time' ELSE 'invalid' END AS kind FROM b")
def bound_kinds(l: Ledger) -> DataFrame:
    k, n = F.col("seq"), F.col("seq") % 6
    bound = F.when(n == 0, k.cast("string")).when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(n == 2, " Now ").when(n == 3, "soon").when(n == 4, "")
    return l.events().select("seq", scalars.bound_kind(bound).alias("kind"))


@query(ctes("ev") + ", a AS (SELECT seq, cents * CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS c FROM ev) SELECT seq, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || CASE WHEN abs(c) % 100 = 0 THEN '' ELSE rtrim('.' || lpad((abs(c) % 100)::VARCHAR, 2, '0'), '0') END AS amount FROM a")
def amount_text(l: Ledger) -> DataFrame:
    signed = F.col("cents") * F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    return l.events().select("seq", scalars.format_amount(signed, 2).alias("amount"))


@query(ctes("ev") + """, d AS (SELECT seq, seq * 37 % 300000 AS s FROM ev), p AS (SELECT *, CASE WHEN s < 3600 THEN 60 WHEN s < 86400 THEN 3600 ELSE 86400 END AS unit, CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' ELSE 'day' END AS word FROM d)
    SELECT seq, CASE WHEN s < 60 THEN '<1 minute' ELSE ((2 * s + unit) // (2 * unit)) || ' ' || word || CASE WHEN (2 * s + unit) // (2 * unit) = 1 THEN '' ELSE 's' END END AS span FROM p""")
def duration_text(l: Ledger) -> DataFrame:
    return l.events().select("seq", scalars.format_duration(F.col("seq") * 37 % 300_000).alias("span"))


@query(ctes("ev") + " SELECT seq, round(cents * pow(10.0, -(2 + seq % 3)) * 10000)::BIGINT AS price_e4, CASE WHEN seq % 4 <> 0 THEN ((cents * 2 + 4) // 8)::BIGINT END AS eighths FROM ev")
def scaled_prices(l: Ledger) -> DataFrame:
    price = scalars.oracle_price(F.col("cents"), -(2 + F.col("seq") % 3))
    odd = F.when(F.col("seq") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("cents") / 4.0)
    return l.events().select("seq", F.round(price * 10_000).cast("long").alias("price_e4"), scalars.round_to(odd, 0).cast("long").alias("eighths"))


@query("SELECT p_partkey AS id, p_brand || '|0x2::coin::Coin<' || p_type || ',u8>|u64' AS params, CASE WHEN p_partkey % 2 = 0 THEN '0x' || p_size END AS package FROM part")
def type_parts(l: Ledger) -> DataFrame:
    kind = F.concat(F.when(F.col("p_partkey") % 2 == 0, "0x").otherwise("x"), F.col("p_size"), F.lit("::pool::Pool<"), F.col("p_brand"), F.lit(", 0x2::coin::Coin<"), F.col("p_type"), F.lit(",u8> ,u64>"))
    rows = l.table("part").select(F.col("p_partkey").alias("id"), kind.alias("type"))
    return rows.select("id", F.array_join(scalars.type_parameters(F.col("type")), "|").alias("params"), scalars.package_id(F.col("type")).alias("package"))


_REF = "CASE p_partkey % 4 WHEN 0 THEN '@' || p_name WHEN 1 THEN ' 0x' || p_size || '/a' WHEN 2 THEN p_brand || '/' || p_type ELSE p_name END"


@query(f"SELECT p_partkey AS id, NOT starts_with(trim({_REF}), '0x') AND (starts_with(trim({_REF}), '@') OR contains(trim({_REF}), '/')) AS is_name, regexp_full_match(CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_brand END, '[A-Za-z_][A-Za-z0-9_]*') AS is_module FROM part")
def name_checks(l: Ledger) -> DataFrame:
    k = F.col("p_partkey")
    ref = F.when(k % 4 == 0, F.concat(F.lit("@"), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit(" 0x"), F.col("p_size"), F.lit("/a"))).when(k % 4 == 2, F.concat_ws("/", "p_brand", "p_type")).otherwise(F.col("p_name"))
    module = F.when(k % 2 == 0, F.lower("p_type")).otherwise(F.col("p_brand"))
    return l.table("part").select(k.alias("id"), scalars.looks_like_name(ref).alias("is_name"), scalars.valid_module_name(module).alias("is_module"))


_TERMS = "t AS (SELECT unnest(['economy-set', 'PROMO', 'item', 'dex', 'nothing']) AS term)"


@query(_OBJ + ", r AS (SELECT DISTINCT type, replace(lower(string_split(type, '::')[-2]), '_', '-') AS slug, string_split(type, '::')[-1] AS name FROM obj), " + _TERMS + " SELECT term, coalesce((SELECT min(type) FROM r WHERE slug = lower(term)), (SELECT min(type) FROM r WHERE contains(slug, lower(term)) OR contains(lower(name), lower(term)))) AS type FROM t")
def collection_resolve(l: Ledger) -> DataFrame:
    asked = l.spark.createDataFrame([(x,) for x in ("economy-set", "PROMO", "item", "dex", "nothing")], "term string")
    return objects.collections_of(asked, objects.registered(_objects(l)))


@query("""WITH f AS (SELECT 'F' || lpad(p_partkey::VARCHAR, 9, '0') AS feed_id, upper(p_type) AS base, CASE WHEN p_partkey % 7 = 0 THEN 'CRYPTO.' || upper(p_type) || '/USD' ELSE 'X' END AS sym, CASE WHEN p_partkey % 11 = 0 THEN 'USD' ELSE 'EUR' END AS quote FROM part),
    c AS (SELECT DISTINCT '0x5::m::' || p_type AS coin, p_type AS symbol FROM part UNION ALL SELECT '0x5::m::NONE', 'NONE') SELECT coin, symbol, (SELECT arg_min(feed_id, (sym <> 'CRYPTO.' || base || '/USD' AND quote <> 'USD', feed_id)) FROM f WHERE base = upper(symbol)) AS feed_id FROM c""")
def feed_match(l: Ledger) -> DataFrame:
    p, k = l.table("part"), F.col("p_partkey")
    pair = F.when(k % 7 == 0, F.concat(F.lit("Crypto."), F.col("p_type"), F.lit("/USD"))).otherwise("x")
    feeds = p.select(F.concat(F.lit("F"), F.lpad(k.cast("string"), 9, "0")).alias("feed_id"), F.col("p_type").alias("base"), pair.alias("feed_symbol"), F.when(k % 11 == 0, "usd").otherwise("eur").alias("quote"))
    coins = p.select(F.concat(F.lit("0x5::m::"), F.col("p_type")).alias("coin")).distinct().unionByName(l.spark.createDataFrame([("0x5::m::NONE",)], "coin string"))
    return objects.feeds_of(coins, feeds)


@query("SELECT DISTINCT 'C' || o_custkey AS owner, 'K' || o_orderkey % 500 AS kiosk FROM orders WHERE o_orderkey % 4 < 2")
def kiosk_discovery(l: Ledger) -> DataFrame:
    k = F.col("o_orderkey")
    shop = F.concat(F.lit('"K'), k % 500, F.lit('"'))
    content = F.when(k % 4 == 0, F.concat(F.lit('{"for":'), shop, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"cap":{"for":'), shop, F.lit("}}"))).otherwise('{"for":7}')
    return objects.kiosks(l.table("orders").select(F.concat(F.lit("C"), F.col("o_custkey")).alias("owner"), F.when(k % 4 == 1, "personal").otherwise("standard").alias("kind"), content.alias("content")))


@query(_OBJ + """ SELECT object_id, CASE p WHEN '0x5' THEN 'dex one' WHEN '0x7' THEN 'book' END AS protocol, CASE WHEN p = '0x7' THEN 'clob' ELSE 'dex' END AS protocol_type, brand AS token_a, CASE WHEN p = '0x5' THEN other END AS token_b, CASE WHEN p = '0x5' THEN content->>'$.coin_a' END AS reserve_a,
    CASE WHEN p = '0x5' THEN content->>'$.balance_b' END AS reserve_b, CASE WHEN p = '0x7' THEN content->>'$.taker_fee' ELSE content->>'$.fee_rate' END AS fee FROM (SELECT *, regexp_extract(type, '^(0x[0-9]+)::', 1) AS p, regexp_extract(type, '<([^,>]+)', 1) AS brand, regexp_extract(type, ', (.*)>$', 1) AS other FROM obj WHERE contains(lower(type), 'pool')) t""")
def pool_views(l: Ledger) -> DataFrame:
    protocols = l.spark.createDataFrame([("0x5", "dex one", "dex"), ("0x7", "book", "clob")], "package string, protocol string, protocol_type string")
    return objects.pools(_objects(l), protocols)


_KINDS = ("suilend", "navi", "scallop", "cetus", "bucket")


@query("""SELECT 'A' || o_orderkey AS object_id, (['suilend', 'navi', 'scallop', 'cetus', 'bucket'])[(o_orderkey % 5 + 1)::INT] AS protocol, side, asset, amount FROM orders, LATERAL (SELECT * FROM (VALUES (0, 'supply', 'a', '1'), (0, 'supply', 'b', o_custkey::VARCHAR), (0, 'borrow', 'c', '3'),
    (1, 'supply', 'a', '4'), (2, 'borrow', 'z', '9'), (3, 'single', 'P', '77'), (4, 'single', NULL, '5')) v(kind, side, asset, amount) WHERE kind = o_orderkey % 5) x""")
def position_entries(l: Ledger) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 5
    content = (
        F.when(n == 0, F.concat(F.lit('{"deposits":[{"coin_type":"a","deposited_ctoken_amount":1},{"deposit_reserve":"b","deposited_ctoken_amount":'), F.col("o_custkey"), F.lit('}],"borrows":[{"borrow_reserve":"c","borrowed_amount":3}]}')))
        .when(n == 1, '{"supplies":[{"asset":"a","balance":4}]}').when(n == 2, '{"debts":[{"type":"z","amount":9}]}').when(n == 3, '{"pool":"P","liquidity":77}').otherwise('{"collateral_amount":5,"buck_amount":6}')
    )
    protocol = F.element_at(F.array(*map(F.lit, _KINDS)), (n + 1).cast("int"))
    return objects.positions(l.table("orders").select(F.concat(F.lit("A"), k).alias("object_id"), protocol.alias("protocol"), content.alias("content")))


_VIS = """WITH fn AS (SELECT p_brand AS package, p_size % 5 = 0 AS entry, (['public', 'friend', 'private'])[(p_partkey % 3 + 1)::INT] AS vis FROM part)"""


@query(_VIS + " SELECT package, count(*) FILTER (entry) AS entry_functions, count(*) FILTER (NOT entry AND vis = 'public') AS public_functions, count(*) FILTER (NOT entry AND vis = 'friend') AS friend_functions, count(*) FILTER (NOT entry AND vis = 'private') AS private_functions FROM fn GROUP BY 1")
def package_api(l: Ledger) -> DataFrame:
    vis = F.element_at(F.array(*map(F.lit, ("public", "friend", "private"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    fn = l.table("part").select(F.col("p_brand").alias("package"), (F.col("p_size") % 5 == 0).alias("entry"), vis.alias("vis"))
    return rules.api_totals(fn)


@query(ctes("bc") + ", t AS (SELECT DISTINCT address, digest, day FROM bc), r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day, digest, address) AS n FROM t) SELECT address, digest, day FROM r WHERE n <= 3 ORDER BY day, digest, address LIMIT 100")
def capped_timeline(l: Ledger) -> DataFrame:
    rows = l.changes().select("address", "digest", "day").distinct()
    return objects.capped_merge(rows, "address", [F.asc("day"), F.asc("digest"), F.asc("address")], 3, 100)


@query("WITH r AS (SELECT p_brand AS package, p_partkey AS id, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey)::BIGINT AS used FROM part) SELECT * FROM r WHERE used <= 300")
def budget_cut(l: Ledger) -> DataFrame:
    rows = l.table("part").select(F.col("p_brand").alias("package"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size"))
    return objects.within_budget(rows, ["package"], [F.asc("id")], "size", 300, F.floor(F.col("id") / 64)).drop("size")


@query(f"SELECT digest, code, severity, row_number() OVER (PARTITION BY digest ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, code) AS position FROM ({ORACLES['ptb_anomalies']}) t")
def severity_order(l: Ledger) -> DataFrame:
    return rules.by_severity(rule_queries.ptb_anomalies(l), "digest").select("digest", "code", "severity", "position")


_WALKED = f"SELECT * FROM ({ORACLES['trace_walk']}) w LEFT JOIN ({ORACLES['dominant_inflow']}) i USING (digest)"


@query(f"SELECT direction, seed, arg_min(coalesce(inflow_cents, 0), hop) AS origin_cents, max(coalesce(inflow_cents, 0)) AS peak_cents, count(*) AS hops, arg_max(stop, hop) AS stop, upper(direction) || ' from ' || seed || ': ' || count(*) || ' hop' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ', ' || arg_max(stop, hop) AS summary FROM ({_WALKED}) x GROUP BY 1, 2")
def trace_summary(l: Ledger) -> DataFrame:
    return flows.trace_summary(flow_queries.walked(l, carry=()), flows.dominant_inflow(l.kept_changes()))


_HUB = ctes("lbl").removeprefix("WITH ")


@query(f"SELECT address, 'cex' AS category, 'Unidentified hub (~' || recipient_count || '+ recipients)' AS label, 'low' AS confidence FROM ({flow_queries.FANOUT_SQL}) f WHERE classification <> 'narrow' AND address NOT IN (SELECT address FROM (WITH {_HUB} SELECT address FROM lbl) k)")
def hub_suggestions(l: Ledger) -> DataFrame:
    return flows.hub_suggestions(flows.fanout(l.kept_changes(), latest=1000, coins=False), labels(l), ("hub", "distributor"))


@query(f"SELECT family, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status <> 'unchanged') = 0 AS identical FROM ({ORACLES['package_diff']}) d GROUP BY 1")
def package_diff_summary(l: Ledger) -> DataFrame:
    return rules.diff_summary(rule_queries.package_diff(l), ["family"])


@query(f"SELECT pair, added, removed, row_number() OVER (ORDER BY added + removed DESC, pair) AS place FROM ({ORACLES['line_multiset_delta']}) d ORDER BY place LIMIT 50")
def module_churn(l: Ledger) -> DataFrame:
    return rules.churn(rule_queries.line_multiset_delta(l), "pair", 50)


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' 0XAB' || s_suppkey END AS address, CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'cex' ELSE 'odd' END AS category FROM supplier), g AS (SELECT *, trim(address) <> '' AND label IS NOT NULL AND category = 'cex' AS accepted FROM r)
    SELECT CASE WHEN accepted THEN '0x' || lpad(lower(trim(address))[3:], 64, '0') ELSE address END AS address, label, category, accepted FROM g""")
def label_import(l: Ledger) -> DataFrame:
    k = F.col("s_suppkey")
    raw = l.table("supplier").select(F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" 0XAB"), k)).alias("address"), F.when(k % 7 != 0, F.col("s_name")).alias("label"), F.when(k % 2 == 0, "cex").otherwise("odd").alias("category"))
    return cases.import_labels(raw)


@query(ctes("ev") + ", r AS (SELECT sender AS key, seq, type, type = 'error' AS deleted, row_number() OVER (PARTITION BY sender ORDER BY seq DESC) AS n FROM ev) SELECT key, seq, type, deleted FROM r WHERE n = 1 AND NOT deleted")
def store_state(l: Ledger) -> DataFrame:
    log = l.events().select(F.col("sender").alias("key"), "seq", "type", (F.col("type") == "error").alias("deleted"))
    return cases.latest(log, "key", "seq")
