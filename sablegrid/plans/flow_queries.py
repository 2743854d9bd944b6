"""Queries over transactions, changes and the walks between addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import flows, search, windows
from ..sources.ledger import SINKS, Ledger, ctes
from ..sources.shared import tasks
from .event_queries import labels
from .registry import query
from .rule_queries import matched_calls

BC, TX = ctes("bc"), ctes("tx")
SINK_SQL = "('cex', 'bridge', 'mixer', 'malicious', 'burn')"

FANOUT_SQL = BC + """, own AS (SELECT address, digest, arg_min(cents, ord) AS own, min(day) AS day FROM bc GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day DESC, digest DESC) AS n FROM own),
    m AS (SELECT r.address, r.digest, own, n, b.address AS other, cents, coin FROM r JOIN bc b USING (digest)),
    f AS (SELECT address, count(DISTINCT other) FILTER (n <= 1000 AND own < 0 AND other <> address AND cents > 0) AS recipient_count, count(DISTINCT other) FILTER (n <= 1000 AND own > 0 AND other <> address AND cents < 0) AS sender_count,
        count(DISTINCT other) FILTER (n <= 1000 AND other <> address AND ((own < 0 AND cents > 0) OR (own > 0 AND cents < 0))) AS counterparty_count, count(DISTINCT coin) FILTER (n <= 1000) AS coin_type_count,
        count(DISTINCT digest) FILTER (n <= 1000) AS scanned, max(n) > 1000 AS truncated FROM m GROUP BY address)
    SELECT *, CASE WHEN sender_count > 0 THEN recipient_count / sender_count END AS out_in_ratio,
        CASE WHEN sender_count = 0 THEN 'unknown' WHEN recipient_count >= 3 * sender_count THEN 'disperser' WHEN 100 * recipient_count <= 33 * sender_count THEN 'collector' ELSE 'balanced' END AS flow_shape,
        CASE WHEN counterparty_count >= 1000 THEN 'hub' WHEN counterparty_count >= 100 THEN 'distributor' ELSE 'narrow' END AS classification FROM f"""

EDGES = """e1 AS (SELECT address, digest, day, sender, coin, sum(cents)::BIGINT AS net FROM bc GROUP BY ALL),
    e2 AS (SELECT *, row_number() OVER (PARTITION BY address, digest ORDER BY net DESC, coin) AS k FROM e1), e3 AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day, digest) AS n FROM e2 WHERE k = 1),
    e4 AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day, digest) AS f FROM e3 WHERE n <= 12 AND net > 0),
    e5 AS (SELECT e4.address, e4.digest, b.address AS other, row_number() OVER (PARTITION BY e4.address ORDER BY b.cents, b.address) AS p FROM e4 JOIN bc b ON e4.digest = b.digest AND b.address <> e4.address AND b.cents < 0 WHERE f = 1),
    edge AS (SELECT e4.address, e4.digest, e4.day, e4.coin, net AS amount_cents, coalesce(other, sender, 'unknown') AS funder FROM e4 LEFT JOIN e5 ON e4.address = e5.address AND p = 1 WHERE f = 1)"""

WALK = ctes("bc", "lbl", recursive=True) + ", " + EDGES + """, seed AS (SELECT DISTINCT address FROM bc),
    w AS (SELECT address, address AS cur, [address] AS visited, 0 AS hops, NULL::VARCHAR AS stop, false AS over FROM seed UNION ALL
        SELECT w.address, coalesce(funder, cur), CASE WHEN funder IS NULL THEN visited ELSE list_append(visited, funder) END, hops + (funder IS NOT NULL)::INT,
            CASE WHEN funder IS NULL THEN 'dead_end' WHEN funder = 'unknown' THEN 'unknown' WHEN lbl.address IS NOT NULL THEN 'labeled' WHEN list_contains(visited, funder) THEN 'cycle' WHEN hops = 4 THEN 'max_hops' END, true
        FROM w LEFT JOIN edge ON cur = edge.address LEFT JOIN lbl ON lbl.address = funder WHERE stop IS NULL)"""


@query(FANOUT_SQL)
def fanout_all(l: Ledger) -> DataFrame:
    return flows.fanout(l.kept_changes(), latest=1000)


@query(BC + ", " + EDGES + " SELECT * FROM edge")
def funding_edges(l: Ledger) -> DataFrame:
    return flows.funding_edges(l.changes())


def _walks(l: Ledger) -> DataFrame:
    return flows.funding_walks(l.changes(), labels(l), 5)


@query(WALK + " SELECT address, cur AS origin, hops::BIGINT AS hops, stop AS stop_reason_code, array_to_string(visited, '>') AS chain FROM w WHERE stop IS NOT NULL")
def funding_walk(l: Ledger) -> DataFrame:
    return _walks(l).select("address", "origin", "hops", "stop_reason_code", F.array_join("visited", ">").alias("chain"))


@query(WALK + ", s AS (SELECT DISTINCT address, unnest(visited[2:]) AS funder FROM w WHERE stop IS NOT NULL), c AS (SELECT funder, count(*) AS funded_count FROM s WHERE funder <> 'unknown' GROUP BY 1 HAVING count(*) > 1) SELECT funder, address, funded_count FROM s JOIN c USING (funder)")
def shared_funders(l: Ledger) -> DataFrame:
    return flows.shared_funders(_walks(l))


NEAR = "near AS (SELECT address, day, lead(min(digest)) OVER (PARTITION BY address ORDER BY day) AS next_digest, lag(max(digest)) OVER (PARTITION BY address ORDER BY day) AS prev_digest FROM bc GROUP BY address, day)"


@query(BC + ", " + NEAR + " SELECT * FROM near")
def next_tx(l: Ledger) -> DataFrame:
    return flows.neighbours(l.changes())


TRACE = """op AS (SELECT digest, ord, action, skip, row_number() OVER (PARTITION BY digest, ord ORDER BY priority) AS r FROM cmd JOIN pat USING (module) WHERE starts_with(function, prefix)),
    sw AS (SELECT DISTINCT digest FROM op WHERE r = 1 AND NOT skip AND action = 'swap'), ps AS (SELECT address FROM lbl WHERE category IN ('protocol', 'defi')),
    g AS (SELECT digest, arg_min(address, ord) FILTER (cents > 0 AND address <> sender AND address NOT IN (SELECT address FROM ps)) AS recipient, arg_min(address, ord) FILTER (cents > 0 AND address <> sender) AS pool FROM bc GROUP BY digest),
    rc AS (SELECT digest, coin, row_number() OVER (PARTITION BY digest ORDER BY cents DESC, coin) AS r FROM bc WHERE cents > 0 AND address = sender),
    te AS (SELECT tx.digest, tx.day, tx.sender, CASE WHEN sw.digest IS NOT NULL THEN tx.sender ELSE coalesce(recipient, pool) END AS next_address, CASE WHEN sw.digest IS NOT NULL THEN rc.coin END AS next_coin, sw.digest IS NOT NULL AS is_swap,
        CASE WHEN sw.digest IS NOT NULL THEN 'swap' WHEN recipient IS NOT NULL THEN 'recipient' WHEN pool IS NOT NULL THEN 'pool_fallback' ELSE 'stop' END AS rule
        FROM tx LEFT JOIN g USING (digest) LEFT JOIN sw USING (digest) LEFT JOIN rc ON rc.digest = tx.digest AND rc.r = 1)"""


def _edges(l: Ledger, swaps: DataFrame | None = None) -> DataFrame:
    """swaps: digests of swaps, if they are known already."""
    if swaps is None:
        swaps = l.commands(matched_calls(l).select("p_partkey", "action", "skip")).where("action = 'swap' and not skip").select("digest").distinct()
    return flows.trace_edges(l.transactions(), l.kept_changes(), swaps, labels(l).where(F.col("category").isin("protocol", "defi")))


@query(ctes("bc", "cmd", "lbl", "pat") + ", " + TRACE + " SELECT * FROM te")
def trace_edges(l: Ledger) -> DataFrame:
    return _edges(l)


_HOPS = """{n} AS (SELECT digest AS seed, 1 AS hop, digest FROM tx UNION ALL SELECT seed, hop + 1, {c} FROM {n} JOIN te USING (digest) JOIN near ON near.address = {a} AND near.day = te.day
    WHERE hop < 10 AND {c} IS NOT NULL AND {a} NOT IN (SELECT address FROM lbl WHERE category IN """ + SINK_SQL + "))"
_SAID = """SELECT '{d}' AS direction, seed, hop::BIGINT AS hop, digest, te.sender, {a} AS next_address, CASE WHEN {a} IS NULL THEN 'no_next' WHEN {a} IN (SELECT address FROM lbl WHERE category IN """ + SINK_SQL + """) THEN 'sink'
    WHEN hop = 10 THEN 'max_hops' WHEN {c} IS NULL THEN 'no_tx' ELSE 'none' END AS stop FROM {n} JOIN te USING (digest) LEFT JOIN near ON near.address = {a} AND near.day = te.day"""


@query(
    ctes("bc", "cmd", "lbl", "pat", recursive=True) + ", " + NEAR + ", " + TRACE + ", " + _HOPS.format(n="f", a="te.next_address", c="next_digest") + ", " + _HOPS.format(n="b", a="te.sender", c="prev_digest") + " "
    + _SAID.format(d="forward", n="f", a="te.next_address", c="next_digest") + " UNION ALL " + _SAID.format(d="backward", n="b", a="te.sender", c="prev_digest")
)
def trace_walk(l: Ledger) -> DataFrame:
    return walked(l)


def walked(l: Ledger, **options) -> DataFrame:
    edges, near = written_edges(l), flows.neighbours(l.kept_changes())
    sinks = labels(l).where(F.col("category").isin(*SINKS))
    return flows.trace_walk(edges, near, sinks, l.transactions().select("digest"), **options)


def written_edges(l: Ledger, swaps: DataFrame | None = None) -> DataFrame:
    return flows.written(_edges(l, swaps), "edges")


@query(ctes("bc", "tx") + " SELECT digest, sender, status, day FROM tx WHERE day > 500 AND digest IN (SELECT digest FROM bc WHERE address = 'S7')")
def scan_transactions(l: Ledger) -> DataFrame:
    return search.scan_transactions(l.transactions(), l.changes(), l.commands(), affected="S7", after=500)


@query(ctes("tx", "cmd") + " SELECT digest, sender FROM tx WHERE digest IN (SELECT digest FROM cmd WHERE package = 'Brand#3' AND module = 'promo')")
def scan_transactions_by_function(l: Ledger) -> DataFrame:
    return search.scan_transactions(l.transactions(), l.changes(), l.commands(), function="Brand#3::promo").select("digest", "sender")


@query(ctes("cmd") + " SELECT digest, count(*) AS total_calls, count(*) FILTER (starts_with(package, 'Brand#1')) AS matched_calls FROM cmd GROUP BY 1")
def tx_call_attribution(l: Ledger) -> DataFrame:
    return l.commands().groupBy("digest").agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(F.startswith("package", F.lit("Brand#1"))).alias("matched_calls"))


@query(BC + " SELECT digest, sender, coalesce(string_agg(DISTINCT address, ',' ORDER BY address) FILTER (cents > 0 AND address <> sender), '') AS counterparties FROM bc GROUP BY 1, 2")
def wallet_history(l: Ledger) -> DataFrame:
    gained = F.when((F.col("cents") > 0) & (F.col("address") != F.col("sender")), F.col("address"))
    return l.changes().groupBy("digest", "sender").agg(F.array_join(F.array_sort(F.collect_set(gained)), ",").alias("counterparties"))  # the lines of one transaction


@query(BC + " SELECT address, coin, sum(cents)::BIGINT AS balance_cents FROM bc WHERE day <= 1200 GROUP BY ALL")
def balance_as_of(l: Ledger) -> DataFrame:
    return l.changes().where("day <= 1200").groupBy("address", "coin").agg(F.sum("cents").alias("balance_cents"))


@query(BC + ", h AS (SELECT address, sum(cents)::BIGINT AS balance_cents, count(*) AS object_count FROM bc WHERE coin = 'PROMO' AND cents > 0 GROUP BY 1) SELECT row_number() OVER (ORDER BY balance_cents DESC, address) AS rank, *, (balance_cents * 1000000 // (SELECT sum(balance_cents) FROM h))::BIGINT AS share_ppm FROM h ORDER BY rank LIMIT 20")
def top_holders(l: Ledger) -> DataFrame:
    return flows.holders(l.changes(), "PROMO")


@query(BC + ", p AS (SELECT digest, address, sum(cents) AS gain FROM bc WHERE cents > 0 GROUP BY ALL) SELECT digest, max(gain)::BIGINT AS inflow_cents FROM p GROUP BY 1")
def dominant_inflow(l: Ledger) -> DataFrame:
    return flows.dominant_inflow(l.changes())


_OWNED = """o AS (SELECT l_orderkey AS object_id, l_partkey AS item, coalesce('C' || c_custkey, 'W' || o_orderkey, 'S' || l_suppkey) AS owner FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'F' LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey <> 3)"""


def _owned(l: Ledger) -> DataFrame:
    wrapper = l.table("orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    owner = l.table("customer").where("c_nationkey <> 3").select("c_custkey")
    rows = l.table("lineitem").join(wrapper, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(owner, F.col("o_custkey") == F.col("c_custkey"), "left")
    name = F.coalesce(F.concat(F.lit("C"), F.col("c_custkey")), F.concat(F.lit("W"), F.col("o_orderkey")), F.concat(F.lit("S"), F.col("l_suppkey")))
    return rows.select(F.col("l_orderkey").alias("object_id"), F.col("l_partkey").alias("item"), name.alias("owner"))


@query("WITH " + _OWNED + " SELECT * FROM o")
def nft_owner_resolution(l: Ledger) -> DataFrame:
    return _owned(l)


@query("WITH " + _OWNED + " SELECT owner, count(*) AS held FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def nft_holders(l: Ledger) -> DataFrame:
    return _owned(l).groupBy("owner").agg(F.count(F.lit(1)).alias("held")).orderBy(F.desc("held"), "owner").limit(25)


@query("SELECT collection, count(*) AS items FROM (SELECT p_brand AS collection FROM part UNION ALL SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A') t GROUP BY 1")
def collection_counts(l: Ledger) -> DataFrame:
    direct = l.table("part").select(F.col("p_brand").alias("collection"))
    wrapped = l.table("lineitem").where("l_returnflag = 'A'").join(l.parts(), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("collection"))
    return direct.unionByName(wrapped).groupBy("collection").agg(F.count(F.lit(1)).alias("items"))


def _first_touched(l: Ledger, order: Callable[[str], Column]) -> DataFrame:
    touched = l.changes().select("address", "digest", "day").distinct()
    return windows.first_rows(touched, ["address"], [order("day"), order("digest")], 12, tasks(l.table("lineitem")))


_TOUCHED = BC + ", t AS (SELECT DISTINCT address, digest, day FROM bc)"


@query(_TOUCHED + ", r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day, digest) AS n FROM t) SELECT address, digest, day FROM r WHERE n <= 12")
def earliest_n(l: Ledger) -> DataFrame:
    return _first_touched(l, F.asc)


@query(_TOUCHED + ", r AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY day DESC, digest DESC) AS n FROM t) SELECT address, digest, day FROM r WHERE n <= 12")
def latest_n(l: Ledger) -> DataFrame:
    return _first_touched(l, F.desc)


@query(BC + ", c AS (SELECT address, digest, ord, cents, sum(cents) OVER (PARTITION BY address ORDER BY cents DESC, digest, ord)::BIGINT AS running FROM bc WHERE cents > 0) SELECT * FROM c WHERE running - cents < 10000000")
def coin_selection(l: Ledger) -> DataFrame:
    rows = l.changes().where("cents > 0").select("address", "digest", "ord", "cents")
    band = F.floor(-8 * F.log2("cents"))  # larger amounts come first
    return windows.select_until(rows, ["address"], "cents", F.lit(10_000_000), [F.desc("cents"), F.asc("digest"), F.asc("ord")], band)


@query(ctes("bc", "tx") + ", k AS (SELECT 'C' || n AS address FROM range(1, 6) r(n) UNION ALL SELECT 'S' || n FROM range(1, 6) r(n)), t AS (SELECT digest, address FROM bc UNION SELECT digest, sender FROM tx), i AS (SELECT digest, string_agg(DISTINCT address, ',' ORDER BY address) AS involved FROM t WHERE address IN (SELECT address FROM k) GROUP BY 1) SELECT digest, day, involved FROM tx JOIN i USING (digest) WHERE day BETWEEN 100 AND 2000 ORDER BY day, digest LIMIT 60")
def timeline(l: Ledger) -> DataFrame:
    tracked = l.spark.createDataFrame([(f"{side}{n}",) for side in "CS" for n in range(1, 6)], "address string")
    return flows.timeline(l.transactions(), l.changes(), tracked, F.lit(100), F.lit(2000))


@query("SELECT * FROM (SELECT 0 AS phase, s_suppkey AS id FROM supplier UNION ALL SELECT 1, c_custkey FROM customer) t WHERE (phase, id) > (0, 95) ORDER BY phase, id LIMIT 20")
def nft_page(l: Ledger) -> DataFrame:
    rows = l.table("supplier").select(F.lit(0).alias("phase"), F.col("s_suppkey").alias("id")).unionByName(l.table("customer").select(F.lit(1).alias("phase"), F.col("c_custkey").alias("id")))
    return rows.where("phase > 0 or (phase = 0 and id > 95)").orderBy("phase", "id").limit(20)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'R0', 'P1'),
    w AS (SELECT 'P1' AS node, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN e ON node = src WHERE level < 3) SELECT node, min(level)::BIGINT AS level FROM w GROUP BY 1""")
def dependency_bfs(l: Ledger) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    edges = l.table("lineitem").select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst")).unionByName(l.table("supplier").select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("dst")))
    edges = edges.unionByName(l.table("nation").select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst"))).unionByName(l.spark.createDataFrame([("R0", "P1")], "src string, dst string"))
    return flows.reachable(edges, l.spark.createDataFrame([("P1",)], "node string"), 3)
