"""Queries over measured fan-outs, cursors, label files and owners."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cursors, flows, sketches
from ..sources import labels as label_sources
from ..sources.ledger import CATEGORIES, Ledger
from ..sources.shared import shared_dir, written
from .event_queries import labels
from .flow_queries import BC, FANOUT_SQL, WALK
from .registry import query

_FAN = FANOUT_SQL[len(BC) :]
_AT = _FAN.index("SELECT *, CASE WHEN sender_count > 0")


@query(WALK.replace("WHEN hops = 4", "WHEN hops = 2") + """, s AS (SELECT DISTINCT address, unnest(visited[2:]) AS funder FROM w WHERE stop IS NOT NULL), c AS (SELECT funder, count(*) AS funded_count FROM s WHERE funder <> 'unknown' GROUP BY 1 HAVING count(*) > 1),
    best AS (SELECT *, row_number() OVER (ORDER BY funded_count DESC, funder) AS place FROM c)""" + _FAN[:_AT].replace("1000", "300") + ", fan AS (" + _FAN[_AT:] + ") SELECT fan.*, place, funded_count FROM fan JOIN best ON fan.address = funder WHERE place <= 10")  # fmt: skip
def shared_funder_fanout(l: Ledger) -> DataFrame:
    """Fan-out of the ten addresses that funded most others within three hops."""
    changes = l.kept_changes()
    walks = flows.funding_walks(changes, labels(l), 3)
    return flows.shared_fanout(flows.shared_funders(walks), changes)


_KEPT = "k AS (SELECT * FROM bc WHERE day % 10 <> 0 AND day >= (SELECT max(day) FROM bc) - 400)"


@query(BC + ", " + _KEPT + _FAN[:_AT].replace("FROM bc", "FROM k").replace("JOIN bc", "JOIN k").replace("1000", "1000000000") + """
    SELECT address, scanned, recipient_count, sender_count, counterparty_count, coin_type_count, true AS recipient_near, true AS sender_near, true AS counterparty_near, true AS coin_near FROM f""")
def fanout_cached(l: Ledger) -> DataFrame:
    """Exact fan-out of each address over the days that a cache of day sketches holds (400 days old at most, those of an
    older method left out), and whether the cache's estimates are within 5 per cent of it."""
    changes = l.kept_changes()
    last = changes.agg(F.max("day")).first()[0]
    cache = written(sketches.day_sketches(changes, method=F.when(F.col("day") % 10 == 0, 1).otherwise(sketches.METHOD)), "sketches")
    found = sketches.merged(cache, F.lit((last or 0) * 86_400), 400 * 86_400)
    exact = flows.fanout(changes.where((F.col("day") % 10 != 0) & (F.col("day") >= (last or 0) - 400)), latest=None)
    names = [n for n in sketches.COUNTS]
    both = exact.join(found.select("address", F.col("scanned").alias("n"), *[F.col(n).alias(f"about_{n}") for n in names]), "address")
    near = [(F.abs(F.col(f"about_{n}") - F.col(n)) <= 0.05 * F.col(n)).alias(n.replace("_type", "").replace("_count", "_near")) for n in names]
    return both.select("address", F.col("n").alias("scanned"), *names, *near)


@query("""WITH shop AS (SELECT DISTINCT 'K' || s_suppkey % 10 AS kiosk FROM supplier WHERE s_suppkey % 3 = 1),
    rows AS (SELECT 0 AS phase, kiosk, 'P' || p_partkey AS id FROM part JOIN shop ON kiosk = 'K' || p_partkey % 17 UNION ALL SELECT 1, NULL, 'C' || c_custkey FROM customer WHERE c_custkey % 3 = 1)
    SELECT * FROM rows ORDER BY phase, kiosk, id LIMIT 50 OFFSET 100""")
def nft_cursor_page(l: Ledger) -> DataFrame:
    """The third page of an owner's list, by the cursors of the two before."""
    name = lambda p, c: F.concat(F.lit(p), c)
    items = l.table("part").select(name("K", F.col("p_partkey") % 17).alias("kiosk"), name("P", F.col("p_partkey")).alias("id"))
    direct = l.table("customer").select(name("N", F.col("c_custkey") % 3).alias("owner"), name("C", F.col("c_custkey")).alias("id"))
    caps = l.table("supplier").select(name("N", F.col("s_suppkey") % 3).alias("owner"), name("K", F.col("s_suppkey") % 10).alias("kiosk"))
    found, token = cursors.page(items, direct, caps, "N1")
    for _ in range(2):
        found, token = cursors.page(items, direct, caps, "N1", token) if token else (found.limit(0), None)
    return found.select("phase", "kiosk", "id")


_NAMES = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"


@query(f"""WITH f AS (SELECT '0x' || lpad('ab' || s_suppkey, 64, '0') AS address, s_name AS label, ({_NAMES})[(s_suppkey % 9 + 1)::INT] AS category, CASE WHEN s_suppkey % 2 = 0 THEN 'desk' ELSE 'override' END AS source FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0),
    c AS (SELECT '0x' || lpad('ab' || s_suppkey, 64, '0') AS address, 'curated ' || s_suppkey AS label, 'other' AS category, 'curated' AS source FROM supplier WHERE s_suppkey % 4 = 0)
    SELECT * FROM f UNION ALL SELECT * FROM c WHERE address NOT IN (SELECT address FROM f)""")
def label_override(l: Ledger) -> DataFrame:
    """Curated labels under those of a label file, in which some lines are broken and some labels are numbers."""
    k = F.col("s_suppkey")
    said = F.to_json(F.struct(F.concat(F.lit(" 0xAB"), k).alias("address"), F.col("s_name").alias("label"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (k % 9 + 1).cast("int")).alias("category"), F.when(k % 2 == 0, "desk").alias("source")))
    line = F.when(k % 9 == 0, F.substring(said, 1, 20)).when(k % 7 == 0, F.regexp_replace(said, '"label":"[^"]*"', '"label":7')).otherwise(said)
    path = f"{shared_dir(l.spark)}/labels-{uuid.uuid4().hex}"
    l.table("supplier").select(line.alias("value")).write.text(path)
    files = label_sources.read_labels(l.spark, path).select("address", "label", "category", "source")
    curated = l.table("supplier").where(k % 4 == 0).select(scalars.normalize_address(F.concat(F.lit("0xab"), k)).alias("address"), F.concat(F.lit("curated "), k).alias("label"), F.lit("other").alias("category"), F.lit("curated").alias("source"))
    return label_sources.overridden(curated, files)


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'address:S' || p_size WHEN 1 THEN 'object:S' || p_size WHEN 2 THEN 'shared' ELSE 'address' END AS owner FROM part")
def owner_text(l: Ledger) -> DataFrame:
    """Owners as text, with the address of those that have one."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "address").when(k % 4 == 1, "object").when(k % 4 == 2, "shared").otherwise("address")
    return l.table("part").select(k.alias("id"), scalars.owner_text(kind, F.when(k % 4 != 3, F.concat(F.lit("S"), "p_size"))).alias("owner"))
