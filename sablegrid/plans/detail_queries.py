"""Queries that tell transactions, walks and cases in words, and the registry's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import cases, flows, objects, rules, search
from ..sources.ledger import SINKS, Ledger, ctes
from ..sources.shared import dealt, tasks
from .event_queries import labels
from .flow_queries import _HOPS, _SAID, NEAR, TRACE, written_edges
from .object_queries import _OBJ, _objects
from .registry import query
from .rule_queries import OP, matched_calls

_ARGS = "CASE WHEN ord % 3 = 0 THEN [] WHEN ord % 3 = 1 THEN ['0x2::' || module || '::' || upper(module)] ELSE ['0x2::' || module || '::' || upper(module), 'USDC'] END"
_KINDS = "CASE ord WHEN 7 THEN 'publish' WHEN 6 THEN 'transfer' WHEN 5 THEN 'split' ELSE 'call' END"
_WORD = "CASE action WHEN 'swap' THEN 'Swap' WHEN 'add_liquidity' THEN 'Add liquidity' WHEN 'remove_liquidity' THEN 'Remove liquidity' WHEN 'borrow' THEN 'Borrow' WHEN 'repay' THEN 'Repay' WHEN 'stake' THEN 'Stake' WHEN 'unstake' THEN 'Unstake' WHEN 'claim_rewards' THEN 'Claim rewards' ELSE action END"
_DECODED = OP + f""", ar AS (SELECT op.*, protocol, {_ARGS} AS args, {_KINDS} AS kind, {_WORD} AS word FROM op LEFT JOIN pro USING (package)),
    sy AS (SELECT *, CASE WHEN len(args) >= 1 THEN upper(module) END AS c0, coalesce(' on ' || protocol, '') AS tail FROM ar),
    wd AS (SELECT digest, ord, CASE WHEN kind = 'call' THEN protocol END AS protocol, CASE WHEN kind = 'publish' THEN 'Publish new package' WHEN kind = 'transfer' THEN 'Transfer to recipient' WHEN kind = 'split' THEN NULL WHEN skip THEN NULL
        WHEN action = 'swap' AND len(args) >= 2 THEN word || ' ' || c0 || ' → USDC' || tail WHEN action IN ('borrow', 'repay') AND len(args) >= 1 THEN word || ' ' || c0 || tail WHEN action IS NOT NULL THEN word || tail
        WHEN protocol IS NOT NULL THEN 'Call ' || module || '::' || function || ' on ' || protocol ELSE 'Call ' || CASE WHEN length(package) > 16 THEN left(package, 10) || '…' || right(package, 4) ELSE package END || '::' || module || '::' || function END AS text FROM sy),
    de AS (SELECT digest, coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol), '') AS protocols, coalesce(string_agg(text, '; ' ORDER BY ord), '') AS actions FROM wd GROUP BY 1)"""


def _operations(commands: DataFrame) -> DataFrame:
    coin = F.concat(F.lit("0x2::"), "module", F.lit("::"), F.upper("module"))
    args = F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).when(F.col("ord") % 3 == 1, F.array(coin)).otherwise(F.array(coin, F.lit("USDC")))
    kind = F.when(F.col("ord") == 7, "publish").when(F.col("ord") == 6, "transfer").when(F.col("ord") == 5, "split").otherwise("call")
    return commands.withColumn("type_args", args).withColumn("kind", kind)


@query(ctes("cmd", "pat", "pro", "bc", "tx") + ", " + _DECODED + ", fl AS (SELECT digest, string_agg(cents || ' ' || coin, '; ' ORDER BY ord) AS token_flow FROM bc WHERE address = sender GROUP BY 1) SELECT digest, coalesce(protocols, '') AS protocols, coalesce(actions, '') AS actions, coalesce(token_flow, '') AS token_flow FROM tx LEFT JOIN de USING (digest) LEFT JOIN fl USING (digest)")
def decode_flows(l: Ledger) -> DataFrame:
    """Every transaction in words: protocols, actions with their coins, and what its sender gained and lost."""
    return rules.decoded(l.transactions(), _operations(l.commands_with_changes(matched_calls(l, coin=True))), l.protocols())


@query(
    ctes("bc", "cmd", "lbl", "pat", "pro", "tx", recursive=True) + ", " + NEAR + ", " + TRACE.replace("op AS", "op0 AS").replace("FROM op WHERE", "FROM op0 WHERE") + ", " + _DECODED + ", " + _HOPS.format(n="f", a="te.next_address", c="next_digest") + ", ww AS ("
    + _SAID.format(d="forward", n="f", a="te.next_address", c="next_digest") + """), tl AS (SELECT digest, string_agg('  ' || address || ': ' || cents || ' ' || coin, chr(10) ORDER BY ord) FILTER (abs(cents) > 1000000) AS flows, list(coin ORDER BY ord) FILTER (abs(cents) > 1000000) AS coins FROM bc GROUP BY 1),
    ea AS (SELECT tx.digest, tx.day, 'Tx:     ' || tx.digest || chr(10) || 'Sender: ' || coalesce(tx.sender, 'unknown') || CASE WHEN coalesce(actions, '') <> '' THEN chr(10) || 'Action: ' || actions ELSE '' END || CASE WHEN flows IS NOT NULL THEN chr(10) || 'Flows:' || chr(10) || flows WHEN tl.digest IS NOT NULL THEN chr(10) || 'Flows:  gas only' ELSE '' END AS body,
        coalesce(protocols, '') AS protocols, coalesce(coins, []) AS coins, coalesce(actions, '') AS actions FROM tx LEFT JOIN tl USING (digest) LEFT JOIN de USING (digest)),
    hp AS (SELECT direction, seed, hop, ea.* FROM ww JOIN ea USING (digest)),
    pn AS (SELECT seed, name, min((hop, i)) AS seen FROM (SELECT seed, hop, unnest(string_split(protocols, ',')) AS name, generate_subscripts(string_split(protocols, ','), 1) AS i FROM hp WHERE protocols <> '') t GROUP BY 1, 2),
    cn AS (SELECT seed, name, min((hop, i)) AS seen FROM (SELECT seed, hop, unnest(coins) AS name, generate_subscripts(coins, 1) AS i FROM hp) t GROUP BY 1, 2),
    pl AS (SELECT seed, string_agg(name, ', ' ORDER BY seen) AS names FROM pn GROUP BY 1), cl AS (SELECT seed, string_agg(name, ', ' ORDER BY seen) AS names FROM cn GROUP BY 1),
    st AS (SELECT direction, seed, count(*) AS n, abs(arg_max(day, hop) - arg_min(day, hop)) AS span, arg_min(digest, hop) AS first, arg_max(actions, hop) AS last, string_agg(chr(10) || '--- Hop ' || hop || ' ' || coalesce('(day ' || day || ') ', '') || '---' || chr(10) || body || chr(10), '' ORDER BY hop) AS hops FROM hp GROUP BY 1, 2)
    SELECT direction, seed, 'FUND TRACE — ' || upper(direction) || chr(10) || 'Starting tx: ' || first || CASE WHEN n > 1 AND span IS NOT NULL THEN chr(10) || 'Time span: ' || span || CASE WHEN span = 1 THEN ' day' ELSE ' days' END || ' across ' || n || ' hops' ELSE chr(10) || 'Hops: ' || n END
        || CASE WHEN pl.names IS NOT NULL THEN chr(10) || 'Protocols: ' || pl.names ELSE '' END || chr(10) || hops || CASE WHEN cl.names IS NOT NULL THEN chr(10) || 'Coins involved: ' || cl.names ELSE '' END || CASE WHEN last <> '' THEN chr(10) || 'Final action: ' || last ELSE '' END AS story
    FROM st LEFT JOIN pl USING (seed) LEFT JOIN cl USING (seed)"""
)
def trace_story(l: Ledger) -> DataFrame:
    """The forward walk of every transaction, told."""
    changes = l.kept_changes()
    sinks = labels(l).where(F.col("category").isin(*SINKS))
    owners = tasks(l.table("lineitem"))
    told = dealt(rules.decode(_operations(l.commands(matched_calls(l))), l.protocols(), F.bool_or(F.expr("action = 'swap' and not skip")).alias("swaps")), "decoded", "digest", owners)
    walk = flows.trace_walk(written_edges(l, told.where("swaps").select("digest")), flows.neighbours(changes), sinks, l.transactions().select("digest"), directions=("forward",), carry=())
    return flows.trace_story(walk, l.transactions(), changes, told.drop("swaps"), owners=owners)


_CASE = """WITH f AS (SELECT event_id AS id, 'case ' || user_id % 40 AS case_name, 'finding ' || event_id AS title, CASE WHEN event_id % 3 > 0 THEN 'seen at ' || event_id END AS detail, (['high', 'Medium', 'low', NULL])[(event_id % 4 + 1)] AS confidence, epoch_ms(ts) AS created_at,
    CASE WHEN event_id % 5 = 0 THEN [] ELSE ['0x' || lpad((event_id % 9)::VARCHAR, 40, 'a'), 'a' || user_id] END AS addresses, CASE WHEN event_id % 2 = 0 THEN ['tx ' || event_id, 'tx ' || (event_id + 1)] ELSE [] END AS evidence FROM events WHERE event_type = 'error'),
    p AS (SELECT *, row_number() OVER (PARTITION BY case_name ORDER BY CASE lower(confidence) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, created_at, id) AS position FROM f),
    a AS (SELECT case_name, address, min((position, i)) AS seen FROM (SELECT case_name, position, unnest(addresses) AS address, generate_subscripts(addresses, 1) AS i FROM p) t GROUP BY 1, 2),
    s AS (SELECT case_name, count(*) AS n, min(created_at) AS lo, max(created_at) AS hi, (SELECT count(*) FROM a WHERE a.case_name = p.case_name) AS m FROM p GROUP BY 1),
    x AS (SELECT case_name, 0 AS part, 0::BIGINT AS place, ['# ' || case_name, '', n || ' finding' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' · ' || m || ' address' || CASE WHEN m = 1 THEN '' ELSE 'es' END || ' · recorded ' || strftime(make_timestamp(lo * 1000), '%Y-%m-%d %H:%M') || ' – ' || strftime(make_timestamp(hi * 1000), '%Y-%m-%d %H:%M') || ' UTC', ''] AS lines FROM s
    UNION ALL SELECT case_name, 1, position, list_concat(['## ' || title, ''], CASE WHEN confidence IS NOT NULL THEN ['**Confidence:** ' || confidence, ''] ELSE [] END, CASE WHEN detail IS NOT NULL THEN [detail, ''] ELSE [] END,
        CASE WHEN len(addresses) > 0 THEN list_concat(['**Addresses**', ''], list_transform(addresses, lambda q: '- `' || CASE WHEN length(q) > 20 THEN left(q, 10) || '…' || right(q, 6) ELSE q END || '`'), ['']) ELSE [] END, CASE WHEN len(evidence) > 0 THEN list_concat(['**Evidence**', ''], list_transform(evidence, lambda q: '- ' || q), ['']) ELSE [] END) FROM p
    UNION ALL SELECT case_name, 2, 0, ['## Appendix: full addresses', ''] FROM s WHERE m > 0 UNION ALL SELECT case_name, 2, row_number() OVER (PARTITION BY case_name ORDER BY seen), ['- `' || address || '`'] FROM a
    UNION ALL SELECT case_name, 3, 0, list_concat(CASE WHEN m > 0 THEN [''] ELSE [] END, ['---', '', '_Generated at 2024-02-01 00:00:00 UTC._']) FROM s)
    SELECT case_name, part, place, (unnest(range(len(lines))))::INT AS n, unnest(lines) AS line FROM x"""


@query(_CASE)
def case_reports(l: Ledger) -> DataFrame:
    """The reports of all cases, line by line."""
    k, e = F.col("seq"), l.events().where("type = 'error'")
    level = F.element_at(F.array(F.lit("high"), F.lit("Medium"), F.lit("low"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    none = F.array().cast("array<string>")
    found = e.select(
        k.alias("id"), F.concat(F.lit("case "), F.col("sender") % 40).alias("case_name"), F.concat(F.lit("finding "), k).alias("title"), F.when(k % 3 > 0, F.concat(F.lit("seen at "), k)).alias("detail"), level.alias("confidence"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.when(k % 5 == 0, none).otherwise(F.array(F.concat(F.lit("0x"), F.lpad((k % 9).cast("string"), 40, "a")), F.concat(F.lit("a"), "sender"))).alias("addresses"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("tx "), k), F.concat(F.lit("tx "), k + 1))).otherwise(none).alias("evidence"),
    )
    return cases.report_lines(found, 1_706_745_600_000)


@query(ctes("tx") + " SELECT digest, sender, status, day FROM tx WHERE day > 200 AND digest IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7)")
def scan_transactions_by_object(l: Ledger) -> DataFrame:
    touched = l.table("lineitem").select(F.col("l_orderkey").alias("digest"), F.concat(F.lit("O"), "l_partkey").alias("object_id"))
    return search.scan_transactions(l.transactions(), l.changes(), l.commands(), object_id="O7", objects=touched, after=200)


@query(ctes("tx") + ", s AS (SELECT digest, sender, CASE WHEN digest % 5 = 0 THEN NULL WHEN digest % 3 = 0 THEN sender ELSE 'C' || digest % 10 END AS sponsor FROM tx) SELECT *, sponsor IS NOT NULL AND sponsor <> sender AS gas_sponsored FROM s")
def tx_sponsored(l: Ledger) -> DataFrame:
    d = F.col("digest")
    sponsor = F.when(d % 5 == 0, F.lit(None).cast("string")).when(d % 3 == 0, F.col("sender")).otherwise(F.concat(F.lit("C"), d % 10))
    return search.sponsored(l.transactions().select("digest", "sender", sponsor.alias("sponsor")))


_TOK = "tk AS (SELECT '0x' || p_partkey || '::m::T' AS type, CASE WHEN p_partkey % 4 > 0 THEN upper(left(p_name, 3)) || p_partkey % 50 END AS symbol, p_name AS name FROM part)"


@query("WITH " + _TOK + """, q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '0x9::a::B' || p_partkey WHEN 1 THEN lower(left(p_name, 3)) || p_partkey % 50 WHEN 2 THEN substr(p_name, 2, 5) ELSE 'zz' || p_partkey END AS term FROM part),
    e AS (SELECT term, min(type) AS type FROM q JOIN tk ON lower(symbol) = lower(term) WHERE NOT contains(term, '::') GROUP BY 1),
    r AS (SELECT term FROM q WHERE NOT contains(term, '::') AND term NOT IN (SELECT term FROM e)),
    ln AS (SELECT lower(name) AS low, arg_min(type, (type, name)) AS type, arg_min(name, (type, name)) AS name FROM tk GROUP BY 1), ls AS (SELECT lower(symbol) AS low, arg_min(type, (type, symbol)) AS type, arg_min(symbol, (type, symbol)) AS name FROM tk WHERE symbol IS NOT NULL GROUP BY 1),
    a AS (SELECT term, arg_min(type, (low <> lower(term), name, type)) AS type FROM r JOIN ln ON contains(low, lower(term)) GROUP BY 1), b AS (SELECT term, arg_min(type, (low <> lower(term), name, type)) AS type FROM r JOIN ls ON contains(low, lower(term)) GROUP BY 1)
    SELECT term, CASE WHEN contains(term, '::') THEN term ELSE coalesce(e.type, a.type, b.type) END AS type, CASE WHEN contains(term, '::') THEN 'literal' WHEN e.type IS NOT NULL THEN 'symbol' WHEN coalesce(a.type, b.type) IS NOT NULL THEN 'part' END AS found FROM q LEFT JOIN e USING (term) LEFT JOIN a USING (term) LEFT JOIN b USING (term)""")
def token_lookup(l: Ledger) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    tokens = l.table("part").select(F.concat(F.lit("0x"), k, F.lit("::m::T")).alias("type"), F.when(k % 4 > 0, F.concat(F.upper(F.left(name, F.lit(3))), k % 50)).alias("symbol"), name.alias("name"))
    term = F.when(k % 4 == 0, F.concat(F.lit("0x9::a::B"), k)).when(k % 4 == 1, F.concat(F.lower(F.left(name, F.lit(3))), k % 50)).when(k % 4 == 2, F.substring(name, 2, 5)).otherwise(F.concat(F.lit("zz"), k))
    return search.resolve_tokens(l.table("part").select(term.alias("term")).distinct(), tokens)


_REG = "rg AS (SELECT '@org/app' || p_partkey % 100 AS name, p_size::BIGINT AS version, min('0x' || p_partkey) AS package, min(p_name) AS description FROM part GROUP BY 1, 2), lt AS (SELECT name, max(version) AS last FROM rg GROUP BY 1)"


def _registry(l: Ledger) -> DataFrame:
    p = l.table("part").select(F.concat(F.lit("@org/app"), F.col("p_partkey") % 100).alias("name"), F.col("p_size").cast("long").alias("version"), F.concat(F.lit("0x"), "p_partkey").alias("package"), "p_name")
    return p.groupBy("name", "version").agg(F.min("package").alias("package"), F.min("p_name").alias("description"))


@query("WITH " + _REG + """, q AS (SELECT DISTINCT '@org/app' || s_suppkey % 150 AS base, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 60 END AS pin FROM supplier)
    SELECT base || coalesce('/' || pin, '') AS name, CASE WHEN package IS NOT NULL THEN coalesce(pin, last) END AS version, package, description FROM q LEFT JOIN lt ON lt.name = base LEFT JOIN rg ON rg.name = base AND version = coalesce(pin, last)""")
def package_info(l: Ledger) -> DataFrame:
    k = F.col("s_suppkey")
    asked = l.table("supplier").select(F.concat_ws("/", F.concat(F.lit("@org/app"), k % 150), F.when(k % 2 == 0, (k % 60).cast("string"))).alias("name")).distinct()
    return search.package_info(asked, _registry(l))


@query("WITH " + _REG + """, st AS (SELECT package, 'm' || length(description) % 3 AS module, 'T' AS type, '0xd' || version AS defined_in FROM rg), q AS (SELECT DISTINCT '@org/app' || s_suppkey % 150 AS base, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 60 END AS pin, 'm' || s_suppkey % 3 AS module FROM supplier)
    SELECT base || coalesce('/' || pin, '') || '::' || q.module || '::T' AS path, CASE WHEN defined_in IS NOT NULL THEN defined_in || '::' || q.module || '::T' END AS type_tag FROM q LEFT JOIN lt ON lt.name = base LEFT JOIN rg ON rg.name = base AND version = coalesce(pin, last) LEFT JOIN st ON st.package = rg.package AND st.module = q.module""")
def struct_tags(l: Ledger) -> DataFrame:
    k, reg = F.col("s_suppkey"), _registry(l)
    structs = reg.select("package", F.concat(F.lit("m"), F.length("description") % 3).alias("module"), F.lit("T").alias("type"), F.concat(F.lit("0xd"), "version").alias("defined_in"))
    name = F.concat_ws("/", F.concat(F.lit("@org/app"), k % 150), F.when(k % 2 == 0, (k % 60).cast("string")))
    return search.resolve_structs(l.table("supplier").select(F.concat_ws("::", name, F.concat(F.lit("m"), k % 3), F.lit("T")).alias("path")).distinct(), reg, structs)


@query(_OBJ + " SELECT object_id, regexp_extract(type, '^0x2::coin::Coin<(.*)>$', 1) AS coin, content->>'$.name' AS name, version FROM obj WHERE starts_with(type, '0x2::coin::Coin<')")
def token_metadata(l: Ledger) -> DataFrame:
    """The catalogue's own rows: an object's coin with its name."""
    return objects.metadata(_objects(l), "0x2::coin::Coin")


@query("SELECT p_partkey AS id, 'w' || repeat('.a', (p_size % 6)::INT) || '.n' || p_size % 6 || ',z' AS fields FROM part")
def deep_numeric_fields(l: Ledger) -> DataFrame:
    """Numbers in objects within objects, up to six levels deep; lists and other text are passed over."""
    depth = (F.col("p_size") % 6).cast("int")
    inner = F.concat(F.lit('{"n'), depth.cast("string"), F.lit('": "'), F.col("p_size").cast("string"), F.lit('", "l": [1, {"x": 2}], "t": "x", "e": "", "b": true}'))
    payload = F.concat(F.lit('{"z": -1.5e2, "w": '), F.repeat(F.lit('{"a": '), depth), inner, F.repeat(F.lit("}"), depth), F.lit("}"))
    return l.table("part").select(F.col("p_partkey").alias("id"), F.array_join(paths.numeric_paths(payload), ",").alias("fields"))
