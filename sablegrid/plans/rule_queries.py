"""Queries of the rules, diffs and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases, diffs, rules
from ..sources.ledger import Ledger, ctes
from .registry import query

OP = """op AS (SELECT cmd.*, p.action, p.skip FROM cmd LEFT JOIN LATERAL (SELECT action, skip FROM pat WHERE pat.module = cmd.module AND starts_with(cmd.function, pat.prefix) ORDER BY priority LIMIT 1) p ON true)"""


def matched_calls(l: Ledger, coin: bool = False) -> DataFrame:
    """The calls of parts with their action and skip: patterns hang on the call alone, so lines need not move for them."""
    return rules.match_operations(l.calls(coin), l.patterns())


@query(ctes("cmd", "pat") + ", " + OP + " SELECT * FROM op")
def operation_match(l: Ledger) -> DataFrame:
    return l.commands(matched_calls(l))


@query(ctes("cmd", "pat", "pro") + ", " + OP + """, t AS (SELECT digest, ord, protocol, CASE WHEN skip THEN NULL WHEN action IS NOT NULL THEN concat_ws(' on ', CASE action WHEN 'swap' THEN 'Swap' WHEN 'add_liquidity' THEN 'Add liquidity' WHEN 'remove_liquidity' THEN 'Remove liquidity'
    WHEN 'borrow' THEN 'Borrow' WHEN 'repay' THEN 'Repay' WHEN 'stake' THEN 'Stake' WHEN 'unstake' THEN 'Unstake' WHEN 'claim_rewards' THEN 'Claim rewards' ELSE action END, protocol) WHEN protocol IS NOT NULL THEN 'Call ' || module || '::' || function || ' on ' || protocol
    ELSE 'Call ' || package || '::' || module || '::' || function END AS text FROM op LEFT JOIN pro USING (package))
    SELECT digest, coalesce(string_agg(DISTINCT protocol, ',' ORDER BY protocol), '') AS protocols, coalesce(string_agg(text, '; ' ORDER BY ord), '') AS actions FROM t GROUP BY 1""")
def decode_tx(l: Ledger) -> DataFrame:
    return rules.decode(l.commands(matched_calls(l)), l.protocols())


_CALLS = ", c AS (SELECT digest, package, CASE WHEN function LIKE 'hot%' THEN 'flash_' || function WHEN function LIKE 'old%' THEN 'borrow_' || function WHEN function LIKE 'new%' THEN function || '_repay' ELSE function END AS function, CASE WHEN ord = 7 THEN 'publish' ELSE 'call' END AS kind FROM cmd)"


@query(ctes("cmd", "pro") + _CALLS + """, s AS (SELECT digest, count(*) FILTER (kind = 'publish') AS published, count(DISTINCT c.package) FILTER (kind = 'call' AND protocol IS NULL) AS unverified, count(*) FILTER (kind = 'call' AND contains(function, 'flash')) AS flash,
    count(*) FILTER (kind = 'call' AND regexp_matches(function, '(^|_)borrow($|_)')) AS borrowed, count(*) FILTER (kind = 'call' AND regexp_matches(function, '(^|_)repay($|_)')) AS repaid, count(DISTINCT c.package) FILTER (kind = 'call') AS packages FROM c LEFT JOIN pro USING (package) GROUP BY 1)
    SELECT digest, 'publishes-or-upgrades' AS code, 'high' AS severity, published AS evidence_count FROM s WHERE published > 0 UNION ALL SELECT digest, 'unverified-package-call', 'medium', unverified FROM s WHERE unverified > 0
    UNION ALL SELECT digest, 'flashloan-pattern', 'info', CASE WHEN flash > 0 THEN flash ELSE borrowed + repaid END FROM s WHERE flash > 0 OR (borrowed > 0 AND repaid > 0) UNION ALL SELECT digest, 'multi-package-composition', 'info', packages FROM s WHERE packages >= 4""")
def ptb_anomalies(l: Ledger) -> DataFrame:
    f = F.col("function")
    name = F.when(f.startswith("hot"), F.concat(F.lit("flash_"), f)).when(f.startswith("old"), F.concat(F.lit("borrow_"), f)).when(f.startswith("new"), F.concat(f, F.lit("_repay"))).otherwise(f)
    return rules.anomalies(l.commands().withColumn("function", name).withColumn("kind", F.when(F.col("ord") == 7, "publish").otherwise("call")), l.protocols())


_SURFACE = """WITH fn AS (SELECT p_brand AS package, CASE WHEN p_partkey % 7 = 0 THEN 'mint_' || p_partkey WHEN p_partkey % 13 = 0 THEN 'deny_add' ELSE replace(p_name, ' ', '_') END AS name, p_size % 2 = 0 AS is_public,
    (['u64', '0x2::coin::Coin', '0x2::coin::TreasuryCap', '0x2::random::Random'])[(p_partkey % 4 + 1)::INT] AS params FROM part), st AS (SELECT p_brand AS package, CASE WHEN p_partkey % 11 = 0 THEN 'AdminCap' WHEN p_partkey % 17 = 0 THEN 'DenyCap' ELSE 'Pool' END AS name, p_size % 4 AS abilities FROM part WHERE p_partkey % 5 = 0)"""


@query(_SURFACE + """, f AS (SELECT package, count(*) AS functions, count(*) FILTER (is_public) AS public, count(*) FILTER (name LIKE 'deny%') AS deny_f, count(*) FILTER (contains(params, 'coin::TreasuryCap')) AS treasury, count(*) FILTER (is_public AND name LIKE 'mint\\_%' ESCAPE '\\') AS mint,
    count(*) FILTER (is_public AND contains(params, 'coin::Coin')) AS funds, count(*) FILTER (contains(params, 'random::Random')) AS random FROM fn GROUP BY 1), s AS (SELECT package, count(*) FILTER (name = 'DenyCap') AS deny_s, count(*) FILTER (name = 'AdminCap') AS caps, count(*) FILTER (abilities = 0) AS potatoes FROM st GROUP BY 1),
    b AS (SELECT package, coalesce(functions, 0) AS functions, coalesce(public, 0) AS public, coalesce(deny_f, 0) + coalesce(deny_s, 0) AS deny, coalesce(treasury, 0) + coalesce(mint, 0) AS mint, coalesce(caps, 0) AS caps, coalesce(funds, 0) AS funds, coalesce(random, 0) AS random, coalesce(potatoes, 0) AS potatoes FROM f FULL JOIN s USING (package)),
    r AS (SELECT package, 'freeze-authority' AS code, 'high' AS severity, deny AS evidence_count FROM b UNION ALL SELECT package, 'mint-authority', 'medium', mint FROM b UNION ALL SELECT package, 'privileged-capability', 'medium', caps FROM b UNION ALL SELECT package, 'handles-funds', 'info', funds FROM b
    UNION ALL SELECT package, 'uses-randomness', 'info', random FROM b UNION ALL SELECT package, 'hot-potato', 'info', potatoes FROM b UNION ALL SELECT package, 'no-public-api', 'info', CASE WHEN functions > 0 AND public = 0 THEN functions ELSE 0 END FROM b) SELECT * FROM r WHERE evidence_count > 0""")
def package_rules(l: Ledger) -> DataFrame:
    p, k = l.table("part"), F.col("p_partkey")
    params = F.element_at(F.array(*map(F.lit, ("u64", "0x2::coin::Coin", "0x2::coin::TreasuryCap", "0x2::random::Random"))), (k % 4 + 1).cast("int"))
    name = F.when(k % 7 == 0, F.concat(F.lit("mint_"), k)).when(k % 13 == 0, "deny_add").otherwise(F.translate("p_name", " ", "_"))
    functions = p.select(F.col("p_brand").alias("package"), name.alias("name"), (F.col("p_size") % 2 == 0).alias("is_public"), params.alias("params"))
    structs = p.where(k % 5 == 0).select(F.col("p_brand").alias("package"), F.when(k % 11 == 0, "AdminCap").when(k % 17 == 0, "DenyCap").otherwise("Pool").alias("name"), (F.col("p_size") % 4).alias("abilities"))
    return rules.package_findings(functions, structs)


@query("""WITH c AS (SELECT p_partkey AS object_id, (['upgrade', 'treasury', 'deny', 'admin', NULL])[(p_partkey % 5 + 1)::INT] AS kind, (['address', 'shared', 'immutable'])[(p_size % 3 + 1)::INT] AS now, p_partkey % 6 = 0 AS gone, (p_partkey % 2) * 255 AS policy FROM part),
    o AS (SELECT object_id, kind, CASE WHEN gone THEN 'burned' ELSE now END AS owner, policy FROM c WHERE kind IS NOT NULL)
    SELECT object_id, kind, owner, CASE WHEN owner = 'burned' THEN 'info' WHEN kind = 'upgrade' AND policy = 255 THEN 'low' WHEN kind IN ('upgrade', 'treasury') THEN CASE WHEN owner = 'address' THEN 'high' ELSE 'medium' END
    WHEN kind = 'deny' THEN CASE WHEN owner = 'address' THEN 'medium' ELSE 'low' END ELSE CASE WHEN owner = 'address' THEN 'low' ELSE 'info' END END AS risk FROM o""")
def capability_risk(l: Ledger) -> DataFrame:
    k, two = F.col("p_partkey"), "0x" + "2".zfill(64)
    types = F.array(*map(F.lit, (f"{two}::package::UpgradeCap", f"{two}::coin::TreasuryCap<A>", f"{two}::coin::DenyCapV2<A::b::C>", "0x5::m::AdminCap", "0x5::m::Pool")))
    created = l.table("part").select(k.alias("object_id"), F.element_at(types, (k % 5 + 1).cast("int")).alias("type"), (k % 2 * 255).alias("policy"))
    owner = F.element_at(F.array(*map(F.lit, ("address", "shared", "immutable"))), (F.col("p_size") % 3 + 1).cast("int"))
    return rules.capability_audit(created, l.table("part").where(k % 6 != 0).select(k.alias("object_id"), owner.alias("owner_kind")))


_PAIRS = r"WITH m AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\s+$', '') AS line FROM documents)"


def _lines(l: Ledger, side: int) -> DataFrame:
    d = l.table("documents").where(F.col("doc_id") % 2 == side)
    return d.select(F.expr("doc_id div 2").alias("pair"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


@query(_PAIRS + """, c AS (SELECT pair, line, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM m GROUP BY ALL) SELECT pair, sum(greatest(b - a, 0))::BIGINT AS added, sum(greatest(a - b, 0))::BIGINT AS removed FROM c GROUP BY 1""")
def line_multiset_delta(l: Ledger) -> DataFrame:
    return rules.line_delta(_lines(l, 0), _lines(l, 1), ["pair"])


@query(r"""WITH m AS (SELECT doc_id // 10 AS family, 'm' || doc_id % 5 AS module, doc_id % 10 >= 5 AS later, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '(?m)[ \t\r]+$', '', 'g') AS text FROM documents),
    a AS (SELECT * FROM m WHERE NOT later), b AS (SELECT * FROM m WHERE later) SELECT coalesce(a.family, b.family) AS family, coalesce(a.module, b.module) AS module, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.family = b.family AND a.module = b.module""")
def package_diff(l: Ledger) -> DataFrame:
    d = l.table("documents").select(F.expr("doc_id div 10").alias("family"), F.concat(F.lit("m"), F.col("doc_id") % 5).alias("module"), (F.col("doc_id") % 10 >= 5).alias("later"), F.coalesce("text", F.lit("")).alias("text"))
    return rules.module_diff(d.where("not later"), d.where("later"), ["family"])


#: Longest common subsequences as chains of equal lines, each one further in both texts.
_COMMON = """, q AS (SELECT key, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM p), c AS (SELECT key, unnest(b) AS line, generate_subscripts(b, 1) AS j FROM p),
    m AS (SELECT q.key, i, j FROM q JOIN c ON q.key = c.key AND q.line = c.line),
    chain(key, i, j, n) AS (SELECT key, i, j, 1 FROM m UNION SELECT m.key, m.i, m.j, n + 1 FROM chain JOIN m ON m.key = chain.key AND m.i > chain.i AND m.j > chain.j),
    best AS (SELECT key, max(n) AS n FROM chain GROUP BY key), delta AS (SELECT p.key, len(b) - coalesce(n, 0) AS added, len(a) - coalesce(n, 0) AS removed FROM p LEFT JOIN best USING (key))"""
_CLEAN = r"list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '\s+$', ''))"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id // 2 AS key, doc_id % 2 AS side, {_CLEAN} AS lines FROM documents),
    p AS (SELECT key, coalesce(max(lines) FILTER (side = 0), ['']) AS a, coalesce(max(lines) FILTER (side = 1), ['']) AS b FROM d GROUP BY key){_COMMON}
    SELECT key, added, removed FROM delta""")
def lcs_diff(l: Ledger) -> DataFrame:
    d = l.table("documents").select(F.expr("doc_id div 2").alias("key"), (F.col("doc_id") % 2).alias("side"), "text")
    a, b = (d.where(F.col("side") == s).select("key", F.col("text").alias(n)) for s, n in ((0, "a"), (1, "b")))
    return diffs.ordered_diff(a.join(b, "key", "full")).select("key", "added", "removed")


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS key, {_CLEAN} AS a FROM documents),
    e AS (SELECT key, a, CASE WHEN key % 3 = 0 THEN a ELSE list_transform(list_filter(a, lambda x, i: i % 5 <> 4), lambda x, i: CASE WHEN i % 4 = 2 THEN x || '!' ELSE x END) END AS b FROM d),
    p AS (SELECT * FROM e WHERE key % 13 > 0 AND key % 11 > 0 AND a <> b){_COMMON},
    s AS (SELECT key // 10 AS package, key % 10 AS module, CASE WHEN key % 13 = 0 THEN 'removed' WHEN key % 11 = 0 THEN 'added' WHEN added IS NULL THEN 'unchanged' ELSE 'changed' END AS status, added, removed FROM e LEFT JOIN delta USING (key))
    SELECT package, module, status, added AS added_lines, removed AS removed_lines, CASE WHEN status = 'changed' THEN row_number() OVER (PARTITION BY package, status ORDER BY added + removed DESC, module) END AS place,
    count(*) FILTER (status <> 'added') OVER w AS from_modules, count(*) FILTER (status <> 'removed') OVER w AS to_modules, count(*) FILTER (status = 'unchanged') OVER w AS unchanged, count(*) FILTER (status <> 'unchanged') OVER w = 0 AS identical FROM s WINDOW w AS (PARTITION BY package)""")
def package_line_diff(l: Ledger) -> DataFrame:
    """A later version of each text: two texts of three lose a line in five and change one in four, the others only
    their line ends; some modules are new and some are gone."""
    k = F.col("doc_id")
    module = l.table("documents").select(F.expr("doc_id div 10").alias("package"), (k % 10).alias("module"), k, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    later = F.transform(F.filter(lines, lambda x, i: i % 5 != 3), lambda x, i: F.when(i % 4 == 1, F.concat(x, F.lit("!"))).otherwise(x))
    text = F.when(k % 3 == 0, F.array_join(lines, "  \r\n")).otherwise(F.array_join(later, "\n"))
    before, after = module.where((k % 11 > 0) | (k % 13 == 0)), module.where(k % 13 > 0).withColumn("text", text)
    return diffs.package_changes(before, after, ["package"]).drop("sample")


@query(ctes("cmd", "pro") + " SELECT package, count(*) AS calls, count(DISTINCT module) AS modules, count(DISTINCT function) AS functions FROM cmd WHERE package NOT IN (SELECT package FROM pro) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def unknown_packages(l: Ledger) -> DataFrame:
    rest = l.commands().join(l.protocols(), "package", "left_anti")
    return rest.groupBy("package").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("module").alias("modules"), F.count_distinct("function").alias("functions")).orderBy(F.desc("calls"), "package").limit(25)


_FIND = ctes("ev") + ", fi AS (SELECT seq AS id, 'case ' || sender AS case_name, seq AS created_at, (['high', 'medium', 'low', NULL])[((payload->>'k')::INT % 4 + 1)] AS confidence FROM ev WHERE type = 'error')"


def findings(l: Ledger) -> DataFrame:
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None).cast("string")), (F.get_json_object("payload", "$.k").cast("int") % 4 + 1))
    return l.events().where("type = 'error'").select(F.col("seq").alias("id"), F.concat(F.lit("case "), F.col("sender")).alias("case_name"), F.col("seq").alias("created_at"), level.alias("confidence"))


@query(_FIND + " SELECT case_name, count(*) AS findings, max(created_at) AS last_at FROM fi GROUP BY 1")
def case_list(l: Ledger) -> DataFrame:
    return cases.case_list(findings(l))


@query(_FIND + " SELECT id, case_name, created_at, confidence, row_number() OVER (PARTITION BY case_name ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, created_at, id) AS position FROM fi")
def case_order(l: Ledger) -> DataFrame:
    return cases.case_order(findings(l))
