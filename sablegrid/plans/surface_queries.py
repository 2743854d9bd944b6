"""Queries over nested types and the operation patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..operators import rules
from ..sources.ledger import Ledger
from ..sources.operations import OPERATIONS, operation_patterns
from .registry import query

#: What a level adds around the type inside: as JSON and as text, before and after.
_AROUND = [
    ('{"kind":"vector","args":[', "]}", "vector<", ">"),
    ('{"kind":"datatype","name":"0x2::table::Table","args":[{"kind":"address"},', "]}", "0x2::table::Table<address, ", ">"),
    ('{"kind":"datatype","name":"0x2::bag::[Bag]","args":[', ',{"kind":"parameter","index":1}]}', "0x2::bag::[Bag]<", ", T1>"),
]
_LEVELS = 9
_CORE = [('{"kind":"u64"}', "u64"), ('{"kind":"parameter"}', "T0"), ('{"kind":"vector","args":[]}', "vector<?>"), ('{"kind":"odd"}', "unknown"), ('{"kind":"datatype","name":"0x2::coin::Coin","args":[]}', "0x2::coin::Coin")]


def _wrapped(core: str, side: tuple[int, int]) -> str:
    """SQL of a part's type: p_size % 10 levels around the core that its key names."""
    at = lambda i, k: "CASE WHEN depth >= %d THEN CASE (p_partkey + %d) %% 3 %s END ELSE '' END" % (i, i, " ".join(f"WHEN {j} THEN '{_AROUND[j][k]}'" for j in range(3)))
    levels = range(1, _LEVELS + 1)
    return " || ".join([at(i, side[0]) for i in reversed(levels)] + [core] + [at(i, side[1]) for i in levels])


def _core(k: int) -> str:
    return f"CASE p_partkey % {len(_CORE)} " + " ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(_CORE)) + " END"


@query(f"SELECT p_partkey AS id, {_wrapped(_core(1), (2, 3))} AS text, depth::INT AS depth FROM (SELECT p_partkey, p_size % {_LEVELS + 1} AS depth FROM part)")
def type_text(l: Ledger) -> DataFrame:
    """Types of parts, nested up to nine levels."""
    rows = l.spread("part", "p_partkey").selectExpr("p_partkey", f"p_size % {_LEVELS + 1} AS depth").selectExpr("p_partkey AS id", "CAST(depth AS int) AS depth", f"{_wrapped(_core(0), (0, 1))} AS body")
    return rows.select("id", types.type_text(F.col("body")).alias("text"), "depth")


_FIELDS = "part JOIN (VALUES (0), (1), (2)) v(n) ON n <= p_size % 3"


@query(f"SELECT p_partkey AS id, string_agg('f' || n || ': ' || CASE (p_partkey + n) % 3 WHEN 0 THEN 'vector<u8>' WHEN 1 THEN 'address' ELSE 'unknown' END, '; ' ORDER BY (n + p_partkey) % 3, n) AS fields FROM {_FIELDS} GROUP BY 1")
def datatype_fields(l: Ledger) -> DataFrame:
    """Fields in the order of their positions."""
    k = F.col("p_partkey")
    kind = lambda n: F.when((k + n) % 3 == 0, '{"kind":"vector","args":[{"kind":"u8"}]}').when((k + n) % 3 == 1, '{"kind":"address"}')
    field = lambda n: F.struct(F.concat(F.lit("f"), n).alias("name"), ((n + k) % 3).cast("int").alias("position"), kind(n).alias("type"))
    fields = F.transform(F.sequence(F.lit(0), (F.col("p_size") % 3).cast("int")), field)
    return l.spread("part", "p_partkey").select(k.alias("id"), fields.alias("f")).select("id", F.array_join(types.ordered_fields(F.col("f")), "; ").alias("fields"))


_LIST = lambda of: "[" + ", ".join(f"'{x}'" for x in of) + "]"
_MODULES, _STARTS = list(dict.fromkeys(r[0] for r in OPERATIONS)) + ["other"], list(dict.fromkeys(r[1] for r in OPERATIONS))
_CALL = f"""c AS (SELECT l_orderkey AS digest, l_linenumber::BIGINT AS ord, p_brand AS package, ({_LIST(_MODULES)})[(l_partkey % {len(_MODULES)} + 1)::INT] AS module,
    ({_LIST(_STARTS)})[(l_suppkey % {len(_STARTS)} + 1)::INT] || (['', '_a2b', 'x', '_with_' || l_linenumber])[(l_orderkey % 4 + 1)::INT] AS function FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PATTERNS = "o(priority, module, prefix, action, skip) AS (VALUES " + ", ".join(f"({i}, '{m}', '{p}', '{a}', {str(s).lower()})" for i, (m, p, a, s) in enumerate(OPERATIONS, 1)) + ")"


@query(f"""WITH {_CALL}, {_PATTERNS}, d AS (SELECT DISTINCT module, function FROM c),
    b AS (SELECT d.module, d.function, arg_min(action, priority) AS action, arg_min(skip, priority) AS skip FROM d JOIN o ON o.module = d.module AND starts_with(d.function, prefix) GROUP BY 1, 2)
    SELECT digest, ord, package, c.module, c.function, action, skip FROM c LEFT JOIN b ON b.module = c.module AND b.function = c.function""")
def operation_registry(l: Ledger) -> DataFrame:
    """All patterns over calls of their modules; several prefixes hide others, some are empty."""
    pick = lambda of, at: F.element_at(F.array(*map(F.lit, of)), (at % len(of) + 1).cast("int"))
    end = F.element_at(F.array(F.lit(""), F.lit("_a2b"), F.lit("x"), F.concat(F.lit("_with_"), "l_linenumber")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    line = l.table("lineitem").join(l.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    calls = line.select(
        F.col("l_orderkey").alias("digest"), F.col("l_linenumber").cast("long").alias("ord"), F.col("p_brand").alias("package"), pick(_MODULES, F.col("l_partkey")).alias("module"),
        F.concat(pick(_STARTS, F.col("l_suppkey")), end).alias("function"),
    )
    return rules.match_operations(calls, operation_patterns(l.spark))
