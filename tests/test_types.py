"""Nested types as text, at any depth, and the index of operation patterns."""

import json
import random

from pyspark.sql import functions as F

from sablegrid.functions import types
from sablegrid.operators import rules
from sablegrid.sources.operations import OPERATIONS, operation_patterns


def plain(body):
    if body is None:
        return "unknown"
    inner = [plain(a) for a in body.get("args", [])]
    kind = body["kind"]
    if kind == "parameter":
        return f"T{body.get('index', 0)}"
    if kind == "vector":
        return f"vector<{inner[0] if inner else '?'}>"
    if kind == "datatype":
        return body.get("name", "?") + (f"<{', '.join(inner)}>" if inner else "")
    return kind if kind in types.PLAIN else "unknown"


def nested(rng, depth):
    kind = rng.choice(["vector", "datatype", "datatype"]) if depth else rng.choice(["u8", "address", "parameter", "odd", "vector", "datatype"])
    body = {"kind": kind}
    if kind == "datatype" and rng.random() < 0.9:
        body["name"] = rng.choice(["0x2::a::B", 'q"[\\', "x]y["])
    if kind == "parameter" and rng.random() < 0.5:
        body["index"] = rng.randrange(4)
    if depth:
        body["args"] = [nested(rng, depth - 1 if i == 0 else rng.randrange(depth)) for i in range(1 if kind == "vector" else rng.randint(1, 3))]
    return body


def test_types_of_any_depth(spark):
    rng = random.Random(1)
    bodies = [nested(rng, rng.randint(0, 7)) for _ in range(150)]
    deep = {"kind": "bool"}
    for _ in range(200):
        deep = {"kind": "vector", "args": [deep]}
    bodies.append(deep)
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(900, None), (901, "not json"), (902, "{}"), (903, '{"kind":"u8"'), (904, '[{"kind":"u8"}]')], "id long, body string")
    got = dict(rows.select("id", types.type_text(F.col("body"))).collect())
    assert got == {i: plain(b) for i, b in enumerate(bodies)} | {900: "unknown", 901: "unknown", 902: "unknown", 903: "unknown", 904: "unknown"}


def test_signatures_keep_other_words_and_mark_references(spark):
    rows = spark.createDataFrame([("mutable", '{"kind":"datatype","name":"A"}'), ("immutable", '{"kind":"signer"}'), (None, '{"kind":"vector","args":[{"kind":"u8"}]}')], "r string, b string")
    assert [r[0] for r in rows.select(types.signature_text(F.col("r"), F.col("b"))).collect()] == ["&mut A", "&signer", "vector<u8>"]


def test_fields_by_position(spark):
    fields = [("b", 1, '{"kind":"u8"}'), ("a", None, None), ("z", 0, '{"kind":"bool"}')]
    rows = spark.createDataFrame([(fields,)], "f array<struct<name: string, position: int, type: string>>")
    assert rows.select(types.ordered_fields(F.col("f"))).first()[0] == ["a: unknown", "z: bool", "b: u8"]


def test_words(spark):
    rows = spark.createDataFrame([("PUBLIC",), ("FRIEND",), ("x",), (None,)], "v string")
    assert [r[0] for r in rows.select(types.word_of(F.col("v"), types.VISIBILITY)).collect()] == ["public", "public(friend)", "unknown", "unknown"]


def test_first_fitting_pattern_wins(spark):
    calls = [("pool", "swap"), ("pool", "swap_a2b"), ("pool", "swapx"), ("pool", "place_market_order"), ("pool", "swa"), ("withdraw", ""), ("pay", "anything"), ("router", "confirm_swap_now"), ("none", "swap"), (None, "swap"), ("coin", None), ("staking_pool", "request_add_stake_2"), ("margin", "é")]
    rows = spark.createDataFrame([(i, 1, "p", m, f) for i, (m, f) in enumerate(calls)], "digest long, ord long, package string, module string, function string")
    want = [next(((a, s) for m, p, a, s in OPERATIONS if m == module and fn is not None and fn.startswith(p)), (None, None)) for module, fn in calls]
    found = rules.match_operations(rows, operation_patterns(spark))
    assert [(r.action, r.skip) for r in found.orderBy("digest").collect()] == want
    assert len(OPERATIONS) == 76
    hidden = spark.createDataFrame([(2, "m", "ab", "late", False), (1, "m", "abc", "first", True), (3, "m", "", "any", False)], "priority int, module string, prefix string, action string, skip boolean")
    rows = spark.createDataFrame([(1, 1, "p", "m", "abcd"), (2, 1, "p", "m", "abd"), (3, 1, "p", "m", "x")], "digest long, ord long, package string, module string, function string")
    assert [r.action for r in rules.match_operations(rows, hidden).orderBy("digest").collect()] == ["first", "late", "any"]


def test_pattern_plan_has_no_range_test(spark):
    rows = spark.createDataFrame([(1, 1, "p", "m", "f")], "digest long, ord long, package string, module string, function string")
    plan = rules.match_operations(rows, operation_patterns(spark))._jdf.queryExecution().executedPlan().toString().lower()
    assert "startswith" not in plan and "nestedloop" not in plan and "cartesian" not in plan
