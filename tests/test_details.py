"""Reports, stories, token lookups, registry records, and plans that are cut in bands and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sablegrid.functions import paths
from sablegrid.operators import aggregate as agg
from sablegrid.operators import cases, flows, market, objects, rules, search

FINDINGS = "id long, case_name string, title string, detail string, confidence string, created_at long, addresses array<string>, evidence array<string>"
LONG = "0x" + "ab" * 20


def test_case_report(spark):
    rows = [(1, "c", "one", "what", "low", 1_706_745_600_000, ["s", LONG], ["tx 1"]), (2, "c", "two", "", None, None, [], []), (3, "c", "three", None, "High", 1_706_749_200_000, [LONG], []), (4, "d", "other", None, None, 0, [], [])]
    f = spark.createDataFrame(rows, FINDINGS)
    said = cases.case_report(f, "c", 1_706_752_800_000)
    assert said == "\n".join([
        "# c", "", "3 findings · 2 addresses · recorded 2024-02-01 00:00 – 2024-02-01 02:00 UTC", "",
        "## three", "", "**Confidence:** High", "", "**Addresses**", "", "- `0xabababab…ababab`", "",
        "## one", "", "**Confidence:** low", "", "what", "", "**Addresses**", "", "- `s`", "- `0xabababab…ababab`", "", "**Evidence**", "", "- tx 1", "",
        "## two", "", "## Appendix: full addresses", "", f"- `{LONG}`", "- `s`", "", "---", "", "_Generated at 2024-02-01 02:00:00 UTC._", "",
    ])
    assert "1 finding · 0 addresses" in cases.case_report(f, "d", 0) and "Appendix" not in cases.case_report(f, "d", 0)
    assert cases.case_report(f, "none", 0) == "# none\n\n_No findings recorded for this case yet._\n"
    assert cases.report_lines(f, 0, appendix=False).where("part = 2").count() == 0


def test_actions_name_their_coins(spark):
    ops = [
        ("swap", "p", ["0x2::a::SUI", "0x3::b::USDC"], "Swap SUI → USDC on P"), ("swap", "q", ["A"], "Swap"), ("flash_loan", "p", ["0x2::a::SUI"], "Flash loan SUI via P"), ("deposit", "q", ["0x2::a::SUI"], "Deposit SUI"),
        ("repay", "p", [], "Repay on P"), ("odd", "p", ["X"], "odd on P"), (None, "p", [], "Call m::f on P"), (None, "0x1234567890abcdef99", [], "Call 0x12345678…ef99::m::f"),
    ]
    rows = spark.createDataFrame([(i, 1, p, "m", "f", a, False, t, "call") for i, (a, p, t, _) in enumerate(ops)] + [(90, 1, None, None, None, None, None, None, "publish"), (90, 2, None, None, None, None, None, None, "split"), (91, 1, "p", "m", "f", "swap", True, [], "call")], "digest long, ord long, package string, module string, function string, action string, skip boolean, type_args array<string>, kind string")
    got = {r.digest: r for r in rules.decode(rows, spark.createDataFrame([("p", "P")], "package string, protocol string")).collect()}
    assert [got[i].actions for i in range(len(ops))] == [o[3] for o in ops]
    assert got[90].actions == "Publish new package" and got[90].protocols == "" and got[91].actions == "" and got[91].protocols == "P"


def test_token_flow_is_the_senders(spark):
    tx = spark.createDataFrame([(1, "a"), (2, None)], "digest long, sender string")
    ch = spark.createDataFrame([(1, 1, "a", "0x2::m::SUI", -5), (1, 2, "b", "X", 5), (1, 3, "a", "Y", 7), (2, 1, "a", "X", 1)], "digest long, ord long, address string, coin string, cents long")
    assert sorted(map(tuple, rules.token_flow(tx, ch).collect())) == [(1, 1, "SUI", -5, "0x2::m::SUI"), (1, 3, "Y", 7, "Y")]


def test_story_of_a_walk(spark):
    walk = spark.createDataFrame([("forward", 1, 1, 1), ("forward", 1, 2, 2), ("backward", 3, 1, 3)], "direction string, seed long, hop long, digest long")
    tx = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", None)], "digest long, sender string, day long")
    ch = spark.createDataFrame([(1, 1, "a", "x::m::S", -2_000_000), (1, 2, "b", "x::m::S", 2_000_000), (1, 3, "c", "fee", 9), (2, 1, "b", "fee", -3)], "digest long, ord long, address string, coin string, cents long")
    de = spark.createDataFrame([(1, "P,Q", "Swap on P"), (2, "Q", "")], "digest long, protocols string, actions string")
    got = {r.seed: r.story for r in flows.trace_story(walk, tx, ch, de).collect()}
    assert got[1] == (
        "FUND TRACE — FORWARD\nStarting tx: 1\nTime span: 1 day across 2 hops\nProtocols: P, Q\n\n--- Hop 1 (day 5) ---\nTx:     1\nSender: a\nAction: Swap on P\nFlows:\n  a: -2000000 S\n  b: 2000000 S\n"
        "\n--- Hop 2 (day 6) ---\nTx:     2\nSender: unknown\nFlows:  gas only\n\nCoins involved: S"
    )
    assert got[3] == "FUND TRACE — BACKWARD\nStarting tx: 3\nHops: 1\n\n--- Hop 1 ---\nTx:     3\nSender: c\n"


def test_tokens(spark):
    t = spark.createDataFrame([("0x1::a::A", "SUI", "Sui coin"), ("0x0::a::B", "sui", "Wrapped"), ("0x2::a::C", "haSUI", "Staked"), ("0x3::a::D", None, "Suite"), ("0x4::a::E", "XYZ", None)], "type string, symbol string, name string")
    asked = spark.createDataFrame([(x,) for x in ("a::b::C", "Sui", "suit", "hasu", "yz", "none", "wrapped")], "term string")
    got = {r.term: (r.type, r.found) for r in search.resolve_tokens(asked, t).collect()}
    assert got == {"a::b::C": ("a::b::C", "literal"), "Sui": ("0x0::a::B", "symbol"), "suit": ("0x3::a::D", "part"), "hasu": ("0x2::a::C", "part"), "yz": ("0x4::a::E", "part"), "none": (None, None), "wrapped": ("0x0::a::B", "part")}


def test_registry_records_and_structs(spark):
    reg = spark.createDataFrame([("@o/a", 1, "0xa1", "d1"), ("@o/a", 2, "0xa2", "d2"), ("@o/b", 1, "0xb1", None)], "name string, version long, package string, description string")
    asked = spark.createDataFrame([(x,) for x in ("@o/a", "@o/a/1", "@o/a/9", "@o/c", "@o/b")], "name string")
    assert {r.name: (r.version, r.package, r.description) for r in search.package_info(asked, reg).collect()} == {"@o/a": (2, "0xa2", "d2"), "@o/a/1": (1, "0xa1", "d1"), "@o/a/9": (None, None, None), "@o/c": (None, None, None), "@o/b": (1, "0xb1", None)}
    st = spark.createDataFrame([("0xa1", "m", "T", "0xa1"), ("0xa2", "m", "T", "0xa1"), ("0xa2", "m", "U", "0xa2")], "package string, module string, type string, defined_in string")
    asked = spark.createDataFrame([(x,) for x in ("@o/a::m::T", "@o/a/1::m::U", "@o/a::m::U", "@o/c::m::T", "@o/a")], "path string")
    assert dict(search.resolve_structs(asked, reg, st).collect()) == {"@o/a::m::T": "0xa1::m::T", "@o/a/1::m::U": None, "@o/a::m::U": "0xa2::m::U", "@o/c::m::T": None, "@o/a": None}


def test_one_exclusive_filter(spark):
    tx = spark.createDataFrame([(1, "a", 1)], "digest long, sender string, day long")
    none = tx.limit(0)
    for more in ({"affected": "a", "object_id": "o"}, {"function": "f", "object_id": "o"}, {"affected": "a", "function": "f"}, {"object_id": "o"}):
        with pytest.raises(ValueError):
            search.scan_transactions(tx, none, none, **more)
    got = search.sponsored(spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", None), (4, None, "b")], "d long, sender string, sponsor string"))
    assert [r.gas_sponsored for r in got.orderBy("d").collect()] == [True, False, False, True]


def test_number_paths(spark):
    deep = "1"
    for _ in range(60):
        deep = '{"k": %s}' % deep
    rows = [deep, '{"a.b": {"c\\"d": 2}, "a.b": 1}', '{"x": "1e400", "y": " 7 ", "z": "", "n": null, "t": true, "l": [{"q": 1}, 2], "m": {"o": -0.5}}', "[1]", "7", None, "{", '{"a": "0x10", "b": NaN}', "{}"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, p string")
    got = [r.f for r in df.select("id", paths.numeric_paths(F.col("p")).alias("f")).orderBy("id").collect()]
    assert got == [[".".join(["k"] * 60)], ["a.b", 'a.b.c"d'], ["m.o", "y"], [], [], [], [], [], []]


def test_ranges_follow_the_values(spark):
    rng = random.Random(2)
    values = sorted({0, 1, -1, 255, 256, 257, 2**53, 2**63 - 1, -(2**63), *(rng.randrange(-(2**k), 2**k) for k in range(1, 63) for _ in range(30))})
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("r", agg.value_range(F.col("v")).cast("long"))
    found = [r.r for r in df.orderBy("v").collect()]
    assert found == sorted(found) and len(set(found)) > 1000
    tail = spark.createDataFrame([(v,) for v in [*range(10_000), 10**15]], "v long").withColumn("r", agg.value_range(F.col("v")).cast("long"))
    assert tail.groupBy("r").count().agg(F.max("count")).first()[0] < 100  # one outlier leaves the others apart


def test_budget_in_bands_is_that_of_one_pass(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(9)) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, i long, size long")
    want = []
    for k in range(3):
        used = 0
        for _, i, s in (r for r in rows if r[0] == k):
            used += s
            if used <= 300:
                want.append((k, i, s, used))
    for width in (1, 7, 1000):
        assert sorted(map(tuple, objects.within_budget(df, ["k"], [F.asc("i")], "size", 300, F.floor(F.col("i") / width)).collect())) == want


def test_mean_falls_back_to_unweighted(spark):
    of = lambda *rows: market.deviation_summary(spark.createDataFrame(rows, "open_at long, deviation long, volume long"), 10).first().mean
    assert of((1, 10, 3), (2, -5, 1)) == 6 and of((1, 10, 0), (2, -5, 0)) == 3 and of((1, -10, 0), (2, 5, 0)) == -3 and of((1, None, 4)) is None
