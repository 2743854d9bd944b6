"""Edge rows that the given tables lack."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sablegrid.functions import scalars as sc
from sablegrid.operators import aggregate as agg
from sablegrid.operators import cases, flows, market, rules, search, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_groups_with_missing_keys_values_and_scale(spark):
    e = spark.createDataFrame([("a", 5), ("a", None), ("b", None), ("", 9), (None, 9)], "sender string, cents long")
    g = agg.group_events(e, "sender", F.col("cents"))
    assert rows(g, "key") == [("a", 2, 5, 1), ("b", 1, 0, 1)]
    assert rows(agg.group_events(e, "sender", F.col("cents"), scale=0), "key") == rows(g, "key")
    assert rows(agg.group_events(e, "sender", F.col("cents"), scale=10), "key")[0][2] == 0.5
    assert rows(agg.group_events(e, "sender"), "key") == [("a", 2, None, 2), ("b", 1, None, 1)]
    assert rows(agg.totals(e, "sender", budget=4)) == [(2, 5, 2, True)] and rows(agg.totals(e, "sender", budget=5))[0][3] is False
    assert agg.group_events(e.limit(0), "sender", F.col("cents")).count() == 0


def test_ranking_ties(spark):
    g = spark.createDataFrame([("c", 1, 5), ("a", 2, 5), ("b", 2, 5), ("d", 9, 1)], "key string, event_count long, value_sum long")
    assert [r[0] for r in rows(agg.rank_groups(g))] == ["a", "b", "c", "d"]
    assert [r[0] for r in rows(agg.rank_groups(g, ascending=True))] == ["d", "c", "a", "b"]


@pytest.mark.parametrize("n", [0, 1, 2, 10, 20, 60, 100])
def test_nearest_rank(spark, n):
    random.seed(n)
    values = [random.randint(-5, 1000) ** 2 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    (got,) = rows(agg.percentiles(df, "v", agg.RANKS))
    s = sorted(values)
    want = (s[0], *[s[max(1, math.ceil(p / 100 * n)) - 1] for p in (25, 50, 75, 95)], s[-1], sum(s)) if n else (None,) * 7
    assert got == want


def test_numeric_text(spark):
    cases_ = {'"1250"': 1250.0, '" 5 "': 5.0, '""': None, '"abc"': None, '"5d"': None, '"1e3"': 1000.0, '"NaN"': None, '"Infinity"': None, "true": None, "null": None, "{}": None, "[1]": None, "7": 7.0, "-0.5": -0.5, '"1e999"': None}
    df = spark.createDataFrame([('{"a": {"b": %s}}' % k,) for k in cases_] + [("{}",), ('{"a": 5}',), ("not json",), (None,)], "p string")
    assert [r[0] for r in df.select(sc.numeric_path(F.col("p"), "a.b")).collect()] == [*cases_.values(), None, None, None, None]


def test_amounts_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(sc.normalize_address(lit(" 0X2 "))) == "0x" + "2".zfill(64)
    assert one(sc.coin_symbol(lit("0x2::abc::ABC"))) == "ABC" and one(sc.coin_symbol(lit("a::b"))) == "a::b"
    assert one(sc.coin_decimals(lit("x::y::USDC"))) == 6 and one(sc.coin_decimals(lit("z"))) == 9
    assert one(sc.usd_value(lit(-5_000_000), lit(6), lit(2.0))) == 10.0 and one(sc.usd_value(lit(5), lit(6), lit(float("nan")))) == 0.0
    assert [one(sc.format_usd(lit(x))) for x in (0.0, 0.001, 1.5, 4200.0, 3.1e6, 1.2e9)] == ["$0", "<$0.01", "$1.50", "$4.2K", "$3.1M", "$1.2B"]
    assert [one(sc.format_amount(lit(x), 9)) for x in (1_500_000_000, -1, 2_000_000_000)] == ["1.5", "-0.000000001", "2"] and one(sc.format_amount(lit(7), None)) == "7"
    assert [one(sc.format_duration(lit(x))) for x in (30, 60, 7200, 90_000)] == ["<1 minute", "1 minute", "2 hours", "1 day"]
    assert one(sc.oracle_price(lit(12345), lit(-2))) == pytest.approx(123.45)


C = "digest long, day long, ord long, sender string, address string, coin string, cents long"


def test_funding_edge_cases(spark):
    c = [(1, 1, 1, "A", "A", "x", -5), (1, 1, 2, "A", "B", "x", 5), (2, 2, 1, "M", "D", "x", 7), (3, 3, 1, None, "E", "x", 7), (4, 4, 1, "F", "F", "x", 9), (5, 5, 1, "G", "G", "x", -1), (5, 5, 2, "G", "H", "y", 3), (5, 5, 3, "G", "I", "x", -9), (5, 5, 4, "G", "J", "x", -9)]
    c += [(100 + i, 50 + i, 1, "K", "K", "x", -1) for i in range(12)] + [(200, 99, 1, "A", "K", "x", 5), (200, 99, 2, "A", "A", "x", -5)]
    got = {r.address: (r.digest, r.amount_cents, r.funder) for r in flows.funding_edges(spark.createDataFrame(c, C)).collect()}
    assert got == {"B": (1, 5, "A"), "D": (2, 7, "M"), "E": (3, 7, "unknown"), "F": (4, 9, "F"), "H": (5, 3, "I")}  # K: over twelve before the first gain


def test_walk_stops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "L"), ("L", "z"), ("d", "unknown"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]], "address string, funder string")
    labels = spark.createDataFrame([("L", "other")], "address string, category string")
    seeds = spark.createDataFrame([(s,) for s in ("a", "c", "d", "z", "n0", "n5", "n4")], "address string")
    got = {r.address: (r.origin, r.hops, r.stop_reason_code) for r in flows.funding_steps(e, labels, seeds, 5).collect()}
    assert got == {"a": ("a", 2, "cycle"), "c": ("L", 1, "labeled"), "d": ("unknown", 1, "unknown"), "z": ("z", 0, "dead_end"), "n0": ("n5", 5, "max_hops"), "n5": ("n9", 4, "dead_end"), "n4": ("n9", 5, "max_hops")}


def test_trace_edges_and_stops(spark):
    tx = spark.createDataFrame([(1, "A", 1), (2, "A", 1), (3, "A", 2), (4, "A", 3), (5, None, 4)], "digest long, sender string, day long")
    c = spark.createDataFrame([(1, 1, 1, "A", "P", "x", 3), (1, 1, 2, "A", "B", "x", 2), (2, 1, 1, "A", "P", "x", 3), (3, 2, 1, "A", "A", "y", 4), (3, 2, 2, "A", "A", "x", 4), (4, 3, 1, "A", "A", "x", -4), (5, 4, 1, None, "B", "x", 1)], C)
    swaps, passing = spark.createDataFrame([(3,)], "digest long"), spark.createDataFrame([("P",)], "address string")
    edges = flows.trace_edges(tx, c, swaps, passing)
    got = {r.digest: (r.next_address, r.next_coin, r.rule) for r in edges.collect()}
    assert got == {1: ("B", None, "recipient"), 2: ("P", None, "pool_fallback"), 3: ("A", "x", "swap"), 4: (None, None, "stop"), 5: ("B", None, "recipient")}
    walk = flows.trace_walk(edges, flows.neighbours(c), spark.createDataFrame([("P",)], "address string"), spark.createDataFrame([(1,), (2,), (3,)], "digest long"), ("forward",), max_hops=3)
    assert rows(walk.select("seed", "hop", "digest", "stop"), "seed", "hop") == [(1, 1, 1, "none"), (1, 2, 5, "no_tx"), (2, 1, 2, "sink"), (3, 1, 3, "none"), (3, 2, 4, "no_next")]


def test_fanout_shapes(spark):
    c = [(i, i, 1, "A", "A", "x", -1) for i in range(1000)] + [(i, i, 2, "A", f"r{i}", "x", 1) for i in range(1000)]
    c += [(2000, 5, 1, "Q", "Q", "x", 1), (2000, 5, 2, "Q", "s", "y", -1), (2000, 5, 3, "Q", "Q", "z", -9)]
    got = {r.address: r for r in flows.fanout(spark.createDataFrame(c, C), latest=1000).where("address in ('A', 'Q')").collect()}
    assert (got["A"].recipient_count, got["A"].out_in_ratio, got["A"].flow_shape, got["A"].classification, got["A"].truncated) == (1000, None, "unknown", "hub", False)
    assert (got["Q"].sender_count, got["Q"].coin_type_count, got["Q"].flow_shape, got["Q"].classification) == (1, 3, "collector", "narrow")
    cut = flows.fanout(spark.createDataFrame(c, C), latest=99).where("address = 'A'").first()
    assert (cut.counterparty_count, cut.scanned, cut.truncated, cut.classification) == (99, 99, True, "narrow")


def test_timeline_bounds_and_nulls(spark):
    tx = spark.createDataFrame([(1, "A", None), (2, "A", 5), (3, "B", 1)], "digest long, sender string, day long")
    c = spark.createDataFrame([(3, 1, 1, "B", "A", "x", 1), (2, 5, 1, "A", "C", "x", 1)], C)
    t = spark.createDataFrame([("A",), ("C",)], "address string")
    assert rows(flows.timeline(tx, c, t)) == [(3, 1, "A"), (2, 5, "A,C"), (1, None, "A")]
    assert [r[0] for r in rows(flows.timeline(tx, c, t, first=F.lit(1)))] == [3, 2]


def test_holders_without_supply(spark):
    c = spark.createDataFrame([(1, 1, 1, "A", "b", "x", 5), (1, 1, 2, "A", "a", "x", 5), (1, 1, 3, "A", "c", "x", -5)], C)
    assert rows(flows.holders(c, "x"), "rank") == [(1, "a", 5, 1, 500_000), (2, "b", 5, 1, 500_000)]
    assert rows(flows.holders(c, "x", supply=F.lit(0)), "rank")[0][4] is None and flows.holders(c, "none").count() == 0


def test_as_of_spans_and_ties(spark):
    r = spark.createDataFrame([("k", 5), ("k", 10), ("k", 999), ("k", 1), ("n", 5)], "key string, at long")
    s = spark.createDataFrame([("k", 5, 1), ("k", 8, 2), ("k", 11, 3)], "key string, t long, price long")
    for span in (3, 100):
        got = windows.as_of(r, s, ["key"], "at", "t", ["price"], span=span)
        assert rows(got, "key", "at") == [("k", 1, None, None), ("k", 5, 5, 1), ("k", 10, 8, 2), ("k", 999, 11, 3), ("n", 5, None, None)]


def test_owner_changes_across_spans(spark):
    random.seed(2)
    made = [(o, v, random.choice("abc")) for o in "xyz" for v in random.sample(range(60), 25)] + [("one", 7, "a"), ("null", 1, None), ("null", 2, "a")]
    df = spark.createDataFrame(made, "object string, version long, owner string")
    want = []
    for o in {m[0] for m in made}:
        own = sorted((v, w) for x, v, w in made if x == o)
        want += [(o, a[1], b[1], b[0]) for a, b in zip(own, own[1:]) if a[1] is not None and a[1] != b[1]]
    for span in (1, 4, 1000):
        assert rows(windows.transitions(df, span=span), "object", "at_version") == sorted(want, key=lambda r: (r[0], r[3]))


def test_running_sums_in_bands(spark):
    random.seed(3)
    made = [(k, i, random.choice((1, 2, 3, 7, 8, 500, 501, 40_000))) for k in "ab" for i in range(80)] + [("c", 0, 10)]
    df = spark.createDataFrame(made, "k string, id long, n long")
    for target in (0, 1, 9, 40_000, 100_000, 10**9):
        want = []
        for k in "abc":
            total = 0
            for _, i, n in sorted((m for m in made if m[0] == k), key=lambda m: (-m[2], m[1])):
                if total < target:
                    total += n
                    want.append((k, i, n, total))
        got = windows.select_until(df, ["k"], "n", F.lit(target), [F.desc("n"), F.asc("id")], F.floor(-8 * F.log2("n")))
        assert rows(got, "k", "id") == sorted(want)


def test_names_by_parts(spark):
    names = spark.createDataFrame([(1, "Abc"), (2, "xabcx"), (3, "q"), (4, "zz"), (5, None), (6, "bcbcd")], "id long, name string")
    asked = spark.createDataFrame([(t,) for t in ("ABC", "bcx", "BcD", "z", "q", "none", "bcbcdz", "bcx")], "term string")
    got = rows(search.resolve_names(asked, names), "term")
    assert got == [("ABC", 1, "Abc", 0), ("BcD", 6, "bcbcd", 1), ("bcbcdz", None, None, None), ("bcx", 2, "xabcx", 1), ("bcx", 2, "xabcx", 1), ("none", None, None, None), ("q", 3, "q", 0), ("z", 4, "zz", 1)]


def test_one_sided_book_and_no_oracle(spark):
    b = spark.createDataFrame([("p", "bid", 10, 3)], "pair string, side string, price long, qty long")
    r = market.book_summary(b, ["pair"]).first()
    assert (r.best_bid, r.best_ask, r.spread, r.bid_depth, r.ask_depth, r.imbalance_ppm) == (10, None, None, 3, 0, 1_000_000)
    bars = spark.createDataFrame([(0, 7200, 110, 2), (0, 3600, 5, 1), (0, 0, 5, 1)], "pair int, open_at long, close long, volume long")
    oracle = spark.createDataFrame([(0, 100, 0), (0, 4000, 100)], "pair int, sample_at_s long, oracle long")
    d = market.deviations(bars, oracle, ["pair"])
    assert rows(d.select("open_at", "oracle", "deviation"), "open_at") == [(0, None, None), (3600, 0, None), (7200, 100, 100_000)]
    assert rows(market.deviation_summary(d, 100_000)) == [(1, 200_000, 2, 100_000, 100_000, 7200, 1)]


def test_trades_count_once(spark):
    t = spark.createDataFrame([(1, "a", "a", 5), (1, "a", "a", 5), (2, "a", "b", 7)], "digest long, maker string, taker string, v long")
    assert rows(market.participation(t, ["maker", "taker"], "digest", "v"), "address") == [("a", 2, 12), ("b", 1, 7)]


def test_diffs(spark):
    m = lambda *x: spark.createDataFrame([(1, *r) for r in x], "k long, module string, text string")
    got = rows(rules.module_diff(m(("a", "x\r\ny"), ("b", ""), ("c", "1")), m(("a", "x  \ny"), ("b", "z"), ("d", "1")), ["k"]), "module")
    assert [(r[1], r[2]) for r in got] == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")]
    lines = lambda *x: spark.createDataFrame([(1, s) for s in x], "k long, line string")
    assert rows(rules.line_delta(lines("a", "a", "b\r"), lines("a", "b", "c "), ["k"])) == [(1, 1, 1)]


def test_anomaly_rules(spark):
    c = [(1, 1, "0x0002", "m", "f", "call"), (2, 1, "0x9", "m", "my_borrow_x", "call"), (2, 2, "0x9", "m", "repay", "call"), (3, 1, "k1", "m", "borrower", "call"), (4, 1, None, "", "", "upgrade"), (5, 1, "k1", "m", "FlashIt", "call")]
    c += [(6, i, f"p{i}", "m", "f", "call") for i in range(4)]
    got = rules.anomalies(spark.createDataFrame(c, "digest long, ord long, package string, module string, function string, kind string"), spark.createDataFrame([("k1", "K")], "package string, protocol string"))
    assert sorted((r.digest, r.code) for r in got.collect()) == [(2, "flashloan-pattern"), (2, "unverified-package-call"), (4, "publishes-or-upgrades"), (5, "flashloan-pattern"), (6, "multi-package-composition"), (6, "unverified-package-call")]


def test_cases_and_labels(spark):
    f = spark.createDataFrame([(1, "c", 5, "low", "t1"), (2, "c", 9, "high", "t2"), (3, "c", 1, None, "t3"), (4, "c", 1, "high", "t4")], "id long, case_name string, created_at long, confidence string, title string")
    assert [r.id for r in cases.case_order(f).orderBy("position").collect()] == [4, 2, 1, 3]
    raw = spark.createDataFrame([("0x2", "x", "cex"), ("0x2", "x", "nope"), (None, "x", "cex")], "address string, label string, category string")
    assert sorted((r.accepted, r.address) for r in cases.import_labels(raw).where("accepted or category = 'nope'").collect()) == [(False, "0x2"), (True, "0x" + "2".zfill(64))]
    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, None)], "address string, at long, deleted boolean")
    assert [r.address for r in cases.latest(log, "address", "at").collect()] == ["b"]


def test_activity_keeps_rows_without_a_mark(spark):
    r = spark.createDataFrame([(1, None), (2, 2**53 + 1), (3, 2**53)], "id long, v long")
    assert [x.id for x in search.activity_since(r, F.col("v"), 2**53).orderBy("id").collect()] == [1, 2]


def test_exclusive_filters(spark):
    with pytest.raises(ValueError):
        search.scan_transactions(spark.range(1), None, None, affected="a", function="b")
