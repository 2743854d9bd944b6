"""Fan-out of a few addresses and from sketches, cursors over two phases, label files."""

import base64
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from sablegrid.operators import cursors, flows, sketches
from sablegrid.sources import labels
from sablegrid.sources import shared
from sablegrid.sources.shared import written

CHANGES = "digest long, day long, ord long, sender string, address string, coin string, cents long"


def ledger(spark, n=600, people=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        a, b = rng.randrange(people), rng.randrange(people)
        a, b = (0, b) if rng.random() < 0.4 else (a, b)  # one address has many
        coin, cents = rng.choice("xyz"), rng.randrange(1, 99)
        rows += [(d, d // 20, 1, f"a{a}", f"a{a}", coin, -cents), (d, d // 20, 2, f"a{a}", f"a{b}", coin, cents)]
    return written(spark.createDataFrame(rows, CHANGES), "changes")


def by_address(df, *columns):
    return {r.address: tuple(r[c] for c in columns) for r in df.collect()}


COUNTS = ("recipient_count", "sender_count", "counterparty_count", "coin_type_count", "scanned")


def test_fanout_of_a_few_is_that_of_all(spark):
    changes = ledger(spark)
    every = by_address(flows.fanout(changes, 30), *COUNTS, "truncated", "classification")
    few = by_address(flows.fanout(changes, 30, of=["a0", "a3", "none"]), *COUNTS, "truncated", "classification")
    assert few == {a: every[a] for a in ("a0", "a3")} and every["a0"][5] and every["a0"][4] == 30
    whole = by_address(flows.fanout(changes, None), *COUNTS, "truncated")
    assert whole["a0"][4] > 200 and not whole["a0"][5] and whole.keys() == every.keys()


def test_fanout_of_a_few_filters_the_scan(spark):
    plan = flows.fanout(ledger(spark), None, of=["a0", "a3"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(address, [a0,a3])" in plan.replace("IsNotNull(address), ", "") or "In(address, [a0,a3])" in plan


def test_shared_fanout_takes_the_top(spark):
    shared = spark.createDataFrame([(f, f"s{i}", n) for f, n in (("a0", 5), ("a1", 9), ("a2", 5), ("a9", 2)) for i in range(n)], "funder string, address string, funded_count long")
    got = by_address(flows.shared_fanout(shared, ledger(spark), top=3), "place", "funded_count")
    assert got == {"a1": (1, 9), "a0": (2, 5), "a2": (3, 5)}
    assert flows.shared_fanout(shared.limit(0), ledger(spark)).count() == 0


def test_sketches_of_days_merge_to_the_whole(spark):
    changes = ledger(spark)
    exact = by_address(flows.fanout(changes, None), *COUNTS)
    late, early = (sketches.day_sketches(changes.where(t)) for t in ("day >= 13", "day < 13"))
    both = by_address(sketches.merged(late.unionByName(early), F.lit(0), 10**9), *COUNTS)
    assert both == exact  # so few are counted exactly
    assert by_address(sketches.merged(sketches.day_sketches(changes), F.lit(0), 10**9), *COUNTS) == exact


def test_sketches_of_many_are_near(spark):
    rows = spark.range(60_000).selectExpr("id as digest", "id div 6000 as day", "1 as ord", "'hub' as address", "'c' as coin", "-1 as cents")
    rows = rows.unionByName(rows.selectExpr("digest", "day", "2 as ord", "concat('r', digest div 2) as address", "'c' as coin", "1 as cents"))
    got = sketches.merged(sketches.day_sketches(rows), F.lit(0), 10**9).where("address = 'hub'").first()
    assert abs(got.recipient_count / 30_000 - 1) < 0.04 and got.sender_count == 0 and got.scanned == 60_000


def test_old_days_and_methods_are_left_out(spark):
    changes = ledger(spark)
    cache = sketches.day_sketches(changes, method=F.when(F.col("day") == 25, 1).otherwise(2))
    got = by_address(sketches.merged(cache, F.lit(29 * 86_400)), "scanned")
    want = by_address(flows.fanout(changes.where("day >= 22 and day <> 25"), None), "scanned")
    assert got == want


@pytest.fixture
def shop(spark):
    rng = random.Random(4)
    items = [(f"k{rng.randrange(6)}", f"i{n:03d}") for n in range(150)]
    direct = [(f"o{n % 2}", f"d{n:02d}") for n in range(40)]
    caps = [("o0", f"k{k}") for k in (4, 1, 2, 1)] + [("o1", "k0"), ("o2", "k9")]
    tables = spark.createDataFrame(items, "kiosk string, id string"), spark.createDataFrame(direct, "owner string, id string"), spark.createDataFrame(caps, "owner string, kiosk string")
    whole = [(0, k, i) for k in ("k1", "k2", "k4") for kk, i in sorted(items) if kk == k] + [(1, None, i) for o, i in direct if o == "o0"]
    return tables, whole


@pytest.mark.parametrize("limit", [7, 50, 1000])
def test_pages_chained_are_the_whole_list(shop, limit):
    tables, whole = shop
    got, token, pages = [], None, 0
    while pages == 0 or token:
        rows, token = cursors.page(*tables, "o0", token, limit)
        got += [(r.phase, r.kiosk, r.id) for r in rows.collect()]
        pages += 1
    assert got == whole and pages == -(-len(whole) // limit)


def test_cursor_keeps_the_shops_of_the_first_page(spark, shop):
    (items, direct, caps), whole = shop
    rows, token = cursors.page(items, direct, caps, "o0", None, 5)
    more = caps.unionByName(spark.createDataFrame([("o0", "k0")], "owner string, kiosk string"))
    gone = items.where("kiosk <> 'k2'")
    rest, end = cursors.page(gone, direct, more, "o0", token, 1000)
    assert end is None and [(r.phase, r.kiosk, r.id) for r in rest.collect()] == [r for r in whole[5:] if r[1] != "k2"]


def test_cursor_is_pushed_to_the_scans(shop):
    (items, direct, _), _ = shop
    plan = cursors.remaining(written(items, "items"), written(direct, "direct"), "o0", cursors.Cursor(("k1", "k2", "k4"), 1, "i050", "d10"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(kiosk, [k2,k4])" in plan and "GreaterThan(id,i050)" in plan and "EqualTo(owner,o0)" in plan and "GreaterThan(id,d10)" in plan


def test_bad_tokens_are_errors():
    good = cursors.Cursor(("k", "é"), 1, "x", None)
    assert cursors.decode(cursors.encode(good)) == good
    said = {"v": 1, "kiosks": ["k"], "ki": 0, "kc": None, "dc": None}
    bad = [said | {"v": 2}, said | {"kiosks": "k"}, said | {"kiosks": [1]}, said | {"ki": 2}, said | {"ki": -1}, said | {"ki": "0"}, said | {"ki": True}, said | {"kc": 3}, {}, [1], None, "x"]
    for token in ["", "§", "abc", "a" * 50, *(base64.urlsafe_b64encode(json.dumps(x).encode()).decode() for x in bad)]:
        with pytest.raises(ValueError, match="invalid cursor"):
            cursors.decode(token)


LINES = [
    '{"address": " 0xAB1 ", "label": "one", "category": "cex", "notes": "n"}', '{"address": "0xab2", "label": 7, "category": "cex"}', '{"address": "0xab3", "label": "three"}',
    '{"address": "0xab4", "label": "four", "category": "odd", "source": "desk", "extra": [1]}', '{"address": "0xab5", "lab', "not json", "", '{"label": "no address", "category": "cex"}', '{"address": "0xAB1", "label": "zzz", "category": "cex"}',
]
FULL = lambda x: "0x" + x.rjust(64, "0")
WANT = [(FULL("ab1"), "one", "cex", "override", None, "n"), (FULL("ab4"), "four", "odd", "desk", None, None)]


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES))
    assert sorted(map(tuple, labels.read_labels(spark, str(tmp_path)).collect())) == WANT
    rows, broken = labels.label_files(spark, str(tmp_path))
    assert sorted(r.record for r in broken.collect()) == sorted([LINES[4], LINES[5]])


def test_label_object(spark, tmp_path):
    good = {"labels": {"0xAB1": {"label": "one", "category": "cex", "notes": "n"}, "0xab2": None, "0xab3": {"label": "x", "category": 3}, "0xab4": {"label": "four", "category": "odd", "source": "desk"}}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text('{"labels": {"0x1": ')
    (tmp_path / "c.json").write_text('{"other": 1}')
    assert sorted(map(tuple, labels.read_labels(spark, str(tmp_path), lines=False).collect())) == WANT
    assert labels.label_files(spark, str(tmp_path), lines=False)[1].count() == 1


def test_missing_and_broken_files_are_not_fatal(spark, tmp_path, caplog):
    assert labels.read_labels(spark, f"{tmp_path}/none").count() == 0 and "no label file" in caplog.text
    assert labels.label_files(spark, f"{tmp_path}/none")[1].count() == 0
    cut = gzip.compress("\n".join(LINES * 2000).encode())[:200]
    (tmp_path / "bad.json.gz").write_bytes(cut)
    (tmp_path / "good.json").write_text("\n".join(LINES))
    assert {WANT[0][0], WANT[1][0]} <= {r.address for r in labels.read_labels(spark, str(tmp_path)).collect()}


def test_files_win(spark):
    of = lambda *x: spark.createDataFrame(x, "address string, label string")
    assert sorted(map(tuple, labels.overridden(of(("a", "1"), ("b", "2")), of(("b", "3"), ("c", "4"))).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]


def test_written_tables_are_swept(spark, monkeypatch):
    monkeypatch.setattr(shared, "_kept", [])
    table = written(spark.range(5), "gone")
    (path,) = shared._kept
    assert table.count() == 5 and shared.sweep(spark) == 1 and shared.sweep(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
