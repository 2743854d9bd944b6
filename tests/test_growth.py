"""Steps whose cost may grow no faster than their rows."""

import datetime as dt
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from sablegrid.operators import diffs, flows, rules, windows
from sablegrid.plans import catalog
from sablegrid.sources import shared
from sablegrid.sources.ledger import Ledger
from sablegrid.streaming import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_checkpoint_reads_each_frame_once(spark):
    rnd, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=rnd.choice((rnd.random(), 40 + rnd.random())) * 3600), n) for n in range(300)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, seq long")
    first = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) - 7200
    asked = list(range(first, first + 48 * 3600, 1777))
    got = windows.nearest_checkpoint(events, spark.createDataFrame([(t,) for t in asked], "target long"))
    assert "unboundedfollowing" not in plan(got).lower()  # such a frame is read anew for each of its rows
    us = lambda t: round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    near = {t: min((abs(us(ts) - t * 1_000_000), us(ts), n) for ts, n in rows)[2] for t in asked}
    assert {r.target: r.seq for r in got.collect()} == near


CHANGES = "digest long, day long, ord long, sender string, address string, coin string, cents long"


def test_fanout_counts_without_expanding_rows(spark):
    rnd = random.Random(5)
    rows = [(d, d % 9, o, "a0", f"a{rnd.randrange(12)}", f"c{rnd.randrange(3)}", rnd.choice((-5, 0, 7))) for d in range(200) for o in range(rnd.randrange(1, 7))]
    changes = spark.createDataFrame(rows, CHANGES)
    got = flows.fanout(changes, 20)
    assert "Expand" not in plan(got)  # a distinct count beside others copies each row for each of them
    own, days = {}, {}
    for d, day, o, _, a, _, cents in sorted(rows, key=lambda r: r[2]):
        own.setdefault((a, d), cents)
        days[a, d] = day
    for r in got.collect():
        last = sorted(((days[k], k[1]) for k in own if k[0] == r.address), reverse=True)
        kept = {d for _, d in last[:20]}
        met = [(x[4], x[6], own[r.address, x[0]], x[5]) for x in rows if x[0] in kept]
        pays = {a for a, c, o, _ in met if a != r.address and o < 0 < c}
        takes = {a for a, c, o, _ in met if a != r.address and c < 0 < o}
        assert (r.recipient_count, r.sender_count, r.counterparty_count, r.coin_type_count) == (len(pays), len(takes), len(pays | takes), len({c for *_, c in met}))
        assert (r.scanned, r.truncated) == (len(kept), len(last) > 20)


def test_lines_of_a_transaction_move_once(spark, sf):
    edges = flows.funding_edges(Ledger(spark, sf).changes())
    assert plan(edges).count("Exchange hashpartitioning(digest") == 0  # what is told of a transaction is told where its lines are


def test_tasks_follow_the_table(spark, sf, monkeypatch):
    table = Ledger(spark, sf).table("lineitem")
    before = shared.tasks(table)
    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 14)
    assert before == 8 < shared.tasks(table)
    assert "hashpartitioning(l_orderkey#" in plan(Ledger(spark, sf).changes()) and f", {shared.tasks(table)})" in plan(Ledger(spark, sf).changes())
    assert shared.tasks(spark.createDataFrame([(1,)], "a long")) == 8  # a size that is not known


class Store:
    """State of one object that counts the calls to it."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], set()

    def called(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, *_):
        return type("Value", (), {"get": lambda s: self.called(self.value), "exists": lambda s: self.called(self.value is not None), "update": lambda s, v: self.called(setattr(self, "value", v))})()

    def getListState(self, *_):
        return type("List", (), {"get": lambda s: self.called(iter(list(self.rows))), "appendValue": lambda s, v: self.called(self.rows.append(v)), "clear": lambda s: self.called(self.rows.clear())})()

    def getMapState(self, *_):
        held = self.rows = {}
        return type("Map", (), {"updateValue": lambda s, k, v: self.called(held.update({k: v})), "iterator": lambda s: self.called(iter(list(held.items()))), "removeKey": lambda s, k: self.called(held.pop(k))})()

    def listTimers(self):
        return self.called(list(self.timers))

    def registerTimer(self, ms):
        self.called(self.timers.add(ms))

    def deleteTimer(self, ms):
        self.called(self.timers.discard(ms))


def test_owner_changes_call_the_store_once_a_frame():
    def run(n, late=()):
        store, p = Store(), keyed.OwnerChanges()
        p.init(store)
        frame = pd.DataFrame({"version": range(n), "owner": ["ab"[v // 2 % 2] for v in range(n)], "ms": range(n)})
        list(p.handleInputRows((7,), iter([frame]), None))
        for more in late:
            list(p.handleInputRows((7,), iter([more]), None))
        store.timers.clear()  # the one that fires
        out = pd.concat(p.handleExpiredTimer((7,), type("T", (), {"getCurrentWatermarkInMs": lambda s: n // 2})(), None))
        return store, out

    few, _ = run(20)
    many, out = run(2000)
    assert many.calls == few.calls  # a message for each row would be most of the work
    assert out["at_version"].tolist() == list(range(2, 1001, 2)) and many.timers == {1001}
    again = pd.DataFrame({"version": [3, 2500], "owner": ["z", "a"], "ms": [3, 2500]})
    store, out = run(2000, [again])
    assert out["at_version"].tolist()[:3] == [2, 3, 4] and out["to_owner"].tolist()[:3] == ["b", "z", "a"]  # what came last of a version counts
    assert sum(len(r[0]) for r in store.rows) == 1000


def test_types_are_read_in_more_tasks_than_files(spark, sf):
    for name in ("type_text", "datatype_fields"):
        assert "hashpartitioning(p_partkey#" in plan(catalog.QUERIES[name](spark, sf))  # a small file is one task, and a type is much work


def test_funding_walks_read_changes_once(spark, sf, monkeypatch):
    asked, changes = [], Ledger.changes
    monkeypatch.setattr(Ledger, "changes", lambda l: asked.append(1) or changes(l))
    walks = catalog.QUERIES["funding_walk"](spark, sf)
    assert len(asked) == 1 and walks.count() == changes(Ledger(spark, sf)).select("address").distinct().count()


def test_first_rows_are_dealt_to_the_tasks_that_are_asked_for(spark, sf, monkeypatch):
    rnd = random.Random(7)
    rows = [(rnd.choice(("hot", "hot", "hot", f"k{rnd.randrange(40)}", None)), rnd.randrange(300), n) for n in range(3000)]
    table = spark.createDataFrame(rows, "k string, at long, n long")
    got = windows.first_rows(table, ["k"], [F.desc("at"), F.desc("n")], 5, 11)
    assert plan(got).count(", 11)") == 2 and "_part" in plan(got)
    want = {k: sorted(((a, n) for x, a, n in rows if x == k), reverse=True)[:5] for k in {r[0] for r in rows}}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, *r) for k, found in want.items() for r in found), key=str)
    monkeypatch.setattr(shared, "TASK_BYTES", 1 << 14)
    owners = shared.tasks(Ledger(spark, sf).table("lineitem"))
    for name in ("earliest_n", "latest_n"):
        assert re.search(rf"hashpartitioning\(address#\d+, {owners}\)", plan(catalog.QUERIES[name](spark, sf)))


def test_hubs_count_no_coins(spark, sf, monkeypatch):
    asked, meetings = [], flows.meetings
    monkeypatch.setattr(flows, "meetings", lambda *a: asked.append(meetings(*a)) or asked[-1])
    found = {r.address: r.label for r in catalog.QUERIES["hub_suggestions"](spark, sf).collect()}
    assert asked[0].where("coin is not null").isEmpty()  # rows for coins would be counted in vain
    whole = flows.fanout(Ledger(spark, sf).kept_changes()).where("classification <> 'narrow'").collect()
    assert found and all(found.get(r.address, f"Unidentified hub (~{r.recipient_count}+ recipients)").endswith(f"(~{r.recipient_count}+ recipients)") for r in whole)


def test_anomalies_count_packages_without_expanding_rows(spark):
    calls = [(1, "0xa", "swap"), (1, "0xa", "flash_x"), (1, "0xb", "borrow"), (1, "0x02", "repay"), (1, "known", "f"), (1, None, "g"), (2, None, "h"), (3, "known", "a_borrow"), (3, "known", "repay_b")]
    rows = spark.createDataFrame(calls, "digest long, package string, function string")
    got = rules.anomalies(rows, spark.createDataFrame([("known",)], "package string"))
    assert "Expand" not in plan(got)
    assert sorted((r.digest, r.code, r.evidence_count) for r in got.collect()) == [(1, "flashloan-pattern", 1), (1, "multi-package-composition", 4), (1, "unverified-package-call", 2), (3, "flashloan-pattern", 2)]


def test_line_differences_hold_a_pair_of_texts_at_a_time(spark):
    rows = [(n, None if n == 3 else f"a\n{n}\nb", f"a\n{n}\nc" if n % 2 else f"a\n{n}\nb") for n in range(450)]
    pairs = spark.createDataFrame(rows, "key long, a string, b string").coalesce(1)
    got = diffs.ordered_diff(pairs)
    assert "MapInArrow" in plan(got)  # with pandas all texts of a batch are Python strings at once
    assert sorted((r.key, r.added, r.removed) for r in got.collect()) == [(n, 3, 1) if n == 3 else (n, n % 2, n % 2) for n in range(450)]


def test_flows_are_decoded_in_one_pass_over_the_lines(spark, sf):
    found = plan(catalog.QUERIES["decode_flows"](spark, sf))
    assert found.count("lineitem.parquet") == 1 and found.count("hashpartitioning(l_orderkey#") == 1  # commands and changes are of the same lines
    found = plan(catalog.QUERIES["operation_match"](spark, sf))
    assert found.count("lineitem.parquet") == 1 and "hashpartitioning(module#" not in found.split("hashpartitioning(l_orderkey#")[0]  # patterns ask parts, not lines


def test_texts_of_a_story_move_once_to_the_walks_of_an_end(spark, monkeypatch):
    chain, n = range(1, 31), 10  # a chain of transactions: all walks end in the last one or go on for ten hops
    walk = spark.createDataFrame([("forward", s, h, s + h - 1) for s in chain for h in range(1, n + 1) if s + h - 1 <= 30], "direction string, seed long, hop long, digest long")
    tx = spark.createDataFrame([(d, f"a{d}", d) for d in chain], "digest long, sender string, day long")
    changes = spark.createDataFrame([(d, 1, f"a{d}", "x::m::S", -2_000_000 - d) for d in chain], "digest long, ord long, address string, coin string, cents long")
    decoded = spark.createDataFrame([(d, f"P{d}", f"Swap {d}") for d in chain], "digest long, protocols string, actions string")
    kept, written = {}, flows.written
    monkeypatch.setattr(flows, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    told = flows.trace_story(walk, tx, changes, decoded, owners=7)
    assert "hashpartitioning(end#" in plan(told) and ", 7)" in plan(told)
    stories = {r.seed: r.story for r in told.collect()}
    assert set(stories) == set(chain) and all(story.count("--- Hop ") == min(n, 31 - s) for s, story in stories.items())
    assert all(f"\n--- Hop {h} (day {s + h - 1}) ---\nTx:     {s + h - 1}\nSender: a{s + h - 1}\nAction: Swap {s + h - 1}\n" in stories[s] for s in chain for h in range(1, min(n, 31 - s) + 1))
    moved = kept["hops"].select("end", "part", F.explode("h.digest")).distinct().count()
    assert moved == 10 + 20 * n < walk.count()  # those of the last end share their hops
    monkeypatch.setattr(flows, "TOGETHER", 3)
    kept.clear()
    assert {r.seed: r.story for r in flows.trace_story(walk, tx, changes, decoded).collect()} == stories
    assert kept["hops"].where("end = 30").select("part").distinct().count() > 1  # one end is no single row
