"""Streams with state for each key, in micro-batches that come out of order, and after a restart."""

import datetime as dt
import random

import pytest

from sablegrid.operators import windows
from sablegrid.streaming import keyed, twins

T0 = dt.datetime(2024, 1, 1)
VERSIONS = "object string, version long, owner string, ts timestamp"
TRADES = "pair string, ts timestamp, seq long, price long, size long"


def rows_of(n, seed=3):
    rng = random.Random(seed)
    return [(f"o{rng.randrange(6)}", v, rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=v)) for v in range(n)]


class Feed:
    """A folder of files as a stream that is run file by file; each run is one micro-batch and starts anew."""

    def __init__(self, spark, base, schema, make):
        self.spark, self.base, self.schema, self.make, self.n = spark, base, schema, make, 0

    def run(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.base}/in/f{self.n}")
        return self.again()

    def again(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in/*")
        with keyed.keyed_state(self.spark):
            return twins.run_available(self.make(stream), f"{self.base}/out", f"{self.base}/state", "append")

    def out(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.base}/out").collect()), key=str)


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_owner_changes_out_of_order(spark, tmp_path, few):
    rows = rows_of(200)
    feed = Feed(spark, str(tmp_path), VERSIONS, keyed.owner_changes)
    odd, even = rows[1:120:2] + rows[120:], rows[0:120:2]  # times lie within the ten minutes that may be late
    feed.run(odd)
    feed.run(even + odd[:30])  # some come again
    end = ("end", 10_000, "z", T0 + dt.timedelta(hours=9))
    feed.run([end])
    want = sorted(map(tuple, windows.transitions(spark.createDataFrame(rows, VERSIONS)).collect()), key=str)
    assert feed.out() == want and len(want) > 20
    # a restart from the checkpoint has nothing to do
    feed.again()
    assert feed.out() == want
    # what was settled stays: rows that are later than the watermark are dropped, newer versions follow the last owner
    last = max((r for r in rows if r[0] == "o1"), key=lambda r: r[1])
    feed.run([("o1", last[1] - 1, "never", last[3])])
    feed.run([("o1", 5000, "new", T0 + dt.timedelta(hours=10))])
    feed.run([("end", 10_001, "z", T0 + dt.timedelta(hours=19))])
    more = [r for r in feed.out() if r not in want]
    assert more == ([("o1", last[2], "new", 5000)] if last[2] else [])


def test_new_versions_move_the_mark(spark, tmp_path, few):
    feed = Feed(spark, str(tmp_path), VERSIONS, keyed.new_versions)
    feed.run([("a", 3, "x", T0), ("a", 5, "y", T0), ("a", 5, "y", T0), ("b", 1, "x", T0), ("b", None, "n", T0)])
    assert feed.out() == sorted([("a", 3, "x"), ("a", 5, "y"), ("b", 1, "x"), ("b", None, "n")], key=str)
    feed.run([("a", 4, "late", T0), ("a", 5, "y", T0), ("a", 6, "z", T0), ("b", None, "n2", T0)])
    feed.again()
    assert feed.out() == sorted([("a", 3, "x"), ("a", 5, "y"), ("b", 1, "x"), ("b", None, "n"), ("a", 6, "z"), ("b", None, "n2")], key=str)


def test_candles_are_final_and_their_state_goes(spark, tmp_path, few):
    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    feed = Feed(spark, str(tmp_path), TRADES, lambda s: keyed.candles(s, "1h"))
    feed.run([("p", at(0, 30), 2, 7, 1), ("p", at(0, 5), 1, 5, 2), ("p", at(0, 30), 3, 6, 1), ("p", at(1, 5), 4, 9, 1)])
    assert feed.out() == []  # the watermark is at 0:55
    feed.run([("p", at(0, 58), 5, 4, 1), ("p", at(1, 20), 6, 8, 1)])  # late, but not too late
    first = ("p", at(0), 5, 7, 4, 4, 4, 5)
    assert feed.out() == [first]
    feed.run([("p", at(0, 59), 7, 100, 1), ("p", at(1, 30), 8, 8, 1)])  # 0:00 is closed: dropped
    assert feed.out() == [first]
    # a long stream holds the open candles alone
    for h in range(2, 8):
        query = feed.run([(x, at(h, m), h * 100 + m, 1, 1) for x in "pqr" for m in range(0, 60, 7)])
    kept = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    assert sum(kept) <= 6 and len(feed.out()) == 2 + 5 * 3
    assert sum(r[6] for r in feed.out() if r[1] == at(1)) == 3


def test_weeks_begin_on_mondays(spark):
    trades = spark.createDataFrame([("p", T0 + dt.timedelta(days=d), d, 1, 1) for d in range(15)], TRADES)  # 2024-01-01 is a Monday
    assert [(r.open_at, r.trades) for r in keyed.candles(trades, "1w").orderBy("open_at").collect()] == [(T0 + dt.timedelta(days=7 * i), n) for i, n in enumerate((7, 7, 1))]
    with pytest.raises(KeyError):
        keyed.candles(trades, "2h")


def test_provider_setting_comes_back(spark):
    before = spark.conf.get(keyed.PROVIDER)
    with keyed.keyed_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.STORE
    assert spark.conf.get(keyed.PROVIDER) == before
