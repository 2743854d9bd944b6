"""Streams with state of their own for each key: owner changes and changes since a version, in whatever order rows come.

State is held for each object: the last version that was settled with its owner, and the versions that came but aren't
settled. The watermark settles them: once it has passed a version's time, all before it are there. What was
settled is final, so a version at or below that mark is dropped, whether it comes late or again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Waiting versions of an object in one row of its state.
FRAME = 10_000
CHANGE = ["object", "from_owner", "to_owner", "at_version"]
#: The store whose state lives on disk and in changelogs of the checkpoint, not in the heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within have the store that keyed state needs; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STORE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _type(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


class OwnerChanges(StatefulProcessor):
    """Gives a row for each change of an object's owner, in version order.

    Each call to the store is a message and each of its rows is encoded by itself, so a frame's rows of an object are
    kept as one row of arrays, and the version that was settled last, its owner and the next timer are one value.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled_until", "version long, owner string, wake long")
        self.waiting = handle.getListState("waiting_frames", "versions array<long>, owners array<string>, ms array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.settled.get() or (None, None, None)
        least = []
        for frame in rows:
            frame = frame if last[0] is None else frame[frame["version"] > last[0]]
            if len(frame):
                self.waiting.appendValue(tuple(frame[c].tolist() for c in ("version", "owner", "ms")))
                least.append(int(frame["ms"].min()))
        if least:
            self.wake(last, min(least))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        version, owner, _ = self.settled.get() or (None, None, None)
        came = {v: (o, ms) for kept in self.waiting.get() for v, o, ms in zip(*kept, strict=True)}  # of a version that came again the last counts
        rest = [(v, o, ms) for v, (o, ms) in came.items() if ms > now]
        out = []
        for v in sorted(v for v, (_, ms) in came.items() if ms <= now):
            if version is not None and v <= version:
                continue
            to = came[v][0]
            if version is not None and to is not None and owner is not None and to != owner:
                out.append((key[0], owner, to, v))
            version, owner = v, to
        self.waiting.clear()
        for i in range(0, len(rest), FRAME):
            self.waiting.appendValue(tuple(map(list, zip(*rest[i : i + FRAME], strict=True))))
        self.wake((version, owner, None), min(ms for *_, ms in rest) if rest else None)  # the timer that fired is gone
        if out:
            yield pd.DataFrame(out, columns=CHANGE)

    def wake(self, last: tuple, ms: int | None) -> None:
        """One timer is enough: the earliest; each one that fires sets the next."""
        version, owner, before = last
        if ms is not None and (before is None or ms < before):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            before = ms
        self.settled.update((version, owner, before))

    def close(self) -> None:
        pass


def owner_changes(versions: DataFrame, late: str = "10 minutes") -> DataFrame:
    """versions (object, version, owner, ts) as a stream of owner changes: object, from_owner, to_owner, at_version.

    The rows of `transitions` in batch form, for all versions whose time the watermark has passed. Start it within
    `keyed_state`, in append mode.
    """
    marked = versions.withWatermark("ts", late).select("object", "version", "owner", "ts", F.unix_millis("ts").alias("ms"))
    schema = f"object {_type(versions, 'object')}, from_owner string, to_owner string, at_version long"
    return marked.groupBy("object").transformWithStateInPandas(OwnerChanges(), schema, "Append", "EventTime")


class NewVersions(StatefulProcessor):
    """Gives each version above the highest one seen of its object, once; rows without a version always."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        frame = pd.concat(list(rows), ignore_index=True)
        known = frame["version"].dropna().astype("int64")
        new = known if mark is None else known[known > mark]
        if len(new):
            self.mark.update((int(new.max()),))
        at = frame.index.isin(new.drop_duplicates().index) | frame["version"].isna()
        yield frame.loc[at, ["object", "version", "owner"]]

    def close(self) -> None:
        pass


def new_versions(versions: DataFrame) -> DataFrame:
    """versions as a stream of what is newer than anything that came before of the object: the high-water mark that a
    caller of the batch form holds is kept for each object. Start it within `keyed_state`, in append mode."""
    rows = versions.select("object", "version", "owner")
    return rows.groupBy("object").transformWithStateInPandas(NewVersions(), f"object {_type(versions, 'object')}, version long, owner string", "Append", "None")


#: Widths of candles.
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day", "1w": "1 week"}


def candles(trades: DataFrame, width: str = "1h", late: str = "10 minutes") -> DataFrame:
    """trades (pair, ts, seq, price, and size) as a stream of candles: pair, open_at, open, high, low, close, trades, volume.

    In append mode, a candle comes once, when the watermark has passed its end, and its state goes; a trade that
    comes after that is dropped. So a candle is final when it is given, and state is bounded by the candles that are open.
    First and last are by time, then seq.
    """
    w, at = F.window("ts", WIDTHS[width], startTime="4 days" if width == "1w" else None), F.struct("ts", "seq")  # weeks begin on Mondays
    bars = trades.withWatermark("ts", late).groupBy("pair", w.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"),
    )
    return bars.select("pair", F.col("w.start").alias("open_at"), "open", "high", "low", "close", "trades", "volume")
