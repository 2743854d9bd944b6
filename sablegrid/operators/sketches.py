"""Fan-out from sketches of distinct counts: one row for each address and day, merged when it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flows import meetings, met_roles
from .search import fresh

#: Seconds that a measured fan-out may live; the present method's number.
TTL_SECONDS, METHOD = 7 * 86_400, 2
#: Bits of a sketch's size: 2 ** 13 registers of up to a byte, a standard error of 1.2 per cent.
SIZE = 13
COUNTS = {"recipient_count": "recipients", "sender_count": "senders", "counterparty_count": "counterparties", "coin_type_count": "coins"}


def day_sketches(changes: DataFrame, measured_at: Column | None = None, method: Column | int = METHOD, size: int = SIZE) -> DataFrame:
    """address, day, measured_at, method_version, scanned and sketches of recipients, senders, counterparties, coins.

    A day's rows never change when the next day comes, so a run adds the sketches of the new days alone. measured_at is
    in seconds, that of the day by default. changes: digest, day, ord, address, coin, cents. Transactions are counted by
    the row that each has of the address itself: a distinct count would shuffle sketches of each transaction.
    """
    met = meetings(changes)
    pays, takes, self = met_roles()
    of = lambda test: F.hll_sketch_agg(F.when(test, F.col("other")), size)
    out = met.groupBy("address", "day").agg(
        F.count_if(self).alias("scanned"), of(pays).alias("recipients"), of(takes).alias("senders"), of(pays | takes).alias("counterparties"), F.hll_sketch_agg("coin", size).alias("coins")
    )
    at = F.col("day") * 86_400 if measured_at is None else measured_at
    return out.withColumns({"measured_at": at.cast("long"), "method_version": (F.lit(method) if isinstance(method, int) else method).cast("int")})


def merged(sketches: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, method: int = METHOD) -> DataFrame:
    """address, scanned and estimated counts over the sketches of the present method that are not too old.

    Sketches merge without loss, so an address's estimate is that of a sketch of all its days; an address on few days
    costs as little as it has days. Partial merges run before the shuffle, so an address with many rows is no hot task.
    """
    kept = fresh(sketches, now, ttl_seconds, method)
    return kept.groupBy("address").agg(F.sum("scanned").alias("scanned"), *[F.hll_sketch_estimate(F.hll_union_agg(s)).alias(n) for n, s in COUNTS.items()])
