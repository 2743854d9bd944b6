"""Helpers that several operators use: shared tables, skew-safe joins, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy if it holds at least one row in so many; there can be no more heavy keys than this.
HEAVY_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine in
    local mode (tests) and an error on a cluster, whose executors would not see it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sablegrid-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts the lineage and computes once; a lost executor costs nothing, for the files are on shared storage.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing will read again."""
    for t in tables:
        files = t.inputFiles()
        if files:
            folder = t.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches in parts of so many rows, so that texts become Python strings a part at a time. When a task's last
    batch is through, memory that Python has freed goes back to the machine (where its C library can), for the worker
    stays and serves other tasks."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Ids (8 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in dropped (doc_id). Rows without an id stay."""
    ids = materialize(dropped.distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to table (one row a key; `size` counts the rows of that key) without a hot task.

    Keys that hold at least total / HEAVY_KEYS rows are broadcast: at most HEAVY_KEYS of them exist. The rest is
    joined by shuffle, where no key holds more than one row in HEAVY_KEYS. rows is read twice, so it should be a
    written table. `how` is inner or left.
    """
    heavy = table.where(F.col(size) * HEAVY_KEYS >= F.lit(total))
    light = table.where(F.col(size) * HEAVY_KEYS < F.lit(total))
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return hot.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the smallest node of each.

    Alternates large-star and small-star steps; each round is one aggregation and one join a step, written to the
    shared folder, where the round before is deleted. No neighbour list is gathered: a node needs only the minimum of
    its neighbours, and the rows of a hub (a root has all its component) are spread over the tasks.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        up, down = (cur.select(F.col(x).alias("node"), F.lit(int(x == "a")).alias("up"), F.lit(int(x == "b")).alias("down")) for x in ("a", "b"))
        ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():  # stars alone, each around its smallest node
            break
        n = cur.count()
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = attach(both, low, ["a"], "n", 2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "stars")
        # each a > b now; the smallest b of an a takes the others
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        small = attach(large, least, ["a"], "n", n).select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("e")).select("e.a", "e.b")
        before, cur = cur, materialize(small.where("a <> b").distinct(), "edges")
        discard(before, large)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
