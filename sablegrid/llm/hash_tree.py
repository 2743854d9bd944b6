"""Sharding by a hierarchical weighted hash tree. DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import discard, materialize

#: region -> rack -> shard -> weight. A rack weighs as much as its shards, a region as much as its racks.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Nodes of a tree at most, which bounds the broadcast of a level.
NODES = 100_000
#: Bytes of one shard file, about.
FILE = 256 << 20


def even_tree(regions: int, racks: int, shards: int) -> dict:
    """regions x racks x shards leaves of weight 1, numbered from 0."""
    return {f"region{g}": {f"rack{r}": {(g * racks + r) * shards + s: 1.0 for s in range(shards)} for r in range(racks)} for g in range(regions)}


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """tree with one more shard, in a region of its own: the weights of all other regions stay, so rows move into the
    new region alone, whose only shard is the new one."""
    if f"region of {shard}" in tree:
        raise ValueError(f"shard {shard} is there already")
    return {**tree, f"region of {shard}": {"rack": {shard: weight}}}


def levels(spark: SparkSession, tree: Tree) -> list[DataFrame]:
    """For each level, a row for each parent path: its children as (name, weight)."""
    region = {g: {r: sum(s.values()) for r, s in racks.items()} for g, racks in tree.items()}
    tables: list[dict[str, dict]] = [
        {"": {g: sum(racks.values()) for g, racks in region.items()}},
        {f"/{g}": racks for g, racks in region.items()},
        {f"/{g}/{r}": shards for g, racks in tree.items() for r, shards in racks.items()},
    ]
    shards = [s for t in tables[2].values() for s in t]
    if len(shards) != len(set(shards)):
        raise ValueError("a shard stands at two places of the tree")
    if sum(len(c) for t in tables for c in t.values()) > NODES:
        raise ValueError(f"a tree has {NODES} nodes at most")
    if not shards or any(w < 0 for t in tables for c in t.values() for w in c.values()) or not sum(tables[0][""].values()) > 0:
        raise ValueError("weights must be 0 or more, and one of them more than 0")
    kind = "array<struct<_node: string, _children: array<struct<name: string, weight: double>>>>"
    said = lambda t: json.dumps([{"_node": p, "_children": [{"name": str(n), "weight": w} for n, w in c.items() if w > 0]} for p, c in t.items() if sum(c.values()) > 0])
    return [spark.range(1).select(F.inline(F.from_json(F.lit(said(t)), kind))) for t in tables]


def draw(key: Column, path: Column, weight: Column) -> Column:
    """The child's weighted draw: an exponential variable of rate `weight`, made of 52 bits of a hash of key and path.
    The least of several draws is each child's with probability in proportion to its weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, path)), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**52)) / weight


def placed(rows: DataFrame, tree: Tree, key: Column, into: str) -> DataFrame:
    """rows with the shard of their key in column `into`: from the root down, the child of the least draw is entered.

    A draw hangs on the key, the child's path and its weight alone. So rows move only between a node whose weight
    changes and its siblings, and all below other nodes stays as it is. Of equal draws the first name is taken.
    """
    out = rows.withColumn("_node", F.lit(""))
    for table in levels(rows.sparkSession, tree):
        out = out.join(F.broadcast(table), "_node")  # NODES rows at most
        full = lambda c: F.concat(F.col("_node"), F.lit("/"), c["name"])
        best = F.array_min(F.transform("_children", lambda c: F.struct(draw(key, full(c), c["weight"]).alias("d"), c["name"].alias("n"))))
        out = out.withColumn("_node", F.concat("_node", F.lit("/"), best["n"])).drop("_children")
    return out.select(*rows.columns, F.element_at(F.split("_node", "/"), -1).cast("int").alias(into))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with slot, gapless from 0 within each group, in this order.

    rows (a written table) are sorted in ranges of group, order and place in the table; so a group of any size, and
    copies of one row too, lie in as many ranges as they need. A row's slot is its place in its range's part of the
    group and the rows of the group in the ranges before. Only the parts' counts meet, one row for each range and group.
    """
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_at").sortWithinPartitions(group, *order, "_at")
    laid = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = laid.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.partitionBy(group).orderBy("_range")) - F.col("_n")).drop("_n")
    return laid.join(parts, [group, "_range"]).withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "slot")


def shard(docs: DataFrame, tree: Tree, more: Tree | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the tree alone decide. size counts the text's bytes in UTF-8 and 8 more; a null text
    has none and crc32 0. grown_shard is the row's shard in `more`, null without it. slot numbers a shard's rows from 0
    by doc_id, nulls first, then crc32 and size. Rows that repeat a doc_id share its shard, rows without one share that
    of the empty key; rows that are the same in all three get following slots in any order. Texts of any length are
    read whole, an empty table gives an empty one, other columns are not looked at.

    One narrow row per document is written and sorted in ranges; texts are never shuffled. A doc_id, or a text, that a
    third of all rows hold is spread over as many ranges as its rows need.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = placed(slim, tree, key, "shard")
    slim = placed(slim, more, key, "grown_shard") if more is not None else slim.withColumn("grown_shard", F.lit(None).cast("int"))
    slim = materialize(slim, "placed")
    out = numbered(slim, "shard", ["doc_id", "text_crc32", "size"])
    discard(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def moved(docs: DataFrame, old: Tree, new: Tree) -> DataFrame:
    """Rows (from_shard, to_shard, n_rows, size) of what changes its shard from one tree to another, most rows first."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"))
    both = placed(placed(sized, old, key, "from_shard"), new, key, "to_shard").where("from_shard <> to_shard")
    return both.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("size")).orderBy(F.desc("n_rows"), "from_shard", "to_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """docs as Parquet files under path, in a folder for each shard (`_shard=<number>`).

    A shard is dealt to as many tasks as its bytes need, by a hash of the whole row and its place, so no key or text
    makes a task large.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sizes = placed(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("b")), tree, key, "_shard")
    largest = sizes.groupBy("_shard").agg(F.sum("b").alias("b")).agg(F.coalesce(F.max("b"), F.lit(0))).first()[0]
    files = max(1, -(-largest // FILE))
    dealt = placed(docs, tree, key, "_shard").withColumn("_file", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)))
    tasks = files * sum(len(shards) for racks in tree.values() for shards in racks.values())
    dealt.repartition(tasks, "_shard", "_file").drop("_file").write.partitionBy("_shard").parquet(path)
