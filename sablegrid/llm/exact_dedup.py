"""Exact deduplication over an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import HEAVY_KEYS, materialize, shared_dir

SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of text of one owner's key range, and the most files that a bucketed table may be dealt to.
RANGE, FILES = 256 << 20, 99_999


@dataclass(frozen=True)
class IndexParams:
    """capacity: keys a bucket may hold before it splits. max_bits: the driver's directory has 2 ** max_bits slots at
    most, which bounds what it holds; fuller buckets split further in the address of the key, at any size. hash_bits:
    bits of the key hash (fewer ones force collisions in tests)."""

    capacity: int = 2_000
    max_bits: int = 16
    hash_bits: int = 64


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def directory(histogram: dict[int, int], capacity: int, max_bits: int) -> tuple[int, list[tuple[int, int]]]:
    """Global depth and, for each slot, its bucket and the further bits that number its parts. histogram: keys by the
    top max_bits of their hash.

    Begins with one bucket; an overfull bucket splits by its next bit, and the directory doubles whenever the
    bucket that splits was as deep as the directory itself. A bucket that is overfull at the last bit has as many
    further bits as its keys need; so its parts, too, are about full.
    """
    depth, buckets, todo = 0, [], [(0, 0, sum(histogram.values()), histogram)]
    while todo:
        prefix, local, n, own = todo.pop()
        if n <= capacity or local == max_bits:
            buckets.append((prefix, local, (max(1, -(-n // capacity)) - 1).bit_length()))
            continue
        depth = max(depth, local + 1)
        halves: tuple[dict, dict] = ({}, {})
        for slot, k in own.items():
            halves[slot >> (max_bits - local - 1) & 1][slot] = k
        todo += [(prefix * 2 + bit, local + 1, sum(h.values()), h) for bit, h in enumerate(halves)]
    slots, number = [(0, 0)] * (1 << depth), 0
    for prefix, local, more in sorted(buckets, key=lambda b: b[0] << (max_bits - b[1])):
        for j in range(1 << (depth - local)):
            slots[(prefix << (depth - local)) + j] = number, more
        number += 1 << more
    return depth, slots


def addressed(rows: DataFrame, depth: int, slots: list[tuple[int, int]]) -> DataFrame:
    """rows with the bucket that the directory gives their hash h."""
    said = F.lit(" ".join(f"{b},{m}" for b, m in slots))  # 2 ** max_bits slots at most
    entry = lambda i: F.get(F.split("e", ","), F.lit(i))
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(said, " ")).alias("slot", "e")).select("slot", entry(0).cast("long").alias("first"), entry(1).cast("int").alias("more"))
    slot = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    further = F.call_function("shiftrightunsigned", F.shiftleft("h", depth), F.lit(64) - F.col("more"))
    bucket = F.col("first") + F.when(F.col("more") > 0, further).otherwise(0)
    return rows.withColumn("slot", slot).join(F.broadcast(table), "slot").withColumn("bucket", bucket).drop("slot", "first", "more")


def bucket_files(rows: DataFrame, owners: int) -> DataFrame:
    """rows as files on shared storage, dealt by bucket: all of a bucket is in the files of one owner, in order of its
    keys, and is read again by that owner's task without another shuffle."""
    spark, name = rows.sparkSession, f"buckets_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    dealt = rows.repartition(owners, "bucket")
    dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(owners, "bucket").sortBy("bucket", "h", "sha").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone goes: the files are not the catalog's
    return out


def exact_dedup(docs: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal if they are after each run of white space became one space; null counts as empty. Of equal
    texts the smallest doc_id stays; rows that repeat both id and text are all of that id, so all of them are
    marked kept. A null doc_id never wins against a number; a group of nulls only has keep_id null and is kept.
    An empty table gives an empty result; columns other than doc_id and text are not looked at. Texts of any
    length are compared whole.

    The key is a 64-bit hash. Its top bits address the directory, its bucket's files are written to shared storage,
    and the bucket's owner task decides: it sorts the keys, chains texts whose hashes collide (chain is the place in
    that chain) and compares bytes. Each row's group comes from its owner. The texts of which one in a thousand rows
    or more are copies, at most a thousand, reach the owner as one row from each map task, however many copies there
    are, and their rows find their group by the digest.
    """
    full = F.xxhash64("norm")
    hashed = full if params.hash_bits == 64 else F.pmod(full, F.lit(1 << params.hash_bits)) * F.lit(1 << (63 - params.hash_bits))
    keyed = docs.select("doc_id", normalized(F.col("text")).alias("norm")).select("doc_id", "norm", hashed.alias("h"), F.sha2("norm", 256).alias("sha"))
    slim = materialize(keyed.select("doc_id", "h", "sha", F.octet_length("norm").alias("bytes")), "fingerprints")
    total, size = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    keys = slim.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("n"))
    # what the driver gets: 2 ** max_bits rows at most
    slot = F.shiftrightunsigned("h", 64 - params.max_bits).cast("int").alias("slot")
    depth, slots = directory({r.slot: r["count"] for r in keys.groupBy(slot).count().collect()}, params.capacity, params.max_bits)
    hot = materialize(keys.where(F.col("n") * HEAVY_KEYS >= F.lit(total)).where("n > 1").select("h", "sha"), "hot")  # HEAVY_KEYS rows at most

    single = keyed.join(F.broadcast(hot), ["h", "sha"], "left_anti").select("h", "sha", "norm", "doc_id", F.lit(1).cast("long").alias("n"), F.lit(False).alias("hot"))
    copies = keyed.join(F.broadcast(hot), ["h", "sha"]).groupBy(F.spark_partition_id().alias("task"), "h", "sha", "norm").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = single.unionByName(copies.drop("task").withColumn("hot", F.lit(True)))
    owners = min(FILES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE)))
    index = bucket_files(addressed(rows, depth, slots), owners)

    same = W.partitionBy("bucket", "h", "sha", "norm")
    chain = F.dense_rank().over(W.partitionBy("bucket", "h").orderBy("sha", "norm")) - 1
    decided = index.select("bucket", "h", "sha", "doc_id", "hot", chain.alias("chain"), F.min("doc_id").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size"))
    decided = materialize(decided, "decided")
    of = ["doc_id", "keep_id", "group_size", "sha", "bucket", "chain"]
    groups = addressed(hot, depth, slots).join(decided.where("hot").drop("doc_id", "hot").distinct(), ["bucket", "h", "sha"])
    found = decided.where("not hot").select(of).unionByName(slim.join(F.broadcast(groups), ["h", "sha"]).select(of))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")
