"""Nearest vectors through a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize


#: Lengths of vectors that have a tree of their own at most.
TREES = 64


@dataclass(frozen=True)
class TreeParams:
    """sample: vectors that the tree is fitted on, by hash of the id (the bound on what reaches the driver).
    branch: children of an inner node. leaf: sampled vectors of a leaf at most; so a tree has at most `sample`
    leaves. k: neighbours. recall: aim of the calibration, made on `probes` vectors against all rows. block: vectors
    of a leaf that one task searches; larger leaves are split. queries: queries about that one task answers; where more
    meet, its vectors go to several tasks."""

    sample: int = 20_000
    branch: int = 8
    leaf: int = 16
    k: int = 10
    recall: float = 0.94
    probes: int = 200
    block: int = 4096
    queries: int = 8192
    seed: int = 7


@dataclass
class Node:
    centres: np.ndarray
    children: list = field(default_factory=list)  # Node or leaf number


@dataclass
class Tree:
    root: Node | int
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, Node):
                out[rows] = node
                continue
            if len(rows):
                near = squared(x[rows], node.centres).argmin(1)
                todo += [(c, rows[near == i]) for i, c in enumerate(node.children)]
        return out

    def best_bins(self, x: np.ndarray) -> Iterator[int]:
        """All leaves as a best-bin-first walk reaches them: the branch with the nearest centre is followed down, the
        others wait in a queue by their centres' distance."""
        queue, n = [(0.0, 0, self.root)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            while isinstance(node, Node):
                d = ((node.centres - x) ** 2).sum(1).tolist()
                first = min(range(len(d)), key=d.__getitem__)
                for i, child in enumerate(node.children):
                    if i != first:
                        n += 1
                        heapq.heappush(queue, (d[i], n, child))
                node = node.children[first]
            yield node


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from a vector to others in double precision, from differences."""
    return np.sqrt(((b - a) ** 2).sum(1))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(10):
        near = squared(x, c).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, barred=lambda i: slice(0, 0)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q (with the id it may not meet): its number, the rows of x that are nearest, and their distances.
    barred: rows of x that a row of q may not meet either.

    Products of matrices tell which rows can be among them, with room for rounding; those are measured exactly.
    """
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = squared(part, x)
        slack = 1e-9 * ((part * part).sum(1) + (x * x).sum(1).max(initial=0))
        for i, d in enumerate(rough):
            d[ids == own[a + i]] = np.inf
            d[barred(a + i)] = np.inf
            bound = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
            j = np.flatnonzero((d <= bound + slack[i]) & (d < np.inf))
            true = exact(part[i], x[j])
            best = np.lexsort((ids[j], true))[:k]
            yield a + i, j[best], true[best]


def fit(x: np.ndarray, p: TreeParams) -> Tree:
    """Split the sample by k-means until its parts are small."""
    rng, leaves = np.random.default_rng(p.seed), 0

    def grow(rows: np.ndarray, depth: int) -> Node | int:
        nonlocal leaves
        if len(rows) > p.leaf and depth < 12:
            c = _centres(x[rows], p.branch, rng)
            near = squared(x[rows], c).argmin(1)
            used = [i for i in range(len(c)) if (near == i).any()]
            if len(used) > 1:
                return Node(c[used], [grow(rows[near == i], depth + 1) for i in used])
        leaves += 1
        return leaves - 1

    tree = Tree(grow(np.arange(len(x)), 0), 0)
    tree.leaves = leaves
    return tree


def widen(tree: Tree, probes: np.ndarray, wanted: list[np.ndarray], recall: float) -> int:
    """Leaf visits until which the share of the probes' true neighbours, whose leaves are wanted, is reached."""
    ranks = []
    for v, leaves in zip(probes, wanted):
        left = Counter(leaves.tolist())
        for n, leaf in enumerate(tree.best_bins(v)):
            if not left:
                break
            ranks += [n] * left.pop(leaf, 0)
    ranks.sort()
    return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)] + 1 if ranks else 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows whose vector is not null or zero and has finite components only."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null").where(good)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def nearest(vectors: DataFrame, p: TreeParams = TreeParams(), every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Null and zero vectors, such as hold null or non-finite components, and rows without an id take no part. A query
    meets only vectors of its own length; a length that less than one row in 64 has is searched in full. Rows that repeat an id are one
    candidate each, but none is the neighbour of its own id. Fewer candidates than k give fewer rows; an empty table
    none. Ties go to the smaller vec_id. Columns other than vec_id and embedding are not looked at.

    The tree is fitted on a bounded sample; all rows are indexed. How many leaves a query visits is calibrated on
    probes whose true neighbours among all rows are known. Leaves are searched by tasks that each hold a block of
    neighbouring leaves, or of one large leaf, and give the k best of those that a query visits; so a leaf that holds
    a third of all rows is many tasks.
    If the visits together would miss k candidates, the query visits further leaves: the walk counts the candidates
    of the leaves it has seen.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors).withColumn("n", F.size("v")), "vectors")
    total = rows.count()
    counts = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    large = sorted(r.n for r in counts.where(F.col("rows") * TREES >= F.lit(total)).collect())  # TREES at most
    few = rows.where(~F.col("n").isin(large)).join(counts, "n") if large else rows.join(counts, "n")
    whole = _scan(few, p, every)
    for n in large:
        whole = whole.unionByName(_search(rows.where(F.col("n") == n).drop("n"), p, every))
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def _local(p: TreeParams):
    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(found):
            ids, own = found["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            barred = {}
            if "leaves" in queries:
                leaf, visited = found["leaf"].to_numpy(), queries["leaves"].tolist()
                barred = {"barred": lambda i: ~np.isin(leaf, visited[i])}
            for i, j, d in closest(_matrix(queries["q"]), _matrix(found["v"]), ids, own, p.k, **barred):
                out += zip([int(own[i])] * len(j), ids[j].tolist(), d.tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _scan(rows: DataFrame, p: TreeParams, every: int) -> DataFrame:
    """All queries against all rows of their length, in blocks: rows (vec_id, v, n, rows) of lengths that few have."""
    blocks, parts = F.ceil(F.col("rows") / p.block).cast("int"), F.ceil(F.col("rows") / (every * p.queries)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("part", each(parts)).select("n", "block", "part", "vec_id", "v")
    part = F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part")
    asked = rows.where(F.col("vec_id") % every == 0).select((F.col("n") + 0).alias("n"), each(blocks).alias("block"), part, F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    keys = ["n", "block", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_local(p), "query_id long, vec_id long, score double")


def _search(rows: DataFrame, p: TreeParams, every: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).toPandas()
    tree = fit(_matrix(sample["v"]), p)
    probes = _matrix(sample["v"][: p.probes]), sample["vec_id"][: p.probes].to_numpy()
    shipped = spark.sparkContext.broadcast((tree, probes))  # at most p.sample centres

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=shipped.value[0].leaf(_matrix(b["v"])))

    def true(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = shipped.value[1]
        for b in batches:
            if len(b):
                ids, leaf, out = b["vec_id"].to_numpy(), b["leaf"].to_numpy(), []
                for i, j, d in closest(q, _matrix(b["v"]), ids, own, p.k):
                    out += zip([i] * len(j), ids[j].tolist(), leaf[j].tolist(), d.tolist())
                yield pd.DataFrame(out, columns=["probe", "vec_id", "leaf", "score"])

    indexed = materialize(rows.mapInPandas(index, "vec_id long, v array<double>, leaf int"), "leaves")
    nearest_to = W.partitionBy("probe").orderBy("score", "vec_id")
    known = indexed.mapInPandas(true, "probe int, vec_id long, leaf int, score double").withColumn("r", F.row_number().over(nearest_to)).where(F.col("r") <= p.k).select("probe", "leaf").toPandas()
    visits = widen(tree, probes[0], [known["leaf"][known["probe"] == i].to_numpy() for i in range(len(probes[0]))], p.recall)

    held = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row a leaf
    owner, blocks, room = {}, [], 0  # neighbouring leaves share a task up to a block of rows; a larger leaf is several blocks
    for leaf, n in sorted(held.items()):
        if not blocks or n > room:
            blocks.append(-(-n // p.block))
            room = p.block * blocks[-1]
        owner[leaf] = len(blocks) - 1
        room -= n
    layout = spark.createDataFrame([(leaf, o, blocks[o]) for leaf, o in owner.items()] or [(0, 0, 1)], "leaf int, owner int, blocks int")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shipped.value[0]
        for b in batches:
            out = []
            for i, v in zip(b["vec_id"].tolist(), b["v"]):
                seen, visited = 0, {}
                for n, leaf in enumerate(tree.best_bins(np.asarray(v, float))):
                    if n >= visits and seen > p.k:
                        break
                    if leaf in held:
                        seen += held[leaf]
                        visited.setdefault(owner[leaf], []).append(leaf)
                out += [(i, v, o, block, leaves) for o, leaves in visited.items() for block in range(blocks[o])]
            yield pd.DataFrame(out, columns=["query_id", "q", "owner", "block", "leaves"])

    asked = rows.where(F.col("vec_id") % every == 0).mapInPandas(walk, "query_id long, q array<double>, owner int, block int, leaves array<int>")
    asked = materialize(asked, "asked")
    parts = F.ceil(F.col("asked") / p.queries).cast("int")
    load = F.broadcast(asked.groupBy("owner", "block").agg(F.count(F.lit(1)).alias("asked")).select("owner", "block", parts.alias("parts")))  # a row a block of leaves
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")
    dealt = indexed.join(F.broadcast(layout), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    dealt = dealt.join(load, ["owner", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.join(load, ["owner", "block"]).select("query_id", "q", "owner", "block", "leaves", part)
    keys = ["owner", "block", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_local(p), "query_id long, vec_id long, score double")
