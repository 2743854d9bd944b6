import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from sablegrid.llm import hash_tree as ht

SCHEMA = "doc_id long, text string, shard string, slot long, _other string, size string"
TREE = ht.even_tree(2, 3, 4)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def brute_shard(key, tree):
    """The descent in plain Python."""
    weight = lambda x: sum(map(weight, x.values())) if isinstance(x, dict) else x
    path = ""
    while isinstance(tree, dict):
        best = None
        for name, below in tree.items():
            if weight(below) > 0:
                u = (int(hashlib.md5(f"{key}{path}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                best = min(best or (math.inf,), (-math.log(u) / weight(below), str(name), below))
        path, tree = f"{path}/{best[1]}", best[2]
    return int(path.rpartition("/")[2])


def brute(rows, tree, more):
    out = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", brute_shard("" if i is None else i, tree), brute_shard("" if i is None else i, more)) for i, t in rows]
    out.sort(key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[1]))
    seen = collections.Counter()
    return [(*r[:5], (seen.update([r[4]]), seen[r[4]] - 1)[1], r[5]) for r in out]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b"), (None, None), (None, "z"), (None, "z"), (9, "€ \U0001f600"), (10, "x y " * 100_000)] + [(i, f"text {i % 7}") for i in range(20, 400)]
    more = ht.grown(TREE, 24)
    assert got(ht.shard(table(spark, rows), TREE, more)) == sorted(brute(rows, TREE, more), key=str)


def test_one_id_on_a_third_of_the_rows(spark):
    """Such a shard's slots are gapless though many ranges number them."""
    rows = [(7 if i % 3 else i, "same") for i in range(3000)]
    out = ht.shard(table(spark, rows).repartition(5), TREE).collect()
    per = collections.defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    assert len(out) == 3000 and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and {r.grown_shard for r in out} == {None}


def test_empty(spark):
    assert ht.shard(table(spark, []), TREE).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = TREE
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    for n in range(24, 27):
        more = ht.grown(tree, n)
        moves = ht.moved(docs, tree, more).collect()
        assert {r.to_shard for r in moves} == {n} and 0.4 / (n + 1) < sum(r.n_rows for r in moves) / 4000 < 1.7 / (n + 1)
        tree = more


def test_moves_stay_in_the_subtree_whose_weights_change(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    # weight from one shard of a rack to its neighbour: only those two exchange rows, for all above weighs the same
    inner = {g: {r: dict(s) for r, s in racks.items()} for g, racks in TREE.items()}
    inner["region0"]["rack1"] |= {4: 0.5, 5: 1.5}
    assert {(r.from_shard, r.to_shard) for r in ht.moved(docs, TREE, inner).collect()} <= {(a, b) for a in range(4, 8) for b in range(4, 8)}
    # a heavier rack takes rows from its region's racks and, as the region weighs more, from the other region; there, none moves within
    heavy = {g: {r: dict(s) for r, s in racks.items()} for g, racks in TREE.items()}
    heavy["region1"]["rack0"] = {s: 2.0 for s in TREE["region1"]["rack0"]}
    moves = ht.moved(docs, TREE, heavy).collect()
    assert moves and all(r.to_shard >= 12 for r in moves) and all(r.to_shard in range(12, 16) for r in moves if r.from_shard >= 12)
    # an emptied shard gives its rows away and takes none
    gone = {g: {r: {s: 0.0 if s == 2 else w for s, w in shards.items()} for r, shards in racks.items()} for g, racks in TREE.items()}
    assert all(r.to_shard != 2 for r in ht.moved(docs, TREE, gone).collect())


def test_weights_are_kept(spark):
    tree = {"a": {"x": {0: 3.0, 1: 1.0}}, "b": {"x": {2: 2.0}, "y": {3: 2.0}}}
    n = dict(ht.placed(spark.range(8000), tree, F.col("id").cast("string"), "shard").groupBy("shard").count().collect())
    assert all(abs(n[s] / 8000 - w / 8) < 0.03 for s, w in ((0, 3), (1, 1), (2, 2), (3, 2)))


def test_bad_trees(spark):
    for bad in ({}, {"a": {"x": {0: 0.0}}}, {"a": {"x": {0: 1.0}}, "b": {"x": {0: 1.0}}}, {"a": {"x": {0: -1.0, 1: 3.0}}}):
        with pytest.raises(ValueError):
            ht.levels(spark, bad)
    with pytest.raises(ValueError):
        ht.grown(ht.grown(TREE, 24), 24)


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ht, "FILE", 200)
    rows = [(5, f"text {i}") for i in range(100)] + [(i, "t") for i in range(100, 200)]
    ht.write_shards(table(spark, rows), TREE, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*table(spark, []).columns, "_shard"]
    assert sorted((r.doc_id, r.text, r._shard) for r in back.collect()) == sorted((i, t, brute_shard(i, TREE)) for i, t in rows)
    hot = brute_shard(5, TREE)
    assert len([f for f in (tmp_path / "out" / f"_shard={hot}").iterdir() if f.suffix == ".parquet"]) > 1
