import itertools

import numpy as np
import pytest

from sablegrid.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, label int, leaf int"


def brute(rows, k, every=100):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out[i] = [(j, s) for s, j in d]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, have = brute(rows, 10), got(nn.nearest(table))
    assert want.keys() == have.keys() and all(len(have[i]) == 10 for i in have)
    exact = dict(rows)
    for i, near in have.items():
        for j, s in near:
            assert s == pytest.approx(float(np.sqrt(((np.array(exact[i], float) - np.array(exact[j], float)) ** 2).sum())), rel=1e-12)
    hits = sum(len({j for j, _ in want[i]} & {j for j, _ in have[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("queries", [8192, 2])
def test_hot_vector_and_blocks(spark, queries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist() if i % 3 else [1.0, 2.0, 3.0, 4.0], 0, 0) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    p = nn.TreeParams(sample=300, leaf=20, recall=1.0, block=50, queries=queries)
    want, have = brute([(r.vec_id, r.embedding) for r in table.collect()], 10), got(nn.nearest(table, p))
    assert want.keys() == have.keys()
    for i in want:
        if i % 3 == 0:  # 199 others tie at distance zero
            assert have[i] == want[i]
    hits = sum(len({j for j, _ in want[i]} & {j for j, _ in have[i]}) for i in want)
    assert hits >= 0.9 * 10 * len(want)


def test_odd_rows(spark):
    bad = [(0, None), (100, [0.0, 0.0]), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    some = [(500, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (600, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in bad + some], SCHEMA)
    assert got(nn.nearest(table)) == {500: [(2, 0.0), (2, 0.0), (1, 1.0)]}
    assert nn.nearest(table.limit(0)).count() == 0
    assert nn.nearest(table.where("vec_id = 500")).count() == 0


def test_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i // 100 % 90).tolist(), 0, 0) for i in range(0, 9000, 50)] + [(9001 + i, rng.normal(size=40).tolist(), 0, 0) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    want, have = brute([(r.vec_id, r.embedding) for r in table.collect()], 10), got(nn.nearest(table, nn.TreeParams(block=64, queries=1)))
    tree = {3800, 9100, 9200, 9300, 9400}  # of the one length that many have
    assert have.keys() == want.keys() and all([j for j, _ in have[i]] == [j for j, _ in want[i]] for i in want.keys() - tree)


def test_trees_prune(spark):
    """Vectors in clusters: a query reads few of them and finds nearly all of its neighbours."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 32)) * 3
    x = centres[rng.integers(0, 400, 20_000)] + rng.normal(size=(20_000, 32))
    p = nn.TreeParams(sample=5000)
    tree = nn.fit(x[:5000], p)
    leaf = tree.leaf(x)
    near = [j for _, j, _ in nn.closest(x[:100], x, np.arange(len(x)), np.arange(100), 10)]
    visits = nn.widen(tree, x[:100], [leaf[j] for j in near], 0.94)
    held = np.bincount(leaf, minlength=tree.leaves)
    asked = range(100, 300)
    orders = [list(itertools.islice(tree.best_bins(x[i]), visits)) for i in asked]
    want = [j for _, j, _ in nn.closest(x[100:300], x, np.arange(len(x)), np.arange(100, 300), 10)]
    assert np.mean([held[o].sum() for o in orders]) < 0.1 * len(x)
    assert np.mean([np.isin(leaf[j], o).mean() for j, o in zip(want, orders)]) >= 0.9


def test_walk_reaches_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 8))
    t = nn.fit(x, nn.TreeParams(leaf=10))
    order = list(t.best_bins(x[0]))
    assert sorted(order) == list(range(t.leaves)) and order[0] == t.leaf(x[:1])[0]
