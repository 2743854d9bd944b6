import zlib

import numpy as np
from pyspark.sql import functions as F

from sablegrid.llm import quality as q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # some thousands of labels
    got = q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 400 and (got.predicted == got.quality).mean() > 0.99
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_accepted_is_what_is_predicted(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    want = q.quality_scores(docs, labels).where("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in want.collect())


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (1, "", 0.1), (2, "x " * 100_000, 0.1), (None, "a b", 0.1), (3, "\n", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labels in ([], [(2, 1), (2, 0), (3, 0), (None, 1), (1, None), (1, 5)]):
        got = q.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert q.quality_scores(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_remainder_is_crc32(spark):
    got = spark.range(50).select("id", q.remainder(F.col("id")).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_a_pair_learns_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x, y, q.GamParams(rounds=20, pairs=1))
    assert model.pairs == [(0, 1)] and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    m = q.fit(x, (x[:, 0] > 0.4).astype(float), q.GamParams(rounds=5, pairs=2, pair_rounds=3))
    for row, s in zip(x[:20], m.score(x[:20])):
        z = m.base + sum(t[sum(row[j] >= e for e in es)] for j, (es, t) in enumerate(zip(m.edges, m.tables)))
        z += sum(g[sum(row[i] >= e for e in m.pair_edges[i]), sum(row[j] >= e for e in m.pair_edges[j])] for (i, j), g in zip(m.pairs, m.grids))
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12


def test_accepted_keeps_odd_columns(spark):
    rows = [(2**60 + 1, "a b c", None, 5), (None, None, 2**61 + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(tuple, q.accepted(docs, labels).collect()), key=str) == sorted(rows, key=str)
