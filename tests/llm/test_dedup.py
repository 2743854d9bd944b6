import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sablegrid.llm import exact_dedup as ed
from sablegrid.llm import simhash as sh

SCHEMA = "doc_id long, text string, lang string, kept string, h long"
SPECIAL = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "a b"), (6, "a\x0b\x0cb"), (7, "a b "), (7, "a b "), (8, "x " * 50000), (9, "A b"), (10, "a b"), (None, "a b"), (None, None), (11, "€ \U0001f600 z")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "no", 1) for i, t in rows], SCHEMA)


def brute_exact(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        keep = min((x for x in groups[n] if x is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [ed.IndexParams(), ed.IndexParams(capacity=2, max_bits=6), ed.IndexParams(capacity=2, max_bits=4, hash_bits=2)])
def test_exact_against_brute_force(spark, params):
    random.seed(3)
    rows = SPECIAL + [(100 + i, " ".join(random.choices("abc", k=random.randint(1, 3)))) for i in range(300)]
    got = [tuple(r) for r in ed.exact_dedup(table(spark, rows), params).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact(rows)


def test_hot_and_cold_copies_against_brute_force(spark):
    """Of 24,000 rows a few texts have over a thousandth, so their rows find their group by digest; all others meet
    their copies in the buckets of their owners."""
    rng = random.Random(7)
    rows = [(i, f"hot  {i % 3}") for i in range(4000)] + [(4000 + i, f"cold {rng.randrange(6000)}{' ' * rng.randrange(1, 3)}x") for i in range(20_000)]
    rng.shuffle(rows)
    got = [tuple(r) for r in ed.exact_dedup(table(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute_exact(rows)
    assert len({r[1] for r in got if 1 < r[2] < 24}) > 4000 and {r[2] for r in got if r[2] > 24} == {1333, 1334}


def test_collisions_chain(spark):
    got = ed.exact_dedup(table(spark, [(i, f"t{i}") for i in range(40)]), ed.IndexParams(hash_bits=2)).collect()
    assert all(r.kept and r.group_size == 1 for r in got) and max(r.chain for r in got) > 3


def test_exact_empty(spark):
    assert ed.exact_dedup(table(spark, [])).count() == 0


def test_directory_doubles():
    depth, slots = ed.directory({0: 5, 1: 5, 15: 1}, 6, 4)
    assert depth == 4 and len(slots) == 16 and slots[0] != slots[1] and slots[8] == slots[15]
    assert ed.directory({3: 100}, 6, 4)[0] == 4
    assert ed.directory({}, 6, 4) == (0, [(0, 0)])


def test_full_buckets_split_beyond_the_directory(spark):
    depth, slots = ed.directory({0: 900, 1: 1}, 100, 1)
    assert depth == 1 and slots == [(0, 4), (16, 0)]
    rows = [(i, f"text {i // 2}") for i in range(4000)]
    got = ed.exact_dedup(table(spark, rows), ed.IndexParams(capacity=20, max_bits=3)).collect()
    assert len({r.bucket for r in got}) > 60 and all(r.keep_id == r.doc_id // 2 * 2 and r.group_size == 2 for r in got)


def test_owners_of_buckets_decide(spark, monkeypatch):
    """Rows that the directory sends to other buckets than their key's are no copies of each other."""
    rows = table(spark, [(i, f"text {i // 2}") for i in range(4000)])
    right = ed.addressed
    monkeypatch.setattr(ed, "addressed", lambda r, *a: right(r, *a).withColumn("bucket", F.col("doc_id") % 2) if "norm" in r.columns else right(r, *a))
    assert ed.exact_dedup(rows).where("group_size = 1").count() == 4000


def test_bucket_files_are_read_by_their_owners(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("bucket"), F.col("id").alias("h"), F.lit("s").alias("sha"))
    read = ed.bucket_files(rows, 5)
    plan = read.groupBy("bucket", "h").count()
    assert plan.count() == 100 and "Exchange" not in plan._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            ids[i] = ids[ids[i]]
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choice(["th", "er", "on", "st", "re"]) + random.choice("abcdefgh") for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(300):
        w = random.choice(base).split()
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "one two"), (405, "ONE  two"), (406, "word " * 60000)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.simhash_dedup(table(spark, rows)).collect()}
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components(fps)
    assert got == {i: (f"{f:016x}", rows[c][0]) for (i, _), f, c in zip(rows, fps, comp)}


def test_large_entries_link_as_all_pairs_would(spark):
    random.seed(9)
    base = [random.getrandbits(64) for _ in range(5)]
    fps = list({b ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 9))) & (1 << 64) - 1 for b in base for _ in range(200)})
    reps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    params = sh.SimHashParams()
    got = {r.node: r.component for r in sh.components(sh.links(reps, params)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps)


@pytest.mark.parametrize("distance,segments", [(4, 3), (7, 4), (4, 5), (3, 2)])
def test_segments_cover_every_link(distance, segments):
    parts = sh.layout(distance, segments)
    assert sum(w for _, w, _ in parts) <= 64 and sum(r + 1 for *_, r in parts) == distance + 1


def test_simhash_empty(spark):
    assert sh.simhash_dedup(table(spark, [])).count() == 0


def test_spark_has_the_same_hash(spark):
    words = "The quick  brown fox\njumps over".lower().split()
    assert spark.range(1).select(F.xxhash64(F.lit(" ".join(words[:4])))).first()[0] == int(sh.shingle_hashes(sh.words("The quick  brown fox"), 4, 42).view(np.int64)[0])
