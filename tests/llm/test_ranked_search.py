import collections
import math
import random
import re

import numpy as np
import pytest

from sablegrid.llm import ranked_search as rs

DOCS = "doc_id long, text string, q int, score long, rank string"
ITEMS = "item_id long, text string, doc_id long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], ITEMS)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    of = [(i, collections.Counter(terms(t))) for i, t in docs]
    of = [(i, c) for i, c in of if c]
    n, total = len(of), sum(sum(c.values()) for _, c in of)
    df = collections.Counter(t for _, c in of for t in c)
    out = []
    for item, text in items:
        mine, scores = set(terms(text)), []
        for i, c in of:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in mine if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "\U0001f600", "x-y", "Zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(n)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(25)]
    return docs, items


SPECIAL = [(None, "w1 w2 w50"), (900, None), (901, ""), (902, "., -"), (903, "w50 W50 w51"), (903, "w50 W50 w51"), (904, "w40 " * 100_000), (905, "été ÉTÉ \x00w55\x7f")]


@pytest.mark.parametrize(
    "params", [rs.SearchParams(), rs.SearchParams(block=16, span=4, lead=3), rs.SearchParams(k=3, block=50, span=8, near=5, lead=1), rs.SearchParams(block=7, span=2, near=0, postings=30, round=200)]
)
def test_against_brute_force(spark, params):
    docs, items = corpus(4)
    docs += SPECIAL + [(2000 + i, docs[5][1]) for i in range(40)]  # many equal scores
    items += [(None, "w1"), (7, None), (8, ""), (9, "zzz nowhere"), (3, "w1 w1 W1"), (3, "w1 w2"), (50, docs[5][1])]
    assert got(rs.ranked(docs_of(spark, docs).repartition(3), items_of(spark, items), params)) == brute(docs, items, params.k)


def test_empty(spark):
    docs, items = corpus(1, 5)
    assert rs.ranked(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert rs.ranked(docs_of(spark, docs), items_of(spark, [])).count() == 0
    assert rs.ranked(docs_of(spark, docs), items_of(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.fixture(scope="module")
def opened(spark):
    """Blocks of an index as a task has them, and the queries: (least score, terms, pairs)."""
    rng, params = random.Random(9), rs.SearchParams(block=1000, span=64, near=6)
    rare = [f"r{i}" for i in range(40)]
    # every document has one half of the words: terms of the other half never meet them
    docs = [(i, " ".join(rng.choices(rare[:20] if i % 2 else rare[20:], k=rng.randint(5, 30)) + ["common"] * (i % 3))) for i in range(3000)]
    items = [(i, " ".join(["common", *rng.sample(rare, 6)])) for i in range(20)]
    kept = []
    rs.ranked(docs_of(spark, docs).coalesce(1), items_of(spark, items), params, follow=lambda index: kept.extend(index.toPandas().itertuples(index=False)))
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, text in items for t in dict.fromkeys(terms(text))))}
    of = {i: [number[t] for t in dict.fromkeys(terms(text))] for i, text in items}
    every = {p: k for k, p in enumerate(sorted({(a, b) for ids in of.values() for a in ids for b in ids if a < b}))}  # near=6 pairs all seven terms
    least = {item: score for item, rank, _, score in brute(docs, items) if rank == 10}
    return [rs.Block(b, params.span) for b in kept], [(least[i], ids, [(every[a, b], a, b) for a in ids for b in ids if a < b]) for i, ids in of.items()]


def test_pairs_hold_their_joint_maxima_and_bound_every_document(opened):
    blocks, queries = opened
    assert len(blocks) == 3
    for block in blocks:
        impact = {t: dict(zip(*(x.tolist() for x in block.list(place)), strict=True)) for t, place in block.place.items()}
        for _, ids, pairs in queries[:5]:
            for p, a, b in pairs:
                both = collections.defaultdict(int)
                for d in impact[a].keys() & impact[b].keys():
                    both[d // block.span] = max(both[d // block.span], impact[a][d] + impact[b][d])
                assert [both[i] for i in range(block.spans)] == (block.pair_max[block.pair_place[p]].tolist() if p in block.pair_place else [0] * block.spans)
            of = rs.groups(block, ids, pairs)
            assert sorted(t for g, _ in of for t in g) == sorted(block.place[t] for t in ids) and max(len(g) for g, _ in of) == 2
            bound = np.sum([b for _, b in of], axis=0)
            assert all(sum(impact[t].get(d, 0) for t in ids) <= bound[d // block.span] for d in range(len(block.ids)))


def test_joint_bounds_read_fewer_postings_and_lose_nothing(opened):
    """With joint maxima of pairs, bounds are lower than with those of terms alone, and the same documents are found."""
    blocks, queries = opened
    read, low = {False: [], True: []}, {False: 0, True: 0}
    for least, ids, pairs in queries:
        for block in blocks:
            found = {}
            for joined in (False, True):
                of = rs.groups(block, ids, pairs, joined)
                low[joined] += int(np.sum([b for _, b in of]))
                found[joined] = [x.tolist() for x in rs.best_of(block, of, least, read[joined])]
            docs, score = rs.best_of(block, rs.groups(block, ids, [], False), 0)
            assert found[True] == found[False] == [docs[score >= least].tolist(), score[score >= least].tolist()]
            assert not block.score.any()
    assert low[True] < 0.8 * low[False] and sum(read[True]) < sum(read[False])


def test_spans():
    assert rs.span_max(np.array([0, 1, 5, 11]), np.array([3, 4, 2, 9]), 4, 4).tolist() == [4, 2, 9, 0]
    assert rs.span_max(np.zeros(0, np.int32), np.zeros(0, np.int64), 2, 4).tolist() == [0, 0]
