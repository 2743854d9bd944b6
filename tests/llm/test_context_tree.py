import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from sablegrid.llm import context_tree as ct


def kt(n0, n1):
    out = 0.0
    for k in range(int(n0)):
        out += math.log((k + 0.5) / (k + 1))
    for k in range(int(n1)):
        out += math.log((k + 0.5) / (n0 + k + 1))
    return out


def test_kt_estimate():
    for a, b in ((0, 0), (1, 0), (3, 5), (0, 400), (77, 2)):
        assert ct.log_kt(a, b) == pytest.approx(kt(a, b), abs=1e-9)


def plain(texts, depth, keep):
    """The tree's bit chances by the definition, over dictionaries."""
    seen = Counter()
    for t in texts:
        padded = b"\0" * depth + t + b"\0"
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for k in range(8):
                    seen[padded[i - d : i], (1 << k) + (padded[i] >> (8 - k)), padded[i] >> (7 - k) & 1] += 1
    total = sum(len(t) + 1 for t in texts)
    least = max(1, -(-total // keep))
    n = lambda c, p: (seen[c, p, 0], seen[c, p, 1])
    there = lambda c, p: len(c) <= depth and sum(n(c, p)) >= least
    bytes_ = sorted({c[0:1] for c, *_ in seen if c})
    kids = lambda c, p: [b + c for b in bytes_ if len(c) < depth and there(b + c, p)]

    @cache
    def parts(c, p):
        own, inner = kt(*n(c, p)), kids(c, p)
        if not inner:
            return own, None
        rest = [x - sum(n(k, p)[i] for k in inner) for i, x in enumerate(n(c, p))]
        return own, sum(whole(k, p) for k in inner) + kt(*rest)

    @cache
    def whole(c, p):
        own, split = parts(c, p)
        return own if split is None else np.logaddexp(own, split) - math.log(2)

    def chance(context, p):
        """Of a one."""
        def mixed(d):
            c = context[len(context) - d :] if d else b""
            n0, n1 = n(c, p)
            own, deeper = (n1 + 0.5) / (n0 + n1 + 1), context[len(context) - d - 1 :]
            if d == depth or not there(deeper, p):
                return own
            share = math.exp(parts(c, p)[0] - math.log(2) - whole(c, p))
            return share * own + (1 - share) * mixed(d + 1)

        return mixed(0) if there(b"", p) else 0.5

    return chance


def brute_scores(docs, depth, keep):
    learn = [(i, t) for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    texts = [(t or "").encode().lower() for _, t in learn]
    chance = plain(texts, depth, keep)
    c = Counter(w for t in texts for w in [*t.split(), b""])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        raw = (t or "").encode().lower()
        words = [*raw.split(), b""]
        padded, bits = b"\0" * depth + raw + b"\0", 0.0
        for j in range(depth, len(padded)):
            for k in range(8):
                one = chance(padded[j - depth : j], (1 << k) + (padded[j] >> (8 - k)))
                bits -= math.log2(one if padded[j] >> (7 - k) & 1 else 1 - one)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(words), sum(c[w] > 0 for w in words), n, base, -bits / math.log2(10)))
    return out


@pytest.mark.parametrize("keep,frequent", [(1 << 18, 1 << 19), (40, 5)])
def test_against_the_definition(spark, keep, frequent):
    random.seed(4)
    docs = [(i, " ".join(random.choices(["the", "then", "an", "Ann", "é"], k=random.randint(1, 12)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\t\n"), (103, "THE \x00 z"), (None, "an an"), (7, docs[7][1])]
    rows = spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double")
    got = ct.lm_scores(rows, ct.TreeParams(depth=3, keep=keep, frequent=frequent)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, sorted(brute_scores(docs, 3, keep), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_chances_of_a_byte_sum_to_one():
    texts = [b"abracadabra", b"abba", b"barbara"] * 5
    key, n = np.unique(ct.grams(texts, 2)[0], return_counts=True)
    rows = Counter()
    for g, k in zip(key.tolist(), n.tolist()):
        for d in range(3):
            for b in range(8):
                rows[d, g >> 8 & (1 << 8 * d) - 1, (1 << b) + ((g & 255) >> (8 - b)), (g & 255) >> (7 - b) & 1] += k
    keys, ones = [], []
    for p in {x[2] for x in rows}:
        own = sorted({x[:2] for x in rows if x[2] == p})
        d, c = (np.array(z, np.int64) for z in zip(*own))
        ones += ct.weigh(d, c, *(np.array([rows[(*x, p, b)] for x in own], float) for b in (0, 1))).tolist()
        keys += (d << 56 | c << 8 | p).tolist()
    at = np.argsort(keys)
    keys, ones = np.array(keys)[at], np.array(ones)[at]
    for context in (b"ab", b"ra", b"zz", b"\0\0"):
        whole = (context[0] << 16 | context[1] << 8) + np.arange(256)
        assert (2 ** -ct.Coder(keys, ones, 2).bits(whole)).sum() == pytest.approx(1)


def test_beats_the_base_on_held_out_text(spark):
    got = ct.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.bits_per_byte < 8).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ct.lm_scores(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ct.lm_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.base_score == pytest.approx(0) and r.score == pytest.approx(-24 * math.log10(2))


def test_very_long_text(spark):
    text = "The old town lies by the river. " * 10_000
    rows = [(i, "by the old river" if i % 2 else None) for i in range(20)] + [(77, text)]
    r = ct.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 77").first()
    assert r.n_tokens == 70_001 and r.n_bytes == len(text) + 1 and math.isfinite(r.score) and r.score < 0


def test_rare_contexts_stay_at_any_size(spark):
    """Over 2^18 training bytes, contexts seen once were left out: scores were those of a smaller model."""
    random.seed(5)
    docs = [(i, "so it goes. " * 2500) for i in range(15)] + [(i, "".join(random.choices("abqxé ", k=60))) for i in range(20, 40)]
    assert sum(len(t.encode()) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1) > 1 << 18
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    score = lambda p: {r.doc_id: r.score for r in ct.lm_scores(rows, p).collect()}
    got = score(ct.TreeParams(depth=2))
    assert got == pytest.approx(score(ct.TreeParams(depth=2, keep=1 << 40)), rel=1e-9)
    assert got != pytest.approx(score(ct.TreeParams(depth=2, keep=1 << 18)), rel=1e-3)


@pytest.mark.parametrize("table", [1 << 21, 50, 0])
def test_parts_of_the_tree_fit_together(spark, table):
    """Depth 6, with code lengths from the broadcast table, from both, and from the join alone: contexts are dealt by their last three bytes; grams without counts get the deepest node's chance."""
    random.seed(6)
    docs = [(i, " ".join(random.choices(["the", "then", "an", "Ann", "é", "river", "rover"], k=9)) + random.choice("!?xyz")) for i in range(40)]
    got = {r.doc_id: r.score for r in ct.lm_scores(spark.createDataFrame(docs, "doc_id long, text string"), ct.TreeParams(table=table)).collect()}
    assert got == pytest.approx({r[0]: r[6] for r in brute_scores(docs, 6, 1 << 60)}, rel=1e-6)
