import random
import re

import pytest

import corpus_pipeline as cp
from sablegrid.llm import packing, quality, queries, secrets, simhash


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")


def made():
    random.seed(2)
    words = [a + b for a in ("th", "er", "on", "st", "re", "in") for b in ("a", "ed", "ing", "ly", "en")]
    base = [[random.choice(words) for _ in range(400)] for _ in range(8)]
    rows = []
    for i in range(60):
        w = list(base[i % 8])
        for _ in range(i // 8 % 3):
            w[random.randrange(400)] = "other"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(random.choice(words) for _ in range(300))) for i in range(20)]
    return rows + [(200, None), (201, ""), (202, "short text")]


def test_near_copies_against_brute_force(spark):
    rows = made()
    kept = {r.doc_id for r in simhash.near_dedup(table(spark, rows)).collect()}
    text = dict(rows)
    ids = sorted(text)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and jaccard(text[a], text[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    for r, own in groups.items():
        assert r in kept
        if len(own) == 1:
            assert own[0] in kept
    assert kept == set(groups)


def roots_of(text):
    """The smallest id of each id's group, from all pairs."""
    ids = sorted(text)
    sets, root = {i: shingles(text[i]) for i in ids}, {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def far_pairs(rng, new, n=25):
    """Isolated pairs of similar texts whose fingerprints are further apart than the candidates' distance."""
    out = []
    print_of = lambda w: simhash.fingerprint(simhash.shingle_hashes(simhash.words(" ".join(w)), 5, 42))
    while len(out) < n:
        a = [new() for _ in range(60)]
        b = list(a)
        b[rng.randrange(60)] = new()
        if jaccard(" ".join(a), " ".join(b)) >= 0.8 and ((print_of(a) ^ print_of(b)) & (1 << 64) - 1).bit_count() > 10:
            out.append((" ".join(a), " ".join(b)))
    return [t for pair in out for t in pair]


def test_every_similar_pair_is_linked(spark):
    rng = random.Random(11)
    new = lambda: f"w{rng.randrange(10**9)}"
    texts = far_pairs(rng, new)
    # one hub, many that are close to it in the fingerprint but below the similarity, in pairs that are above
    hub = [new() for _ in range(400)]
    texts.append(" ".join(hub))
    for _ in range(40):
        one = list(hub)
        for at in rng.sample(range(0, 400, 6), 14):
            one[at] = new()
        two = list(one)
        two[3] = new()
        texts += [" ".join(one), " ".join(two)]
    # one repeated line makes all fingerprints equal, the sets differ
    line = [new() for _ in range(7)] * 60
    for _ in range(20):
        tail = [new() for _ in range(60)]
        texts += [" ".join(line + tail), " ".join(line + tail[:-2])]
    # a common passage in texts that are else unlike
    passage = [new() for _ in range(40)]
    texts += [" ".join(passage + [new() for _ in range(40)]) for _ in range(60)]
    rng.shuffle(texts)
    text = dict(enumerate(texts))
    kept = {r.doc_id for r in simhash.near_dedup(table(spark, list(text.items()))).collect()}
    assert kept == {i for i, r in roots_of(text).items() if i == r}


def large_group(spark, n):
    """Pairs of texts that share bands, above the similarity within a pair and mostly below it between pairs."""
    rng = random.Random(5)
    new = lambda: f"w{rng.randrange(10**9)}"
    base, texts = [new() for _ in range(200)], []
    for _ in range(n):
        one = list(base)
        for at in rng.sample(range(0, 200, 6), 4):
            one[at] = new()
        two = list(one)
        two[3] = new()
        texts += [" ".join(one), " ".join(two)]
    text = dict(enumerate(texts))
    kept = {r.doc_id for r in simhash.near_dedup(table(spark, list(text.items()))).collect()}
    assert kept == {i for i, r in roots_of(text).items() if i == r} and 0 < len(kept) < n


def test_large_groups_lose_no_link(spark):
    large_group(spark, 600)


def test_large_bands_are_cut_both_ways(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    large_group(spark, 60)


def test_long_half_alike_sets_are_ruled_out_without_loss():
    """A family of long sets at 0.6 to each other: bitmaps that grow with the sets leave few pairs to compare."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(-(2**63), 2**63 - 1, n)
    common, sets = new(3000), []
    for n in (1000,) * 40:
        sets.append(np.unique(np.concatenate([common, new(n)])))
    for i in range(10):  # above the similarity to one of the family, in both directions over a power of two of elements
        sets.append(np.unique(np.concatenate([sets[i], new(200 + 80 * i)])))
        sets.append(sets[i][: -100 * (i + 1)] if i % 2 else sets[i][400:])
    sets += [new(50), np.unique(new(2500))]
    frame = pd.DataFrame({"rep": range(len(sets)), "size": [len(x) for x in sets], "bits": [simhash.sketch(x)[1] for x in sets]})
    s = simhash.Sketches(frame, 0.8)
    assert {len(b) * 8 for b in frame["bits"]} >= {2048, 4096, 8192}
    i, j = np.triu_indices(len(sets), 1)
    admitted = s.admit(i, j)
    alike = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]) >= 0.8
    assert alike.sum() >= 20 and admitted[alike].all() and admitted[~alike].sum() < 0.05 * (~alike).sum()


def test_near_dedup_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(None, "a b"), (None, None), (1, None), (2, ""), (3, " \t"), (4, long), (5, long + " end"), (6, "x y"), (6, "x y"), (6, "other words are here now"), (7, "x y")]
    kept = [r.doc_id for r in simhash.near_dedup(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == [1, 4, 6, 6, 6, None, None]
    assert simhash.near_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_stages_return_the_columns_they_get(spark, sf, k):
    docs = table(spark, [*made(), (300, "token=abcdefghijklmnop in it"), (300, "token=abcdefghijklmnop in it")])
    out = cp.STAGES[k][1](spark, docs, sf)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
    assert cp.STAGES[k][1](spark, docs.limit(0), sf).count() == 0


def test_last_stage_of_odd_rows(spark, sf):
    docs = table(spark, [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "word " * 9000)])
    out = cp.STAGES[4][1](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "1", "2", "2", "2", "None"] and sum(r.length for r in out if r.doc_id == 2) == 9001
    assert cp.STAGES[4][1](spark, docs.limit(0), sf).count() == 0


def test_whole_pipeline_against_its_stages_by_hand(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(source, labels).where("predicted = 1").collect()}
    seen, exact = set(), set()
    for i in sorted(good):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", docs[i].text or "")
        if t not in seen:
            seen.add(t)
            exact.add(i)
    out = cp.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    assert kept == {i for i, r in roots_of({i: docs[i].text for i in exact}).items() if i == r} and len(kept) > 300
    # what is packed are the texts without their secrets
    redacted = {r.doc_id: r.text for r in cp.STAGES[3][1](spark, source, sf).collect()}
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(source).collect()}
    encode, packed = packing.Encoder(queries.word_tokenizer()), {}
    for r in out:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    some = [i for i in sorted(kept) if spans[i]]
    assert len(some) > 5 and all("[SECRET]" in redacted[i] and docs[i].text[s.start : s.end] not in redacted[i] for i in some for s in spans[i])
    assert all(packed[i] == len(encode([redacted[i]])[0]) // 4 + 1 for i in kept)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
