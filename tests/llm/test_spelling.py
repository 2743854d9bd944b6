import collections
import random
import re
import zlib

import numpy as np
import pytest

from sablegrid.llm import spelling as sp

SCHEMA = "doc_id long, text string, word string, n long, form string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def brute(rows, one_in=97):
    seen = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    form, count = {}, {}
    for w in n:
        of = sorted((-n[x], x) for x in n if near(w, x))
        count[w] = len(of)
        form[w] = of[0][1] if of and -of[0][0] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], count[w], form[w] and n[form[w]]) for w in n)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 7))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = [w for w in rng.choices(base, weights=[1 / (k + 1) for k in range(25)], k=60)]
        for k in range(0, 60, 4):
            w, at = words[k], rng.randrange(5)
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcéz") + w[at + 1 :], w[:at] + rng.choice("abÿ") + w[at:]])
        rows.append((i % 50, rng.choice([" ", "-", "Ā", "1"]).join(words).replace("a", rng.choice("aA"))))
    return rows


SPECIAL = [(None, None), (1, None), (2, ""), (3, "ÀÀÀÀÀ Éaaaa éaaaa ab abcd"), (None, "abcab abcab abcab abcaz"), (4, "abcab " * 5000), (4, "abcab " * 5000), (5, ("x" * 3000 + " ") * 3 + ("x" * 2999 + " ") * 7)]


@pytest.mark.parametrize("params", [sp.SpellingParams(), sp.SpellingParams(one_in=3), sp.SpellingParams(bits=1, part=10, broadcast=200)])
def test_against_brute_force(spark, params):
    rows = corpus() + SPECIAL
    want = brute(rows, params.one_in)
    assert got(sp.spelling_groups(table(spark, rows).repartition(7), params)) == want
    assert any(r[2] != r[1] for r in want if r[1]) and any(r[4] > 1 and not r[1] for r in want)


def test_empty(spark):
    assert sp.spelling_groups(table(spark, [])).count() == 0
    assert sp.spelling_groups(table(spark, [(1, None), (2, "a b c"), (3, "abcde")])).count() == 0


def test_long_chain_of_forms(spark):
    """Twenty words, each twice as frequent as the last and one letter away."""
    words = ["abcdefghijklmnopqrst"[:k].upper() for k in range(5, 17)]
    counts = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(words)], "word string, n long")
    links = sp.materialize(counts.selectExpr("word", "lead(word) over (order by n) as root").where("root is not null"), "links")
    assert {r.root for r in sp.roots(links).collect()} == {words[-1]}


def test_held_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD", 3)
    rows = corpus(8, 30)
    assert got(sp.spelling_groups(table(spark, rows))) == brute(rows)


def test_each_pair_comes_up_once():
    words = ["aaaab", "aaabb", "baaab", "aabab", "caaab"]
    alphabet = np.array(sorted(map(ord, "abc")), np.uint64)
    everything = {n: sp.laid_out(0, 1, [np.full(8, 2**64 - 1, np.uint64)]) for n in (4, 5)}
    made = [(words[i], e) for i, e in sp.edits(words, alphabet, everything)]
    assert len(made) == len(set(made)) and {e for w, e in made if w == "aaaab" and len(e) == 4} == {"aaab", "aaaa"}
    for a in words:
        for b in words:
            if a != b and sum(x != y for x, y in zip(a, b)) == 1:
                assert ((a, b) in made) + ((b, a) in made) == 1


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = random.Random(1)
    words = list({"".join(rng.choices("abcdefgh", k=rng.randint(5, 12))) for _ in range(20_000)})
    h = sp.hashes(words)
    assert len(set(h.tolist())) == len(words)
    found = sp.passing(h, sp.laid_out(0, 1, [sp.bloom(h[:10_000], 16)]))
    assert set(range(10_000)) <= set(found.tolist()) and len(found) - 10_000 < 0.01 * (len(words) - 10_000)


def test_rounds_hold_their_bound():
    params = sp.SpellingParams(part=100, broadcast=1000)
    plan = list(sp.rounds({5: (3, 300), 6: (1, 10), 9: (20, 2000)}, params))
    assert [x for own in plan for x in own] == [(n, i) for n, k in ((5, 3), (6, 1), (9, 20)) for i in range(k)]
    assert len(plan) > 5


def test_parts_are_found_in_the_round_that_has_them():
    h = sp.hashes([f"word{i}" for i in range(3000)])
    parts = [sp.bloom(h[h % np.uint64(5) == i], 16) for i in range(5)]
    here = sp.laid_out(1, 5, parts[1:3])
    assert set(np.flatnonzero((h % np.uint64(5) == 1) | (h % np.uint64(5) == 2)).tolist()) == set(sp.passing(h, here).tolist())
