import itertools
import random
import re

import numpy as np

from sablegrid.llm import skip_chain as sc

CONTRACT = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    text, out = text or "", []
    for k, p in enumerate(CONTRACT):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and sc.luhn(d), 10 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "plain words", "mail a.b+c@mail1.example.com, x@y @z.com a@b.c@d.e", "ip 1.2.3.4 1.2.3.4.5.6.7.8 999.1.1.1 256.1.1.1 001.002.003.004", "4795326016703902 4795 3260 1670 3902 4795-3260-1670-3902 4795326016703903",
    "+1 (569) 555-6633 4795326016703902 53.121.55.90", "+1 (569) 555-6633 then (569) 555-6633 again", "é€😀 a@b.cd +49 30 1234567", "+ +1 +12 +1234567890123456789", "1" * 50_000, "a" * 50_000 + "@", "@" * 5000, "1.2." * 20_000, "+1" + " " * 20_000,
]


def test_base_spans_are_those_of_the_contract():
    for t in TEXTS:
        if t is None or len(t) < 1000:
            assert sc.base_spans(t or "") == brute(t)
    random.seed(1)
    for _ in range(3000):
        t = "".join(random.choice("1234567890 ..+-@aB().%") for _ in range(random.randint(1, 60)))
        assert sc.base_spans(t) == brute(t), t


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, base int, spans string")


def test_query_rows(spark):
    got = {r.doc_id: r for r in sc.find_entities(table(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert [(s.start, s.kind, s.end) for s in got[i].spans if s.base] == sc.base_spans(t or "")


def test_like_tokens_take_the_label(spark):
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now" + f" or +1 ({200 + i}) 555-{1000 + i}" * (i % 2) for i in range(60)] + [f"in {1900 + i} we had {i} of 12,{i:03d} and ({i}) 3.5" for i in range(60)]
    texts += ["call +1 (569) 555-6633 or later (569) 555-6633 again in 1999"]
    got = {r.doc_id: r.spans for r in sc.find_entities(table(spark, texts)).collect()}
    added = [(s.start, s.kind, s.end) for s in got[120] if not s.base]
    assert added == [(texts[120].index("(569)", 20), 3, texts[120].rindex("6633") + 4)]
    assert not any(got[i] for i in range(60, 120))
    # the link alone tells it: without skip potentials nothing is added
    pairs = [(sc.tokens(t), sc.base_spans(t)) for t in texts]
    w = sc.fit(sc.graph(pairs), sc.FieldParams())
    assert any(sc.added_spans(pairs, w, sc.FieldParams())) and not any(sc.added_spans(pairs, sc.Weights(w.node, w.chain, 0 * w.skip), sc.FieldParams()))


def test_base_spans_stay_and_documents_without_tokens_get_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in sc.find_entities(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        base = sc.base_spans(r.text)
        assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == base
        labelled = {k for t in sc.tokens(r.text) for k in t[3] if any(a < t[1] and b > t[0] for a, _, b in base)}
        for s in r.spans:  # numbers of licenses, hashes and cards with a wrong digit are none, unless they repeat a found one
            assert s.base or any(s.start <= t[0] < s.end and labelled & set(t[3]) for t in sc.tokens(r.text))


def test_numbers_like_labelled_ones_need_a_link(spark):
    """A card number with a wrong digit fails the pattern and stays out."""
    rng = random.Random(3)
    good = [n for n in (str(rng.randrange(10**15, 10**16)) for _ in range(3000)) if sc.luhn(n)]
    bad = [n for n in (str(rng.randrange(10**15, 10**16)) for _ in range(60)) if not sc.luhn(n)]
    texts = [f"paid with {n} on day {i} of {1900 + i % 120}" for i, n in enumerate(good[:200])] + [f"paid with {n} on day {i} of 1999" for i, n in enumerate(bad)]
    got = {r.doc_id: r.spans for r in sc.find_entities(table(spark, texts)).collect()}
    assert not any(got[200 + i] for i in range(len(bad))) and all(len(got[i]) == 1 for i in range(200))


def test_hidden_labels_are_recovered_through_links(spark, sf):
    """Some base labels are hidden; what the field says of their tokens is held against them, with links and without."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[0-9@]'")
    g = sc.graph([(sc.tokens(r.text), sc.base_spans(r.text)) for r in docs.collect()])
    w = sc.fit(g, sc.FieldParams())
    hidden = (np.random.default_rng(2).random(len(g.y)) < 0.3) & (g.y > 0)
    held, right = sc.Graph(g.x, np.where(hidden, 0, g.y), g.chain, g.skip), []
    for skip in (w.skip, 0 * w.skip):
        q = sc.marginals(held, sc.Weights(w.node, w.chain, skip), 12)
        said = (q.max(1) >= 0.9) & (q.argmax(1) > 0) & hidden
        assert ((q.argmax(1) == g.y) & said).sum() >= 0.98 * said.sum()
        right.append(int(said.sum()))
    assert hidden.sum() > 20 and right[0] >= right[1] and right[0] >= 0.75 * hidden.sum()


def test_labels_reach_far_repeats():
    text = "x 555-1234567 " * 500
    g = sc.graph([(sc.tokens(text), [(2, 3, 13)])])
    w = sc.Weights(np.zeros((sc.FEATURES, sc.LABELS)), np.zeros((sc.LABELS,) * 2), 4 * np.eye(sc.LABELS))
    assert len(g.y) == 500 and (g.y > 0).sum() == 1 and (sc.marginals(g, w, 12)[:, 4] > 0.9).all()


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(5)
    w = sc.Weights(rng.normal(size=(sc.FEATURES, sc.LABELS)), rng.normal(size=(sc.LABELS,) * 2), (lambda a: a + a.T)(rng.normal(size=(sc.LABELS,) * 2)))
    x = (rng.random((5, sc.FEATURES)) < 0.3).astype(np.float32)
    g = sc.Graph(x, np.array([0, 0, 3, 0, 0]), np.array([(0, 1), (1, 2)]), np.array([(1, 3), (2, 4)]))
    got, want = sc.marginals(g, w, 80), np.zeros((5, sc.LABELS))
    for y in itertools.product(range(sc.LABELS), repeat=5):
        if y[2] == 3:
            z = sum(x[i] @ w.node[:, y[i]] for i in (0, 1, 3, 4)) + sum(w.chain[y[a], y[b]] for a, b in g.chain) + sum(w.skip[y[a], y[b]] for a, b in g.skip)
            for i in range(5):
                want[i, y[i]] += np.exp(z)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_edges_grow_with_tokens():
    g = sc.graph([(sc.tokens("a1 " * 2000), [])])
    assert len(g.x) == 2000 and len(g.skip) + len(g.chain) < 2 * 2000


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a@b.cd"), (1, None), (None, "a@b.cd a@b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), len([s for s in r.spans if s.base])) for r in sc.find_entities(rows).collect()) == [("1", 0), ("1", 1), ("None", 1)]
    assert sc.digest(sc.find_entities(rows.limit(0))).count() == 0


def test_very_long_text(spark):
    text = "x 555-1234567 and +49 30 1234567, " * 20_000 + "é a@b.cd"
    (r,) = sc.find_entities(table(spark, [text])).collect()
    assert [(s.start, s.kind, s.end) for s in r.spans if s.base] == sc.base_spans(text) and len(r.spans) >= 20_001
