import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sablegrid.llm import pieces as pc
from sablegrid.llm.queries import op8_gumbel_segmentations

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  a  ", "Hello world", "naïve 😀 日本 \t x\r\n\n y", "the", "x" * 30_000, "\n", "▁ a", "a b " * 20_000, ";\r", "ÿ\x00z"]


@pytest.fixture(scope="module")
def v():
    return pc.vocabulary(PATH)


def segmentations(text, v):
    """All segmentations of a short text with their log weights."""
    s = pc.SPACE + text.replace(" ", pc.SPACE)
    pieces = {b.decode("utf-8", "replace").replace(" ", pc.SPACE): i for i, b in enumerate(v.bytes) if b and v.log[i]}
    out = []

    def go(at, ids, log):
        if at == len(s):
            out.append((tuple(ids), log))
            return
        for n in range(1, 17):
            p = s[at : at + n]
            if len(p) == n and p in pieces:
                go(at + n, [*ids, pieces[p]], log + v.log[pieces[p]])
        if s[at] not in pieces:
            raw = s[at].encode()
            go(at + 1, [*ids, *(int(v.byte_ids[b]) for b in raw)], log + v.least * len(raw))

    go(0, [], 0.0)
    return out


@pytest.mark.parametrize("text", ["the", "an a", "bé😀", "in  on", "a\nb"])
def test_probabilities_against_all_segmentations(v, text):
    every = dict(segmentations(text, v))
    whole = math.log(sum(map(math.exp, every.values())))
    got = pc.sample_block([text], [5], v, pc.SampleParams(PATH, samples=10_000))[0]
    assert {tuple(ids.tolist()) for ids, *_ in got} == set(every) and len(got) == len(every)
    for ids, log, _, inside in got:
        assert log == pytest.approx(every[tuple(ids.tolist())] - whole, abs=1e-9) and inside == 1.0
    values = [g for _, _, g, _ in got]
    assert values == sorted(values, reverse=True)


def test_first_and_second_samples_follow_the_distribution(v):
    text, n = "an on", 4000
    every = dict(segmentations(text, v))
    whole = sum(map(math.exp, every.values()))
    chance = {k: math.exp(x) / whole for k, x in every.items()}
    firsts, both = Counter(), Counter()
    for row in pc.sample_block([text] * n, [s * 7919 + 1 for s in range(n)], v, pc.SampleParams(PATH, samples=2)):
        a, b = (tuple(x[0].tolist()) for x in row)
        assert a != b
        firsts[a] += 1
        both[b] += 1
    for k, q in chance.items():
        second = sum(chance[j] * q / (1 - chance[j]) for j in chance if j != k)
        for seen, p in ((firsts[k], q), (both[k], second)):
            assert abs(seen - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_perturbed_values_are_gumbel(v):
    g = np.array([row[0][2] for row in pc.sample_block(["word"] * 3000, list(range(3000)), v, pc.SampleParams(PATH, samples=1))])
    assert abs(g.mean() - 0.5772) < 0.12 and abs(g.var() - math.pi**2 / 6) < 0.25


def table(spark, texts):
    return spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)], "doc_id long, text string, rank int, ids string")


def test_round_trip_and_order(spark, v):
    got = pc.sampled(table(spark, TEXTS), pc.SampleParams(PATH, samples=3)).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == set(range(len(TEXTS)))
    for i, own in rows.items():
        own.sort(key=lambda r: r["rank"])
        assert all(r.decoded for r in own) and len({tuple(r.ids) for r in own}) == len(own)
        assert all(a.perturbed >= b.perturbed for a, b in zip(own, own[1:])) and all(0 <= r.inclusion <= 1 for r in own)
        assert all(pc.decode(r.ids, v) == (TEXTS[i] or "").replace("▁", " ") for r in own)
    assert len(rows[0]) == len(rows[1]) == 1 and len(rows[4]) == 3


def test_same_rows_same_samples(spark):
    p = pc.SampleParams(PATH)
    one = {(r.doc_id, r["rank"]): r.ids for r in pc.sampled(table(spark, TEXTS), p).collect()}
    two = {(r.doc_id, r["rank"]): r.ids for r in pc.sampled(table(spark, TEXTS).repartition(5), pc.SampleParams(PATH, chunks=3)).collect()}
    assert one == two


def test_odd_rows(spark):
    p = pc.SampleParams(PATH)
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    got = pc.sampled(rows, p, with_ids=False).collect()
    assert len(got) == 6 and len({(str(r.doc_id), r["rank"], r.ids_crc32) for r in got}) == 4
    assert pc.sampled(rows.limit(0), p).count() == 0


def test_samples_are_those_of_the_first_form(v):
    """Kept from the form that took one text after the other."""
    rows = pc.sample_block(TEXTS, list(range(len(TEXTS))), v, pc.SampleParams(PATH, samples=2))
    assert [zlib.crc32(b"".join(x[0].astype("<u4").tobytes() for x in row)) for row in rows] == [
        0, 0, 1477368247, 3091707054, 4254156126, 2672322303, 606000190, 3339626388, 1325184343, 2847188194, 1888724796, 3222580965, 3007885677,
    ]


def test_texts_of_a_block_take_their_steps_together(v, monkeypatch):
    made, uniform = [], pc.uniform
    monkeypatch.setattr(pc, "uniform", lambda x: made.append(len(x)) or uniform(x))
    calls = []
    for n in (3, 300):
        made.clear()
        pc.sample_block(["Hello world, hello words"] * n, list(range(n)), v, pc.SampleParams(PATH))
        calls.append(len(made))
    assert calls[1] < calls[0] + 60


def test_chances_hang_on_the_chunk_alone(v):
    chunks = [" otherwise", " segmentations", "\n", " naïve"]
    together = pc.Lattice([f" word{i}" for i in range(20_000)] + chunks, v, 1.0)
    for i, chunk in enumerate(chunks, 20_000):
        alone = pc.Lattice([chunk], v, 1.0)
        a = int(together.head[together.start[i]])
        for name in ("ids", "cond", "upto"):
            assert getattr(together, name)[a : a + len(alone.ids)].tolist() == getattr(alone, name).tolist()


def test_query_gives_the_segmentations(spark, v, tmp_path):
    """The digests alone would leave out what was sampled."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_gumbel_segmentations(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(len(TEXTS)))
    for r in got:
        assert pc.decode(r.ids, v) == (TEXTS[r.doc_id] or "").replace("▁", " ")
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
