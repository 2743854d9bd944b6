import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sablegrid.llm.packing import BoundedBestFit, PackParams, best_fit_pack

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World's 42 tests", None, "", "\t\n", "naïve Ångström Å Éé ß ΣΑΣ", "a\x1cb\x85c\xa0d e", "word " * 9000, "<|endoftext|>x <|EndOfText|>", "it's we'll 1234 !!! --", "End. end, END.,. e., É., 5., !., 's. a\u0301. K. İ. ..,", "Hello, World's 42 tests"]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, length int")


def check(got, texts, length):
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())) for k, a in enumerate(range(0, len(ids), length))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_pieces_are_the_tokenizers(spark):
    for length in (16, 4096):
        check(best_fit_pack(rows(spark, TEXTS), PackParams(PATH, length=length)).collect(), TEXTS, length)


def test_repeated_null_ids_and_empty(spark):
    again = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = best_fit_pack(again, PackParams(PATH)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({r.sequence_id for r in got}) == 1
    assert best_fit_pack(rows(spark, []), PackParams(PATH)).count() == 0


def test_close_to_the_lower_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = best_fit_pack(docs, PackParams(PATH)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = check(got, [texts[i] for i in range(len(texts))], 4096)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 4096) + 1


def test_best_fit_and_the_fullest_closes():
    b = BoundedBestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = BoundedBestFit(10, 2)
    assert [b.place(n)[0] for n in (6, 7, 8, 2, 3, 4)] == [0, 1, 2, 2, 0, 3]  # bin 1 was the fullest when bin 2 had to open


def brute(sizes, length, limit):
    bins, made, out = [], 0, []
    for n in sizes:
        fit = [b for b in bins if b[1] >= n]
        if fit:
            b = min(fit, key=lambda b: b[1])
        else:
            b = [made, length]
            made += 1
            if length > n:
                if len(bins) == limit:
                    bins.remove(min(bins, key=lambda x: x[1]))
                bins.append(b)
        b[1] -= n
        if b[1] == 0 and b in bins:
            bins.remove(b)
        out.append(length - b[1] - n)
    return made, out


def test_against_a_plain_best_fit():
    rng = np.random.default_rng(1)
    for limit in (1, 3, 50):
        sizes = rng.integers(1, 41, 400).tolist()
        b = BoundedBestFit(40, limit)
        got = [b.place(n) for n in sizes]
        made, _ = brute(sizes, 40, limit)
        assert abs(b.made - made) <= max(3, made // 50) and all(o + n <= 40 for (_, o), n in zip(got, sizes))
