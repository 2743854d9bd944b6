"""Grouping of spelling variants: edits that Bloom filters of the vocabulary let through, joined to it exactly."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, discard, materialize

RUN = r"[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: A word's hash is the sum of its code points times powers of BASE, so that an edit's hash follows from sums alone.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: A filter has blocks of 512 bits; a key sets PROBES bits of one block.
PROBES = 6
#: Edits that are hashed at once, and words that a counting task holds before it hands its counts on.
EDITS, HELD = 1 << 20, 200_000


@dataclass(frozen=True)
class SpellingParams:
    """least_length, least_count: what makes a run a word. ratio: a form occurs at least so many times as often as the
    word. one_in: of the run's occurrences, those of a document lose a code point if this divides their hash (0: never).
    bits: of the filters, for each key. part: keys of a filter about; a length has as many filters as its words need.
    broadcast: bytes of filters that are sent to the tasks at once; more are probed in further rounds."""

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    one_in: int = 97
    bits: int = 16
    part: int = 4096
    broadcast: int = 64 << 20


def words_of(doc_id: str | None, text: str | None, run: re.Pattern, params: SpellingParams) -> Iterator[tuple[str, int]]:
    """The words of one text with their counts; the same word may come more than once."""
    prefix = zlib.crc32(f"{doc_id or ''}:".encode())
    for raw, n in Counter(run.findall(text or "")).items():
        word = raw.translate(LOWER)
        if params.one_in and not (h := zlib.crc32(word.encode(), prefix)) % params.one_in:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < params.least_length:
                continue
        yield word, n


def vocabulary(docs: DataFrame, params: SpellingParams) -> DataFrame:
    """Words and how often they occur: (word, n). Counts are added up in each task before the shuffle."""
    run = re.compile(RUN.replace("+", f"{{{params.least_length},}}"))  # shorter runs have no word, and deletions only shorten

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        give = lambda: pd.DataFrame({"word": pd.Series(list(held), dtype="object"), "n": pd.Series(list(held.values()), dtype="int64")})
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                for word, n in words_of(doc_id, text, run, params):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield give()
                    held.clear()
        yield give()

    # the id as text: pandas would make a column with nulls one of floats
    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least_count)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of sums over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """Hashes of words of any lengths."""
    out = np.zeros(len(words), np.uint64)
    for n, own in by_length(words):
        c = codes([words[i] for i in own])
        out[own] = mixed((c * powers(n)).sum(axis=1, dtype=np.uint64))
    return out


def by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for n, own in groupby(order, key=lambda i: len(words[i])):
        yield n, list(own)


def spot(h: np.ndarray, blocks: np.ndarray | np.uint64, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one probe, the filter's 64-bit words and the bit in each."""
    first = ((h >> np.uint64(32)) * blocks >> np.uint64(32)) * np.uint64(8)
    g = h * np.uint64(0xD6E8FEB86659FD93)
    at = (g ^ g >> np.uint64(32)) >> np.uint64(9 * probe) & np.uint64(511)
    return (first + (at >> np.uint64(6))).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def bloom(h: np.ndarray, bits: int) -> np.ndarray:
    """A blocked Bloom filter of these hashes."""
    blocks = max(1, -(-len(h) * bits // 512))
    out = np.zeros(blocks * 8, np.uint64)
    for i in range(PROBES):
        np.bitwise_or.at(out, *spot(h, np.uint64(blocks), i))
    return out


@dataclass(frozen=True)
class Filters:
    """Filters of one length, from part `first` of `of` on, end to end: where each begins and its number of blocks."""

    first: int
    of: int
    begin: np.ndarray
    blocks: np.ndarray
    bits: np.ndarray


def laid_out(first: int, of: int, filters: list[np.ndarray]) -> Filters:
    ends = np.cumsum([0, *(len(f) for f in filters)])
    return Filters(first, of, ends[:-1], np.diff(ends).astype(np.uint64) // np.uint64(8), np.concatenate(filters))


def passing(h: np.ndarray, of: Filters) -> np.ndarray:
    """Places of the hashes that are in their filter, if that is one of these."""
    part = (h % np.uint64(of.of)).astype(np.int64) - of.first
    left = np.flatnonzero((part >= 0) & (part < len(of.begin)))
    for probe in range(PROBES):  # nearly all others fail at the first or second
        word, bit = spot(h[left], of.blocks[part[left]], probe)
        left = left[of.bits[of.begin[part[left]] + word] & bit != 0]
    return left


def edits(words: list[str], alphabet: np.ndarray, filters: dict[int, Filters]) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) for the deletions and replacements that pass; all words have one length.

    Insertions are the deletions of the longer word, and of two words that differ by a replacement the one with the
    lower code point makes it. Of a run of equal code points the first alone is deleted. So a pair comes up once.
    """
    length = len(words[0])
    power = powers(length)
    step = max(1, EDITS // (length * (len(alphabet) + 1)))
    for lo in range(0, len(words), step):
        c = codes(words[lo : lo + step])
        terms = c * power
        total = terms.sum(axis=1, dtype=np.uint64)
        if length - 1 in filters:
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            h = before + (total[:, None] - before - terms) * np.uint64(BACK)
            row, at = np.nonzero(np.concatenate([np.ones((len(c), 1), bool), c[:, 1:] != c[:, :-1]], axis=1))
            for k in passing(mixed(h[row, at]), filters[length - 1]):
                w = words[lo + row[k]]
                yield lo + row[k], w[: at[k]] + w[at[k] + 1 :]
        if length in filters:
            wide = max(1, EDITS // (len(c) * len(alphabet)))
            for left in range(0, length, wide):
                own = c[:, left : left + wide]
                row, at, to = np.nonzero(alphabet[None, None, :] > own[:, :, None])
                h = total[row] + (alphabet[to] - own[row, at]) * power[left + at]
                for k in passing(mixed(h), filters[length]):
                    w, i = words[lo + row[k]], left + at[k]
                    yield lo + row[k], w[:i] + chr(alphabet[to[k]]) + w[i + 1 :]


def rounds(of: dict[int, tuple[int, int]], params: SpellingParams) -> Iterator[list[tuple[int, int]]]:
    """The filters (length, part) of each round. of: by length, its filters and its words."""
    held, own = 0, []
    for length, (parts, n) in sorted(of.items()):
        size = -(-n // parts) * params.bits // 8 + 64
        for i in range(parts):
            if own and held + size > params.broadcast:
                yield own
                held, own = 0, []
            held, own = held + size, [*own, (length, i)]
    if own:
        yield own


def near_words(vocab: DataFrame, params: SpellingParams) -> DataFrame:
    """Pairs of words (a, n_a, b, n_b) one code point apart, each once. vocab is a written table of (word, n).

    A round has filters of params.broadcast bytes at most. Its tasks make the edits of the words whose length, or the
    one below, has a filter in it; what passes is shuffled to the vocabulary, which says what is a word.
    """
    spark, bits = vocab.sparkSession, params.bits
    sizes = {r[0]: r[1] for r in vocab.groupBy(F.length("word")).count().collect()}  # a row for each length
    parts = {n: max(1, -(-k // params.part)) for n, k in sizes.items()}
    letters = [ord(r[0]) for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()]  # 90 at most
    alphabet = np.array(sorted(letters), np.uint64)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = frame["word"].tolist()
            h, length = hashes(words), np.array([len(w) for w in words], np.int64)
            of = np.array([parts[n] for n in length], np.uint64)
            yield pd.DataFrame({"length": length, "part": (h % of).astype(np.int64), "h": h.view(np.int64)})

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"length": [key[0]], "part": [key[1]], "bits": [bloom(frame["h"].to_numpy().view(np.uint64), bits).tobytes()]})

    keys = vocab.mapInPandas(keyed, "length long, part long, h long")
    filters = materialize(keys.groupBy("length", "part").applyInPandas(build, "length long, part long, bits binary"), "filters")
    found = []
    for own in rounds({n: (parts[n], k) for n, k in sizes.items()}, params):
        (n, i), (m, j) = own[0], own[-1]
        rows = filters.where(f"(length > {n} or length = {n} and part >= {i}) and (length < {m} or length = {m} and part <= {j})")
        got = {(r.length, r.part): np.frombuffer(r.bits, np.uint64) for r in rows.toLocalIterator()}  # params.broadcast bytes at most
        empty = np.zeros(8, np.uint64)  # a part that no word fell into
        sent = {n: [i for m, i in own if m == n] for n in dict.fromkeys(m for m, _ in own)}
        shared = spark.sparkContext.broadcast({n: laid_out(i[0], parts[n], [got.get((n, x), empty) for x in i]) for n, i in sent.items()})

        def probe(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                words, n = frame["word"].tolist(), frame["n"].to_numpy()
                for length, at in by_length(words):
                    if length in shared.value or length - 1 in shared.value:
                        got = [(at[i], e) for i, e in edits([words[i] for i in at], alphabet, shared.value)]
                        if got:
                            who = [i for i, _ in got]
                            yield pd.DataFrame({"a": [words[i] for i in who], "n_a": n[who], "b": [e for _, e in got]})

        dealt = vocab.repartition("word")  # a small table may be one file
        found.append(materialize(dealt.mapInPandas(probe, "a string, n_a long, b string"), "edits"))
        shared.destroy()
    discard(filters)
    none = vocab.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b")).where("false")
    passed = reduce(DataFrame.unionByName, found, none)
    return passed.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a written table of links (word, root): every step doubles how far a word has come. A root with
    very many words is spread over the tasks."""
    while True:
        total, n = links.count(), links.groupBy("root").agg(F.count(F.lit(1)).alias("k"))
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next")).join(n, "root")
        if step.isEmpty():
            return links
        moved = attach(links, step, ["root"], "k", total, "left").select("word", F.coalesce("next", "root").alias("root"))
        before, links = links, materialize(moved, "roots")
        discard(before)


def spelling_groups(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of whole texts, lower-cased in A-Z, of at least five code points and three
    occurrences; of a document's occurrences whose hash 97 divides, one code point is deleted first. Words are near if
    one inserted, deleted or replaced code point makes them equal. A word's form is its near word of largest n, of
    equal n the smallest in code-point order, if that occurs at least twice as often; root follows forms to the last.

    A null text has no words; a null doc_id is empty in the hash; rows that repeat count each. Texts and words of any
    length are taken whole, an empty table gives an empty one, other columns are not looked at.
    """
    vocab = materialize(vocabulary(docs, params), "vocabulary")
    pairs = near_words(vocab, params)
    side = lambda w, f: F.struct(F.col(w).alias("word"), F.struct((-F.col(f"n_{f}")).alias("n"), F.col(f).alias("form")).alias("best"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n_near"))
    formed = vocab.join(best, "word", "left").withColumn("far", -F.col("best.n") >= params.ratio * F.col("n"))
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("far"), F.col("best.form")).alias("form"), F.when(F.col("far"), -F.col("best.n")).alias("form_n"))
    formed = materialize(formed, "forms")
    last = roots(materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "links"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
