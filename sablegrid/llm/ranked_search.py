"""Ranked search over blocks of documents: MaxScore whose bounds of terms are tightened by joint bounds of pairs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import discard, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Ids of documents without one, in a block.
NO_ID = np.iinfo(np.int64).max

BLOCK = "ids binary, nulls binary, n binary, terms array<int>, df array<int>, starts binary, docs binary, tf binary, n_docs long, n_terms long, lead boolean"
INDEX = "ids binary, nulls binary, terms binary, starts binary, docs binary, impact binary, term_max binary, pairs binary, pair_max binary, lead boolean"
HIT = "q int, doc_id long, score long"


@dataclass(frozen=True)
class SearchParams:
    """k: documents of an item. block: documents of a block, postings: of a block, about; span: documents that share a
    bound. near: a term is paired with so many that follow it by weight. round: bytes of items' texts that are searched
    at once; more are searched in further rounds. lead: one block in so many is searched first, for its scores."""

    k: int = 10
    block: int = 16_384
    postings: int = 2_000_000
    span: int = 256
    near: int = 2
    round: int = 4 << 20
    lead: int = 16


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(LOWER))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def blocks_of(docs: DataFrame, number: dict[str, int], params: SearchParams) -> DataFrame:
    """Blocks of documents, each an inverted index of the terms in `number`; a document without any is only counted."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def one(rows: list, counted: list[int]) -> pd.DataFrame:
        ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
        term = np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows)])
        tf = np.concatenate([np.zeros(0, np.int64), *(r[3] for r in rows)])
        order = np.argsort(term, kind="stable")
        there, starts, df = np.unique(term[order], return_index=True, return_counts=True)
        row = [packed(ids), packed(np.array([r[0] is None for r in rows], bool)), packed(np.array([r[1] for r in rows], np.int64)), there.astype(np.int32), df.astype(np.int32)]
        row += [packed(np.append(starts, len(term)).astype(np.int64)), packed(doc[order]), packed(tf[order]), *counted, bool(len(rows) and hash((int(ids[0]), len(rows), len(term))) % params.lead == 0)]
        return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        rows, held, counted = [], 0, [0, 0]
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                counted[0], counted[1] = counted[0] + 1, counted[1] + len(terms)
                own = [(known[t], c) for t, c in Counter(terms).items() if t in known]
                if own:
                    rows.append((None if doc_id is None else int(doc_id), len(terms), np.array([t for t, _ in own], np.int32), np.array([c for _, c in own], np.int64)))
                    held += len(own)
                if len(rows) >= params.block or held >= params.postings:
                    yield one(rows, counted)
                    rows, held, counted = [], 0, [0, 0]
        if counted[0]:
            yield one(rows, counted)

    # the id as text: pandas would make a column with nulls one of floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(build, BLOCK)


@dataclass(frozen=True)
class Law:
    """Scores of the contract: a term's weight, and a document's m from its length and the corpus."""

    docs: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def impact(self, weight: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + 90 * n * self.docs // max(1, self.terms)
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def span_max(docs: np.ndarray, value: np.ndarray, spans: int, span: int) -> np.ndarray:
    """Largest value in each span of documents; docs ascend."""
    out = np.zeros(spans, np.int64)
    if len(docs):
        at = docs // span
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.maximum.reduceat(value, first)
    return out


def weighed(blocks: DataFrame, law: Law, weight: np.ndarray, pairs: np.ndarray, params: SearchParams) -> DataFrame:
    """The index: impacts, and for each span the largest impact of each term and the largest joint impact of each
    pair over the documents of their intersection. Pairs (rows of `pairs`, sorted) that never meet have no list."""
    sent = blocks.sparkSession.sparkContext.broadcast((weight, pairs))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, pairs = sent.value
        for frame in frames:
            for b in frame.itertuples(index=False):
                terms, starts = np.asarray(b.terms, np.int32), np.frombuffer(b.starts, np.int64)
                docs, tf, n = np.frombuffer(b.docs, np.int32), np.frombuffer(b.tf, np.int64), np.frombuffer(b.n, np.int64)
                if not len(n):
                    continue
                impact = law.impact(np.repeat(weight[terms], np.diff(starts)), tf, n[docs])
                spans = -(-len(n) // params.span)
                part = lambda i: slice(starts[i], starts[i + 1])
                term_max = np.array([span_max(docs[part(i)], impact[part(i)], spans, params.span) for i in range(len(terms))])
                place = np.full(len(weight), -1, np.int64)
                place[terms] = np.arange(len(terms))
                met, joint, dense, last = [], [], np.zeros(len(n), np.int64), -1
                for k, (x, y) in enumerate(place[pairs].tolist() if len(pairs) else []):
                    if x < 0 or y < 0:
                        continue
                    if x != last:
                        if last >= 0:
                            dense[docs[part(last)]] = 0
                        dense[docs[part(x)]] = impact[part(x)]
                        last = x
                    other = dense[docs[part(y)]]
                    both = np.flatnonzero(other)
                    if len(both):
                        met.append(k)
                        joint.append(span_max(docs[part(y)][both], other[both] + impact[part(y)][both], spans, params.span))
                row = [b.ids, b.nulls, packed(terms), b.starts, b.docs, packed(impact), packed(term_max), packed(np.array(met, np.int32)), packed(np.array(joint, np.int64)), b.lead]
                yield pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return blocks.mapInPandas(weigh, INDEX)


class Block:
    """A block of the index in a task."""

    def __init__(self, b, span: int):
        self.ids, self.nulls = np.frombuffer(b.ids, np.int64), np.frombuffer(b.nulls, bool)
        self.starts, self.docs, self.impact = np.frombuffer(b.starts, np.int64), np.frombuffer(b.docs, np.int32), np.frombuffer(b.impact, np.int64)
        spans = -(-len(self.ids) // span)
        self.place = {t: i for i, t in enumerate(np.frombuffer(b.terms, np.int32).tolist())}
        self.term_max = np.frombuffer(b.term_max, np.int64).reshape(-1, spans)
        met = np.frombuffer(b.pairs, np.int32)
        self.pair_place = {p: i for i, p in enumerate(met.tolist())}
        self.pair_max = np.frombuffer(b.pair_max, np.int64).reshape(-1, spans)
        self.span, self.spans, self.score = span, spans, np.zeros(len(self.ids), np.int64)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[term], self.starts[term + 1])
        return self.docs[own], self.impact[own]


def groups(block: Block, terms: list[int], pairs: list[tuple[int, int, int]], joined: bool = True) -> list[tuple[list[int], np.ndarray]]:
    """The query's terms in disjoint pairs and alone, with a bound for each span: a document that holds one term of a
    pair scores that term's maximum at most, one that holds both scores the pair's joint maximum at most. The pairs
    that lower the bound most are taken first. terms, pairs: numbers of terms, and (pair, term, term)."""
    top = {t: block.term_max[block.place[t]] for t in terms if t in block.place}
    gains = []
    for p, a, b in pairs if joined else []:
        if a in top and b in top:
            bound = np.maximum(top[a], top[b])
            if p in block.pair_place:
                bound = np.maximum(bound, block.pair_max[block.pair_place[p]])
            gain = int((top[a] + top[b] - bound).sum())
            if gain:
                gains.append((-gain, a, b, bound))
    out, used = [], set()
    for _, a, b, bound in sorted(gains, key=lambda g: g[:3]):
        if a not in used and b not in used:
            used |= {a, b}
            out.append(([block.place[a], block.place[b]], bound))
    return out + [([block.place[t]], top[t]) for t in top if t not in used]


def best_of(block: Block, of: list[tuple[list[int], np.ndarray]], least: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block that score `least` or more, and more than 0, with their scores. least may be 0.

    Spans whose bounds add up to less are out. Groups whose bounds together stay below `least` in every other span are
    not read for candidates; they add to the candidates of the others, the largest bound first, and whatever can't
    reach `least` any more is dropped on the way. seen: gets the postings read (for tests).
    """
    none = np.zeros(0, np.int64)
    live = np.sum([b for _, b in of], axis=0) >= max(1, least) if of else np.zeros(block.spans, bool)
    if not live.any():
        return none, none
    ranked = sorted(((int(b[live].max()), terms) for terms, b in of), key=lambda x: (x[0], x[1]))
    rest, cut = 0, 0
    while cut < len(ranked) and rest + ranked[cut][0] < max(1, least):
        rest, cut = rest + ranked[cut][0], cut + 1
    score = block.score  # zero again when this ends
    for _, terms in ranked[cut:]:
        for t in terms:
            docs, impact = block.list(t)
            score[docs] += impact
            if seen is not None:
                seen.append(len(docs))
    found = np.flatnonzero(score)
    own = score[found]
    score[found] = 0
    on = live[found // block.span] & (own + rest >= least)
    found, own = found[on], own[on]
    for bound, terms in reversed(ranked[:cut]):
        if not len(found):
            break
        for t in terms:
            docs, impact = block.list(t)
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            own = own + np.where(docs[at] == found, impact[at], 0)
        rest -= bound
        on = own + rest >= least
        found, own = found[on], own[on]
    return found, own


def searched(index: DataFrame, queries: list[tuple[list[int], list[tuple[int, int, int]]]], least: dict[int, int], params: SearchParams) -> DataFrame:
    """The k best documents of each query in each task's blocks, those below `least` (by query) left out."""
    sent = index.sparkSession.sparkContext.broadcast((queries, least))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, least = sent.value
        floor = [least.get(q, 0) for q in range(len(queries))]
        # of each query: (null id, id, score), best first
        held = [np.zeros((3, 0), np.int64) for _ in queries]
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = Block(row, params.span)
                for q, (terms, pairs) in enumerate(queries):
                    found, own = best_of(block, groups(block, terms, pairs), floor[q])
                    if len(found):
                        all_ = np.concatenate([held[q], np.stack([block.nulls[found].astype(np.int64), block.ids[found], own])], axis=1)
                        held[q] = all_[:, np.lexsort((all_[1], all_[0], -all_[2]))[: params.k]]
                        if held[q].shape[1] == params.k:
                            floor[q] = max(floor[q], int(held[q][2, -1]))
        q = np.repeat(np.arange(len(queries)), [h.shape[1] for h in held])
        null, ids, score = np.concatenate([np.zeros((3, 0), np.int64), *held], axis=1)
        yield pd.DataFrame({"q": q.astype(np.int32), "doc_id": pd.Series(ids).astype("Int64").mask(null == 1), "score": score})

    return index.mapInPandas(search, HIT)


def top(hits: DataFrame, by: str, k: int) -> DataFrame:
    order = W.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_rounds(items: DataFrame, size: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items as (item_id, distinct terms), in lists whose texts have `size` bytes at most or one item."""
    held, own = 0, []
    for r in items.select("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode())
        if own and held + n > size:
            yield own
            held, own = 0, []
        held, own = held + n, [*own, (r.item_id, list(dict.fromkeys(terms_of(r.text))))]
    if own:
        yield own


def ranked(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams(), follow: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters, digits and all other code points above 7F of whole texts, lower-cased in A-Z. A
    document's score is the sum of the impacts of the item's terms, once each; only scores above 0 are given, equal ones
    by ascending doc_id, null last. Null and empty texts have no terms; an item without terms has no rows; rows of
    either table that repeat count each, items too. An empty table gives an empty one. Texts of any length are read
    whole; other columns are not looked at.

    A task turns its documents into blocks with an inverted index of the items' terms; nothing is shuffled but the
    counts of terms and the best documents of each task. Each block stores for each pair of an item's terms that are
    next to each other in weight the joint maximum over the documents that hold both, by spans of documents. Items come
    in rounds of params.round bytes, whose terms and weights are all that is sent to the tasks. One block in
    params.lead is searched first: the k-th score there is a lower bound for all others. follow: gets the index.
    """
    spark, out = docs.sparkSession, []
    for own in item_rounds(items, params.round):
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in own for t in terms))}
        blocks = materialize(blocks_of(docs, number, params), "blocks")
        n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        law, df = Law(n_docs, n_terms), np.zeros(len(number), np.int64)
        for r in blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df")).collect():  # the round's terms at most
            df[r[0]] = r[1]
        weight = np.array([law.weight(int(x)) for x in df], np.int64)
        chosen: dict[tuple[int, int], int] = {}
        queries = []
        for _, terms in own:
            ids = sorted((number[t] for t in terms), key=lambda t: (-weight[t], t))
            mine = [tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i + 1, min(len(ids), i + 1 + params.near))]
            queries.append((ids, [(chosen.setdefault(p, len(chosen)), *p) for p in mine]))
        order = sorted(chosen)  # by first term, whose list is laid out once
        place = {chosen[p]: i for i, p in enumerate(order)}
        queries = [(ids, [(place[p], a, b) for p, a, b in mine]) for ids, mine in queries]
        index = materialize(weighed(blocks, law, weight, np.array(order, np.int64).reshape(-1, 2), params), "index")
        discard(blocks)
        lead = materialize(searched(index.where("lead"), queries, {}, params), "hits")
        kth = top(lead, "q", params.k).where(F.col("rank") == params.k).select("q", "score")
        least = {r.q: r.score for r in kth.collect()}  # the round's items at most
        rest = materialize(searched(index.where("not lead"), queries, least, params), "hits")
        if follow:
            follow(index)
        discard(index)
        names = _lookup(own)
        out.append(materialize(top(lead.unionByName(rest), "q", params.k).select(names.alias("item_id"), "rank", "doc_id", "score"), "ranked"))
        discard(lead, rest)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def _lookup(own: list[tuple[int | None, list[str]]]) -> Column:
    """The item_id of a round's q-th item."""
    ids = F.split(F.lit(",".join("" if i is None else str(i) for i, _ in own)), ",")
    return F.element_at(ids, F.col("q") + 1).try_cast("long")
