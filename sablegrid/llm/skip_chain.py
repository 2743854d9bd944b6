"""Personal data: patterns, and a skip-chain conditional random field that keeps labels consistent in a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract, in its order. Label 0 of the field is "none"; kind i is label i + 1.
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits that fails at its start fails all along it
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of the longest span of each kind that is made of several tokens.
LONGEST = (0, 0, 23, 24)
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s]+")
_OUTER = "\"'`.,;:!?<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass, per kind leftmost and without overlap."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


@dataclass(frozen=True)
class FieldParams:
    """sample: documents with digits or @ that the weights are learnt from, by hash of the id, and tokens: their tokens
    in all (the bounds on what reaches the driver). steps, rate, ridge: of the fit. rounds: of message passing.
    certain: least marginal of a label that adds a span."""

    sample: int = 1_000
    tokens: int = 100_000
    steps: int = 150
    rate: float = 0.3
    ridge: float = 1e-5
    rounds: int = 12
    certain: float = 0.9


@dataclass
class Weights:
    node: np.ndarray  # features x labels
    chain: np.ndarray  # label before x label after
    skip: np.ndarray  # symmetric


FEATURES = 24


def shape(core: str) -> list[int]:
    """Features of a token that are set."""
    digits = sum("0" <= c <= "9" for c in core)
    letters = any(c.isalpha() for c in core)
    size = next(i for i, n in enumerate((0, 2, 3, 4, 7, 9, 13, 19, 10**9)) if digits <= n)
    flags = ("@" in core, core.count(".") == 3, "." in core, core.startswith("+"), "(" in core or ")" in core, "-" in core, letters, digits == len(core), ":" in core, "=" in core, "@" in core and "." in core.rpartition("@")[2], "/" in core)
    return [0, 1 + size, *(10 + i for i, on in enumerate(flags) if on)]


def tokens(text: str) -> list[tuple[int, int, list[int], tuple[str, ...], bool]]:
    """Tokens with a digit or @: start, end, features, keys of like tokens, whether the token before is the one listed before."""
    out, before = [], -9
    for n, m in enumerate(_TOKEN.finditer(text)):
        if not _HINT.search(m[0]):
            continue
        core = m[0].strip(_OUTER)
        s = m.start() + len(m[0]) - len(m[0].lstrip(_OUTER))
        if core:
            digits = "".join(c for c in core if "0" <= c <= "9")
            keys = {core.lower()}
            if len(digits) >= 7:
                keys.add(digits[-7:])
            if "@" in core:
                keys.add(core.lower().partition("@")[0] + "@")
            out.append((s, s + len(core), shape(core), tuple(sorted(keys)), before == n - 1))
            before = n
    return out


@dataclass
class Graph:
    """Tokens of many documents: features as a matrix, label that a base span gives (0 if none), and edges."""

    x: np.ndarray
    y: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(docs: list[tuple[list, list]]) -> Graph:
    """docs: tokens and base spans. Like tokens are linked each to the one before it and to the first of them, so edges
    grow with tokens and a label reaches all of them in a few rounds, however long the text."""
    x, y, chain, skip = [], [], [], []
    for toks, base in docs:
        last: dict[str, int] = {}
        first: dict[str, int] = {}
        at = 0
        for s, e, feats, keys, joined in toks:
            i = len(x)
            row = np.zeros(FEATURES, np.float32)
            row[feats] = 1
            x.append(row)
            while at < len(base) and base[at][2] <= s:
                at += 1
            y.append(next((k + 1 for a, k, b in base[at : at + 4] if a < e and b > s), 0))
            if joined:
                chain.append((i - 1, i))
            for j in {seen[k] for k in keys if k in last for seen in (last, first)}:
                if not (joined and j == i - 1):
                    skip.append((j, i))
            last.update(dict.fromkeys(keys, i))
            for k in keys:
                first.setdefault(k, i)
    pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Graph(np.array(x, np.float32).reshape(-1, FEATURES), np.array(y, np.int64), pairs(chain), pairs(skip))


def fit(g: Graph, p: FieldParams) -> Weights:
    """Pseudo-likelihood: each token's label given its neighbours' labels, by gradient ascent.

    The patterns label only what passes their checks, and what they pass over is evidence for no label, however like a
    labelled token it looks: a number of a card's length with a wrong digit is no card. But a token that they pass over
    although a skip link ties it to a labelled one is unknown and left out: such tokens are what links are to find.
    """
    w = Weights(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    w.node[0, 0] = 1.0
    if not len(g.y):
        return w
    tied = np.zeros(len(g.y), bool)
    for here, there in (g.skip.T, g.skip.T[::-1]):
        tied[here[g.y[there] > 0]] = True
    unknown = tied & (g.y == 0)
    hot = np.eye(LABELS)[g.y] * ~unknown[:, None]

    def around(edges: np.ndarray, ends: int) -> np.ndarray:
        """Labels of the neighbours at one end of the edges, summed for the other."""
        out = np.zeros_like(hot)
        np.add.at(out, edges[:, ends], hot[edges[:, 1 - ends]])
        return out

    before, after = around(g.chain, 1), around(g.chain, 0)
    like = around(g.skip, 0) + around(g.skip, 1)
    n, squares = (~unknown).sum(), [np.zeros_like(part) for part in (w.node, w.chain, w.skip)]
    for _ in range(p.steps):
        z = g.x @ w.node + before @ w.chain + after @ w.chain.T + like @ w.skip
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        d = (hot - q / q.sum(1, keepdims=True)) * ~unknown[:, None]
        own = like.T @ d / n
        slopes = (g.x.T @ d / n - p.ridge * w.node, (before.T @ d + d.T @ after) / n - p.ridge * w.chain, (own + own.T) / 2 - p.ridge * w.skip)
        for part, slope, sq in zip((w.node, w.chain, w.skip), slopes, squares):
            sq += slope**2
            part += p.rate * slope / np.sqrt(sq + 1e-12)
    return w


def marginals(g: Graph, w: Weights, rounds: int) -> np.ndarray:
    """Loopy sum-product message passing over all documents of the graph at once; base labels are held fast."""
    unary = g.x @ w.node
    held = g.y > 0
    unary[held] = -50.0
    unary[held, g.y[held]] = 0.0
    ends = np.concatenate([g.chain, g.skip])
    if not len(ends):
        return _normal(unary)
    potential = np.concatenate([np.broadcast_to(w.chain, (len(g.chain), LABELS, LABELS)), np.broadcast_to(w.skip, (len(g.skip), LABELS, LABELS))])
    forth, back = np.zeros((len(ends), LABELS)), np.zeros((len(ends), LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, ends[:, 1], forth)
        np.add.at(belief, ends[:, 0], back)
        new_forth = _sum(belief[ends[:, 0]] - back, potential)
        new_back = _sum(belief[ends[:, 1]] - forth, potential.transpose(0, 2, 1))
        forth, back = (forth + new_forth) / 2, (back + new_back) / 2
    belief = unary.copy()
    np.add.at(belief, ends[:, 1], forth)
    np.add.at(belief, ends[:, 0], back)
    return _normal(belief)


def _sum(into: np.ndarray, potential: np.ndarray) -> np.ndarray:
    z = into[:, :, None] + potential
    top = z.max(1)
    out = top + np.log(np.exp(z - top[:, None]).sum(1))
    return out - out.max(1, keepdims=True)


def _normal(z: np.ndarray) -> np.ndarray:
    q = np.exp(z - z.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def added_spans(docs: list[tuple[list, list]], w: Weights, p: FieldParams) -> list[list[tuple[int, int, int]]]:
    """Spans of neighbouring tokens that get the same certain label and touch no base span."""
    g = graph(docs)
    q = marginals(g, w, p.rounds) if len(g.y) else np.zeros((0, LABELS))
    out, i = [], 0
    for toks, _ in docs:
        own: list[list[int]] = []
        for s, e, _, _, joined in toks:
            label = int(q[i].argmax())
            if g.y[i] == 0 and label and q[i, label] >= p.certain:
                if own and joined and own[-1][1] == label - 1 and own[-1][3] == i - 1 and e - own[-1][0] <= LONGEST[label - 1]:
                    own[-1][2:] = [e, i]
                else:
                    own.append([s, label - 1, e, i])
            i += 1
        out.append([(s, k, e) for s, k, e, _ in own])
    return out


def train(docs: DataFrame, p: FieldParams) -> Weights:
    """Learn from the base spans of a bounded sample of documents."""
    hinted = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("doc_id", "text").alias("h"))
    wanted = hinted.select("h").distinct().orderBy("h").limit(p.sample)
    picked = hinted.join(F.broadcast(wanted), "h").dropDuplicates(["h"])  # the texts of p.sample hashes alone move

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, t in zip(b["h"].tolist(), b["text"]):
                toks, base = tokens(t), base_spans(t)
                yield pd.DataFrame({"h": h, "n": range(len(toks)), "s": [x[0] for x in toks], "e": [x[1] for x in toks], "feats": [x[2] for x in toks], "keys": [list(x[3]) for x in toks], "joined": [x[4] for x in toks], "base": [[v for span in base for v in span] if not n else [] for n in range(len(toks))]})

    schema = "h long, n long, s long, e long, feats array<int>, keys array<string>, joined boolean, base array<long>"
    seen = picked.mapInPandas(run, schema).orderBy("h", "n").limit(p.tokens).toPandas()
    docs_, current = [], None
    for r in seen.itertuples(index=False):
        if r.n == 0:
            flat = list(r.base)
            current = ([], [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)])
            docs_.append(current)
        current[0].append((r.s, r.e, list(r.feats), tuple(r.keys), bool(r.joined)))
    return fit(graph(docs_), p)


def find_entities(docs: DataFrame, p: FieldParams = FieldParams()) -> DataFrame:
    """One row per row of docs: doc_id, and spans, an array of (start, kind, end, base) in order of start, then kind.

    base tells the patterns' spans, which always stay, from those the field adds; positions count code points. A
    text without findings has an empty array, as have null and empty texts. Rows that repeat an id are searched
    each for itself. An empty table gives an empty result; columns other than doc_id and text are not looked at.

    Nodes of the field are the tokens with a digit or @ of every document that has one, whether a pattern matches in
    it or not; whole texts count, however long. Neighbours share a chain potential and like tokens (equal without
    case, or in their last seven digits, or in the part before @) a skip potential, learnt together from the patterns'
    own labels. Base labels are held fast and messages carry them to like tokens; of equal marginals the first kind
    counts, and none before all.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, p))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            base: list = [base_spans(t) if _HINT.search(t) else [] for t in texts]
            asked = [i for i, t in enumerate(texts) if _HINT.search(t)]
            found = [[(s, k, e, True) for s, k, e in x] for x in base]
            for at in range(0, len(asked), 500):
                part = asked[at : at + 500]
                for i, more in zip(part, added_spans([(tokens(texts[i]), base[i]) for i in part], shipped.value, p)):
                    found[i] = sorted(found[i] + [(s, k, e, False) for s, k, e in more])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": [[{"start": s, "kind": k, "end": e, "base": x} for s, k, e, x in f] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, spans array<struct<start:long,kind:int,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count of base spans for each kind, the digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(i: int):
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
