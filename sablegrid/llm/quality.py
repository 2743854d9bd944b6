"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeats", "distinct_pairs", "upper", "digits", "spaces", "lines",
    "stops", "bangs", "bars", "marks", "wide", "entropy", "top_byte", "sentence_words",
)


@dataclass(frozen=True)
class GamParams:
    """sample: labelled rows that the fit may see, taken by hash of the id (the bound on what reaches the driver).
    bins, pair_bins: of a feature alone and in a pair. rounds, pair_rounds: cycles over the features and the pairs.
    pairs: interactions that are kept. rate: shrinkage. threshold: least score of an accepted document."""

    sample: int = 20_000
    bins: int = 64
    pair_bins: int = 12
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 6
    rate: float = 0.15
    threshold: float = 0.3


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    w = max(1, len(words))
    share = c[c > 0] / n
    stops = int(c[46] + c[63])
    marks = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, len(set(words)) / w, sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / w, c[65:91].sum() / n, c[48:58].sum() / n, c[32] / n, c[10] / n, stops / w, c[33] / w, c[124] / w,
        (marks - c[44] - c[46]) / n, c[128:].sum() / n, float(-(share * np.log2(share)).sum()), c.max() / n, w / (stops + 1),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, penalty: float = 1.0) -> np.ndarray:
    """Newton step of a small tree over ordered bins with summed gradients g and curvatures h."""
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = gs[a + 1 : b] - gs[a], hs[a + 1 : b] - hs[a]
        all_g, all_h = gs[b] - gs[a], hs[b] - hs[a]
        gain = left_g**2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty) - all_g**2 / (all_h + penalty)
        i = int(gain.argmax())
        return float(gain[i]), a + 1 + i

    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, at = max((*best(a, b), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[at]
        parts[at : at + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + penalty)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton step and gain of a tree that cuts a grid once by rows or columns, then each half once by the other."""
    best_gain, best_step = -1.0, np.zeros_like(g)
    total = g.sum() ** 2 / (h.sum() + penalty)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            step, gain = np.zeros_like(gg), -total
            for rows in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[rows].sum(0), hh[rows].sum(0)
                line = _tree(sg, sh, 2, penalty)
                step[rows] = line
                gain += float((2 * line * sg - line**2 * (sh + 0)).sum())
            if gain > best_gain:
                best_gain, best_step = gain, step.T if turned else step
    return best_step, best_gain


@dataclass
class Gam:
    """Lookup tables: one a feature, one a pair; the score is the logistic of their sum."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (i, j), t in zip(self.pairs, self.grids):
            z += t[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, p: GamParams) -> Gam:
    """Without rows of both labels, every score is the (smoothed) share of label 1, or one half."""
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    edges, coarse = [_edges(x[:, j], p.bins) for j in range(width)], [_edges(x[:, j], p.pair_bins) for j in range(width)]
    model = Gam(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(p.rounds):
        for j in range(width):
            g, h = slopes()
            n = len(model.tables[j])
            step = p.rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n))
            model.tables[j] += step
            z += step[at[j]]
    grid = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(grid[i] * shape[1] + grid[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda q: -_pair_tree(sums(*q, g), sums(*q, h))[1])
    model.pairs = ranked[: p.pairs]
    model.grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(p.pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = p.rate * _pair_tree(sums(i, j, g), sums(i, j, h))[0]
            model.grids[k] += step
            z += step[grid[i], grid[j]]
    return model


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, p: GamParams) -> Gam:
    """Fit on at most p.sample labelled rows whose remainder is not 0."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id")) != 0).select("doc_id", "quality").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(p.sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([features(t) for t in b["text"]], columns=FEATURES, dtype=float)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.assign(quality=b["quality"].to_numpy())

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", quality int"
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.withColumn("quality", F.col("quality").cast("int"))), "doc_id")
    ordered = rows.mapInPandas(run, schema).orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES, "quality")  # rows that repeat an id may be many
    seen = ordered.limit(2 * p.sample).toPandas()
    seen = seen.sort_values(list(seen.columns), kind="stable")
    return fit(seen[list(FEATURES)].to_numpy(float), seen["quality"].to_numpy(float), p)


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t) for t in b["text"]], float).reshape(len(b), len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": shipped.value.score(x)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, p: GamParams = GamParams()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Inputs of a score come from the text alone. Null and empty texts have all features at zero. Rows that repeat
    an id are scored one by one. A null id is not held out. Labels that are null or not 0 or 1 are passed over; a
    document that is labelled both ways counts both ways. Without labels every score is the same (see fit). An
    empty docs table gives an empty result; other columns are not looked at.
    """
    scored = score(docs, train(docs, labels, p))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, p: GamParams = GamParams()) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold, also those just at it.

    Null and empty texts are scored like any other, rows without an id too, and rows that repeat an id each for itself.
    Whole texts count, however long. An empty table gives an empty one; columns may have any names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches, 1024):  # Arrow keeps every column as it is
            x = np.array([features(t) for t in b.column("text").to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(shipped.value.score(x) >= p.threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
