"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, attach, components, discard, materialize, slices, without

#: Groups up to this size are compared by shifts over the whole batch, larger ones by a search from one member to the next.
SMALL = 8
#: A table entry with so many visitors at most gives all their links to its members; one with more gives a forest of them.
FEW = 32
#: Texts whose shingle sets a task holds at once.
SLICE = 1000
#: Bands of a set of shingles and minima of a band; least bits of its bitmap, which has one for each element at least.
BANDS, MINIMA, BITS = 32, 4, 2048
#: Rows of a band that a task compares at once; pairs of a document with one copy of its set.
BLOCK, HUB = 1024, 1024
#: Random factors and terms of the minima's hash functions, and factors of the bands' keys.
_TIMES, _PLUS, _MIX = np.split(np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 2 * BANDS * MINIMA + MINIMA, np.uint64), [BANDS * MINIMA, 2 * BANDS * MINIMA])
_TIMES, _MIX = _TIMES | np.uint64(1), _MIX | np.uint64(1)


@dataclass(frozen=True)
class SimHashParams:
    """shingle: words of a shingle. distance: fingerprints link at so many differing bits or fewer.
    segments: the fingerprint is cut into so many tables. seed: of XXH64."""

    shingle: int = 4
    distance: int = 4
    segments: int = 3
    seed: int = 42


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; bytes.lower and bytes.split know ASCII only, which is what is asked for."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(tokens: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words make one shingle."""
    import xxhash

    if not tokens:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(tokens) - size + 1)
    stops = (ends - 1)[min(size, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """doc_id, fp (bigint)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(shingle_hashes(words(t), params.shingle, params.seed)) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def layout(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    If each segment i differed in more than radius i bits, the whole would differ in at least sum(radius + 1)
    bits. So with that sum at distance + 1, any two linked fingerprints are within the radius in some segment.
    """
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    radii = [(distance + 1) // segments + (i < (distance + 1) % segments) - 1 for i in range(segments)]
    return [(sum(widths[:i]), w, r) for i, (w, r) in enumerate(zip(widths, radii)) if r >= 0]


def probes(parts: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(segment, mask) of each member of each segment's Hamming ball."""
    return [(i, sum(1 << b for b in flip)) for i, (_, w, r) in enumerate(parts) for n in range(r + 1) for flip in combinations(range(w), n)]


def spanning(fps: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all that is linked among one table entry's visitors: a forest, never all pairs."""
    out, todo = [], np.arange(len(fps))
    while len(todo) > 1:
        front, todo = [todo[:1]], todo[1:]
        while front and len(todo):
            some = front.pop()
            for at in some.tolist():
                near = np.bitwise_count(fps[todo] ^ fps[at]) <= distance
                if near.any():
                    new = todo[near]
                    out.append((np.full(len(new), ids[at]), ids[new]))
                    front.append(new)
                    todo = todo[~near]
                    if not len(todo):
                        break
    return out


def stars(near: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (rows, columns) of the links in near, a matrix of a few members by all visitors of an entry.
    own: each member's column.

    A row takes the columns that no row before it took, and one column of each further tree that it meets.
    """
    tree, out = np.full(near.shape[1], -1), []
    for i, met in enumerate(near):
        tree[tree == tree[own[i]] if tree[own[i]] >= 0 else own[i]] = i
        at = np.flatnonzero(met & (tree != i))
        old = at[tree[at] >= 0]
        trees, first = np.unique(tree[old], return_index=True)
        at = np.concatenate((at[tree[at] < 0], old[first]))
        tree[np.isin(tree, trees)] = i
        tree[at] = i
        out.append((np.full(len(at), i), at))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def verify(key: np.ndarray, fps: np.ndarray, ids: np.ndarray, exact: np.ndarray, distance: int) -> pd.DataFrame:
    """Links (a, b) among rows sorted by key; every link's complete distance is checked."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    large = np.repeat(sizes > SMALL, sizes)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for s in range(1, SMALL):
        if s >= len(key):
            break
        i = np.flatnonzero((key[s:] == key[:-s]) & (exact[s:] | exact[:-s]) & ~large[s:])
        i = i[np.bitwise_count(fps[i] ^ fps[i + s]) <= distance]
        out.append((ids[i], ids[i + s]))
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        held = np.flatnonzero(exact[a : a + n]) + a
        if 0 < len(held) <= FEW:
            near = np.bitwise_count(fps[held][:, None] ^ fps[a : a + n]) <= distance
            i, j = np.nonzero(near) if n <= FEW else stars(near, held - a)
            other = held[i] != j + a
            out.append((ids[held[i[other]]], ids[j[other] + a]))
        elif len(held):
            out += spanning(fps[a : a + n], ids[a : a + n], distance)
    return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})


def links(reps: DataFrame, params: SimHashParams) -> DataFrame:
    """Links (a, b) that join all that is linked: reps has one row (fp, rep) for each distinct fingerprint."""
    parts = layout(params.distance, params.segments)
    codes = F.array(*[F.lit(i << 40 | m) for i, m in probes(parts)])
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in k]), F.col("seg") + 1)
    seen = reps.where("rep is not null").select("fp", "rep", F.explode(codes).alias("code")).withColumn("seg", F.shiftright("code", 40).cast("int"))
    flip = F.col("code").bitwiseAND(F.lit((1 << 40) - 1))
    shift, mask = pick([s for s, _, _ in parts]), pick([(1 << w) - 1 for _, w, _ in parts])
    own = F.call_function("shiftrightunsigned", F.col("fp"), shift).bitwiseAND(mask)
    rows = seen.select((F.shiftleft(F.col("seg").cast("long"), 40) + own.bitwiseXOR(flip)).alias("key"), "fp", "rep", (flip == 0).alias("exact"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            key = b["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last entry may go on in the next batch
            kept = b.iloc[cut:]
            if cut:
                yield work(b.iloc[:cut])
        if kept is not None and len(kept):
            yield work(kept)

    def work(b: pd.DataFrame) -> pd.DataFrame:
        return verify(b["key"].to_numpy(), b["fp"].to_numpy().view(np.uint64), b["rep"].to_numpy(), b["exact"].to_numpy(), params.distance)

    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(run, "a long, b long")


def simhash_dedup(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, the document itself included. Null and empty texts have
    no words and the fingerprint zero, which links like any other. Rows that repeat an id count one by one; null
    ids take the component of their fingerprint if a row with an id has it, and null otherwise. A bit that just half of
    the shingles set is 0. Whole texts count, however long. An empty table gives an empty result; columns other than
    doc_id and text are not looked at.

    Equal fingerprints become one row before the search. A fingerprint visits every table entry in the Hamming
    ball around each of its segments; entries that hold many come out as a spanning forest of verified links, so
    rows grow with the number of fingerprints and not with the square of a group.
    """
    fps = materialize(fingerprints(docs, params), "fingerprints")
    total = fps.count()
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")
    groups = components(links(reps, params))
    placed = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    found = attach(fps, materialize(placed, "placed"), ["fp"], "n", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sketch(held: np.ndarray) -> tuple[list[int], bytes]:
    """Band keys and bitmap of a set of shingle hashes; an empty set has no bands, for it is like empty sets alone.

    Each element turns one bit of the bitmap over, so what two sets have in common cancels out when they are compared.
    A bitmap has a power of two of bits, as many as elements at least: a longer set's says as much as a short one's.
    """
    if not len(held):
        return [], bytes(BITS // 8)
    h, low = held.view(np.uint64), np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        low = np.minimum(low, (h[i : i + 4096, None] * _TIMES + _PLUS).min(0))
    keys = (low.reshape(BANDS, MINIMA) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    bits = max(BITS, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return keys.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).tobytes()


def summaries(docs: DataFrame, params: SimHashParams) -> DataFrame:
    """doc_id, fp, code (digest of the set of shingles), size of the set, its bands and its bitmap."""

    types = {"fp": pa.int64(), "code": pa.binary(), "size": pa.int64(), "bands": pa.list_(pa.int64()), "bits": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, SLICE):
            out = []
            for t in part.column("text").to_pylist():
                hashes = shingle_hashes(words(t), params.shingle, params.seed)
                held = np.unique(hashes.view(np.int64))
                out.append((fingerprint(hashes), xxhash.xxh3_128_digest(held.tobytes()), len(held), *sketch(held)))
            made = [pa.array([row[k] for row in out], t) for k, t in enumerate(types.values())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *made], ["doc_id", *types])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, code binary, size long, bands array<long>, bits binary")


def similar(docs: DataFrame, pairs: DataFrame, params: SimHashParams, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of doc_id, a written table, whose sets of shingles have a Jaccard similarity of so much
    at least. Where rows of other texts repeat an id, any of them will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            held = [np.unique(shingle_hashes(words(t), params.shingle, params.seed).view(np.int64)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["id", "held"])

    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    side = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    held = docs.select("doc_id", "text").join(side, "doc_id", "left_semi").mapInArrow(run, "id long, held array<long>")
    held = materialize(held.groupBy("id", F.xxhash64("held").alias("h")).agg(F.first("held").alias("held")).drop("h"), "shingles")
    # a hub is in many pairs: its set goes to several tasks, each of which has about HUB of the pairs
    n, met, sides = pairs.count(), pairs, []
    for x in ("a", "b"):
        ends = materialize(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")), "ends")
        parts = F.ceil(F.col("n") / HUB).cast("int")
        met = attach(met, ends, [x], "n", n).withColumn(f"salt_{x}", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("n")
        salts = F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"salt_{x}")
        sides.append(held.join(ends.withColumnRenamed(x, "id"), "id").select(F.col("id").alias(x), F.col("held").alias(f"held_{x}"), salts))
    for x, side in zip(("a", "b"), sides):
        met = met.join(side, [x, f"salt_{x}"])
    both = F.size(F.array_intersect("held_a", "held_b"))
    wide = F.size("held_a") + F.size("held_b")
    found = materialize(met.where((both >= F.lit(similarity) * (wide - both)) | (wide == 0)).select("a", "b").distinct(), "similar")
    discard(asked, held)
    return found


class Sketches:
    """Ids, sizes and bitmaps of sets that share a band."""

    def __init__(self, b: pd.DataFrame, similarity: float) -> None:
        self.ids, self.size = b["rep"].to_numpy(), b["size"].to_numpy()
        self.least, self.apart = similarity, (1 - similarity) / (1 + similarity)
        bits = b["bits"].tolist()
        self.width = np.array([len(x) for x in bits], np.int64)
        # by width: where a row is, and the bitmaps of that width or twice that, folded; others differ too much in size
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero((self.width >= w) & (self.width <= w * max(2, int(2 / similarity))))
            place, folded = np.zeros(len(bits), np.int64), []
            for i in own.tolist():
                row = np.frombuffer(bits[i], np.uint64)
                place[i] = len(folded)
                folded.append(np.bitwise_xor.reduce(row.reshape(-1, w // 8), axis=0) if len(row) * 8 > w else row)
            self.at[w] = place, np.stack(folded)

    def admit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sizes and bitmaps allow the similarity. Sets differ in one element at least for each differing bit,
        and in at most that share of their sizes' sum; so no pair of the similarity is ruled out."""
        i, j = np.broadcast_arrays(i, j)
        x, y = self.size[i], self.size[j]
        ok = np.minimum(x, y) >= self.least * np.maximum(x, y) - 1e-9
        width = np.minimum(self.width[i], self.width[j])
        for w, (place, bits) in self.at.items():
            on = np.flatnonzero(ok & (width == w))
            differ = np.bitwise_count(bits[place[i[on]]] ^ bits[place[j[on]]]).sum(-1)
            ok[on] = differ <= self.apart * (x[on] + y[on]) + 1e-9
        return ok


def trees(s: Sketches, start: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Admitted pairs that join all that admitted pairs join among n neighbouring rows: a forest, never all pairs."""
    out, todo = [], np.arange(start, start + n)
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            at = front.pop(0)
            near = s.admit(np.array([at]), todo)
            if near.any():
                new, todo = todo[near], todo[~near]
                out.append((np.full(len(new), at), new))
                front.extend(new.tolist())
    return out


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def told(s: Sketches, out: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    i, j = (np.concatenate([np.empty(0, np.int64), *[x[k] for x in out]]) for k in (0, 1))
    pairs = np.unique(np.stack((np.maximum(s.ids[i], s.ids[j]), np.minimum(s.ids[i], s.ids[j])), axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def first_pairs(b: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Of rows sorted by part: all admitted pairs of a part with few rows, and a forest of them of a larger one."""
    s, key, out = Sketches(b, similarity), b["part"].to_numpy(), []
    starts, sizes = runs(key)
    large = np.repeat(sizes > SMALL, sizes)
    for k in range(1, min(SMALL, len(key))):
        i = np.flatnonzero((key[k:] == key[:-k]) & ~large[k:])
        i = i[s.admit(i, i + k)]
        out.append((i, i + k))
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        out += trees(s, a, n)
    return told(s, out)


def last_pairs(b: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Of rows sorted by part: all admitted pairs of two groups, one of which asks."""
    s, group, asks, out = Sketches(b, similarity), b["grp"].to_numpy(), b["asks"].to_numpy(), []
    for a, n in zip(*[x.tolist() for x in runs(b["part"].to_numpy())]):
        held = np.arange(a, a + n)[~asks[a : a + n]]
        for i in (np.flatnonzero(asks[a : a + n]) + a).tolist():
            j = held[group[held] != group[i]]
            j = j[s.admit(np.array([i]), j)]
            out.append((np.full(len(j), i), j))
    return told(s, out)


def chunks(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, all rows of a key together."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        k = b[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut or (kept and len(k) and kept[-1][key].iloc[-1] != k[0]):
            yield pd.concat([*kept, b.iloc[:cut]], ignore_index=True)
            kept = []
        if len(k):
            kept.append(b.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def near_dedup(docs: DataFrame, params: SimHashParams = SimHashParams(shingle=5), similarity: float = 0.8) -> DataFrame:
    """docs without near copies: one document, that of the smallest id, of each group of linked ones stays, with all
    its columns. Two documents link if their sets of word shingles have the similarity.

    Equal sets become one; so do null, empty and blank texts, whose sets are empty. Whole texts count, however long.
    A pair at exactly the similarity links. Rows without an id stay; rows that repeat an id stay or go together. An
    empty table gives an empty result; of the columns only doc_id and text are looked at, all are returned.

    Fingerprints within the distance are found by multi-index hashing. A fingerprint of 64 bits can't tell 0.8 from
    less (there, about ten bits differ), so sets that share a band of four of their minima are candidates as well: at
    the similarity a pair shares none of the 32 bands once in 20 million. Every candidate is held against its bitmap's
    bound, which loses nothing, and then exactly. A band that many share gives a forest of its candidates first; after
    these were verified, all candidates that are still in two groups are tried too, in blocks, so the forest decides
    the order of the work and not its result.
    """
    known = docs.where("doc_id is not null")
    rows = materialize(summaries(known, params), "summaries")
    total = rows.count()
    sets = rows.groupBy("code").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("fp", "size", "bands", "bits")])
    sets = materialize(sets, "sets")
    copies = attach(rows.select("doc_id", "code"), sets.select("code", "rep", "n"), ["code"], "n", total)
    copies = materialize(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "copies")

    reps = materialize(sets.groupBy("fp").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("k")), "distinct")
    near = links(reps.select("fp", F.col("first").alias("rep")), params)
    alike = attach(sets.select("fp", "rep"), reps, ["fp"], "k", total).select(F.col("rep").alias("a"), F.col("first").alias("b"))

    bands = sets.select("rep", F.explode("bands").alias("band"))
    held = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    part = F.xxhash64("band", "block").alias("part")
    slim = attach(bands, held, ["band"], "n", BANDS * total).withColumn("block", block).select(part, "rep")
    shared = slim.join(sets.select("rep", "size", "bits"), "rep")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunks(batches, "part"):
            yield first_pairs(b, similarity)

    tried = shared.repartition("part").sortWithinPartitions("part", "rep").mapInPandas(first, "a long, b long")
    pairs = near.unionByName(alike).unionByName(tried).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    linked = similar(known, pairs, params, similarity)

    groups = components(linked).withColumnsRenamed({"node": "rep", "component": "grp"})
    placed = materialize(sets.select("rep", "size", "bits", "bands").join(groups, "rep", "left").withColumn("grp", F.coalesce("grp", "rep")), "placed")
    bands = placed.select("rep", "grp", F.explode("bands").alias("band"))
    many = attach(bands, held.where(F.col("n") > SMALL), ["band"], "n", BANDS * total)
    split = many.groupBy("band", "grp").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.max_by("grp", F.struct("k", "grp")).alias("most"), F.max("k").alias("of_most"), F.count(F.lit(1)).alias("groups"))
    split = materialize(split.where("groups > 1"), "split")
    # all but a band's largest group ask all its blocks; within a group all is linked already. A task has a block of
    # those that are asked and a block of those that ask
    tiles = F.ceil((F.col("n") - F.col("of_most")) / BLOCK).cast("int")
    part = F.xxhash64("band", "block", "tile").alias("part")
    met = attach(bands, split, ["band"], "n", BANDS * total).drop("grp").join(placed.select("rep", "grp", "size", "bits"), "rep")
    there = met.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1))).select(part, "rep", "grp", "size", "bits", F.lit(False).alias("asks"))
    asking = met.where("grp <> most").withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(1)), tiles).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(part, "rep", "grp", "size", "bits", F.lit(True).alias("asks"))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunks(batches, "part"):
            yield last_pairs(b, similarity)

    left = there.unionByName(asking).repartition("part").sortWithinPartitions("part", "rep").mapInPandas(last, "a long, b long").distinct()
    left = materialize(left.join(pairs, ["a", "b"], "left_anti"), "untried")
    more = similar(known, left, params, similarity)
    groups = components(linked.unionByName(copies).unionByName(more))
    out = without(docs, groups.where("node <> component").select(F.col("node").alias("doc_id")))
    discard(rows, sets, copies, reps, held, pairs, linked, placed, split, left, more)
    return out
