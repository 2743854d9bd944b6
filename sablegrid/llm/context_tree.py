"""Language-model scores by context-tree weighting, beside a word-frequency base score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Bytes of text that are turned into arrays at once.
BLOCK = 3 << 19
#: Rows of grams that a task sends at once.
SENT = 1 << 17
#: Distinct grams of a task that works out code lengths, on average.
DEAL = 1 << 17
#: Bytes of the contexts whose trees are dealt to tasks; with a byte less at each end they are put together in two steps.
CUT = 3
#: Logarithms are summed as whole numbers of this part of one, so that no order of rows changes the sum.
UNIT = 2.0**-33
#: Code lengths in bits are whole numbers of this part of one.
BIT_UNIT = 2.0**-24
LOG2_10 = np.log2(10.0)


@dataclass(frozen=True)
class TreeParams:
    """depth: bytes of the longest context, 1 to 6. keep: None for the whole tree, with every context of the training
    rows; a number for a smaller model, in which a node stays if it has seen one in so many of the training bytes.
    frequent: words that make up one in so many training tokens, at most that many, are looked up from a broadcast
    table, all others by a join. table: so many of the commonest grams at most have their code lengths in a
    broadcast table (24 to 48 bytes each); all others find theirs by the same join. Neither changes a result."""

    depth: int = 6
    keep: int | None = None
    frequent: int = 1 << 19
    table: int = 1 << 21

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= 6:
            raise ValueError("depth is 1 to 6")


def prepared(text: str | None) -> bytes:
    """Lower-cased (A-Z) text in UTF-8. A zero byte in it stands for itself and, once more, for the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: context (the byte before is lowest) and the byte, as one number; and
    the number of the text. Before a text stand zero bytes."""
    buf = np.frombuffer(b"\0" * 7 + b"".join(b"\0" * depth + t + b"\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    here = np.tile([False, True], len(texts)).repeat(np.stack((np.full(len(texts), depth), sizes), 1).ravel())
    last = np.ndarray(len(buf) - 7, ">i8", buf, strides=(1,))  # the eight bytes that end at each place
    return last[here].astype(np.int64) & (1 << 8 * (depth + 1)) - 1, np.repeat(np.arange(len(texts)), sizes)


def blocks(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Parts of a batch with their prepared texts, of about BLOCK bytes; a longer text is a part of its own."""
    texts, start, size = [], 0, 0
    for i, t in enumerate(b["text"]):
        raw = prepared(t)
        if texts and size + len(raw) > BLOCK:
            yield b.iloc[start:i], texts
            texts, start, size = [], i, 0
        texts.append(raw)
        size += len(raw)
    if texts:
        yield b.iloc[start:], texts


def learns(doc_id: Column) -> Column:
    """Rows to learn from; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


def gram_counts(docs: DataFrame, p: TreeParams) -> DataFrame:
    """(gram, n, asked): how often each gram is in the training rows and in all rows, summed in each task before the
    shuffle as far as memory goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for part, texts in blocks(b):
                key, own = grams(texts, p.depth)
                key, n = np.unique(key << 1 | part["learn"].to_numpy().astype(np.int64)[own], return_counts=True)
                held.append((key, n))
                size += len(key)
                if size > 3_000_000:
                    held, size = merged(held)
                    if size > 2_500_000:
                        yield from shown(*held[0])
                        held, size = [], 0
        if held:
            yield from shown(*merged(held)[0][0])

    def merged(held: list) -> tuple[list, int]:
        key, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        order = np.argsort(key, kind="stable")  # a merge of sorted runs
        key = key[order]
        first = runs(key)
        return [(key[first], np.add.reduceat(n[order], first))], len(first)

    def shown(key: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        gram = key >> 1
        first = runs(gram)
        gram, learnt, asked = gram[first], np.add.reduceat(n * (key & 1), first), np.add.reduceat(n, first)
        for i in range(0, len(gram), SENT):
            at = slice(i, i + SENT)
            yield pd.DataFrame({"gram": gram[at], "n": learnt[at], "asked": asked[at]})

    rows = docs.select("text", learns(F.col("doc_id")).alias("learn")).mapInPandas(run, "gram long, n long, asked long")
    # dealt before they are added up, for a task's rows hardly repeat a gram
    return rows.repartition("gram").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training rows; the end of a text is the empty word, which no word is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(prepared(t).split())
                seen[b""] += 1
                if len(seen) > 500_000:
                    yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})

    return docs.where(learns(F.col("doc_id"))).select("text").mapInPandas(run, "word binary, c long").repartition("word").groupBy("word").agg(F.sum("c").alias("c"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; exact to 1e-13 for x >= 0.5."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


#: Logarithms of the gamma function at n + 1/2 and n + 1, for small n.
SMALL = np.arange(1 << 16)
AT_HALF, AT_ONE = _log_gamma(SMALL + 0.5), _log_gamma(SMALL + 1.0)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""

    def at(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
        out = table[np.minimum(n, len(table) - 1)]
        large = np.flatnonzero(n >= len(table))
        out[large] = _log_gamma(n[large] + more)
        return out

    n0, n1 = np.atleast_1d(n0).astype(np.int64), np.atleast_1d(n1).astype(np.int64)
    return at(AT_HALF, n0, 0.5) + at(AT_HALF, n1, 0.5) - np.log(np.pi) - at(AT_ONE, n0 + n1, 1.0)


@dataclass
class Level:
    """Nodes of one depth, in the order of their paths: prefix, then the context's bytes, the byte before first. prefix is
    the bits of the byte that are known already, after a leading one. whole: log probability of all that fell to a
    node; alone: its own estimate's share of it; there: the node is in the tree; parent: its place in the level above."""

    path: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    whole: np.ndarray
    alone: np.ndarray
    there: np.ndarray
    parent: np.ndarray | None = None


def climbed(path: np.ndarray, n0: np.ndarray, n1: np.ndarray, whole: np.ndarray | None, steps: int, least: int) -> list[Level]:
    """Levels from the given nodes (sorted by path) up so many steps, the topmost last.

    A node with children in the tree is half its own estimate and half the product of its children's; what fell to
    children that are not there is one more child. Without `whole` the given nodes are the deepest.
    """
    out = [Level(path, n0, n1, log_kt(n0, n1) if whole is None else whole, np.ones(len(path)), n0 + n1 >= least)]
    for _ in range(steps):
        low = out[-1]
        above = low.path >> 8
        first = runs(above)
        low.parent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(above))))
        total = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: E731, B023
        n0, n1, below = total(low.n0), total(low.n1), total(np.where(low.there, low.whole, 0.0))
        own = log_kt(n0, n1)
        if least > 1:
            below = below + log_kt(n0 - total(low.n0 * low.there), n1 - total(low.n1 * low.there))
        inner = total(low.there.astype(np.int64)) > 0
        both = np.logaddexp(own, below) - np.log(2)
        out.append(Level(above[first], n0, n1, np.where(inner, both, own), np.where(inner, np.exp(own - np.log(2) - both), 1.0), n0 + n1 >= least))
    return out


def descended(levels: list[Level], mass: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """mass and left of the deepest level, from those of the topmost. A node's chance of a one is mass + left * its own
    estimate if no deeper node is there: each node's share of the posterior weighs its estimate, and the deepest node
    takes what is left. A node that is not there has no left, and its parent's chance as mass."""
    for low, high in zip(levels[-2::-1], levels[:0:-1]):
        estimate = (high.n1 + 0.5) / (high.n0 + high.n1 + 1)
        chance, on, rest = mass + left * estimate, mass + left * high.alone * estimate, left * (1 - high.alone)
        mass, left = np.where(low.there, on[low.parent], chance[low.parent]), np.where(low.there, rest[low.parent], 0.0)
    return mass, left


def turned(context: np.ndarray, depth: int) -> np.ndarray:
    """The context's bytes in the other order: the byte before is highest."""
    out = np.zeros_like(context)
    for j in range(depth):
        out = out << 8 | (context >> 8 * j & 255)
    return out


def planes(gram: np.ndarray, n: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the byte's eight bits: grams in the order of their nodes' paths, their bits, where each node's grams
    begin, its path, n0 and n1. gram is sorted by turned context, so that a stable sort by prefix will do."""
    context, byte = turned(gram >> 8, depth), (gram & 255).astype(np.uint8)
    for k in range(8):
        prefix = ((1 << k) + (byte.astype(np.int64) >> 8 - k)).astype(np.uint8)
        order = np.argsort(prefix, kind="stable")
        path = prefix[order].astype(np.int64) << 8 * depth | context[order]
        first = runs(path)
        bit, each = (byte[order] >> 7 - k & 1).astype(np.int64), n[order]
        n1 = np.add.reduceat(each * bit, first)
        yield order, bit, first, path[first], np.add.reduceat(each, first) - n1, n1


def code_lengths(counted: DataFrame, p: TreeParams) -> DataFrame:
    """(gram, asked, code): each gram's code length under the whole tree, in parts of BIT_UNIT.

    The trees of different prefixes do not touch, and below a context neither do those of different bytes before it. So
    what lies under each context of CUT bytes is worked out in one task, from the leaves up; then what lies between
    those and a single byte, at most 65,536 nodes of each prefix and byte; and here what a root gives to the at most 256 nodes
    under it. Going down again, all that is above a context comes to two numbers, so each task can end its own part.
    Grams that the training rows do not have go along with no count, and get the chance of the deepest node there is.
    """
    spark, cut = counted.sparkSession, min(CUT, p.depth)
    size, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(1, -(-total // p.keep)) if p.keep else 1
    root = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * cut) - 1))
    every = counted.select(root.alias("root"), "gram", "n", "asked", F.lit(0).alias("prefix"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("left"))

    def together(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
        held = list(batches)
        rows = pd.concat(held, ignore_index=True) if held else None
        return rows if rows is not None and len(rows) else None

    def in_order(gram: np.ndarray) -> np.ndarray:
        return np.argsort(turned(gram >> 8, p.depth) << 8 | gram & 255)

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := together(batches)) is None:
            return
        gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        order = in_order(gram)
        for *_, path, n0, n1 in planes(gram[order], n[order], p.depth):
            top = climbed(path, n0, n1, None, p.depth - cut, least)[-1]
            yield pd.DataFrame({"prefix": (top.path >> 8 * cut).astype(np.int32), "root": turned(top.path, cut), "n0": top.n0, "n1": top.n1, "whole": top.whole})

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := together(batches)) is None:
            return
        path = rows["prefix"].to_numpy().astype(np.int64) << 8 * cut | turned(rows["root"].to_numpy(), cut)
        order = np.argsort(path)
        levels = climbed(path[order], *(rows[c].to_numpy()[order] for c in ("n0", "n1", "whole")), cut - 1, least)
        low, top = levels[0], levels[-1]
        mass, left = descended(levels, np.zeros(len(top.path)), np.ones(len(top.path)))
        rest = {"n0": 0, "n1": 0, "whole": 0.0}
        yield pd.DataFrame({"top": False, "prefix": (low.path >> 8 * cut).astype(np.int32), "root": turned(low.path, cut), "mass": mass, "left": left, **rest})
        rest = {"mass": 0.0, "left": 0.0}
        yield pd.DataFrame({"top": True, "prefix": (top.path >> 8).astype(np.int32), "root": top.path & 255, **rest, "n0": top.n0, "n1": top.n1, "whole": top.whole})

    deal = max(1, -(-size // DEAL))
    roots = materialize(every.repartition(deal, "root").mapInPandas(up, "prefix int, root long, n0 long, n1 long, whole double"), "roots")
    kinds = "top boolean, prefix int, root long, mass double, left double, n0 long, n1 long, whole double"
    dealt = roots.withColumn("byte", F.col("root").bitwiseAND(F.lit(255))).repartition(max(1, -(-roots.count() // DEAL)), "prefix", "byte")
    middle = materialize(dealt.mapInPandas(between, kinds), "middle")
    tops = middle.where("top").select((F.shiftleft(F.col("prefix").cast("long"), 8) + F.col("root")).alias("path"), "n0", "n1", "whole").toPandas().sort_values("path")  # at most 255 * 256
    levels = climbed(*(tops[c].to_numpy() for c in ("path", "n0", "n1", "whole")), 1, least)
    above = np.zeros((2, 1 << 16))
    above[:, levels[0].path] = descended(levels, np.where(levels[1].there, 0.0, 0.5), levels[1].there.astype(float))
    shipped = spark.sparkContext.broadcast(above)

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (rows := together(batches)) is None:
            return
        own = rows["gram"].to_numpy() == -1
        tops, rows = rows[own], rows[~own]
        prefix, context = tops["prefix"].to_numpy().astype(np.int64), tops["root"].to_numpy()
        mass, left = shipped.value[:, prefix << 8 | context & 255]
        mass, left = mass + left * tops["mass"].to_numpy(), left * tops["left"].to_numpy()
        at = prefix << 8 * cut | turned(context, cut)
        order = np.argsort(at)
        at, mass, left = at[order], mass[order], left[order]
        gram, n = rows["gram"].to_numpy(), rows["n"].to_numpy()
        order = in_order(gram)
        gram, n = gram[order], n[order]
        bits = np.zeros(len(gram))
        for at_node, bit, first, path, n0, n1 in planes(gram, n, p.depth):
            levels = climbed(path, n0, n1, None, p.depth - cut, least)
            place = np.searchsorted(at, levels[-1].path)
            m, rest = descended(levels, mass[place], left[place])
            one = np.repeat(m + rest * (n1 + 0.5) / (n0 + n1 + 1), np.diff(np.append(first, len(gram))))
            bits[at_node] -= np.log2(np.where(bit == 1, one, 1 - one))
        yield pd.DataFrame({"gram": gram, "asked": rows["asked"].to_numpy()[order], "code": np.round(bits / BIT_UNIT).astype(np.int64)})

    none = F.lit(-1).cast("long")  # no gram; a null would make pandas turn the others into floats
    over = middle.where("not top").select("root", none.alias("gram"), none.alias("n"), none.alias("asked"), "prefix", "mass", "left")
    out = materialize(every.unionByName(over).repartition(deal, "root").mapInPandas(down, "gram long, asked long, code long"), "lengths")
    discard(roots, middle)
    return out


def common_from(lengths: DataFrame, most: int) -> float:
    """The least `asked` such that no more than `most` grams have it or a larger one, to a sixteenth of a power of two."""
    step = F.floor(F.log2("asked") * 16)
    steps = lengths.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("asked").alias("asked")).orderBy(F.desc("s")).collect()  # at most 16 * 63
    least, sofar = float("inf"), 0
    for r in steps:
        sofar += r["n"]
        if sofar > most:
            break
        least = r["asked"]
    return least


class Slots:
    """Numbers by a distinct int64 key in open addressing, for whole arrays of keys at once. At most half the slots are used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, values.dtype)
        slot, todo = self.first(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & self.mask
        self.values[slot] = values

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether the key is in it."""
        slot = self.first(keys)
        there = self.keys[slot]
        hit = there == keys
        todo = np.flatnonzero(~hit & (there != -1))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            there = self.keys[slot[todo]]
            hit[todo] = there == keys[todo]
            todo = todo[(there != keys[todo]) & (there != -1)]
        return slot, hit


def weigh(depth: np.ndarray, context: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Chance of a one at each node of one prefix's whole tree, if it is the deepest that a context reaches."""
    out, deepest = np.empty(len(depth)), int(depth.max())
    path = lambda i, d: turned(context[i], d)
    at = np.flatnonzero(depth == deepest)
    at = at[np.argsort(path(at, deepest))]
    levels = climbed(path(at, deepest), n0[at], n1[at], None, deepest, 1)
    for j, level in enumerate(levels):
        mass, left = descended(levels[j:], np.zeros(1), np.ones(1))
        i = np.flatnonzero(depth == deepest - j)
        out[i] = (mass + left * (level.n1 + 0.5) / (level.n0 + level.n1 + 1))[np.searchsorted(level.path, path(i, deepest - j))]
    return out


class Coder:
    """Code lengths in bits under a tree held in memory: sorted keys (depth, context, prefix) and each node's chance of a one."""

    def __init__(self, keys: np.ndarray, one: np.ndarray, depth: int) -> None:
        self.depth, self.masks, self.nodes = depth, np.array([(1 << 8 * d) - 1 for d in range(depth + 1)]), Slots(keys, one)

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Code length of each gram's byte after its context, bit after bit at the deepest node there is."""
        d, context, byte, out = np.full(len(key), self.depth), key >> 8, key & 255, np.zeros(len(key))
        for k in range(8):
            prefix, bit = (1 << k) + (byte >> (8 - k)), byte >> (7 - k) & 1
            chance, todo = np.full(len(byte), 0.5), np.flatnonzero(d >= 0)
            while len(todo):
                at, hit = self.nodes.find(d[todo] << 56 | (context[todo] & self.masks[d[todo]]) << 8 | prefix[todo])
                chance[todo[hit]] = self.nodes.values[at[hit]]
                todo = todo[~hit]
                d[todo] -= 1
                todo = todo[d[todo] >= 0]
            out -= np.log2(np.where(bit == 1, chance, 1 - chance))
        return out


def gram_word(gram: np.ndarray) -> list[bytes]:
    """Grams as keys beside words: seven bytes and a tab, which no word has."""
    return (gram << 8 | 9).astype(">i8").view("S8").tolist()


def lm_scores(docs: DataFrame, p: TreeParams = TreeParams()) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    score is the log10 probability of the lower-cased text's bytes and its end under the tree. Null and empty texts
    have the end token and the end byte alone. Rows that repeat an id are scored one by one; a null id is learnt
    from. With nothing to learn from every bit has the chance one half. An empty table gives an empty result;
    columns other than doc_id and text are not looked at. A text is held whole in one task, with some 40 bytes beside
    each of its bytes.

    What is gathered are all contexts and all words of the training rows. Each byte's eight bits are coded one
    after another; a bit mixes the estimates of all depths of its context. The commonest grams and words are looked up
    from broadcast tables; the others of each document meet their code length or count in one join.
    """
    spark = docs.sparkSession
    counted = materialize(gram_counts(docs, p), "grams")
    lengths = code_lengths(counted, p)
    discard(counted)
    common = common_from(lengths, p.table)
    table = lengths.where(F.col("asked") >= common).select("gram", (F.col("code") * BIT_UNIT).cast("float").alias("bits")).toArrow()  # at most p.table grams
    slots = Slots(table["gram"].to_numpy(), table["bits"].to_numpy())
    vocabulary = materialize(word_counts(docs), "words")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    often = vocabulary.where(F.col("c") * p.frequent >= n).toArrow()  # at most p.frequent words
    frequent = dict(zip(often["word"].to_pylist(), np.log10(often["c"].to_numpy() + 0.5).tolist()))
    shipped = spark.sparkContext.broadcast((slots, frequent))
    whole = np.log10(n + 0.5 * (v + 1))

    numbers = ["uid", "doc_id", "n_tokens", "known", "base", "bits", "n_bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        from pyspark import TaskContext

        slots, frequent = shipped.value
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for part, texts in blocks(b):
                key, own = grams(texts, p.depth)
                bits, rare = np.zeros(len(key)), []
                for i in range(0, len(key), 1 << 16):  # what a processor's cache holds
                    at, hit = slots.find(key[i : i + (1 << 16)])
                    bits[i : i + (1 << 16)] = np.where(hit, slots.values[at], 0.0)
                    rare.append(np.flatnonzero(~hit) + i)
                bits, rare = np.bincount(own, bits, len(texts)), np.concatenate(rare)
                key, own = key[rare], own[rare]
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))) if len(key) else order
                each = pd.DataFrame({"uid": uid + own[first], "word": gram_word(key[first]), "k": np.diff(np.append(first, len(key)))})
                yield each.reindex(columns=[*numbers, "word", "k"])
                rows, word, k, sizes = [], [], [], []
                for doc, raw, x in zip(part["doc_id"].tolist(), texts, bits.tolist()):
                    words = Counter(raw.split())
                    words[b""] = 1
                    total, base, known, before = words.total(), 0.0, 0, len(word)
                    for w, n in words.items():
                        log = frequent.get(w)
                        if log is None:
                            word.append(w)
                            k.append(n)
                        else:
                            base += n * log
                            known += n
                    sizes.append(len(word) - before)
                    rows.append((uid + len(rows), doc, total, known, base - total * whole, x, len(raw) + 1))
                own_word = [b" %d" % row[0] for row in rows]  # no word has a space: it meets no other row in the join
                yield pd.DataFrame(rows, columns=numbers).astype({"doc_id": "Int64"}).assign(word=own_word, k=0)[[*numbers, "word", "k"]]
                each = pd.DataFrame({"uid": np.repeat(np.arange(uid, uid + len(rows)), sizes), "word": word, "k": np.array(k, np.int64)})
                yield each.reindex(columns=[*numbers, "word", "k"])
                uid += len(rows)

    # a row with the numbers of each document, and one for each of its words and of its grams that is not frequent
    rows = docs.select("doc_id", "text").mapInPandas(run, "uid long, doc_id long, n_tokens long, known long, base double, bits double, n_bytes long, word binary, k long")
    words = vocabulary.where(F.col("c") * p.frequent < n).select("word", F.lit(False).alias("is_gram"), F.round(F.log10(F.col("c") + 0.5) / UNIT).cast("long").alias("size"))
    rare = lengths.where(F.col("asked") < common).select(F.concat(F.unhex(F.lpad(F.hex("gram"), 14, "0")), F.lit(b"\t")).alias("word"), F.lit(True).alias("is_gram"), F.col("code").alias("size"))
    joined = rows.join(words.unionByName(rare).hint("shuffle_hash"), "word", "left")
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("is_gram") if kind else ~F.col("is_gram"), x)), F.lit(0))
    summed = joined.groupBy("uid").agg(
        *[F.max(c).alias(c) for c in numbers[1:]],  # one row of each document has them
        of(False, F.col("k")).alias("rare_known"), (of(False, F.col("k") * F.col("size")) * UNIT).alias("rare_base"), (of(True, F.col("k") * F.col("size")) * BIT_UNIT).alias("rare_bits"),
    )
    unseen = F.col("n_tokens") - F.col("known") - F.col("rare_known")
    bits = F.col("bits") + F.col("rare_bits")
    return summed.select(
        "doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base") + unseen * F.log10(F.lit(0.5))).alias("base_score"), (-bits / F.lit(float(LOG2_10))).alias("score"), "n_bytes", (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
