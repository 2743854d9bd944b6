"""Sampled SentencePiece segmentations without replacement, and decoding."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SPACE = "▁"
#: Pieces hold their space mark in front or are space marks alone, and never a line feed, so a lattice is those of its chunks in a row.
_CHUNK = re.compile("\n| *[^ \n]+| +")
_models: dict[str, "Vocabulary"] = {}
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SampleParams:
    """model: file of a SentencePiece model with byte fallback. samples: distinct segmentations of a text.
    temperature: of the distribution over segmentations. chunks: chunks of a text that are worked on at once."""

    model: str
    samples: int = 2
    temperature: float = 1.0
    seed: int = 42
    chunks: int = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(numbers: list[int]) -> np.ndarray:
    """The last 64 bits of each number."""
    return np.array([x & (1 << 64) - 1 for x in numbers], np.uint64)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1, of 32 bits."""
    return ((mix(x * _M) >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


class Vocabulary:
    """Pieces as a trie over characters in a hash table, so that many texts walk it at once.

    Pieces of a merge model have ranks, not probabilities; piece r gets a weight of 1 / (r + 1), the usual law of
    word frequencies. A character that is no piece is its bytes, each as likely as the last piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((-sp.get_score(i), i, piece))
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        plain.sort()
        whole = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        self.log = np.zeros(n)
        nodes, self.piece_at = {}, [-1]
        for r, (_, i, piece) in enumerate(plain):
            self.log[i] = -math.log(r + 1) - whole
            at = 0
            for c in piece:
                key = (at << 21) | ord(c)
                if key not in nodes:
                    nodes[key] = len(self.piece_at)
                    self.piece_at.append(-1)
                at = nodes[key]
            self.piece_at[at] = i
        self.least = -math.log(len(plain)) - whole
        self.piece_at = np.array(self.piece_at)
        # a slot holds a key and the node it leads to; at most a quarter of the slots are taken
        self.bits = (4 * len(nodes)).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        for key, to in nodes.items():
            h = (key * int(_M) & (1 << 64) - 1) >> (64 - self.bits)
            while self.slots[h] >= 0:
                h = (h + 1) & (1 << self.bits) - 1
            self.slots[h] = key << 21 | to
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)

    def step(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next trie nodes, or -1."""
        key = (at << 21) | code
        h = ((key.view(np.uint64) * _M) >> np.uint64(64 - self.bits)).view(np.int64)
        held = self.slots[h]
        out = np.where(held >> 21 == key, held & (1 << 21) - 1, -1)
        todo = np.flatnonzero((out < 0) & (held >= 0))
        while len(todo):
            h[todo] = (h[todo] + 1) & (1 << self.bits) - 1
            held = self.slots[h[todo]]
            hit = held >> 21 == key[todo]
            out[todo[hit]] = held[hit] & (1 << 21) - 1
            todo = todo[~hit & (held >= 0)]
        return out


#: Characters of a slice of a lattice: what is at hand while it is made stays in a core's cache.
_SLICE = 1 << 15


class Lattice:
    """Segmentations of distinct chunks, in which a space counts as a space mark. Node numbers run through all chunks;
    a node's edges lie together, the longest first, and nodes lie as in the text. It is made in slices of chunks.

    The log of the total weight from a node to its chunk's end is worked out backwards, so an edge's share of its
    start's total is the exact chance that a segmentation that has come to the start goes on with it. cond is the log
    of it, upto the sum of chances up to the edge, added up for each node alone: both hang on the chunk only.
    """

    def __init__(self, chunks: list[str], v: Vocabulary, temperature: float) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.concatenate(([0], np.cumsum(sizes)))  # characters before each chunk
        self.start = first[:-1] + np.arange(len(chunks))  # first node of each chunk
        self.end = self.start + sizes
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, int(first[-1]), _SLICE)), len(chunks))).tolist()
        parts = [_slice(chunks[a:b], sizes[a:b], v, temperature) for a, b in zip(cuts[:-1], cuts[1:])]
        for (ids, src, dst, *_), a in zip(parts, cuts):
            src += self.start[a]
            dst += self.start[a]
        self.ids, self.src, self.dst, self.cond, self.upto, self.count = map(np.concatenate, zip(*parts))
        self.head = np.cumsum(self.count, dtype=np.int64) - self.count

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node by its chance; long pieces, the likeliest as a rule, are tried first."""
        edge = self.head[node]
        todo = np.flatnonzero(u >= self.upto[edge])
        while len(todo):
            edge[todo] += 1
            todo = todo[u[todo] >= self.upto[edge[todo]]]
        return edge


def _slice(chunks: list[str], sizes: np.ndarray, v: Vocabulary, temperature: float) -> tuple[np.ndarray, ...]:
    """ids, src, dst, cond and upto of the edges of these chunks, whose nodes count from 0, and each node's edges."""
    code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    code[code == 32] = ord(SPACE)
    own = np.repeat(np.arange(len(chunks)), sizes)
    node = np.arange(len(code)) + own
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters from here to the chunk's end
    found, count = [], np.zeros(len(code), np.int64)
    at, pos, n = np.zeros(len(code), np.int64), np.arange(len(code)), 0
    while len(pos):
        at = v.step(at, code[pos + n])
        good = np.flatnonzero(at >= 0)
        at, pos, n = at[good], pos[good], n + 1
        piece = v.piece_at[at]
        hit = np.flatnonzero(piece >= 0)
        ends, piece = pos[hit], piece[hit]
        found.append((ends, piece, v.log[piece]))
        count[ends] += 1
        if n == 1:
            bare = np.flatnonzero(count == 0)
            own_code = code[bare]
            bytes_ = np.where(own_code < 0x80, 1, np.where(own_code < 0x800, 2, np.where(own_code < 0x10000, 3, 4)))
            # one byte is its piece, a negative number a character in several
            found.append((bare, np.where(bytes_ == 1, v.byte_ids[own_code & 0x7F], -own_code - 1), v.least * bytes_))
            count[bare] += 1
        more = np.flatnonzero(left[pos] > n)
        at, pos = at[more], pos[more]
    free = np.cumsum(count)
    head = free - count
    ids, log, size = np.empty(free[-1], np.int32), np.empty(free[-1]), np.empty(free[-1], np.int32)
    for k, (pos, own_ids, own_log) in enumerate(found):
        free[pos] -= 1
        i = free[pos]
        ids[i], log[i], size[i] = own_ids, own_log, max(1, k)  # the second entry has the bare characters
    log /= temperature
    src = np.repeat(node.astype(np.int32), count)
    dst = src + size
    back = np.zeros(len(code) + len(chunks))
    level = left.astype(np.int16) if left.max() < 30_000 else left
    order = np.argsort(level, kind="stable")
    steps = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
    begin, held = head[order], count[order]
    cut = np.concatenate(([0], np.cumsum(held)))
    every = np.arange(cut[-1]) + np.repeat(begin - cut[:-1], held)  # edges by their distance from the end
    w, to, at = log[every], dst[every], node[order]
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        if a < b:
            e = slice(cut[a], cut[b])
            own_w = w[e]
            own_w += back[to[e]]
            heads = cut[a:b] - cut[a]
            top = np.maximum.reduceat(own_w, heads)
            back[at[a:b]] = top + np.log(np.add.reduceat(np.exp(own_w - np.repeat(top, held[a:b])), heads))
    cond = log + back[dst] - back[src]
    upto = np.exp(cond)
    more, k = head[count > 2], 1  # the last edge takes what rounding leaves
    count_of = count[count > 2]
    while len(more):
        upto[more + k] += upto[more + k - 1]
        k += 1
        more, count_of = more[count_of > k + 1], count_of[count_of > k + 1]
    upto[head + count - 1] = 2.0
    counts = np.zeros(len(back), np.int32)
    counts[node] = count
    return ids, src, dst, cond, upto, counts


def _split(text: str | None) -> list[str]:
    return _CHUNK.findall(" " + text.replace(SPACE, " ")) if text else []


class _Numbers(dict):
    """Numbers of chunks in the order of their first asking."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


#: A prefix's value is at most its log chance plus this: uniform numbers have 32 bits, and -log(-log(1 - 2 ** -33)) is less.
REACH = 22.9
#: Edges of paths that are looked at together.
_SIDE_BY_SIDE = 1 << 17


@dataclass
class Path:
    """A whole segmentation: its edges, and where each chunk's begin."""

    edges: np.ndarray
    at: np.ndarray


def best_paths(l: Lattice, types: list[np.ndarray], seeds: list[int], drawn: list[list[Path]], k: int) -> list[tuple[list[tuple[float, Path]], float]]:
    """Perturbed A*: for each text the k segmentations of the greatest perturbed values with these, and the next value.

    A queue entry is a prefix with the greatest perturbed value among its completions, so entries leave the queue
    in the order of the segmentations' own values. A prefix hands its value down to the child that holds the
    maximum, which is any child by its exact chance; so the way down is a draw, made for all texts of a block at
    once. The siblings along it get Gumbel numbers under the condition that they are smaller, and wait. Only the
    best few of them can be wanted, and none whose log chance is more than REACH below those. Every text has a queue
    and numbers of its own; they take their steps together.
    """
    base, used = _words(seeds), np.zeros(len(types), np.int64)

    def numbers(of: np.ndarray, place: np.ndarray) -> np.ndarray:
        return uniform(mix(place.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + base[of]))

    def siblings(of: np.ndarray, paths: list[Path], first: np.ndarray, log: np.ndarray, g: np.ndarray, want: int, serial: int) -> list[list[tuple]]:
        """The best entries beside each text's path from its edge `first` on."""
        found: list[list[tuple]] = [[] for _ in paths]
        long = np.array([len(p.edges) for p in paths], np.int64)
        todo, size = np.flatnonzero(first < long), 256
        while len(todo):
            wide = np.minimum(long[todo] - first[todo], size)
            rows = max(1, _SIDE_BY_SIDE // int(wide.max()))
            for a in range(0, len(todo), rows):
                r, w = todo[a : a + rows], wide[a : a + rows]
                e = np.concatenate([paths[i].edges[x : x + n] for i, x, n in zip(r.tolist(), first[r].tolist(), w.tolist())])
                row = np.repeat(np.arange(len(r)), w)
                col = np.arange(len(e)) - np.repeat(np.cumsum(w) - w, w)
                before = np.zeros((len(r), int(w.max()) + 1))
                before[row, col + 1] = l.cond[e]
                before = log[r][:, None] + np.cumsum(before, axis=1)
                node = l.src[e]
                count = l.count[node]
                step = np.repeat(np.arange(len(e)), count)
                every = np.arange(len(step)) + np.repeat(l.head[node] - np.cumsum(count) + count, count)
                other = np.flatnonzero(every != e[step])
                every, step = every[other], step[other]
                mine = row[step]
                many = np.bincount(mine, minlength=len(r))
                stop = np.cumsum(many)
                place = np.arange(len(step)) + (used[of[r]] - stop + many)[mine]
                own = before[mine, col[step]] + l.cond[every]
                less = np.log(np.exp(np.minimum(own - g[r][mine], 700.0)) - np.log(numbers(of[r][mine], place))) - own
                used[of[r]] += many
                log[r] = before[np.arange(len(r)), w]
                top = [x + np.argpartition(less[x:y], want)[:want] if y - x > want else np.arange(x, y) for x, y in zip((stop - many).tolist(), stop.tolist())]
                top = np.concatenate(top)
                at = first[r][mine[top]] + col[step[top]]
                for i, *entry in zip(r[mine[top]].tolist(), less[top].tolist(), (serial + at).tolist(), every[top].tolist(), at.tolist(), own[top].tolist()):
                    found[i].append((*entry, paths[i]))
                for i in r.tolist():
                    found[i] = sorted(found[i], key=lambda x: x[:3])[:want]
            first[todo] += size
            size *= 2
            reach = np.array([-found[i][-1][0] if len(found[i]) == want else -math.inf for i in todo.tolist()])
            todo = todo[(first[todo] < long[todo]) & (log[todo] + REACH >= reach)]
        return found

    of = np.arange(len(types))
    g = -np.log(-np.log(numbers(of, used)))
    used += 1
    out = [[(x, own[0])] for x, own in zip(g.tolist(), drawn)]
    queues = siblings(of, [own[0] for own in drawn], np.zeros(len(of), np.int64), np.zeros(len(of)), g, k, 0)
    for queue in queues:
        heapq.heapify(queue)
    for n in range(1, k):
        of = np.array([d for d, queue in enumerate(queues) if queue], np.int64)
        if not len(of):
            break
        value, _, edge, at, log, parents = zip(*(heapq.heappop(queues[d]) for d in of.tolist()))
        chunks = [int(np.searchsorted(parent.at, x, side="right")) - 1 for parent, x in zip(parents, at)]
        end = l.end[[types[d][chunk] for d, chunk in zip(of.tolist(), chunks)]]
        tails, edge = [[x] for x in edge], np.array(edge)
        todo = np.flatnonzero(l.dst[edge] != end)
        while len(todo):
            edge[todo] = l.draw(l.dst[edge[todo]], numbers(of[todo], used[of[todo]]))
            used[of[todo]] += 1
            for i, x in zip(todo.tolist(), edge[todo].tolist()):
                tails[i].append(x)
            todo = todo[l.dst[edge[todo]] != end[todo]]
        paths = []
        for d, less, x, chunk, tail, parent in zip(of.tolist(), value, at, chunks, tails, parents):
            fresh = drawn[d][n]
            rest = int(fresh.at[chunk + 1])
            edges = np.concatenate([parent.edges[:x], tail, fresh.edges[rest:]]).astype(np.int64)
            paths.append(Path(edges, np.concatenate([parent.at[: chunk + 1], fresh.at[chunk + 1 :] - rest + x + len(tail)])))
            out[d].append((-less, paths[-1]))
        for d, more in zip(of.tolist(), siblings(of, paths, np.array(at) + 1, np.array(log), -np.array(value), k - n + 1, (n + 1) << 40)):
            for entry in more:
                heapq.heappush(queues[d], entry)
    return [(own, -queue[0][0] if queue else -math.inf) for own, queue in zip(out, queues)]


def sample_block(texts: list[str | None], seeds: list[int], v: Vocabulary, p: SampleParams) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: ids, log probability, perturbed value, inclusion probability."""
    number, parts = _Numbers(), []
    for chunks in map(_split, texts):
        parts.append(np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks)))
    if not number:
        return [[(np.empty(0, np.int64), 0.0, 0.0, 1.0)] for _ in texts]
    l = Lattice(list(number), v, p.temperature)
    occ = np.concatenate(parts)
    sizes = np.array([len(x) for x in parts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    of = np.repeat(np.arange(len(texts)), sizes)
    index = np.arange(len(occ)) - starts[of]
    base = _words(seeds)[of] + index.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    drawn = [_draw_all(l, occ, base, j) for j in range(p.samples)]
    full = np.flatnonzero(sizes).tolist()
    ends = [(int(starts[d]), int(starts[d + 1])) for d in full]
    own = [[Path(edges[at[a] : at[b]], at[a : b + 1] - at[a]) for edges, at in drawn] for a, b in ends]
    out = [[(np.empty(0, np.int64), 0.0, 0.0, 1.0)] for _ in texts]
    for d, (best, after) in zip(full, best_paths(l, [occ[a:b] for a, b in ends], [seeds[d] for d in full], own, p.samples)):
        out[d] = rows = []
        for g, path in best:
            log = float(l.cond[path.edges].sum())
            # chance that its value is above that of the next one: 1 - exp(-exp(log - after))
            inside = 1.0 if after == -math.inf else -math.expm1(-math.exp(min(700.0, log - after)))
            rows.append((_ids(l.ids[path.edges], v), log, g, inside))
    return out


def _draw_all(l: Lattice, occ: np.ndarray, base: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """A segmentation of every chunk: edges in order, and where each chunk's begin."""
    node, todo, steps = l.start[occ].copy(), np.arange(len(occ)), []
    length = np.zeros(len(occ), np.int64)
    while len(todo):
        salt = np.uint64((j * 0x2545F4914F6CDD1D + (len(steps) + 1) * 0x9E6C63D0876A9A47) & (1 << 64) - 1)
        e = l.draw(node[todo], uniform(base[todo] ^ salt))
        steps.append((todo, e))
        length[todo] += 1
        node[todo] = l.dst[e]
        todo = todo[node[todo] != l.end[occ[todo]]]
    at = np.concatenate(([0], np.cumsum(length)))
    edges = np.empty(int(at[-1]), np.int64)
    for n, (rows, e) in enumerate(steps):
        edges[at[rows] + n] = e
    return edges, at


def _ids(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids with characters in bytes written out."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    written = [v.byte_ids[list(chr(-i - 1).encode("utf-8", "surrogatepass"))] for i in ids[bare].tolist()]
    size = np.ones(len(ids), np.int64)
    size[bare] = [len(w) for w in written]
    out = np.repeat(ids, size)
    out[np.repeat(ids < 0, size)] = np.concatenate(written)
    return out


def decode(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    """The text of ids: pieces and bytes in a row, less the space that encoding puts in front."""
    ids = np.asarray(ids, np.int64)
    size = v.size[ids]
    stop = np.cumsum(size)
    raw = v.all_bytes[np.arange(size.sum()) + np.repeat(v.begin[ids] - stop + size, size)].tobytes().decode("utf-8", "replace")
    return raw[1:] if raw[:1] == " " else raw


def vocabulary(path: str) -> Vocabulary:
    if path not in _models:
        _models[path] = Vocabulary(path)
    return _models[path]


def sampled(docs: DataFrame, p: SampleParams, with_ids: bool = True) -> DataFrame:
    """Rows for each row of docs and each of its samples: doc_id, rank, n_pieces, ids_crc32, log_prob, perturbed,
    inclusion, decoded (whether decoding gives the text back), and ids, the segmentation itself, unless with_ids is false.

    Samples of a row are distinct, in falling order of their perturbed values; a text with fewer segmentations has
    fewer rows. inclusion is the chance to be among the samples, given the first value outside them. Null and
    empty texts have the empty segmentation alone. The randomness of a row comes from the seed and its doc_id
    alone, so rows that repeat an id and a text give the same samples; rows without an id share one. A space mark
    in a text decodes to a space. An empty table gives an empty result; columns other than doc_id and text are not
    looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        v = vocabulary(p.model)
        for b in batches:
            block: list[tuple] = []
            size = 0
            for doc, text in zip(b["doc_id"].tolist(), b["text"].tolist()):
                doc = None if doc is None or doc != doc else int(doc)
                n = text.count(" ") + text.count("\n") + 1 if text else 0
                if block and size + n > p.chunks:
                    yield work(block, v)
                    block, size = [], 0
                block.append((doc, text, xxhash.xxh64_intdigest(str(doc), p.seed)))
                size += n
            if block:
                yield work(block, v)

    def work(block: list[tuple], v: Vocabulary) -> pd.DataFrame:
        rows = []
        for (doc, text, _), own in zip(block, sample_block([t for _, t, _ in block], [s for *_, s in block], v, p)):
            want = (text or "").replace(SPACE, " ")
            for rank, (ids, log, g, inside) in enumerate(own, 1):
                same = decode(ids, v) == want
                ids = ids.astype("<i4")
                rows.append((doc, rank, len(ids), zlib.crc32(ids.tobytes()), log, g, inside, same, *([ids] if with_ids else [])))
        names = ["doc_id", "rank", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "decoded", *(["ids"] if with_ids else [])]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    held = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded boolean{held}")
