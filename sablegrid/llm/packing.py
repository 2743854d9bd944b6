"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Bytes that the chunks and ids known to one Python worker may take; what was not met lately goes first.
CACHE = 48_000_000
#: Bytes of an entry of a dictionary of small byte strings beside the strings' own characters.
ENTRY = 170
_STOPS = re.compile(rb"(?<=[a-z])([!-/:-@\[-`{-~]+)(?=[\x20\x09-\x0D]|$)")
_encoders: dict[str, Encoder] = {}
PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


@dataclass(frozen=True)
class PackParams:
    """length: tokens of a sequence. end_id: follows each document. open_bins: sequences open at once in a task.
    rows_per_task: documents a packing task gets, whatever the size of the input. tokenizer: file of a tokenizer
    that drops white space and never merges across it."""

    tokenizer: str
    length: int = 4096
    end_id: int = 1
    open_bins: int = 1024
    rows_per_task: int = 250_000


class BoundedBestFit:
    """Online best fit with at most `limit` open bins; the fullest one closes when another has to open.

    Bit f of `levels` is set if an open bin has f tokens free, so the best bin for a piece is the lowest set bit
    at or above its length, and the fullest bin is the lowest set bit.
    """

    def __init__(self, length: int, limit: int) -> None:
        self.length, self.limit, self.levels, self.open, self.made = length, limit, 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_id = stack.pop()
        if not stack:
            self.levels &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to length tokens."""
        fits = self.levels >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            if self.open == self.limit:
                self._take((self.levels & -self.levels).bit_length() - 1)
            self.bins.setdefault(left, []).append(bin_id)
            self.levels |= 1 << left
            self.open += 1
        return bin_id, self.length - free


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    White space is dropped and nothing merges across it, so the ids of a text are those of its chunks one after
    another; chunks recur, and only new ones reach the tokenizer. Those met lately are kept in two halves: when the
    young half is full it becomes the old one, which is let go.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.size = Tokenizer.from_file(path), {}, {}, 0
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        words = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(words.values(), default=-1) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in words.items() if t.endswith(suffix)]] = True

    def ids(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each chunk with its ids. Chunks of letters alone are single words; where the tokenizer marks the tokens that
        end a word, they are encoded many at a time and told apart by these."""
        texts = [c.decode() for c in chunks]
        plain = [w for w in texts if w.isalpha()] if len(self.ends) else []
        rest = [w for w in texts if not w.isalpha()] if plain else texts
        joined = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for some, e in zip(joined, self.tokenizer.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) == len(some) + 1 and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                yield from zip([w.encode() for w in some], [raw[p:q] for p, q in zip(cuts, cuts[1:])])
            else:
                rest += some
        for i in range(0, len(rest), 20_000):
            for w, e in zip(rest[i : i + 20_000], self.tokenizer.encode_batch_fast(rest[i : i + 20_000], add_special_tokens=False)):
                yield w.encode(), array("I", e.ids).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [_chunks(t) for t in texts]
        if self.size > CACHE // 2:
            self.young, self.old, self.size = {}, self.young, 0
        new = set().union(*split).difference(self.young)
        met = {w: self.old[w] for w in new & self.old.keys()}
        met.update(self.ids(list(new.difference(met))))
        self.young.update(met)
        self.size += ENTRY * len(met) + sum(map(len, met)) + sum(map(len, met.values()))
        known = self.young
        return [b"".join([known[w] for w in ws]) for ws in split]


def _chunks(text: str | None) -> list[bytes]:
    """A text between white space, in lower case, which the tokenizer folds anyway, with the marks
    that end a chunk after a letter apart, which it splits off anyway; so fewer different strings reach it. What may
    hold a special token stays as it is."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.split() if b"<|" in raw else _STOPS.sub(rb" \1", raw.lower()).split()


def pieces(docs: DataFrame, params: PackParams) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents with their end id, cut where longer than a sequence."""
    width, end = params.length * 4, np.array([params.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if params.tokenizer not in _encoders:
            _encoders[params.tokenizer] = Encoder(params.tokenizer)
        encode = _encoders[params.tokenizer]
        for part in slices(batches, 1024):
            rows: list[list] = [[] for _ in PIECE]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                ids += end
                for k, i in enumerate(range(0, len(ids), width)):
                    own = ids[i : i + width]
                    for column, x in zip(rows, (doc, k, i // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, PIECE.values(), strict=True)], list(PIECE))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, tasks: int, params: PackParams) -> DataFrame:
    """sequence_id and offset for pieces. Each task packs its own part in a fixed order, so a task that is run
    again gives the same sequences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        bins = BoundedBestFit(params.length, params.open_bins)
        for b in batches:
            placed = [bins.place(n) for n in b["length"].tolist()]
            yield b.drop(columns="turn").assign(sequence_id=[first + s for s, _ in placed], offset=[o for _, o in placed])

    # long and short pieces come in a random order, so that short ones fill what long ones leave
    mixed = cut.withColumn("turn", F.xxhash64("doc_id", "piece", "start"))
    dealt = mixed.repartition(tasks, "doc_id").sortWithinPartitions("turn", "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id alone. Rows that repeat an id are packed one by one,
    as are null ids. Texts of any length are encoded whole and cut into pieces. Of equally full bins the one that came
    last takes a piece; pieces that are the same in all come in any order. An empty table gives an empty result; columns
    other than doc_id and text are not looked at.
    """
    tasks = max(1, -(-docs.count() // params.rows_per_task))
    return pack(pieces(docs, params), tasks, params)
