"""Differences of versions: lines of texts in order, and modules of packages."""

from __future__ import annotations

import heapq
import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines of one side beyond which `diff` counts bags of lines, as the original does; no query asks for it.
#: Lines of an excerpt, alone and within a package's difference.
MAX_LINES, EXCERPT, SAMPLE = 4000, 80, 60

#: Bytes of the bits of lines that are kept at once; those of rarer lines are made when they are asked for.
BITS = 16 << 20

#: Pairs whose results are held at once.
PAIRS = 200
LINES = "added long, removed long, excerpt string, truncated boolean"


def lines_of(text: str | None) -> list[str]:
    """Lines without the white space at their ends."""
    return [re.sub(r"\s+$", "", x) for x in (text or "").replace("\r\n", "\n").split("\n")]


def _bits(places: list[int], size: int) -> int:
    """A number with these bits."""
    out = bytearray(size // 8 + 1)
    for c in places:
        out[c >> 3] |= 1 << (c & 7)
    return int.from_bytes(out, "little")


def common_rows(a: list[str], b: list[str], last: int | None = None) -> deque[int]:
    """For r = 0 .. len(a), a number whose bit c is 0 where the last r lines of a and the last c + 1 of b have a longer
    common subsequence than with the last c: the rows of the table of lengths, a bit for each cell. last: how many of
    the rows are kept, all if None.

    A whole row comes from the one before by an addition, whose carries pass on along each run of lengths. Beside the
    rows that are kept, the bits of b's commonest lines are held, in BITS bytes, and the places of all others.
    """
    places: dict[str, list[int]] = {}
    asked = set(a)
    for c, line in enumerate(reversed(b)):
        if line in asked:
            places.setdefault(line, []).append(c)
    held = {line: _bits(places[line], len(b)) for line in heapq.nlargest(BITS // (len(b) // 8 + 1), places, key=lambda x: len(places[x]))}
    full = (1 << len(b)) - 1
    rows, v = deque([full], last), full
    for line in reversed(a):
        if line in places:
            own = held.get(line)
            u = v & (_bits(places[line], len(b)) if own is None else own)
            v = (v + u | v - u) & full
        rows.append(v)
    return rows


def equal_start(a: list[str], b: list[str]) -> int:
    """How many lines both begin with. Equal ends are none of it: which of several equal lines is kept hangs on them."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    return head


def _walk(a: list[str], b: list[str], head: int, rows: deque[int]) -> Iterator[tuple[str, str]]:
    """(mark, line) of the difference, in which the first `head` lines are equal; rows are those of the lines after them,
    of which a walk of n lines needs the last n + 1."""
    yield from ((" ", x) for x in a[:head])
    i = j = head
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield " ", a[i]
            i, j = i + 1, j + 1
            continue
        rest = (1 << len(b) - j) - 1
        if (rows[head - i - 1] & rest).bit_count() == (rows[head - i - 2] & rest).bit_count():  # as long without this line
            yield "-", a[i]
            i += 1
        else:
            yield "+", b[j]
            j += 1
    yield from (("-", x) for x in a[i:])
    yield from (("+", x) for x in b[j:])


def script(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """(mark, line) of a shortest difference: equal lines are kept wherever they meet, and a line of a goes before one
    of b comes where both are as good."""
    head = equal_start(a, b)
    yield from _walk(a, b, head, common_rows(a[head:], b[head:]))


def exact_diff(a: list[str], b: list[str], excerpt: int) -> tuple[int, int, str, bool]:
    """added, removed, the first `excerpt` lines of the difference, whether there were more, for texts of any length.

    The last row tells how many lines stay, and an excerpt needs no more rows than it has lines, so of the table only
    these are kept. Time is a bit operation for each pair of lines."""
    head = equal_start(a, b)
    rows = common_rows(a[head:], b[head:], excerpt + 2)
    kept = len(b) - rows[-1].bit_count()
    out = [f"{mark} {line}" for mark, line in islice(_walk(a, b, head, rows), excerpt)]
    return len(b) - kept, len(a) - kept, "\n".join(out), len(a) + len(b) - kept > excerpt


def diff(a: list[str], b: list[str], excerpt: int) -> tuple[int, int, str, bool]:
    """exact_diff of texts of at most MAX_LINES lines, and beyond that the difference of bags of lines, as the original
    has it. What Spark is asked for is exact_diff at any length."""
    if max(len(a), len(b)) > MAX_LINES:
        x, y = Counter(a), Counter(b)
        return sum((y - x).values()), sum((x - y).values()), "", True
    return exact_diff(a, b, excerpt)


def ordered_diff(pairs: DataFrame, excerpt: int = EXCERPT, arrow: bool = True) -> DataFrame:
    """pairs without a and b, and with added, removed, excerpt, truncated: the changes from text a to text b against a
    longest common subsequence of their lines. A null text is one empty line.

    Counts are exact for texts of any length. Tasks hold a pair's lines, the bits of the commonest of them (BITS) and a
    bit for each line of b and of the excerpt, beside what Arrow holds of a batch: texts become Python strings a pair at
    a time, results leave by PAIRS. A text may lie in one task alone, so pairs are what Spark spreads. With arrow false,
    a batch's texts are Python strings at once.
    """
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = [exact_diff(lines_of(a), lines_of(b), excerpt) for a, b in zip(p["a"], p["b"], strict=True)]
            yield pd.concat([p[keys].reset_index(drop=True), pd.DataFrame(found, columns=["added", "removed", "excerpt", "truncated"])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for i in range(0, len(whole), PAIRS):
                p = whole.slice(i, PAIRS)
                found = [exact_diff(lines_of(a.as_py()), lines_of(b.as_py()), excerpt) for a, b in zip(p["a"], p["b"], strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                out = p.select(keys).combine_chunks()
                for name, c in zip(("added", "removed", "excerpt", "truncated"), columns, strict=True):
                    out = out.append_column(name, c)
                yield from out.to_batches()

    asked, schema = pairs.select(*keys, "a", "b"), f"{schema}, {LINES}"
    return asked.mapInArrow(run, schema) if arrow else asked.mapInPandas(held, schema)


def lines_changed(before: Column, after: Column) -> Column:
    """Whether two texts differ in more than line ends and white space at the ends of lines."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"(?m)[ \t\r\f\x0B]+$", "")
    return clean(before) != clean(after)


def package_changes(before: DataFrame, after: DataFrame, keys: list[str], sample: int = SAMPLE) -> DataFrame:
    """A row for each module of either version: keys, module, status, added_lines, removed_lines, sample, place, and of
    its package from_modules, to_modules, unchanged and identical.

    before and after: keys, module, text. Lines are compared of modules alone that are in both and differ beyond
    white space at ends of lines; only these texts reach Python. place orders a package's changed modules by the
    lines they change, most first, then by name. Line counts and sample are null for other modules.
    """
    both = before.select(*keys, "module", F.col("text").alias("a"), F.lit(True).alias("from")).join(after.select(*keys, "module", F.col("text").alias("b"), F.lit(True).alias("to")), [*keys, "module"], "full")
    status = (
        F.when(F.col("from").isNull(), "added").when(F.col("to").isNull(), "removed")
        .when(F.coalesce(lines_changed(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))), F.lit(False)), "changed").otherwise("unchanged")
    )
    told = both.withColumn("status", status)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("added", "long"), ("removed", "long"), ("excerpt", "string"), ("truncated", "boolean"))]
    same = told.where("status <> 'changed'").select(*keys, "module", "status", *none)
    rows = same.unionByName(ordered_diff(told.where("status = 'changed'").select(*keys, "module", "status", "a", "b"), sample, arrow=False))
    package, n = W.partitionBy(*keys), lambda *s: F.count_if(F.col("status").isin(*s))
    order = package.orderBy((F.col("status") != "changed"), F.desc(F.col("added") + F.col("removed")), "module")
    return rows.select(
        *keys, "module", "status", F.col("added").alias("added_lines"), F.col("removed").alias("removed_lines"), F.col("excerpt").alias("sample"),
        F.when(F.col("status") == "changed", F.row_number().over(order)).cast("long").alias("place"),
        n("removed", "changed", "unchanged").over(package).alias("from_modules"), n("added", "changed", "unchanged").over(package).alias("to_modules"),
        n("unchanged").over(package).alias("unchanged"), (n("added", "removed", "changed").over(package) == 0).alias("identical"),
    )
