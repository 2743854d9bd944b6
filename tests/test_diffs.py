"""Line differences against the table of common lengths, package differences row by row."""

import random
import time

import pytest

from sablegrid.operators import diffs


def by_table(a, b):
    """The whole table of lengths and the walk through it."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and t[i + 1][j] >= t[i][j + 1]):
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abcd", "abcdefghijkl"])
def test_same_script_as_the_table(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        a, b = (rng.choices(letters, k=rng.randint(0, 25)) for _ in range(2))
        assert list(diffs.script(a, b)) == by_table(a, b)


def test_long_texts():
    rng = random.Random(2)
    a, b = ([str(rng.randrange(3000)) for _ in range(4000)] for _ in range(2))
    began = time.process_time()
    added, removed, _, truncated = diffs.diff(a, b, 80)
    assert time.process_time() - began < 1 and truncated and added == removed
    began = time.process_time()
    a, b = (["ab"[rng.random() < p] for _ in range(4000)] for p in (0.3, 0.6))
    assert diffs.diff(a, b, 80)[0] > 0 and time.process_time() - began < 1
    # beyond the limit, bags of lines
    assert diffs.diff(["a"] * 5000, ["a"] * 4999 + ["b"], 80) == (1, 1, "", True)
    assert diffs.diff(["a", "b"] * 2500, ["b", "a"] * 2500, 80) == (0, 0, "", True)


def test_excerpts_show_what_stays():
    assert diffs.diff(["a", "b", "c"], ["a", "x", "c"], 80) == (1, 1, "  a\n- b\n+ x\n  c", False)
    assert diffs.diff(["a", "b", "c"], ["a", "x", "c"], 2) == (1, 1, "  a\n- b", True)
    assert diffs.diff(["x"], ["x"], 80) == (0, 0, "  x", False) and diffs.diff([], ["x"], 0) == (1, 0, "", True)
    assert diffs.lines_of("a \r\nb\t\n") == ["a", "b", ""] and diffs.lines_of(None) == [""]


def test_ordered_diff_in_tasks(spark):
    pairs = spark.createDataFrame([(1, "k", "a\nb", "a\nc"), (2, "k", None, "x"), (3, None, None, None)], "key long, `other key` string, a string, b string")
    got = sorted(map(tuple, diffs.ordered_diff(pairs).collect()))
    assert got == [(1, "k", 1, 1, "  a\n- b\n+ c", False), (2, "k", 1, 1, "- \n+ x", False), (3, None, 0, 0, "  ", False)]
    assert diffs.ordered_diff(pairs.limit(0)).count() == 0


def test_package_changes(spark):
    m = lambda *x: spark.createDataFrame(x, "p long, module string, text string")
    before = m((1, "same", "x\r\ny"), (1, "gone", "1"), (1, "little", "a\nb"), (1, "more", "a\nb\nc"), (2, "m", "t "), (3, "n", None))
    after = m((1, "same", "x  \ny"), (1, "new", "1"), (1, "little", "a\nc"), (1, "more", "z"), (2, "m", "t"), (3, "n", None), (4, "o", ""))
    got = {(r.p, r.module): r for r in diffs.package_changes(before, after, ["p"]).collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, "same"): "unchanged", (1, "gone"): "removed", (1, "new"): "added", (1, "little"): "changed", (1, "more"): "changed", (2, "m"): "unchanged", (3, "n"): "unchanged", (4, "o"): "added",
    }
    one = got[1, "more"]
    assert (one.added_lines, one.removed_lines, one.place, one.sample) == (1, 3, 1, "- a\n- b\n- c\n+ z") and got[1, "little"].place == 2
    assert {(r.from_modules, r.to_modules, r.unchanged, r.identical) for k, r in got.items() if k[0] == 1} == {(4, 4, 1, False)}
    assert got[2, "m"].identical and got[3, "n"].identical and not got[4, "o"].identical and got[1, "new"].sample is None and got[1, "new"].place is None


def test_only_changed_modules_reach_python(spark):
    m = lambda *x: spark.createDataFrame(x, "p long, module string, text string")
    out = diffs.package_changes(m((1, "a", "x")), m((1, "a", "y")), ["p"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_no_switch_by_length(spark, monkeypatch):
    """Beyond 4000 lines of a text the counts are those of the order of lines still, not of bags of lines."""
    n = 2500
    rows = [(1, "a\nb\n" * n + "z", "b\na\n" * n + "z"), (2, "\n".join(f"l{i}" for i in range(4100)), "\n".join(f"l{i}" for i in reversed(range(4100))))]
    pairs = spark.createDataFrame(rows, "key long, a string, b string")
    for arrow in (True, False):
        got = {r.key: r for r in diffs.ordered_diff(pairs, 3, arrow).collect()}
        assert (got[1].added, got[1].removed, got[1].excerpt, got[1].truncated) == (1, 1, "- a\n  b\n  a", True)
        assert (got[2].added, got[2].removed, got[2].excerpt) == (4099, 4099, "- l0\n- l1\n- l2")
    monkeypatch.setattr(diffs, "BITS", 40)  # few lines' bits are held
    rng = random.Random(9)
    for excerpt in (0, 1, 7, 500):
        for _ in range(60):
            a, b = (rng.choices("abcdefghijkl", k=rng.randint(0, 90)) for _ in range(2))
            want = by_table(a, b)
            shown = "\n".join(f"{m} {x}" for m, x in want[:excerpt])
            assert diffs.exact_diff(a, b, excerpt) == (sum(m == "+" for m, _ in want), sum(m == "-" for m, _ in want), shown, len(want) > excerpt)
