"""Main text of web pages by wrappers: union-free regular expressions over the tags of each host's pages."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

#: Wrappers (characters of JSON) that may be broadcast; beyond it they are joined to the pages by shuffle.
BROADCAST_CHARS = 8_000_000
#: Hosts that may be broadcast.
BROADCAST_HOSTS = 200_000

#: Element names of the HTML standard and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("head nav header footer aside form script style noscript template iframe object embed svg math canvas audio video button select textarea input menu dialog title xmp noembed noframes datalist fieldset search map".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager paginate pagination popup promo promoted promotion related recommended respond share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Start tags that end an open element of the listed names in the same block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("html body table ul ol dl select div article section main aside nav header footer form blockquote td th".split())

#: Elements nested deeper are read as part of the one around them, as browsers do at some depth; furniture among them
#: is still left out.
DEEPEST = 200
#: Products of the lengths of two part lists up to which their longest common sequence is worked out.
TABLE = 250_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"\s+")


def label(name: str, attributes: str) -> str:
    """Token of a start tag: the name, with class, id and role words that tell furniture or content."""
    if not attributes or not attributes.strip(" /\t\r\n"):
        return name
    found = {}
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), a or b or c)
    words = set()
    for key in ("class", "id"):
        for w in re.split(r"[\s_-]+", found.get(key, "").lower()):
            w = w.rstrip("0123456789")
            if w in FURNITURE:
                words.add(w)
    role = found.get("role", "").lower().strip()
    if role in ROLES or role in ("main", "article"):
        words.add("role=" + role)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        words.add("hidden")
    if found.get("itemprop", "").lower() == "articlebody":
        words.add("role=article")
    return ".".join([name, *sorted(words)])


def furniture(label: str) -> bool:
    """Whether a part with this label holds no main text."""
    words = label.split(".")
    return words[0] in HIDDEN or any(w in FURNITURE or w == "hidden" or (w.startswith("role=") and w[5:] in ROLES) for w in words[1:])


def events(html: str | None) -> Iterator[tuple[str, str]]:
    """("open", label), ("close", name) and ("text", characters) of a page, with implied end tags put in."""
    pos, text, stack, muted = 0, html or "", [], []  # muted: places of open furniture below DEEPEST
    held: Counter = Counter()  # open elements by name

    def shut() -> tuple[str, str]:
        name = stack.pop()
        held[name] -= 1
        if muted and muted[-1] == len(stack):
            muted.pop()
        return ("close", name) if len(stack) < DEEPEST else ("block" if name in BLOCKS else "text", "")

    while pos < len(text):
        m = TOKEN.match(text, pos)
        pos, raw, name = m.end(), m[0], (m[2] or "").lower()
        if not name:
            if not raw.startswith(("<!", "<?")) or raw.startswith("<![CDATA["):
                if not muted:
                    yield "text", raw[9:].removesuffix("]]>") if raw.startswith("<![CDATA[") else entities.unescape(raw)
            continue
        if m[1]:
            if held[name]:
                while stack[-1] != name:
                    yield shut()
                yield shut()
            elif name == "br":
                yield "text", " "
            continue
        if name in VOID:
            yield "text", " " if name in ("br", "wbr", "hr") else ""
            if name == "hr":
                yield "block", ""
            continue
        ends = ENDS.get(name, ())
        if name in BLOCKS and held["p"]:
            ends = (*ends, "p")
        for end in ends:
            if held[end]:
                at = len(stack) - 1 - stack[::-1].index(end)
                if end == "p" or not SCOPE & set(stack[at + 1 :]) - {end}:
                    if end == "p" and {"table", "article", "section", "div"} & set(stack[at + 1 :]):
                        continue
                    while len(stack) > at:
                        yield shut()
        stack.append(name)
        held[name] += 1
        if len(stack) <= DEEPEST:
            yield "open", label(name, m[3])
        elif furniture(label(name, m[3])):
            muted.append(len(stack) - 1)
        elif name in BLOCKS:
            yield "block", ""
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, pos)
            inside = text[pos : close.start() if close else len(text)]
            if name in ("title", "textarea"):
                inside = entities.unescape(inside)
            if len(stack) <= DEEPEST:
                yield "text", inside
            pos = close.end() if close else len(text)
            yield shut()
    while stack:
        yield shut()


# A wrapper is a list of parts [label, sign, wrapper]: label "#" is a text slot, sign one of "" (once), "?" (optional),
# "+" (repeated) and "*" (both). Neighbouring parts never have the same label: they are one repeated part.


def _sign(optional: bool, repeated: bool) -> str:
    return ("*" if optional else "+") if repeated else "?" if optional else ""


def skeleton(html: str | None) -> list:
    """The page as a wrapper that fits it alone, with runs of like neighbours folded into repeated groups."""
    root: list = []
    stack = [root]
    for kind, x in events(html):
        if kind == "open":
            part = [x, "", []]
            stack[-1].append(part)
            stack.append(part[2])
        elif kind == "close":
            stack.pop()
        elif kind == "text" and x and not x.isspace() and not (stack[-1] and stack[-1][-1][0] == "#"):
            stack[-1].append(["#", "", []])
    return fold(root)


def fold(parts: list) -> list:
    out: list = []
    for name, sign, inner in parts:
        inner = fold(inner)
        if out and out[-1][0] == name:
            last = out[-1]
            last[1] = "" if name == "#" else _sign(last[1] in ("?", "*") and sign in ("?", "*"), True)
            last[2] = align(last[2], inner)
        else:
            out.append([name, sign, inner])
    return out


def align(a: list, b: list) -> list:
    """One wrapper for all that a or b fits: parts that match in order are merged, the others become optional."""
    if a == b:
        return a
    out, i, j = [], 0, 0
    for p, q in [*common([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[name, _sign(True, sign in ("+", "*")), inner] for name, sign, inner in a[i:p] + b[j:q]]
        if p < len(a):
            (name, x, own), (_, y, other) = a[p], b[q]
            out.append([name, _sign("?" in x + y or "*" in x + y, "+" in x + y or "*" in x + y), align(own, other)])
        i, j = p + 1, q + 1
    return fold(out)


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a common sequence: equal ends first; between them a longest one, or, where that were too much work,
    what a walk finds that goes on at the nearer of each label's next places. Either way the wrapper fits both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out, n, m, i, j = [(k, k) for k in range(head)], len(a) - tail, len(b) - tail, head, head
    if (n - head) * (m - head) <= TABLE:
        best = [[0] * (m + 1 - head) for _ in range(n + 1 - head)]
        for x in range(n - head - 1, -1, -1):
            for y in range(m - head - 1, -1, -1):
                best[x][y] = best[x + 1][y + 1] + 1 if a[x + head] == b[y + head] else max(best[x + 1][y], best[x][y + 1])
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1 - head][j - head] >= best[i - head][j + 1 - head]:
                i += 1
            else:
                j += 1
    else:
        places: tuple[dict, dict] = ({}, {})
        for where, labels, stop in ((places[0], a, n), (places[1], b, m)):
            for k in range(stop - 1, head - 1, -1):
                where.setdefault(labels[k], []).append(k)

        def after(where: dict, label: str, k: int) -> int:
            left = where.get(label, [])
            while left and left[-1] < k:
                left.pop()
            return left[-1] if left else len(a) + len(b)

        while i < n and j < m:
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
                continue
            in_b, in_a = after(places[1], a[i], j) - j, after(places[0], b[j], i) - i
            if min(in_a, in_b) > len(a) + len(b) - max(i, j) - 1:  # neither label comes again
                i, j = i + 1, j + 1
            elif in_b <= in_a:
                j += in_b
            else:
                i += in_a
    return out + [(n + k, m + k) for k in range(tail)]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression over tags, for people to read."""
    out = []
    for name, sign, inner in wrapper:
        body = "#TEXT" if name == "#" else f"<{name}>{expression(inner)}</{name.split('.')[0]}>"
        out.append(f"({body}){sign}" if sign else body)
    return "".join(out)


def content(wrapper: list) -> tuple[bool, set[str]]:
    """Whether the host marks its articles, and the paths of the wrapper's parts whose text is main text."""
    paths: dict[str, bool] = {}
    marked = False

    def walk(parts: list, path: str, inside: bool) -> None:
        nonlocal marked
        for name, _, inner in parts:
            own = f"{path}/{name}"
            if name == "#":
                paths[path] = inside
                continue
            words = name.split(".")
            if furniture(name):
                continue
            article = words[0] in ("article", "main") or "role=main" in words or "role=article" in words
            marked = marked or article
            walk(inner, own, inside or article)

    walk(wrapper, "", False)
    return marked, {p for p, inside in paths.items() if inside or not marked}


def blocks(html: str | None, main: set[str] | None) -> list[tuple[str, str]]:
    """(path, line) of the page's blocks in order: text of the slots at the given paths, or at all."""
    out, block, path, at = [], [], [""], ""

    def end() -> None:
        line = SPACES.sub(" ", "".join(block)).strip()
        if line:
            out.append((at, line))
        block.clear()

    for kind, x in events(html):
        if kind == "text":
            if main is None or path[-1] in main:
                if not block:
                    at = path[-1]
                block.append(x)
            continue
        if kind == "block":
            end()
            continue
        if x.split(".")[0] in BLOCKS:
            end()
        if kind == "open":
            path.append(f"{path[-1]}/{x}")
        else:
            path.pop()
    end()
    return out


def constant(path: str, line: str) -> int:
    """Key of a block's text at its path."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{line}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(html: str | None, main: set[str], constants: set[int] = frozenset(), words: int = 0) -> str:
    """Text of the slots at the given paths: blocks in page order, one line each.

    Of constants, only furniture goes: blocks in an element of whose own blocks each is a constant of at most `words`
    words. A long text, or one beside which anything varies, may be an article's that other pages repeat, so it stays.
    """
    found = blocks(html, main)
    if constants:
        kept = {path.rpartition("/")[0] for path, line in found if line.count(" ") >= words or constant(path, line) not in constants}
        found = [(path, line) for path, line in found if path.rpartition("/")[0] in kept]
    return "\n".join(line for _, line in found)


@dataclass(frozen=True)
class WrapperParams:
    """spread: groups that the page shapes of one host are dealt to before the last step of alignment. pages, share: a
    text that so many different pages of a host and such a part of them have at one path is a constant of the wrapper.
    words: an element of constants that have so many words each at most is furniture."""

    spread: int = 64
    pages: int = 3
    share: float = 0.5
    words: int = 8


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, p: WrapperParams = WrapperParams()) -> DataFrame:
    """(host, wrapper): a wrapper (JSON) of each host that fits all its pages.

    Pages give their shape; equal shapes of a host are one before the shuffle. Shapes are aligned one after another
    in groups of a host's shapes, and the groups' wrappers once more, so no task has all shapes of a large host.
    """

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "shape": [json.dumps(skeleton(h), separators=(",", ":")) for h in b["html"]]}).drop_duplicates()

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        out = None
        for s in sorted(g["shape"].unique(), key=lambda s: (-len(s), s)):
            out = json.loads(s) if out is None else align(out, json.loads(s))
        return pd.DataFrame({"host": g["host"].iloc[:1], "shape": [json.dumps(out, separators=(",", ":"))]})

    seen = pages.select(host().alias("host"), "html").mapInPandas(shapes, "host string, shape string").distinct()
    part = F.pmod(F.xxhash64("shape"), F.lit(p.spread)).alias("part")
    once = seen.groupBy("host", part).applyInPandas(merge, "host string, shape string")
    return once.groupBy("host").applyInPandas(merge, "host string, shape string").withColumnRenamed("shape", "wrapper")


def constants(pages: DataFrame, rules: DataFrame, p: WrapperParams) -> DataFrame:
    """(host, constants): texts that the pages of a host have in common, for hosts that don't mark their articles.

    Only counts of (host, path and text) meet; a page that occurs several times is one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 200):
                rows = []
                for h, page in zip(b["host"].iloc[i : i + 200], b["html"].iloc[i : i + 200]):
                    own = constant("", page or "")
                    rows += [(h, k, own) for k in {0, *(constant(*x) for x in blocks(page, None))}]
                yield pd.DataFrame(rows, columns=["host", "key", "page"])

    unmarked = F.broadcast(rules.where("not marked").select("host")) if rules.count() <= BROADCAST_HOSTS else rules.where("not marked").select("host")
    rows = pages.select(host().alias("host"), "html").join(unmarked, "host", "left_semi")
    seen = rows.mapInPandas(run, "host string, key long, page long").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.where(F.col("n") >= p.pages), "constants")
    whole = seen.where("key = 0").select("host", F.col("n").alias("whole"))
    common = seen.where("key <> 0").join(whole, "host").where(F.col("n") >= F.lit(p.share) * F.col("whole"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("constants"))  # 1 / share of a page's texts at most


def main_text(pages: DataFrame, p: WrapperParams = WrapperParams()) -> DataFrame:
    """One row per row of pages: page_id, url, text.

    Main text are the text slots of the host's wrapper that lie in no menu, header, footer, sidebar, notice, advert,
    form, script, style, markup or reader comment, judged by the tags around the slot. If the host marks articles
    anywhere, only what lies in one counts (pages of such a host that lack an article are read without that
    condition). If it doesn't, texts that its pages have in common at one place are constants of the wrapper; elements
    that have nothing but short constants are furniture and left out, unless all the page's texts are such. Articles
    that pages repeat stay: their texts are long, or stand beside others.

    Null and empty pages give an empty text. Pages without a url, or with one that has no host, share a wrapper.
    Whole pages count, however long or deep. Rows that repeat an id are extracted one by one. An empty table gives an
    empty result; columns other than page_id, url and html are not looked at.
    """

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(marked=[content(json.loads(w))[0] for w in b["wrapper"]])

    rules = materialize(infer(pages, p).mapInPandas(marks, "host string, wrapper string, marked boolean"), "wrappers")
    rules = materialize(rules.join(constants(pages, rules, p), "host", "left"), "wrappers")
    size = rules.agg(F.sum(F.length("wrapper") + F.length("host") + 8 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0]

    small = (size or 0) <= BROADCAST_CHARS
    held = {r.host: (r.wrapper, r.constants) for r in rules.toLocalIterator()} if small else {}
    shipped = pages.sparkSession.sparkContext.broadcast(held)  # BROADCAST_CHARS at most; as a column, every page would carry its wrapper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shipped.value, {}
        for b in slices(batches, 256):
            hosts, texts = b.column("host").to_pylist(), []
            rest = zip(b.column("wrapper").to_pylist(), b.column("constants").to_pylist(), strict=True) if not small else (table.get(h, (None, None)) for h in hosts)
            for h, html, (w, same) in zip(hosts, b.column("html").to_pylist(), rest, strict=True):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = *(content(json.loads(w)) if w else (False, set())), frozenset(same or ())
                marked, main, same = known[h]
                text = extract(html, main, same, p.words) or (extract(html, main) if same else "")
                if marked and not text:
                    own_marked, own = content(skeleton(html))
                    text = "" if own_marked else extract(html, own)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    met = pages.select("page_id", "url", "html", host().alias("host"))
    if not small:  # a host may hold a third of the pages: its wrapper goes to several tasks
        salted = rules.select("host", "wrapper", "constants", F.explode(F.sequence(F.lit(0), F.lit(p.spread - 1))).alias("salt"))
        met = met.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(p.spread)).cast("int")).join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "host", "wrapper", "constants")
    return met.mapInArrow(run, "page_id long, url string, text string")
