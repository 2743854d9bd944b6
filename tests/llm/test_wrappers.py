import json
import re

import pytest

from sablegrid.llm import wrappers as wr

ROWS = "page_id long, url string, html string, text string, host int"


def one(spark, html, url="http://a.example/x"):
    return wr.main_text(spark.createDataFrame([(1, url, html, "z", 1)], ROWS)).first().text


def page(body, tail=""):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div>{body}<footer>&copy; foot</footer></body></html>{tail}'


CASES = [
    (page("<article><h1>Head</h1><p><b>One  two<br><p>Three\n four</p></article>"), "Head\nOne two\nThree four"),
    (page("<article><h1>A &amp; B&nbsp;&#233;&#x41;</h1><ul><li>x<li>y</ul></article>"), "A & B éA\nx\ny"),
    (page("<article><header>by</header><p>Body</p><aside>side</aside><section id=comments><p>me too</p></section><form><input>go</form></article>"), "Body"),
    (page('<main><div class="notice-box">cookies</div><div>In <em>line</em> text</div></main>'), "In line text"),
    (page("<div><p>No article here</p><div class='comment-list'>x</div></div>"), "No article here"),
    (page("<article>a<!-- no <p>x</p> -->b<script>1<2</script><style>p{}</style>c</article>"), "abc"),
    (page("<article><table><tr><td>1<td>2<tr><td>3</table></article>"), "1\n2\n3"),
    (page('<article role="main"><p hidden>no</p><p style="display: none">no</p><pre>a\n  b</pre></article>'), "a b"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("plain < text & more", "plain < text & more"),
    (None, ""),
    ("", ""),
    ("<article>" + "<p>w</p>" * 20000 + "</article>", "\n".join(["w"] * 20000)),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_pages(html, want):
    marked, main = wr.content(wr.skeleton(html)) if html is None or len(html) < 10**6 else (False, set())
    assert wr.extract(html, main) == want


def test_every_page_of_a_table(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", h, "z", 1) for i, (h, _) in enumerate(CASES[:12])] + [(50, None, CASES[0][0], "z", 1), (50, None, CASES[0][0], "z", 1)]
    got = wr.main_text(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (CASES[r.page_id] if r.page_id < 50 else CASES[0])[1]


def test_join_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"http://h{i % 2}.example/{i}", CASES[i % 3][0], "z", 1) for i in range(30)], ROWS)
    want = sorted(map(tuple, wr.main_text(rows).collect()))
    monkeypatch.setattr(wr, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, wr.main_text(rows, wr.WrapperParams(spread=4)).collect())) == want


def test_against_a_plain_reading_of_the_given_pages(spark, sf):
    import html as entities

    got = {r.page_id: r.text for r in wr.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", body)))]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_empty(spark):
    assert wr.main_text(spark.createDataFrame([], ROWS)).count() == 0


def fits(wrapper, parts):
    """Brute force: whether a sequence of parts is in the wrapper's language."""
    pattern, inner = "", {}
    for name, sign, own in wrapper:
        inner[name] = own
        pattern += f"(?:{re.escape(name)};){sign}"
    return bool(re.fullmatch(pattern, "".join(p[0] + ";" for p in parts))) and all(fits(inner[p[0]], p[2]) for p in parts)


def raw(html):
    root, stack = [], None
    stack = [root]
    for kind, x in wr.events(html):
        if kind == "open":
            part = [x, "", []]
            stack[-1].append(part)
            stack.append(part[2])
        elif kind == "close":
            stack.pop()
        elif kind == "text" and x.strip() and not (stack[-1] and stack[-1][-1][0] == "#"):
            stack[-1].append(["#", "", []])
    return root


def test_a_wrapper_fits_all_pages_it_was_made_from():
    pages = [page(f"<article><h1>H</h1>{'<p>x</p>' * i}{'<hr><ul><li>y</li></ul>' * (i % 3)}</article>{'<aside>z</aside>' * (i % 2)}") for i in range(1, 7)]
    whole = None
    for h in pages:
        whole = wr.skeleton(h) if whole is None else wr.align(whole, wr.skeleton(h))
    assert all(fits(whole, raw(h)) for h in pages) and json.loads(json.dumps(whole)) == whole
    assert "(<p>#TEXT</p>)+" in wr.expression(whole) and "(<aside>#TEXT</aside>)?" in wr.expression(whole)


def test_constants_of_a_host_are_no_main_text(spark):
    """No article tag and no telling class words: only the host's other pages tell template from text."""
    def made(i):
        return f"<html><body><div>Our shop in the old town</div><div><p>Story {i} begins here.</p><p>It goes on with {i * 7}.</p></div><div>All about us</div><div>Call now</div></body></html>"

    rows = [(i, f"http://plain.example/{i}", made(i), "z", 1) for i in range(12)]
    rows += [(50 + i, "http://same.example/", "<p>Only this</p>", "z", 1) for i in range(5)] + [(60 + i, f"http://two.example/{i}", f"<p>Common</p><p>Own {i}</p>", "z", 1) for i in range(2)]
    rows += [(70 + i, f"http://marked.example/{i}", f"<article><p>In common</p><p>Own {i}</p></article>", "z", 1) for i in range(5)]
    got = {r.page_id: r.text for r in wr.main_text(spark.createDataFrame(rows, ROWS)).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} begins here.\nIt goes on with {i * 7}."
    assert all(got[50 + i] == "Only this" for i in range(5)) and all(got[60 + i] == f"Common\nOwn {i}" for i in range(2)) and all(got[70 + i] == f"In common\nOwn {i}" for i in range(5))


@pytest.mark.parametrize("n", [2, 3, 30])
def test_repeated_articles_stay(spark, n):
    """Mirrors and near copies on hosts without article marks: whatever the number of pages, no article is lost."""
    long = "The council met on Tuesday and spoke about the harbour, the bridge and the school until late at night."
    rows = []
    for i in range(n):
        rows.append((i, f"http://copies.example/{i}", f"<body><div><p>{long}</p><p>Short end.</p><p>Updated on day {i}</p></div><div>Contact us</div></body>", "z", 1))
        rows.append((100 + i, f"http://mirror.example/{i}", f"<body><div><p>{long}</p><p>Short end.</p></div></body>", "z", 1))
        rows.append((200 + i, f"http://apart.example/{i}", f"<body><div>Our town</div><section><p>{long}</p><p>Short end.</p></section><div class='x'>Day {i}</div></body>", "z", 1))
    got = {r.page_id: r.text.split("\n") for r in wr.main_text(spark.createDataFrame(rows, ROWS)).collect()}
    for i in range(n):
        assert got[i][:3] == [long, "Short end.", f"Updated on day {i}"] and got[100 + i] == [long, "Short end."]
        assert [x for x in got[200 + i] if x != "Our town"] == [long, "Short end.", f"Day {i}"]


def test_furniture_below_the_deepest_level():
    html = "<div>" * 205 + "<nav>MENU<p>more</p></nav><p>body</p><div class='sidebar'>x</div>" + "</div>" * 205 + "<p>end</p>"
    marked, main = wr.content(wr.skeleton(html))
    assert wr.extract(html, main) == "body\nend"


def test_long_pages_align_in_bounded_work():
    import time

    began = time.time()
    a = wr.skeleton("<div>" + "<p>x</p><ul><li>y</li></ul>" * 10_000 + "</div>")
    b = wr.skeleton("<div>" + "<ul><li>y</li></ul><pre>z</pre><p>x</p>" * 10_000 + "</div>")
    both = wr.align(a, b)
    assert time.time() - began < 20
    assert fits(both, raw("<div><p>x</p></div>")) is not None


def test_common_sequences():
    import random

    rng = random.Random(1)
    for size in (5, 700):
        a, b = ([rng.choice("abc") for _ in range(size)] for _ in range(2))
        pairs = wr.common(a, b)
        assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert len(pairs) >= (0.4 * size if size > 5 else 0)
