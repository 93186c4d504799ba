import random
import tracemalloc

import pytest

from panelloom.llm import pages
from panelloom.llm.pages import ARTICLE, MARKED, PLAIN, common_lines, lines_of

SCHEMA = "page_id long, url string, html string, text string, rank int"


def slow_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(common_lines(a, b))
        assert len(set(found)) == len(found) == slow_common(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_common_lines_in_halves(monkeypatch):
    monkeypatch.setattr(pages, "TABLE_BITS", 8)
    monkeypatch.setattr(pages, "FREQUENT", 2)
    test_common_lines()


def test_common_lines_of_long_pages():
    n = 100_000
    a = list(range(n))
    b = [x for i in range(0, n, 2) for x in (a[i + 1], a[i])]  # each pair of lines swapped
    tracemalloc.start()
    found = common_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found)) == len(found) == n // 2
    assert {i // 2 for i in found} == set(range(n // 2))
    assert peak < 100 << 20
    assert len(common_lines([1] * n, [2] + [1] * (n // 2))) == n // 2


@pytest.mark.parametrize(
    "html, lines",
    [
        (None, []),
        ("", []),
        ("<", [("<", PLAIN)]),
        ("no markup", [("no markup", PLAIN)]),
        ("<p>a<b>b<br>c<p>d</b>e", [("ab c", PLAIN), ("de", PLAIN)]),
        ("<p>&lt;i&gt; &amp;amp; &eacute;&#8364;&nbsp; x</p>", [("<i> &amp; é€ x", PLAIN)]),
        ('<script>var t="</p>";</script><style>p{}</style><p>x', [("x", PLAIN)]),
        ("<script>never closed <p>x", []),
        ("<!-- <p>no</p> --><p>yes", [("yes", PLAIN)]),
        ('<a title="a > b">t</a>', [("t", PLAIN)]),
        ('<div class="ad top">x</div><p>y', [("x", MARKED), ("y", PLAIN)]),
        ('<div class="address">x</div>', [("x", PLAIN)]),
        ("<nav><ul><li>m<li>n</ul></nav><p>y", [("m", MARKED), ("n", MARKED), ("y", PLAIN)]),
        ('<div role="search">s</div><form>f</form><aside>g</aside>z', [("s", MARKED), ("f", MARKED), ("g", MARKED), ("z", PLAIN)]),
        ("<header>h</header><article><header><h1>t</h1></header><p>b</article><footer>f",
         [("h", MARKED), ("t", ARTICLE), ("b", ARTICLE), ("f", MARKED)]),
        ('<main>m<article>a<section id="comments"><p>c</section></article></main>',
         [("m", PLAIN), ("a", ARTICLE), ("c", MARKED)]),
        ('<p>a <span class="adBanner">b</span> c</p><cookie-bar>d</cookie-bar>', [("b", MARKED), ("a c", PLAIN), ("d", MARKED)]),
        ('<div>a <a class="share"><div>b</div></a> c', [("a", PLAIN), ("b", MARKED), ("c", PLAIN)]),
        ('<div id="sideBar">x<p>y</div><p>z', [("x", MARKED), ("y", MARKED), ("z", PLAIN)]),
        ("<main><p>m</main>x", [("m", ARTICLE), ("x", PLAIN)]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", [("1 2", PLAIN), ("3", PLAIN)]),
    ],
)
def test_lines(html, lines):
    assert lines_of(html) == lines


def test_shared_lines_go(spark):
    frame = "<div>Welcome to the site of all sites</div><p>{}</p><p>{}</p><div>Written with care</div>"
    rows = []
    for i in range(40):
        rows.append((i, f"http://h.example/{'ab'[i % 2]}/{i:02}", frame.format(f"first text {i} " * 5, f"second text {i} " * 5)))
    rows += [
        (100, "https://other.example/x", frame.format("alone here", "quite alone")),  # no neighbour on its host
        (101, "https://copy.example/x?page=1", frame.format("one", "two " * 60)),
        (102, "https://copy.example/x?page=2", frame.format("one", "two " * 60)),  # a copy is no evidence
        (103, "http://art.example/1", "<nav>menu</nav><article><p>quoted by both</p><p>own one</p></article>"),
        (104, "http://art.example/2", "<nav>menu</nav><article><p>quoted by both</p><p>own two</p></article>"),
        (105, None, "<p>no url</p>"),
        (None, None, None),
        (106, "http://long.example/", "<p>" + "word " * 200_000),
    ]
    rows.append(rows[0])
    table = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    found = pages.extract(table).collect()
    assert len(found) == len(rows)
    text = {r.page_id: r.text for r in found}
    for i in range(40):
        assert text[i] == "\n".join([" ".join([f"first text {i}"] * 5), " ".join([f"second text {i}"] * 5)])
    whole = "Welcome to the site of all sites\n{}\n{}\nWritten with care"
    assert text[100] == whole.format("alone here", "quite alone")
    assert text[101] == text[102] == whole.format("one", " ".join(["two"] * 60))
    assert text[103] == "quoted by both\nown one" and text[104] == "quoted by both\nown two"
    assert text[105] == "no url" and text[None] == ""
    assert all(r.n_chars == len(r.text) for r in found)
    assert pages.extract(table.where("false")).count() == 0


def test_articles_are_evidence_only(spark):
    body = "<div>{0} real body, with much to read on it</div>"
    card = "<article><p>Teaser {0}</p></article>"
    framed = "<p>Top of the site</p><article><p>Share this story</p><p>Story {0}, told at some length</p><p>Thanks for reading</p></article>"
    rows = [(i, f"http://card.example/{i}", f"<main>{body}{card}</main><p>Unmarked menu</p>".format(f"No {i}")) for i in range(4)]
    rows += [(10 + i, f"http://framed.example/{i}", framed.format(f"number {i}" * 5)) for i in range(4)]
    table = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    text = {r.page_id: r.text for r in pages.extract(table).collect()}
    for i in range(4):
        assert text[i] == f"No {i} real body, with much to read on it\nTeaser No {i}"
    for i in (1, 2):
        assert text[10 + i] == f"Story {f'number {i}' * 5}, told at some length"
    # With one neighbour, shared lines of an article may be quotations.
    assert text[10] == f"Share this story\nStory {'number 0' * 5}, told at some length\nThanks for reading"


def test_passages_of_few_pages_stay(spark):
    """Two lines that begin three articles in a row are no frame of a host of twelve."""
    rows = []
    for i in range(12):
        quoted = "<p>A passage</p><p>told by three</p>" if i in (4, 5, 6) else ""
        rows.append((i, f"http://h.example/{i:02}", f"<article>{quoted}<p>{f'Story {i}. ' * 9}</p><p>Thanks for reading</p></article>"))
    table = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    text = {r.page_id: r.text for r in pages.extract(table).collect()}
    for i in range(12):
        own = [" ".join([f"Story {i}."] * 9)]
        ends = ["Thanks for reading"] if i in (0, 11) else []  # with one neighbour it may be a quotation
        assert text[i] == "\n".join((["A passage", "told by three"] if i in (4, 5, 6) else []) + own + ends)


def test_copies_do_not_hide_the_frame(spark, monkeypatch):
    frame = "<div>Welcome to the site of all sites</div>{}<div>Written with care</div>"
    rows = []
    def add(url, *own):  # noqa: E306
        rows.append((len(rows), f"http://h.example/{url}", frame.format("".join(f"<p>{x}</p>" for x in own)), "\n".join(own)))
    add("a", "first page " * 9)
    for i in range(300):  # variants of one page, exact and near, and mirrors of it under other paths
        add(f"b?page={i}", "second page " * 30, *([f"variant {i}"] if i % 2 else []))
        add(f"b/{i}", "second page " * 30)
    add("c", "stub 1")  # the frame is most of a stub
    add("d", "third page " * 9)
    add("e", "stub 2")
    add("f", "stub 3")
    add("g", "fourth page " * 9)
    monkeypatch.setattr("panelloom.llm.pages.BUCKETS", 4)
    table = spark.createDataFrame([(*r[:3], None, 1) for r in rows], SCHEMA)
    text = {r.page_id: r.text for r in pages.extract(table).collect()}
    assert text == {r[0]: "\n".join(x.strip() for x in r[3].split("\n")) for r in rows}
