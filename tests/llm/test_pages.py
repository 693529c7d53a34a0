import random

import pytest

from lumenspan.llm import html_lines, pages
from lumenspan.llm.html_lines import common_lines


def table_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 40])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_lines, "KEPT_BITS", bits)
    for seed in range(300):
        rng = random.Random(seed)
        a, b = ([rng.randrange(rng.choice([2, 6, 30])) for _ in range(rng.randrange(40))] for _ in range(2))
        places = common_lines(a, b)
        assert places == sorted(set(places)) and len(places) == table_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def kept(html):
    return [line.text for _, line, _ in pages.kept_lines(html)[1]]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a&amp;b &eacute;&#x2014;&#8212; x&nbsp; y</p>", ["a&b é—— x y"]),
        ("<p>one<br>two <b>bo</b>ld <i>it", ["one", "two bold it"]),
        ("<p><b>open<br><p>next</p>", ["open", "next"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>t</p><!-- <p>no</p> --><noscript>n</noscript>", ["t"]),
        ("<nav><ul><li>Home<li>News</ul></nav><header>Site</header><p>body</p><footer>&copy; x", ["body"]),
        ("<div class='ad box'>buy</div><div id=comments><article><p>me too</p></article></div><p>body", ["body"]),
        ("<div class=ad>never closed<article><h1>T</h1><p>body</p></article>", ["T", "body"]),
        ("<form action=x><article><p>body</p><input><button>Send</button></article></form>", ["body"]),
        ("<article class='post comments-open'><header><h1>T</h1><p>by me</p></header><p>body</p><aside>more</aside></article><p>out</p>", ["T", "body"]),
        ("<main><div class=breadcrumb>a &gt; b</div><p>body</p><div class=siteNav>x</div></main>", ["body"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ('<a title="a > b">link</a> 1 < 2 & 3', ["link 1 < 2 & 3"]),
        ("<p>cut<a href='x", ["cut"]),
        ("", []), (None, []), ("no markup at all", ["no markup at all"]), ("<div hidden>h</div><p style='display: none'>n</p>y", ["y"]),
    ],
)
def test_lines_by_markup(html, text):
    assert kept(html) == text


def site(host, n, seed, repeat=()):
    """Pages without telling markup: a frame, own paragraphs, and copies of some."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(rng.randrange(3, 8))]
        frame = ["Home", "All topics", f"Top story of {host}"], ["About us", f"Contact {host}"]
        html = "".join(f"<div>{x}</div>" for x in [*frame[0], *body, *frame[1]])
        out.append((host, i, html, " ".join(body)))
        if i in repeat:
            out.append((host, f"{i}?copy=1", html, None))
    return out


def test_frames_of_a_host_go_and_texts_stay(spark):
    rows = site("a.example", 60, 1) + site("b.example", 25, 2) + [("alone.example", 1, "<div>Home</div><div>only page</div>", "Home only page")]
    docs = [(k, f"https://{host}/t/{i}", html, text) for k, (host, i, html, text) in enumerate(rows)]
    df = spark.createDataFrame(docs, "page_id long, url string, html string, want string").repartition(13)
    got = pages.main_text(df).select("page_id", "want", "main.*").collect()
    assert len(got) == len(docs) and all(r.text == r.want for r in got)
    assert sorted(r.n_shared for r in got) == [0] + [5] * 85


def test_neighbours_are_those_of_the_whole_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaaab"), f"/{rng.randrange(99)}/{rng.randrange(9)}", "", i, [i], [1], [0]) for i in range(400)]
    schema = "host string, path string, query string, key long, lines array<long>, sizes array<int>, loose array<int>"
    df = spark.createDataFrame(rows, schema).repartition(7)
    order = sorted(rows)
    want = {}
    for i, row in enumerate(order):
        near = [order[j] if 0 <= j < len(order) and order[j][0] == row[0] else None for j in (i - 1, i + 1)]
        want[row[3]] = [x and x[3] for x in near]
    got = pages.neighbours(df).collect()
    assert {r.key: [x and x["lines"][0] for x in (r.before, r.after)] for r in got} == want


def test_link_lines_of_articles_go_if_shared(spark):
    html = "<article><p>own text {i}</p><p><a href=x>More like this</a></p><p>Shared words</p></article>"
    df = spark.createDataFrame([(f"http://h.example/{i}", html.format(i="x" * (50 + i))) for i in range(3)], "url string, html string")
    assert {r.main.text.split(" ", 3)[3] for r in pages.main_text(df).collect()} == {"Shared words"}


def test_copies_say_nothing_about_frames(spark):
    rows = site("c.example", 6, 3, repeat=(2,))
    df = spark.createDataFrame([(f"//c.example/{i}", html) for _, i, html, _ in rows], "url string, html string")
    texts = {r.url: r.main.text for r in pages.main_text(df).collect()}
    bodies = {f"//c.example/{i}": text for _, i, _, text in rows}
    bodies["//c.example/2?copy=1"] = bodies["//c.example/2"]
    assert texts == bodies


def test_awkward_pages(spark):
    long_page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(20_000)) + "</article>"
    rows = [
        (1, None, "<p>no address"), (2, "not an address", "<p>x"), (3, "http://h.example/", None), (4, "http://h.example/", ""),
        (5, "http://h.example/a", long_page), (6, "http://h.example/b", long_page), (7, "http://h.example/c", "<p>c"), (7, "http://h.example/c", "<p>c"),
    ]
    schema = "page_id long, url string, html string, main string, page_key string, `a.b` string, key string, shared string, range string"
    df = spark.createDataFrame([(*r, *["mine"] * 6) for r in rows], schema)
    out = pages.main_text(df)
    assert out.columns == [*df.columns, "_main"]
    got = [(r.page_id, r._main.text, r.main, r.key) for r in out.collect()]
    text = " ".join(f"line {i}" for i in range(20_000))
    want = [(1, "no address"), (2, "x"), (3, ""), (4, ""), (5, text), (6, text), (7, "c"), (7, "c")]
    assert sorted(got) == [(*w, "mine", "mine") for w in want]
    assert pages.main_text(df.limit(0)).count() == 0
