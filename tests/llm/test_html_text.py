import random
import re
import time

import pytest

from segue.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">home</a></li><li><a>b</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this</div><div id="cookie-banner">We use cookies</div><article><h1>Head &amp; line</h1><p>One&nbsp; <b>two</b>
three<p>Four &lt;five&gt;<br>six</p><aside>Related</aside><form><p>Mail</p></form><ul><li>item</li></ul><section class="comments"><p>Nice!</p></section></article><footer>(c)</footer></body></html>"""
TEXT = "Head & line\nOne two three\nFour <five> six\nitem"


def test_text_of_one_page():
    assert H.extract(PAGE) == TEXT
    assert H.extract(None) == H.extract("") == H.extract("<p></p>") == ""
    assert H.extract("plain &eacute; text") == "plain é text"
    assert H.extract("<div><p>a < b</p><script>never") == "a < b"
    assert H.extract('<p title="a > b" class=x>one</p><p x="unclosed>two</p>three') == "one\ntwo\nthree"
    assert H.extract("one <a two") == "one <a two" and H.extract("a </ b> c <1> <!x> d <") == "a c <1> d <"


def items(*keys):
    return [[k, 0, 0, None] for k in keys]


def test_repeats_fold():
    pat = lambda xs: " ".join(("(" + pat(x[3]) + ")" if x[0][0] == "(" else x[0]) + ("+" if x[2] else "") for x in xs)
    assert pat(H.fold(items(*"aabccc"))) == "a+ b c+"
    assert pat(H.fold(items(*"xabababy"))) == "x (a b)+ y"
    assert pat(H.fold(items(*"abbabcabbabc"))) == "((a b+)+ c)+"
    long = [f"k{i}" for i in range(40)]
    assert pat(H.fold(items(*long * 5))) == f"({' '.join(long)})+"


def pattern(content):
    """A wrapper's content as a regular expression over labels and brackets."""
    out = ""
    for key, optional, repeated, inner in content:
        one = pattern(inner) if key[0] == "(" else re.escape(f"<{key}>") if inner is None else re.escape(f"<{key}[") + pattern(inner) + re.escape("]>")
        out += f"(?:{one})" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated]
    return out


def written(content):
    return "".join(f"<{k}>" if isinstance(x, str) else f"<{k}[{written(x)}]>" for k, x in content)


def random_page(r):
    def inside(deep):
        out = ""
        for _ in range(r.randint(0, 5)):
            k = r.choice(["p", "p", "h2", "div", "ul", "bare"])
            if k == "bare":
                out += f"t{r.randint(0, 9)} "
            elif k in ("p", "h2"):
                out += f"<{k}>x{r.randint(0, 99)}</{k}>"
            elif deep:
                out += f"<{k} class='{r.choice('ab')}'>{inside(deep - 1)}</{k}>"
        return out

    return "<body>" + inside(2) + "</body>"


@pytest.mark.parametrize("width", [H.WIDTH, 2])
def test_wrappers_accept_their_pages(monkeypatch, width):
    """Against a brute-force regular-expression engine: the language of a wrapper has each page it was made of, and matching puts all text into slots."""
    monkeypatch.setattr(H, "WIDTH", width)
    r = random.Random(4)
    for _ in range(60):
        pages = [random_page(r) for _ in range(r.randint(2, 7))]
        w = H.infer(pages)
        c = H.Content(w)
        for p in pages:
            content = H.read(p)
            got = c.match(content)
            assert got is not None
            flat = lambda xs: [t for _, x in xs for t in ([x] if isinstance(x, str) else flat(x))]
            assert [t for _, t in got] == flat(content)
            if width == 48:
                assert re.fullmatch(pattern(w), written(content)), (pages, w)


def test_mismatches_become_optional_and_repeated():
    page = lambda *labels: H.shape([[k, "x"] for k in labels])
    assert H.merge(page("#h1", "#p"), page("#h1", "#h2", "#p", "#p")) == [["#h1", 0, 0, None], ["#h2", 1, 0, None], ["#p", 0, 1, None]]
    group = H.merge(page("#dt", "#dd", "#dt", "#dd"), page("#dt", "#dd"))
    assert [(x[0], x[1], x[2]) for x in group] == [("(#dt #dd)", 0, 1)]


def test_alignment_is_longest_of_occurrences():
    assert H.align(items(*"abcde"), items(*"axcye")) == [(0, 0), (2, 2), (4, 4)]
    r = random.Random(1)
    for _ in range(200):
        a, b = (items(*r.choices("abcd", k=r.randint(0, 7))) for _ in range(2))
        got = H.align(a, b)
        number = lambda xs: [(x[0], sum(y[0] == x[0] for y in xs[:i])) for i, x in enumerate(xs)]
        na, nb = number(a), number(b)
        best = [[0] * (len(nb) + 1) for _ in range(len(na) + 1)]
        for i in range(len(na)):
            for j in range(len(nb)):
                best[i + 1][j + 1] = best[i][j] + 1 if na[i] == nb[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and all(na[i] == nb[j] for i, j in got) and got == sorted(set(got))


def texts(spark, pages, url="http://h.org/{}"):
    rows = [(i, url.format(i), p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_operator_and_edges(spark):
    rows = [(1, "http://a.org/1", PAGE, "x"), (2, "http://a.org/2", PAGE, "x"), (2, "http://a.org/2", PAGE, "x"), (3, None, None, "x"), (None, "nohost", "", None), (5, "http://b.org", "<p>" + "long text " * 200_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for bound in (1 << 20, 0):
        got = sorted(((str(r.page_id), r.text, r.n_chars) for r in H.main_text(pages, broadcast_bytes=bound).collect()))
        want = sorted([("1", TEXT, len(TEXT)), ("2", TEXT, len(TEXT)), ("2", TEXT, len(TEXT)), ("3", "", 0), ("None", "", 0), ("5", ("long text " * 200_000).strip(), 1_999_999)])
        assert got == want
    assert H.main_text(pages.limit(0)).count() == 0


def test_alignment_decides_which_text_is_template(spark):
    """The notice and the story are both paragraphs of one element: only their places, before and after an optional heading, tell them apart."""
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(20))
    page = lambda i: f"<body><div class='c'><p>Printed on paper</p>{'<h2>Part ' + str(i) + '</h2>' if i % 2 else ''}<ul><li>point {i}</li></ul><p>{body(i)}</p><p>{body(i + 50)}</p></div></body>"
    want = {i: (f"Part {i}\n" if i % 2 else "") + f"point {i}\n{body(i)}\n{body(i + 50)}" for i in range(6)}
    assert texts(spark, [page(i) for i in range(6)]) == want


def test_all_varying_text_stays(spark):
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    page = lambda i: f"<body><div class='top'>Site name</div><h1>Title {i}</h1><div class='intro'>intro {i}</div><div class='content'><p>{body(i)}</p></div></body>"
    assert texts(spark, [page(i) for i in range(5)]) == {i: f"Title {i}\nintro {i}\n{body(i)}" for i in range(5)}
    post = lambda i: f"<body><div class='top'>Site name</div><div class='byline'>by author {i}</div><div id='post-{100 + i}'><p>{body(i)}</p><div class='end'>Thanks all</div></div></body>"
    assert texts(spark, [post(i) for i in range(5)]) == {i: f"by author {i}\n{body(i)}" for i in range(5)}
    named = lambda i: f"<body><div class='top'>Site name</div><div class='byline'>by author {i}</div><div id='{'abcde'[i]}'>{body(i)}</div></body>"
    assert texts(spark, [named(i) for i in range(5)] + [named(0)] * 3).items() >= {i: f"by author {i}\n{body(i)}" for i in range(5)}.items()


def test_shapes_and_names_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 16)
    tags = lambda i: "".join("<h2>a{0}</h2>" if i >> b & 1 else "<p>b{0}</p><ul><li>c{0}</li></ul>" for b in range(10)).replace("{0}", str(i))
    page = lambda i: f"<body><div class='top'>Site</div>{tags(i)}<div class='n{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>own {i}</div></body>"
    got = texts(spark, [page(i) for i in range(1000)])
    line = lambda i: "\n".join(f"a{i}" if i >> b & 1 else f"b{i}\nc{i}" for b in range(10))
    assert got == {i: f"{line(i)}\nown {i}" for i in range(1000)}


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    for bit in ("<script ", "<a ", "<a x=\"", "<a x=' > \" ", "<div>", "</div>", "<div></nav>", "<!--", "</", "<p>a<div>b", "<ul><li>x</li></ul><p>y</p>", "<![", "class=\"", "<a class='x"):
        page = bit * ((1 << 20) // len(bit))
        H.extract(page)
    r = random.Random(2)
    H.extract("".join(f"<{r.choice(['p', 'h2', 'div', 'ul'])} class=c{chr(97 + r.randrange(26))}>t" for _ in range(50_000)))
    assert time.time() - began < 120
    assert H.extract("<script " * 100_000).startswith("<script <script")
    assert H.extract("<div>" * 50_000 + "deep" + "<nav>no</nav>" + "</div>" * 50_000) == "deep"
