import math
from collections import defaultdict

import pytest

from tessera.llm import html_extract as hx
from tessera.llm.common import Scratch


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a &amp; b &#233;&nbsp; c\n d</p><p></p>text", "a & b é c d\ntext"),
        ("<article><h1>T</h1><p><b>x<br>y<p>z</article><footer>f</footer>", "T\nx y\nz"),
        ("<body><nav>n</nav><div class='ad-box'>buy</div><main><div>one<div>two</div>three</div></main></body>", "one\ntwo\nthree"),
        ("<script>var a='</p><p>no</p>';</script><style>p{}</style><p>yes<!-- no --><!-- cut", "yes"),
        ("<p>a<p>b &am", "a\nb &am"),
        ("<p>a &amp", "a &"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><th>f</table>", "a\nb\nc\nd\ne\nf"),
        ("<article><div class='comments'><p>c</p></div><p>x</p><form>q</form></article><article class='comment'>r</article><p>out</p>", "x"),
        ("<p title=\"a>b\">x</p><p title=\"open>y</p>", "x\ny"),
        ("<P>UP</P></div></b><p hidden>no</p><a href=x>li<b>nk</b></a>", "UP\nlink"),
        ("1 < 2 <p", "1 < 2"),
        ("<header>h</header><article><header><h1>T</h1></header>x</article>", "T\nx"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_single_pages(page, text):
    assert hx.extract(page, "h", frozenset()) == text


def brute(pages, gamma=hx.GAMMA):
    """importance by key, from the definitions on whole trees"""
    styles, contents, children, seen = defaultdict(list), defaultdict(list), defaultdict(dict), defaultdict(int)
    for host, page in pages:
        for node, key, parent, level, siblings, kids, _ in hx.walk(hx.parse(page), host):
            seen[key] += 1
            styles[key].append(tuple(k.sign for k in kids))
            contents[key].append(set(hx._contents(node)))
            children[parent][key] = siblings

    def imp(key):
        m = seen[key]
        own = styles[key]
        p = [own.count(s) / m for s in set(own)]
        node = 1.0 if m == 1 else -sum(x * math.log(x, m) for x in p)
        feats = [f for c in contents[key] for f in c]
        content = 1.0 if m == 1 else 0.0 if not feats else 1 - sum(math.log(feats.count(f), m) for f in set(feats)) / len(set(feats))
        bare = own.count(()) / m
        if bare == 1:
            return content
        share = sum(seen[c] / n for c, n in children[key].items()) / m
        inner = sum(imp(c) * seen[c] / n for c, n in children[key].items()) / m + bare * content + max(0, 1 - share - bare)
        f = gamma ** len(set(own))
        return (1 - f) * node + f * inner

    return {k: (seen[k], imp(k)) for k in seen}


def site(n=9):
    out = []
    for i in range(n):
        menu = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(3))
        body = "".join(f"<div><p>unique {i} {k}</p></div>" for k in range(1 + i % 4))
        out.append((i, "http://s.com/x", f"<html><head><title>t</title></head><body><div class='x1'><ul>{menu}</ul></div><div class='x2'>{body}</div><div class='x3'>same words</div></body></html>"))
    return out + [(90, "http://t.com/", "<body><div class='x1'>only</div></body>"), (91, None, None), (92, "odd", "<p>q"), (92, "odd", "<p>q"), (93, "http://s.com/y", "")]


def test_importances_against_brute_force(spark):
    pages = site()
    rows = [(p[1].split("/")[2] if p[1] and "//" in p[1] else "", p[2]) for p in pages]
    made = hx.importances(spark.createDataFrame(rows, "host string, html string"), Scratch(spark, "t")).collect()
    want = brute([(h, p or "") for h, p in rows])
    assert {r.key for r in made} == set(want)
    for r in made:
        assert r.pages == want[r.key][0]
        assert abs(r.importance - want[r.key][1]) < 1e-6


@pytest.mark.parametrize("broadcast_keys", [10**6, 0])
def test_template_branches_go(spark, broadcast_keys):
    pages = site()
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in hx.main_text(frame, broadcast_keys=broadcast_keys).collect())
    want = [(i, "\n".join(f"unique {i} {k}" for k in range(1 + i % 4))) for i in range(9)] + [(90, "only"), (91, ""), (92, "q"), (92, "q"), (93, "")]
    assert rows == [(i, t, len(t)) for i, t in want]
    assert hx.main_text(frame.limit(0)).collect() == []


def test_repeated_article_stays(spark):
    page = "<body><div class='zz'>hello world</div><article><p>same</p><p>text</p></article></body>"
    frame = spark.createDataFrame([(i, "http://s.com/", page) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in hx.main_text(frame).collect()} == {"same\ntext"}


def test_pages_of_a_host_that_nest_deeply_keep_their_texts(spark):
    def deep(body, n=30):
        return "<div>" * n + body + "</div>" * n

    def rows(depth_of):
        out = []
        for i in range(4):
            bodies = [f"different {i}", f"<a href='/{i}'>read</a>", f"<p>two</p><div><p>different {i}</p></div>", f"<article>{deep(f'<p>same</p><p>own {i}</p>')}</article>", f"<article>{deep('<p>same</p>')}</article>", "<article><p>same</p></article>"]
            for k, body in enumerate(bodies):
                out.append((10 * k + i, f"http://s{k}.com/", f"<html><body><div class='x1'>same words</div>{deep(body, depth_of)}</body></html>", hx.extract(body, "", frozenset())))
            out.append((90 + i, "http://t.com/", f"<body><p>own {i}</p>{deep(f'the same on each<nav>{i}</nav>', depth_of)}</body>", f"own {i}"))
        return out

    made = spark.createDataFrame([r[:3] for r in rows(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in hx.main_text(made, depth=4).collect()} == {r[0]: r[3] for r in rows(8)}


def test_text_of_main_outside_an_article_stays():
    assert hx.extract("<body><div>out</div><main><p>lead</p><article><p>body</p></article><nav>n</nav></main></body>", "h", frozenset()) == "lead\nbody"


@pytest.mark.parametrize("unit", ["<div>", "<p><span>", "<span></b>", "<td><div>", "<li><i>", "<table><tr>", "<dl><dt><div>"])
def test_time_grows_with_the_page_alone(unit):
    import time

    def took(n):
        best = math.inf
        for _ in range(3):
            begun = time.process_time()
            hx.extract(unit * n + "deep", "h", frozenset({1}))
            best = min(best, time.process_time() - begun)
        return best

    assert hx.extract(unit * 5000 + "deep", "h", frozenset()) == "deep"
    assert took(32_000) < 40 * max(took(2000), 1e-3)  # sixteen times the page; a quadratic parser takes 256 times as long
