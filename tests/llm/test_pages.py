from __future__ import annotations

import random
import re
from html import unescape

from quernstone.llm import pages
from quernstone.llm.pages import Node, elements, extract, main_text, match, parse, votes
from quernstone.llm.queries import op1_main_text


def plain(html: str) -> str:
    """What the test table's pages hold in their article, by expressions that fit only these pages."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    art = re.sub(r"<[a-zA-Z/][^>]*\Z", "", m[1]) if m else ""
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", art)]
    return "\n\n".join(b for b in blocks if b)


def test_query_on_test_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op1_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def site(rng: random.Random, n: int, copies: int) -> list[tuple[int, str, str, str]]:
    """Pages without article elements or telling class names; only comparison shows what is template."""
    words = [f"w{i}" for i in range(500)]
    para = lambda: " ".join(rng.choices(words, k=30))
    out = []
    for i in range(n):
        title, body = para(), [para() for _ in range(rng.randint(1, 6))]
        if i and i <= copies:
            title, body = out[0][3][0], out[0][3][1]
        html = f"<body><div><p>Welcome to our house of words</p><p>Call us any time</p></div><div><h1>{title}</h1>" + "".join(f"<p>{b}" for b in body) + "</div><div><p>Made with care &copy; us</p></div>"
        out.append((i, "http://x.example.com/a", html, (title, body)))
    return out


def test_template_is_found_by_alignment(spark):
    pages = site(random.Random(4), 40, 18)  # nearly half are copies of the pivot's article
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    for i, _, _, (title, body) in pages:
        assert got[i] == "\n\n".join([title, *body])


def textbook(a: Node, b: Node) -> int:
    """Simple tree matching as published: the full table of the children's weights."""
    if a.tag != b.tag:
        return 0
    p, q = elements(a), elements(b)
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            m[i + 1][j + 1] = max(m[i + 1][j], m[i][j + 1], m[i][j] + textbook(x, y))
    return m[-1][-1] + 1


def random_tree(rng: random.Random, depth: int, width: int) -> str:
    tag = rng.choice(("div", "section", "span"))
    return f"<{tag}>" + "".join(random_tree(rng, depth - 1, width) for _ in range(rng.randint(0, width) if depth else 0)) + f"</{tag}>"


def checked(a: Node, b: Node) -> int:
    """The number of matched nodes, after a check that the pairs are a match: equal tags, parents matched, in order."""
    pairs = match(a, b)
    up = {id(c): n for t in (a, b) for n in walk(t) for c in elements(n)}
    of = {id(x): y for x, y in pairs}
    assert len(of) == len({id(y) for _, y in pairs}) == len(pairs)
    for x, y in pairs:
        assert x.tag == y.tag and (x is a and y is b or of[id(up[id(x)])] is up[id(y)])
    for x, _ in pairs:
        at = [of[id(c)].number for c in elements(x) if id(c) in of]
        assert at == sorted(at)
    return len(pairs)


def walk(node: Node):
    yield node
    for c in elements(node):
        yield from walk(c)


def test_matching_equals_the_textbook(monkeypatch):
    rng = random.Random(1)
    for k in range(300):
        a, b = (parse(random_tree(rng, rng.randint(1, 4), 4)) for _ in range(2))
        assert checked(a, b) == textbook(a, b)
    # long child lists: by rows of a table, and split where the table is too large
    for most in (pages.TABLE, 300):
        monkeypatch.setattr(pages, "TABLE", most)
        for _ in range(6):
            a, b = (parse("<ul>" + "".join(random_tree(rng, 2, 2) for _ in range(rng.randint(25, 60))) + "</ul>") for _ in range(2))
            assert checked(a, b) == textbook(a, b)
    a, b = parse("<div>ad</div><div><p>x<p>y<p>z</div>"), parse("<div><p>x<p>y<p>z</div>")
    assert checked(a, b) == 5
    a, b = (parse("<ul>" + "".join(rng.choice(("<li>x</li>", "<li><b>x</b></li>", "<p>x</p>")) for _ in range(6000)) + "</ul>") for _ in range(2))
    assert checked(a, b) > 4000


def test_deep_trees_match():
    a, b = parse("<div>" * 390 + "<p>x<p>y"), parse("<div>" * 390 + "<b>z</b><p>x")
    assert checked(a, b) == 392


def test_template_goes_and_slots_stay_inside_an_article():
    """Votes decide inside the article too: a constant paragraph goes, whatever its name, a varying one stays."""
    make = lambda k: parse(f"<article><h1>t{k}</h1><p>Read our paper every day and night</p><p class=notice>text {k} of its own</p><p>body {k} " + f"w{k} " * 20 + "</p></article>")
    pivot = make(0)
    counts: dict[int, list[int]] = {}
    for k in range(1, 5):
        for n, same in votes(pivot, make(k)):
            c = counts.setdefault(n, [0, 0])
            c[0] += 1
            c[1] += same
    constant = frozenset(n for n, (seen, same) in counts.items() if same >= 0.6 * seen)
    assert extract(make(3), pivot, constant) == ["t3", "text 3 of its own", "body 3" + " w3" * 20]


def test_structure():
    html = """<html><head><title>t</title></head><body class="has-sidebar"><header>h</header><nav>n</nav><div class="cookie-notice">c</div><main><h1>A &amp; B</h1><form>f</form>
    <p>one<br>two <b>three</b> <a href="x">four</a></p><aside>s</aside><ul><li>i<li>j</ul><script>if (a < b) {}</script><!-- no --><div id="comments"><p>reader</p></div></main><footer>z</footer>"""
    assert extract(parse(html)) == ["A & B", "one two three four", "i", "j"]
    assert extract(parse("just text &lt;b&gt; <p")) == ["just text <b>"]
    assert extract(parse("<p>a<style>p{}</style>b</p><div hidden>x</div><table><tr><td>1<td>2</table>")) == ["ab", "1", "2"]


def test_names_only_tell_apart_what_is_no_article():
    assert extract(parse('<div class="page has-sidebar"><h1>T</h1><p>Body text</p></div>')) == ["T", "Body text"]
    assert extract(parse('<div class="sidebar"><h1>T</h1><p>Body text</p></div>')) == ["T", "Body text"]
    html = """<article><header><h1>T</h1></header><p class="notice">n</p><div class="share-price">p</div><blockquote class="reply">r</blockquote><figure><img><figcaption>c</figcaption></figure>
    <div class="share-buttons">no</div><p class="ad">no</p><article class="comment"><p>no no no no no</p></article><div id="ad-slot-3">no</div><section class="comments"><h3>no</h3><article><p>no</p></article></section></article>"""
    assert extract(parse(html)) == ["T", "n", "p", "r", "c"]
    # without an article, menus are lists of links
    html = "<div><a href=1>one</a> | <a href=2>two</a> | <a href=3>three</a></div><div class='wrap'><h1>T</h1><p>Body <a href=4>link</a></p><ul><li>an <a href=5>item</a></ul></div><div class=comments><p>no</p></div>"
    assert extract(parse(html)) == ["T", "Body link", "an item"]
    assert extract(parse("<p>a</p><svg><svg>x</svg>inner</svg><p>b</p><header>no</header>")) == ["a", "b"]
    assert extract(parse("<main></main><div><p>body</p></div>")) == ["body"]


def test_raw_elements_hide_what_they_hold():
    assert extract(parse("<script>if (a<b) {} // don't</script><article><h1>T</h1><p>It's here and more.</p></article>")) == ["T", "It's here and more."]
    assert extract(parse("<script>var s='<!--';</script><article><p>a</p><style>p:after{content:'<p>'}</style><p>b</p></article>")) == ["a", "b"]
    assert extract(parse("<p>a</p><textarea><p>no</textarea><p title=\"it's\">b</p><p class=x' data-k='>'>c</p><p title=\"5\" tall\">d</p><script>rest <p>")) == ["a", "b", "c", "d"]
    assert extract(parse("<p>a <!-- <p>no --> b</p><![CDATA[x]]><?php no ?>c")) == ["a b", "c"]


def test_adverts_and_comments_of_unknown_names():
    for name in ("fb-comments-thread", "commentlist", "comment-section-v2", "google-ads", "dfp-ad", "td-ad-unit", "ad_top_728x90", "related-posts"):
        html = f'<div><h1>T</h1><p>Body text</p><div class="{name}"><h1>no</h1><article><h2>no</h2><p>no</p></article></div></div>'
        assert extract(parse(html)) == ["T", "Body text"], name
        assert extract(parse(html.replace("class=", "id="))) == ["T", "Body text"], name
    html = '<article><h1>T</h1><div class="no-ads">a</div><div id="ad-hoc">b</div><section class="related-work">c</section><h2 id="comments-on-it">d</h2><div class="with-comments">e</div><div style="color:red">f</div></article>'
    assert extract(parse(html)) == ["T", "a", "b", "c", "d", "e", "f"]
    assert extract(parse('<p>a</p><div style="Display : none">no</div><p style="visibility:hidden">no</p><h1>T</h1><div id="comments"><h1>no</h1></div>')) == ["a", "T"]


def test_template_over_half_of_the_text(spark):
    """Unmarked boilerplate of three times the article, without and with a heading that all pages share."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    say = lambda k: " ".join(rng.choices(words, k=k))
    fixed = [say(60) for _ in range(6)]
    rows, want = [], {}
    for i in range(24):
        title, body = ("Daily words", say(120)) if i % 2 else (say(5), say(120))
        host = f"http://h{i % 2}.example/"
        rows.append((i, host + str(i), f"<title>Daily words</title><div>{''.join(f'<div>{f}</div>' for f in fixed[:3])}</div><div><h1>{title}</h1><p>{body}</p></div><div>{''.join(f'<div>{f}</div>' for f in fixed[3:])}</div>"))
        want[i] = [body] if i % 2 else [title, body]
    rows += [(100 + k, rows[0][1], rows[0][2]) for k in range(8)]  # copies of the pivot's page don't vote
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == {i: "\n\n".join(w) for i, w in want.items()}
    assert got[103] == got[0]


def test_cases(spark):
    rows = [(1, None, None), (2, "", ""), (3, None, "<article>" + "<p>para" * 50_000), (3, None, "<p>x"), (4, "http://h/", "<p>" * 100), (5, "http://h/", "no tags"), (None, "http://h/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, text string, host int, n_chars int")
    got = main_text(df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == by[2].text == by[4].text == "" and by[5].text == "no tags" and by[None].text == "deep"
    assert max(r.n_chars for r in got) == 50_000 * 6 - 2
    assert main_text(df.limit(0)).count() == 0
