import itertools
import random
import time

from voxelloom.llm import html as h

PAGE = "page_id long, url string, html string"

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a> Slogan of the site</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div id="cookie-notice">We use cookies.</div><aside class="sidebar"><h3>Related</h3><p>Another story that is long enough to look like an article.</p></aside>
<main><article><h1>The &amp; Title</h1><p>First <b>paragraph</b>,&nbsp;with   <a href="#">a link</a>
 and more.<p>Second &lt;one&gt;<br>goes on.<!-- hidden <p>x</p> --></p><div class="ad">Buy now, it is cheap and good!</div>
<ul><li>Point one<li>Point two</ul><form><label>Mail</label><input name=q><button>Send</button></form>
<section class="comments"><p>A reader writes a long comment about this article, and much more.</p></section></article></main>
<footer>&copy; 2024</footer><noscript>No script</noscript></body></html>"""

WANT = "The & Title\n\nFirst paragraph, with a link and more.\n\nSecond <one> goes on.\n\nPoint one\n\nPoint two"


def test_main_text_of_a_page():
    assert h.main_text(FULL) == WANT


def test_page_without_semantic_elements():
    page = """<body><div class="menu"><a href=1>Home</a> <a href=2>News</a></div><div><p>A paragraph of some length, as articles have it, with a full stop.</p>
    <p>Short one.</p><p>Another paragraph that is long enough to be taken for what it is.</p></div><div id=footer>All rights reserved</div></body>"""
    assert h.main_text(page).split("\n\n") == ["A paragraph of some length, as articles have it, with a full stop.", "Short one.", "Another paragraph that is long enough to be taken for what it is."]


def test_broken_markup():
    for page in ("", "<", "<p", "text only & more", "<p>a<script>", "</div></p>", "<a title='it's>x</a>", "<!-- open", '<p title="<b>">x', "<" * 3000, "<p>" * 2000 + "x"):
        assert isinstance(h.main_text(page), str)
    assert [b.text for b in h.blocks("a<b>b</b>c<p>d<i>e<p>f</div>g")] == ["abc", "de", "fg"]
    assert [b.text for b in h.blocks("<div>a<p>d<i>e<p>f</div>g")] == ["a", "de", "f", "g"]
    assert [b.text for b in h.blocks("<p>a<span>b</p>c")] == ["ab", "c"]


def test_long_attribute_values():
    for n in (10, 3000, 5000, 100_000, 2_000_000):
        long = "QUJD" * (n // 4)
        for value in (f'"data:image/png;base64,{long}"', f"""'{{"a": "{long} > b"}}'""", f'"{long} > {long}"', long):
            page = f"""<p>Zero.</p><img src={value} alt="x"><p>Lost paragraph one.</p><p>Two <a href="/u">link</a>, it's said.</p>"""
            assert [b.text for b in h.blocks(page)] == ["Zero.", "Lost paragraph one.", "Two link, it's said."]


def test_stray_quotes():
    assert [b.text for b in h.blocks("<p title=it's>one</p><p>isn't two</p>")] == ["one", "isn't two"]
    assert [b.text for b in h.blocks("<p class='a'' id=x>one</p><p>isn't two</p>")] == ["one", "isn't two"]
    assert [b.text for b in h.blocks('<p title="open>one</p><p>two</p>')] == ["one", "two"]
    assert [b.text for b in h.blocks('<p title= >one</p><p =">two</p><p a = "b>c"d>three</p>')] == ["one", "two", "three"]
    begun = time.perf_counter()
    for part in ("<a b='", '<a b="', "<a b=", "<a =", "<a b ", "<a b\t\n", "<a '", '="', "<a b=c"):
        h.blocks("<p " + part * 50_000)
        h.blocks("<p x" + part * 50_000 + "</p>")
    h.blocks("<p x" + " " * 500_000 + "y>")
    assert time.perf_counter() - begun < 20


def test_min_cut_is_least_energy():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 8)
        unary = [rng.choice([-2, -1, -0.5, 0.3, 0.6, 1, 3]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.2, 0.7, 1.5])) for _ in range(rng.randrange(10))]

        def energy(label):
            return sum(u if not on else 0 for u, on in zip(unary, label) if u > 0) + sum(-u for u, on in zip(unary, label) if u < 0 and on) + sum(w for a, b, w in edges if label[a] != label[b])

        least = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(h.min_cut(unary, edges)) - least) < 1e-9


def test_smoothness_decides_doubtful_blocks():
    assert h.min_cut([2.0, -0.3, 2.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [True] * 3
    assert h.min_cut([2.0, -1.0, 2.0], [(0, 1, 0.4), (1, 2, 0.4)]) == [True, False, True]


LONG = "A paragraph of the article that is long enough to be taken for what it is, with a full stop."
FLOW = [
    # a paragraph that is but a link, among others; short lines; a heading in a list of links
    (f"<article><p>{LONG}</p><p><a href=1>See the other part</a></p><p>{LONG}</p></article>", f"{LONG}\n\nSee the other part\n\n{LONG}"),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p><p><a href=1>Part two</a></p><p>{LONG}</p></div><div id=footer>Imprint</div>", f"{LONG}\n\n{LONG}\n\nPart two\n\n{LONG}"),
    (f"<article><p>{LONG}</p><pre><a href=x>x</a></pre><pre><a href=x>y</a> z</pre><p>{LONG}</p></article>", f"{LONG}\n\nx\n\ny z\n\n{LONG}"),
    ("<body><div><span>" + "</span></div><div><span>".join(f"<a href={k}>Item {k}</a>" for k in range(9)) + "</span></div><div>This one line among links says it, and ends.</div><div><a href=z>Item z</a></div>", ""),
]


def test_flow_changes_labels():
    """Where the cut departs from what each block says by itself."""
    moved = 0
    for page, want in FLOW:
        found = h.blocks(page)
        alone = [x > 0 for x in h.log_odds(found, h.Model())]
        assert h.main_text(page) == want
        moved += alone != h.choose(found, h.Model())
    assert moved >= 3


def test_wrappers_and_names_with_two_meanings():
    form = f"<body><form id='aspnetForm' method=post><nav><a href=1>Home</a></nav><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p><div class=footer>Imprint and such</div></form>"
    assert h.main_text(form) == f"Title of it\n\n{LONG}\n\n{LONG}"
    assert h.main_text(f"<article><h1>Law</h1><section class='legal-text'><p>{LONG}</p><p>{LONG}</p></section></article>") == f"Law\n\n{LONG}\n\n{LONG}"
    assert h.main_text(f"<article><h1>Law</h1><div id=message><p>{LONG}</p></div></article>") == f"Law\n\n{LONG}"
    assert h.main_text(f"<div class='with-sidebar nav-open'><article class='post ad-free'><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>") == LONG
    assert h.main_text(f"<div class=ad>{LONG} {LONG}</div><article><h1>Short.</h1><p>It is.</p></article>") == "Short.\n\nIt is."
    talk = "".join(f"<p>{LONG} {LONG}</p>" for _ in range(20))
    assert h.main_text(f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class='notice'>{LONG}</div></article><section id=comments>{talk}</section>") == f"T\n\n{LONG}\n\n{LONG}"


def test_fit_learns_names_of_the_sample():
    pages = [f"<nav class=zork><a href=1>Home</a> <a href=2>Away {k}</a></nav><article><p>{LONG}</p></article><footer class=blurb>Some words of it.</footer>" for k in range(30)]
    model = h.fit(pages)
    assert model.words["blurb"] < 0 and set(model.words) == {"zork", "blurb"}
    assert all(w * p >= 0 for w, p in zip(model.weights, h.PRIOR.values()))
    assert h.fit([]) == h.fit([FULL, None or ""][1:]) == h.Model()


def test_time_grows_with_the_page():
    n = 30_000
    pages = ["<b>" * n + "</i>" * n, "<i><div>" + "<b></i>" * n, "<b>" * n + "<hr>" * n, "<div>" * n + "<dt></dt>" * n, "<dt><dl>" + "<div>" * n + "<dd></dd>" * n, "<p>" * n + "</p>" * n,
             "<body><head>" * n, "<div class='x1 y'>" * n + "a", "<form>" * n + "a<p>b", "<p>a</p><div>b</div>" * n, "<p>Long enough it is, I say.</p><div class=ad>b c d e f</div>" * n, "<ul><li>x" * n]
    for page in pages:
        begun = time.perf_counter()
        h.main_text(page)
        assert time.perf_counter() - begun < 25, page[:40]


def test_articles_of_the_table(spark):
    """Against SQL that takes the article elements apart; it shares nothing with the operator."""
    import duckdb

    from voxelloom.llm.queries import ORACLES

    table = "/root/testdata/sf0.01/pages.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{table}'")
    want = duckdb.sql(ORACLES["op2_html_text"]).fetchall()
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in h.report(spark.read.parquet(table)).collect()]
    assert len(got) == 250 and sorted(got) == sorted(want)


def test_nulls_ties_empty_and_clashing_names(spark):
    rows = [(1, "u", None, "old"), (1, "u", None, "old"), (None, None, FULL, "old"), (2, "v", "<p>" + "word " * 100_000, None)]
    got = h.extract(spark.createDataFrame(rows, PAGE + ", text string"), h.Model()).collect()
    assert len(got) == 4 and [r.text for r in got[:3]] == ["", "", WANT] and got[3].n_chars == 499_999
    assert h.report(spark.createDataFrame([], PAGE)).count() == 0


def test_plain_text_is_that_of_all_blocks():
    import pyarrow.parquet as pq

    table = [r or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()]
    odd = ["", "a", "<p>a<p>b", "<div hidden>x<div>y</div>z</div>w", "<p hidden>a<p>b", "<head><title> A &amp; b</title>x<body>y", "<svg><a href=1>x</a></svg>z", "a<br>b<textarea>c</textarea>d",
           "<ul><li style='display: none'>a<li>b</ul>", "<select><option>a</select>b", "<object><script>'</object>'</script>x</object>y", "<a href='1&amp;2'>x</a><a>y</a><a HREF=z>", "<div style='color:red'>a</div>b"]
    for page in table + odd + [p for p, _ in FLOW] + [FULL]:
        a, b = h.Seen(), h.Seen()
        assert h.plain_text(page, a) == [x.text for x in h.blocks(page, b)] and a == b, page[:80]
