"""Embeddings, pages, URLs, archives and the pipeline."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioflow.llm import embedding_dedup, html_extract, url_filter, warc
from biblioflow.llm._shared import connected_components


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 4), (20, 3)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 9: 7, 8: 7, 7: 7, 100: 100} | {i: 100 for i in range(101, 160)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("false")).count() == 0


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = [centre[i % 12] + rng.normal(size=16) * (0.05 + 0.1 * (i % 5)) for i in range(150)]
    rows = [(i, [float(v) for v in np.float32(a)]) for i, a in enumerate(x)]
    rows += [(150 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, [1.0, 2.0]), (205, []), (206, [float("inf")] * 16), (207, [v * 3e30 for v in rows[0][1]])]
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} for i in unit}
    part = {i: i for i, _ in rows}
    for _ in rows:
        part = {i: min([part[i], *(part[j] for j in links.get(i, ()))]) for i in part}
    want = sorted((i, len(links.get(i, ())), part[i], part[i] == i) for i, _ in rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    for block in (8_192, 40):
        monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
        monkeypatch.setattr(embedding_dedup, "TILE", 16)
        assert sorted(tuple(r) for r in embedding_dedup.dedup(df).collect()) == want
    assert sum(w[1] for w in want) > 100
    assert embedding_dedup.dedup(df.where("false")).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_embeddings_without_ids(spark, order):
    """Vectors at 0, 15, 30 degrees and so on link with their neighbours only; those without an id take part."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, 0), (None, 15), (2, 30), (None, 100), (None, 115), (7, 200), (None, 200), (8, 300), (8, 260)][::order]
    got = embedding_dedup.dedup(spark.createDataFrame([(i, at(d)) for i, d in rows], "vec_id long, embedding array<float>")).collect()
    want = [(1, 1, 1, True), (None, 2, 1, False), (2, 1, 1, False), (None, 1, None, False), (None, 1, None, False), (7, 1, 7, True), (None, 1, 7, False), (8, 0, 8, True), (8, 0, 8, True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = (embedding_dedup.Quantised(rng.normal(size=(300, 24)) * rng.uniform(0.01, 100, (300, 1))) for _ in "ab")
    exact = a.unit @ b.unit.T
    near = (a.code.astype(float) * a.scale[:, None]) @ (b.code.astype(float) * b.scale[:, None]).T
    assert (np.abs(exact - near) <= a.error[:, None] + a.length[:, None] * b.error[None, :]).all()


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy {n}</div><article><h1>Head {n}</h1><p><b>One &amp; {n}<br>two</b><p>Three\n  four of {n}{more}</article><footer>&copy; foot {n}</footer></body></html>'


def test_html(spark):
    pages = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i, more="</p><p>Five</p><p>Six" * (i % 3))) for i in range(30)]
    odd = [(100, "http://h0.example.com/x", None), (101, None, ""), (102, "nourl", "plain text only"), (103, "http://z.org/", "<div>" * 3_000 + "deep"), (104, "http://h1.example.com/cut", PAGE.format(n=1, more="")[:330]), pages[3]]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for i, url, _ in pages:
        assert got[i].text == "\n\n".join([f"Head {i}", f"One & {i} two", f"Three four of {i}", *["Five", "Six"] * (i % 3)])
        assert (got[i].url, got[i].n_chars) == (url, len(got[i].text))
    assert [got[i].text for i in (100, 101)] == ["", ""] and got[103].text == "deep" and got[104].text.startswith("Head 1")
    assert html_extract.extract(df).count() == 36 and html_extract.extract(df.where("false")).count() == 0
    noisy = '<html><body><header>Top</header><div class="cookie-notice">We use</div><div id="main"><h2>Ti &amp; tle</h2><p>One<br>two <b>bold</b><p>Three<ul><li>a<li>b</ul><div class="comments"><p>Nope</p></div><form>x</form></div><aside>side</aside><footer>f</footer>'
    assert html_extract.text_of(noisy, None) == "Ti & tle\n\nOne two bold\n\nThree\n\na\n\nb"


def test_html_names_that_only_sound_like_a_menu(spark):
    """Layout wrappers, widget containers and generated ids keep their text; what is a menu, advert or comment by its whole name goes."""
    article = '<article><h1 id="comments">Head {n}</h1><div class="elementor-widget-container"><p>Para {n} of text</p></div><h2 id="related-work">Related</h2><section id="share-prices"><p class="notice">Prices {n}</p></section><div id="social-policy">Policy {n}</div><div class="related-posts"><a href="/1">Other post</a></div><div class="comment-list"><p>Nope</p></div></article>'
    want = "Head {n}\n\nPara {n} of text\n\nRelated\n\nPrices {n}\n\nPolicy {n}"
    around = ['<div class="content-sidebar-wrap">', '<div class="layout has-sidebar">', '<div class="sidebar">', "<form>"]
    pages = [(10 * k + n, f"http://h{k}.org/{n}", f"<html><body><nav>Menu</nav>{start}{article.format(n=n)}") for k, start in enumerate(around) for n in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: want.format(n=i % 10) for i, _, _ in pages}
    plain = '<body><div class="ad">Buy</div><div class="widget"><p>All of the text of this page</p></div><div class="page-sidebar"><a href="/">A link</a></div>'
    assert html_extract.text_of(plain, None) == "All of the text of this page"
    talk = '<body><article><p>Short</p><div id="comments" class="comments-area"><article class="comment-body"><p>Much longer than the article is</p></article></div></article>'
    assert html_extract.text_of(talk, None) == "Short"


def test_wrapper_alignment():
    a, b = (html_extract.wrapper(x) for x in ("<div><h1>x</h1><p>a</p><p>b</p></div>", "<div><h1>y</h1><img><ul><li>1</li><li>2</li></ul><p>c</p></div>"))
    html_extract._unite(a, b)
    assert a.expression() == "<> <div> <h1>#</> <ul> <li>#</>+</>? <p>#</>+</></>"
    again = html_extract.Node.load(a.dump())
    assert again.expression() == a.expression()
    same, other = (html_extract.wrapper(f"<div><b>Site</b></div><p>{x}</p>") for x in "xy")
    html_extract._unite(same, other)
    assert same.expression() == "<> <div>'…' <b></></> <p>#</></>"


def extracted(spark, pages):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}


def test_html_wrappers_decide(spark):
    """Class names without meaning: what all pages of a host share is template, wherever it stands; what varies is the article."""
    header = "The long header of this site, which every page shows. " * 20
    mailing = "Sign up for our mailing list today!"
    pages, want = [], {}
    for h in range(20):
        x = [f"k{h}{c}" for c in "abcd"]
        for n in range(3 + h % 4):
            own = [f"Host {h} tells of {n} in part {k}, at some length." for k in range(1 + (n + h) % 4)]
            blocks = own[:1] + [mailing] + own[1:]
            body = "".join(f"<p>{b}</p>" if h % 2 else f"<div class={x[3]}>{b}</div>" for b in blocks)
            pages.append((100 * h + n, f"http://h{h}.org/{n}", f"<body><div class={x[0]}>{header}</div><div class={x[1]}><a href=/{n}>Other page {n}</a></div><div class={x[2]}>{body}</div><div class={x[0]}2>All rights of {h}</div>"))
            want[100 * h + n] = own
    got = extracted(spark, pages)
    for i, own in want.items():
        assert got[i].split("\n\n") == own, i


def test_html_template_needs_evidence(spark):
    """Copies of one page, two pages, and texts that only some pages have say nothing of a template."""
    one = "<body><article><h1>Title</h1><p>The same text</p></article>"
    two = "<body><div class=q><p>The same text here</p><p>Page {n}</p></div>"
    some = "<body><div class=q><p>Text of {n}</p>{more}</div>"
    pages = [(n, "http://copies.org/", one) for n in range(5)] + [(10 + n, "http://two.org/", two.format(n=n)) for n in range(2)] + [(20 + n, "http://some.org/", some.format(n=n, more="<p>Said by most</p>" if n else "")) for n in range(5)]
    got = extracted(spark, pages)
    assert {got[n] for n in range(5)} == {"Title\n\nThe same text"}
    assert [got[10 + n] for n in range(2)] == [f"The same text here\n\nPage {n}" for n in range(2)]
    assert [got[20 + n] for n in range(5)] == ["Text of 0"] + [f"Text of {n}\n\nSaid by most" for n in range(1, 5)]
    deep = "<div>" * 2_000 + "Deep {n}" + "</div>" * 2_000
    got = extracted(spark, [(n, "http://deep.org/", "<body>" + deep.format(n=n)) for n in range(3)])
    assert got == {n: f"Deep {n}" for n in range(3)}


def test_urls(spark):
    canonical = '<link rel="canonical" href="http://a.other.org/es/1">'
    rows = [
        (1, "https://X.Example.COM/en/7?q", None), (2, "http://a.com/en/1", ""), (3, "http://notcom/en/1", ""), (4, "ftp://b.net/de/9#f", ""), (5, "http://b.example.net/de/8", ""), (6, None, ""), (7, "nothing", ""),
        (8, "http://alias.io/page", canonical), (9, "http://alias.io/page#again", ""), (10, "http://free.io/", ""), (11, "http://b.com/en/7", canonical), (12, "http://hop.io/1", ""), (12, "http://hop.io/1", ""), (13, "http://q.io?x=://y", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    hops = spark.createDataFrame([("http://hop.io/1", "http://hop.io/2"), ("http://hop.io/2", "https://z.net/de/x"), (None, "http://free.io/")], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, redirects=hops).collect()}
    assert got[1] == ("x.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.com", "/en/1", "com/en/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == ("b.net", "/de/9", "net/de/", "block") and got[5][2] == "example.net/de/8"
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == got[9][2:] == (None, "block") and got[10][3] == "allow" and got[12][2:] == (None, "block")
    assert got[11][2:] == ("com/en/", "block") and got[13][:2] == ("q.io", "")
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.where("false")).count() == 0


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives(spark, tmp_path, min_bytes):
    rows = [(5, "u\n", "same"), (3, None, "same"), (4, "x", None), (9, "x", ""), (None, "y", "same"), (3, "z", "same"), (11, "l", "é" * 200_000)] + [(100 + i, f"http://e/{i}", f"<p>{i % 40} text</p>" * 30) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("rep", F.lit("clash"))
    warc.write(df, str(tmp_path / "w"), min_bytes)
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        assert not data or data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        rep = least[h or ""] if len(p) >= min_bytes and least[h or ""] != i else None
        want.append(repr((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if rep is not None else "response", rep)))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(want)
    assert all(bytes(r.payload) == (b"\xc3\xa9" * 200_000) for r in got if r.page_id == 11)
    warc.write(df.where("false"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
