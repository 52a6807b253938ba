"""Operators on pages, urls, WARC records and vectors, and the pipeline."""

import gzip
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossa.llm import html, urls, vectors, warc
from glossa.llm.hnsw import Graph
from glossa.llm.shared import Scratch, components

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site name, a banner.</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/a>All about us</a></ul></nav>
<div id="cookie-notice">We use cookies, and you can't help it.</div><div class="container">
%s
<aside>Also read this, and that.</aside></div><form><label>Mail</label><input><button>Send</button></form>
<section id="comments"><h3>Comments</h3><p>First! I was first, and I am glad of it, truly.</p></section><footer>&copy; Site</footer></body></html>"""
TEXT = ["A heading", "First paragraph with bold & more text, long enough to count as prose.", "Ok.", "Second paragraph: it goes on, and on, until it ends.", "point one", "point two", "“Quoted” words"]
BODY = """<h1>A
 heading</h1><div class="ad">Buy now, it is cheap!</div><p>First paragraph with <b>bold</b> &amp; more<br>text, long
 enough to count as prose.<p>Ok.</p><p>Second paragraph: it goes on, and on, until it ends.</p><ul><li>point one<li>point two</ul><blockquote>&ldquo;Quoted&rdquo; words</blockquote>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><article class='post'>%s</article></main>", '<div class="content">%s</div>', '<div role="main" id="story">%s</div>'])
def test_main_text(wrap):
    assert html.main_text(PAGE % (wrap % BODY)).split("\n") == TEXT


def test_main_text_odd_pages(spark):
    for page in (None, "", "   ", "<html></html>", "<script>x</script>", "<!-- c -->"):
        assert html.main_text(page) == ""
    assert html.main_text("<p>Just a line &lt;3</p>") == "Just a line <3"
    assert html.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    rows = [(1, "u", "<p>é</p>", 1), (1, None, None, 2), (None, "x", "", 3)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "é", 1), (1, None, "", 0), (None, "x", "", 0)], key=str)


BODY_TEXT = "Body text, it is long and has commas, too. " * 5


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="post has-sidebar"><h1>T</h1><p>One two, three four. Five six, seven.</p><p>More text here.</p></div><div class="sidebar"><p>Side text here, with words.</p></div>', ["T", "One two, three four. Five six, seven.", "More text here."]),
        ('<div class="single comments-open"><p>One two, three four. Five six, seven.</p><p>More text here.</p></div><section id="comments"><p>First, I say! Very nice.</p><p>Second, I say it is so very, very nice.</p></section>', ["One two, three four. Five six, seven.", "More text here."]),
        ('<form id="aspnetForm"><div id="header"><ul><li><a href=x>A</a></ul></div><div id="main"><h1>T</h1><p>One two, three four. Five six, seven.</p><label>Mail</label><button>Go</button></div><div class="sidebar">Side, text.</div></form>', ["T", "One two, three four. Five six, seven."]),
        (f'<div id=page><div class=menu><a href=1>m</a></div><div><h1>Head</h1><p>Lead text, of one sentence.</p><div><p>{BODY_TEXT}</p><p>{BODY_TEXT}</p></div></div><footer>foot text here</footer></div>', ["Head", "Lead text, of one sentence.", BODY_TEXT.strip(), BODY_TEXT.strip()]),
        (f"<article><h1>T</h1><p>{BODY_TEXT}</p><h2>Sources</h2><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h3>More stories</h3><ul><li><a href=a>A</a><li><a href=b>B</a></ul></article>", ["T", BODY_TEXT.strip(), "Sources", "One", "Two"]),
        ("<head><title>x</title><p>Text in a page, without an end of its head.", ["Text in a page, without an end of its head."]),
        ("<p>a<![foo]>b</p><![CDATA[ x ]]><p>c", ["ab", "c"]),
    ],
)
def test_main_text_without_markup_to_lean_on(page, want):
    assert html.main_text(page).split("\n") == want


def plain_ratios(rows, parents):
    """own, smooth, above of each path; rows: (path, chars, marks, link chars, weight) of each block."""

    def own(p):
        mine = [r for r in rows if r[0] == p]
        return sum(r[1] - r[3] for r in mine) / len(mine) * math.sqrt(1 + sum(r[2] for r in mine) / len(mine))

    def prefixes(p):
        return [p] if p == 0 else [p, *prefixes(parents[p])]

    def below(q):
        under = [((r[1] - r[3]) * r[4], own(r[0])) for r in rows if q in prefixes(r[0])]
        return sum(m * x for m, x in under) / sum(m for m, _ in under) if sum(m for m, _ in under) > 0 else 0.0

    last = len(rows) - 1
    kernel = [math.exp(-k * k / 2) for k in (-2, -1, 0, 1, 2)]
    near = [[rows[min(max(i + k, 0), last)] for k in (-2, -1, 0, 1, 2)] for i in range(len(rows))]
    around = [sum(w * own(r[0]) * r[4] for r, w in zip(x, kernel)) / sum(kernel) for x in near]
    out = {}
    for p in {r[0] for r in rows}:
        mine = [a for a, r in zip(around, rows) if r[0] == p]
        out[p] = own(p), sum(mine) / len(mine), max(0.75**k * below(q) for k, q in enumerate(prefixes(p)))
    return out


def test_path_ratios_equal_brute_force():
    rng = random.Random(11)
    weight_of = {p: rng.choice([0.1, 1.0]) for p in range(6)}
    rows = [(p := rng.randrange(6), n := rng.randrange(1, 300), rng.randrange(9), n * rng.choice([0, 0, 0.3, 1]), weight_of[p]) for _ in range(60)]
    parents = [0, 0, 1, 1, 3, 0]
    got = html.path_ratios(*map(list, zip(*rows)), parents)
    for p, (own, smooth, above) in plain_ratios(rows, parents).items():
        assert (got.own[p], got.smooth[p], got.above[p]) == (pytest.approx(own), pytest.approx(smooth), pytest.approx(above))


def plain_text(page):
    """The selection once more, block by block from the parsed page's elements."""
    blocks = page.blocks
    rows = [(b.element.path, len(b.text), len(html.PUNCTUATION.findall(b.text)), b.link_chars / max(1, b.chars) * len(b.text), b.element.weight) for b in blocks]
    ratios = plain_ratios(rows, page.parents)
    score = [w * math.sqrt(ratios[p][0] * ratios[p][1]) for p, _, _, _, w in rows]
    mass = [(n - k) * w for _, n, _, k, w in rows]
    mean = sum(m * s for m, s in zip(mass, score)) / (sum(mass) or 1)
    texts = {p: 1 - sum(r[3] for r in rows if r[0] == p) / sum(r[1] for r in rows if r[0] == p) for p in ratios}
    inner = [w * texts[p] * ratios[p][0] ** 0.25 * ratios[p][2] ** 0.75 for p, _, _, _, w in rows]
    chosen, stays = [s > 0 and s >= 0.3 * mean for s in score], [s > 0 and s >= 0.05 * mean for s in inner]
    if not sum(m for m, c in zip(mass, chosen) if c):
        mass = [r[1] for r in rows]
        chosen = stays = [r[4] >= 0.5 for r in rows]

    def lines(e):
        return [] if e is None else [e, *lines(e.parent)]

    held = {}
    for b, m, c in zip(blocks, mass, chosen):
        for e in lines(b.element):
            held[id(e)] = held.get(id(e), 0) + m * c
    total = sum(m for m, c in zip(mass, chosen) if c)
    best = max((b.element for b, c in zip(blocks, chosen) if c), key=lambda e: held[id(e)])
    best = next((e for e in lines(best) if held[id(e)] >= 0.85 * total), best)
    whole = [e for tag in ("article", "main") for e in lines(best) if e.tag == tag and e.weight >= 0.5]
    if whole:
        best = whole[0]
    elif best.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "blockquote", "pre") and best.parent is not None:
        best = best.parent
    within = [any(e is best for e in lines(b.element)) for b in blocks]
    title = next((i for i, b in enumerate(blocks) if b.element.tag == "h1"), None) if not any(x and b.element.tag == "h1" for x, b in zip(within, blocks)) else None
    first = within.index(True) if True in within else len(blocks)
    kept = {i for i in range(len(blocks)) if (stays[i] if within[i] else chosen[i] or title is not None and title <= i < first and stays[i])}
    heads = [i for i, b in enumerate(blocks) if b.element.tag in html.HEADINGS]
    for i, end in zip(heads, [*heads[1:], len(blocks)]):
        below = [j for j in range(i + 1, end) if within[j]]
        if i in kept and blocks[i].element.tag != "h1" and below and not kept & set(below):
            back = [] if html.ELSEWHERE.match(blocks[i].text) else [j for j in below if rows[j][4] >= 0.5 and not blocks[j].element.menu]
            kept |= set(back)
            if not back:
                kept.discard(i)
    return "\n".join(blocks[i].text for i in sorted(kept))


def odd_page(rng):
    leaf = ["<p>%s</p>", "<li><a href=x>%s</a></li>", "<h2>%s</h2>", "<p>%s <a href=y>more</a></p>", "<div class='ad'>%s</div>", "<h3>Related %s</h3>", "<nav><a href=z>%s</a></nav>", "<blockquote>%s</blockquote>", "<h1>%s</h1>"]
    box = ["<div>%s</div>", "<article>%s</article>", "<section>%s</section>", "<aside>%s</aside>", "<div class=comments>%s</div>", "<ul>%s</ul>", "<main>%s</main>", "<footer>%s</footer>"]

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(leaf) % " ".join(rng.choice(["Word,", "longer words.", "and", "x"]) for _ in range(rng.choice([1, 3, 25])))
        return rng.choice(box) % "".join(node(depth - 1) for _ in range(rng.randrange(1, 5)))

    return "".join(node(4) for _ in range(rng.randrange(1, 4)))


def test_selection_equals_brute_force():
    rng = random.Random(13)
    for _ in range(150):
        markup = odd_page(rng)
        page = html.parsed(markup)
        got = html.main_text(markup)
        html._weigh(page)
        if all(b.element.weight < 0.5 for b in page.blocks):
            for e in page.elements:
                e.weight = 1.0
        assert got == plain_text(page), markup


def test_path_ratios_decide(spark, monkeypatch):
    """With one ratio for all paths no page of the test tables comes out the same."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    texts = [html.main_text(p) for p in pages]
    monkeypatch.setattr(html, "path_ratios", lambda paths, *_: html.Ratios(*({p: 1.0 for p in paths} for _ in range(3))))
    assert all(html.main_text(p) != t for p, t in zip(pages, texts))


def test_texts_in_frames_of_the_article():
    lists = "<ul><li>a</li><li>bc</li></ul><table><tr><td>1</td><td>x</td></tr></table><p>Ok</p>"
    inside = f"<h1>T</h1><p>{BODY_TEXT}</p><h2>On</h2>{lists}<p>{BODY_TEXT}</p>"
    want = ["T", BODY_TEXT.strip(), "On", "a", "bc", "1", "x", "Ok", BODY_TEXT.strip()]
    for wrap in ("<article>%s</article>", "<div>%s</div>", "<div><div>%s</div></div>"):
        for extra in (
            f'<div class="discussion"><p>{BODY_TEXT}</p></div>', f'<ol class="user-comments"><li><p>{BODY_TEXT}</p></ol>', '<div id="google_ads_1">Buy now, it is cheap!</div>',
            "<nav><h2>Menu</h2><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>", "<ul class=breadcrumbs><li><a href=x>Home</a></ul>", f"<aside><p>{BODY_TEXT}</p></aside>",
        ):
            page = "<header><p>Site, a banner.</p></header>" + wrap % (inside + extra) + "<footer>&copy; Site, all rights reserved.</footer>"
            assert html.main_text(page).split("\n") == want, (wrap, extra)


@pytest.mark.parametrize("piece", ["<a ", "<a b=", "<p a='", '<p a="', "<", "</", "<!--", "<![x", "<script>", "<title>x", "<p>a", "<div>x", "<b>", "&", "<a = "])
def test_broken_pages_of_a_megabyte(piece):
    began = time.time()
    html.main_text(piece * (1_000_000 // len(piece)))
    html.main_text("<p>Text, first.</p>" + piece * (1_000_000 // len(piece)) + "'\">")
    assert time.time() - began < 40


def test_broken_pages_end_in_time():
    rng = random.Random(12)
    pieces = ["<![", "<!", "<![foo]>", "<p>", "</p>", "<b>", "</b>", "<div class='a b'>", "</div>", "text, more. ", "&amp", "<", ">", "<a href=x>", "</a>", "<table><td>", "</table>", "<!--", "-->", "<script>", "</script>", "\x00", "<head>", "<br>", "<svg/>"]
    for _ in range(300):
        page = "".join(rng.choice(pieces) for _ in range(40))
        assert isinstance(html.main_text(page), str) and isinstance(html.visible_text(page), str)
    began = time.time()
    for tags in ("<div>", "<b><p>", "<ul><li>", "<b>"):
        assert html.main_text(tags * 20_000 + "deep") == "deep"
    assert time.time() - began < 10


def test_url_parts_and_rules(spark):
    cases = {
        "http://WWW.Example.COM/EN/x?q#f": ("www.example.com", "/EN/x"), "https://a.net/fr/1": ("a.net", "/fr/1"), "x": ("", ""), None: ("", ""), "a://b://c/d": ("b:", "//c/d"),
        "http://h?x/y": ("h", ""), "http://h#": ("h", ""), "http://": ("", ""), "http://É.com/": ("É.com", "/"), "http://www.example.com/en/1": ("www.example.com", "/en/1"),
        "http://m.example.com/en/1": ("m.example.com", "/en/1"), "http://myexample.com/en/": ("myexample.com", "/en/"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(cases))] == list(cases.values())
    rule = {u: (got[i].rule, got[i].verdict) for i, u in enumerate(cases)}
    assert rule["http://www.example.com/en/1"] == ("www.example.com/en/", "allow") and rule["http://m.example.com/en/1"] == ("example.com/en/", "block")
    assert rule["http://myexample.com/en/"] == ("com/", "allow") and rule["https://a.net/fr/1"] == ("net/fr/", "block") and rule["x"][0] is None


def reputation(spark, urls_of, labels):
    table = spark.createDataFrame(urls_of, "page_id long, url string").withColumn("host", urls.host_and_path(F.col("url"))[0])
    return {r.site: r.bad_bound for r in urls.host_reputation(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark)).collect()}


def test_reputation_shrinks_and_blocks(spark):
    pages = [(i, f"http://bad.site.org/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 9}.other.org/") for i in range(90)] + [(300, "http://new.site.org:8080/"), (301, "http://me@new.other.org./")]
    labels = [(i, 0, 0) for i in range(60)] + [(100 + i, 1, int(i % 30 == 0)) for i in range(90)] + [(300, None, None)]
    bound = reputation(spark, pages, labels)
    assert bound["bad.site.org"] >= bound["new.site.org"] > 0.5 > 0.2 > bound["new.other.org"]
    # One bad label of two blocks nobody, and no labels nobody either.
    assert max(reputation(spark, pages, [(0, 0, 0), (100, 1, 0)]).values()) < urls.MAX_BAD
    assert max(reputation(spark, pages, []).values()) < 0.1


def test_registered_domains(spark):
    cases = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "com": ("com", "com"), "": ("", ""), "u.github.io": ("u.github.io", "github.io"), "10.0.0.1": ("10.0.0.1", ""),
        "[::1]": ("[::1]", ""), "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"), "a.b.c.d.example.org": ("example.org", "org"),
    }
    domain, suffix = urls.domain_and_suffix(F.col("site"))
    got = {r.site: (r.d, r.s) for r in spark.createDataFrame([(c,) for c in cases], "site string").select("site", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == cases
    sites = spark.createDataFrame([("u:p@x.com:80",), ("x.com.",), ("[::1]:443",), ("",)], "host string").select(urls.site_of(F.col("host")).alias("s"))
    assert [r.s for r in sites.collect()] == ["x.com", "x.com", "[::1]", ""]


def test_beta_quantile(spark):
    """Against the posterior integrated numerically."""
    cases = [(a, b) for a in (0.6, 2.0, 9.5, 60.0, 900.0) for b in (0.7, 2.5, 19.0, 400.0)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", urls.beta_quantile(F.col("a"), F.col("b")).alias("q")).collect()
    x = (np.arange(400_000) + 0.5) / 400_000
    for r in got:
        dense = (r.a - 1) * np.log(x) + (r.b - 1) * np.log1p(-x)
        mass = np.exp(dense - dense.max()).cumsum()
        exact = x[np.searchsorted(mass, 0.1 * mass[-1])]
        assert r.q == pytest.approx(exact, abs=0.02), (r.a, r.b, exact)


def test_many_rules(spark):
    """Joined by suffixes, rules give what they give as conditions."""
    rules = list(urls.RULES) + [("block", f"h{i}.example.com/p/") for i in range(30)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://h3.example.com/p/x", "http://a.h3.example.com/p/", "http://h3.example.com/q", "http://www.example.com/en/", "x", None, "http://a.net/fr/", "http://h3.example.com/p/x"])], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = sorted(map(tuple, urls.judge_urls(pages, labels, rules).collect()))
    many = sorted(map(tuple, urls.judge_urls(pages, labels, rules + [("block", f"none{i}.org/") for i in range(2000)]).collect()))
    assert few == many and few[0][3] == "h3.example.com/p/"


def http(body, kind="text/html", extra=""):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n{extra}\r\n".encode() + body


def test_warc_derivatives(spark, tmp_path):
    responses = [
        ("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", http(b"<p>Caf\xc3\xa9</p><nav>Menu</nav>")),
        ("<urn:uuid:2>", "http://b/", None, http(gzip.compress("plain é".encode("latin-1")), "text/plain; charset=latin-1", "Content-Encoding: gzip\r\n")),
        ("<urn:uuid:3>", None, None, http(b"\x89PNG", "image/png")), ("<urn:uuid:4>", "x", None, None), (None, None, None, b"no http"),
        ("<urn:uuid:5>", "c", None, http(b"4\r\nWiki\r\n3\r\npe!\r\n0\r\n\r\n", "text/plain", "Transfer-Encoding: chunked\r\n")),
    ]
    table = spark.createDataFrame([(*r, 1) for r in responses], "record_id string, target_uri string, date string, block binary, block_digest int")
    records = warc.derivatives(table)
    got = records.collect()
    assert sum(r.warc_type == "metadata" for r in got) == 6
    text = {r.refers_to: r.block for r in got if r.warc_type == "conversion"}
    assert text == {"<urn:uuid:1>": "Café\nMenu", "<urn:uuid:2>": "plain é", "<urn:uuid:5>": "Wikipe!"}
    first = next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.warc_type == "metadata")
    assert first.source_headers["content-type"] == "text/html" and first.source_status == 200 and first.source_payload_digest == warc.digest(b"<p>Caf\xc3\xa9</p><nav>Menu</nav>")
    assert all(warc.digest(r.block.encode()) == r.block_digest and r.content_length == len(r.block.encode()) for r in got)
    again = warc.derivatives(table).collect()
    assert {r.record_id for r in again} == {r.record_id for r in got} and len({r.record_id for r in got}) == len(got)
    warc.write_warc(records, str(tmp_path / "out"))
    back = {r.record_id: r for r in warc.read_warc(spark, f"{tmp_path}/out/*.gz").collect()}
    assert {k: bytes(r.block).decode() for k, r in back.items()} == {r.record_id: r.block for r in got}
    assert all(back[r.record_id].refers_to == r.refers_to and back[r.record_id].warc_type == r.warc_type for r in got)
    assert warc.derivatives(table.limit(0)).count() == 0


def test_warc_of_broken_responses():
    record = lambda block: list(warc.derivatives_of("<r>", "u", None, block))
    for head in (b"HTTP/1.1 \xc2\xb200 OK\r\n", b"HTTP/1.1\r\n", b"HTTP/1.1 99999999 OK\r\n", b"HTTP/1.1 \xd9\xa3\r\n"):
        assert record(head + b"Content-Type: text/html\r\n\r\n<![foo]>x")[0][9] is None
    assert [r[1] for r in record(http(b"<![ x", "text/html"))] == ["metadata", "conversion"]
    bomb = gzip.compress(b"a" * 5_000_000)
    assert warc.decoded(bomb, {"content-encoding": "gzip"}, most=1_000_000) is None and len(warc.decoded(bomb, {"content-encoding": "gzip"}, most=5_000_000)) == 5_000_000
    assert warc.decoded(bomb[:1000], {"content-encoding": "gzip"}).startswith("aaa") and warc.decoded(b"no gzip", {"content-encoding": "gzip"}) == "no gzip"


def test_content_encodings():
    import zlib

    text = b"plain text, " * 50
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(text) + raw.flush()
    many = gzip.compress(text) + gzip.compress(b"and more")
    cases = {
        ("br", text): None, ("gzip, br", gzip.compress(text)): None, ("zstd", text): None, ("", text): text, ("identity", text): text, ("gzip, identity", gzip.compress(text)): text,
        ("deflate", zlib.compress(text)): text, ("deflate", raw): text, ("deflate", text): text, ("deflate", b"\xff\xfe\xfd\xfc"): None, ("x-gzip", many): text + b"and more",
        ("deflate, gzip", gzip.compress(zlib.compress(text))): text, ("gzip", gzip.compress(text) + b"\0\0"): text, ("gzip", b"\x1f\x8bno"): None, ("gzip", b""): b"",
    }
    for (encoding, payload), want in cases.items():
        assert warc.decoded(payload, {"content-encoding": encoding}) == (want if want is None else want.decode()), encoding
    assert len(list(warc.derivatives_of("r", "u", None, http(text, "text/plain", "Content-Encoding: br\r\n")))) == 1
    assert warc.decoded(many, {"content-encoding": "gzip"}, most=len(text) + 7) is None


def warc_record(i, block, length=None):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %s\r\n\r\n" % (i, str(len(block) if length is None else length).encode()) + block + b"\r\n\r\n"


def test_read_warc_of_broken_files(spark, tmp_path):
    blocks = [b"one\r\n\r\ntwo\n", b"", b"\xff\xfe\x00 \r\n\r\nWARC/1.0\r\nWARC-Type: inner\r\n\r\nx", b"caf\xe9" * 1000]
    whole = b"".join(warc_record(i, x) for i, x in enumerate(blocks))
    files = {
        "plain.warc": whole, "whole.warc.gz": gzip.compress(whole), "each.warc.gz": b"".join(gzip.compress(warc_record(i, x)) for i, x in enumerate(blocks)),
        "length.warc": warc_record(0, b"a", "abc") + warc_record(1, b"b", "\u00b2") + warc_record(2, b"c", -5), "empty.warc": b"", "other.warc": b"no warc",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = lambda name: {r.record_id: bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / name)).collect()}
    want = {f"<{i}>": x for i, x in enumerate(blocks)}
    assert read("plain.warc") == read("whole.warc.gz") == read("each.warc.gz") == want
    assert {k: v.strip() for k, v in read("length.warc").items()} == {"<0>": b"a", "<1>": b"b", "<2>": b"c"} and read("empty.warc") == {} == read("other.warc")
    (tmp_path / "cut.warc.gz").write_bytes(files["each.warc.gz"][:-20])
    assert {k: v for k, v in want.items() if k != "<3>"}.items() <= read("cut.warc.gz").items()
    assert len(warc.read_warc(spark, str(tmp_path / "*.gz")).collect()) >= 11


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(None, 1), (5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(up)} and len(got) == len(up)


def clusters(seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([c + 0.15 * rng.normal(size=(k, 32)) for c, k in zip(centres, rng.integers(1, 60, 30))])
    return np.concatenate([x, rng.normal(size=(400, 32)), x[:5]]).astype(np.float32)


def test_graph_recall():
    x = clusters()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, nodes, _ = Graph.build(x, 1).audited(x, 0.9, 16, 0.995, 16)
    exact = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9))}
    assert len(exact & set(zip(rows.tolist(), nodes.tolist()))) >= 0.99 * len(exact)


def test_a_lost_link_widens_no_beam():
    """A node that no search reaches is found by a scan of the queries at hand; those to come keep their beam."""
    x = np.random.default_rng(4).standard_normal((700, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph.build(x, 1)
    lost = int(np.flatnonzero(graph.levels == 0)[0])
    for layer in graph.layers:
        layer[layer == lost] = -1
    rows, nodes, beam = graph.audited(x[[lost] * 20], 0.999, 16, 0.995, 16)
    assert beam == 16 and sorted(rows) == list(range(20)) and set(nodes) == {lost}


def test_near_vectors(spark):
    x = clusters()
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000 + i, v, 0) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int"), shards=3).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (least == label).all():
            break
        label = least
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    found = sum(by_id[i].n_links for i in range(len(x)))
    assert 0.99 * near.sum() <= found <= near.sum()
    assert sum(by_id[i].component_id == label[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(by_id[5000 + i].n_links == 0 for i in range(5)) and by_id[5005].n_links == 1 == by_id[5006].n_links and by_id[5006].component_id == 5005
    assert by_id[None].n_links == 0 and by_id[None].kept
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_of_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.1]), (3, [0.01, 1.0, 0.1]), (4, [0.0, 0.0, -1.0]), (4, [0.0, 0.0, -1.0]), (5, [-1.0, 0.0, 0.0]), (None, a)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shards=2).collect()
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 0, 5), (None, 0, None)]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_near_vectors_of_large_shards(spark):
    """Two shards of over 5,000 vectors each: links and components against all pairs, in double precision."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(900, 32))
    x = np.concatenate([c + rng.choice([0.1, 0.2, 0.3]) * rng.normal(size=(k, 32)) for c, k in zip(centres, rng.integers(1, 12, 900))] + [rng.normal(size=(6000, 32))]).astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), shards=2).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.zeros(len(x), np.int64)
    label = np.arange(len(x))
    pairs = np.concatenate([np.argwhere(unit[lo : lo + 1000] @ unit.T >= 0.9) + [lo, 0] for lo in range(0, len(x), 1000)])
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    np.add.at(links, pairs[:, 0], 1)
    while True:
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        if (least == label).all():
            break
        label = least
    found = np.array([got[i].n_links for i in range(len(x))])
    assert len(x) > 10_500 and links.sum() > 10_000
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.995


def test_pipeline(spark, sf_dir):
    """Each stage on what the one before kept: columns, and its promise."""
    from glossa.llm import decontam, minhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench, scratch, sizes = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark), [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "MinHash near-dedup":
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if name == "benchmark decontamination":
            assert decontam.contamination(docs, bench).where("contaminated").count() == 0
            ids = docs.select("doc_id").distinct().count()
    assert sizes[1] > 0.6 * sizes[0] and docs.select("doc_id").distinct().count() == ids
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
