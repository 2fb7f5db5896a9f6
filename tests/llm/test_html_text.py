import itertools
import random

import pytest

from framelake.llm import html_text
from framelake.llm.html_text import deleted_lines, extract_main_text, page_blocks, shared_lines

SCHEMA = "page_id long, url string, html string"


def lines_of(source):
    blocks = page_blocks(source)
    return [t for t, _, _ in blocks], [root + 2 * bad for _, root, bad in blocks]


def text(source, *neighbours):
    texts, flags = lines_of(source)
    return html_text.main_text(texts, flags, deleted_lines(texts, flags, [lines_of(n)[0] for n in neighbours]))


def test_article_without_furniture():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><script>var t="</p><article>";</script>
    <header>Site</header><nav><ul><li>Home</li></ul></nav><!-- <p>no</p> --><div id="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B&#33;</h1><p>One
      two\tthree<p>Four <b>fi<i>ve</b>six<div class="ad-slot"><p>Buy</p></div><table><tr><td>1<td>2</tr></table>
      <form><input value="x">Sign</form><aside>See also</aside><p title="a > b">5 &lt; 6 < 7</p><div class="comments"><article>Nice!</article></div></article>
    <div class="sidebar">Side</div><footer>&copy; 2020</footer>"""
    assert text(source) == "A & B!\nOne two three\nFour fivesix\n1 2\n5 < 6 < 7"


def test_broken_markup():
    assert text(None) == "" and text("") == ""
    assert text("<article><p>x<script>if (a</b) {") == "x"
    assert text("<p>a</p><!-- never closed <p>b") == "a"
    assert text("<main><p>cut off<a href='") == "cut off"
    assert text("plain & simple &bogus; &#x41;") == "plain & simple &bogus; A"


def test_no_text_is_lost():
    assert text("<p>a<svg class=x /><p>b<svg><p>no</p></svg>c") == "a\nb\nc"  # the first has no end tag
    assert text("<p title=it's>a</p><p>b's</p>") == "a\nb's"
    assert text("<p title = \"a > b\" x='c > d'>a</p><a href=x?a=b&c='d'>b</a>") == "a\nb"
    assert text("<article><section id='comments-on-method'><h2 id='discussion'>D</h2>a</section><div class='related-work'>b</div><p id=notice>c</article>") == "D\na\nb\nc"
    assert text("<article>a<section class='comments'>no</section><div id='sidebar-left'>no</div><div class='related posts'>no</div></article>") == "a"
    assert text("<body><form id=aspnetForm><nav>no</nav><div><p>a<form>no</form></div><main>b</main></form><form><p>no</form>") == "a\nb"
    assert text("<fieldset><legend>a</legend><label>b</label></fieldset><math><mi>x</mi><mo>=</mo>1</math><xmp><b>&amp;</b></xmp>") == "a\nb\nx=1\n<b>&amp;</b>"


def test_differencing_by_nearest_url():
    page = "<body><div>Menu</div><div>Ad {0}</div><p>Own text {0}</p><p>More {0}</p><div>All rights</div>"
    assert text(page.format(1), page.format(2)) == "Ad 1\nOwn text 1\nMore 1"
    assert text(page.format(1), page.format(1)) == "Menu\nAd 1\nOwn text 1\nMore 1\nAll rights"
    assert text(page.format(1), page.format(1), page.format(2)) == "Ad 1\nOwn text 1\nMore 1"
    short = "<div>a{0}</div>" + "".join(f"<div>m{k}</div>" for k in range(40))
    assert text(short.format(1), short.format(2)) == "a1"
    assert text("<div>Menu</div><article>Menu</article><div>Own</div>", "<div>Menu</div><p>Menu</p>") == "Menu\nOwn"


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if all(x in it for it in [iter(b)] for x in c))
        found = shared_lines(a, b)
        it = iter(b)
        assert len(found) == best and all(a[k] in it for k in sorted(found))


def test_many_equal_lines():
    a, b = ["x", "y"] * 5000 + ["a"], ["z"] + ["x"] * 9000
    assert len(shared_lines(a, b)) == 5000


def site(seed):
    """Pages with templates by host and section, some without article, copies, and one host with a third of all."""
    rng = random.Random(seed)
    rows, k = [], 0
    for host in ["hot.example"] * 60 + [f"h{n}.example" for n in range(30) for _ in range(4)]:
        section = rng.choice("abc")
        body = "".join(f"<p>line {rng.randrange(60)} of {host}</p>" for _ in range(rng.randrange(4)))
        root = ("<article>", "</article>") if k % 5 == 0 else ("", "")
        rows.append((k, f"https://{host}/{section}/{rng.randrange(40)}", f"<div>Menu {section}</div><div>Top {host}</div>{root[0]}<p>Own {k}</p>{body}{root[1]}<div>Rights</div>"))
        k += 1
    rows += [(k + n, f"https://hot.example/copy/{n}", rows[7][2]) for n in range(50)]
    rows += [(500, None, "<p>x</p>"), (501, None, None), (502, "no url", "<p>y"), (503, "//Hot.example/a/1", ""), (503, "//hot.example/a/1", ""), (None, "https://h1.example/a", "<p>z")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    """Each page against the neighbours among its host's different pages."""
    pages = []
    for page_id, url, source in rows:
        url_ = url or ""
        host, path = "", ""
        if "//" in url_:
            host, _, path = url_.split("//", 1)[1].partition("/")
            host, path = host.lower(), "/" + path if path else ""
        texts, flags = lines_of(source)
        pages.append((page_id, url, host, path, texts, flags))
    hosts = {}
    for page_id, _, host, path, texts, flags in pages:
        own = hosts.setdefault(host, {})
        key = tuple(texts), tuple(flags)
        place = (path, page_id is not None, page_id or 0)
        own[key] = min(place, own.get(key, place))
    out = []
    for page_id, url, host, path, texts, flags in pages:
        order = sorted(hosts[host].items(), key=lambda r: r[1])
        at = [key for key, _ in order].index((tuple(texts), tuple(flags)))
        mine = order[at][1][0]
        near = [] if not host else sorted((-html_text._common(mine, order[n][1][0]), n, list(order[n][0][0])) for n in (at - 1, at + 1) if 0 <= n < len(order))
        found = html_text.main_text(texts, flags, deleted_lines(texts, flags, [n[2] for n in near]))
        out.append((page_id, url, found, len(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", (1, 7, 200))
def test_against_brute_force_however_dealt_out(spark, monkeypatch, parts):
    monkeypatch.setattr(html_text, "HOT", 20)
    monkeypatch.setattr(html_text, "SEGMENT", 16)
    rows = site(4)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts if parts < 200 else 40)
    spark.conf.set("spark.sql.adaptive.enabled", str(parts == 1).lower())
    try:
        frame = spark.createDataFrame([(*r, "host", 1, 2) for r in rows], SCHEMA + ", host string, path int, run int").repartition(parts)
        out = extract_main_text(frame)
        assert out.columns == ["page_id", "url", "text", "n_chars"]
        got = sorted(map(tuple, out.collect()), key=repr)
    finally:
        for key, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before):
            spark.conf.set(key, value)
    assert got == brute(rows)
    hot = [r[2] for r in got if "//hot.example" in (r[1] or "")]
    assert sum("Top hot.example" in t for t in hot) < len(hot) / 10


def test_very_long_page_and_no_pages(spark):
    long = "<div>Menu</div>" + "<p>word</p>" * 50_000 + "x" * 1_000_000
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame([(1, "http://a/1", long), (2, "http://a/2", "<div>Menu</div><p>b")], SCHEMA)).collect()}
    assert got[2] == "b" and got[1] == "word\n" * 50_000 + "x" * 1_000_000
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []
