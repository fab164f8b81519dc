import random

from shardmend.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><!-- <p>gone</p> --><div class=ad>Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold
 text</b>&nbsp;here<br>next<p>Second &lt;p&gt; &#233;&#x2014;x<div class="ad">Buy more</div>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><p>Your mail<input></form><noscript>no</noscript>
<blockquote>{quote}</blockquote><aside>Related</aside><section id="comments"><p>Reader</p></section><footer>tags</footer></article>
<section class="comments"><article class="comment"><p>{long}</p></article></section><footer>foot</footer></body></html>"""

WANT = "Head & line\n\nFirst bold text here next\n\nSecond <p> é—x\n\none\n\ntwo\n\na\n\nb\n\n{quote}"


def test_article():
    assert htmltext.main_text(PAGE.format(quote="Quoted", long="comment " * 500)) == WANT.format(quote="Quoted")


def test_odd_pages():
    for page, want in (
        (None, ""),
        ("", ""),
        ("plain text & more", "plain text & more"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article>a<!-- open", "a"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ("<main><p>m</p></main><p>out", "m"),
        ("<script>x", ""),
        ("<article><p title='>'>q</p></article>", "q"),
        ("<ARTICLE><P>up</P></ARTICLE>", "up"),
        ("<article></article><div class=content><p>x</div>", "x"),
        ("<article><p hidden>h</p><p style='display:none'>n</p><p>s</p></article>", "s"),
        ("<article><p>a</article><article class=comment><p>a much longer comment</article>", "a"),
        ("<article><p>one</div></p><p>two</article>", "one\n\ntwo"),
    ):
        assert htmltext.main_text(page) == want, page


def test_long_page_is_linear():
    assert len(htmltext.main_text("<article>" + "<p>word</p>" * 40_000 + "</article>")) == 40_000 * 6 - 2
    htmltext.main_text("<" * 100_000)
    htmltext.main_text("<a " + "x='" * 30_000)


def test_template_of_a_host_without_article_elements(spark):
    """The content slot is the class that holds varying text; constant slots are the template's."""
    page = "<html><body><div class=top>Welcome to the site</div><div id=z1><p>{}</p></div><div class=bottom>All rights</div></body></html>"
    rows = [(k, f"https://h.example.com/{k}", page.format(f"varying words number {k}"), "x") for k in range(12)]
    rows += [(100, "https://other.example.com/", PAGE.format(quote="q", long="l"), "x"), (101, None, None, "x"), (None, "odd", "<p>z", "x"), (3, "https://h.example.com/3", page.format("varying words number 3"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = htmltext.extracted(pages)
    assert out.columns == ["page_id", "url", "html", "text", "_text"]
    got = sorted(((r.page_id, r._text) for r in out.collect()), key=repr)
    want = [(k, f"varying words number {k}") for k in (*range(12), 3)] + [(100, WANT.format(quote="q")), (101, ""), (None, "z")]
    assert got == sorted(want, key=repr)
    [t] = [htmltext.Template(r.template) for r in htmltext.templates(pages).where("host = 'h.example.com'").collect()]
    assert any(len(c) >= 4 for c in t.classes.values()) and t.parent["html>body>div.z0"] == "html>body"
    assert htmltext.extracted(pages.limit(0)).count() == 0


def test_slot_by_varying_text(spark):
    """Without names, the innermost slot that holds the varying text is the content; short varying slots beside it are not."""
    page = "<html><body><div class=x1>Welcome</div><div class=x2><div class=x3><p>{}</p></div></div><div class=x4>Seen {} times</div></body></html>"
    rows = [(k, f"https://h.example.com/{k}", page.format(f"varying words number {k} " * 20, k)) for k in range(12)]
    rows.append((50, "https://h.example.com/odd", "<html><body><div class=y><p>of another make</p></div></body></html>"))
    got = {r.page_id: r.text for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: " ".join(f"varying words number {k} ".split() * 20) for k in range(12)} | {50: "of another make"}


def test_copies_keep_their_text(spark):
    """Equal pages say nothing about what is constant, and the root's own path is never a constant slot."""
    boxed, bare = "<html><body><div class=content><p>the text</p></div></body></html>", "<html><body><p>bare text</body></html>"
    moved = "<html><body><div class=x9>Seen {} times</div><div class=content><p>the same text</p></div></body></html>"
    rows = [(k, f"https://{host}.example.com/{k}", page.format(k)) for host, page in (("a", boxed), ("b", bare), ("c", moved)) for k in range(6)]
    got = {(r.url[8], r.text) for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {("a", "the text"), ("b", "bare text"), ("c", "the same text")}


NAMELESS = '<html><body><div class="m{m}"><ul><li>{a}<li>{b}</ul></div><div class="q">{ad}</div><div class="k"><h1>{head}</h1>{paragraphs}</div><div class="z">(c) {host} {foot}</div></body></html>'


def nameless(n=60, hosts=4, seed=3):
    """Pages without article elements or telling names, and their articles by brute force: the text of the element k."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for k in range(n):
        host = f"h{k % hosts}.example.com"
        parts = [words(rng.randint(3, 80)) for _ in range(rng.randint(1, 6))]
        head = words(4)
        page = NAMELESS.format(m=k, a=words(1), b=words(1), ad=words(6), head=head, paragraphs="".join(f"<p>{p}" for p in parts), host=host, foot=words(3))
        rows.append((k, f"https://{host}/{k}", page))
        want[k] = "\n\n".join([head, *parts])
    return rows, want


def test_the_template_decides(spark):
    """The content is found by equivalence classes alone; without them the same pages are taken whole."""
    rows, want = nameless()
    out = htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host_", "'y' AS host", "'z' AS template"))
    assert out.columns == ["page_id", "url", "html", "host_", "host", "template", "text"]
    assert {r.page_id: r.text for r in out.collect()} == want
    assert all(htmltext.main_text(h) != want[k] and want[k] in htmltext.main_text(h) for k, _, h in rows)


def test_classes_against_brute_force(spark):
    """Equal occurrence vectors, support and single occurrence of every token, counted page by page."""
    rows, _ = nameless(24, 2)
    rows += [(100 + k, "https://h0.example.com/x", '<html><body><div class="w"><table><tr><td>t</table><table></table></div></body></html>') for k in range(3)]
    got = {r.host: htmltext.Template(r.template) for r in htmltext.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in ("h0.example.com", "h1.example.com"):
        vectors = {}
        mine = [h for _, u, h in rows if host in u]
        for n, h in enumerate(mine):
            for token, times, *_ in htmltext.tokens(h):
                vectors.setdefault(token, {})[n] = times
        valid = {t: v for t, v in vectors.items() if len(v) > 1 and len(v) >= htmltext.SUPPORT * len(mine) and sum(x == 1 for x in v.values()) >= 0.9 * len(v)}
        want = {}
        for t, v in valid.items():
            want.setdefault(tuple(sorted(v.items())), set()).add(t)
        assert {frozenset(c) for c in got[host].classes.values()} == {frozenset(c) for c in want.values()}
        assert all(p == max((x for x in valid if x == "" or t.startswith(x + ">")), key=len) for t, p in got[host].parent.items() if t)


def test_only_what_is_marked_goes():
    page = "<article><p>a</p><div class='related-work'><p>b</p></div><section class='banner-history'><p>c</p></section><p class=overlay-text>d</p><math>x+1</math><div class=related><p>no</p></div><div class='site-nav'>no</div></article>"
    assert htmltext.main_text(page) == "a\n\nb\n\nc\n\nd\n\nx+1"


def test_deep_pages_are_told_apart():
    deep = "".join(f"<div class=level-name-{'abcdefghij'[k % 10] * 9}>" for k in range(300))
    found = [t[0] for t in htmltext.tokens(f"<body>{deep}<div class=one>x</div><div class=two>y</div>")]
    assert len(found) == len(set(found)) == 304 and max(map(len, found)) <= 2 * htmltext.PATH_CHARS
