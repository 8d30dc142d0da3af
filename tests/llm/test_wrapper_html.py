import html
import json
import re

import __spark_entry__ as E
from tessera.llm import wrapper_html as W
from tessera.llm.dom import blocks, parse


def article(page):
    """Blocks of the one article element of the generated pages, by patterns."""
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", body)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in parts]
    return "\n".join(x for x in texts if x)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = E.queries()["op10_wrapper_html"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark, odd):
    rows = E.queries()["op10_wrapper_html"](spark, odd).collect()
    text = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == 11
    assert text[0] == text[1] == text[3] == text[7] == ""
    assert text[2] == "no markup at all"
    assert text[4] == "one\ntwo & three & <four> five"
    assert text[6] == "deep"
    assert text[8] == "quote\nbcd"


SITE = """<html><head><title>t</title></head><body><div id="top"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></div>
<div class="cookie-notice">We use cookies {n}</div><div id="wrap"><div class="sidebar"><p>Most read {n}</p></div>
<div class="story"><h2>Title {n}</h2><p>{body}</p><ul><li>point a{n}</li><li>point b{n}</li></ul><p>Share this page</p></div>
<div class="comments"><p>reader {n} says: {body}</p></div></div><form><p>Your mail</p></form><div class="bottom">All rights kept.</div></body></html>"""


def test_template_is_learned_without_an_article_element():
    pages = [SITE.format(n=n, body=f"Sentence {n} of the story, long enough to be the main text of the page. " * 4) for n in range(6)]
    wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
    assert wrapper["root"].endswith("div.story")
    for n, p in enumerate(pages):
        text = W.extract(p, wrapper)
        assert text.startswith(f"Title {n}\nSentence {n}") and f"point a{n}\npoint b{n}" in text
        assert "cookies" not in text and "Most read" not in text and "reader" not in text and "mail" not in text
        assert "All rights" not in text and "Home" not in text


def test_copies_do_not_make_content_template():
    page = "<body><div>menu</div><article><p>The same article twice.</p></article></body>"
    wrapper = W.induce([W.skeleton(parse(page)) for _ in range(6)])
    assert wrapper["constants"] == {} and W.extract(page, wrapper) == "The same article twice."


def test_tree_matching_counts_aligned_nodes():
    a = W.skeleton(parse("<div><h1>x</h1><p>y</p><section><p>z</p></section></div>"))
    b = W.skeleton(parse("<div><p>y</p><table></table><section><p>q</p></section></div>"))
    assert W.tree_match(a, b)[0] == 5         # top, div, p, section, its p


def test_blocks_and_references():
    top = parse("<div>a <b>b</b>\n\n c<p>d&nbsp;&eacute; &#8364;<ul><li>e<li>f</ul>g</div><script>if (a<b) {}</script>")
    assert blocks(top, lambda n: False) == ["a b c", "d é €", "e", "f", "g"]


def test_all_elements_at_the_root_path_are_kept():
    page = "<body><article><p>First {n}.</p></article><article><p>Second one {n}, longer.</p></article><article>Third {n}</article></body>"
    pages = [page.format(n=n) for n in "abcd"]
    wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
    assert [W.extract(p, wrapper) for p in pages] == [f"First {n}.\nSecond one {n}, longer.\nThird {n}" for n in "abcd"]
    page = "<body><div class=content>" + "".join(f"<div class=section><p>part {i} {{n}}</p></div>" for i in range(4)) + "</div></body>"
    pages = [page.format(n=n) for n in "abcd"]
    wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
    for n, p in zip("abcd", pages):
        assert W.extract(p, wrapper) == W.extract(p) == "\n".join(f"part {i} {n}" for i in range(4))


def test_no_varying_text_is_left_beside_the_root():
    long = "".join(f"<li>a long point {i} of {{n}}</li>" for i in range(20))
    for page, first, last in [
            ("<body><div class=content><p>intro {n}</p><ul>" + long + "</ul><p>end {n}</p></div></body>", "intro {n}", "end {n}"),
            ("<body><main><h1>head {n}</h1><article><ul>" + long + "</ul></article><p>second half {n}</p></main></body>",
             "head {n}", "second half {n}"),
            ("<body><article class=x><p>one {n}</p></article><main><ul>" + long + "</ul><p>end {n}</p></main></body>", "one {n}", "end {n}")]:
        pages = [page.format(n=n) for n in "abcd"]
        wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
        for n, p in zip("abcd", pages):
            want = [first.format(n=n), *(f"a long point {i} of {n}" for i in range(20)), last.format(n=n)]
            assert W.extract(p, wrapper).split("\n") == W.extract(p).split("\n") == want


def test_constant_siblings_are_template():
    pages = [SITE.format(n=n, body=f"Sentence {n} of the story, long enough to be the main text of the page. " * 4).replace(
        "<p>Share", "<ul><li>Print</li><li>Send<br>on</li></ul><p>Share") for n in range(6)]
    wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
    for n, p in enumerate(pages):
        text = W.extract(p, wrapper).split("\n")
        assert len(text) == 4 and text[0] == f"Title {n}" and text[2:] == [f"point a{n}", f"point b{n}"]


def test_constants_come_from_all_pages(spark):
    def page(n, lead):
        body = "".join(f"<p>Sentence {i} on subject {n}.</p>" for i in range(4))
        return f"<body><div class=story><h2>Title {n}</h2><h3>{lead}</h3>{body}<p>Share this page</p></div></body>"

    def other(n):
        return f"<body><div class=gallery><p>Picture {n}</p><p>Click to enlarge</p></div></body>"

    copy = page("copy", "Copied")
    html = [page(n, "By chance" if n else "Once") for n in range(60)] + [copy] * 200 + [other(n) for n in range(8)]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    text = {r["page_id"]: r["text"].split("\n") for r in W.extract_pages(pages.repartition(7)).collect()}
    for i, h in enumerate(html):
        want = [x for x in blocks(parse(h), lambda n: False) if x not in ("Share this page", "Click to enlarge")]
        assert text[i] == want, i


def framed(rows):
    return "page_id long, url string, html string", [(i, f"http://a.example/{i}", h) for i, h in enumerate(rows)]


def test_roots_come_from_all_pages(spark):
    def page(n, annex=""):
        links = "".join(f'<li><a href="/{n}{i}">Read {n} {i}</a></li>' for i in range(3))
        return (f'<body><div class="side"><ul>{links}</ul></div><div class="story"><h2>Title {n}</h2><p>Text of {n}, whole.</p></div>'
                f"{annex}<div class=legal>Imprint</div></body>")

    # two of many pages have a second part, in a layout of their own; one page is of another make
    html = [page(n) for n in range(120)] + [page(n, f"<div class=annex><p>Annex of {n}, a text too.</p></div>") for n in (120, 121)]
    html.append("<body><p>No page 122 here.</p></body>")
    schema, rows = framed(html)
    for parts in (1, 7):
        text = {r["page_id"]: r["text"] for r in W.extract_pages(spark.createDataFrame(rows, schema).repartition(parts)).collect()}
        for n in range(120):
            assert text[n] == f"Title {n}\nText of {n}, whole.", n
        for n in (120, 121):
            assert f"Title {n}\nText of {n}, whole.\nAnnex of {n}, a text too." in text[n]
        assert text[122] == "No page 122 here."


def test_host_roots_equal_those_of_all_pages_aligned_at_once(spark):
    import numpy as np
    rng = np.random.default_rng(3)

    def block(n, i):
        """Varying text, links or a constant, in a place that some pages lack."""
        kinds = [f"<p>Text {i} of {n}.</p>", f'<p><a href="/">Read {i} of {n}</a></p>', "<p>Always this</p>"]
        inner = kinds[int(rng.choice(3, p=[[.9, .1, 0], [.1, .9, 0], [0, 0, 1]][i % 3]))]
        return f"<div class=part{'abcdefgh'[i]}><div class=inner>{inner}</div></div>" if rng.random() < 0.7 else ""

    for core in ("div", "article"):
        pages = [f"<body><div id=a>{''.join(block(n, i) for i in range(3))}</div><{core} id=b>{''.join(block(n, i) for i in range(3, 8))}</{core}></body>"
                 for n in range(80)]
        found = W.induce_wrappers(spark.createDataFrame(framed(pages)[1], framed(pages)[0]).repartition(5)).collect()
        wrapper = json.loads(found[0]["wrapper"])
        want = W.induce([W.skeleton(parse(p)) for p in pages], wrapper["constants"])
        assert len(found) == 1 and len(wrapper["layouts"]) == 1
        for paths in wrapper["layouts"].values():
            assert set(paths) == {want["root"], *want["also"]}


def test_shapes_keep_the_tree():
    tree = W.skeleton(parse(SITE.format(n=1, body="Text.")))
    shape, texts = W.flat(tree)
    nodes = W.shaped(shape)
    assert W.flat(nodes[0])[0] == shape and len(nodes) == shape.count("\n") + 1 and nodes[0].tag == "html"
    assert {m for _, m, _, _ in texts} == W.marks(tree)


def test_text_inside_a_form_is_kept():
    text = "<p>A paragraph of {n}, long enough.</p><p>Another one of {n}.</p>"
    controls = "<label>Your name</label><select><option>x</select><button>Send</button>"
    for page in (f"<body><form><main>{text}</main>{controls}</form></body>", f"<body><form><div>{text}</div>{controls}</form></body>",
                 f"<body><form id=a><p>A paragraph of {{n}}, long enough.</p></form><form id=b><p>Another one of {{n}}.</p>{controls}</form></body>",
                 f"<body><object><article>{text}</article></object></body>",
                 f"<body>{text}<form><p>Mail</p>{controls}</form></body>"):
        pages = [page.format(n=n) for n in "abcd"]
        wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
        for n, p in zip("abcd", pages):
            assert W.extract(p, wrapper) == W.extract(p) == f"A paragraph of {n}, long enough.\nAnother one of {n}."


THREE = "<p>The first sentence of {n} is here.</p><p>A second one of {n} follows.</p><p>And {n} ends with a third.</p>"


def body_of(n):
    return "\n".join(x.format(n=n) for x in ("The first sentence of {n} is here.", "A second one of {n} follows.", "And {n} ends with a third."))


def both_ways(page):
    """(n, text of the page alone, text under its host's wrapper)."""
    pages = [page.format(n=n) for n in "abcd"]
    wrapper = W.induce([W.skeleton(parse(p)) for p in pages])
    return [(n, W.extract(p), W.extract(p, wrapper)) for n, p in zip("abcd", pages)]


def test_names_of_containers_do_not_drop_the_article():
    for open_tag, close in (('<div class="post with-sidebar">', "</div>"), ('<div class="content no-comments">', "</div>"),
                            ('<div id="ad-free">', "</div>"), ('<div class="page has-sidebar"><div id="content">', "</div></div>"),
                            ('<div class="search-result-page">', "</div>"), ('<div class="layout hasHeader">', "</div>"),
                            ('<div class="related">', "</div>"), ('<div id="widget">', "</div>"), ('<div class="site-sidebar">', "</div>")):
        menu = '<div class="nav"><a href="/">Home</a> <a href="/n">News</a></div><div class="comments-area"><p>Me {n}!</p></div>'
        for page in (f"<body>{open_tag}{THREE}{close}</body>", f"<body>{menu}{open_tag}{THREE}{close}<footer>All rights</footer></body>"):
            for n, alone, hosted in both_ways(page):
                assert alone == hosted == body_of(n), (open_tag, page)


def test_a_named_part_that_is_the_article_is_kept():
    for n, alone, hosted in both_ways('<body><article><h1>T{n}</h1><div class="related">article body of {n}</div></article></body>'):
        assert alone == hosted == f"T{n}\narticle body of {n}"
    page = f'<body><section><header><h2>Title {{n}}</h2></header>{THREE}</section><div class="sidebar-left"><p>Most read {{n}}</p></div></body>'
    for n, alone, hosted in both_ways(page):
        assert alone == hosted == f"Title {n}\n{body_of(n)}"


def site(rng, kind):
    """A generated site without article and main elements: pages as (html, main text)."""
    main = ["story", "post with-sidebar", "entry no-comments", "page has-nav", "text"][kind % 5]
    pages = []
    for n in range(7):
        words = [f"w{rng.integers(1000)}" for _ in range(60)]
        parts = [" ".join(words[i:i + 12]) + f" {n}." for i in range(0, 60, 12)]
        blocks_ = [f"Title {n}", *parts]
        inner = f"<h1>{blocks_[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[:3]) + "<ul>" + "".join(f"<li>{p}</li>" for p in parts[3:]) + "</ul>"
        around = [f'<div class="side-{kind}"><ul><li><a href="/{n}">Read {n}</a></li><li><a href="/x">Old {n}</a></li></ul></div>',
                  f'<div class="comment-list"><p>Reader {rng.integers(1000)} says so.</p></div>',
                  '<div class="legal">Imprint and terms of this site</div>', f'<div class="share-buttons"><a href="#">Send {n}</a></div>']
        cut = int(rng.integers(0, 5))
        page = "".join(around[:cut]) + f'<div class="{main}">{inner}</div>' + "".join(around[cut:])
        pages.append((f"<html><body><nav>Start</nav>{page}</body></html>", "\n".join(blocks_)))
    return pages


def test_generated_sites_without_article_elements(spark):
    import numpy as np
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for kind in range(10):
        for html_, text in site(rng, kind):
            want[len(rows)] = text
            rows.append((len(rows), f"http://s{kind}.example/{len(rows)}", html_))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in W.extract_pages(df).collect()}
    assert got == want


def test_deeply_nested_names_end_soon():
    import time
    start = time.time()
    assert W.extract('<div class="sidebar">' * 20000 + "deep") == "deep" and time.time() - start < 5
