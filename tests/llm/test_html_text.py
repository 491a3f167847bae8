import html
import re
import time

from spanloom.llm import html_pages, queries
from spanloom.llm import html_text as h


def test_blocks():
    texts = lambda page: [b.text for b in h.leaf_blocks(page)]
    assert texts("<p>a <b>b</b><br>c<p>d &amp; &eacute;&nbsp;f<div>g</div>h") == ["a b c", "d & é f", "g", "h"]
    assert texts("<script>var t='</p>';if(a<b)x</script><style>p{}</style><!-- <p>no</p> --><p>yes") == ["yes"]
    assert texts("<ul><li>one<li>two<ul><li>three</ul></ul></p></div>four") == ["one", "two", "three", "four"]
    assert texts("<p title='a>b'>x</p><P CLASS=q>y</P>5 < 6 & 7") == ["x", "y", "5 < 6 & 7"]
    assert texts(None) == texts("") == texts("<p>  </p>") == []
    (block,) = h.leaf_blocks("<main><div class='Side-bar x2' id=q>t")
    assert (block.path.tag, block.path.names, block.path.parent.tag) == ("div", ("bar", "q", "side", "x"), "main")
    assert {"in=main", "in=div", "up0=div", "up1=main", "up0name=side", "name=q"} <= set(h.features(block))


def test_viterbi_is_the_best_of_all_sequences():
    import itertools

    chain = h.model()
    page, _ = next(html_pages.labelled_pages(1, 31))
    blocks = h.leaf_blocks(page)[:9]
    emit = [sum(chain.weights.get(f, 0.0) for f in h.features(b)) for b in blocks]

    def value(states):
        return chain.first[states[0]] + sum(e for e, s in zip(emit, states, strict=True) if s) + sum(chain.step[a][b] for a, b in zip(states, states[1:], strict=False))

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
    assert chain.decode(blocks) == [bool(s) for s in best]


def test_pages_that_were_not_trained_on():
    chain, right, n = h.model(), 0, 0
    for page, wanted in html_pages.labelled_pages(150, 77):
        blocks = h.leaf_blocks(page)
        assert [b.text for b in blocks] == [t for t, _ in wanted]
        right += sum(int(s) == y for s, (_, y) in zip(chain.decode(blocks), wanted, strict=True))
        n += len(wanted)
    assert right / n > 0.98


def test_pages_table(spark, sf_dir):
    got = {r.page_id: r for r in queries.op5_html_text(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))
    assert len(got) == len(rows)


def test_edges(spark):
    page = "<article>" + "".join(f"<p>Sentence {i}, of the text. And more of it.</p>" for i in range(20_000)) + "</article><footer>© x</footer>"
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", page), (2, "u", "no < tags")], "page_id long, url string, html string").selectExpr("*", "1 text", "2 n_chars")
    got = h.page_texts(df).collect()
    assert len(got) == 4 and max(r.n_chars for r in got) == page.count("<p>") * len("Sentence 1, of the text. And more of it.\n") + sum(len(str(i)) - 1 for i in range(20_000)) - 1
    assert h.page_texts(df.limit(0)).count() == 0
    assert h.extract(df).columns == ["page_id", "url", "html", "n_chars", "text"]


def test_custom_and_self_closed_elements_hide_nothing():
    texts = lambda page: [b.text for b in h.leaf_blocks(page)]
    assert texts("<p>a</p><svg-icon></svg-icon><title-bar>b</title-bar><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><svg class='x' /><p>b</p><svg><text>no</text></svg><p>c</p>") == ["a", "b", "c"]
    assert texts("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == ["so x=2 holds"]


def test_no_text_of_an_article_is_lost():
    texts = lambda page: [b.text for b in h.leaf_blocks(page)]
    assert texts("<article><h1>h</h1><p>one</p><svg class='i'/><p>two</p></article>") == ["h", "one", "two"]
    assert texts("<p>Text <math/> goes on") == ["Text goes on"]
    assert texts("<p>a <noscript>b</noscript> c</p><p><object data=x>d</object> e</p>") == ["a", "b", "c", "d e"]
    assert texts("<svg><path d=''><p>a</p><canvas width=1>no</canvas><p>b</p>") == ["a", "b"]
    assert texts("<select><option>no<option>no<p>a</p><textarea>no<p>b</p><title>no<div>c") == ["a", "b", "c"]
    assert texts("<iframe src=x><p>a</p><canvas/><p>b</p><script src=x /><p>c</p>") == ["a", "b", "c"]
    assert texts("<p don't>a</p><p title = \"it's > b\">it's c</p><p class=\"x>d</p><p>e</p>") == ["a", "it's c", "d", "e"]
    assert texts("<select><option>no</select><template><p>no</p></template><p>a</p><svg><g/><title>no</title></svg>b") == ["a", "b"]


def test_pages_made_to_be_slow():
    n = 200_000
    for page, want in (
        ("<a " * n, ["<a " * (n - 1) + "<a"]),
        ("<a " * n + ">x", ["x"]),
        ("<div>x" * n, ["x"] * n),
        ("<div class='a b'>" * n + "x", ["x"]),
        ("<li><ul>" + "<div>" * n + "<li>y</li>" * n, ["y"] * n),
        ("<!--" * n + "<p>x", []),
        ("<title>" * n + "<p>x", ["x"]),
        ("<p a=\"" * n + ">x", None),
        ("<p a='\">" * n + "x", None),
        ("<script " * n + ">x", []),
        ("</b" * n + ">x", ["x"]),
        ("x" + "<br>" * n + "&amp;" * n, ["x " + "&" * n]),
    ):
        began = time.process_time()
        blocks = h.leaf_blocks(page)
        for b in blocks[-3:]:
            h.features(b)
        assert time.process_time() - began < 8
        assert want is None or [b.text for b in blocks] == want


PROSE = ["Paragraph one tells of the river, its banks and the town. It goes on.", "The second says more, of mills. And of fish.", "Winter came early.", "Nobody was in the street, so the lamps stayed dark."]
KEPT = "".join(f"<p>{p}</p>" for p in PROSE)
REMARKS = [f"<p>{p}</p>" for p in ("I liked this piece very much, thank you.", "Not sure that it is right. But well written.")]


def framed(after="", within=""):
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><main><article><h1>The river</h1>{KEPT}{within}</article></main>{after}</body></html>"


def test_pages_unlike_those_trained_on():
    chain, listed = h.model(), "".join(f"<li>{r}</li>" for r in REMARKS)
    whole = ["The river", *PROSE]
    for page, want in (
        (framed("<footer><p>© 2020 Site. All rights reserved.</p></footer>"), whole),
        (framed("<footer><p>The Site is published by the Company of the River, which has its seat in the town.</p></footer>"), whole),
        (framed(f'<ol class="commentlist">{listed}</ol>'), whole),
        (framed(within=f'<ol class="commentlist">{listed}</ol>'), whole),
        (framed(f'<div id="disqus_thread"><div class="post">{REMARKS[0]}</div></div>'), whole),
        (f"<body><div>Menu</div><div><div>{KEPT}</div></div><div>foot</div></body>", PROSE),
        (f"<table><tr><td>Menu</td><td>{KEPT}</td></tr></table>", PROSE),
        ("<p>Only one paragraph is here, and it tells of the river.</p>", ["Only one paragraph is here, and it tells of the river."]),
        (f'<div id="x">{"<br><br>".join(PROSE)}</div>', [" ".join(PROSE)]),
        (PROSE[0], PROSE[:1]),
    ):
        assert h.main_text(page, chain) == "\n".join(want)


def test_layouts_left_out_of_training():
    """Block by block: layouts with names and nesting that html_pages doesn't write."""
    chain, right = h.model(), {}
    listed = "".join(f'<li id="c{i}"><b>Ann</b>{r}</li>' for i, r in enumerate(REMARKS))
    links = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("News", "Sport", "Weather", "About us"))
    for name, page, main in (
        ("blog", f"<div class=hdr><a href=/>River blog</a></div><div class=hentry><h2>The river</h2>{KEPT}</div><div class=comments-area><ol>{listed}</ol></div><div class=footer-widgets><p>Made in the town by river people.</p></div>", ["The river", *PROSE]),
        ("news", f"<ul class=navigation>{links}</ul><section class=story-body><header><h1>The river</h1></header>{KEPT}<aside><p>Read more of the mills here.</p></aside></section><footer><ul>{links}</ul><p>© 2019 News</p></footer>", ["The river", *PROSE]),
        ("forum", f"<div class=navbar>{links}</div><div class=content><div class=message-body>{KEPT}</div></div><div class=footnav><p>Terms of the forum are binding.</p></div>", PROSE),
        ("old", f"<center><a href=/>Home</a> | <a href=/m>Map</a></center><h1>The river</h1>{KEPT}<center>Last updated 1999</center>", ["The river", *PROSE]),
        ("wiki", f"<div id=mw-navigation><ul>{links}</ul></div><div id=bodyContent><h1>The river</h1>{KEPT}<ul><li>A list of mills.</li><li>A list of bridges.</li></ul></div><div id=footer-info><p>This page was last edited in May.</p></div>", ["The river", *PROSE, "A list of mills.", "A list of bridges."]),
        ("shop", f"<header><form><button>Search</button></form></header><main><div class=description>{KEPT}</div><div class=related-items><h3>Related</h3>{links}</div><section id=reviews>{''.join(REMARKS)}</section></main><div class=cookie-bar>We use cookies, you agree to them.</div>", PROSE),
    ):
        blocks = h.leaf_blocks(page)
        right[name] = sum(s == (b.text in main) for s, b in zip(chain.decode(blocks), blocks, strict=True)), len(blocks)
    assert sum(a for a, _ in right.values()) >= 0.9 * sum(b for _, b in right.values())
