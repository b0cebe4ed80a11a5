from duelgrid.llm import wrappers as w

SCHEMA = "page_id bigint, url string, html string"


def page(title, paragraphs, extra="", menu="<li><a href=x>one</a></li><li><a>two</a></li>"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav><ul>{menu}</ul></nav>"
            f"<div class='ad'>buy</div><article><h1>{title}</h1>{extra}{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>&copy; x</footer></body></html>")


def test_wrapper_has_repeats_options_and_slots():
    root = w.infer([page("A", ["x", "y"]), page("B", ["z"], "<h2>sub</h2>"), page("C", ["q", "r", "s"])])
    assert w.expression(root, 3).split("<article>")[1].startswith("<h1>#</h1>(<h2>#</h2>)?(<p>#</p>)+</article>")
    assert "(<li><a>#</a></li>)+" in w.expression(root, 3) and "<div.ad>buy</div>" in w.expression(root, 3)
    assert w.main_paths(root, 3) == ([["html", "body", "article"]], [])


def text(html):
    return w.main_text(html, [], [])


def test_blocks_spaces_and_references():
    assert text(page("T &amp; U", ["a\n  b&nbsp;<i>c</i>d", "&lt;e&gt; &eacute; &#233; &am", ""])) == "T & U\na b cd\n<e> é é &am"
    assert text("<article><p><b>one<br><p>two<ul><li>three<li>four</ul>five</article>") == "one\ntwo\nthree\nfour\nfive"


def test_boilerplate_inside_the_article():
    html = ("<article><header><h1>Head</h1><span>by me</span></header><p>a</p><div class='ad-box'>buy</div><form>f</form><aside>s</aside><!-- c -->"
            "<div class=cookie-notice>n</div><script>s</script><p>b</p><section id=comments>hate</section><article class='comment'>c</article></article>")
    assert text(html) == "Head\na\nb"


def test_pages_without_an_article():
    pages = [f"<body><div class=top>Site</div><div class=sidebar><a>l{k}</a></div><div id=c><h2>T{k}</h2><p>{'real text ' * 9}{k}<p>Read on</div><div class=end>End</div>" for k in range(4)]
    paths, same = w.main_paths(w.infer(pages), 4)
    assert w.main_text(pages[0], paths, same) == f"T0\n{('real text ' * 9)}0"  # `Read on` is on every page
    assert text("plain") == "plain" and text("a < b <p>c") == "a < b\nc" and text("<p>only") == "only" and text("") == "" == w.main_text(None, [], [])


def test_broken_markup_ends():
    for html in ("<p title='x>unclosed", "<", "<article", "<script>x", "</p></div>", "<article><p>a", "<![CDATA[", "<!-- never"):
        assert isinstance(text(html), str)
    assert text("<article><p>a") == "a" and text("<div>" * 3000 + "deep") == "deep"


def test_tables(spark, rows):
    pages = [(k, "http://one.example/" + str(k), page(f"T{k}", [f"p{k}", "q"])) for k in range(30)]
    pages += [(30, "https://two.example", "<main><p>x</p></main>"), (31, None, page("N", ["n"])), (32, "no host", ""), (33, None, None), (None, "http://one.example/z", pages[0][2])]
    pages += [pages[0], (34, "http://one.example/odd", "<main><p>other layout</p></main>")]
    frame = spark.createDataFrame(pages, SCHEMA)
    found = rows(w.main_texts(frame))
    want = [(i, u, t, len(t)) for i, u, h in pages for t in [text(h)]]
    assert found == sorted(want, key=repr)
    from pyspark.sql import functions as F
    more = frame.withColumn("host", F.lit(1)).withColumn("rule", F.lit(1)).withColumn("text", F.lit(1))
    assert rows(w.main_texts(more.withColumn("k", F.lit(2)).toDF(*more.columns, "HTML"))) == found
    assert w.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.host: r.pages for r in w.host_wrappers(frame).collect()} == {"one.example": 6, "two.example": 1, "": 1}


def test_against_the_tags_of_the_given_pages(spark, sf):
    import html
    import re

    frame = spark.read.parquet(f"{sf}/pages.parquet")
    for row, source in zip(*(sorted(x.collect(), key=lambda r: r.page_id) for x in (w.main_texts(frame), frame))):
        article = re.search(r"<article>(.*?)</article>", source.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", article))
        assert row.text == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_boilerplate_beside_or_around_the_content():
    body = "<article><p>real words</p></article>"
    for html in (f"<body><div id=header>top</div><div id=content>{body}</div><div id=footer>end</div></body>",
                 f"<div role=banner>top</div><div role=main>{body}</div><div role=contentinfo>end</div>",
                 f"<div hidden>top</div><div>{body}</div>", f"<div style='display: none'>top</div><div>{body}</div>",
                 f"<div class='page has-sidebar'>{body}<div class=sidebar>side</div></div>", f"<form action=x>{body}</form>",
                 f"<div class=has-sidebar>{body}</div><div class=sidebar><article>tea</article></div>",
                 "<article><div class=with-sidebar><p>real words</p><div class=sidebar>side</div></div></article>",
                 "<div id=header>top</div><div id=content><p>real words</p></div><div id=footer>end</div>",
                 "<div class='has-sidebar'><p>real words</p><div id=sidebar>side</div></div><div class=footer>end</div>"):
        assert text(html) == "real words", html
        assert w.main_text(html, *w.main_paths(w.infer([html.replace("words", f"words {k}") for k in range(3)]), 3)) == "real words", html
    assert text("<div class=post><p>own text</p></div><div id=comments><p>more words than the post has by far</p></div>") == "own text"


def test_repeated_paragraphs_stay(spark):
    """Copies and near copies under many addresses, a paragraph on all pages, and a label that one page lacks."""
    layout = "<body><div class=top>Site</div><div id=c><h2>{}</h2><p>{}<p>{}</div>"
    body, shared = "a whole paragraph of the article " * 4, "We tell this at the end of each story, and mean it."
    pages = [(k, f"http://copies.example/{k}", layout.format("Title", body, shared)) for k in range(8)]
    pages += [(100 + k, f"http://near.example/{k}", layout.format("Title", body, shared) + f"<!-- {k} --><div class=footer>{k}</div>") for k in range(8)]
    pages += [(200 + k, f"http://shared.example/{k}", layout.format(f"T{k}", f"number {k} has its own words " * 9, shared)) for k in range(8)]
    pages += [(300 + k, f"http://label.example/{k}", layout.format(f"T{k}", f"number {k} has its own words " * 9, "Read on")) for k in range(8)]
    pages += [(400 + k, f"http://some.example/{k}", layout.format(f"T{k}", f"number {k} has its own words " * 9, "Read on" if k != 37 else "Stop")) for k in range(60)]
    found = {r.page_id: r.text.split("\n") for r in w.main_texts(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert all(found[k][-3:] == ["Title", body.strip(), shared] for k in [*range(8), *range(100, 108)])
    assert all(found[200 + k][-1] == shared for k in range(8))
    assert all("Read on" not in found[300 + k] and f"T{k}" in found[300 + k] for k in range(8))
    assert all(found[400 + k][-1] == ("Read on" if k != 37 else "Stop") for k in range(60))


def test_layouts_of_one_host_are_kept_apart(spark):
    """A teaser stands where the other layout has its article; a third layout is on one page only."""
    words = "words of a story that goes on for a while, and then some more, " * 3
    one = lambda k: f"<body><div class=content><h2>T{k}</h2><p>{words}{k}</p></div><div class=foot><p>x{k}</p></div>"
    two = lambda k: f"<body><div class=content><p>Teaser {k}.</p></div><section class=story><p>{words}second {k}</p><p>end {k}</p></section>"
    rare = f"<body><div class=content><p>Teaser.</p></div><div class=box><div class=inner><p>{words}rare</p></div></div>"
    short = "<body><div class=content><h2>S</h2><p>Few.</p></div><div class=foot><p>a longer line at the foot of the page</p></div>"
    pages = [(k, f"http://a.example/{k}", one(k)) for k in range(40)] + [(100 + k, f"http://a.example/s{k}", two(k)) for k in range(9)]
    pages += [(200, "http://a.example/r", rare), (201, "http://a.example/short", short)]
    found = {r.page_id: r.text for r in w.main_texts(spark.createDataFrame(pages, SCHEMA), labels=False).collect()}
    assert all(found[k] == f"T{k}\n{words}{k}" for k in range(40))
    assert all(found[100 + k] == f"{words}second {k}\nend {k}" for k in range(9))
    assert found[200] == f"{words}rare"
    assert found[201] == "S\nFew."  # by the wrapper of its layout, not by its own longest element


def test_nothing_is_left_out_without_labels(spark):
    layout = "<body><div class=top>Site</div><div id=c><h2>T{}</h2><p>{}<p>Read on</div>"
    pages = [(k, f"http://label.example/{k}", layout.format(k, f"number {k} has its own words " * 9)) for k in range(8)]
    for r in w.main_texts(spark.createDataFrame(pages, SCHEMA), labels=False).collect():
        assert r.text == f"T{r.page_id}\n{(f'number {r.page_id} has its own words ' * 9).strip()}\nRead on"


def test_salted_wrappers_read_alike(spark, sf, rows, monkeypatch):
    frame = spark.read.parquet(f"{sf}/pages.parquet")
    before = rows(w.main_texts(frame, labels=False))
    monkeypatch.setattr(w, "BROADCAST_BYTES", 0)
    assert rows(w.main_texts(frame, labels=False)) == before


def test_alignment_against_brute_force():
    import itertools
    import random

    rnd = random.Random(5)

    def longest(x, y):
        return max((len(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n) if any(c == d for d in itertools.combinations(y, n))), default=0)

    for _ in range(150):
        x, y = (rnd.choices("abc", k=rnd.randint(0, 7)) for _ in range(2))
        pairs = w.counterparts(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(x, y)


def test_many_alternating_blocks_and_a_very_long_text():
    import time

    page = lambda n, t: "<article>" + "".join(f"<h2>{t}{i}</h2><p>p{i}</p>" + ("<ul><li>x</ul>" if (i + len(t)) % 7 == 0 else "") for i in range(n)) + "</article>"
    at = time.time()
    root = w.infer([page(10_000, "a"), page(9_000, "bb"), page(8_000, "ccc")])
    assert w.main_paths(root, 3)[0] == [["article"]] and time.time() - at < 60
    long = "word " * 400_000
    assert w.main_text(f"<article><p>{long}</p></article>", [["article"]], []) == long.strip()


def test_a_page_is_a_word_of_its_wrapper():
    root = w.outline(w.infer([page("A", ["x", "y"]), page("B", ["z"], "<h2>sub</h2>")]))
    assert w.fits(root, w.page_wrapper(page("C", ["1", "2", "3"]))) and w.fits(root, w.page_wrapper(page("D", ["<b>1</b>"], "<h2>s</h2>")))
    assert not w.fits(root, w.page_wrapper(page("E", ["1"], "<h3>s</h3>"))) and not w.fits(root, w.page_wrapper(page("F", [])))


def test_every_page_of_a_layout_shapes_its_wrapper(spark):
    """The one page of forty with a table has its table in the wrapper, whatever its hash, and fits it."""
    import json
    from duelgrid.llm.common import Kept
    pages = [(k, f"http://one.example/{k}", page(f"T{k}", [f"p{k}", "q"])) for k in range(40)]
    pages += [(40 + k, "http://one.example/odd", page(f"T{k}", ["p"], f"<{tag}>odd {k}</{tag}>")) for k, tag in enumerate(("table", "pre", "blockquote", "figure"))]
    for parts in (1, 7):
        frame = spark.createDataFrame(pages, SCHEMA).repartition(parts)
        found = [r.outline for r in w.layout_wrappers(w.layouts(w.with_html(frame)), Kept(spark, "test")).collect()]
        assert len(found) == 1
        for _, _, html in pages:
            assert w.fits(json.loads(found[0]), w.page_wrapper(html))


def test_shape_keeps_neighbours_of_one_label_apart():
    root = w.page_wrapper("<main><p>a</p><b>x</b><p>b</p><p>c</p></main>")
    assert w.outline(w.of_shape(w.shape(root))) == w.outline(root)
    whole = w.of_shape(w.shape(root))
    w.merge(whole, w.of_shape(w.shape(root)))
    assert w.fits(w.outline(whole), root)
