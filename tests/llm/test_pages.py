"""WARC files and main text."""

import gzip
import hashlib
import io
import random

from glossmill.llm import html_blocks, warc
from glossmill.llm.common import filesystem


def test_archives_are_normalised_and_read_back(spark):
    long = "<p>" + "é" * 100 + "</p>"
    data = [
        (5, "http://a/\n5", long, "x"),
        (2, "http://a/2", long, "x"),
        (9, None, long, "x"),
        (2, "http://a/2", long, "again"),
        (7, "u", "short", "x"),
        (8, "u", "short", "x"),
        (3, "u", None, "x"),
        (4, "u", "\r\n\r\nContent-Length: 3\r\n\r\n" * 30, "x"),
        (6, "u", "z" * 3_000_000, "x"),
        (None, "u", long, "x"),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, uri string").repartition(2)
    members = warc.normalise(warc.write_archives(warc.with_targets(pages)))
    got = {(r.page_id, r.record_type, r.refers_to): r for r in warc.read_records(members).collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert got[5, "revisit", 2].payload_digest == digest
    assert got[5, "revisit", 2].payload_bytes == len(long.encode())
    assert got[5, "revisit", 2].url == "http://a/%0A5"
    assert got[9, "revisit", 2].url is None
    assert (2, "response", None) in got and (None, "revisit", 2) in got
    assert {(7, "response", None), (8, "response", None), (3, "response", None)} <= set(got)
    assert got[3, "response", None].payload_bytes == 0
    assert got[6, "response", None].payload_bytes == 3_000_000
    assert warc.read_records(members).count() == len(data)
    for row in members.collect():
        files, path = filesystem(row.uri)
        raw = files.open_input_file(path).readall()
        index = files.open_input_file(filesystem(row.index_uri)[1]).readall().splitlines()
        assert len(index) == row.records
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1\r\n") == row.records


def test_no_pages_give_no_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    members = warc.normalise(warc.write_archives(warc.with_targets(pages)))
    assert warc.read_records(members).count() == 0


def test_inflate_reads_one_or_many_members():
    whole = gzip.compress(b"a" * 10) + gzip.compress(b"b")
    assert b"".join(warc.inflate(io.BytesIO(whole))) == b"a" * 10 + b"b"


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body>
<header class="site"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="cookie-banner">We use cookies on this site. <button>Fine</button></div>
<article><header><h1>A &amp; B</h1></header><script>var t = "</p>";</script>
<p>First   line<br>goes on&nbsp;here, with <b>bold</b> and <a href="#">a link</a> in it.
<p>Short.<ul><li>One item.<li>Another item.</ul>
<div class="ad">Buy this now, it is cheap and good for you and your friends.</div>
<!-- no --><p>Caf&eacute; &lt;end&gt; of the text that matters to the reader of pages.</p>
<section id="comments"><h3>Comments</h3><p>I liked this article very much, thank you for it.</p></section></article>
<aside><p>Read also what others have written about it last week.</p></aside>
<form><label>Mail</label><input><textarea>x</textarea></form><footer>&copy; 2020 Somebody.</footer></body></html>"""


def test_main_text(spark):
    data = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "", "z"), (4, "u", "<p>cut <b", "w")]
    data += [(5, "u", "<article><p>" + "long text. " * 40_000, "v"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    assert got[1].text.split("\n") == [
        "A & B",
        "First line goes on here, with bold and a link in it.",
        "Short.",
        "One item.",
        "Another item.",
        "Café <end> of the text that matters to the reader of pages.",
    ]
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[2].url is None and got[3].text == ""
    assert got[5].n_chars == len("long text. ") * 40_000 - 1
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_silent_elements_end_with_what_holds_them(spark):
    nodes = html_blocks.fit_tree(spark)
    story = f"<article><p>{'Words of the story. ' * 9}</p><p>{'And its end, too. ' * 9}</p></article>"
    want = html_blocks.main_text(nodes, story)
    assert want.count("\n") == 1
    starts = ["<datalist id=x><option value=a>a<option value=b>b</datalist>"]
    starts += ["<select><option>a<option>b</select>", "<div><option>a<option>b</div>", "<svg><title>a</svg>"]
    starts += [f"<div><{x} data-x=y>old browser</div>" for x in sorted(html_blocks.NESTED)]
    starts += [f"<{x} data-x=y>old browser" for x in sorted(html_blocks.NESTED)]
    for start in starts:
        assert html_blocks.main_text(nodes, start + story) == want, start
        # an end tag of another element further down is not that of the first
        later = html_blocks.main_text(nodes, f"{start}{story}<div><object>a<p>b</p></object><svg>a</svg></div>")
        assert later == want, start
    for x in sorted(html_blocks.SILENT):
        assert html_blocks.blocks(f"<div><{x}><{x}a>no</{x}></div>") == []
    for x in sorted(html_blocks.RAW):
        assert html_blocks.blocks(f"<div><{x}>no</div><p>no") == []
    assert len(html_blocks.blocks("<p>a</p>" + "<div><svg>" * 50_000 + "<option>" * 50_000)) == 1


def test_names_around_the_article_do_not_hide_it(spark):
    nodes = html_blocks.fit_tree(spark)
    body = f"<p>{'Words of the story. ' * 9}</p><p>{'And its end, too. ' * 9}</p>"
    want = html_blocks.main_text(nodes, f"<article>{body}</article>")
    assert want.count("\n") == 1
    for x in ("has-sidebar", "comments-open", "elementor-widget-container", "widget", "with-ads"):
        for page in (f"<div class='{x}'><article>{body}</article></div>", f"<main class='{x}'>{body}</main>"):
            assert html_blocks.main_text(nodes, page) == want, page
    title = html_blocks.main_text(nodes, f"<div id=sidebar><p>a b c.</p><div class=ad><p>x.</p></div><h1>T</h1>{body}</div>")
    assert title.endswith(want)
    marked = lambda page: [x[8] for _, x in html_blocks.blocks(page)]
    for x in ("ad", "AD", "ad-slot", "cookie-notice", "comment-list", "related-posts", "navBar", "post-comments"):
        assert marked(f"<div class='a {x}'><p>b</p></div><p>c</p>") == [1.0, 0.0]
    assert marked("<div class=ad><p>a</p><div class=ad><p>b</p></div><h1>c</h1><p>d</p></div>") == [0.0, 1.0, 0.0, 0.0]
    assert marked("<div class=comments><article class=comment><p>a</p></article></div>") == [1.0]


def test_labelled_table_is_learnt(spark):
    nodes = html_blocks.fit_tree(spark)
    rows = html_blocks.labelled_pages()
    right = sum(html_blocks.keeps(nodes, x) == bool(label) for x, label in rows)
    assert right / len(rows) > 0.98


def test_links_reach_over_the_blocks_inside_them():
    found = html_blocks.blocks("<div><a href=x><h3>a b</h3><p>c d e</p></a><p>f</p></div><div><a href=y><p>g</p></div><p>h</p>")
    assert [(t, m[1]) for t, m in found] == [("a b", 1.0), ("c d e", 1.0), ("f", 0.0), ("g", 1.0), ("h", 0.0)]
    assert [m[1] for _, m in html_blocks.blocks("<a name=top><p>a</p><p>b</p>")] == [0.0, 0.0]


def test_the_tree_uses_words_links_and_neighbours(spark):
    nodes = html_blocks.fit_tree(spark)
    used = {html_blocks.FEATURES[n[0]] for n in nodes if n[0] >= 0}
    assert {"words", "links"} <= used
    assert used & {"words_before", "links_before", "words_behind", "links_behind"}


def held_out_pages(seed=5, n=60):
    """Layouts the labelled table does not have: (page, blocks of the article)."""
    rng = random.Random(seed)
    word = lambda: rng.choice("river stone paper light window garden early later found made".split())
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    for _ in range(n):
        box = rng.choice(["div", "section", "center"])
        title, parts = some(3, 7), [some(18, 90) + "." for _ in range(rng.randint(2, 6))]
        links = lambda k, a, b: [f"<a href='/{i}'>{some(a, b)}</a>" for i in range(k)]
        menu = "".join(f"<li>{x}</li>" for x in links(rng.randint(4, 9), 1, 2))
        cards = "".join(f"<{box}><a href=z><h4>{some(2, 5)}</h4><p>{some(5, 14)}.</p></a></{box}>" for _ in range(3))
        story = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in parts)
        share = f"<{box}>{some(1, 2)} {' '.join(links(3, 1, 1))}</{box}>"
        foot = f"<{box}>{' - '.join(links(4, 1, 2))}</{box}>"
        page = f"<html><body><ul>{menu}</ul><{box}>{story}{share}</{box}>{cards}{foot}</body></html>"
        yield page, [title, *parts]


def test_held_out_layouts(spark):
    nodes, right, given, wanted = html_blocks.fit_tree(spark), 0, 0, 0
    for page, story in held_out_pages():
        got = html_blocks.main_text(nodes, page).split("\n")
        right += len(set(got) & set(story))
        given, wanted = given + len(got), wanted + len(story)
    assert 2 * right / (given + wanted) >= 0.95


def test_unnamed_matter_around_and_inside_articles(spark):
    nodes = html_blocks.fit_tree(spark)
    body = [f"{'Words of the story stand here. ' * 9}".strip(), f"{'And its end, which is long, too. ' * 9}".strip()]
    text = "".join(f"<p>{x}</p>" for x in body)
    share = "<div class=zz>Share this on <a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></div>"
    assert html_blocks.main_text(nodes, f"<article>{text}{share}</article>").split("\n") == body
    menu = "<table><tr><td>Menu</td>" + "".join(f"<td><a href=/{i}>Part {i}</a></td>" for i in range(6)) + "</tr></table>"
    page = f"<body>{menu}<table><tr><td><h1>Some title here</h1>{text}</td></tr></table></body>"
    assert html_blocks.main_text(nodes, page).split("\n") == ["Some title here", *body]
    cards = "".join(f"<div><a href=/{i}><h3>Another one</h3><p>{'Read more of it. ' * 3}</p></a></div>" for i in range(3))
    assert html_blocks.main_text(nodes, f"<div><h1>Some title here</h1>{text}</div>{cards}").split("\n")[-2:] == body
