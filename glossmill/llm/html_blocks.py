"""Main text of pages: flat text blocks, judged by a decision tree.

A page is cut into flat blocks at its block-level tags. A block has its words, its link
density (share of words inside links), both of its neighbours, and where it stands:
inside the article, inside elements that by tag or name hold other matter, or as a
heading. A class, id or role counts as a whole or by its head word, and not on an element
that holds an article, main or h1. A decision tree over these measures, fitted by Spark ML on a small labelled
table, keeps or drops the block. Scripts, styles, form controls and comments in the
markup never become text. Only scripts, styles, textareas and titles without an end tag
reach to the end of the page; what else is silent ends with the element around it, and
without an end tag of its own at the first block inside.

The labelled table is built here by rule: layouts with and without an article element,
with menus, notices, sidebars, adverts and reader comments around short and long
paragraphs, every block labelled by the element that made it. Part of them are plain
pages of div and table elements without telling tags or names, whose blocks differ by words,
links and neighbours alone. A link reaches over the blocks inside it.

What has neither a telling tag or name nor links, such as a reader's comment in the midst of
an article under an unknown name, cannot be told from the article by these measures.

Null pages, and pages without text, have an empty text. Repeated rows give equal
results. Only key, url and html are read; html is read whole, and nesting is followed
with a stack, so a long page costs time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import map_batches

#: Elements whose content is no text of the page: without markup inside, and with it.
RAW = frozenset("script style textarea title".split())
NESTED = frozenset("noscript template iframe object svg math select datalist option canvas audio video".split())
SILENT = RAW | NESTED
#: Elements that end a block.
BREAKING = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section
    summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements without an end tag.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements, and names in class, id and role, that hold other matter than the article.
OTHER_TAGS = frozenset("nav footer aside form menu dialog button label fieldset".split())
OTHER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent
    contentinfo cookie cookies copyright discussion disqus footer gdpr login masthead menu menubar modal nav
    navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply
    respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split()
)
#: Last words that leave a name's meaning to the word before, and first words of states.
PARTS = frozenset("area bar box form item items link links list posts section slot unit".split())
STATES = frozenset("has is no not with without".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_NESTED = re.compile(rf"<(?:{'|'.join(sorted(NESTED))})\b", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_TARGET = re.compile(r"\bhref\b", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

FEATURES = (
    "words",
    "links",
    "words_before",
    "links_before",
    "words_behind",
    "links_behind",
    "in_article",
    "other_tag",
    "other_name",
    "heading",
    "page_has_article",
    "sentence",
)


def is_other(token: str) -> bool:
    """Whether a class, id or role names other matter, as a whole or by its head word."""
    if token.lower() in OTHER_NAMES:
        return True
    words = [x.lower() for x in _NAME.findall(token)]
    if not words or words[0] in STATES:
        return False
    while len(words) > 1 and words[-1] in PARTS and words[-1] not in OTHER_NAMES:
        words.pop()
    return words[-1] in OTHER_NAMES


def raw_end(page: str, tag: str, at: int) -> int:
    stop = _RAW_END[tag].search(page, at)
    return stop.end() if stop else len(page)


def silent_ends(page: str) -> dict[int, int]:
    """Where the text goes on behind each silent element, by the place of its start tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    whole: list[int] = []  # silent elements no block has begun in
    block: dict[int, int] = {}  # where the first block in a silent element begins

    def pop(at: int) -> None:
        """Close the last element, for want of its end tag, at a place."""
        tag, start = stack.pop()
        opened[tag] -= 1
        if tag in NESTED:
            ends[start] = min(at, block.get(start, at))

    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag and tag.lower()
        if tag not in SILENT and (tag not in BREAKING or tag in EMPTY):
            continue
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop(m.start())
                start = stack.pop()[1]
                opened[tag] -= 1
                if tag in NESTED:
                    ends[start] = at
            continue
        if tag in SILENT and attributes.endswith("/"):
            continue
        if tag in RAW:
            # titles of drawings may hold markup
            if tag != "title" or not (opened["svg"] or opened["math"]):
                at = raw_end(page, tag, at)
            ends[m.start()] = at
            continue
        if tag in NESTED:
            if tag == "option" and stack and stack[-1][0] == "option":
                pop(m.start())
            whole.append(m.start())
        else:
            block.update((x, m.start()) for x in whole)
            whole.clear()
            while stack and stack[-1][0] in ("p", "li" if tag == "li" else "p"):
                pop(m.start())
        stack.append((tag, m.start()))
        opened[tag] += 1
    while stack:
        pop(len(page))
    return ends


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Flat blocks of a page in order: text, measures."""
    found: list[tuple[str, int, int, list]] = []
    # tag, article, other tag, hidden, other name, number of blocks before
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []
    named: list[int] = []  # places in the stack of other names
    counts = [0, 0, 0, 0]
    pieces: list[str] = []
    linked: list[str] = []
    link: int | None = None  # elements open where a link began; it ends with any of them
    heading = False

    def close_block() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            in_links = len(entities.unescape(" ".join(linked)).split())
            place = [counts[0] > 0, counts[1] > 0, counts[2] > 0, counts[3], heading]
            found.append((text, words, min(in_links, words), place))
        pieces.clear()
        linked.clear()

    def pop() -> None:
        nonlocal link
        if link is not None and len(stack) <= link:
            link = None
        _, *marks, _ = stack.pop()
        for k in range(4):
            counts[k] -= marks[k]
        if marks[3]:
            named.pop()

    def unmark() -> None:
        """Take back the names of all open elements, for they hold the article."""
        if not named:
            return
        firsts = [stack[x][5] for x in named]
        passed = 0
        for number in range(firsts[0], len(found)):
            while passed < len(firsts) and firsts[passed] <= number:
                passed += 1
            found[number][3][3] -= passed
        for x in named:
            stack[x] = (*stack[x][:4], False, stack[x][5])
        counts[3] = 0
        named.clear()

    ends = silent_ends(page) if _NESTED.search(page) else {}
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            pieces.append(text)
            if link is not None:
                linked.append(text)
        if m is None:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            link = None if closing or not _TARGET.search(attributes) else len(stack)
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                at = ends[m.start()] if ends else raw_end(page, tag, at)
            pieces.append(" ")
            continue
        if tag not in BREAKING:
            continue
        close_block()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        if tag in EMPTY:
            continue
        if closing:
            # an end tag closes what it names and what was left open inside
            if any(x[0] == tag for x in reversed(stack)):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        while stack and stack[-1][0] in ("p", "li" if tag == "li" else "p"):
            pop()  # end tags that may be left out
        inside_article = counts[0] > 0
        tokens = [x for v in _NAMES.findall(attributes) for x in (v[0] or v[1] or v[2]).split()]
        main = tag == "main" or any("main" in map(str.lower, _NAME.findall(x)) for x in tokens)
        other = tag != "main" and any(map(is_other, tokens))
        if tag in ("main", "h1") or (tag == "article" and not other):
            unmark()
        marks = (
            tag == "article" or main,
            tag in OTHER_TAGS or (tag == "header" and not inside_article),
            bool(_HIDDEN.search(attributes)),
            other,
        )
        if other:
            named.append(len(stack))
        stack.append((tag, *marks, len(found)))
        for k in range(4):
            counts[k] += marks[k]
    close_block()
    has_article = float(any(x[3][0] for x in found))
    out = []
    for k, (text, words, links, place) in enumerate(found):
        row = [float(words), links / words]
        for near in (k - 1, k + 1):
            known = 0 <= near < len(found)
            row += [float(found[near][1]), found[near][2] / found[near][1]] if known else [0.0, 0.0]
        article, other_tag, hidden, names, title = place
        place = [float(article), float(other_tag), float(hidden or names > 0), float(title)]
        out.append((text, [*row, *place, has_article, float(text[-1] in ".!?:;…\"'»”)")]))
    return out


def plain_pages() -> list[str]:
    """Pages of div and table elements without names: menus, cards and share lines around text."""
    out = []
    lengths = ((30, 60, 25), (45, 12, 80), (20, 35), (14, 30, 22, 19), (90, 60, 40, 25))
    link = "<a href='#'>{}</a>"
    for number in range(30):
        n, wide = lengths[number % len(lengths)], number % 3
        cell = "td" if number % 2 else "div"
        word = link.format("x" + " x" * wide)
        menu = f"<{cell}>x</{cell}>" * (number % 4 == 0) + f"<{cell}>{word}</{cell}>" * (4 + wide)
        bar = f"<div>{' | '.join([word] * (3 + wide))}</div>"
        share = f"<div>x x {' '.join([link.format('x')] * (2 + wide))}</div>"
        card = f"<div>{link.format('<h3>x x x</h3><p>' + 'x ' * (6 + 4 * wide) + 'x.</p>')}</div>"
        more = f"<div>{link.format('x ' * (3 + wide) + 'x')}</div>" * 3
        foot = f"<div>x x x {word} {word}</div>" if number % 3 else f"<div>{word} {word}</div>"
        part = "p" if number % 5 else "div"
        text = "".join(
            f"<{part}>{'m ' * (k - 1)}m.</{part}>" + (share if i == 0 and number % 6 == 5 else "")
            for i, k in enumerate(n)
        )
        cited = f"<{part}>m m m m m m {link.format('m m')} {'m ' * 9}m.</{part}>" * (number % 2)
        story = f"<h1>m m {'m ' * wide}m</h1>{text}{cited}<h2>m m</h2><{part}>{'m ' * 17}m.</{part}>"
        if cell == "td":
            story = f"<table><tr><td>{story}</td></tr></table>"
            menu = f"<table><tr>{menu}</tr></table>"
        behind = (share, card * 3, more, bar)[number % 4]
        out.append(f"<body><div>{menu if number % 3 else bar}</div><div>{story}</div>{behind}{foot}</body>")
    return out


def bare_pages() -> list[str]:
    """Pages of an article and next to nothing else, of one block or a few."""
    out = []
    for words in (6, 12, 30, 120, 500, 2000):
        for k in (1, 2, 3):
            text = "".join(f"<p>{'m ' * (words + 7 * i)}m.</p>" for i in range(k))
            for holder in ("article", "main", "body"):
                out += [f"<{holder}>{text}</{holder}>", f"<{holder}><h1>m m m</h1>{text}</{holder}>"]
                if holder != "body":
                    # without a name, but outside an article that the page does mark
                    before, behind = (f"<div>{'x ' * n}x.</div>" for n in (2 + words % 40, 5 * k + words % 25))
                    out.append(f"<body>{before}<{holder}><h1>m m m</h1>{text}</{holder}>{behind}</body>")
    return out


def labelled_pages() -> list[tuple[list[float], float]]:
    """The labelled table: measures of blocks of made pages, 1 for blocks of the article.

    Words of the article are ``m``, of other matter ``x``, so a block's first letter is
    its label.
    """
    rows = []
    lengths = ((3, 60, 25), (40, 2, 80), (1, 1, 6), (12, 30, 4, 9), (150, 90))
    for number, paragraphs in enumerate(lengths * 4):
        wide = number % 3
        sentence = [f"{'m ' * (n - 1)}m{'.' if (number + k) % 3 else ''}" for k, n in enumerate(paragraphs)]
        text = "".join(f"<p>{x}</p>" for x in sentence) + "<ul><li>m m m</li><li>m m</li></ul>" * (wide == 1)
        linked = f"<p>m m m m <a href='#'>m m</a> {'m ' * 9}m.</p>" * (number % 2)
        body = f"<h1>{'m ' * (3 + wide)}m</h1>{text}{linked}<h2>m m</h2><p>{'m ' * 14}m.</p>"
        menu = "<ul>" + "<li><a href='#'>x</a></li>" * (4 + wide) + "</ul>"
        other = [
            f"<div class='ad'>{'x ' * (5 + 9 * wide)}x.</div>",
            f"<div class='cookie-notice'><p>{'x ' * 20}x.</p><button>x</button></div>",
            f"<div id='comments'><h3>x x</h3><p>{'x ' * (8 + 20 * wide)}x.</p><p>x x x.</p></div>",
            f"<aside class='sidebar'><h3>x x</h3><p>{'x ' * 15}x.</p>{menu}</aside>",
            f"<form><label>x x</label><p>{'x ' * 10}x.</p></form>",
            f"<section class='related'><h2>x x</h2><p><a href='#'>{'x ' * 7}x</a></p></section>",
        ]
        inner = other[number % 6] if number % 2 else ""
        outer = other[(number + 3) % 6]
        head = f"<header><p>{'x ' * (2 + wide)}x</p></header>" if number % 2 else ""
        nav = f"<nav>{menu}</nav>" if number % 3 else menu
        foot = f"<footer>{'x ' * (4 + 8 * wide)}x.</footer>" if number % 4 != 3 else menu
        holder = ("article", "main", "article", "div")[number // len(lengths)]
        story = f"<{holder}>{body}{inner}<p>{'m ' * 5}m.</p></{holder}>"
        # names that speak of other matter around the article itself
        wrapper = ("", "has-sidebar", "comments-open", "elementor-widget-container", "widget")[number % 5]
        story = f"<div class='{wrapper}'>{story}</div>" if wrapper else story
        page = f"<body>{head}{nav}{outer}{story}{other[(number + 1) % 6]}{foot}</body>"
        rows += [(measures, float(x.startswith("m"))) for x, measures in blocks(page)]
    for page in plain_pages() + bare_pages():
        rows += [(measures, float(x.startswith("m"))) for x, measures in blocks(page)]
    return rows


def fit_tree(spark: SparkSession, depth: int = 8) -> list[tuple]:
    """The tree as nodes (feature, threshold, left, right, label), the root first."""
    rows = spark.createDataFrame(labelled_pages(), "features array<double>, label double")
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(
        rows.coalesce(1).select(array_to_vector("features").alias("features"), "label")
    )
    nodes: list[tuple] = []
    lines = [x.strip() for x in model.toDebugString.splitlines()[1:] if x.strip()]

    def read(k: int) -> tuple[int, int]:
        """The node that line ``k`` begins, and the line behind it."""
        number = len(nodes)
        nodes.append(())
        if lines[k].startswith("Predict"):
            nodes[number] = (-1, 0.0, 0, 0, float(lines[k].split()[-1]) > 0.5)
            return number, k + 1
        feature, threshold = re.search(r"feature (\d+) <= (\S+)\)", lines[k]).groups()
        left, k = read(k + 1)
        right, k = read(k + 1)  # behind the line of Else
        nodes[number] = (int(feature), float(threshold), left, right, False)
        return number, k

    read(0)
    return nodes


def keeps(nodes: list[tuple], measures: list[float]) -> bool:
    node = nodes[0]
    while node[0] >= 0:
        node = nodes[node[2] if measures[node[0]] <= node[1] else node[3]]
    return node[4]


def main_text(nodes: list[tuple], page: str) -> str:
    return "\n".join(text for text, measures in blocks(page) if keeps(nodes, measures))


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """key, url, text, n_chars of every page."""
    nodes = fit_tree(pages.sparkSession)
    source = pages.select(F.col(key), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(nodes, x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(found, pa.string()),
                pa.array([len(x) for x in found], pa.int64()),
            ],
            [key, "url", "text", "n_chars"],
        )

    kind = source.schema[key].dataType.simpleString()
    return map_batches(source, run, f"{key} {kind}, url string, text string, n_chars long")
