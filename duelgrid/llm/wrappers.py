"""Main text of pages by wrappers: union-free regular expressions inferred per host and layout.

Every page gives a wrapper of its own, which tells where its main element is; pages of a host that have it at the same
place are one layout.  A page's wrapper is reduced to its `shape`, its shown block elements; all different shapes of a
layout are aligned one after the other: elements that match are merged, neighbours of the same shape become a repeated
group `( )+`, and what only some pages have becomes an optional group `( )?`.  The result, the layout's wrapper, has no
unions.  No page is left out: shapes are dealt to `PARTS` parts by hash, each is merged in order, then the parts are, so
that a task holds one wrapper and the result does not depend on partitions.  Its main element is the layout's place, on
which all of its pages agree: an <article> or <main> element if there is one, else the element whose own slots hold most
text outside links and outside boilerplate.  (`infer` does the same for token streams with their texts, of which
`host_wrappers` and the template labels take up to `SAMPLE` pages, by hash; labels are checked on all pages after.)

Extraction matches each whole page against its host's wrappers, those of the largest layouts first.  Of the first that
it is a word of, the text of the slots and groups in the main element is taken, but for boilerplate elements (menus,
sidebars, notices, adverts, forms, scripts, comments, by tag or by class and id).  A page that fits none, as those of layouts
beyond a host's `LAYOUTS` largest may, is read with its own wrapper, whose main element is its layout's too.  Optionally, labels of the template are left out where the main element had to be guessed:
texts of at most `LABEL` characters, without a sentence's end and outside headings, that stand on all of the host's
pages, of which there are three of different html at least; the query leaves nothing out.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by a line feed.  An element whose names make it boilerplate is kept where it holds the article or most
of the text (`has-sidebar`), and is never folded with neighbours that are not.  Null or empty html, and pages without
main text, give the empty string.  Pages without a host share their wrappers.  Repeated rows give repeated rows; nothing
of a page is cut.  Ties between layouts go by a hash of the place.  Wrappers are broadcast if they are small, else joined
by host and salt, so that the pages of one host go to many tasks.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import Kept, map_slices, pick

#: Pages that `host_wrappers` and the candidates for template labels are inferred from.
SAMPLE = 6
#: Layouts of a host that get a wrapper; pages of others are read by their own.
LAYOUTS = 8
#: Parts of a layout's shapes that are merged on their own first.
PARTS = 64
#: Pairs of elements that are aligned by a table, and how far ahead a counterpart is looked for beyond.
CELLS, REACH = 1 << 18, 64
#: Wrappers of more bytes than this are joined, each host's in `SALTS` parts, and not broadcast.
BROADCAST_BYTES, SALTS = 32 << 20, 16
#: Characters of a repeated text that may be a label of the template, and what ends a sentence.
LABEL = 40
SENTENCE = re.compile(r"[.!?\u2026:;\u3002]\W*$")
#: Elements deeper than this join their ancestor at this depth in a wrapper (not in extraction).
DEPTH = 100

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed template svg select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, if it is open within the given elements.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
BOILERPLATE_TAGS = frozenset("nav footer aside form script style noscript template iframe menu dialog button select "
                             "option textarea svg head title object embed canvas".split())
BOILERPLATE_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-?bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"comments?|comment-\w+|replies|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|"
    r"signup|login|search|pagination|pager|skip-link|toolbar|widget)(?:$|[\s_-])")
MAIN_TAGS = ("article", "main")
#: Elements hidden by these names, or by a tag other than <form>, are never shown again.
COMMENTS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|comment-\w+|replies|disqus|respond)(?:$|[\s_-])")
NO, BY_NAME, BY_TAG = 0, 1, 2
#: An <article> with such a class is a comment or a teaser.
NOT_MAIN = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|reply|replies|related|teaser|ads?|advert\w*|promo\w*)(?:$|[\s_-])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")


def tokens(page: str):
    """(kind, name, label, hidden): kind is `<`, `>` or `t`; for text the name is the decoded text.  Hidden is
    NO, BY_NAME (also by attributes, and forms) or BY_TAG."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:  # a quote that is never closed: the tag ends at the next sign
            close = page.find(">", at)
            at = end if close < 0 else close + 1
            continue
        at = m.end()
        if m["text"] is not None:
            yield "t", html.unescape(m["text"]), "", NO
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if m["close"]:
                yield ">", tag, "", NO
                continue
            label, hidden = tag, (BY_NAME if tag == "form" else BY_TAG) if tag in BOILERPLATE_TAGS else NO
            if m["attributes"]:
                marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m["attributes"])}
                names = marks.get("class", "")
                label = ".".join([tag, *sorted(re.sub(r"\d+", "", names).split())])
                called = NOT_MAIN if tag in MAIN_TAGS else BOILERPLATE_NAMES
                named = f"{names} {marks.get('id', '')}"
                if not hidden and tag not in ("html", "body") and (
                    called.search(named) or marks.get("aria-hidden") == "true"
                    or marks.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
                    or re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", m["attributes"]))
                    or re.search(r"display\s*:\s*none", marks.get("style", ""))):
                    hidden = BY_TAG if called is NOT_MAIN and called.search(named) or COMMENTS.search(named) else BY_NAME
            yield "<", tag, label, hidden
            if tag in RAW and not m["attributes"].endswith("/"):
                stop = re.compile(rf"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
                yield ">", tag, "", False


def nested(page: str):
    """The tokens with the element structure that they imply: (`<`, tag, label, hidden), (`>`, tag), (`t`, text)."""
    open_: list[str] = []
    count: Counter = Counter()

    def shut(upto: int):
        while len(open_) > upto:
            tag = open_.pop()
            count[tag] -= 1
            yield ">", tag, "", False

    for kind, name, label, hidden in tokens(page):
        if kind == "t":
            yield kind, name, "", False
        elif kind == "<":
            if name in BLOCK and count["p"]:
                yield from shut(len(open_) - 1 - open_[::-1].index("p"))
            if name in CLOSES:
                closes, within = CLOSES[name]
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k] in within:
                        break
                    if open_[k] in closes:
                        yield from shut(k)
                        break
            yield kind, name, label, hidden
            if name in VOID:
                yield ">", name, "", False
            else:
                open_.append(name)
                count[name] += 1
        elif count[name]:
            yield from shut(len(open_) - 1 - open_[::-1].index(name))
    yield from shut(0)


def shown(found: list[tuple]) -> set[int]:
    """Which of the elements hidden by name hold the main text: those around the largest <article> or <main> of
    a page that shows none, and those with most of the text of the main element, or of a page without one.
    Text in links and in elements hidden by tag does not count."""
    at, open_, links, tagged, named = 0, [], 0, 0, 0
    elements, mains = [], []  # (first, last, weight), and (visible, weight, first, last)
    for i, (kind, name, _, hidden) in enumerate(found):
        if kind == "t":
            at += 0 if links or tagged else len(SPACE.sub(" ", name).strip())
        elif kind == "<":
            open_.append((i, at, name, hidden, not named and hidden != BY_NAME, not tagged and hidden != BY_TAG))
            links, tagged, named = links + (name == "a"), tagged + (hidden == BY_TAG), named + (hidden == BY_NAME)
        else:
            place, before, name, hidden, visible, free = open_.pop()
            links, tagged, named = links - (name == "a"), tagged - (hidden == BY_TAG), named - (hidden == BY_NAME)
            if hidden == BY_NAME:
                elements.append((place, i, at - before))
            if name in MAIN_TAGS and free:
                mains.append((visible, at - before, place, i))
    out: set[int] = set()
    low, high, whole = -1, len(found), at
    if mains:
        visible, whole, low, high = max(mains)
        if not visible:
            out = {a for a, b, _ in elements if a <= low and b >= high}
    return out | {a for a, b, weight in elements if low <= a and b <= high and 2 * weight > whole}


def stream(page: str):
    """The tokens of the nested elements; hidden is whether an element is boilerplate."""
    found = list(nested(page))
    back = shown(found) if any(t[3] == BY_NAME for t in found) else ()
    for i, (kind, name, label, hidden) in enumerate(found):
        yield kind, name, label, bool(hidden) and i not in back


class Node:
    """An element of a wrapper: its label, its items in order, its text slots and how often it occurs.  Only
    elements of one key, that is of one label and both hidden or both not, are aligned or folded."""

    __slots__ = ("label", "key", "items", "texts", "pages", "own", "linked", "optional", "repeated", "hidden")

    def __init__(self, label: str, hidden: bool = False):
        self.label, self.hidden, self.key, self.items = label, hidden, (label, hidden), []
        self.texts: dict[str, int] = {}  # own texts by the number of sampled pages that have them
        self.pages, self.own, self.linked, self.optional, self.repeated = 1, 0, 0, False, False


def page_wrapper(page: str | list) -> Node:
    """The wrapper of one page (or of its tokens): its elements, with neighbours of one key folded into a repeated
    group."""
    root = Node("")
    path, deep, links = [root], 0, 0
    for kind, name, label, hidden in stream(page) if isinstance(page, str) else page:
        if kind == "t":
            text = SPACE.sub(" ", name).strip()
            if text:
                path[-1].texts[text] = 1
                path[-1].own += len(text)
                path[-1].linked += len(text) * bool(links)
        elif kind == "<":
            links += name == "a"
            if len(path) > DEPTH:
                deep += 1
                continue
            node = Node(label, hidden)
            path[-1].items.append(node)
            path.append(node)
        else:
            links -= name == "a"
            if deep:
                deep -= 1
                continue
            path.pop()
            above = path[-1].items
            if len(above) > 1 and above[-2].key == above[-1].key:
                last = above.pop()
                merge(above[-1], last, within=True)
                above[-1].repeated = True
    return root


def counterparts(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.  What both begin and end with is taken first; if the rest has more than
    `CELLS` pairs, each key goes to its next place within `REACH`, so that time and memory stay in proportion."""
    if x == y:
        return [(i, i) for i in range(len(x))]
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    end = 0
    while end < min(len(x), len(y)) - low and x[-1 - end] == y[-1 - end]:
        end += 1
    n, m = len(x) - low - end, len(y) - low - end
    out = [(i, i) for i in range(low)]
    if n * m > CELLS:
        places: dict = {}
        for j in range(low, low + m):
            places.setdefault(y[j], []).append(j)
        at = low
        for i in range(low, low + n):
            own = places.get(x[i], ())
            k = bisect_left(own, at)
            if k < len(own) and own[k] - at <= REACH:
                out.append((i, own[k]))
                at = own[k] + 1
    elif n and m:
        size = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                size[i][j] = size[i + 1][j + 1] + 1 if x[low + i] == y[low + j] else max(size[i + 1][j], size[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if x[low + i] == y[low + j]:
                out.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif size[i + 1][j] >= size[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(x) - k, len(y) - k) for k in range(end, 0, -1)]


def merge(a: Node, b: Node, within: bool = False) -> None:
    """Aligns b with a and generalises a.  Within a page, counts of pages are not added up."""
    for text, n in b.texts.items():  # in place: a page may fold many paragraphs
        had = a.texts.get(text, 0)
        a.texts[text] = max(had, n) if within else had + n
    a.own, a.linked = a.own + b.own, a.linked + b.linked
    a.pages = max(a.pages, b.pages) if within else a.pages + b.pages
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    x, y = a.items, b.items
    out, i, j = [], 0, 0
    for k, l in [*counterparts([n.key for n in x], [n.key for n in y]), (len(x), len(y))]:
        for node in (*x[i:k], *y[j:l]):  # what has no counterpart is optional
            node.optional = True
            out.append(node)
        if k < len(x):
            merge(x[k], y[l], within)
            out.append(x[k])
        i, j = k + 1, l + 1
    a.items = []
    for node in out:  # groups that have become neighbours of one key
        if a.items and a.items[-1].key == node.key:
            merge(a.items[-1], node, within=True)
            a.items[-1].repeated = True
        else:
            a.items.append(node)


def outline(node: Node) -> list:
    """What `fits` reads of a wrapper: label, optional, and the same of the shown block elements within."""
    return [node.label, node.optional, [outline(n) for n in node.items if not n.hidden and n.label.split(".")[0] in BLOCK]]


def fits(wrapper: list, page: Node) -> bool:
    """Whether a page is a word of the wrapper's expression: its shown block elements come in the wrapper's order, each
    within its like, and none is missing that the wrapper does not call optional.  Slots, inline elements and
    boilerplate take anything."""
    ours, at = wrapper[2], 0
    for node in page.items:
        if node.hidden or node.label.split(".")[0] not in BLOCK:
            continue
        while at < len(ours) and ours[at][0] != node.label:
            if not ours[at][1]:
                return False
            at += 1
        if at == len(ours) or not fits(ours[at], node):
            return False
        at += 1
    return all(optional for _, optional, _ in ours[at:])


def shape(node: Node) -> list:
    """What a layout's wrapper is merged from: label, optional, repeated, and the same of the shown block elements within.
    Of what stands between two of one label a `|` is left, so that they stay two."""
    items: list[list] = []
    for n in node.items:
        if not n.hidden and n.label.split(".")[0] in BLOCK:
            if items and items[-1][0] == n.label:
                items.append(["|", n.optional, False, []])
            items.append(shape(n))
    return [node.label, node.optional, node.repeated, items]


def of_shape(found: list) -> Node:
    node = Node(found[0])
    node.optional, node.repeated, node.items = found[1], found[2], [of_shape(x) for x in found[3]]
    return node


def infer(pages: list[str]) -> Node:
    whole = page_wrapper(pages[0])
    for page in pages[1:]:
        merge(whole, page_wrapper(page))
    return whole


def expression(node: Node, pages: int) -> str:
    """The wrapper as a regular expression over tags, `#` for a text slot and literal text that never changes."""
    inner = "".join(expression(n, pages) for n in node.items)
    if node.texts:
        same = [t for t, n in node.texts.items() if n >= pages]
        inner = (same[0] if len(node.texts) == 1 and same and pages > 1 else "#") + inner
    if not node.label:
        return inner
    out = f"<{node.label}>{inner}</{node.label.split('.')[0]}>"
    return f"({out}){'*' if node.optional and node.repeated else '?' if node.optional else '+'}" if (
        node.optional or node.repeated) else out


def main_paths(root: Node, pages: int) -> tuple[list[list[str]], list[str]]:
    """Label paths of the main elements, and labels of the template that every page repeats."""
    found: dict[str, list] = {t: [] for t in MAIN_TAGS}
    best, best_weight = None, 0
    todo = [(root, [])]
    while todo:
        node, path = todo.pop()
        tag = node.label.split(".")[0]
        if node.hidden:
            continue
        if tag in found:
            found[tag].append(path)
            if tag == "article":
                continue
        # text of the element itself and of its paragraphs
        weight = sum(n.own - 2 * n.linked for n in [node, *(n for n in node.items if not n.hidden)])
        for n in node.items:
            if not n.hidden and n.label.split(".")[0] not in BLOCK:
                weight += sum(x.own - 2 * x.linked for x in n.items if not x.hidden)
        if weight > best_weight:
            best, best_weight = path, weight
        todo.extend((n, [*path, n.label]) for n in reversed(node.items))
    for tag in MAIN_TAGS:
        if found[tag]:
            return [list(p) for p in sorted(found[tag], key=len)], []
    if best is None:
        return [], []
    # a guessed element: the block that holds it, so that neighbouring groups are not lost
    while len(best) > 1 and best[-1].split(".")[0] in HEADINGS | {"p", "span", "b", "i", "em", "strong", "a", "li", "ul", "ol"}:
        best = best[:-1]
    same: set[str] = set()
    labels: set[str] = set()
    if pages >= 3:
        todo, total = [root], 0
        while todo:
            node = todo.pop()
            if not node.hidden:
                repeated = [t for t, n in node.texts.items() if n >= pages]
                same.update(repeated)
                total += node.own
                if node.label.split(".")[0] not in HEADINGS:
                    labels.update(t for t in repeated if len(t) <= LABEL and not SENTENCE.search(t))
                todo.extend(node.items)
        if 2 * sum(map(len, same)) * pages > total:
            labels = set()
    return [best], sorted(labels)


def extract(page: str | list | None, paths: list[list[str]], same: list[str]) -> tuple[str, bool]:
    """Main text of a page, and whether a main element was met."""
    wanted = {tuple(p) for p in paths}
    template = frozenset(same)
    blocks: list[str] = []
    run: list[str] = []
    path: list[str] = []
    hidden = heading = header = 0
    inside = int(() in wanted)  # no element holds the text: all of the page
    marks: list[tuple[bool, bool, bool, bool]] = []
    met = bool(inside)
    depths = {len(p) for p in wanted}

    def end_block():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text and text not in template:
            blocks.append(text)

    for kind, name, label, hide in page if isinstance(page, list) else stream(page or ""):
        if kind == "t":
            if inside and not hidden and (heading or not header):
                run.append(name)
            continue
        if name == "br" or name == "hr":
            if kind == "<":
                run.append(" ")
                path.append(label)
                marks.append((False, False, False, False))
            else:
                path.pop()
                marks.pop()
            continue
        if inside and name in BLOCK:
            end_block()
        if kind == "<":
            path.append(label)
            at_main = len(path) in depths and tuple(path) in wanted
            mark = (at_main, bool(hide), name in HEADINGS, name == "header")
            met = met or at_main
            marks.append(mark)
            inside, hidden, heading, header = inside + mark[0], hidden + mark[1], heading + mark[2], header + mark[3]
        else:
            path.pop()
            mark = marks.pop()
            inside, hidden, heading, header = inside - mark[0], hidden - mark[1], heading - mark[2], header - mark[3]
    end_block()
    return "\n".join(blocks), met


def main_text(page: str | None, paths: list[list[str]], same: list[str]) -> str:
    """At these main elements, or by a wrapper of the page's own where it has none of them."""
    if not page:
        return ""
    text, met = extract(page, paths, same)
    if met:
        return text
    return extract(page, *main_paths(page_wrapper(page), 1))[0]


def wrapped_text(page: str | None, rules: list[tuple]) -> str:
    """By the first wrapper (outline, main paths, template labels) that the page fits, or by one of its own."""
    if not page:
        return ""
    found = list(stream(page))
    own = page_wrapper(found)
    for wrapper, paths, same in rules:
        if fits(wrapper, own):
            text, met = extract(found, paths, same)
            if met:
                return text
    return extract(found, *main_paths(own, 1))[0]


def host(url="url"):
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def first_of(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first `most` rows of each group: cut by hash part first, so that no task sorts a whole group."""
    def cut(r, *part):
        return r.withColumn("r", F.row_number().over(Window.partitionBy(*by, *part).orderBy(order))).filter(F.col("r") <= most).drop("r")
    return cut(cut(rows.withColumn("part", F.pmod(F.xxhash64(order), F.lit(64))), "part").drop("part"))


def small_side(df: DataFrame, size) -> DataFrame:
    """The frame, to be broadcast if the sum of `size` over its rows is below `BROADCAST_BYTES`; else Spark decides."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def inferred(keyed: DataFrame, html: DataFrame, by: list[str], sample: int, kept: Kept) -> DataFrame:
    """The `by` columns, pages (sampled), wrapper (the expression), outline and rule (main paths and template labels), as
    JSON: one row per group of `keyed` (by, key).  html: host, key, html of all pages."""
    chosen = kept(first_of(keyed.select(*by, "key").distinct(), by, "key", sample))
    sampled = html.join(small_side(chosen, F.lit(64)), ["host", "key"]).dropDuplicates([*by, "key"])
    names = ", ".join(f"{c} {t}" for c, t in keyed.select(*by).dtypes)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one group's pages at a time
                row = batch.slice(k, 1).to_pylist()[0]
                root, n = infer([p["html"] for p in row["sampled"]]), len(row["sampled"])
                values = [*(row[c] for c in by), n, expression(root, n), json.dumps(outline(root)), json.dumps(main_paths(root, n))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(k, 1) for i in range(len(by))), *(pa.array([v], pa.int64() if isinstance(v, int) else pa.string()) for v in values[len(by):])],
                    names=[*by, "pages", "wrapper", "outline", "rule"])

    return (sampled.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "html"))).alias("sampled"))
            .mapInArrow(run, f"{names}, pages bigint, wrapper string, outline string, rule string"))


def with_html(pages: DataFrame) -> DataFrame:
    return pick(pages, "url", "html").filter("html is not null and html <> ''").select(host().alias("host"), F.xxhash64("html").alias("key"), "html")


def host_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """host, pages, wrapper, outline, rule: one wrapper for all layouts of a host."""
    html = with_html(pages)
    return inferred(html, html, ["host"], sample, Kept(pages.sparkSession, "wrappers"))


def layouts(html: DataFrame) -> DataFrame:
    """host, layout, key, place, shape of every page: pages of a layout have their main element, by their own wrapper, at
    one place."""

    def work():
        def each(part):
            roots = [page_wrapper(p) for p in part.column(2).to_pylist()]
            places, shapes = ([json.dumps(x) for x in xs] for xs in ([main_paths(r, 1)[0] for r in roots], map(shape, roots)))
            return {"host": part.column(0), "key": part.column(1), "place": places, "shape": shapes}

        return each

    return map_slices(html, work, "host string, key bigint, place string, shape string").select(
        "host", F.xxhash64("place").alias("layout"), "key", "place", "shape")


def merged(shapes: DataFrame, by: list[str], made=shape) -> DataFrame:
    """The `by` columns and shape: all shapes of a group, merged in the order of their other columns, and what is `made`
    of the whole.  A task holds the wrapper of one group."""
    order = [c for c in shapes.columns if c not in by]
    schema = ", ".join(f"{c} {t}" for c, t in shapes.select(*by, "shape").dtypes)

    def run(batches):
        now = whole = kind = None

        def row():
            return pa.RecordBatch.from_pylist([{**dict(zip(by, now)), "shape": json.dumps(made(whole))}], schema=kind)

        for batch in batches:
            kind = pa.schema([batch.schema.field(c) for c in (*by, "shape")])
            for *group, found in zip(*(batch.column(c).to_pylist() for c in (*by, "shape"))):
                page = of_shape(json.loads(found))
                if group == now:
                    merge(whole, page)
                    continue
                if now is not None:
                    yield row()
                now, whole = group, page
        if now is not None:
            yield row()

    return shapes.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def layout_wrappers(keyed: DataFrame, kept: Kept) -> DataFrame:
    """host, layout, rank, place, outline: a wrapper for each of the `LAYOUTS` layouts that most different pages of a host
    have, merged from all pages of the layout; by rank those of most pages come first.  keyed: what `layouts` gives."""
    sizes = keyed.select("host", "layout", "key").distinct().groupBy("host", "layout").agg(F.count("*").alias("n"))
    most = kept(first_of(sizes.withColumn("rank", F.struct(-F.col("n"), "layout")), ["host"], "rank", LAYOUTS))
    wanted = small_side(most.select("host", "layout", "rank"), F.lit(64))
    shapes = keyed.join(wanted, ["host", "layout"]).select("host", "layout", "place", "shape").distinct()
    parts = merged(shapes.withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(PARTS))), ["host", "layout", "place", "part"])
    whole = merged(parts, ["host", "layout", "place"], outline)
    return whole.withColumnRenamed("shape", "outline").join(wanted, ["host", "layout"])


def not_repeated(rows: DataFrame) -> DataFrame:
    """host, missing: the rules' template labels that some page of the host does not have."""

    def work():
        def each(part):
            out = set()
            for host, page, labels in zip(*(c.to_pylist() for c in part.columns)):
                own = {SPACE.sub(" ", name).strip() for kind, name, *_ in stream(page) if kind == "t"}
                out.update((host, t) for t in labels if t not in own)
            return {"host": [x[0] for x in out], "missing": [x[1] for x in out]}

        return each

    return map_slices(rows.select("host", "html", "labels"), work, "host string, missing string").distinct()


def main_texts(pages: DataFrame, sample: int = SAMPLE, labels: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.  With `labels`, labels of the template are left out
    where the main element had to be guessed; `sample` pages of a layout give the candidates, all pages of the host
    decide."""
    kept = Kept(pages.sparkSession, "wrappers")
    html = with_html(pages)
    keyed = kept(layouts(html))
    found = layout_wrappers(keyed, kept)
    if labels:  # what stands on all pages stands on those of the sample
        at = found.select("host", "layout")
        guessed = inferred(keyed.join(small_side(kept(at), F.lit(64)), ["host", "layout"]), html, ["host", "layout"], sample, kept)
        found = found.join(guessed.select("host", "layout", F.get_json_object("rule", "$[1]").alias("same")), ["host", "layout"])
    else:
        found = found.withColumn("same", F.lit("[]"))
    rule = F.concat(F.lit("["), "place", F.lit(", "), "same", F.lit("]")).alias("rule")
    rules = kept(found.select("host", F.struct("rank", "outline", rule).alias("r")).groupBy("host").agg(
        F.sort_array(F.collect_list("r")).alias("rules")))
    rows = pick(pages, "page_id", "url", "html").withColumn("host", host())
    if labels:
        texts = F.flatten(F.transform("rules", lambda r: F.from_json(F.get_json_object(r["rule"], "$[1]"), "array<string>")))
        said = kept(rules.select("host", F.array_distinct(texts).alias("labels")).filter("size(labels) > 0"))
        missing = not_repeated(rows.filter("html is not null and html <> ''").join(said, "host"))
        absent = kept(missing.groupBy("host").agg(F.collect_list("missing").alias("missing")))
        rules = rules.join(said, "host", "left").join(absent, "host", "left").withColumn(
            "labels", F.array_except(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("missing", F.array().cast("array<string>"))))
    else:
        rules = rules.withColumn("labels", F.array().cast("array<string>"))
    size = F.length(F.to_json("rules")) + F.lit(64)
    rules = kept(rules.select("host", "rules", "labels"))
    if (rules.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(rules), "host", "left")
    else:  # a host's pages are dealt to `SALTS` tasks at least
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    both = both.select("page_id", "url", "html", F.to_json(F.struct("rules", "labels")).alias("said"))

    def work():
        read: dict[str, list] = {}

        def each(part):
            texts = []
            for page, said in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if said not in read:
                    if len(read) > 1_000:
                        read.clear()
                    found = json.loads(said)
                    left = set(found.get("labels") or ())
                    read[said] = [(json.loads(r["outline"]), paths, [t for t in same if t in left])
                                  for r in found.get("rules") or () for paths, same in [json.loads(r["rule"])]]
                texts.append(wrapped_text(page, read[said]))
            return {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return each

    return map_slices(both, work, "page_id bigint, url string, text string, n_chars bigint")
