"""Main text of web pages by tag-path ratios.

Every block of text has a path of tags from the root. Over each path text length, punctuation and link text are
added up; their ratios to the path's number of blocks are smoothed over neighbouring paths, fused into one score
and held against a threshold. The element around all blocks of the winning paths, or the article around most of
them, is the content node; its other blocks (headings, short paragraphs) are kept unless they stand in menus, forms,
notices, adverts, comments and the like, or, without an article, on paths of links. A form or the like that holds
most of the page's text is no such place. Inside an article, elements whose class or id has but a word that articles are
about as well (a notice, a share, related work), its header and dialogs are content if their own paths' ratios are like the best one's; the class
of a single paragraph does not count at all.

Null or empty pages give an empty text, an empty table no rows; repeated rows are worked out alike; further columns are
kept, but for ``text`` and ``n_chars``, which are replaced. Tags that are never closed, quotes without an end and
elements in each other to any depth take time in proportion to the page. Inside the content node nothing but the
named places is dropped, and nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A path's fused score must reach this share of the page's largest.
SHARE = 0.12
#: Weights of the previous, own and next path in smoothing.
SMOOTH = (0.1, 0.8, 0.1)

# Elements by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
AWAY = set("aside button dialog fieldset footer form head header menu nav option select".split())
HEADING = {f"h{i}" for i in range(1, 7)}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words in classes and ids of places that are never content.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|footer|foot|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|pager|pagination|paywall|popup|promo|promotion|recommended|replies|respond|sharing|sidebar|signup|sponsor|sponsored|subscribe|subscription|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Words that name places beside an article, but within one may as well be what it is about: there their paths' ratios tell.
DOUBTS = re.compile(r"(?:^|[\s_-])(?:banner|byline|copyright|disclaimer|notice|notification|related|search|share|skip|social|teaser)(?:$|[\s_-])", re.I)
#: Elements whose classes do not name a place of the page, but what one paragraph is.
PARAGRAPHS = set("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: Classes that name what a layout has or lacks.
LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S+", re.I)
#: Elements that never hold the content, whatever their share of the text.
NEVER = set("button dialog footer head menu nav option select".split())
#: Share of the text (of articles, if there are any) that makes a wrapper content if at most REST stands outside of wrappers.
WRAPPER, REST = 0.7, 0.1
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"[,.;:!?。，；：！？、…]")


RAW = set("script style noscript template textarea svg iframe title select".split())
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[\"'>]")


class Node:
    """An open or closed element; the nodes of a page stand in the order of their start tags."""

    __slots__ = ("away", "doubted", "hidden", "name", "number", "own", "parent", "path", "within")

    def __init__(self, number: int, name: str, path: int, parent: Node | None, own: bool, hidden: bool, doubted: bool = False) -> None:
        self.number, self.name, self.path, self.parent, self.own, self.hidden, self.away, self.doubted = number, name, path, parent, own, hidden, False, doubted
        self.within = name in ("article", "main") or parent is not None and parent.within


def tokens(page: str):
    """(text, closing, name, attributes) of the page's texts and tags; a text has no name. Each character is looked at a
    bounded number of times, whatever the page: a quote without an end is no quote, a tag without an end is text."""
    at, size, quotes = 0, len(page), True
    last = page.rfind(">")
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            yield page[at:], False, "", ""
            return
        if start > at:
            yield page[at:start], False, "", ""
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            at = start + 9
            continue
        m = TAG.match(page, start + 1)
        if not m:
            if page[start + 1 : start + 2] in ("!", "?"):
                at = page.find(">", start) + 1
            else:
                yield "<", False, "", ""
                at = start + 1
            continue
        end = m.end()
        while quotes:
            mark = MARK.search(page, end)
            if mark is None:
                quotes = False
            elif mark[0] == ">":
                end = mark.start()
                break
            else:
                end = page.find(mark[0], mark.end()) + 1
                if not end:
                    quotes = False
        if not quotes:
            end = page.find(">", m.end())
        name, attributes = m[2].lower(), page[m.end() : end]
        at = end + 1
        if name in RAW and not m[1]:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        yield "", bool(m[1]), name, attributes


def _away(name: str, attributes: str) -> bool:
    """Whether an element is no content by its name, class, id or role."""
    if name in AWAY:
        return True
    if attributes and _doubted(name, attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and HINTS.search(LAYOUT.sub(" ", value)):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _doubted(name: str, attributes: str) -> bool:
    """Whether only words of DOUBTS in its class or id keep an element away."""
    values = [(m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    return name not in ("html", "body", "article", "main") and any(DOUBTS.search(LAYOUT.sub(" ", v)) for v in values)


def _in_doubt(name: str, attributes: str) -> bool:
    """Whether an element inside an article is away for nothing but a word that articles are about as well, or as the
    article's own header or a dialog of it."""
    rest = ATTRIBUTE.sub(lambda m: "" if m[1].lower() in ("class", "id") and not HINTS.search(LAYOUT.sub(" ", (m[2] or "").strip("\"'"))) else m[0], attributes)
    return not _away("div" if name in ("header", "dialog") else name, rest)


class Page:
    """The nodes of a page and its blocks (text, node, characters inside links), in page order."""

    def __init__(self, page: str) -> None:
        self.nodes = [Node(0, "", 0, None, False, False)]
        self.blocks: list[tuple[str, Node, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        stack, places = [self.nodes[0]], defaultdict(list)  # of each name the places in the stack
        held: list[str] = []
        linked, link = 0, False

        def close() -> None:
            nonlocal linked
            if held:
                if text := " ".join(entities.unescape("".join(held)).split()):
                    self.blocks.append((text, stack[-1], linked))
                held.clear()
                linked = 0

        def cut(place: int) -> None:
            while len(stack) > place:
                places[stack.pop().name].pop()

        for text, closing, name, attributes in tokens(page):
            if not name:
                held.append(text)
                if link:
                    linked += len(text)
            elif name == "br":
                held.append(" ")
            elif name == "a":
                link = not closing
            elif name in INLINE and not (name in ("span", "label") and _away(name, attributes)):
                continue
            elif name == "hr":
                close()
            elif name in VOID:
                continue
            elif closing:
                if places[name]:
                    close()
                    cut(places[name][-1])
            else:
                close()
                link = False
                if name in CLOSES:
                    nearest = max((places[x][-1] for x in CLOSES[name] if places[x]), default=0)
                    if nearest > max((places[x][-1] for x in SCOPES[name] if places[x]), default=-1) and nearest:
                        cut(nearest)
                elif name not in INLINE and stack[-1].name == "p":
                    cut(len(stack) - 1)
                top, own = stack[-1], _away(name, attributes)
                doubted = own and top.within and _in_doubt(name, attributes)
                if doubted and name in PARAGRAPHS:
                    own = doubted = False
                # a place in doubt has paths of its own, so that its ratios can be told from those of others
                path = self.paths.setdefault((top.path, f"{name}?" if doubted else name), len(self.paths) + 1)
                node = Node(len(self.nodes), name, path, top, own, own and HIDDEN.search(attributes) is not None, doubted)
                self.nodes.append(node)
                places[name].append(len(stack))
                stack.append(node)
        close()

    def held(self, chosen=lambda node: True) -> list[int]:
        """Characters of text below each node, of the blocks at chosen nodes."""
        out = [0] * len(self.nodes)
        for text, node, _ in self.blocks:
            if chosen(node):
                out[node.number] += len(text)
        for node in reversed(self.nodes[1:]):
            out[node.parent.number] += out[node.number]
        return out

    def inherited(self, own, start=None) -> list:
        """For each node ``own(node)`` or else its parent's value."""
        out = [start] * len(self.nodes)
        for node in self.nodes[1:]:
            found = own(node)
            out[node.number] = out[node.parent.number] if found is None else found
        return out


def keep_wrappers(page: Page) -> None:
    """Wrappers that hold most of the text are content after all, from the outermost inwards, until text is left.
    Wrappers of so much text lie in each other, so one walk inwards finds them."""
    articles = page.inherited(lambda n: True if n.name in ("article", "main") else None)
    counted = (lambda n: articles[n.number]) if any(articles[n.number] for _, n, _ in page.blocks) else (lambda n: True)
    held, nearest = page.held(counted), page.inherited(lambda n: n.number if n.own else None)
    total, direct = held[0], defaultdict(int)
    for text, node, _ in page.blocks:
        if counted(node):
            direct[nearest[node.number]] += len(text)
    outside = direct[None]
    for node in page.nodes[1:]:
        if node.own and held[node.number] >= WRAPPER * total > 0:
            if outside >= REST * total or node.name in NEVER or node.hidden:
                break
            node.own = False
            outside += direct[node.number]
    for node in page.nodes[1:]:
        node.away = node.own or node.parent.away


def path_scores(page: Page) -> tuple[dict[int, float], dict[int, list[int]]]:
    """The fused score of each path's ratios, and its totals: blocks, characters, punctuation and characters inside links."""
    totals: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for text, node, linked in page.blocks:
        if not node.away:
            t = totals[node.path]
            for i, v in enumerate((1, len(text), len(PUNCTUATION.findall(text)), min(linked, len(text)))):
                t[i] += v
    paths = list(totals)
    length = [totals[p][1] / totals[p][0] for p in paths]
    marks = [totals[p][2] / totals[p][0] for p in paths]

    def smooth(v: list[float]) -> list[float]:
        return [SMOOTH[0] * v[max(i - 1, 0)] + SMOOTH[1] * v[i] + SMOOTH[2] * v[min(i + 1, len(v) - 1)] for i in range(len(v))]

    return {p: a * (1 + b) * (1 - totals[p][3] / totals[p][1]) ** 2 for p, a, b in zip(paths, smooth(length), smooth(marks), strict=True)}, totals


def winning_paths(page: Page) -> tuple[set[int], dict[int, list[int]]]:
    """The paths whose score, weighed by how much text they hold, reaches the threshold, and the totals of each path."""
    ratios, totals = path_scores(page)
    fused = {p: v * totals[p][1] ** 0.5 for p, v in ratios.items()}
    limit = SHARE * max(fused.values(), default=0)
    return {p for p, v in fused.items() if v >= limit and v > 0}, totals


def settle_doubts(page: Page) -> None:
    """Places in doubt are tried as content: those go that have no path with a score like that of the best one, whatever
    amount of text they hold."""
    for node in page.nodes[1:]:
        node.away = node.own and not node.doubted or node.parent.away
    ratios, _ = path_scores(page)
    limit = SHARE * max(ratios.values(), default=0)
    like = page.held(lambda n: not n.away and ratios[n.path] >= limit and ratios[n.path] > 0)
    for node in page.nodes[1:]:
        if node.doubted and like[node.number]:
            node.own = False
        node.away = node.own or node.parent.away


def main_text(html: str | None) -> str:
    """The main text of a page; blocks are joined by an empty line."""
    page = Page(html or "")
    keep_wrappers(page)
    settle_doubts(page)
    chosen, totals = winning_paths(page)
    wins = lambda n: not n.away and n.path in chosen
    weight = page.held(wins)
    if not weight[0]:
        return ""
    # the deepest element around all winners, or the article around most of their text
    around = [n for n in page.nodes if weight[n.number] == weight[0]]
    content = around[-1]  # they lie in each other
    if any(n is content for _, n, _ in page.blocks if wins(n)) and content.parent is not None:
        content = content.parent
    whole = [n for n in page.nodes if n.name in ("article", "main") and weight[n.number] >= WRAPPER * weight[0]]
    content = whole[-1] if whole else content
    links = set() if whole else {p for p, t in totals.items() if t[3] >= 0.8 * t[1]} - chosen
    # whether a node lies in the content, and whether something but a header keeps it away there
    inside = page.inherited(lambda n: True if n is content else None, content is page.nodes[0])
    inside[content.number] = True
    barred = [False] * len(page.nodes)
    for n in page.nodes[1:]:
        barred[n.number] = n is not content and (n.own and n.name != "header" or barred[n.parent.number])
    out = []
    for text, node, _ in page.blocks:
        away = node.away
        if away and node.name in HEADING and not content.away:  # the article's own heading may stand in its header
            away = barred[node.number]
        if inside[node.number] and not away and node.path not in links:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to each page; ``html`` is dropped."""
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    src = pages.select(*rest, F.col(html).alias("_html"))
    schema = src.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return src.mapInArrow(run, schema)
