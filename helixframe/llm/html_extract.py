"""Main-text extraction by tag-path ratios.

A page is read once, tag by tag, as browsers do: quotes only count after ``=``, end tags may be missing, an open ``head`` ends where the
body's content starts.  The tree of its block elements gives each text block a root-to-leaf tag path; an element's step on a path
is its tag with its class names.  For each distinct path, text length, punctuation, blocks and text inside links are summed over the page:

    ratio = log(1 + length / blocks) * (1 + log(1 + marks / blocks)) * share outside links

and fused with the path's share of the page's text.  Fused ratios are smoothed with those of the paths before and after in page
order that stand in the same container.  Paths that reach KEEP of the strongest one are content, and so is all that stands in
their containers (the element above; an article or main element around it; or one further out that adds little text).
On the level of the page itself, only text elements, not further divisions, belong to such a container.  A first heading is content.

Boilerplate elements are left out before: by tag (navigation, headers and footers outside the article, sidebars, forms, scripts, styles),
by whole class names, id or role (adverts, notices, comments of readers), hidden ones, and lists of links only.  An element that holds an
article, main or h1 element or most of the page's text is none, unless its name says that it holds readers' comments beside other text.

Inline tags neither end a block nor enter a path.  Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one line feed in page order.

Null, empty and blank pages give the empty text; a page without markup is one block.  A ``<`` that starts no tag is text.  Unclosed and
misnested tags never fail: an end tag without its start is ignored, and one with it closes what was opened since.  An inline element
that is boilerplate ends at its end tag or at the border of the block around it; without an end tag, at the next block's start.
An unclosed comment, script or style runs to the page's end, as in browsers.  Pages of any length are read whole in linear time; repeated rows give repeated
results; an empty table gives an empty one; columns not asked for are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of

#: Elements that hold no main text, elements whose content is not markup, void elements, inline elements, elements of the head.
DROP = frozenset("nav aside footer form button select textarea option iframe noscript template svg canvas object audio video map dialog menu title script style".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements of text, which belong to a page's own level.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption section center address details summary hgroup".split())
#: Words of a class, id or role that mark boilerplate, those that mark readers' comments, and words that say an element only concerns such a part.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar side menu navbar nav navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments reply replies"
    " respond disqus footer masthead toolbar pagination pager widget widgets search login skip hidden complementary contentinfo".split()
)
REPLIES = frozenset("comment comments reply replies respond disqus".split())
ABOUT = frozenset("has have no not non with without is are overflow hide show js can when if supports enable enabled disable disabled allow open closed layout template page single".split())
#: A p element is closed by the start of these.
ENDS_P = frozenset("p div ul ol dl table article section aside nav header footer h1 h2 h3 h4 h5 h6 form pre blockquote figure main hr address center details fieldset menu".split())
#: An element of the left kind is closed by a new one of the right kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "thead", "tbody", "tfoot"}, "td": {"td", "th", "tr", "thead", "tbody", "tfoot"}, "th": {"td", "th", "tr", "thead", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option"},
}
CLOSERS = frozenset().union(*CLOSES.values())
#: Elements that such a start does not reach over.
SCOPES = frozenset("ul ol dl table select div article section main".split())
#: Share of the strongest path's ratio that makes a path content; share of a neighbour in a smoothed ratio; share of its text that a container may gain by growing.
KEEP, SMOOTH, GROW = 0.12, 0.25, 0.25
#: Mean length up to which links that are all of a list's text are a menu.
MENU_LINK = 40

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，！？]")


def tokens(page: str):
    """(tag, whether it ends an element, attributes, start, end) of each tag, in order; raw contents are skipped with their start tag."""
    at, n, quotes = 0, len(page), True
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            return
        c = page[at + 1]
        if c == "!" or c == "?" or (c == "/" and at + 2 < n and not page[at + 2].isascii()):
            if page.startswith("<!--", at):
                end = at + 5 if page.startswith("<!-->", at) else at + 6 if page.startswith("<!--->", at) else page.find("-->", at + 4) + 3
                end = n if end == 2 else end
            else:
                end = page.find(">", at) + 1
                if not end:  # no tag can follow
                    return
            yield None, False, "", at, end
            at = end
            continue
        ends = c == "/"
        name = _NAME.match(page, at + 1 + ends) if c.isascii() else None
        if name is None:
            at += 1
            continue
        stop = None
        if quotes:
            stop = _QUOTED.match(page, name.end())
            quotes = stop is not None  # else some quote would take in the rest of the page: none counts from here on
        end = stop.end() if stop else page.find(">", name.end()) + 1
        if not end:  # no tag can follow
            return
        tag = name[0].lower()
        attributes = page[name.end() : end - 1]
        start, at = at, end
        if not ends and tag in RAW:
            raw = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, end)
            if raw or tag in ("script", "style"):
                at = raw.end() if raw else n
        yield tag, ends, attributes, start, at


def _mark(words: list[str]) -> int:
    """2 if the words of a name are of readers' comments, 1 if of other boilerplate, else 0."""
    found = NOISE.intersection(words)
    if not found or len(words) > 1 and not ABOUT.isdisjoint(words):  # "has-sidebar" is no sidebar
        return 0
    return 2 if REPLIES & found else 1


def _said(attributes: str) -> tuple[str, int]:
    """The class names without digits, and the mark of an element's attributes."""
    names, mark = "", 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            names = " ".join(sorted({_DIGITS.sub("", x) for x in value.split()}))
        if key in ("class", "id", "role"):
            mark = max(mark, max((_mark([w.lower() for w in _WORD.findall(x)]) for x in value.split()), default=0))
        elif key == "hidden" and value.lower() != "false" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            mark = max(mark, 1)
    return names, mark


class Tree:
    """Block elements, and inline ones that are boilerplate, in the order of their start tags: parent, tag, path and mark; and the text blocks.

    A block is (element, pieces), a piece (raw text, element that it stands in, number of its link or 0).
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.mark, self.inline = [-1], [""], [0], [0], [False]
        self.above, self.step = [0], [""]  # of each path: the path above, and the tag of its last step
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, list]] = []
        self._read(page, list(tokens(page)))

    def _add(self, parent: int, tag: str, names: str, mark: int, inline: bool) -> int:
        path = self.path[parent]
        if not inline:
            key = (path, f"{tag} {names}")
            if key not in self.known:
                self.known[key] = len(self.above)
                self.above.append(path)
                self.step.append(tag)
            path = self.known[key]
        for column, value in ((self.parent, parent), (self.tag, tag), (self.path, path), (self.mark, mark), (self.inline, inline)):
            column.append(value)
        return len(self.parent) - 1

    def _read(self, page: str, found: list) -> None:
        ended, waiting = set(), {}  # inline start tags that have an end tag of their own
        for k, (tag, ends, *_) in enumerate(found):
            if tag in INLINE:
                if not ends:
                    waiting.setdefault(tag, []).append(k)
                elif waiting.get(tag):
                    ended.add(waiting[tag].pop())
        # The stack holds (tag, element, kind): a block; an inline element; or one that is boilerplate up to its end tag, blocks inside too.
        BLOCK, RUN, SPAN = 0, 1, 2
        stack: list[tuple[str, int, int]] = []
        open_: dict[str, list[int]] = {}  # places in the stack by tag
        floors: list[int] = []  # places of the blocks
        links, link, pieces, at = [], 0, [], 0

        def close():
            nonlocal pieces
            if pieces:
                self.blocks.append((stack[floors[-1]][1] if floors else 0, pieces))
                pieces = []

        def pop(k: int):
            while len(stack) > k:
                tag, _, kind = stack.pop()
                open_[tag].pop()
                if kind == BLOCK:
                    floors.pop()
                if tag == "a":
                    links.pop()

        def push(tag: str, element: int, kind: int):
            nonlocal link
            open_.setdefault(tag, []).append(len(stack))
            if kind == BLOCK:
                floors.append(len(stack))
            if tag == "a":
                link += 1
                links.append(link)
            stack.append((tag, element, kind))

        def over_block(k: int) -> bool:
            return bool(floors) and floors[-1] >= k

        for k, (tag, ends, attributes, start, end) in enumerate([*found, (None, False, "", len(page), len(page))]):
            if start > at:
                raw = page[at:start]
                if open_.get("head") and not raw.isspace():
                    close()
                    pop(open_["head"][-1])
                pieces.append((raw, stack[-1][1] if stack else 0, links[-1] if links else 0))
            at = end
            if tag is None:
                continue
            if ends:
                place = open_[tag][-1] if open_.get(tag) else -1
                if tag in ("html", "body"):
                    continue
                if place < 0:
                    if tag == "p":
                        close()
                elif tag not in INLINE:
                    close()
                    pop(place)
                elif not over_block(place):
                    pop(place)
                elif stack[place][2] == SPAN:
                    close()
                    pop(place)
                continue  # an inline end tag that would close a block is misnested, ignored
            if open_.get("head") and tag not in HEAD:  # the head ends where content starts
                close()
                pop(open_["head"][-1])
            if tag in INLINE:
                if tag not in VOID:
                    if tag == "a" and open_.get("a") and not over_block(open_["a"][-1]):  # a link ends where the next one starts
                        pop(open_["a"][-1])
                    above, mark = stack[-1][1] if stack else 0, _said(attributes)[1] if attributes else 0
                    if mark and not self.inline[above]:
                        push(tag, self._add(above, tag, "", mark, True), SPAN if k in ended else RUN)
                    else:
                        push(tag, above, RUN)
                continue
            if tag == "br" and stack and self.inline[stack[-1][1]]:
                continue
            close()
            if tag in RAW or tag in VOID:
                if tag != "hr":
                    continue
            if tag in ENDS_P and floors and stack[floors[-1]][0] == "p":
                pop(floors[-1])
            if tag in CLOSERS:
                for j in reversed(floors):
                    if tag in CLOSES.get(stack[j][0], ()):
                        pop(j)
                        break
                    if stack[j][0] in SCOPES:
                        break
                while floors and tag in CLOSES.get(stack[floors[-1]][0], ()):  # a row with its cell, a group with its row
                    pop(floors[-1])
            if tag in VOID or tag in ("html", "body") and open_.get(tag):
                continue
            while stack and stack[-1][2] == RUN:  # an inline element does not reach over a block's start
                pop(len(stack) - 1)
            names, mark = _said(attributes) if attributes else ("", 0)
            if tag in ("html", "body") or tag in ("article", "main") and mark == 1:
                mark = 0
            if tag in DROP or tag == "header" and not (open_.get("article") or open_.get("main")):
                mark = max(mark, 1)
            push(tag, self._add(stack[-1][1] if stack else 0, tag, names, mark, False), BLOCK)
        close()


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def _solid(text: str) -> int:
    """Characters without spaces and the marks between links."""
    return len(text) - sum(map(text.count, " |/·•»«›‹"))


def _menu(links: int, linked: int, plain: int) -> bool:
    """Whether text is a list of short links only."""
    return links > 1 and 9 * plain <= linked <= MENU_LINK * links


def _boilerplate(tree: Tree, sizes: list[list[tuple[int, int]]], menus: bool) -> list[bool]:
    """Whether each element is boilerplate or stands in it; sizes: characters, and those without spaces, of each block's pieces."""
    n = len(tree.parent)
    size, linked, links, plain, core, titles = ([0] * n for _ in range(6))
    for (_, pieces), known in zip(tree.blocks, sizes, strict=True):
        last = 0
        for (_, e, link), (long, solid) in zip(pieces, known, strict=True):
            size[e] += long
            if link:
                linked[e] += solid
                links[e] += link != last and solid > 0
                last = link
            else:
                plain[e] += solid
    for e in range(n - 1, 0, -1):
        p = tree.parent[e]
        core[e] += tree.tag[e] in ("article", "main") and not tree.mark[e]
        titles[e] += tree.tag[e] == "h1"
        for column in (size, linked, links, plain, core, titles):
            column[p] += column[e]
    gone = [False] * n
    for e in range(1, n):
        tag, mark = tree.tag[e], tree.mark[e]
        if gone[tree.parent[e]]:
            gone[e] = True
        elif mark:
            if core[0]:
                holds = core[e] == core[0]
            else:
                title = titles[e] == titles[0] > 0 and tag not in ("header", "nav", "footer", "aside")
                holds = title or (2 * plain[e] > plain[0] + linked[0] if mark == 1 else size[e] == size[0])
            gone[e] = not holds
        elif menus and tag not in ("html", "body", "article", "main"):
            gone[e] = _menu(links[e], linked[e], plain[e])
    return gone


def _parts(tree: Tree, menus: bool) -> list[tuple[int, str, int]]:
    """(path, text, characters in links) of each block that is no boilerplate, in page order."""
    sizes = [[(len(t), _solid(t)) for t in (clean(raw) for raw, _, _ in pieces)] for _, pieces in tree.blocks]
    gone, found = _boilerplate(tree, sizes, menus), []
    for (e, pieces), known in zip(tree.blocks, sizes, strict=True):
        kept = [(*piece, *size) for piece, size in zip(pieces, known, strict=True) if not gone[piece[1]]]
        text = "" if gone[e] and not tree.inline[e] else clean("".join(raw for raw, *_ in kept))
        if text:
            linked = sum(solid for _, _, link, _, solid in kept if link)
            plain = sum(solid for _, _, link, _, solid in kept if not link)
            if not (menus and _menu(len({link for _, _, link, _, solid in kept if link and solid}), linked, plain)):
                found.append((tree.path[e], text, min(len(text), sum(long for _, _, link, long, _ in kept if link))))
    return found


def extract(page: str) -> str:
    """The main text of a page."""
    tree = Tree(page)
    parts = _parts(tree, True) or _parts(tree, False)  # a page of links only is no menu
    if not parts:
        return ""
    # Sums and ratios of each path over the page.
    order: dict[int, int] = {}
    chars, marks, count, links = [], [], [], []
    for path, text, linked in parts:
        k = order.setdefault(path, len(order))
        if k == len(chars):
            for column in (chars, marks, count, links):
                column.append(0)
        for column, value in ((chars, len(text)), (marks, len(_PUNCTUATION.findall(text))), (count, 1), (links, linked)):
            column[k] += value
    total, paths = sum(chars), list(order)
    ratio = [math.log1p(c / t) * (1 + math.log1p(m / t)) * (1 - a / c) for c, m, t, a in zip(chars, marks, count, links, strict=True)]
    fused = [r * math.sqrt(c / total) for r, c in zip(ratio, chars, strict=True)]
    smooth = []
    for k, path in enumerate(paths):
        near = [fused[j] if 0 <= j < len(paths) and tree.above[paths[j]] == tree.above[path] else fused[k] for j in (k - 1, k + 1)]
        smooth.append((1 - 2 * SMOOTH) * fused[k] + SMOOTH * sum(near))
    top = max(smooth)
    strong = {p for p, s in zip(paths, smooth, strict=True) if s >= KEEP * top}
    # A path has a higher number than the one above it: one pass up sums the text below each, passes down carry what stands above.
    n = len(tree.above)
    below, heart, holds, inside = [0] * n, [0] * n, [False] * n, [False] * n
    for p, k in order.items():
        below[p] += chars[k]
    for p in range(n - 1, 0, -1):
        below[tree.above[p]] += below[p]
    page_level = [step in ("", "html", "body") for step in tree.step]
    for p in range(1, n):
        heart[p] = p if tree.step[p] in ("article", "main") else heart[tree.above[p]]
    for p in strong:
        q = heart[p] or tree.above[p]
        while not page_level[q] and not page_level[tree.above[q]] and below[tree.above[q]] <= (1 + GROW) * below[q]:
            q = tree.above[q]
        holds[q] = True
    inside[0] = holds[0]
    for p in range(1, n):
        q = tree.above[p]
        inside[p] = holds[p] or p in strong or inside[q] and (not page_level[q] or page_level[p] or tree.step[p] in TEXT)
    for p, k in order.items():  # a division of links only is no text
        inside[p] &= links[k] < chars[k] or tree.step[p] in TEXT or p in strong
    return "\n".join(text for path, text, _ in parts if inside[path] or tree.step[path] == "h1")


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars) for each row of pages."""
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [extract(t.decode()) for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return arrow_map(source, run, schema)
