"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every element gets the characters, tags, link characters and link tags below it, and
from them its composite density: characters per tag, weighed by the share of text in links as against the whole body (a
body without any link has nothing to weigh by: characters per tag alone). A block's density sum adds up the densities of the
blocks and loose texts right below it; a block that holds no others has its own density. The lowest density on the path
from the block of the largest sum up to the body is the threshold, and every block at or above it gives its subtree of
the largest sum, unless that sum is below SHARE of the largest: these, in page order, are the main text, each with the heading
that stands right before it. Elements inside a line are tags, and links, but no subtrees to choose, as that would cut a block in two.
The tags article and main are blocks as others are.

Tags and names (of class, id and role) only help: blocks in an element that they mark as a menu, comments or the like count
MARKED of their sums when the block of the largest sum is first looked for. What that block stands in, and what holds MOST of the
page's text, is not marked after all, if it has LEAST characters outside links; the other marked elements leave the tree,
and densities are taken anew. A name is judged by the word that it ends in (reader-comments, not comments-open).
Pages are apart from each other, so this is one Arrow function over a column: no shuffle. Every step takes time in
proportion to the page, whatever is unclosed in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A block beside the block of the largest sum has at least this share of that sum.
SHARE = 0.25
#: What a sum counts for in a marked element; the share of the page's text, and the characters outside links, from which marks say nothing.
MARKED, MOST, LEAST = 0.1, 0.9, 200
#: Elements without an end tag, those whose content is not markup, those that show no text, those that mostly are not content, those that break a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe xmp noembed noframes template svg math".split()
NEVER = set("script style textarea title noscript iframe template svg math head button select option object canvas audio video map label input datalist".split())
ASIDE = set("nav header footer aside form menu dialog fieldset".split())
BLOCK = set("address article blockquote body dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption center".split())
#: Words of class, id and role that mark what mostly is not the article; words behind them that say nothing.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related recommended recommendations trending footer header masthead toolbar topbar social share sharing comment comments disqus respond reply replies "
    "complementary contentinfo search".split()
)
FRAME = set("container wrapper wrap box inner outer area section block list bar panel group item items link links slot unit zone row col column holder module component content body main top bottom left right text title form".split())
#: Words by which a class says what its element goes with, not what it is.
ABOUT = {"with", "without", "has", "no"}
#: End tags that a start tag implies.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in BLOCK - {"body", "html", "li", "dt", "dd", "tr", "td", "th"}}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("article aside body div section main table ul ol dl td th blockquote nav header footer form".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("chars", "density", "kids", "link_chars", "link_tags", "marked", "parent", "sum", "tag", "tags", "text", "top")

    def __init__(self, tag: str, parent: _Node | None, text: str | None = None):
        self.tag, self.parent, self.kids, self.text, self.top = tag, parent, [], text, self
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.marked = False


def _hidden(attributes: str) -> bool:
    for name, *values in _ATTR.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag or a name of it says that it mostly is not content. An article's own header is content."""
    if tag in ASIDE and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, *values in _ATTR.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        for token in "".join(values).split():
            words = [w.lower() for w in _WORD.findall(token)]
            if tag in ("article", "main"):  # those only by a name that is a mark and nothing else
                words = words if len(words) == 1 else []
            while len(words) > 1 and words[-1] in FRAME:
                words.pop()
            if words and words[-1] in MARKS and not ABOUT & set(words):
                return True
    return False


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kinds: text, start, end. Comments, declarations and raw contents are left out.

    A tag ends at the first > outside quotes. Once a tag has no such end, quotes are taken for ordinary characters from
    there on, and what has no > after it is text; so no part of a page is searched more than a few times.
    """
    place, quotes, last = 0, True, page.rfind(">")
    begin = 0
    while (at := page.find("<", place)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield "text", page[begin:at], ""
            begin = place = end + 3 if end >= 0 else len(page)
            continue
        m = _NAME.match(page, at + 1)
        if at > last or not m and page[at + 1 : at + 2] not in ("!", "?", "/"):
            place = at + 1
            continue
        k = m.end() if m else at + 1
        end = page.find(">", k)
        if m and quotes:
            while (stop := _STOP.search(page, k)) and stop[0] != ">":
                closing = page.find(stop[0], stop.end())
                k = closing + 1 if closing >= 0 else len(page)
            quotes = stop is not None
            end = stop.start() if stop else end
        yield "text", page[begin:at], ""
        begin = place = end + 1
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, ""
            continue
        yield "start", name, page[m.end() : end]
        if name in _ENDS:
            close = _ENDS[name].search(page, place)
            yield "end", name, ""
            begin = place = close.end() if close else len(page)
    yield "text", page[begin:], ""


def _tree(page: str) -> _Node:
    """The tree of elements and texts, without those that show none. End tags that fit nothing open are passed over.

    Where elements of a name are open is kept in a list for each name, so that an end tag finds its element at once.
    """
    root = _Node("html", None)
    path, at_tag, scopes = [root], {}, [0]  # open elements; their places in it by name; places of those that implied ends stop at
    left_out: list[_Node] = []  # elements that are never content; they close as any other does, then they go

    def close(place: int) -> None:
        while len(path) > place:
            gone = path.pop()
            at_tag[gone.tag].pop()
            if scopes[-1] == len(path):
                scopes.pop()

    for kind, name, attributes in _pieces(page):
        if kind == "text":
            if name:
                path[-1].kids.append(_Node("#", path[-1], name))
        elif kind == "end":
            if places := at_tag.get(name):
                close(places[-1])
        elif name not in ("html", "body"):
            if ends := CLOSES.get(name):
                open_at = max((at_tag[e][-1] for e in ends if at_tag.get(e)), default=0)
                if open_at > 0 and open_at >= scopes[-1]:
                    close(open_at)
            node = _Node(name, path[-1])
            path[-1].kids.append(node)
            if name in NEVER or _hidden(attributes):
                left_out.append(node)
                if attributes.endswith("/"):
                    continue
            node.marked = _marked(name, attributes, bool(at_tag.get("article") or at_tag.get("main")))
            if name not in VOID:
                at_tag.setdefault(name, []).append(len(path))
                if name in SCOPE:
                    scopes.append(len(path))
                path.append(node)
    for node in left_out:
        _empty(node)
    return root


def _empty(node: _Node) -> None:
    """The element stays as a place between texts, and as a block if it is one."""
    node.kids = []
    if node.tag not in BLOCK:
        node.tag, node.text = "#", ""


def composite(chars: int, tags: int, link_chars: int, link_tags: int, whole: float) -> float:
    """Composite text density; whole: the body's share of characters in links. Counts of nothing are taken for one."""
    if not chars:
        return 0.0
    per_tag = chars / max(tags, 1)
    if not whole:
        return per_tag
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + whole * chars + math.e)
    return per_tag * math.log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0)) / math.log(base)


def _measure(root: _Node) -> list[_Node]:
    """Counts, densities, density sums and the best subtree of every block; the blocks, parents before children. No recursion, so depth does not matter."""
    order = [root]
    for node in order:
        order.extend(node.kids)
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(order):
        if node.text is not None:
            node.chars = len(node.text) - sum(map(node.text.count, " \t\n\r"))
        elif node.tag == "a":
            node.link_chars, node.link_tags = node.chars, 1
        if up := node.parent:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.tags += node.tags + (node.text is None)
    whole = root.link_chars / max(root.chars, 1)
    blocks = {id(n) for n in order if n.text is None and (n.tag in BLOCK or n is root)}
    for n in reversed(order):  # a link or the like around blocks is a block too
        if id(n) in blocks and n.parent is not None:
            blocks.add(id(n.parent))
    found = [n for n in order if id(n) in blocks]
    for n in reversed(found):
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, whole)
        inner = [k for k in n.kids if id(k) in blocks]
        loose = [k for k in n.kids if id(k) not in blocks]
        if inner:
            add = lambda name: sum(getattr(k, name) for k in loose)  # noqa: B023, E731
            n.sum = sum(k.density for k in inner) + composite(add("chars"), add("tags") + sum(k.text is None for k in loose), add("link_chars"), add("link_tags"), whole)
        else:
            n.sum = n.density
        n.top = max((n, *(k.top for k in inner)), key=lambda x: x.sum)
    return found


def _without_marked(root: _Node) -> None:
    """Empty what is marked, but for what the text says is the main text all the same."""
    blocks = _measure(root)
    inside, marked, best, most = set(), [], None, 0.0
    for n in blocks:  # parents before children
        if n.marked or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        if n.chars and (weighed := n.sum * (MARKED if id(n) in inside else 1.0)) > most:
            best, most = n, weighed
    holding = set()
    while best is not None:
        holding.add(id(best))
        best = best.parent
    stack = [root]
    while stack:
        n = stack.pop()
        if n.marked and not (n.chars - n.link_chars >= LEAST and (id(n) in holding or n.chars >= MOST * root.chars)):
            marked.append(n)
        else:
            stack.extend(n.kids)
    for n in marked:
        _empty(n)


def _main(root: _Node) -> list[_Node]:
    """The blocks of the main text, in page order."""
    _without_marked(root)
    blocks = [n for n in _measure(root) if n.chars]
    if not blocks:
        return []
    threshold, at = math.inf, root.top
    while at is not None:
        threshold = min(threshold, at.density)
        at = at.parent
    least = SHARE * root.top.sum
    chosen = {id(n.top): n.top for n in blocks if n.density >= threshold and n.density > 0 and n.top.sum >= least} or {id(root): root}
    holding = set(chosen)
    for n in chosen.values():
        while (n := n.parent) is not None and id(n) not in holding:
            holding.add(id(n))
    kept, stack = [], [root]
    while stack:
        n = stack.pop()
        if id(n) in chosen:
            kept.append(n)
            continue
        for k, after in zip(n.kids[::-1], [None, *_next_with_text(n.kids)], strict=False):
            if id(k) in holding or k.tag in HEADING and k.chars and after is not None and id(after) in holding:
                if id(k) not in holding:
                    chosen[id(k)] = k
                stack.append(k)
    return kept


def _next_with_text(kids: list[_Node]) -> Iterator[_Node | None]:
    """For each of kids but the last, from behind: the next after it that has text and is no heading."""
    after = None
    for k in kids[:0:-1]:
        after = k if k.chars and k.tag not in HEADING else after
        yield after


def _blocks(top: _Node) -> str:
    """Texts below top: references decoded, white space as one space, a line for each block."""
    pieces: list[str] = []
    stack: list = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif x.text is not None:
            pieces.append(_SPACE.sub(" ", html.unescape(x.text)))
        elif x.tag == "br":
            pieces.append(" ")
        else:
            stack.extend(["\n"] * (x.tag in BLOCK) + x.kids[::-1] + ["\n"] * (x.tag in BLOCK))
    lines = ("".join(pieces)).split("\n")
    return "\n".join(y for y in (_SPACE.sub(" ", x).strip() for x in lines) if y)


def main_text(page: str | None) -> str:
    """The main text of one page; empty for a null, empty or text-free page."""
    if not page:
        return ""
    return "\n".join(y for x in _main(_tree(page)) if (y := _blocks(x)))


def extracted(page: Column) -> Column:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract(page)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars (code points).

    Null, empty and text-free pages give an empty text. Unclosed and misplaced tags are borne; pages of any length and
    depth are read whole. What leaves by a tag or a name has less than LEAST characters outside links, or neither the block
    of the largest weighed sum nor MOST of the text. Rows that repeat are extracted each; columns of pages named text or n_chars,
    in any case of letters, give way. An empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    return pages.select(*kept, extracted(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
