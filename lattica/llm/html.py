"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, half as many to the second and fewer further up; an
ancestor's points are discounted by the part of its text inside links. The best container, with the siblings that belong to
it, is the article; its blocks in page order are the text. Elements that are no article text (menus, forms, asides) are left
out of the tree; a name in class, id or role only tells against a part of the page, and a part that holds most of the page's
text stays whatever its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import by_value, small_batches, table

by_value(__name__)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The rest of a tag: without quotes, or with quoted values after "="; a quote elsewhere, or one that nothing closes, is a character.
_PLAIN = re.compile(r"""([^>"']*+)>""")
_QUOTED = re.compile(r"""((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>"'=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_COMMENT_END = re.compile(r"--!?>")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAMES = re.compile(r"[A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("noscript template nav footer aside form button select option datalist dialog menu svg math canvas object audio video head map fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li div section article main".split())
#: Words of class, id and role names that tell against a part of the page.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies dialog footer header login masthead menu modal nav navbar navigation newsletter notice overlay pagination paywall popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
COMMENTS = frozenset("comment comments disqus replies".split())
#: An open element that a start tag of the key's kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAST = 25  # characters of a paragraph that gives points


class Node:
    __slots__ = ("above", "children", "closed", "commas", "inline", "kind", "links", "net", "points", "size", "tag")

    def __init__(self, tag: str, above: Node | None, kind: str = "") -> None:
        self.tag, self.above, self.kind, self.closed = tag, above, kind, False
        self.children: list = []  # Nodes and texts
        self.points, self.size, self.links, self.net = 0.0, 0, 0, 0
        self.commas = self.inline = 0  # of the text that is not in blocks below


def kind_of(tag: str, attributes: str, inside_article: bool) -> str:
    """``dropped`` for what is no article text by its element or is hidden, ``comments`` or ``unlikely`` by its names, or empty."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return "dropped"
    if not attributes or tag in ("html", "body"):
        return ""
    kind = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return "dropped"
        if name in ("class", "id", "role"):
            words = {x.lower() for x in _NAMES.findall(value)}
            if not COMMENTS.isdisjoint(words):
                kind = "comments"
            elif not kind and not UNLIKELY.isdisjoint(words):
                kind = "unlikely"
    return kind


def tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, whether it closes, attributes) of each tag, the last with an empty name. Comments and what is inside
    raw elements are left out, and so is a tag that the page doesn't end. Each character is looked at a bounded number of times."""
    at, text, last, quotes = 0, [], html.rfind(">"), True
    while True:
        begin = html.find("<", at)
        if begin < 0:
            yield "".join([*text, html[at:]]), "", False, ""
            return
        text.append(html[at:begin])
        m = _NAME.match(html, begin + 1)
        if m and m.end() <= last:
            rest = _PLAIN.match(html, m.end()) or quotes and _QUOTED.match(html, m.end())
            if not rest:
                quotes = False
                rest = re.compile("([^>]*+)>").match(html, m.end())
            tag, at = m[2].lower(), rest.end()
            if not m[1] and tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = (html.find(">", end.start()) + 1 or len(html)) if end else len(html)
                continue
            yield "".join(text), tag, bool(m[1]), rest[1]
            text = []
        elif m:
            at = len(html)
        elif html.startswith("<!--", begin):
            end = _COMMENT_END.search(html, begin + 2)
            at = end.end() if end else len(html)
        elif html[begin + 1 : begin + 2] in ("!", "?", "/"):
            at = html.find(">", begin) + 1 or len(html)
        else:
            text.append("<")
            at = begin + 1


def parse(html: str) -> Node:
    """Tree of the page. Unclosed and crossed tags are mended as browsers do in the main: a block start closes an open paragraph
    with all that is in it, an end tag closes up to its element, and without one is void."""
    root = Node("html", None)
    stack, articles = [root], 0
    open_tags: dict[str, int] = {}

    def pop() -> Node:
        nonlocal articles
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        articles -= gone.tag in ("article", "main")
        return gone

    def close(tag: str) -> None:
        while stack[-1].tag != tag:
            pop()
        pop().closed = True

    for text, tag, closing, attributes in tags(html):
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not tag:
            return root
        if closing:
            if open_tags.get(tag):
                close(tag)
            continue
        if tag == "br":
            stack[-1].children.append("\n")
            continue
        if tag in BLOCKS or tag == "body":
            for open_tag in ("head", "p"):
                if open_tags.get(open_tag):
                    close(open_tag)
        if tag in CLOSES:
            for k in range(len(stack) - 1, max(len(stack) - 8, 0), -1):
                if stack[k].tag in CLOSES[tag]:
                    while len(stack) > k:
                        pop().closed = True
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            if tag == "hr":
                stack[-1].children.append(Node("hr", stack[-1]))
            continue
        node = Node(tag, stack[-1], kind_of(tag, attributes, articles > 0))
        stack[-1].children.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        articles += tag in ("article", "main")
    return root


def prune(root: Node) -> None:
    """Take out what is no article text. Text outside links decides: an unlikely part, or an element that was never closed, goes
    unless it holds half of the page's and no article is elsewhere; comments go unless there is next to nothing else; if nothing would stay, names don't count."""
    nodes = _order(root)
    inside, articles, around = {}, {}, {id(root): 0}
    for node in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if isinstance(c, Node)]
        inside[id(node)] = 0 if node.tag == "a" else own + sum(inside[id(c)] for c in below)
        node.net = 0 if node.tag == "a" else own + sum(c.net for c in below if not (c.kind == "dropped" and c.closed or c.kind == "comments"))
        articles[id(node)] = sum(articles[id(c)] for c in below) + (node.tag in ("article", "main") and node.net > 0)
    for node in nodes[1:]:
        around[id(node)] = around[id(node.above)] + (node.above.tag in ("article", "main") and node.above.net > 0)
    total = root.net

    def goes(c: Node, names: bool) -> bool:
        if c.kind == "dropped" and c.closed:
            return True
        if c.kind == "comments":
            return names and 10 * total >= inside[id(c)]
        return (c.kind == "dropped" or names and c.kind == "unlikely") and (2 * c.net < total or articles[id(root)] > articles[id(c)] + around[id(c)])

    left = {}
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        left[id(node)] = own + sum(left[id(c)] for c in node.children if isinstance(c, Node) and not goes(c, True))
    names = left[id(root)] > 0
    for node in nodes:
        # a dropped block still parts the text around it
        node.children = [Node("hr" if c.tag in BLOCKS else "span", node) if isinstance(c, Node) and goes(c, names) else c for c in node.children]


def _order(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def score(root: Node) -> list[Node]:
    """Set size, links and points of all nodes; gives those with points."""
    nodes = _order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.size += (n := len(" ".join(c.split())))
                node.inline += n
                node.commas += c.count(",") + c.count("、") + c.count("，")
        if node.tag == "a":
            node.links = node.size
        if node.above is not None:
            node.above.size += node.size
            node.above.links += node.links
            if node.tag not in BLOCKS:
                node.above.inline += node.inline
                node.above.commas += node.commas
        if node.tag in PARAGRAPHS and node.inline >= LEAST:
            points = 1 + node.commas + min(node.inline / 100, 3)
            up, depth = node.above or node, 1
            if node.tag in ("div", "section", "article", "main"):
                up = node
            while up is not None and depth <= 5:
                up.points += points / depth if depth < 3 else points / (3 * depth)
                up, depth = up.above, depth + 1
    return [n for n in nodes if n.points > 0]


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def content(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    scored = score(root)
    if not scored:
        articles = [n for n in _order(root) if n.tag in ("article", "main")]
        return articles[:1] or [root]
    value = {id(n): n.points * (1 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: value[id(n)])
    # an article around the best container stays whole if what it adds is no heap of links
    mass = lambda n: (n.size - n.links) * (1 - _density(n))
    up, least = best, mass(best)
    while up is not None:
        if up.tag in ("article", "main") and mass(up) >= least:
            best = up
        up = up.above
    if best.above is None or best.tag == "body":
        return [best]
    if best.tag not in ("article", "main"):
        # children of one parent that share the points are parts of one article
        peers = [c for c in best.above.children if isinstance(c, Node) and value.get(id(c), 0) >= 0.6 * value[id(best)]]
        if len(peers) >= 3 and best.above.tag != "html":
            return [best.above]
    least = max(10.0, 0.2 * value.get(id(best), 0.0))
    out = []
    for c in best.above.children:
        if isinstance(c, Node):
            prose = c.tag == "p" and c.size >= 80 and _density(c) < 0.25
            if c is best or value.get(id(c), 0) >= least or prose or c.tag == "h1" and best.tag != "article":
                out.append(c)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks, white space made one space. Where the whole page is the container, lists and tables that are mostly
    links are left out, as they are menus there."""
    out: list[str] = []
    run: list[str] = []
    whole = any(n.tag in ("html", "body") for n in nodes)

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [x for n in reversed(nodes) for x in (None, n, None)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        else:
            if whole and x.tag in ("ul", "ol", "table", "dl") and x.size and _density(x) > 0.6:
                continue
            inside = list(reversed(x.children))
            todo += [None, *inside, None] if x.tag in BLOCKS else inside
    flush()
    return out


def extract(html: str | None) -> str:
    """Main text of a page; empty if there is none, as for null and empty pages."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n".join(blocks(content(root)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages(page_id, url, html)``; rows are independent of each other."""
    small_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all pages."""
    return extracted(table(spark, sf_dir, "pages"))
