"""HTML pages to Markdown.

The parser is a stream of tags; elements without an end tag nest what follows,
as lenient parsers have it.  Local images are looked up by name; nothing is
fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# ---- fixed values
DROPPED = frozenset("script style nav footer head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("strong b em i span a".split())
MIN_TEXT, MAX_LEVEL, MAX_EM, PIXELS_PER_EM = 10, 3, 38, 16
IMAGE = '<img src="{src}" alt="{alt}" style="width: {em:.1f}em; max-width: 100%; display: block; margin: 0.5em 0;" />'
# ----


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if depth:
            del self.open[depth:]

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(Node("!", {"text": data}))


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


def nodes(root: Node) -> Iterator[Node]:
    """All elements in document order; the walk keeps its own stack, since unclosed elements nest deeply."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in DROPPED and x.tag != "!":
            stack += reversed(x.children)
    return "".join(out)


def _flat(text: str) -> str:
    return " ".join(text.split())


def items(body: Node, images: frozenset[str] = frozenset()) -> list[str]:
    out, stack = [], list(reversed(body.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.tag == "!":
            text = _flat(node if isinstance(node, str) else node.attrs["text"])
            out += [text] if len(text) >= MIN_TEXT else []
            continue
        tag = node.tag
        if tag in DROPPED:
            continue
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out += [f"{'#' * min(int(tag[1]), MAX_LEVEL)} {x}" for x in [_flat(text_of(node))] if x]
        elif tag == "p" or tag in INLINE:
            out += [x for x in [_flat(text_of(node))] if len(x) >= MIN_TEXT]
        elif tag in ("ul", "ol"):
            rows = [_flat(text_of(c)) for c in node.children if isinstance(c, Node) and c.tag == "li"]
            out += [f"{f'{n}.' if tag == 'ol' else '-'} {x}" for n, x in enumerate(rows, 1) if x]
        elif tag == "img":
            src = node.attrs.get("src") or ""
            if src.rsplit("/", 1)[-1] in images:
                width = node.attrs.get("width")
                out.append(IMAGE.format(src=f"images/{src.rsplit('/', 1)[-1]}", alt=node.attrs.get("alt") or "", em=min(float(width) / PIXELS_PER_EM, MAX_EM) if width and width.replace(".", "", 1).isdigit() else MAX_EM))
        elif tag == "figcaption":
            out += [f"*{x}*" for x in [_flat(text_of(node))] if x]
        elif tag == "table":
            out.append(f"```\n{text_of(node)}\n```")
        elif tag == "br":
            out.append("")
        else:
            stack += reversed(node.children)
    return out


def to_markdown(html: str, name: str, ref: str, images: frozenset[str] = frozenset()) -> str:
    root = parse(html)
    found = list(nodes(root))
    title = next((text_of(n).strip() for n in found if n.tag == "title"), name)
    body = next((n for n in found if n.tag == "body"), root)
    return "\n".join([f"# {title}\n", f"**Source:** {ref}\n", "", *(f"{x}\n" for x in items(body, images))])


def convert_pages(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html.  page_id, md and chars; a null html is empty, and the source is the url or, without one, the id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            md = [to_markdown(h or "", f"page-{i}", u or f"page-{i}") for i, u, h in zip(f["page_id"], f["url"], f["html"], strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "md": md, "chars": [len(m) for m in md]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, md string, chars long")
