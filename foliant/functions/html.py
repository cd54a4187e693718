"""Web pages to Markdown: a tree from the standard library's parser, cleaned, retagged and rendered.

``parse_page`` is a vectorised function of one row and shuffles nothing. What is particular to a site (where the article
stands, what is junk) is a ``Template``. A page that doesn't fit it gives a row with ``error``. The parser does not repair
broken markup the way browsers do: an element stays open until its end, a new sibling of its kind, or its parent's end.
Elements nested deeper than ``DEEPEST`` become siblings. A cell spans at most ``WIDEST_SPAN`` columns or rows, the limit that
browsers have for columns: a page can't ask for a table of any size. Null and empty pages are errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

DEEPEST = 200
WIDEST_SPAN = 1000
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: Elements without an end, and what a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Node:
    """An element; comments have the tag ``!``. Children are nodes and strings."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for kid in self.kids:
            if isinstance(kid, Node):
                yield from kid.walk()

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    @property
    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node) and k.tag != "!"]

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else "" if k.tag == "!" else k.text() for k in self.kids)

    def prune(self, junk: Callable[[Node], bool]) -> None:
        """Take out the nodes below that are junk; text after them stays."""
        kept: list[Node | str] = []
        for kid in self.kids:
            if isinstance(kid, Node):
                if junk(kid):
                    continue
                kid.prune(junk)
                kept.append(kid)
            elif kept and isinstance(kept[-1], str):
                kept[-1] += kid
            else:
                kept.append(kid)
        self.kids = kept


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def _imply_ends(self, tag):
        if tag in _P_ENDS:
            names = [n.tag for n in self.open]
            if "p" in names and not {"table", "td", "li"} & set(names[len(names) - names[::-1].index("p") :]):
                self._close("p")
        ends, keeps = _ENDS.get(tag, ()), _KEEPS.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in keeps:
                break
            if self.open[i].tag in ends:
                del self.open[i:]

    def _close(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        kids = self.open[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data):
        self.open[-1].kids.append(Node("!"))


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# -- rendering ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """How an element is written: ``render`` gets it with its content; a block stands apart from what is around it."""

    block: bool
    render: Callable[[Node, str], str]


RULES: dict[str, Rule] = {}


def rule(*tags: str, block: bool):
    """Registers a renderer for some tags; this is how users add their own."""

    def put(render: Callable[[Node, str], str]):
        for tag in tags:
            RULES[tag] = Rule(block, render)
        return render

    return put


def spaced(text: str) -> str:
    """White space as single spaces; a literal ``<`` is escaped."""
    return _SPACE.sub(" ", text).replace("<", "\\<")


def apart(before: str, after: str) -> str:
    return f"{before.rstrip()}\n\n{after.lstrip()}"


def flow(node: Node) -> str:
    """Content of an element.

    A block begins apart from what stands before it, and so does whatever element follows a heading; text after a block
    stands apart from the block.
    """
    out, last = "", None
    for kid in node.kids:
        if isinstance(kid, str):
            own = spaced(kid)
            after_block = last is not None and is_block(last) and own.strip()
            out = apart(out, own) if after_block and out.strip() else out + own
        elif kid.tag != "!":
            own = render(kid)
            out = apart(out, own) if out.strip() and (is_block(kid) or last is not None and last.tag in HEADINGS) else out + own
            last = kid
    return out


def is_block(node: Node) -> bool:
    return node.tag in RULES and RULES[node.tag].block


def render(node: Node) -> str:
    known = RULES.get(node.tag)
    content = flow(node).strip()
    return known.render(node, content) if known else content


@rule("div", "tr", "td", "th", block=True)
def _plain(_: Node, content: str) -> str:
    return content


@rule(*HEADINGS, block=True)
def _heading(node: Node, content: str) -> str:
    return f"{'#' * HEADINGS[node.tag]} {content}"


@rule("p", block=True)
def _paragraph(node: Node, content: str) -> str:
    style = _SPACE.sub("", node.attrs.get("style", "").lower())
    looks = {"title": 2, "divider": 3}
    depth = next((n for name, n in looks.items() if name in node.classes), 5 if "font-weight:bold" in style and "border-bottom" in style else 0)
    return f"{'#' * depth} {content}" if depth else content


@rule("b", "strong", block=False)
def _bold(_: Node, content: str) -> str:
    return f"**{content}**"


@rule("i", "em", block=False)
def _italic(_: Node, content: str) -> str:
    return f"*{content}*"


@rule("br", block=False)
def _line_end(_: Node, content: str) -> str:
    return "\n"


@rule("ul", "ol", block=True)
def _list(node: Node, _: str) -> str:
    lines = []
    for n, item in enumerate((k for k in node.elements if k.tag == "li"), 1):
        mark = "- " if node.tag == "ul" else f"{n}. "
        own = _item(item, " " * len(mark))
        lines.append(own if own.startswith(mark) else mark + own)
    return "\n".join(lines)


def _item(item: Node, indent: str) -> str:
    """A list item's text; lists inside it begin on their own line, indented to the text of the item."""
    out, last = "", None
    for kid in item.kids:
        if isinstance(kid, str):
            own = spaced(kid)
            if last is not None and is_block(last) and own.strip():
                own = f"\n{indent}\n{indent}{own.strip()}" if last.tag in ("ul", "ol") else apart("", own)
            out += own
        elif kid.tag in ("ul", "ol"):
            out += "\n" + "\n".join(indent + line for line in render(kid).strip().split("\n"))
            last = kid
        elif kid.tag != "!":
            out += render(kid)
            last = kid
    return out.strip()


def _rows(node: Node) -> Iterator[Node]:
    """A table's own rows, also those of row groups that broken markup has nested."""
    for kid in node.elements:
        if kid.tag == "tr":
            yield kid
        elif kid.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(kid)


def _span(cell: Node, name: str) -> int:
    try:
        return min(WIDEST_SPAN, max(1, int(cell.attrs.get(name) or 1)))
    except ValueError:
        return 1


@rule("table", block=True)
def _table(node: Node, content: str) -> str:
    if any(n.tag == "table" for k in node.elements for n in k.walk()):
        return content  # a layout
    grid: list[list[str]] = []
    header, covered = False, {}  # covered: by column, the rows that a cell above still fills
    for row in _rows(node):
        line: list[str] = []

        def fill(line=line):
            while covered.get(len(line), 0):
                covered[len(line)] -= 1
                line.append("")

        for cell in row.elements:
            if cell.tag in ("td", "th"):
                fill()
                own, down = " ".join(render(cell).split()), _span(cell, "rowspan")
                for i in range(_span(cell, "colspan")):
                    if down > 1:
                        covered[len(line)] = down - 1
                    line.append("" if i else own)
        fill()
        header = header or not grid and any(k.tag == "th" for k in row.elements)
        grid.append(line)
    wide = max(map(len, grid), default=0)
    lines = [f"| {' | '.join(line + [''] * (wide - len(line)))} |" for line in grid]
    if header:
        lines.insert(1, f"| {' | '.join(['---'] * wide)} |")
    caption = next((k for k in node.elements if k.tag == "caption"), None)
    said = spaced(caption.text()).strip() if caption else ""
    return (f"**{said}**\n\n" if said else "") + "\n".join(lines)


# -- pages -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Where a site's pages keep the article, and what in it is no part of it."""

    root_id: str | None = "article-content"
    root_tag: str | None = None
    breadcrumbs: str | None = "breadcrumbs"
    #: Classes of elements that are no part of an article.
    junk_classes: tuple[str, ...] = ("breadcrumbs", "section15", "toc_light_blue", "goog-toc", "product-right", "ogn-childpages", "custom-content", "sites-comment-docos-wrapper", "right-sidebar", "sidebar-bottom", "footer-nav", "container-fluid", "ogn-npa-container")
    junk_tags: tuple[str, ...] = ("script",)
    note_class: str = "ed-note-header"
    box_classes: tuple[str, ...] = ("content-sidebar", "info-sidebar", "faq", "widefaq")


#: For pages whose article is an ``article`` element.
PLAIN = Template(root_id=None, root_tag="article", breadcrumbs=None, junk_classes=("ad",), junk_tags=("script", "style", "nav", "footer"))


def retag(content: Node, template: Template = Template()) -> None:
    """Make headings of what only looks like one: note and box titles, and dividers one level below what they stand under.

    A divider's level holds until a heading above it: deeper headings belong to the divider's part.
    """
    for node in content.walk():
        if template.note_class in node.classes:
            node.tag = "h5"
        if set(template.box_classes) & set(node.classes):
            first = next((k for k in node.kids if isinstance(k, Node)), None)
            if first is not None and first.tag in ("div", "p"):
                first.tag = "h5"
    above, divider = 1, None
    for node in content.walk():
        here = HEADINGS.get(node.tag, 2 if node.tag == "p" and "title" in node.classes else None)
        if here is not None:
            if divider is None or here < divider:
                above, divider = here, None
        elif node.tag == "p" and "divider" in node.classes:
            divider = divider or min(6, above + 1)
            node.tag = f"h{divider}"


def page(html: str | None, template: Template = Template()) -> dict:
    """Fields title, breadcrumb, body_md, n_chars, error of one page."""
    if not html or not html.strip():
        return {"title": None, "breadcrumb": None, "body_md": None, "n_chars": None, "error": "empty page"}
    nodes = list(tree(html).walk())
    root = next((n for n in nodes if (template.root_id and n.attrs.get("id") == template.root_id) or (template.root_tag and n.tag == template.root_tag)), None)
    trail = None if root is None or not template.breadcrumbs else next((n for n in root.walk() if n is not root and template.breadcrumbs in n.classes), None)
    if root is None or (template.breadcrumbs and trail is None):
        missing = template.root_id or template.root_tag if root is None else template.breadcrumbs
        return {"title": None, "breadcrumb": None, "body_md": None, "n_chars": None, "error": f"no {missing}"}
    crumbs = [n.text().strip() for n in trail.walk() if n.tag == "a"] if trail is not None else []
    junk_classes, junk_tags = set(template.junk_classes), set(template.junk_tags)
    root.prune(lambda n: n.tag in junk_tags or bool(junk_classes & set(n.classes)))
    title = next((k.text().strip() for k in root.elements if k.tag == "h1"), "")
    retag(root, template)
    body = flow(root).strip()
    return {"title": title, "breadcrumb": crumbs, "body_md": body, "n_chars": len(body), "error": None}


PAGE_DDL = "title string, breadcrumb array<string>, body_md string, n_chars int, error string"


def parse_page(html: Column, template: Template = Template()) -> Column:
    """Struct (title, breadcrumb, body_md, n_chars, error) of each page."""

    @F.pandas_udf(PAGE_DDL)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(h, template) for h in pages], columns=["title", "breadcrumb", "body_md", "n_chars", "error"]).astype({"n_chars": "Int32"})

    return run(html)


def parse_pages(pages: DataFrame, base_url: str, min_body: int = 100, template: Template = Template(), slug_col: str = "slug", html_col: str = "html") -> DataFrame:
    """Articles and rejects in one frame: the columns of an article and ``drop_reason`` (null: kept).

    The reasons are ``parse error: ...``, ``hashed slug`` and ``body too short``.
    """
    own = pages.select(F.col(slug_col).alias("doc_id"), parse_page(F.col(html_col), template).alias("p"))
    reason = F.when(F.col("p.error").isNotNull(), F.concat(F.lit("parse error: "), F.col("p.error"))).when(urls.is_hashed(F.col("doc_id")), F.lit("parse error: hashed slug")).when(F.col("p.n_chars") < min_body, F.format_string("body too short (%d < %d chars)", F.col("p.n_chars"), F.lit(min_body)))
    return own.select("doc_id", urls.from_slug(F.col("doc_id"), base_url).alias("url"), "p.title", F.get(F.split("doc_id", "__"), F.lit(0)).alias("category"), "p.breadcrumb", "p.body_md", "p.n_chars", reason.alias("drop_reason"))


def articles(parsed: DataFrame) -> DataFrame:
    return parsed.filter("drop_reason IS NULL").drop("drop_reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("drop_reason IS NOT NULL").select("doc_id", "drop_reason")
