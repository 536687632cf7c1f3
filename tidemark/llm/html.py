"""Layout-aware text of HTML pages.

A page is cut into tags and text, a tree is built from them with the end tags that HTML lets an
author leave out, and the tree is rendered: blocks on lines of their own with blank lines where a
browser has space, list items with marks and numbers, tables as columns of equal width, preformatted
text as it stands.  All text that a reader sees is kept; what a browser hides is not.

Rules
    * NULL and empty pages give an empty text.  Broken markup never fails: unknown end tags are
      skipped, open elements end with the page, a stray ``<`` is text.
    * Hidden are head, script, style, template, noscript and the like, the fallback of iframe, object,
      audio, video and canvas, ``hidden`` attributes, ``display: none``, and hidden inputs.
      ``visibility`` is inherited, so a visible child of a hidden element is kept.  An element nested
      deeper than ``max_depth`` is taken as a child of the one at that depth.
    * Of svg the text elements and foreign objects are kept (not what only ``use`` would draw), of math
      all but annotations and phantoms.  A select shows its selected option, as a list all options.
    * A comment also ends at ``--!>``, an empty one and ``<![CDATA[`` outside svg and math at the first
      ``>``.
    * A head ends at its end tag, or where something starts that is no part of a head: text, or any
      element that is not of a head.  Later head tags are skipped.
    * Rows that repeat an id, NULL ids and extra columns pass through.

Each page is rendered alone, in one Arrow batch at a time; pages need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_runs

MAX_DEPTH = 200
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas datalist noembed noframes".split())
SVG_HIDDEN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter desc metadata".split())
MATH_HIDDEN = frozenset("annotation annotation-xml mphantom".split())
MATH_APART = frozenset("mfrac mroot munder mover munderover mtable mtr mlabeledtr mmultiscripts".split())
MATH_TEXT = frozenset("mi mo mn ms mtext".split())
#: Start tags that end svg and math, and those that end select.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
SELECT_ENDS = frozenset("input keygen textarea select caption table tbody tfoot thead tr td th".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table ul tr caption xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr menu dir xmp".split())
#: Open elements that a start tag ends, and the elements that this does not look beyond.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
PARAGRAPH_ENDS = BLOCK - frozenset(["tr", "caption", "li", "dd", "dt", "html", "body"])
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([a-z-]+)")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_LAST_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: name, attributes, children, which are nodes or text, and space: svg, math or empty."""

    __slots__ = ("attributes", "children", "name", "space")

    def __init__(self, name: str, attributes: dict[str, str], space: str = ""):
        self.name, self.attributes, self.children, self.space = name, attributes, [], space


def _space_inside(node: Node, name: str) -> str:
    """The space of a child of that name."""
    if node.space == "svg" and node.name in ("foreignobject", "desc", "title"):
        return ""
    if node.space == "math":
        if node.name in MATH_TEXT and name not in ("mglyph", "malignmark"):
            return ""
        if node.name == "annotation-xml" and (name == "svg" or node.attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")):
            return ""
    return node.space


def build(page: str, max_depth: int = MAX_DEPTH) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    open_nodes, at = [root], 0
    begun = inherits = False

    def close(upto: int) -> None:
        del open_nodes[max(1, upto) :]

    def begin_body() -> None:
        nonlocal begun
        begun = True
        if open_nodes[-1].name == "head":
            body = Node("body", {})
            open_nodes[-2].children.append(body)
            open_nodes[-1] = body

    def add_text(text: str) -> None:
        if text:
            if _SPACE.sub("", text):
                begin_body()
            open_nodes[-1].children.append(unescape(text))

    while found := _TAG.search(page, at):
        add_text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if open_nodes[-1].space and found[0].startswith("<![CDATA["):
                end = page.find("]]>", found.start())
                open_nodes[-1].children.append(page[found.start() + 9 : end if end >= 0 else len(page)])
                at = end + 3 if end >= 0 else len(page)
            continue
        if found[1]:
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].name == name:
                    close(i)
                    break
                if open_nodes[i].name == "table" and name not in ("div", "body", "html"):
                    break
            else:
                if name == "p":
                    open_nodes[-1].children.append(Node("p", {}))
            continue
        attributes = {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(found[3])}
        space = _space_inside(open_nodes[-1], name) if open_nodes[-1].space else ""
        if space and (name in BREAKOUT or name == "font" and not attributes.keys().isdisjoint(("color", "face", "size"))):
            while _space_inside(open_nodes[-1], name):
                open_nodes.pop()
            space = ""
        inherits = inherits or "visibility" in attributes.get("style", "").lower() or "visibility" in attributes
        if space or name in ("svg", "math"):
            begin_body()
            node = Node(name, attributes, space or name)
            parent = open_nodes[-1]
            parent.children.append(node)
            closed = found[3].endswith("/") and not _LAST_UNQUOTED.search(found[3])
            if not closed and (len(open_nodes) < max_depth or node.space == parent.space and name in ("text", "foreignobject") and name != parent.name):
                open_nodes.append(node)
            continue
        if name in SELECT_ENDS:
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].name == "select" and not open_nodes[i].space:
                    close(i)
                    break
            else:
                i = 0
            if i and name == "select":
                continue
        if name == "html" and len(open_nodes) > 1 or name == "head" and begun or name == "body" and any(n.name == name for n in open_nodes):
            continue
        if name == "head":
            begun = True
        elif name != "body" and name != "html" and name not in HEAD:
            begin_body()
        if name in ENDS:
            ended, barrier = ENDS[name]
            lowest = None
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].name in barrier:
                    break
                if open_nodes[i].name in ended:
                    lowest = i
            if lowest is not None:
                close(lowest)
        if name in PARAGRAPH_ENDS:
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].name == "p":
                    close(i)
                    break
                if open_nodes[i].name in BLOCK or open_nodes[i].name in ("td", "th"):
                    break
        node = Node(name, attributes)
        open_nodes[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            text = page[at : end.start()]
            node.children.append(unescape(text) if name in ("textarea", "title") else text)
            at = end.end()
        elif len(open_nodes) < max_depth:
            open_nodes.append(node)
    add_text(page[at:])
    if inherits:
        _drop_unseen(root, True)
    return root


def _styles(node: Node) -> dict[str, str]:
    """Values of display, visibility and content-visibility; the last one counts, a style before an attribute."""
    a = node.attributes
    out = {k: a[k].strip().lower() for k in ("display", "visibility") if k in a} if node.space else {}
    if "style" in a:
        out |= dict(_STYLE.findall(_CSS_COMMENT.sub("", a["style"]).lower()))
    return out


def visible(node: Node) -> bool:
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if node.space and node.name in (SVG_HIDDEN if node.space == "svg" else MATH_HIDDEN):
        return False
    if not node.space and "style" not in a:
        return True
    styles = _styles(node)
    row = node.name in ("tr", "thead", "tbody", "tfoot") and styles.get("visibility") == "collapse"
    return not (row or styles.get("display") == "none" or styles.get("content-visibility") == "hidden")


def _drop_unseen(node: Node, seen: bool) -> None:
    """Take the text, images and fields of hidden elements out; their children may be visible again."""
    left: list = []
    for child in node.children:
        if isinstance(child, str):
            left.append(child if seen else _SPACE.search(child) and " ")
            continue
        own = _styles(child).get("visibility")
        shown = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(own, seen)
        if shown or child.name not in ("img", "input", "hr", "select"):
            left.append(child)
            _drop_unseen(child, shown)
    node.children = [c for c in left if c]


class _Lines:
    """Lines under construction: words of the open line, and the blank lines owed before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.owed = False

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text.startswith(" "):
            self.space = True
        body = text.strip(" ")
        if body:
            if self.parts and self.space:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = text.endswith(" ")

    def end(self, blank: bool = False) -> None:
        if self.parts:
            self._put("".join(self.parts))
        self.parts, self.space = [], False
        self.owed = self.owed or blank

    def line_break(self) -> None:
        if self.parts:
            self.end()
        elif self.lines:
            self.lines.append("")

    def _put(self, line: str) -> None:
        if self.owed and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.owed = False
        self.lines.append(line)

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        for i, line in enumerate(lines):
            self._put((first if i == 0 else rest) + line if line else "")

    def done(self) -> list[str]:
        self.end()
        lines = [x.rstrip(" ") for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        return lines


def render(node: Node) -> list[str]:
    """Lines of a node's visible text."""
    out = _Lines()
    _children(node, out)
    return out.done()


def _children(node: Node, out: _Lines) -> None:
    number = _int(node.attributes.get("start"), 1)
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif visible(child):
            if child.name == "li" and node.name == "ol":
                number = _int(child.attributes.get("value"), number)
                _item(child, out, f"{number}. ")
                number += 1
            else:
                _element(child, out)


def _int(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def _item(node: Node, out: _Lines, mark: str) -> None:
    out.end()
    lines = render(node)
    if lines:
        out.block(lines, mark, " " * len(mark))


def _element(node: Node, out: _Lines) -> None:
    name = node.name
    if node.space == "svg":
        _svg(node, out)
    elif node.space == "math":
        _math(node, out)
    elif name == "select":
        _select(node, out)
    elif name == "br":
        out.line_break()
    elif name == "hr":
        out.end(blank=True)
        out.block(["---"])
        out.end(blank=True)
    elif name == "wbr":
        pass
    elif name in ("img", "input"):
        text = node.attributes.get("alt", "") if name == "img" else node.attributes.get("value", "")
        out.text(text)
    elif name == "li":
        _item(node, out, "- ")
    elif name == "dd":
        out.end()
        out.block(render(node), "    ", "    ")
    elif name in ("pre", "xmp", "textarea"):
        out.end(blank=True)
        text = _plain(node).replace("\r\n", "\n").replace("\r", "\n")
        out.block((text[1:] if text.startswith("\n") else text).rstrip("\n").split("\n"))
        out.end(blank=True)
    elif name == "blockquote":
        out.end(blank=True)
        out.block(render(node), "> ", "> ")
        out.end(blank=True)
    elif name == "table":
        out.end(blank=True)
        out.block(_table(node))
        out.end(blank=True)
    elif name in BLOCK:
        out.end(blank=name in SPACED)
        _children(node, out)
        out.end(blank=name in SPACED)
    elif name in ("td", "th"):
        out.text(" ")
        _children(node, out)
        out.text(" ")
    else:
        _children(node, out)


def _svg(node: Node, out: _Lines) -> None:
    """Text of a drawing: its text elements, apart from each other, and foreign objects."""
    if node.name == "text":
        out.text(" ")
        _children(node, out)
        out.text(" ")
    elif node.name == "foreignobject":
        out.end()
        _children(node, out)
        out.end()
    elif node.name in ("tspan", "textpath"):
        if not node.attributes.keys().isdisjoint(("x", "y", "dy")):
            out.text(" ")
        _children(node, out)
    else:
        # only text elements show text; links and the like may stand in one
        inside = node.name in ("a", "altglyph", "tref")
        for child in node.children:
            if isinstance(child, str):
                if inside:
                    out.text(child)
            elif visible(child):
                _element(child, out)


def _math(node: Node, out: _Lines) -> None:
    own_line = node.name == "math" and node.attributes.get("display", "").lower() == "block"
    if own_line:
        out.end()
    for i, child in enumerate(c for c in node.children if isinstance(c, str) or visible(c)):
        if isinstance(child, str):
            out.text(child)
            continue
        if node.name in MATH_APART and i:
            out.text(" ")
        _element(child, out)
    if node.name in MATH_APART:
        out.text(" ")
    if own_line:
        out.end()


def _options(node: Node, disabled: bool = False) -> Iterator[tuple[Node, bool]]:
    """Options and groups of a select, and whether they are disabled."""
    for child in node.children:
        if isinstance(child, Node):
            off = disabled or "disabled" in child.attributes
            if child.name in ("option", "optgroup"):
                yield child, off
            if child.name != "option":
                yield from _options(child, off if child.name == "optgroup" else disabled)


def _select(node: Node, out: _Lines) -> None:
    """The selected option, or all options of a list."""
    found = list(_options(node))
    if "multiple" in node.attributes or _int(node.attributes.get("size"), 1) > 1:
        for option, _ in found:
            if visible(option):
                out.end()
                out.text(_label(option))
        out.end()
        return
    options = [x for x in found if x[0].name == "option"]
    chosen = [o for o, _ in options if "selected" in o.attributes][-1:] or [o for o, off in options if not off][:1]
    for option in chosen:
        out.text(f" {_label(option)} ")


def _label(option: Node) -> str:
    return option.attributes.get("label") or (" ".join(render(option)) if option.name == "option" else "")


def _plain(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.name == "br" else _plain_element(c) if visible(c) else "" for c in node.children)


def _plain_element(node: Node) -> str:
    if not node.space and node.name not in ("select", "img", "input"):
        return _plain(node)
    out = _Lines()
    _element(node, out)
    return "\n".join(out.done())


def _rows(node: Node, captions: list[Node], rows: list[list[Node]], rest: list) -> None:
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                rest.append(child)
        elif not visible(child):
            continue
        elif child.name == "caption":
            captions.append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            _rows(child, captions, rows, rest)
        elif child.name == "tr":
            cells = [c for c in child.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)]
            rest += [c for c in child.children if c not in cells and (c.strip() if isinstance(c, str) else visible(c))]
            rows.append(cells)
        elif child.name in ("td", "th"):
            if not rows or node.name == "tr":
                rows.append([])
            rows[-1].append(child)
        elif child.name not in ("col", "colgroup"):
            rest.append(child)


def _table(node: Node) -> list[str]:
    """Caption, text that is in no cell, and rows with their cells in columns of equal width."""
    captions: list[Node] = []
    rows: list[list[Node]] = []
    rest: list = []
    _rows(node, captions, rows, rest)
    lines = [x for c in captions for x in render(c)]
    if rest:
        loose = Node("div", {})
        loose.children = rest
        lines += render(loose)
    grid = [[(render(c), min(1000, max(1, _int(c.attributes.get("colspan"), 1)))) for c in cells] for cells in rows]
    width: dict[int, int] = {}
    for cells in grid:
        at = 0
        for text, span in cells:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, text), default=0))
            at += span
    for cells in grid:
        height = max((len(t) for t, _ in cells), default=0)
        for i in range(height):
            line, at, reach = "", 0, 0
            for text, span in cells:
                piece = text[i] if i < len(text) else ""
                if piece:
                    line = line.ljust(reach) + piece
                reach = max(reach, len(line)) if span > 1 and len(piece) > sum(width.get(at + k, 0) + 3 for k in range(span)) else reach
                reach += sum(width.get(at + k, 0) + 3 for k in range(span))
                at += span
            if line.strip():
                lines.append(line)
    return lines


def page_text(page: str | None, max_depth: int = MAX_DEPTH) -> str:
    return "\n".join(render(build(page, max_depth))) if page else ""


def extract(pages: DataFrame, html: str = "html", max_depth: int = MAX_DEPTH) -> DataFrame:
    """``pages`` with text, the visible text of each page."""
    if "text" in pages.columns:
        raise ValueError("there is a column text already")
    at = pages.columns.index(html)
    schema = pages.select("*", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, at):
                text = pa.array([page_text(x, max_depth) for x in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "text"])

    return pages.mapInArrow(run, schema)
