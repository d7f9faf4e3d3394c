"""Operator 9: the visible text of web pages, laid out as blocks, lists and tables."""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, ship, text_bytes

# Element classes of the public HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head title meta link base style script template noscript iframe noembed noframes object audio "
                    "video canvas datalist area param source track col colgroup rp".split())
#: What svg and math hold without showing it.
_UNDRAWN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter "
                     "style script".split()),
    "math": frozenset("annotation annotation-xml mphantom style script".split()),
}
#: HTML may stand in these; elsewhere in svg and math the start tags of the last set end them.
_HOLDS_HTML = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                        "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
                   "option p pre search section summary table ul xmp caption tr thead tbody tfoot td th".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                      "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul "
                      "li dt dd summary".split())
#: A start tag ends these open elements, up to the nearest of the elements in the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}), "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, set()),
}
#: Inline and block content that may not stand in the head, so that its first tag ends it.
_HEAD = frozenset("head title meta link base style script template noscript html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'=]+/\Z")  # the slash belongs to the value
_SHOWN_STYLE = re.compile(r"visibility\s*:\s*visible", re.I)
_LINE = re.compile(r"\n(?=[^\n])")
_NESTED = 40  # lists, quotations and tables deeper than this keep lines, markers and cells but are not indented or aligned
_PAD = 48  # a wider column is not padded


class Node:
    __slots__ = ("tag", "attrs", "children", "kind")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, kind: str = ""):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.kind = kind  # "svg" or "math" for their elements


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), _html.unescape(value.strip("\"'")) if value else "")
    return out


def build(page: str) -> Node:
    """The element tree: void elements, raw text, implied ends of p, li, dt, dd, options, rows and cells.

    An end tag closes the nearest open element of its name within its table cell;
    without one it is passed over.  A stray ``</p>`` has no effect on text.
    In svg and math, elements have their own names, ``/>`` ends them, and no text is raw.
    """
    root = Node("html")
    stack = [root]

    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a name stand
    places["html"].append(0)
    outside: list[int] = []  # open svg and math elements

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        if node.kind:
            outside.append(len(stack))
        stack.append(node)

    def pop(at: int) -> None:
        while len(stack) > at:
            node = stack.pop()
            places[node.tag].pop()
            if node.kind:
                outside.pop()

    def pop_to(names, stops, every: bool = False) -> None:
        """Close the nearest open element of these names below the nearest stop; ``every``: all of them (a cell, its row)."""
        found = [places[x] for x in names if places.get(x)]
        if not found:
            return
        least = max((places[x][-1] for x in stops if places.get(x)), default=0)
        if outside and holds_html(stack[-1], "") and not names & _UNDRAWN.keys():
            # HTML within svg or math ends nothing outside; an element of the name itself may end
            least = max(least, outside[-1] - (stack[outside[-1]].tag in names))
        nearest = [x[bisect_right(x, least)] if every else x[-1] for x in found if x[-1] > least]
        if nearest:
            pop(min(nearest) if every else max(nearest))

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                pop(len(stack) - 1)
            stack[-1].children.append(s)

    def closes_itself(raw: str) -> bool:
        return raw.endswith("/") and not _UNQUOTED_END.search(raw)

    def holds_html(node: Node, tag: str) -> bool:
        if node.kind == "math" and node.tag == "annotation-xml":
            return tag == "svg" or node.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        return not node.kind or (node.tag in _HOLDS_HTML[node.kind] and tag not in ("mglyph", "malignmark"))

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(_html.unescape(page[at:]))
            break
        if m.start() > at:
            s = page[at:m.start()]
            text(_html.unescape(s) if "&" in s else s)
        at = m.end()
        if m[2] is None:
            if stack[-1].kind and page.startswith("<![CDATA[", m.start()):
                end = page.find("]]>", m.start() + 9)
                text(page[m.start() + 9:end if end >= 0 else size])
                at = end + 3 if end >= 0 else size
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "table"):
                pop_to({tag}, {"table"} - {tag})
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                pop_to({tag}, {"td", "th", "table"})
            continue
        if stack[-1].kind:
            if tag in _BREAKS_OUT:
                while not holds_html(stack[-1], tag):
                    pop(len(stack) - 1)
            if not holds_html(stack[-1], tag):
                node = Node(tag, _attributes(m[3]), stack[-1].kind)
                stack[-1].children.append(node)
                if not closes_itself(m[3]):
                    push(node)
                continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in _HEAD:
            pop(len(stack) - 1)
        if tag in _CLOSES_P:
            pop_to({"p"}, {"td", "th", "table", "button", "li", "dd", "dt"} - {tag})
        if tag in _ENDS:
            pop_to(*_ENDS[tag], every=True)
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /\n\t\r") else None, tag if tag in _UNDRAWN else "")
        stack[-1].children.append(node)
        if node.kind and closes_itself(m[3]):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at:end.start()] if end else page[at:]
            at = end.end() if end else size
            node.children.append(_html.unescape(raw) if tag in ("textarea", "title") else raw)
        elif tag not in _VOID:
            push(node)
    return root


def _visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in (_UNDRAWN[node.kind] if node.kind else _UNSEEN):
        return False
    if not a:
        return True
    if node.kind == "svg" and (a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")):
        return False
    if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not ("style" in a and _HIDDEN_STYLE.search(a["style"]) and not _SHOWN_STYLE.search(a["style"]))


class _Page:
    """Text so far, with spaces and line ends held back until text follows."""

    def __init__(self, level: int = 0):
        self.parts: list[str] = []
        self.space, self.lines = False, 0
        self.level = level  # pages that this one lies in
        self.marks: list[str] = []  # list markers held back until their item has text

    def flow(self, s: str) -> None:
        t = _SPACE.sub(" ", s)
        body = t.strip(" ")
        if not body:
            self.space |= bool(t)
            return
        self._open(t[0] == " ")
        self.parts.append(body)
        self.space = t[-1] == " "

    def _open(self, space: bool) -> None:
        if self.parts:
            if self.lines:
                self.parts.append("\n" * self.lines)
            elif space or self.space:
                self.parts.append(" ")
        self.lines, self.space = 0, False
        if self.marks:
            self.parts += self.marks
            self.marks.clear()

    def exact(self, s: str) -> None:
        """Text whose white space counts."""
        s = s.strip("\n") if not s.strip() else s
        if s:
            self._open(False)
            self.parts.append(s)

    def end_line(self, n: int = 1) -> None:
        self.lines = max(self.lines, n)

    def line_break(self) -> None:
        if self.parts:
            self.lines = min(self.lines + 1, 3)

    def text(self) -> str:
        return "".join(self.parts)


def _number(s: str | None, default: int) -> int:
    try:
        return int(s) if s is not None else default
    except ValueError:
        return default


def _finish(steps) -> None:
    """Run a renderer, which yields the renderers of inner elements, on a stack of its own."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def _render(node: Node, out: _Page, pre: bool = False):
    for child in node.children:
        if isinstance(child, str):
            (out.exact if pre else out.flow)(child)
            continue
        tag = child.tag
        if tag == "br":
            out.line_break()
            continue
        if not _visible(child):
            continue
        if tag in ("details", "dialog") and "open" not in child.attrs:
            # closed: a dialog shows nothing, details only its summary
            if tag == "details":
                shut = Node(tag)
                shut.children = [x for x in child.children if not isinstance(x, str) and x.tag == "summary"]
                out.end_line()
                yield _render(shut, out)
                out.end_line()
            continue
        if child.kind:
            # a drawn text stands for itself, as the rows of a formula's table do
            line = tag in ("text", "foreignobject", "mtr", "mlabeledtr")
            if line:
                out.end_line()
            out.space |= tag == "mtd"
            yield _render(child, out)
            if line:
                out.end_line()
            continue
        gap = 2 if tag in _SPACED else 1 if tag in _BLOCK else 0
        if gap == 2 and node.tag == "li" and tag != "p":
            gap = 1  # a nested list follows its item's line
        if gap:
            out.end_line(gap)
        if tag in ("ul", "ol", "menu", "dir"):
            yield _list(child, out, pre)
        elif tag == "table":
            yield _table(child, out)
        elif tag == "blockquote":
            yield _indented(child, out, "  ", "  ", pre)
        elif tag == "dd":
            yield _indented(child, out, "  ", "  ", pre)
        elif tag == "input":
            if child.attrs.get("type", "text").lower() not in ("password", "file", "image"):
                out.flow(child.attrs.get("value", ""))
        else:
            yield _render(child, out, pre or tag in ("pre", "textarea", "xmp"))
        if gap:
            out.end_line(gap)


def _indented(node: Node, out: _Page, first: str, rest: str, pre: bool):
    if out.level >= _NESTED:
        held = len(out.marks)
        if first.strip():
            out.marks.append(first)
        yield _render(node, out, pre)
        del out.marks[held:]  # of an item without text
        out.end_line()
        return
    inner = _Page(out.level + 1)
    yield _render(node, inner, pre)
    body = inner.text()
    if body:
        out.exact(first + _LINE.sub("\n" + rest, body))
        out.end_line()


def _list(node: Node, out: _Page, pre: bool):
    """Items after a dash or their number, further lines under the item's text; a nested list is indented."""
    no = _number(node.attrs.get("start"), 1)
    loose = Node("div")
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if loose.children:
                yield _render(loose, out, pre)
                loose = Node("div")
            if not _visible(child):
                continue
            no = _number(child.attrs.get("value"), no)
            mark = f"{no}. " if node.tag == "ol" else "- "
            no += 1
            out.end_line()
            yield _indented(child, out, mark, " " * len(mark), pre)
        else:
            loose.children.append(child)
    if loose.children:
        yield _render(loose, out, pre)


def _rows(node: Node, rows: list[Node], other: list) -> None:
    for child in node.children:
        if isinstance(child, Node) and child.tag in ("thead", "tbody", "tfoot") and _visible(child):
            _rows(child, rows, other)
        elif isinstance(child, Node) and child.tag == "tr":
            if _visible(child):
                rows.append(child)
        elif isinstance(child, Node) and child.tag in ("td", "th"):
            if not rows or rows[-1].attrs.get("implied") is None:
                rows.append(Node("tr", {"implied": ""}))
            rows[-1].children.append(child)
        else:
            other.append(child)


def _table(node: Node, out: _Page):
    """Cells of a column start at the same place, two spaces after the widest cell; spans keep their columns.

    Text outside rows and the caption come first, as browsers place them.
    """
    rows: list[Node] = []
    before = Node("div")
    _rows(node, rows, before.children)
    yield _render(before, out)
    out.end_line()
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    for row in rows:
        cells, at = {}, 0
        covered, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
        loose = Node("td")
        loose.children = [x for x in row.children if isinstance(x, str) or x.tag not in ("td", "th")]
        own = [x for x in row.children if isinstance(x, Node) and x.tag in ("td", "th") and _visible(x)]
        if any(not isinstance(x, str) or not x.isspace() for x in loose.children):
            own.insert(0, loose)
        if out.level >= _NESTED:
            for cell in own:
                out.space = True
                yield _render(cell, out)
            out.end_line()
            continue
        for cell in own:
            while at in covered:
                at += 1
            inner = _Page(out.level + 1)
            yield _render(cell, inner)
            cells[at] = inner.text().split("\n")
            wide = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
            tall = min(max(_number(cell.attrs.get("rowspan"), 1), 1), 65534)
            if tall > 1:
                taken.update({c: max(taken.get(c, 0), tall - 1) for c in range(at, at + wide)})
            at += wide
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        last = max(cells, default=0)
        for c, lines in cells.items():
            w = max(map(len, lines))
            if c != last and w <= _PAD:
                width[c] = max(width.get(c, 0), w)
    for cells in grid:
        for i in range(max((len(x) for x in cells.values()), default=0)):
            line, want = "", 0
            for c in range(max(cells) + 1):
                if c in cells and i < len(cells[c]) and cells[c][i]:
                    line = line.ljust(want) + ("  " if len(line) > want else "") + cells[c][i]
                if c in width:
                    want += width[c] + 2
            if line.strip():
                out.exact(line)
                out.end_line()


def visible_text(page: str) -> str:
    """All visible text of a page; the empty page has none."""
    out = _Page()
    _finish(_render(build(page), out))
    return out.text()


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, text, n_lines`` of every page, in one pass without a shuffle.

    Null and empty html give an empty text; broken markup and bytes that look like
    tags are read as a browser would, and nothing raises.  Repeated rows stay;
    an empty table gives no rows; other columns are left out.
    """
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                texts = [visible_text(t.as_py().decode("utf-8", "replace")) for t in part.column("t")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(texts, pa.string()),
                     pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int32())],
                    names=["k", "text", "n_lines"])

    return pages.select(F.col(key).alias("k"), text_bytes(html).alias("t")).mapInArrow(
        run, f"k {kind}, text string, n_lines int").withColumnRenamed("k", key)
