"""Visible text of HTML pages, laid out as a browser without scripts would.

A tree builder with implied tags makes elements of the markup, visibility rules
(of elements, style attributes and style sheets in the page) leave out what isn't
shown, and a renderer writes blocks on lines of their own,
blank lines between paragraphs, list markers with indents, and table cells in
aligned columns.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown.  Browsers play audio and video and draw canvases, so what these hold for others isn't seen.
_HIDDEN = frozenset("head script style template iframe noembed noframes title datalist audio video canvas rp".split())
#: Blocks with a blank line around them, and blocks that only start and end a line.
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table menu hr xmp fieldset".split())
_BLOCK = _SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr td th tbody thead tfoot caption".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt xmp".split())
#: An opening tag closes open elements of the named kinds, up to the nearest element that bounds them.
_CELLS = frozenset(["td", "th"])
_ROWS = frozenset(["td", "th", "tr"])
_GROUPS = frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"])
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "td": (_CELLS, frozenset(["table", "tr"])),
    "th": (_CELLS, frozenset(["table", "tr"])),
    "tr": (_ROWS, frozenset(["table", "thead", "tbody", "tfoot"])),
    "thead": (_GROUPS, frozenset(["table"])),
    "tbody": (_GROUPS, frozenset(["table"])),
    "tfoot": (_GROUPS, frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
}
_P_BOUND = frozenset(["table", "td", "th", "caption", "button", "object", "template", "html"])
#: Frames that an element takes at most when it is laid out (a cell of a table's group).
_FRAMES = 6

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_HEAD = frozenset("meta link title script style base template noscript".split())
_TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())
_NO_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|url\([^)]*\)?""", re.S)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
#: Values of ``display`` that show an element, and of ``visibility``; others are no valid declarations.
_SHOWS = frozenset("block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-caption table-row-group list-item contents flow-root run-in initial revert unset".split())
_SEES = {"visible": True, "initial": True, "hidden": False, "collapse": False}


class Element:
    __slots__ = ("attributes", "children", "lit", "shown", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], lit: bool = True):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.shown, self.lit = visible(self), lit


def _holder(e: Element, children: list) -> Element:
    """A block around some of the children of ``e``."""
    out = Element("div", {}, e.lit)
    out.children = children
    return out


def declarations(style: str) -> dict[str, tuple[bool, bool]]:
    """Of ``display`` and ``visibility``: whether the declaration is important, and whether it shows; the last one counts."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in _NO_CSS.sub('""', style).split(";"):
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name not in ("display", "visibility"):
            continue
        value, _, mark = value.strip().lower().partition("!")
        value, important = value.strip(), mark.strip() == "important"
        shows = (False if value == "none" else True if value in _SHOWS else None) if name == "display" else _SEES.get(value)
        if shows is not None and (important or not out.get(name, (False,))[0]):
            out[name] = (important, shows)
    return out


class Rule:
    """A rule of a style sheet that shows or hides: compound selectors in order, each with the combinator before it."""

    def __init__(self, selector: list[tuple[str, str, frozenset[str], frozenset[str]]], order: int, says: dict[str, tuple[bool, bool]]):
        self.selector, self.says = selector, says
        self.weight = (sum(len(ids) for _, _, ids, _ in selector), sum(len(c) for _, _, _, c in selector), sum(t not in ("", "*") for _, t, _, _ in selector), order)

    def fits(self, k: int, e: Element, above: int, parent: int) -> bool:
        """Whether the selector up to its compound ``k`` ends at ``e``, by the bits of the beginnings that end at an ancestor and at the parent."""
        combinator, tag, ids, classes = self.selector[k]
        if k and not (parent if combinator == ">" else above) >> (k - 1) & 1:
            return False
        return tag in ("", "*", e.tag) and (not ids or ids == {e.attributes.get("id", "")}) and classes <= set(e.attributes.get("class", "").split())

    def selects(self, ends: int) -> bool:
        return bool(ends >> (len(self.selector) - 1) & 1)


def sheet_rules(css: str, first: int = 0) -> list[Rule]:
    """Rules that set ``display`` or ``visibility``, with selectors of tags, classes, ids, descendants and children.

    Rules for other media than the screen, other selectors and other at-rules are left out.
    """
    out: list[Rule] = []
    css = _NO_CSS.sub('""', css.replace("<!--", " ").replace("-->", " "))
    at = 0
    while (start := css.find("{", at)) >= 0:
        prelude, depth, end = css[at:start].rpartition(";")[2].strip(), 1, start + 1
        while end < len(css) and depth:
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        body, at = css[start + 1 : end - (not depth)], end
        if prelude.startswith("@"):
            if re.fullmatch(r"@media\s+(?:only\s+)?(?:screen|all)", prelude, re.I):
                out += sheet_rules(body, first + len(out))
            continue
        says = declarations(body)
        for selector in prelude.split(",") if says else []:
            parts = re.split(r"\s*(>)\s*|\s+", selector.strip())
            compounds, combinators = parts[::2], [p or " " for p in parts[1::2]]
            found = [_COMPOUND.fullmatch(c) for c in compounds]
            if not all(found) or not all(compounds):
                continue
            chain = []
            for m, before in zip(found, [" ", *combinators], strict=True):
                names = re.findall(r"[.#][\w-]+", m[2])
                chain.append((before, (m[1] or "").lower(), frozenset(n[1:] for n in names if n[0] == "#"), frozenset(n[1:] for n in names if n[0] == ".")))
            out.append(Rule(chain, first + len(out), says))
    return out


class Index:
    """Compounds of rules by the id, class or tag without which they fit nothing."""

    def __init__(self, rules: list[Rule]):
        self.ids: dict[str, list[tuple[int, int]]] = {}
        self.classes: dict[str, list[tuple[int, int]]] = {}
        self.tags: dict[str, list[tuple[int, int]]] = {}
        for i, rule in enumerate(rules):
            for k, (_, tag, ids, classes) in enumerate(rule.selector):
                table, name = (self.ids, min(ids)) if ids else (self.classes, min(classes)) if classes else (self.tags, tag or "*")
                table.setdefault(name, []).append((i, k))

    def of(self, e: Element) -> Iterator[tuple[int, int]]:
        """Numbers of rules and compounds that may fit the element."""
        yield from self.tags.get("*", ())
        yield from self.tags.get(e.tag, ())
        yield from self.ids.get(e.attributes.get("id", ""), ())
        for name in set(e.attributes.get("class", "").split()):
            yield from self.classes.get(name, ())


def cascade(root: Element, rules: list[Rule]) -> None:
    """Set ``shown`` and ``lit`` of all elements: style sheets, own styles, and visibility handed down."""
    index = Index(rules)
    stack: list[tuple[Element, dict[int, int], dict[int, int]]] = [(root, {}, {})]  # with the beginnings of rules that end above and at the parent
    while stack:
        e, above, parent = stack.pop()
        best: dict[str, tuple[tuple, bool]] = {}

        def say(says: dict[str, tuple[bool, bool]], weight: tuple, best: dict = best) -> None:
            for name, (important, shows) in says.items():
                rank = (important, *weight)
                if name not in best or rank >= best[name][0]:
                    best[name] = (rank, shows)

        ends: dict[int, int] = {}
        for i, k in index.of(e):
            if rules[i].fits(k, e, above.get(i, 0), parent.get(i, 0)):
                ends[i] = ends.get(i, 0) | 1 << k
        for i in sorted(ends):
            if rules[i].selects(ends[i]):
                say(rules[i].says, (0, *rules[i].weight))
        begun = {i: above.get(i, 0) | bits for i, bits in ends.items() if len(rules[i].selector) > 1 and bits & ~above.get(i, 0)}
        below = {**above, **begun} if begun else above
        if "style" in e.attributes:
            say(declarations(e.attributes["style"]), (1, 0, 0, 0, 0))
        if "display" in best and e.tag not in _HIDDEN:
            e.shown = best["display"][1]
        if "visibility" in best:
            e.lit = best["visibility"][1]
        for c in e.children:
            if isinstance(c, Element):
                c.lit = e.lit
                stack.append((c, below, ends))


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, value in _ATTRIBUTE.findall(text):
            if value[:1] in "\"'" and value:
                value = value[1:-1]
            out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def build(markup: str) -> tuple[Element, int]:
    """The element tree, of any depth, and its depth; every markup has one."""
    root = Element("html", {})
    stack = [root]
    known: Counter[str] = Counter()  # open elements by tag, so that deep stacks are searched for what is there only
    at, size, deepest = 0, len(markup), 1
    styled, sheets = False, []
    implied = 0  # place of a table that cells outside of any imply

    def cut(i: int) -> None:
        nonlocal implied
        known.subtract([e.tag for e in stack[i:]])
        del stack[i:]
        if implied >= i:
            implied = 0

    def leave_table() -> None:
        """Content that isn't in a cell ends an implied table."""
        if implied and not any(e.tag in _CELLS for e in stack[implied:]):
            cut(implied)

    def close(kinds: frozenset[str], bound: frozenset[str]) -> None:
        if not any(known[k] for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in kinds:
                # the outermost of the kinds inside the bound goes
                while i > 1 and stack[i - 1].tag in kinds:
                    i -= 1
                cut(i)
                return
            if tag in bound:
                return

    while at < size:
        m = _TOKEN.match(markup, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not text.isspace():
                    if stack[-1].tag == "head":
                        cut(len(stack) - 1)
                    leave_table()
                stack[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not known["p"]:
                stack[-1].children.append(Element("p", {}))
            elif tag == "br":
                stack[-1].children.append(Element("br", {}))
            elif tag not in ("html", "body") and known[tag]:
                bound = () if tag in _BLOCK else _CELLS
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in bound or (stack[i].tag == "table" and tag != "table" and tag not in _GROUPS):
                        break
            continue
        attributes = _attributes(m[3])
        if tag == "html":
            for k, v in attributes.items():
                root.attributes.setdefault(k, v)
            continue
        if stack[-1].tag == "noscript" and stack[-2].tag == "head" and tag not in ("link", "meta", "style"):
            cut(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in _HEAD:
            cut(len(stack) - 1)
        if tag not in _TABLE_PARTS:
            leave_table()
        elif not known["table"]:
            if tag not in _CELLS or stack[-1].tag != "p":
                close(frozenset(["p"]), _P_BOUND)
            implied = len(stack)
            stack[-1].children.append(Element("table", {}))
            stack.append(stack[-1].children[-1])
            known["table"] += 1
        if tag == "body":
            if known["body"]:
                continue
        elif tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag in _CLOSES_P:
            close(frozenset(["p"]), _P_BOUND)
        element = Element(tag, attributes)
        styled = styled or "style" in attributes
        stack[-1].children.append(element)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(markup, at)
            text = markup[at : end.start() if end else size]
            if tag == "style" and attributes.get("media", "screen").strip().lower() in ("", "all", "screen"):
                sheets.append(text)
            element.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else size
        elif tag not in _VOID and not (m[3].endswith("/") and tag in ("svg", "path", "circle", "rect", "use")):
            stack.append(element)
            known[tag] += 1
            deepest = max(deepest, len(stack))
    rules: list[Rule] = []
    for css in sheets:
        rules += sheet_rules(css, len(rules))
    if rules or styled:
        cascade(root, rules)
    return root, deepest


def visible(e: Element) -> bool:
    """Whether an element is displayed if no style says otherwise."""
    if e.tag in _HIDDEN:
        return False
    a = e.attributes
    if not a:
        return e.tag != "dialog"
    return not ("hidden" in a or e.tag == "dialog" and "open" not in a or e.tag == "input" and a.get("type", "").lower() == "hidden")


class Flow:
    """Lines of text under way."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self._put(first)
            for x in rest:
                self.end_line(force=True)
                self._put(x)
            return
        words = _SPACES.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        tail = words[-1] == " "
        if tail:
            words = words[:-1]
        if self.space and self.line:
            self.line.append(" ")
        self.space = tail
        self._put(words)

    def _put(self, s: str) -> None:
        if s:
            if self.gap and self.lines and not self.line:
                self.lines.append("")
            self.gap = False
            self.line.append(s)

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).replace("\xa0", " ").rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def insert(self, lines: list[str]) -> None:
        """Lines laid out elsewhere."""
        if lines:
            self.end_line()
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else default


def _inside(e: Element, pre: bool = False) -> list[str]:
    flow = Flow()
    render(e, flow, pre)
    return flow.done()


def _list(e: Element) -> list[str]:
    lines: list[str] = []
    items = [c for c in e.children if isinstance(c, str) and not c.isspace() or isinstance(c, Element) and c.shown]
    ordered = e.tag == "ol"
    n = _number(e.attributes.get("start"), 1)
    if ordered and "reversed" in e.attributes and "start" not in e.attributes:
        n = sum(isinstance(c, Element) and c.tag == "li" for c in items)
    step = -1 if ordered and "reversed" in e.attributes else 1
    for c in items:
        if isinstance(c, str) or c.tag != "li":
            lines += ["  " + x if x else x for x in _inside(_holder(e, [c]))]
            continue
        n = _number(c.attributes.get("value"), n) if ordered else n
        mark = f"{n}. " if ordered else "- "
        n += step
        inner = _inside(c) or [""]
        if not c.lit:
            mark = " " * len(mark)
        lines.append((mark + inner[0]).rstrip())
        lines += [" " * len(mark) + x if x else x for x in inner[1:]]
    return lines


def _table(e: Element) -> list[str]:
    rows: list[Element] = []
    captions: list[list[str]] = []
    heads: list[Element] = []
    feet: list[Element] = []
    loose: list[list[str]] = []

    def gather(parent: Element, into: list[Element]) -> None:
        for c in parent.children:
            if isinstance(c, str):
                if not c.isspace():
                    loose.append(_inside(_holder(parent, [c])))
            elif not c.shown:
                continue
            elif c.tag == "tr":
                into.append(c)
            elif c.tag in ("thead", "tbody", "tfoot"):
                gather(c, heads if c.tag == "thead" else feet if c.tag == "tfoot" else rows)
            elif c.tag in _CELLS:
                if not (into and into[-1].tag == "implied"):
                    into.append(Element("implied", {}, parent.lit))
                into[-1].children.append(c)
            elif c.tag == "caption":
                captions.append(_inside(c))
            elif c.tag not in ("col", "colgroup"):
                loose.append(_inside(_holder(parent, [c])))

    gather(e, rows)
    grid: list[dict[int, tuple[list[str], int]]] = []
    busy: dict[int, int] = {}  # column: rows that a cell from above still takes
    for tr in heads + rows + feet:
        cells: dict[int, tuple[list[str], int]] = {}
        column = 0
        taken, busy = busy, {k: v - 1 for k, v in busy.items() if v > 1}
        for c in tr.children:
            if isinstance(c, str):
                if c.isspace():
                    continue
                cell = _holder(tr, [c])
            elif not c.shown:
                continue
            else:
                cell = c
            while column in taken:
                column += 1
            wide = min(max(1, _number(cell.attributes.get("colspan"), 1)), 1000)
            tall = min(max(1, _number(cell.attributes.get("rowspan"), 1)), 65534)
            cells[column] = (_inside(cell), wide)
            if tall > 1:
                for k in range(column, column + wide):
                    busy[k] = tall - 1
            column += wide
        if cells:
            grid.append(cells)
    out = [line for block in captions + loose for line in block]
    most = PADDING * sum(len(x) + 2 for cells in grid for lines, _ in cells.values() for x in lines) + 10_000
    return out + next(rows for wide in _WIDTHS if (rows := _aligned(grid, _columns(grid, wide), most)) is not None)


#: Times the text of a table that its lines may hold, and how far a line may widen its column where they would hold more.
PADDING, _WIDTHS = 4, (1 << 30, 1000, 300, 100, 30, 10, 0)


def _columns(grid: list[dict[int, tuple[list[str], int]]], most: int) -> dict[int, int]:
    """Where each column begins; a longer line than ``most`` doesn't widen its column further."""
    widths: dict[int, int] = {}
    for cells in grid:
        for k, (lines, wide) in cells.items():
            if wide == 1:
                widths[k] = max(widths.get(k, 0), min(most, max(map(len, lines), default=0)))
    for cells in grid:
        for k, (lines, wide) in cells.items():
            if wide > 1:
                have = sum(widths.get(j, 0) + 2 for j in range(k, k + wide)) - 2
                need = min(most, max(map(len, lines), default=0))
                if need > have:
                    widths[k + wide - 1] = widths.get(k + wide - 1, 0) + need - have
    places, x = {}, 0
    for k in sorted(widths):
        places[k] = x
        x += widths[k] + (2 if widths[k] else 0)
    return places


def _aligned(grid: list[dict[int, tuple[list[str], int]]], places: dict[int, int], most: int) -> list[str] | None:
    """The lines of a table; None if they would hold more than ``most`` characters."""
    out, size, known = [], 0, sorted(places)
    for cells in grid:
        for i in range(max(len(lines) for lines, _ in cells.values())):
            row = ""
            for k, (lines, _) in cells.items():
                if i < len(lines) and lines[i]:
                    at = places[known[max(0, bisect_right(known, k) - 1)]] if known else 0
                    if size + max(at, len(row)) > most:
                        return None
                    row = row.ljust(at) + ("  " if len(row) > at else "") + lines[i]
            size += len(row)
            out.append(row)
    return out


def render(e: Element, flow: Flow, pre: bool = False) -> None:
    """Write the visible children of ``e``."""
    for c in e.children:
        if isinstance(c, str):
            if e.lit:
                flow.text(c, pre)
            continue
        tag = c.tag
        if not c.shown:
            continue
        if tag == "br":
            flow.end_line(force=True)
        elif tag == "input":
            if c.lit and c.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                flow.text(" " + c.attributes.get("value", "") + " ", False)
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = e.tag == "li"
            flow.block(not nested)
            flow.insert(_list(c))
            flow.block(not nested)
        elif tag == "table":
            flow.block(True)
            flow.insert(_table(c))
            flow.block(True)
        elif tag == "dd":
            flow.block(False)
            flow.insert(["  " + x if x else x for x in _inside(c)])
        elif tag == "details" and "open" not in c.attributes:
            flow.block(False)
            for s in c.children:
                if isinstance(s, Element) and s.tag == "summary" and s.shown:
                    flow.insert(_inside(s))
                    break
            flow.block(False)
        elif tag in _BLOCK:
            spaced = tag in _SPACED
            flow.block(spaced)
            if tag in ("pre", "textarea", "xmp"):
                flow.insert(_inside(c, True))
            elif tag not in _VOID:
                render(c, flow, pre)
            flow.block(spaced)
        elif tag not in _VOID:
            render(c, flow, pre or tag == "textarea")


def visible_text(markup: str | None) -> str | None:
    """The text that a reader of the page sees; None stays None."""
    if markup is None:
        return None
    flow = Flow()
    root, depth = build(markup)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1000 + _FRAMES * depth))  # calls between Python functions take no room on the C stack
    try:
        render(root, flow)
    finally:
        sys.setrecursionlimit(limit)
    return "\n".join(flow.done())


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the markup, with the visible text of each whole page as ``out``.

    A null page has a null text, an empty one or one without visible text an
    empty one.  Broken markup still gives its text, at any depth.  Repeated rows stay, an input column named as ``out`` is
    replaced, all others pass through; an empty table gives an empty one.
    """
    kept = pages.drop(*[c for c in (out,) if c != html_column and c in pages.columns])
    rest = [f for f in kept.schema.fields if f.name != html_column]
    from pyspark.sql import types as T

    schema = T.StructType([*rest, T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, html_column):
                texts = pa.array(map(visible_text, part.column(html_column).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], texts], [f.name for f in schema.fields])

    return kept.mapInArrow(work, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(read_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
