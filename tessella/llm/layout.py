"""Text of HTML pages as a reader sees it: a tree with implied tags, visibility rules, then layout.

Block elements stand on lines of their own, some with a blank line around; list items get markers and
indentation; table cells line up in columns; preformatted text keeps its spaces. Nothing visible is left out:
of lists of options the chosen one is shown, of closed details the summary, of drawings their texts. Hidden is what
an element's style, an attribute, or a simple rule of a style sheet hides; visibility may come back further inside.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.session import ship

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript title meta link base iframe object embed noembed noframes canvas "
    "audio video datalist input param source track area map col colgroup annotation annotation-xml".split()
)
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table ul xmp caption".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("article aside blockquote dl figure footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul menu".split())
#: Tags that end an open paragraph.
ENDS_P = BLOCK - {"html", "body", "li", "dd", "dt", "caption", "legend"}
#: For a tag: the open tags it closes, and the tags beyond which it looks no further.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag does not look past these for its start tag.
SCOPES = frozenset("table td th caption html template".split())
#: Elements open at once at most, as in browsers; deeper ones add their content to the deepest open one.
DEPTH = 512
#: Cells are padded up to this width; longer ones stand as they are.
WIDEST = 60
#: Columns that one cell spans at most, as in the HTML standard.
SPAN = 1000

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_COMMENT_END = re.compile(r"--!?>")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)", re.I)
_SHEET = re.compile(r"<style\b[^>]*>(.*?)(?:</style|$)", re.I | re.S)
_SHEET_NOISE = re.compile(r"/\*.*?\*/|<!--|-->|@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", re.S)
_SHEET_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?$")


class Element:
    """A node: tag, attributes that matter, whether it and all in it is hidden, whether its own text is dark, children."""

    __slots__ = ("attributes", "children", "dark", "hidden", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], hidden: bool, dark: bool = False):
        self.tag = tag
        self.attributes = attributes
        self.hidden = hidden
        self.dark = dark
        self.children: list = []


def _declared(style: str) -> tuple[str | None, str | None]:
    """The last display and visibility that a style declares."""
    display, visibility = _DISPLAY.findall(style), _VISIBILITY.findall(style)
    return display[-1].lower() if display else None, visibility[-1].lower() if visibility else None


def style_rules(source: str) -> dict[tuple[str, str], tuple[str | None, str | None]]:
    """Display and visibility by (tag or "", ".class", "#id" or "") of a page's style sheets, later rules over earlier.

    Only selectors of one tag, class or id, or a tag with one of these, count; rules for some media do not.
    """
    rules: dict[tuple[str, str], tuple[str | None, str | None]] = {}
    for sheet in _SHEET.findall(source):
        for selectors, style in _SHEET_RULE.findall(_SHEET_NOISE.sub(" ", sheet)):
            display, visibility = _declared(style)
            if display is None and visibility is None:
                continue
            for selector in selectors.split(","):
                simple = _SIMPLE.match(selector.strip())
                if simple and simple[0]:
                    key = ((simple[1] or "").lower(), simple[2] or "")
                    before = rules.get(key, (None, None))
                    rules[key] = display or before[0], visibility or before[1]
    return rules


def _style(tag: str, attributes: dict[str, str], rules: dict) -> tuple[str | None, str | None]:
    """Display and visibility of an element: its own style over the sheets', ids over classes over tags there."""
    display, visibility = _declared(attributes.get("style", ""))
    if rules:
        names = ["", *("." + c for c in attributes.get("class", "").split()), *(["#" + attributes["id"]] if "id" in attributes else [])]
        for name in reversed(names):
            for of in (tag, ""):
                found = rules.get((of, name), (None, None))
                display, visibility = display or found[0], visibility or found[1]
    return display, visibility


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def parse(source: str) -> Element:
    """Tree of a page. Unclosed tags close where HTML implies it or at the end; stray end tags are ignored."""
    root = Element("html", {}, False)
    stack = [root]
    rules = style_rules(source) if "<style" in source or "<STYLE" in source else {}
    at, end = 0, len(source)
    lower = None

    def close_until(tags: set[str], fence: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in fence:
                return
            if stack[i].tag in tags:
                del stack[i:]
                # Several may be open, such as a cell and its row.
                close_until(tags, fence)
                return

    def add_text(data: str) -> None:
        if not stack[-1].dark:
            stack[-1].children.append(data)

    while at < end:
        open_at = source.find("<", at)
        if open_at < 0:
            add_text(html.unescape(source[at:]))
            break
        if open_at > at:
            add_text(html.unescape(source[at:open_at]))
        if source.startswith("<!--", open_at):
            # "<!-->" and "<!--->" are comments that are empty.
            empty = source.startswith((">", "->"), open_at + 4)
            close = None if empty else _COMMENT_END.search(source, open_at + 4)
            at = source.find(">", open_at) + 1 if empty else close.end() if close else end
            continue
        following = source[open_at + 1 : open_at + 2]
        if following in ("!", "?"):
            close = source.find(">", open_at)
            at = end if close < 0 else close + 1
            continue
        match = _TAG.match(source, open_at)
        if not match:
            if following.isalpha() or following == "/":
                # A tag with an open quote, or cut off by the end: it goes up to the next >.
                close = source.find(">", open_at)
                at = end if close < 0 else close + 1
                continue
            add_text("<")
            at = open_at + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Element("p", {}, False))
                continue
            if tag == "br":
                stack[-1].children.append(Element("br", {}, False))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                    break
            continue
        attributes = _attributes(match[3]) if match[3].strip(" /\n\t") else {}
        if tag in ("html", "body") and any(x.tag == tag for x in stack[:3]):
            continue
        if tag in ENDS_P:
            close_until({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            close_until(*IMPLIED[tag])
        display, visibility = _style(tag, attributes, rules)
        unseen = (
            tag in HIDDEN
            or display == "none"
            or ("hidden" in attributes and display is None)
            or (tag == "dialog" and "open" not in attributes)
        )
        dark = stack[-1].dark if visibility in (None, "inherit") else visibility in ("hidden", "collapse")
        node = Element(tag, attributes, unseen, dark)
        stack[-1].children.append(node)
        if tag in RAW:
            if lower is None:
                lower = source.lower() if len(source.lower()) == len(source) else source
            close = lower.find("</" + tag, at)
            content = source[at : end if close < 0 else close]
            if not dark:
                node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            close = end if close < 0 else lower.find(">", close)
            at = end if close < 0 else close + 1
        elif tag not in VOID and not match[3].endswith("/") or tag in BLOCK and tag not in VOID:
            if len(stack) < DEPTH or unseen:
                stack.append(node)
    return root


class Page:
    """Lines under construction, with the blank lines still due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.blank = False

    def text(self, data: str) -> None:
        """Running text: white space collapses, also with what stands before."""
        data = _SPACE.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self.start()
            self.line += data

    def start(self) -> None:
        if self.blank and not self.line:
            if self.lines:
                self.lines.append("")
            self.blank = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def add(self, lines: list[str]) -> None:
        """Ready lines, each on its own."""
        if lines:
            self.end_line()
            self.start()
            self.lines.extend(lines)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(value: str, default: int) -> int:
    value = value.strip()
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else default


def render(node: Element, page: Page) -> None:
    """Lay a node's visible content out on the page."""
    for child in node.children:
        if isinstance(child, str):
            page.text(child)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            if page.line:
                page.end_line()
            elif page.lines:
                page.lines.append("")
            continue
        if tag == "hr":
            page.gap()
            continue
        if tag in SPACED:
            page.gap()
        elif tag in BLOCK:
            page.end_line()
        if tag == "details" and "open" not in child.attributes:
            _closed(child, page)
        elif tag == "select":
            page.text(f" {_chosen(child)} ")
        elif tag == "svg":
            _drawn(child, page)
        elif tag == "table":
            page.add(_table(child))
        elif tag in ("pre", "xmp", "textarea"):
            page.add(_text_of(child).expandtabs(8).strip("\n").split("\n"))
        elif tag in ("ul", "ol", "menu", "dir"):
            page.add(_list(child))
        elif tag in ("blockquote", "dd"):
            page.add(["    " + x if x else x for x in _lines(child)])
        elif tag in ("td", "th", "tr") and node.tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            page.text(" ")
            render(child, page)
            page.text(" ")
        else:
            render(child, page)
        if tag in SPACED:
            page.gap()
        elif tag in BLOCK:
            page.end_line()


def _lines(node: Element) -> list[str]:
    page = Page()
    render(node, page)
    return page.done()


def _closed(node: Element, page: Page) -> None:
    """Closed details show their first summary only."""
    summary = next((x for x in node.children if isinstance(x, Element) and x.tag == "summary" and not x.hidden), None)
    if summary is not None:
        render(summary, page)


def _chosen(node: Element) -> str:
    """What a list of options shows: the selected ones, else the first; all of a list that stands open."""
    options, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Element) and not x.hidden:
            if x.tag == "option":
                options.append(x)
            else:
                todo.extend(reversed(x.children))
    if "multiple" not in node.attributes and _number(node.attributes.get("size", ""), 1) < 2:
        options = [x for x in options if "selected" in x.attributes][-1:] or options[:1]
    return " ".join(_text_of(x) or x.attributes.get("label", "") for x in options)


def _drawn(node: Element, page: Page) -> None:
    """Text elements of a drawing, in order; its titles, descriptions and definitions are not drawn."""
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.hidden or x.tag in ("title", "desc", "defs", "symbol", "metadata"):
            continue
        if x.tag in ("text", "foreignobject"):
            page.text(" ")
            render(x, page)
            page.text(" ")
        else:
            todo.extend(reversed(x.children))


def _text_of(node: Element) -> str:
    parts = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        elif not x.hidden:
            todo.extend(reversed(x.children))
    return "".join(parts)


def _list(node: Element) -> list[str]:
    """Items behind a dash or their number, further lines indented; other content of the list as it comes."""
    out: list[str] = []
    number = _number(node.attributes.get("start", ""), 1)
    loose = Element("div", {}, False)

    def flush() -> None:
        out.extend(_lines(loose))
        loose.children = []

    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            loose.children.append(child)
            continue
        flush()
        if child.hidden:
            continue
        number = _number(child.attributes.get("value", ""), number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        lines = _lines(child)
        if not lines and child.dark:
            continue
        lines = lines or [""]
        out.append((mark + lines[0]).rstrip())
        out.extend(" " * len(mark) + x if x else x for x in lines[1:])
    flush()
    return out


def _rows(node: Element, above: list[str]) -> Iterator[Element]:
    """Rows of a table in order; what stands between rows goes to ``above``."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                above.append(_SPACE.sub(" ", child).strip())
        elif child.hidden:
            continue
        elif child.tag in ("tbody", "thead", "tfoot"):
            yield from _rows(child, above)
        elif child.tag == "tr":
            yield child
        elif child.tag in ("td", "th"):
            row = Element("tr", {}, False)
            row.children.append(child)
            yield row
        else:
            holder = Element("div", {}, False)
            holder.children.append(child)
            above.extend(_lines(holder))


def _table(node: Element) -> list[str]:
    """Cells side by side, columns of one width, two spaces apart; a cell of several lines takes several lines."""
    above: list[str] = []
    grid: list[list[tuple[int, list[str]]]] = []
    # Rows that a cell above still takes in a column; 0 rows last to the end of the table.
    taken: dict[int, float] = {}
    for row in _rows(node, above):
        cells, column = [], 0
        begun: dict[int, float] = {}
        for child in row.children:
            if isinstance(child, str) or child.tag not in ("td", "th"):
                if isinstance(child, str) and not child.strip():
                    continue
                holder = Element("td", {}, False)
                holder.children.append(child)
                child = holder
            if child.hidden:
                continue
            while taken.get(column, 0) > 0:
                column += 1
            cells.append((column, _lines(child)))
            across = min(SPAN, max(1, _number(child.attributes.get("colspan", ""), 1)))
            down = _number(child.attributes.get("rowspan", ""), 1)
            if down != 1:
                begun |= dict.fromkeys(range(column, column + across), float("inf") if down == 0 else min(down, 65_534) - 1)
            column += across
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in begun.items() if n > 0}
        grid.append(cells)
    if all(len(cells) < 2 for cells in grid):
        # A table of one column only arranges the page.
        return above + [x for cells in grid for _, lines in cells for x in lines]
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells:
            widths[column] = max(widths.get(column, 0), min(WIDEST, max(map(len, lines), default=0)))
    left, at = {}, 0
    for column in sorted(widths):
        left[column] = at
        at += widths[column] + 2
    out = above
    for cells in grid:
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for column, lines in cells:
                if i < len(lines) and lines[i]:
                    line = line.ljust(left[column])
                    line += ("  " if line and not line.endswith("  ") else "") + lines[i]
            out.append(line.rstrip())
    return out


def text_of_page(source: str | None) -> str:
    """All visible text of a page, lines joined by line feeds; empty for a null or empty page."""
    if not source:
        return ""
    # A level of nesting takes three calls at most.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    lines = _lines(parse(source))
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, text, n_lines) of every page, whole. A null or empty page gives an empty text and 0 lines.

    Repeated rows are rendered alike; other columns are not read. Elements nested deeper than DEPTH add their
    content to the deepest open one, so no page can exhaust the stack.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of_page(x.as_py()) for x in batch.column(1)]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=[key, "text", "n_lines"]
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"`{key}` {kind}, text string, n_lines long")
