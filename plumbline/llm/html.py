"""Visible text of web pages by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The parser scans a page once; its tree is walked with an own stack, so depth
costs no recursion.  Rendering keeps what layout says: blocks on lines of
their own, a blank line around paragraphs, headings, lists and tables, list
items with a bullet or number and indented by depth, preformatted text as it
is, and table cells padded so that columns align.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.store import arrow_bytes

#: Fixed values of HTML: elements without content, with raw content, without a box, blocks, and those with space around.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noembed noframes".split())
#: Within a formula, and within a drawing, where only text elements and embedded pages show words.
_UNSEEN_IN = {"math": frozenset(("annotation", "annotation-xml")), "svg": frozenset("defs symbol desc metadata clippath mask pattern marker".split())}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dir dt figcaption footer form header hgroup hr legend li main menu nav section summary caption tr thead tbody tfoot option search".split())
#: A start tag closes an open element of these, looking no further up than the scope.
_CLOSES_P = BLOCKS - frozenset("html body caption tr thead tbody tfoot option legend".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "caption"), ("table",)),
    "body": (("head",), ("html",)),
}
#: An end tag doesn't reach over these.
SCOPE = frozenset("table td th caption template html".split())

_MARKUP = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*)(?:>|\Z)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SHOWING = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
#: A selector of one element: a name or none, then classes and ids.
_COMPOUND = re.compile(r"(\*|[\w-]+)?((?:[.#][\w-]+)*)")
_QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|<!--|-->", re.S)
_FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*(\d+(?:\.\d*)?|\.\d+)(px|r?em)?\s*\)")
#: Columns of pixels of the screen for which style sheets are read.
SCREEN = 1280
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds for a screen of SCREEN pixels; one with a condition on anything else doesn't."""

    def holds(query: str) -> bool:
        kind, *features = re.split(r"\s+and\s+", query.strip().lower().removeprefix("only "))
        if kind not in ("", "all", "screen"):
            features = [kind, *features]
        for f in features:
            m = _FEATURE.fullmatch(f.strip())
            if not m:
                return False
            w = float(m[2]) * (16 if m[3] in ("em", "rem") else 1)
            if w > SCREEN if m[1] == "min" else w < SCREEN:
                return False
        return True

    return any(map(holds, media.split(",")))


def _applies(head: str) -> bool:
    name, _, rest = head.partition(" ") if "(" not in head.split(" ", 1)[0] else head.partition("(")
    name = name.lower()
    if name == "@media":
        return on_screen("(" + rest if "(" in head.split(" ", 1)[0] else rest)
    return name == "@layer" or name == "@supports" and not rest.strip().lower().startswith("not")


def rules(css: str):
    """(selectors, declarations) that hold on a screen, in order."""
    css = _QUOTED.sub(" ", css)
    stack: list[tuple[str | None, bool, bool]] = []  # open blocks: selectors (None of an at-rule), whether they hold, whether a rule is open
    for text, brace in re.findall(r"([^{}]*)([{}])", css + "}" * css.count("{")):
        holds, within = stack[-1][1:] if stack else (True, False)
        if brace == "{":
            before, _, head = text.rpartition(";")
            if stack and stack[-1][0] and holds:
                yield stack[-1][0], before
            head = " ".join(head.split())
            if head.startswith("@"):
                stack.append((None, holds and _applies(head), within))
            else:
                stack.append((head, holds and not within, True))  # what a rule nests depends on more than a simple selector
        elif stack:
            selectors, holds, _ = stack.pop()
            if selectors and holds:
                yield selectors, text


def declared(body: str):
    """(property, value, whether important) of the declarations on display and visibility."""
    for name, value, important in _SHOWING.findall(body):
        yield name.lower(), value.lower(), bool(important)


def parse(page: str) -> tuple[Node, dict]:
    """(tree, what style sheets declare for selectors of one element).

    By the selector's last id or class or its name: the names, classes and ids
    that an element must have besides, and for each property the strongest
    weight and its value.
    """
    root = Node("#root", {})
    stack, sheet, at = [root], {}, 0
    order = 0
    opened: Counter[str] = Counter()  # by name, so that a deep stack isn't searched for what it doesn't have

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s))

    def cut(k: int) -> None:
        opened.subtract(n.name for n in stack[k:])
        del stack[k:]

    def close(names, scope) -> None:
        while any(opened[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    cut(k)
                    break
                if stack[k].name in scope:
                    return
            if len(names) < 3:  # else a row may be open inside a body that ends too
                return

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _MARKUP.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if name := m["end"]:
            name = name.lower()
            if name == "p" and not opened["p"]:
                stack[-1].kids.append(Node("p", {}))  # a lone </p> is an empty paragraph
            elif name == "br":
                stack[-1].kids.append(Node("br", {}))
            else:
                close((name,), SCOPE - {name} if name not in ("table", "html", "body", "template") else ())
        elif name := m["tag"]:
            name = name.lower()
            attrs = {}
            for a in _ATTR.finditer(m["attrs"]):
                attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            if name in ("html", "body") and opened[name]:
                continue
            if name in _CLOSES_P:
                close(("p",), SCOPE | {"button", "object"})
            if name in IMPLIED:
                close(*IMPLIED[name])
            if name in BLOCKS and stack[-1].name == "head" or name in ("a", "span", "img") and stack[-1].name == "head":
                cut(len(stack) - 1)
            node = Node(name, attrs)
            stack[-1].kids.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])|\Z", re.I).search(page, at)
                raw = page[at : end.start()]
                if name == "style" and on_screen(attrs.get("media", "")):
                    for selectors, body in rules(raw):
                        order += 1
                        for sel in selectors.split(","):
                            if (m := _COMPOUND.fullmatch(sel.strip())) and m[0]:
                                tag, marks = (m[1] or "").lower(), re.findall(r"[.#][\w-]+", m[2])
                                parts = [*([tag] if tag not in ("", "*") else []), *sorted(set(marks), key=lambda x: (x[0] == "#", x))]
                                key, also = (parts[-1], frozenset(parts[:-1])) if parts else ("*", frozenset())
                                power = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), int(tag not in ("", "*")))
                                for what, value, important in declared(body):
                                    mine = sheet.setdefault(key, {}).setdefault(also, {})
                                    weight = (important, power, order)
                                    if weight >= mine.get(what, ((),))[0]:
                                        mine[what] = (weight, value)
                if name == "textarea":
                    raw = html.unescape(raw.removeprefix("\n"))
                node.kids.append(raw)
                close_at = page.find(">", end.start())
                at = len(page) if end.start() == len(page) or close_at < 0 else close_at + 1
            elif name not in VOID:
                stack.append(node)
                opened[name] += 1
    return root, sheet


def style_of(node: Node, sheet: dict) -> dict[str, str]:
    """display and visibility of an element, where declared: the strongest declaration, of equally strong ones the last."""
    a, best = node.attrs, {}
    own = (4,)  # an element's own style is stronger than any selector
    if "hidden" in a or (node.name == "dialog" and "open" not in a):
        best["display"] = ((False, (0,), 0), "none")
    if sheet:
        keys = ["*", node.name, *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if "id" in a else [])]
        have = set(keys)
        for key in keys:
            for also, found in sheet.get(key, {}).items():
                if also <= have:
                    for what, x in found.items():
                        best[what] = max(best.get(what, ((False, (-1,), 0), "")), x)
    for k, (what, value, important) in enumerate(declared(a.get("style", "")) if "style" in a else ()):
        best[what] = max(best.get(what, ((False, (-1,), 0), "")), ((important, (1 << 30, *own), k), value), key=lambda x: x[0])
    return {what: value for what, (_, value) in best.items()}


def options(select: Node) -> list:
    """What a select element shows: the chosen option's words, or all of a list box."""
    every, todo = [], list(reversed(select.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, Node):
            if k.name == "option":
                every.append(k)
            todo.extend(reversed(k.kids) if k.name != "option" else ())
    for o in every:
        if label := o.attrs.get("label"):
            o.kids = [label]
    if "multiple" in select.attrs or re.fullmatch(r"0*[1-9]\d+|0*[2-9]", select.attrs.get("size", "")):
        for k in select.kids:
            if isinstance(k, Node) and k.name == "optgroup":
                k.kids.insert(0, k.attrs.get("label", ""))
        return select.kids
    chosen = [o for o in every if "selected" in o.attrs][-1:] or [o for o in every if "disabled" not in o.attrs][:1]
    return [" ", *chosen[0].kids, " "] if chosen else []


def prune(root: Node, sheet: dict) -> None:
    """Take from a tree all that isn't shown."""
    todo = [(root, True, "")]
    while todo:
        node, shown, inside = todo.pop()
        if node.name == "select":
            node.kids = options(node)
        kids = []
        for k in node.kids:
            if isinstance(k, str):
                if shown and inside != "svg":
                    kids.append(k)
                continue
            if k.name in UNSEEN or k.name in _UNSEEN_IN.get(inside, ()):
                continue
            style = style_of(k, sheet)
            if style.get("display") == "none":
                continue
            v = style.get("visibility", "inherit")
            here = k.name if k.name in _UNSEEN_IN else "" if inside == "svg" and k.name in ("text", "foreignobject") else inside
            todo.append((k, shown if v in ("inherit", "unset") else v not in ("hidden", "collapse"), here))
            kids += [" ", k, " "] if inside == "svg" and not here else [k]
        node.kids = kids


def width(s: str) -> int:
    """Columns of a monospaced screen."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in s)


class Lines:
    """Text as it is laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines owed before the next text
        self.mark = ""  # a bullet owed before the next text
        self.indent = 0
        self.space = False  # white space owed within a line

    def put(self, s: str) -> None:
        if not self.now:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            lead = " " * self.indent
            if self.mark:
                lead, self.mark = lead[: max(0, len(lead) - len(self.mark))] + self.mark, ""
            self.now.append(lead)
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(s)

    def text(self, s: str) -> None:
        parts = _SPACE.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = self.space or bool(self.now)
        for k, w in enumerate(p for p in parts if p):
            if k:
                self.space = True
            self.put(w)
        if len(parts) > 1 and parts[-1] == "":
            self.space = bool(self.now)

    def brk(self, gap: int = 0) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        if self.now:
            self.brk()
        elif self.lines and not self.mark:
            self.gap = max(self.gap, 1)

    def verbatim(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                if self.now:
                    self.brk()
                else:
                    self.lines.append("")
            if line:
                self.put(line)

    def done(self) -> str:
        self.brk()
        return "\n".join(self.lines)


#: Tables within tables as deep as this are laid out; deeper ones are read as blocks.
NESTED = 12


def render(root: Node, depth: int = 0, pre: bool = False) -> str:
    """The visible text below a node."""
    out, stack = Lines(), [(root, 0, pre, None)]
    while stack:
        node, phase, pre, number = stack.pop()
        if isinstance(node, str):
            out.verbatim(node) if pre else out.text(node)
            continue
        name = node.name
        gap = 1 if name in SPACED else 0
        if phase:
            if name == "li":
                out.indent -= 3
                out.mark = ""
            if name in ("blockquote", "dd"):
                out.indent -= 2
            if name in ("td", "th"):
                out.space = bool(out.now)
            if name in BLOCKS:
                out.brk(0 if name in ("ul", "ol") and out.indent else gap)
            continue
        if name == "br":
            out.newline()
            continue
        if name in BLOCKS:
            out.brk(0 if name in ("ul", "ol") and out.indent else gap)
        if name == "table" and depth < NESTED and node is not root:
            for line in table(node, depth):
                out.put(line) if line else out.newline()
                out.brk()
            out.brk(1)
            continue
        if name == "li":
            out.indent += 3
            out.mark = f"{number}. " if number is not None else "-  "
        if name in ("blockquote", "dd"):
            out.indent += 2
        stack.append((node, 1, pre, None))
        pre = pre or name in ("pre", "xmp", "textarea")
        numbers, n = {}, 0
        if name == "ol":
            n = int(node.attrs["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 0
            for k in node.kids:
                if isinstance(k, Node) and k.name == "li":
                    n = int(k.attrs["value"]) if re.fullmatch(r"-?\d{1,9}", k.attrs.get("value", "")) else n + 1
                    numbers[id(k)] = n
        stack.extend((k, 0, pre, numbers.get(id(k)) if isinstance(k, Node) else None) for k in reversed(node.kids))
    return out.done()


def table(node: Node, depth: int) -> list[str]:
    """Lines of a table: a caption, then rows with their cells padded to the columns' widths.

    A cell that spans rows keeps its columns free in those below, as far as its
    group of rows goes.
    """
    rows, heads, loose = [], [], []
    todo, down = list(reversed(node.kids)), {}  # down: rows for which a column is still taken

    def free(cells: list, more: bool = True) -> None:
        """Go on to a column that isn't taken; at a row's end over all taken ones."""
        while down.get(len(cells), 0) > 0 or not more and any(c >= len(cells) for c in down):
            c = len(cells)
            cells.append([""])
            if down.get(c, 0) > 1:
                down[c] -= 1
            else:
                down.pop(c, None)

    def number(text: str, most: int) -> int:
        return min(int(text), most) if re.fullmatch(r"[1-9]\d{0,5}", text) else 1

    while todo:
        k = todo.pop()
        if k is None:
            down.clear()
        elif isinstance(k, str):
            if k.strip():
                loose.append(_SPACE.sub(" ", k).strip())
        elif k.name in ("thead", "tbody", "tfoot"):
            down.clear()
            todo.append(None)
            todo.extend(reversed(k.kids))
        elif k.name == "tr" or k.name in ("td", "th"):
            cells, new = [], {}
            for c in k.kids if k.name == "tr" else [k]:
                if isinstance(c, str):
                    if c.strip():
                        loose.append(_SPACE.sub(" ", c).strip())
                else:
                    if c.name in ("td", "th"):
                        if k.name == "tr":
                            free(cells)
                        across, rest = number(c.attrs.get("colspan", "1"), 1000), c.attrs.get("rowspan", "1").strip()
                        begin, below = len(cells), (1 << 16 if rest == "0" else number(rest, 1 << 16)) - 1
                        cells.append(render(c, depth + 1).split("\n"))
                        cells.extend([""] for _ in range(across - 1))
                        if below and k.name == "tr":
                            new.update((i, below) for i in range(begin, len(cells)))
                    else:
                        loose.append(render(c, depth + 1))
            if k.name == "tr":
                free(cells, False)
                down.update(new)
            if k.name == "tr" or not rows or not getattr(rows[-1], "open", False):
                rows.append(cells)
            else:
                rows[-1].extend(cells)
        else:
            text = render(k, depth + 1)
            if text:
                (heads if k.name == "caption" else loose).append(text)
    wide: list[int] = []
    for r in rows:
        for i, c in enumerate(r):
            w = max(map(width, c), default=0)
            if i == len(wide):
                wide.append(w)
            wide[i] = max(wide[i], w)
    lines = [x for h in [*heads, *loose] for x in h.split("\n")]
    for r in rows:
        for k in range(max((len(c) for c in r), default=0)):
            cells = [c[k] if k < len(c) else "" for c in r]
            line = "  ".join(c + " " * (wide[i] - width(c)) for i, c in enumerate(cells)).rstrip(" ")
            if line:
                lines.append(line)
    return lines


def page_text(page: str | None) -> str:
    """The visible text of a page, laid out; empty for null."""
    root, sheet = parse(page or "")
    prune(root, sheet)
    return render(root)


def _extract(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_text(x.as_py()) for x in batch.column(1)], pa.string())], ["key", "text"])


def extract_pages(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, text) for each row of pages.

    A null or empty page, and one that shows nothing, has the empty text.
    Broken markup is read as browsers do in outline: what is no tag is text,
    what isn't closed ends with its parent.  Keys aren't looked at; repeated
    rows give repeated results.  An empty table gives no rows; further columns
    are ignored.
    """
    arrow_bytes(pages.sparkSession)
    d = pages.select(F.col(key).alias("key"), F.col(page).alias("page"))
    return d.mapInArrow(_extract, f"key {dict(d.dtypes)['key']}, text string").withColumnRenamed("key", key)
