"""HTML as readable Markdown, and removal of noise blocks that need balanced tags: plain Python on one text."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from corpusmill.functions import patterns as P

HINT = re.compile(P.HTML_HINT)
TAG = re.compile(r"(?is)</?([a-z][a-z0-9:-]*)(?:\s+[^<>]*)?/?>")
NOISE_OPEN = {t: re.compile(rf"(?is)<{t}\b[^>]*{P.NOISE_ATTRIBUTE}[^>]*>") for t in P.NOISE_TAGS}
UNCLOSED = re.compile(P.UNCLOSED_END)
PRE = re.compile(r"(?is)<pre\b[^>]*>(.*?)</pre>")
CODE = re.compile(r"(?is)<code\b[^>]*>(.*?)</code>")
CODE_TAGS = re.compile(r"(?is)</?code\b[^>]*>")
SPACES, BLANK_LINES = re.compile(r"[ \t]{2,}"), re.compile(P.BLANK_LINES)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript svg meta link head template".split())
SPACED = frozenset("html body main article p div section header blockquote ul ol".split())
#: An opening tag ends these open elements, looked for no further out than the last set.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Tags as the writer without a tree sees them.
TABLE, ROW = re.compile(r"(?is)<table\b[^>]*>(.*?)</table>"), re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr>")
CELL = re.compile(r"(?is)<(?:th|td)\b[^>]*>(.*?)</(?:th|td)>")
LINK = re.compile(r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""")
HEADING = re.compile(r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>")
BACKTICKED = re.compile(r"`[^`\n]+`")
STRUCTURE = (
    (re.compile(r"(?is)<br\s*/?>"), "\n"),
    (re.compile(r"(?is)<li\b[^>]*>"), "\n- "),
    (re.compile(r"(?is)</li>"), "\n"),
    (re.compile(r"(?is)</(?:p|div|section|article|main|header|blockquote|ul|ol|tr)>"), "\n\n"),
    (re.compile(r"(?is)<(?:p|div|section|article|main|header|blockquote|ul|ol|tr)\b[^>]*>"), "\n"),
)


def tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


def noise_blocks(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A page without elements whose attributes name noise; and for each tag removed a label, tokens and number.

    An element ends where its tags are balanced, which patterns can't tell; noise that patterns find is none of this.
    """
    gone: list[tuple[str, int, int]] = []
    if not HINT.search(text):
        return text, gone
    for tag, opening in NOISE_OPEN.items():
        out, found, at = [], [], 0
        while m := opening.search(text, at):
            end = block_end(text, tag, m.end())
            out += [text[at : m.start()], "\n"]
            found.append(text[m.start() : end])
            at = end
        if found:
            gone.append((f"HTML boilerplate block: {tag} noise", sum(map(tokens, found)), len(found)))
            text = "".join([*out, text[at:]])
    return text, gone


def block_end(text: str, tag: str, at: int) -> int:
    """Where the element that opened before ``at`` ends; if it never does, the next sure boundary or the text's end."""
    depth = 1
    for m in TAG.finditer(text, at):
        if m.group(1).lower() == tag:
            if m.group().startswith("</"):
                depth -= 1
                if not depth:
                    return m.end()
            elif not m.group().endswith("/>"):
                depth += 1
    m = UNCLOSED.search(text, at)
    return m.start() if m else len(text)


class Element:
    """A node of the parsed page; children are elements and strings."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class Tree(HTMLParser):
    """Builds elements, closing what HTML leaves open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def _close(self, tags: set[str], limits: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        own = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(own)
        if tag not in VOID:
            self.open.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def text_of(node: Element, raw: bool) -> str:
    """All text below a node, however deep; ``raw``: with line ends for br."""
    out, left = [], list(reversed(node.children))
    while left:
        child = left.pop()
        if isinstance(child, str):
            out.append(child)
        elif raw and child.tag == "br":
            out.append("\n")
        elif child.tag not in ("script", "style", "noscript", "svg"):
            left.extend(reversed(child.children))
    return "".join(out)


def inline(text: str) -> str:
    return SPACES.sub(" ", text).strip()


def is_noise(node: Element, aggressive: bool) -> bool:
    terms = P.RENDER_NOISE_TERMS + (P.AGGRESSIVE_TERMS if aggressive else ())
    return any(t in node.attributes.get(a, "").lower() for a in P.NOISE_ATTRIBUTES for t in terms)


class Writer:
    """Writes elements as Markdown; what is still to be written lies on a stack, so that pages may be nested to any depth."""

    GAP = object()

    def __init__(self, mode: str):
        self.mode, self.parts = mode, []
        self.left: list = []

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def gap(self) -> None:
        """A blank line, unless nothing stands before it."""
        while self.parts:
            last = self.parts.pop().rstrip(" \t")
            if last:
                self.parts.append(last)
                break
        if self.parts:
            end = (self.parts[-2][-1:] if len(self.parts) > 1 and len(self.parts[-1]) < 2 else "") + self.parts[-1][-2:]
            self.add("\n" * (2 - len(end) + len(end.rstrip("\n"))))

    def spaced(self, text: str) -> None:
        self.gap()
        self.add(text)
        self.gap()

    def below(self, node: Element, *after: object) -> None:
        """A node's children come next, then ``after``."""
        self.left.extend(reversed(after))
        self.left.extend(reversed(node.children))

    def write(self, root: Element) -> str:
        self.below(root)
        while self.left:
            item = self.left.pop()
            if item is self.GAP:
                self.gap()
            elif isinstance(item, str):
                self.add(item)
            else:
                self.element(item)
        return "".join(self.parts)

    def element(self, node: Element) -> None:
        tag, strict = node.tag, self.mode != "light"
        if tag in HIDDEN or (strict and tag in ("nav", "footer", "aside")):
            return
        if strict and tag in (*P.NOISE_TAGS, "iframe") and is_noise(node, self.mode == "aggressive"):
            return
        if tag == "br":
            self.add("\n")
        elif tag in SPACED:
            self.gap()
            self.below(node, self.GAP)
        elif tag == "li":
            self.add("\n- ")
            self.below(node, "\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            if label := inline(text_of(node, False)):
                self.spaced("#" * int(tag[1]) + " " + label)
        elif tag == "a":
            label, target = inline(text_of(node, False)), node.attributes.get("href", "").strip()
            self.add(f"[{label}]({target})" if label and target else label)
        elif tag == "table":
            if found := rows_of(node):
                self.spaced(table(found))
        elif tag == "pre":
            if (code := text_of(node, True)).strip():
                stripped = code.strip("\n")
                self.spaced(f"```\n{stripped}\n```")
        elif tag == "code":
            if (code := text_of(node, True)).strip():
                self.add(f"`{inline(code)}`")
        else:
            self.below(node)


def rows_of(node: Element) -> list[list[str]]:
    """Rows of a table and of tables within, each with its cells that hold text."""
    out: list[list[str]] = []
    left: list[tuple[Element, list[str] | None]] = [(node, None)]
    while left:
        own, row = left.pop()
        if row is not None and own.tag in ("td", "th"):
            if label := inline(text_of(own, False)):
                row.append(label.replace("|", "\\|"))
            continue
        if row is None and own.tag == "tr":
            row = []
            out.append(row)
        left.extend((c, row) for c in reversed(own.children) if not isinstance(c, str))
    return [row for row in out if row]


def table(rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |\n"
    return line(rows[0]) + line(["---"] * len(rows[0])) + "".join(map(line, rows[1:]))


class Held:
    """Pieces set aside under marks that the text itself doesn't hold."""

    def __init__(self, text: str):
        self.mark = "\ue000"
        while self.mark in text:
            self.mark += "\ue000"
        self.pieces: list[str] = []

    def hold(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"{self.mark}{len(self.pieces) - 1}\ue001"

    def restored(self, text: str) -> str:
        # No digit follows a shorter run of the mark's character, so a run before a mark does no harm.
        return re.sub(self.mark + "(\\d+)\ue001", lambda m: self.pieces[int(m.group(1))], text) if self.pieces else text


def tidy(text: str) -> str:
    lines = "\n".join(inline(x) for x in text.split("\n"))
    return BLANK_LINES.sub("\n\n", lines).strip()


def plain(text: str) -> str:
    return inline(TAG.sub("", text))


def by_patterns(text: str) -> str:
    """A page written without a tree, tag by tag: for pages whose tree has nothing to show."""

    def rows(m: re.Match) -> str:
        found = [[c.replace("|", "\\|") for x in CELL.findall(row) if (c := plain(x))] for row in ROW.findall(m.group(1))]
        found = [row for row in found if row]
        return f"\n\n{table(found)}\n" if found else "\n"

    def link(m: re.Match) -> str:
        target, label = m.group(1).strip(), plain(m.group(2))
        return f"[{label}]({target})" if target and label else label

    def heading(m: re.Match) -> str:
        label = plain(m.group(2))
        return f"\n\n{'#' * int(m.group(1))} {label}\n\n" if label else "\n"

    text = HEADING.sub(heading, LINK.sub(link, TABLE.sub(rows, text)))
    text = CODE.sub(lambda m: f"`{c}`" if (c := inline(m.group(1))) else "", text)
    held = Held(text)
    text = BACKTICKED.sub(lambda m: held.hold(m.group()), text)
    for pattern, made in STRUCTURE:
        text = pattern.sub(made, text)
    return held.restored(tidy(TAG.sub("", text)))


def markdown(text: str, mode: str = "standard") -> str:
    """A page as Markdown; what is no HTML stays as it is. Code is set aside first, so that nothing in it is a tag."""
    if not HINT.search(text):
        return text
    held = Held(text)
    safe = PRE.sub(lambda m: "\n" + held.hold("\n\n```\n" + CODE_TAGS.sub("", m.group(1)).strip("\n") + "\n```\n\n") + "\n", text)
    safe = CODE.sub(lambda m: held.hold(f"`{c}`" if (c := inline(m.group(1))) else ""), safe)
    tree = Tree()
    tree.feed(safe)
    tree.close()
    out = held.restored(tidy(Writer(mode).write(tree.root)) or by_patterns(safe))
    out = BLANK_LINES.sub("\n\n", out).strip()
    if mode == "aggressive":
        out = "\n".join(x for x in out.split("\n") if not (len(x.strip()) > 6 and set(x.strip()) <= set("-_=")))
    return out
