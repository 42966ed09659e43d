"""A small HTML tree builder on the standard library's tokenizer.

It follows the HTML rules that change what a page's elements contain: void elements, implied html, head and body, raw
text, end tags implied by block starts, list items, table parts and options. Misnested formatting is closed with its
block instead of being reopened after it, and foreign content is kept as plain elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
RAW = frozenset("iframe noembed noframes noscript xmp textarea title".split())
RCDATA = frozenset(["textarea", "title"])
SCOPE = frozenset("html table td th caption button object marquee template".split())
#: A start tag closes these when open, up to one of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element: tag in lower case, attributes (the first of a name counts), children (elements and strings)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if child.__class__ is Node:
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if child.__class__ is str:
                    out.append(child)
                elif child.tag not in skip:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return "".join(out)

    def ancestors(self) -> Iterator[Node]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def next_element(self) -> Node | None:
        siblings = self.parent.children if self.parent else []
        seen = False
        for s in siblings:
            if seen and s.__class__ is Node:
                return s
            seen = seen or s is self
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.html = Node("html", {}, self.root)
        self.root.children.append(self.html)
        self.head = Node("head", {}, self.html)
        self.body = Node("body", {}, self.html)
        self.html.children += [self.head, self.body]
        self.open, self.in_body, self.raw = [self.head], False, ""

    def _to_body(self) -> None:
        if not self.in_body:
            self.in_body, self.open = True, [self.body]

    def _close(self, tags: frozenset[str], until: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                if not tags - {tag}:
                    return
            elif tag in until or tag in SCOPE and tag not in ("td", "th"):
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.raw:
            self.handle_data(self.get_starttag_text() or "")
            return
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self._to_body()
            return
        if not self.in_body and tag not in HEAD_ONLY and self.open[-1] is self.head:
            self._to_body()
        if self.in_body:
            if tag in CLOSES_P:
                self._close(frozenset(["p"]), frozenset(["button"]))
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
            if tag == "a" and any(x.tag == "a" for x in self.open):
                self._close(frozenset(["a"]), frozenset())
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in RAW:
                self.raw = tag
            if tag in RCDATA:
                self.set_cdata_mode(tag)  # what looks like a tag or comment there is text

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.raw:
            if tag != self.raw:
                self.handle_data(f"</{tag}>")
                return
            self.raw = ""
        if tag == "head":
            self._to_body()
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(x.tag == "p" for x in self.open):
            self.handle_starttag("p", [])
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag or tag in HEADINGS and self.open[i].tag in HEADINGS:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # the tokenizer raises an error for names that it doesn't know

    def handle_data(self, data: str) -> None:
        if not data:
            return
        if self.cdata_elem in RCDATA and not getattr(self, "_escapable", False):  # later tokenizers decode references there themselves
            data = unescape(data)
        if not self.in_body and self.open[-1] is self.head:
            if not data.strip():
                return
            self._to_body()
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    if builder.raw in RCDATA and builder.cdata_elem:
        builder.handle_data(builder.rawdata)  # never closed: all the rest
    return builder.root
