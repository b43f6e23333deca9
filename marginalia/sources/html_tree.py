"""A small tree of an HTML page, built on the standard library's tokenizer.

Handles what real pages rely on: implied end tags, void elements, raw text in
scripts and styles, and formatting elements left open, which carry on into the
following blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Element categories of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
BLOCKS = CLOSES_P | frozenset("body canvas dd dt frameset html isindex li noframes noscript output tbody td tfoot th thead tr".split())
HEAD = frozenset("title meta link base script style noscript".split())
#: What a start tag closes first, and the ancestors at which that search stops.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "facts")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent, self.facts = tag, attrs or {}, [], None, {}

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name) or default

    def add(self, child: Node | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.remove()
            child.parent = self
        self.children.append(child)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, new: list[Node | str]) -> None:
        parent, at = self.parent, next(i for i, c in enumerate(self.parent.children) if c is self)
        for n in new:
            if isinstance(n, Node):
                n.remove()
                n.parent = parent
        parent.children[at : at + 1] = new
        self.parent = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Every element below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += node.children[::-1]
        return "".join(out)

    def ancestors(self, most: int | None = None) -> list[Node]:
        out, node = [], self.parent
        while node is not None and (most is None or len(out) < most):
            out.append(node)
            node = node.parent
        return out

    def copy(self) -> Node:
        root = Node(self.tag, dict(self.attrs))
        stack = [(self, root)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                if isinstance(c, str):
                    new.children.append(c)
                else:
                    own = Node(c.tag, dict(c.attrs))
                    own.parent = new
                    new.children.append(own)
                    stack.append((c, own))
        return root

    def named(self) -> str:
        return f"{self.get('class')} {self.get('id')}"


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.root.add(self.head)
        self.root.add(self.body)
        self.open: list[Node] = []
        self.active: list[tuple[str, dict]] = []
        self.in_body = False

    def place(self) -> Node:
        return self.open[-1] if self.open else self.body

    def close(self, tags, stops=()) -> bool:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k].tag
            if tag in tags:
                del self.open[k:]
                return True
            if tag in stops:
                return False
        return False

    def restore(self) -> None:
        """Reopen formatting elements that a closed block left open."""
        for tag, attrs in self.active[sum(n.tag in FORMATTING for n in self.open) :] if self.active else ():
            self.push(Node(tag, dict(attrs)))

    def push(self, node: Node) -> None:
        self.place().add(node)
        self.open.append(node)

    def handle_starttag(self, tag, pairs):
        attrs = {}
        for k, v in pairs:
            attrs.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            (self.root if tag == "html" else self.head if tag == "head" else self.body).attrs.update(attrs)
            self.in_body |= tag == "body"
            return
        if not self.in_body and not self.open and tag in HEAD:
            node = Node(tag, attrs)
            self.head.add(node)
            if tag not in VOID:
                self.open.append(node)
            return
        self.in_body = True
        if tag in CLOSES_P:
            self.close(("p",), ("table", "td", "th", "button"))
        if tag in ENDED_BY:
            self.close(*ENDED_BY[tag])
        if tag[0] == "h" and tag[1:].isdigit() and self.open and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self.open.pop()
        if tag == "a" and any(t == "a" for t, _ in self.active):
            self.handle_endtag("a")
        if tag not in BLOCKS:
            self.restore()
        node = Node(tag, attrs)
        if tag in VOID:
            self.place().add(node)
            return
        self.push(node)
        if tag in FORMATTING:
            self.active.append((tag, attrs))

    def handle_startendtag(self, tag, pairs):
        self.handle_starttag(tag, pairs)
        if tag not in VOID and tag in ("svg", "path", "circle", "rect", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("html", "head", "body"):
            return
        if tag == "br":
            return self.handle_starttag("br", [])
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.place().add(Node("p"))
            return None
        if tag in FORMATTING:
            for k in range(len(self.active) - 1, -1, -1):
                if self.active[k][0] == tag:
                    del self.active[k]
                    break
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
                if self.open[k].tag in BLOCKS:
                    break
            return None
        if tag[0] == "h" and tag[1:].isdigit():
            self.close(("h1", "h2", "h3", "h4", "h5", "h6"))
            return None
        self.close((tag,), () if tag in BLOCKS else tuple(BLOCKS))
        return None

    def handle_data(self, data):
        if not self.in_body and not self.open:
            if not data.strip():
                return
            self.in_body = True
        if not self.open or self.open[-1].tag not in ("script", "style", "title", "textarea"):
            if data.strip():
                self.restore()
        self.place().add(data)


def parse(html: str | None) -> Node:
    """The ``html`` element with its head and body; any text parses."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close_all = True
    HTMLParser.close(builder)
    return builder.root
