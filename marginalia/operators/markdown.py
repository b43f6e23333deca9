"""From an element to Markdown, and the page operator that does it all in one Arrow stage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.operators import html_article as article
from marginalia.sources.html_tree import BLOCKS, VOID, Node

MEANINGFUL = frozenset("a table thead tbody tfoot th td iframe script audio video".split())
# What is escaped in running text, in order; those with ^ only where the text begins.
ESCAPES = [(re.compile(a), b) for a, b in ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), ("`", r"\\`"), ("^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), ("^>", r"\\>"), ("_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "))]
TRUNCATE = 100_000


@dataclass(frozen=True)
class Options:
    """What a conversion keeps and adds."""

    scope: str = "mainContent"
    images: bool = True
    links: bool = True
    tables: bool = True
    title: bool = True
    template: str | None = None


def collapse(root: Node) -> None:
    """White space as a browser shows it: one space between words, none at the edges of blocks; PRE keeps its own."""
    last: list | None = None  # (children list, index) of the text before, while it may lose its end
    open_space = True  # whether a space would stand at a block's edge or after another

    def visit(node: Node) -> None:
        nonlocal last, open_space
        if node.tag == "pre" or node.tag == "code" and any(a.tag == "pre" for a in node.ancestors()):
            last, open_space = None, False
            return
        kids = node.children
        for i, c in enumerate(kids):
            if isinstance(c, str):
                text = re.sub(r"[ \t\r\n]+", " ", c)
                if open_space and text.startswith(" "):
                    text = text[1:]
                kids[i] = text
                if text:
                    last, open_space = [kids, i], text.endswith(" ")
            elif c.tag in BLOCKS or c.tag == "br":
                trim()
                last, open_space = None, True
                visit(c)
                if c.tag != "br":
                    trim()
                last, open_space = None, True
            elif c.tag in VOID:
                last, open_space = None, False
            else:
                visit(c)
        node.children = [c for c in node.children if c != ""]

    def trim() -> None:
        if last is not None and isinstance(last[0][last[1]], str):
            last[0][last[1]] = last[0][last[1]].rstrip(" ")

    visit(root)
    trim()
    for n in [root, *root.walk()]:
        n.children = [c for c in n.children if c != ""]


def blank(node: Node) -> bool:
    keep = lambda n: n.tag in VOID or n.tag in MEANINGFUL
    return not keep(node) and not node.text().strip() and not any(keep(d) for d in node.walk())


def joined(parts: list[str]) -> str:
    """Texts joined so that at most two line ends stand between them."""
    out = ""
    for p in parts:
        a, b = out.rstrip("\n"), p.lstrip("\n")
        gap = max(len(out) - len(a), len(p) - len(b))
        out = a + "\n" * min(gap, 2) + b
    return out


def escaped(text: str) -> str:
    for pattern, to in ESCAPES:
        text = pattern.sub(to, text)
    return text


class Renderer:
    def __init__(self, options: Options):
        self.o = options

    def inside(self, node: Node) -> str:
        parts = []
        for i, c in enumerate(node.children):
            if isinstance(c, str):
                in_code = any(a.tag in ("code", "pre") for a in [node, *node.ancestors()])
                parts.append(c if in_code else escaped(c))
            else:
                parts.append(self.node(c, i))
        return joined(parts)

    def node(self, n: Node, at: int) -> str:
        block = n.tag in BLOCKS
        if blank(n):
            return "\n\n" if block else " " if n.text().strip("\n\r\t ") == "" and " " in n.text() else ""
        content = self.inside(n)
        lead = trail = ""
        if not block and n.tag not in VOID and n.tag != "code":
            # White space at an inline element's edges stands outside its marks, once.
            bare = content.strip(" \t\r\n")
            if bare:
                k = content.index(bare)
                lead, trail = content[:k], content[k + len(bare) :]
            before = n.parent.children[at - 1] if n.parent and at else None
            after = n.parent.children[at + 1] if n.parent and at + 1 < len(n.parent.children) else None
            edge = lambda x, end: (x if isinstance(x, str) else x.text() if isinstance(x, Node) and x.tag not in BLOCKS else "")[-1:] == " " if end else (x if isinstance(x, str) else x.text() if isinstance(x, Node) and x.tag not in BLOCKS else "")[:1] == " "
            lead = "" if lead and edge(before, True) else lead
            trail = "" if trail and edge(after, False) else trail
            content = bare
        return lead + self.element(n, content) + trail

    def element(self, n: Node, content: str) -> str:
        rule = getattr(self, "do_" + n.tag, None)
        if rule:
            return rule(n, content)
        return f"\n\n{content}\n\n" if n.tag in BLOCKS else content

    def do_br(self, n, c):
        return "  \n"

    def do_hr(self, n, c):
        return "\n\n---\n\n"

    def heading(self, n, c):
        return f"\n\n{'#' * int(n.tag[1])} {c}\n\n"

    do_h1 = do_h2 = do_h3 = do_h4 = do_h5 = do_h6 = heading

    def do_blockquote(self, n, c):
        return "\n\n" + "\n".join("> " + x for x in c.strip("\n").split("\n")) + "\n\n"

    def do_ul(self, n, c):
        up = n.parent
        return "\n" + c if up is not None and up.tag == "li" and up.elements() and up.elements()[-1] is n else f"\n\n{c}\n\n"

    do_ol = do_ul

    def do_li(self, n, c):
        mark, up = "-   ", n.parent
        if up is not None and up.tag == "ol":
            k = next(i for i, x in enumerate(up.elements()) if x is n)
            mark = f"{int(up.get('start')) + k if re.fullmatch(r'-?[0-9]+', up.get('start')) else k + 1}.  "
        body = c.strip("\n") + ("\n" if c.endswith("\n") else "")
        more = up is not None and n is not up.children[-1]
        return mark + body.replace("\n", "\n" + " " * len(mark)) + ("\n" if more else "")

    def do_a(self, n, c):
        href = n.get("href")
        if not href or not self.o.links:
            return c
        title = re.sub(r"(\n+\s*)+", "\n", n.get("title")).replace('"', '\\"')
        return f"[{c}]({re.sub(r'([()])', r'\\\1', href)}{f' {chr(34)}{title}{chr(34)}' if title else ''})"

    def do_img(self, n, c):
        if not self.o.images or not n.get("src"):
            return ""
        title = re.sub(r"(\n+\s*)+", "\n", n.get("title"))
        return f"![{re.sub(r'(\n+\s*)+', chr(10), n.get('alt'))}]({n.get('src')}{f' {chr(34)}{title}{chr(34)}' if title else ''})"

    def do_em(self, n, c):
        return f"*{c}*" if c.strip() else ""

    def do_strong(self, n, c):
        return f"**{c}**" if c.strip() else ""

    do_i, do_b = do_em, do_strong

    def do_code(self, n, c):
        c = re.sub(r"\r?\n|\r", " ", c)
        runs = {len(r) for r in re.findall("`+", c)}
        size = next(k for k in range(1, len(runs) + 2) if k not in runs)
        pad = " " if re.match(r"`|^ .*?[^ ].* $", c) or c.endswith("`") else ""
        return f"{'`' * size}{pad}{c}{pad}{'`' * size}" if c else ""

    def do_pre(self, n, c):
        code = (n.find("code") or [None])[0]
        label = re.search(r"(?:language|lang)-(\S+)", f"{code.get('class') if code else ''} {n.get('class')}")
        own = (code or n).copy()
        for br in own.find("br"):
            br.replace(["\n"])
        text = re.sub(r"\n\Z", "", own.text())
        size = max([3, *(len(f) + 1 for f in re.findall("^`{3,}", text, re.M))])
        return f"\n\n{'`' * size}{label[1] if label else ''}\n{text}\n{'`' * size}\n\n"

    def do_table(self, n, c):
        return f"\n\n{c}\n\n"

    def do_tr(self, n, c):
        if not self.o.tables:
            return f"\n\n{c}\n\n"
        cells = n.find("th", "td")
        return "|" + c + "\n" + ("|" + " --- |" * len(cells) + "\n" if any(x.tag == "th" for x in cells) else "")

    def do_td(self, n, c):
        return f" {c.strip()} |" if self.o.tables else f"\n\n{c}\n\n"

    do_th = do_td

    def section(self, n, c):
        return c if self.o.tables else f"\n\n{c}\n\n"

    do_thead = do_tbody = section

    # An empty cell keeps its bar.
    def render(self, root: Node) -> str:
        collapse(root)
        return self.inside(root).lstrip("\t\r\n").rstrip("\t\r\n ")


def convert(html: str | None, url: str, options: Options = Options()) -> dict:
    """Markdown, article data and measures of one page; null and empty pages give empty Markdown."""
    found, about, page = article.extract(html, url)
    body = page.elements()[1]
    shell = any((n.get("id") in article.SHELLS or n.tag == "app-root" or "ng-version" in n.attrs) and not n.text().strip() for n in body.walk())
    frames = [f.get("src") for f in body.find("iframe") if re.match("https?://", f.get("src"), re.I)]
    if options.scope == "fullPage":
        content = body.copy()
        for f in content.find("iframe"):
            f.replace([f"[Embedded content: {f.get('src') or 'inline'}]"])
        size = len(content.text().strip())
    else:
        content, size = (found, len(found.text().strip())) if found is not None else (article.fallback(page), 0)
    article.finish(content, article.base_of(page, url), options.images)
    titles = page.find("title")
    title = (titles[0].text().strip() if titles else "") or url
    text = Renderer(options).render(content)
    if options.title and text and title:
        text = f"# {title}\n\n{text}"
    if frames:
        text += f"\n\n---\n> **Note:** This page was captured from its server-rendered HTML, so the content of {len(frames)} embedded frame(s) was never loaded and is not included. Links to those frames have been preserved where possible.\n"
    text = re.sub(r"\n{3,}", "\n\n", text)
    text = re.sub(r"([^\n])(\n#{1,6} )", r"\1\n\n\2", text)
    text = re.sub(r"(\n[*\-+] [^\n]+)(\n[*\-+] )", r"\1\n\2", text)
    if options.template:
        known = {"title": about["title"] or title, "url": url, "date": about["published"], "author": about["author"], "siteName": about["site"], "excerpt": about["excerpt"]}
        text += "\n\n" + re.sub(r"\{(title|url|date|author|siteName|excerpt)\}", lambda m: known[m[1]], options.template)
    words = len(text.split())
    return {
        "markdown": text, "title": title, "article_title": about["title"] if found is not None else None, "author": about["author"], "site_name": about["site"],
        "published": about["published"], "excerpt": about["excerpt"], "text_length": size, "body_text_length": len(body.text().strip()), "empty_app_shell": shell,
        "token_count": -(-max(words * 3, len(text.encode("utf-16-le")) // 2) // 4),
    }


FIELDS = pa.schema([("markdown", pa.string()), ("title", pa.string()), ("article_title", pa.string()), ("author", pa.string()), ("site_name", pa.string()), ("published", pa.string()), ("excerpt", pa.string()), ("text_length", pa.int32()), ("body_text_length", pa.int32()), ("empty_app_shell", pa.bool_()), ("token_count", pa.int32())])
DDL = "markdown string, title string, article_title string, author string, site_name string, published string, excerpt string, text_length int, body_text_length int, empty_app_shell boolean, token_count int"


def pages_to_markdown(pages: DataFrame, ident: str = "page_id", options: Options = Options()) -> DataFrame:
    """``ident``, url and the columns of DDL for each page; one narrow stage, no shuffle.

    A page that cannot be converted keeps its row, with null Markdown.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    try:
                        rows.append(convert(html, url or "", options))
                    except (RecursionError, ValueError):
                        rows.append(dict.fromkeys(FIELDS.names))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[f.name] for r in rows], f.type) for f in FIELDS)], names=[ident, "url", *FIELDS.names])

    return pages.select(ident, "url", "html").mapInArrow(run, f"{ident} {kinds[ident]}, url string, {DDL}")
