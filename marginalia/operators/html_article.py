"""From an HTML page to its main article: metadata, pruning, scoring, joining, cleaning.

One pass over a page's own tree; pages are independent, so the operator is a
narrow Arrow stage without a shuffle.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit

from marginalia.sources.html_tree import Node, parse

# Names that speak for or against an element, bounds and weights of the score.
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|"
    r"replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I
)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|"
    r"scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I
)
BYLINE = re.compile(r"byline|author|dateline|writtenby|p-author", re.I)
SHARE = re.compile(r"(\b|_)(share|sharedaddy)(\b|_)", re.I)
VIDEO = re.compile(r"//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)", re.I)
COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")
ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
SHELLS = ("root", "__next", "app")
ARTICLE_TYPES = re.compile(r"Article|Report|BlogPosting|SocialMediaPosting|DiscussionForumPosting|APIReference")
TAG_SCORES = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, **dict.fromkeys("address ol ul dl dd dt li form".split(), -3), **dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)}
SCORED = ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")
PHRASING = frozenset("abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript object output progress q ruby samp script select small span strong sub sup textarea time var wbr a del ins map".split())
BLOCK_INSIDE = ("blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")
ENOUGH, PARAGRAPH, TOP = 500, 25, 5


def squeezed(text: str) -> str:
    return re.sub(r"\s{2,}", " ", text.strip())


def link_density(node: Node) -> float:
    total = len(squeezed(node.text()))
    if not total:
        return 0.0
    return sum(len(squeezed(a.text())) * (0.3 if a.get("href").startswith("#") and len(a.get("href")) > 1 else 1) for a in node.find("a")) / total


def class_weight(node: Node) -> int:
    out = 0
    for name in (node.get("class"), node.get("id")):
        if name:
            out += 25 * bool(POSITIVE.search(name)) - 25 * bool(NEGATIVE.search(name))
    return out


def similarity(a: str, b: str) -> float:
    """One less the share of b's words that a lacks, by length."""
    own = {w for w in re.split(r"\W+", a.lower()) if w}
    words = [w for w in re.split(r"\W+", b.lower()) if w]
    if not own or not words:
        return 0.0
    return 1 - len(" ".join(w for w in words if w not in own)) / len(" ".join(words))


def hidden(node: Node) -> bool:
    style = node.get("style").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style or "hidden" in node.attrs or (node.get("aria-hidden") == "true" and "fallback-image" not in node.get("class"))


# ---------------------------------------------------------------- metadata


def meta_values(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in root.find("meta"):
        for key in (m.get("property") or m.get("name")).lower().split():
            if m.get("content"):
                out[key.strip()] = m.get("content").strip()
    return out


def json_ld(root: Node) -> dict[str, str]:
    """Fields of the first article object in the page's linked data."""
    for s in root.find("script"):
        if s.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(re.sub(r"^\s*<!\[CDATA\[|\]\]>\s*$", "", s.text()))
        except ValueError:
            continue
        found = data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []
        for item in found if isinstance(found, list) else [found]:
            kind = item.get("@type") if isinstance(item, dict) else None
            if not kind or not ARTICLE_TYPES.search(kind if isinstance(kind, str) else " ".join(map(str, kind))):
                continue
            name, headline = item.get("name"), item.get("headline")
            title = headline if isinstance(headline, str) else name
            if isinstance(name, str) and isinstance(headline, str) and name != headline:
                page = page_title(root)
                title = headline if similarity(headline, page) > 0.75 or similarity(name, page) <= 0.75 else name
            author = item.get("author")
            names = [a.get("name") for a in (author if isinstance(author, list) else [author]) if isinstance(a, dict)]
            site = item.get("publisher")
            pick = lambda x: x.strip() if isinstance(x, str) else ""
            return {
                "title": pick(title), "author": ", ".join(n.strip() for n in names if isinstance(n, str)), "excerpt": pick(item.get("description")),
                "site": pick(site.get("name")) if isinstance(site, dict) else "", "published": pick(item.get("datePublished")),
            }
    return {}


def page_title(root: Node) -> str:
    """The title without the site's name, where separators or a heading show it."""
    titles = root.find("title")
    whole = title = titles[0].text().strip() if titles else ""
    words = lambda t: len(t.split())
    parted = False
    if re.search(r" [|\-–—\\/>»] ", title):
        parted = bool(re.search(r" [\\/>»] ", title))
        title = re.sub(r"(.*) [|\-–—\\/>»] .*", r"\1", whole, flags=re.S)
        if words(title) < 3:
            title = re.sub(r"^[^|\-–—\\/>»]*[|\-–—\\/>»]", "", whole)
    elif ": " in title:
        heads = [h.text().strip() for h in root.find("h1", "h2")]
        if whole not in heads:
            title = whole.rsplit(":", 1)[1]
            if words(title) < 3:
                title = whole.split(":", 1)[1]
            elif words(whole.split(":", 1)[0]) > 5:
                title = whole
    elif not 15 <= len(title) <= 150:
        heads = root.find("h1")
        if len(heads) == 1:
            title = heads[0].text()
    title = squeezed(title)
    if words(title) <= 4 and (not parted or words(title) != words(re.sub(r"[|\-–—\\/>»]+", "", whole)) - 1):
        title = whole
    return title


def metadata(root: Node, url: str) -> dict[str, str]:
    meta, ld = meta_values(root), json_ld(root)
    first = lambda *keys: next((meta[k] for k in keys if meta.get(k)), "")
    published = ld.get("published") or first("article:published_time", "parsely-pub-date")
    return {
        "title": ld.get("title") or first("dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title", "parsely-title") or page_title(root),
        "author": ld.get("author") or first("dc:creator", "dcterm:creator", "author", "parsely-author"),
        "excerpt": ld.get("excerpt") or first("dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description", "twitter:description"),
        "site": ld.get("site") or first("og:site_name"),
        "published": published,
    }


def day_of(root: Node) -> str:
    """The publication day that metadata or a time element names, as YYYY-MM-DD in UTC."""
    meta = meta_values(root)
    values = [meta.get(k) for k in ("article:published_time", "dcterms.created", "dc.date.created", "date", "og:published_time")]
    values += [t.get("datetime") or t.text() for t in root.find("time") if "datetime" in t.attrs or "pubdate" in t.attrs]
    for v in filter(None, values):
        try:
            at = datetime.fromisoformat(v.strip().replace("Z", "+00:00"))
            return (at.astimezone(timezone.utc) if at.tzinfo else at).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return ""


# ---------------------------------------------------------------- the article


def prepare(body: Node) -> None:
    """Scripts and styles out, fonts to spans, runs of line breaks to paragraphs."""
    for n in list(body.walk()):
        if n.tag in ("script", "style", "noscript"):
            if n.tag == "noscript" and n.find("img") and not n.text().strip():
                n.replace(n.children)
            else:
                n.remove()
        elif n.tag == "font":
            n.tag = "span"
    for br in body.find("br"):
        if br.parent is None:
            continue
        kids = br.parent.children
        at = next(i for i, c in enumerate(kids) if c is br)
        end, several = at + 1, False
        while end < len(kids) and (isinstance(kids[end], str) and not kids[end].strip() or isinstance(kids[end], Node) and kids[end].tag == "br"):
            several |= isinstance(kids[end], Node)
            end += 1
        if several:
            para, stop = Node("p"), end
            while stop < len(kids) and (isinstance(kids[stop], str) or kids[stop].tag in PHRASING and kids[stop].tag != "br"):
                stop += 1
            parent, taken = br.parent, kids[end:stop]
            parent.children = kids[:at] + [para] + kids[stop:]
            para.parent = parent
            for t in taken:
                if isinstance(t, Node):
                    t.parent = None
                para.add(t)
            if parent.tag == "p":
                parent.tag = "div"


def phrasing_only(node: Node) -> bool:
    return all(isinstance(c, str) or c.tag in PHRASING and all(d.tag in PHRASING for d in c.walk()) for c in node.children)


def prune(body: Node, title: str, facts: dict, strip: bool) -> list[Node]:
    """Take out what is no content; the elements to score, with divisions of plain text turned to paragraphs."""
    score, named = [], False
    stack = [body]
    while stack:
        node = stack.pop()
        if node is not body:
            if hidden(node) or node.get("aria-modal") == "true" and node.get("role") == "dialog":
                node.remove()
                continue
            text = node.text().strip()
            if not facts.get("byline") and 0 < len(text) < 100 and (node.get("rel") == "author" or "author" in node.get("itemprop") or BYLINE.search(node.named())):
                facts["byline"] = text
                node.remove()
                continue
            if not named and node.tag in ("h1", "h2") and title and similarity(title, text) > 0.75:
                named = True
                node.remove()
                continue
            if strip:
                name = node.named()
                inside = any(a.tag in ("table", "code") for a in node.ancestors(3))
                if (UNLIKELY.search(name) and not MAYBE.search(name) and not inside and node.tag not in ("body", "a")) or node.get("role") in ROLES:
                    node.remove()
                    continue
            if node.tag in ("div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6") and not text and all(e.tag in ("br", "hr") for e in node.walk()):
                node.remove()
                continue
        if node.tag in SCORED:
            score.append(node)
        if node.tag == "div":
            fresh: list[Node | str] = []
            for c in node.children:  # runs of phrasing content become paragraphs
                plain = isinstance(c, str) or c.tag in PHRASING and all(d.tag in PHRASING for d in c.walk())
                if plain and fresh and isinstance(fresh[-1], Node) and fresh[-1].facts.get("run"):
                    fresh[-1].children.append(c)
                    if isinstance(c, Node):
                        c.parent = fresh[-1]
                elif plain and not (isinstance(c, str) and not c.strip()) and not (isinstance(c, Node) and c.tag == "br"):
                    para = Node("p")
                    para.facts["run"], para.parent = True, node
                    para.children.append(c)
                    if isinstance(c, Node):
                        c.parent = para
                    fresh.append(para)
                else:
                    fresh.append(c)
            node.children = fresh
            kids = node.elements()
            lone = len(kids) == 1 and kids[0].tag == "p" and not any(isinstance(c, str) and c.strip() for c in node.children)
            if lone and link_density(node) < 0.25:
                only = kids[0]
                node.replace([only])
                score.append(only)
                stack += only.elements()[::-1]
                continue
            if not any(d.tag in BLOCK_INSIDE for d in node.walk()):
                node.tag = "p"
                score.append(node)
        stack += node.elements()[::-1]
    return score


def grab(root: Node, title: str, facts: dict, strip: bool, weigh: bool, clean: bool) -> Node:
    """The article element found in ``root``'s body with these means."""
    body = root.elements()[1]
    weight = class_weight if weigh else lambda n: 0
    ranked: list[Node] = []
    for node in prune(body, title, facts, strip):
        text = squeezed(node.text())
        if len(text) < PARAGRAPH or node.parent is None:
            continue
        worth = 1 + len(COMMAS.split(text)) + min(len(text) // 100, 3)
        for level, up in enumerate(node.ancestors(5)):
            if up.parent is None and up.tag == "html":
                continue
            if "score" not in up.facts:
                up.facts["score"] = TAG_SCORES.get(up.tag, 0) + weight(up)
                ranked.append(up)
            up.facts["score"] += worth / (1 if level == 0 else 2 if level == 1 else level * 3)
    for n in ranked:
        n.facts["score"] *= 1 - link_density(n)
    best = sorted(ranked, key=lambda n: -n.facts["score"])[:TOP]
    if not best or best[0].tag == "body":
        top = Node("div")
        for c in list(body.children):
            top.add(c)
        body.children = []
        body.add(top)
        top.facts["score"] = TAG_SCORES["div"] + weight(top)
    else:
        top = best[0]
        rivals = [set(map(id, n.ancestors())) for n in best[1:] if n.facts["score"] >= 0.75 * top.facts["score"]]
        if len(rivals) >= 3:
            for up in top.ancestors():
                if up.tag == "body":
                    break
                if sum(id(up) in r for r in rivals) >= 3:
                    top = up
                    break
        top.facts.setdefault("score", TAG_SCORES.get(top.tag, 0) + weight(top))
        last, floor, up = top.facts["score"], top.facts["score"] / 3, top.parent
        while up is not None and up.tag != "body":
            own = up.facts.get("score")
            if own is not None:
                if own < floor:
                    break
                if own > last:
                    top = up
                    break
                last = own
            up = up.parent
        while top.parent is not None and top.parent.tag != "body" and len(top.parent.elements()) == 1:
            top = top.parent
        top.facts.setdefault("score", TAG_SCORES.get(top.tag, 0) + weight(top))
    article = Node("div")
    bound = max(10, top.facts["score"] * 0.2)
    for near in list(top.parent.elements()):
        take = near is top
        if not take:
            bonus = top.facts["score"] * 0.2 if near.get("class") and near.get("class") == top.get("class") else 0
            take = "score" in near.facts and near.facts["score"] + bonus >= bound
            if not take and near.tag == "p":
                text, density = squeezed(near.text()), link_density(near)
                take = len(text) > 80 and density < 0.25 or 0 < len(text) < 80 and density == 0 and bool(re.search(r"\.( |$)", text))
        if take:
            if near.tag not in ("div", "article", "section", "p", "ol", "ul"):
                near.tag = "div"
            article.add(near)
    tidy(article, weight, clean)
    return article


def data_table(table: Node) -> bool:
    if table.get("role") == "presentation" or table.get("datatable") == "0":
        return False
    if table.get("summary") or any(c.text().strip() for c in table.find("caption")) or table.find("col", "colgroup", "tfoot", "thead", "th"):
        return True
    if table.find("table"):
        return False
    rows = table.find("tr")
    cells = max((len([c for c in r.elements() if c.tag in ("td", "th")]) for r in rows), default=0)
    return len(rows) > 1 and cells > 1 and (len(rows) >= 10 or cells > 4 or len(rows) * cells > 10)


def dispensable(node: Node, weight, listed: bool) -> bool:
    """Whether a form, table, list or division looks like no content."""
    if any(a.tag == "table" and data_table(a) for a in [node, *node.ancestors()]) or any(a.tag == "code" for a in node.ancestors()):
        return False
    own = weight(node)
    if own < 0:
        return True
    text = squeezed(node.text())
    if len(COMMAS.findall(text)) >= 10:
        return False
    count = lambda *tags: len(node.find(*tags))
    p, img, li, inputs = count("p"), count("img"), count("li") - 100, count("input")
    embeds = [e for e in node.find("object", "embed", "iframe") if not any(VIDEO.search(v) for v in e.attrs.values())]
    density, size = link_density(node), len(text)
    figure = any(a.tag == "figure" for a in node.ancestors())
    headings = sum(len(squeezed(h.text())) for h in node.find("h1", "h2", "h3", "h4", "h5", "h6")) / size if size else 0
    bad = (
        not figure and img > 1 and p / img < 0.5 or not listed and li > p or inputs > p // 3
        or not listed and not figure and headings < 0.9 and size < 25 and (img == 0 or img > 2) and density > 0
        or not listed and own < 25 and density > 0.2 or own >= 25 and density > 0.5 or len(embeds) == 1 and size < 75 or len(embeds) > 1
        or img == 0 and not text
    )
    if listed and bad and node.elements() and all(len(e.elements()) <= 1 for e in node.elements()) and count("li") == img:
        return False
    return bad


def tidy(article: Node, weight, clean: bool) -> None:
    """Attributes of style, boilerplate elements and what conditional cleaning finds go; headings settle at level two."""
    for n in list(article.walk()):
        for a in ("align", "background", "bgcolor", "border", "cellpadding", "cellspacing", "frame", "hspace", "rules", "style", "valign", "vspace"):
            n.attrs.pop(a, None)
        if n.tag == "img" and not n.get("src"):  # pictures that load later
            for k, v in list(n.attrs.items()):
                if re.search(r"\.(jpe?g|png|webp|gif)", v, re.I) and " " not in v.strip():
                    n.attrs["src"] = v
                    break
    listed = lambda n: n.tag in ("ul", "ol") or (len(n.text()) and sum(len(x.text()) for x in n.find("ul", "ol")) / max(1, len(n.text())) > 0.9)

    def conditionally(*tags):
        for n in article.find(*tags)[::-1]:
            if clean and n.parent is not None and dispensable(n, weight, listed(n)):
                n.remove()

    conditionally("form")
    conditionally("fieldset")
    for n in article.find("object", "embed", "footer", "link", "aside", "iframe", "input", "textarea", "select", "button"):
        if not (n.tag in ("object", "embed", "iframe") and any(VIDEO.search(v) for v in n.attrs.values())):
            n.remove()
    for n in article.elements():
        for d in [n, *n.walk()]:
            if SHARE.search(d.named()) and len(d.text()) < ENOUGH:
                d.remove()
    for n in article.find("h1", "h2"):
        if weight(n) < 0:
            n.remove()
    conditionally("table")
    conditionally("ul")
    conditionally("div")
    for n in article.find("h1"):
        n.tag = "h2"
    for n in article.find("p")[::-1]:
        if not n.find("img", "embed", "object", "iframe") and not squeezed(n.text()):
            n.remove()
    for t in article.find("table"):
        cells = t.find("td", "th")
        if len(cells) == 1 and t.parent is not None:
            cells[0].tag = "p" if phrasing_only(cells[0]) else "div"
            t.replace([cells[0]])


def ligatures(body: Node) -> None:
    """Icon names that an icon font draws."""
    for n in list(body.walk()):
        text = n.text().strip()
        if not n.elements() and 0 < len(text) <= 40 and re.fullmatch(r"[a-z][a-z0-9]*(_[a-z0-9]+)*", text) and (n.get("aria-hidden") == "true" or re.search(r"material-(icons|symbols)|icon-font|(^|\s)icons?($|\s)", n.get("class"))):
            n.remove()


def extract(html: str | None, url: str) -> tuple[Node | None, dict[str, str], Node]:
    """(article or None, metadata, the page's tree). Means are dropped one by one until enough text is found."""
    page = parse(html)
    facts: dict = {}
    about = metadata(page, url)
    best, best_size, article = None, -1, None
    for strip, weigh, clean in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        tree = page.copy()
        body = tree.elements()[1]
        ligatures(body)
        prepare(body)
        found = grab(tree, about["title"], facts, strip, weigh, clean)
        size = len(squeezed(found.text()))
        if size > best_size:
            best, best_size = found, size
        if size >= ENOUGH:
            article = found
            break
    article = article or (best if best_size > 0 else None)
    if article is not None and not about["excerpt"]:
        paragraphs = article.find("p")
        about["excerpt"] = paragraphs[0].text().strip() if paragraphs else ""
    about["author"] = about["author"] or facts.get("byline", "")
    host = urlsplit(url).hostname or ""
    meta = meta_values(page)
    about["author"] = about["author"] or next((meta[k] for k in ("author", "article:author", "dcterms.creator", "dc.creator", "og:author") if meta.get(k)), "")
    about["site"] = about["site"] or next((meta[k] for k in ("og:site_name", "application-name", "apple-mobile-web-app-title") if meta.get(k)), host)
    about["published"] = about["published"] or day_of(page)
    return article, about, page


def fallback(page: Node) -> Node:
    body = page.elements()[1]
    tests = (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: "content" in n.get("class").split(), lambda n: n.get("id") == "content")
    return next((n for t in tests for n in body.walk() if t(n)), body).copy()


def base_of(page: Node, url: str) -> str:
    bases = [b.get("href") for b in page.find("base") if b.get("href")]
    return urljoin(url, bases[0]) if bases else url


def finish(content: Node, base: str, images: bool) -> None:
    """What no reader needs goes; links and pictures become absolute; empty blocks go."""
    gone = {"script", "style", "noscript", "nav", "footer", *(() if images else ("img", "picture", "svg"))}
    for n in list(content.walk()):
        if n.tag in gone or {"comments", "ads", "sidebar"} & set(n.get("class").split()):
            n.remove()
    for n in list(content.walk()):
        if n.tag in ("p", "div") and not n.children:
            n.remove()
        elif n.tag == "a" and re.match(r"\s*javascript:", n.get("href"), re.I):
            n.tag = "span"
        for tag, attr in (("a", "href"), ("img", "src")):
            if n.tag == tag and n.get(attr):
                try:
                    n.attrs[attr] = urljoin(base, n.get(attr).strip())
                except ValueError:
                    pass
