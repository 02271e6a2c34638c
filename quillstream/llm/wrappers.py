"""Main text of web pages through wrappers: union-free regular expressions inferred from pages of one host.

Inference: a page's token stream (block elements with class and id, lines of text; inline elements belong to their line)
is read as a nested expression. Siblings of one kind fold into a repeated group; kinds that alternate fold into one
repeated group of them all. Page after page of the same host is aligned with the expression so far: what one side lacks
becomes optional, what one side repeats becomes a repeated group, and a text stays a constant where every page holds that
line at that place; all else is a slot. There are no alternatives (unions). At most PAGES_PER_HOST distinct pages of a
host take part, those with the least hash; they are picked by partial aggregation over salted hosts, so a host with a
third of all pages is no single task. Pages that share more than half of their characters with one already taken are copies and
no witnesses. A wrapper needs MIN_SHARED pages: fewer can't tell a constant from a slot.

Extraction: each page is parsed as a whole and aligned with its host's wrapper. What is in slots is the page's own text; lines
that are constants are left out, also inside an article element, but for headings, list items and table cells between slots, which articles may well share. Element names are an aid: the article
is looked for in article elements, else in main, role=main or itemprop=articleBody, else in the whole page. In the
whole page the wrapper also rules out groups: those that hold nothing but links on all sampled pages (menus), and those whose
lines mostly recur on other sampled pages (rotating notices and adverts; headings, lists and tables apart). Menus, page headers, footers, sidebars, notices,
adverts, forms and reader comments are also known by element, role, or a class or id that says this and nothing else
("comments", "ad-box", but not "ad hoc topics"). All article elements of a page count, whatever their sizes.

Blocks are set by block elements and br; character references are decoded, white space becomes one space, and blocks are joined
by a line feed, none dropped or cut.

Cases: null or empty html, or a page without an article, gives the empty text. A null or unreadable url makes the host
''. Repeated rows get a result each. Unclosed, stray or cut-off tags are read leniently, in time linear in the page; elements
nested more than DEPTH deep count as siblings, in their order, so that no text is lost. Very long pages are read whole. Equal pages
give equal texts. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import small, text_pieces, written

PAGES_PER_HOST = 16
SALTS = 64
MIN_SHARED = 3
#: Share of characters above which two pages are copies of each other, and of recurring lines that makes a group part of the template.
COPY, RECURRING = 0.5, 0.5
DEPTH = 64

# fixed values: element names of HTML by their role
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "option", "picture", "q", "s", "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "video", "audio"}
OUTSIDE = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "head", "input", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "reply", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
#: Words in a class or id that say nothing about what an element holds.
PLAIN = {
    "area", "article", "bar", "block", "bottom", "box", "button", "buttons", "clearfix", "col", "container", "content", "element", "entry", "global", "group", "header", "hidden", "holder", "inner", "item", "items",
    "js", "large", "left", "links", "list", "main", "medium", "module", "outer", "page", "panel", "post", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "thread", "top", "unit", "user", "wrap", "wrapper",
}
CLOSES = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Elements that an end tag of another name doesn't close.
FENCES = {"article", "main", "body"}

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)")
_SPACE = re.compile(r"\s+")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Linked(str):
    """Text inside a link."""


class Node:
    __slots__ = ("tag", "key", "out", "kind", "parts", "fixed", "ruled", "depth")

    def __init__(self, tag: str, key: str = "", out: bool = False, kind: str = "", depth: int = 0):
        self.tag, self.key, self.out, self.kind, self.depth = tag, key, out, kind, depth
        self.parts: list = []  # Nodes and texts
        self.fixed: set[str] | frozenset = frozenset()  # lines that are constants of the wrapper here
        self.ruled = False  # the wrapper takes this group for a part of the template


def _says(name: str) -> bool | None:
    """Whether a class or id names what is no article: None if it says nothing."""
    words = [w for w in re.split(r"[_-]+|\d+", name) if w]
    if all(w in PLAIN for w in words):
        return None
    return all(w in PLAIN or w in NAMES for w in words)


def _element(tag: str, raw: str) -> Node:
    if "=" not in raw and "hidden" not in raw:
        return Node(tag, tag, tag in OUTSIDE, tag if tag in ("article", "main") else "")
    a = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    role = a.get("role", "").lower()
    said = [x for x in map(_says, names) if x is not None]
    hidden = "display:none" in a.get("style", "").replace(" ", "").lower() or "hidden" in raw and _HIDDEN.search(_ATTRIBUTE.sub("", raw)) is not None
    out = tag in OUTSIDE or role in ROLES or bool(said) and all(said) or hidden
    kind = "article" if tag == "article" or "articlebody" in a.get("itemprop", "").lower() else "main" if tag == "main" or role == "main" else ""
    key = ".".join([tag, *sorted(re.sub(r"\d+", "0", n) for n in names)])
    return Node(tag, key, out and tag not in ("html", "body", "main"), kind)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): kinds are text, open and close. Each character is looked at a bounded number of times."""
    at, n, quotes = 0, len(page), True
    last = {c: page.rfind(c) for c in "<>\"'"}
    unclosed: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield "text", page[at : lt if lt >= 0 else n], ""
            if lt < 0:
                return
        at = lt
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        closing = page.startswith("</", at)
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if closing and last[">"] > at:
                at = page.find(">", at) + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        tag, end = name[0].lower(), name.end()
        # the end of the tag: the next > outside quoted values; a < outside them cuts the tag off
        i = end
        while True:
            stop = _STOP.search(page, i)
            if stop is None:
                if quotes and last[">"] >= end:  # a quote that never ends: from here on quotes are plain characters
                    quotes, i = False, end
                    continue
                i, cut = n, True
                break
            c, i = stop[0], stop.start()
            if c in "<>":
                cut = c == "<"
                break
            opens = quotes and last[c] > i and (page[i - 1] == "=" or page[i - 2 : i] == "= ")
            i = page.find(c, i + 1) + 1 if opens else i + 1
        if cut and not closing:
            if tag not in BLOCK and tag not in INLINE and tag not in RAW and tag not in VOID:
                yield "text", page[at:i], ""
            at = i
            continue
        attributes, at = page[end:i], i + (not cut)
        if closing:
            yield "close", tag, ""
        elif tag in RAW:
            found = None if tag in unclosed else _CLOSING[tag].search(page, at)
            if found:
                at = found.end()
            elif tag in ("script", "style"):
                return
            else:
                unclosed.add(tag)
        else:
            yield "open", tag, attributes


class _Tree:
    """Builds a page's tree; every step takes constant time, apart from elements it closes for good."""

    def __init__(self) -> None:
        self.root = Node("html", "html")
        self.stack: list[tuple[str, Node]] = [("html", self.root)]
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        self.blocks, self.fences = [0], [0]
        self.links = 0
        self.deepest = self.root  # the node at depth DEPTH that deeper ones hang on, one after the other

    def _close(self, size: int) -> None:
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            self.links -= tag == "a"
            for open_ in (self.blocks, self.fences):
                if open_[-1] == len(self.stack):
                    open_.pop()

    def text(self, value: str) -> None:
        tag, node = self.stack[-1]
        if node.depth > DEPTH and self.deepest.parts[-1] is not node:  # go on after what stood inside it
            node = Node(node.tag, node.key, node.out, node.kind, node.depth)
            self.deepest.parts.append(node)
            self.stack[-1] = (tag, node)
        node.parts.append(Linked(value) if self.links else value)

    def close(self, tag: str) -> None:
        where = self.places.get(tag)
        if where and (where[-1] >= self.fences[-1] or tag in FENCES or tag == "html"):
            self._close(where[-1])

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        block = tag in BLOCK
        if block:  # end tags left out: a p ends where a block begins, also under inline elements
            i = len(self.blocks) - 1
            for _ in range(8):
                if i < 1 or (name := self.stack[self.blocks[i]][0]) not in CLOSES:
                    break
                if tag in CLOSES[name]:
                    self._close(self.blocks[i])
                    i = len(self.blocks)
                i -= 1
        parent = node = self.stack[-1][1]
        if block or tag in OUTSIDE or any(x in attributes for x in ("class", "id=", "role", "hidden", "style", "itemprop")):
            made = _element(tag, attributes)
            if block or made.out:
                node = made
                if parent.depth < DEPTH:
                    node.depth = parent.depth + 1
                    parent.parts.append(node)
                else:
                    if parent.depth == DEPTH:
                        self.deepest = parent
                    else:
                        node.out, node.kind = node.out or parent.out, node.kind or parent.kind
                    node.depth = DEPTH + 1
                    self.deepest.parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            here = len(self.stack)
            self.places.setdefault(tag, []).append(here)
            if block:
                self.blocks.append(here)
            if tag in FENCES:
                self.fences.append(here)
            self.stack.append((tag, node))
            self.links += tag == "a"


def parse(page: str) -> Node:
    """The page as a tree of block elements and of elements left out; other inline elements stand in their line."""
    tree = _Tree()
    for kind, value, attributes in _tokens(page):
        if kind == "text":
            tree.text(value)
        elif kind == "close":
            tree.close(value)
        else:
            tree.open(value, attributes)
    return tree.root


def _line(texts: list[str]) -> str:
    return _SPACE.sub(" ", "".join(texts)).strip()


def _own_lines(node: Node) -> list[tuple[str, int]]:
    """The lines that stand in node itself, with how many of their characters are in links."""
    out, now, linked = [], [], 0
    for part in [*node.parts, None]:
        if isinstance(part, str):
            now.append(part)
            linked += len(part.strip()) if isinstance(part, Linked) else 0
        elif part is None or part.tag in BLOCK:
            if now and (line := _line(now)):
                out.append((line, linked))
            now, linked = [], 0
    return out


# ---------------------------------------------------------------- wrappers


class Group:
    """An expression: one kind of element among its siblings, over all pages so far."""

    __slots__ = ("key", "many", "optional", "mixed", "pages", "lines", "chars", "linked", "kids")

    def __init__(self, key: str):
        self.key, self.many, self.optional, self.mixed, self.pages = key, False, False, False, 1
        self.lines: dict[str, int] = {}  # pages that hold the line here
        self.chars = self.linked = 0
        self.kids: dict[str, Group] = {}


def fold(node: Node, into: Group | None = None) -> Group:
    """A page's expression; into: that of the page's earlier elements of the same kind at the same place."""
    group = into or Group(node.key)
    for line, linked in _own_lines(node):
        group.lines[line] = 1
        group.chars += len(line)
        group.linked += linked
    before = None
    for part in node.parts:
        if isinstance(part, str) or part.out or part.tag not in BLOCK:
            continue
        if part.key in group.kids:
            kid = group.kids[part.key]
            kid.many = True
            if before is not kid:  # kinds that take turns: all from here on repeat together
                kid.mixed = True
                if before is not None:
                    before.mixed = True
            fold(part, kid)
        else:
            kid = group.kids[part.key] = fold(part)
        before = kid
    return group


def joined(a: Group, b: Group) -> Group:
    """The least general expression that covers both; b is of one more page."""
    out = Group(a.key)
    out.many, out.optional, out.mixed, out.pages = a.many or b.many, a.optional or b.optional, a.mixed or b.mixed, a.pages + b.pages
    out.lines = {x: a.lines.get(x, 0) + b.lines.get(x, 0) for x in a.lines | b.lines}
    out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    out.kids = align(a.kids, b.kids)
    return out


def _may_lack(x: Group) -> Group:
    x.optional = True
    return x


def align(a: dict[str, Group], b: dict[str, Group]) -> dict[str, Group]:
    """Align two lists of siblings in which each kind stands once: in order; kinds whose order differs become one repeated group."""
    place = {key: i for i, key in enumerate(b)}
    rows, out, done = list(b.values()), {}, 0
    for key, x in a.items():
        i = place.get(key)
        if i is None:
            out[key] = _may_lack(x)
            continue
        for y in rows[done:i]:
            if y.key not in a:
                out[y.key] = _may_lack(y)
        out[key] = joined(x, rows[i])
        out[key].mixed = out[key].mixed or i < done
        done = max(done, i + 1)
    return out | {y.key: _may_lack(y) for y in rows[done:] if y.key not in a}


def _all_lines(group: Group) -> set[str]:
    return set(group.lines).union(*map(_all_lines, group.kids.values()))


def _chars(lines: set[str]) -> int:
    return sum(map(len, lines))


def infer(pages: list[str]) -> tuple[int, Group | None]:
    """How many different pages took part, and the wrapper of them, in a fixed order."""
    wrapper, taken = None, []
    for page in sorted(set(pages)):
        one = fold(parse(page))
        lines = _all_lines(one)
        if any(_chars(lines & x) > COPY * max(_chars(lines), _chars(x)) for x in taken):
            continue
        taken.append(lines)
        wrapper = one if wrapper is None else joined(wrapper, one)
    return len(taken), wrapper


def expression(group: Group, pages: int) -> str:
    """The wrapper as a regular expression, to be read."""
    text = " / ".join(sorted(x for x, n in group.lines.items() if n == pages))
    body = f"<{group.key}>{text}" + ("#TEXT" if any(n < pages for n in group.lines.values()) else "")
    run: list[str] = []
    for kid in group.kids.values():
        if run and not kid.mixed:
            body += f"({''.join(run)})+"
            run = []
        if kid.mixed:
            run.append(expression(kid, pages))
        else:
            body += expression(kid, pages)
    body += f"({''.join(run)})+" if run else ""
    mark = ("*" if group.optional else "+") if group.many else "?" if group.optional else ""
    return f"({body}){mark}" if mark else body


#: Elements whose lines an article's pages may have in common without their being the template's: headings and items.
ITEMS = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th", "td", "caption", "figcaption"}
LISTS = {"ul", "ol", "dl", "table", "tbody", "tr"} | ITEMS


def rules(group: Group, pages: int) -> list:
    """What extraction needs of a wrapper: [constants, part of the template, {kind: the same}], without branches that rule out nothing."""
    return _rules(group, pages)[0]


def _rules(group: Group, pages: int) -> tuple[list, bool]:
    """The same, and whether there is any line in the group."""
    below = {k: _rules(x, pages) for k, x in group.kids.items()}
    held, recurring = sum(group.lines.values()), sum(n for n in group.lines.values() if n > 1)
    listed = group.key.partition(".")[0] in LISTS  # a page's own list may have most items in common with others
    own = group.pages >= MIN_SHARED and (group.linked >= group.chars or recurring >= RECURRING * held and not listed)
    full = held > 0 or any(some for _, some in below.values())
    ruled = full and (own or not held) and all(r[1] for r, some in below.values() if some)
    return [sorted(x for x, n in group.lines.items() if n >= pages), int(ruled), {k: r for k, (r, _) in below.items() if any(r)}], full


def mark(node: Node, found: list) -> None:
    """Align a page with its host's wrapper: note where its constants and the groups of the template stand."""
    node.fixed, node.ruled = frozenset(found[0]), bool(found[1])
    for part in node.parts if found[2] else ():
        if not isinstance(part, str) and (below := found[2].get(part.key)):
            mark(part, below)


# ---------------------------------------------------------------- the article


def _found(node: Node, kind: str) -> list[Node]:
    if node.out:
        return []
    if node.kind == kind:
        return [node]
    return [x for p in node.parts if not isinstance(p, str) for x in _found(p, kind)]


def _headings(node: Node) -> list[Node]:
    return [node] if re.fullmatch("h[1-6]", node.tag) else [x for p in node.parts if not isinstance(p, str) and not p.out for x in _headings(p)]


def _lines(node: Node, whole_page: bool, aligned: bool, out: list[tuple[str, bool, bool]], item: bool = False) -> None:
    """Lines below node with whether they are constants and whether they are headings or items; in the whole page without the template's groups."""
    now: list[str] = []
    item = item or node.tag in ITEMS

    def end() -> None:
        if now and (line := _line(now)):
            out.append((line, line in node.fixed, item))
        now.clear()

    for part in node.parts:
        if isinstance(part, str):
            now.append(part)
            continue
        if part.tag in BLOCK:
            end()
        if part.out or whole_page and part.ruled and node.tag != "html":
            continue
        if whole_page and part.tag == "header":  # of a page's header only headlines, and only if a wrapper can tell them from the site's
            for heading in _headings(part) if aligned else ():
                _lines(heading, whole_page, aligned, out)
            continue
        _lines(part, whole_page, aligned, out, item)
    end()


def _text(nodes: list[Node], whole_page: bool, constants: bool, aligned: bool) -> str:
    out: list[tuple[str, bool, bool]] = []
    for node in nodes:
        _lines(node, whole_page, aligned, out)
    slots = [i for i, (_, fixed, _) in enumerate(out) if not fixed]
    # a constant is the template's, but for headings and items that stand between the page's own lines
    kept = (x for i, (x, fixed, item) in enumerate(out) if constants or not fixed or item and slots and slots[0] < i < slots[-1])
    decoded = (_SPACE.sub(" ", entities.unescape(x)).strip() for x in kept)
    return "\n".join(x for x in decoded if x)


def main_text(page: str | None, wrapper: list | None = None) -> str:
    """The article of one page. wrapper: its host's rules, if there is one."""
    if not page:
        return ""
    root = parse(page)
    if wrapper:
        mark(root, wrapper)
    for kind in ("article", "main"):
        if found := _found(root, kind):
            if text := _text(found, False, False, bool(wrapper)) or _text(found, False, True, bool(wrapper)):
                return text
    return _text([root], True, False, wrapper is not None)


def host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][-a-zA-Z0-9+.]*://([^/?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, most: int = PAGES_PER_HOST) -> DataFrame:
    """host, n_pages (different ones that took part), wrapper (rules as JSON; null below MIN_SHARED pages), expression, from at most `most` distinct pages of each host."""
    rows = pages.where("html is not null and html <> ''").select(host().alias("host"), F.xxhash64("html").alias("order"))
    picks = rows.groupBy("host", F.pmod("order", F.lit(SALTS)).alias("salt")).agg(F.min("order").alias("order"))  # at most SALTS of a host
    picks = picks.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("order"))).where(F.col("place") <= most).select("host", "order")
    sample = pages.select(host().alias("host"), F.xxhash64("html").alias("order"), "html").join(small(written(picks)), ["host", "order"], "left_semi").dropDuplicates(["host", "order"])

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, wrapper = infer(group["html"].tolist())
        return pd.DataFrame({"host": [key[0]], "n_pages": [n], "wrapper": [json.dumps(rules(wrapper, n)) if n >= MIN_SHARED else None], "expression": [expression(wrapper, n)]})

    return sample.select("host", "html").groupBy("host").applyInPandas(learn, "host string, n_pages int, wrapper string, expression string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_pieces(batches):
        known: dict[str, list] = {}
        texts = []
        for page, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if w is not None and w not in known:
                known[w] = json.loads(w)
            texts.append(main_text(page, known.get(w)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; a row for each input row."""
    wrappers = written(infer_wrappers(pages)).where("wrapper is not null").select("host", "wrapper")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    return rows.join(small(wrappers), "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(_apply, "page_id long, url string, text string, n_chars long")
