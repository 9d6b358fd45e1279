"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives points for its length and its commas
to its parent, half of them to the grandparent and less further up; a container's points
are discounted by the share of its text that is inside links. The best container and those of
its siblings that score well or read like prose are kept; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments are left out wherever they are.
A name of a class, or a form, does so only if the element holds a small share of the page's
unlinked text and no article; a wrapper of the whole page is kept, whatever it is called.
Lists of links are part of the article that holds them.
Blocks come out in page order, one line each.

Defined results: a null or empty page, and a page without text, give an empty string; markup
that is never closed ends with the page, and so does a comment without an end (what follows it is
in the comment); a tag with unbalanced quotes ends at its next ``>``; a paragraph right ahead of the
chosen article belongs to it; character references are decoded,
white space inside a block becomes one space; pages of any length and depth are read whole,
without recursion; repeated rows each give their row; extra columns are carried, but those named like the two
results are replaced by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never part of the text, with all they hold.
SKIPPED = frozenset(
    "script style noscript template head title svg math canvas iframe object embed audio video button select "
    "textarea input label fieldset nav footer aside menu dialog map applet frameset noframes datalist".split()
)
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
PARAGRAPHS = frozenset("p pre td th li blockquote dd dt h1 h2 h3 h4 h5 h6 div section article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Opening one of these ends an open element of the listed kinds, up to the listed borders.
_P_ENDERS = BLOCKS - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Words of a class or id that mark what is no part of the article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|ted|s)?|banner|cookies?|consent|"
    r"gdpr|notices?|newsletter|subscri(?:be|ption)|signup|login|paywall|popup|modal|overlay|menu|nav(?:bar|igation)?|"
    r"breadcrumbs?|sidebar|side|widgets?|related|recommended|recommendations|more-stories|share|sharing|social|footer|foot|"
    r"header|masthead|topbar|comments?|commentlist|comment-?list|disqus|respond|replies|reply|pagination|pager|toc|"
    r"tags|toolbar|search|skip|legal|copyright|disclaimer|alert|toast|rating|reactions?)(?:$|[\s_-])",
    re.I,
)
UNLIKELY_ROLES = frozenset(
    "navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split()
)
COMMENT_END = re.compile("--!?>")
TAG_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
LIKELY = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
# Of the page's unlinked text, the most that an element can hold to be left out for its name, a
# thread of comments, and all such elements together beside threads.
SMALL, THREAD, TOGETHER = 1 / 3, 0.9, 0.75
THREADS = re.compile(r"(?:^|\s)(?:comments?|comment-?list|comments?-(?:area|section|thread|list)|disqus(?:_thread)?|replies)(?:$|\s)", re.I)
COMMENT_PARTS = re.compile(r"(?:^|[\s_-])(?:user-?)?comment", re.I)


class Node:
    __slots__ = (
        "tag", "parent", "children", "skipped", "doubtful", "thread", "likely", "points", "length", "linked", "commas"
    )

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.skipped = self.doubtful = self.thread = self.likely = False
        self.points = 0.0
        self.length = self.linked = self.commas = 0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None)
        self.open: dict[str, int] = {}
        self.checked = -1, -1

    # Pages are fed whole, so markup without an end has none: nothing is searched for twice.

    def check_for_whole_start_tag(self, i: int) -> int:
        if self.checked[0] != i:
            self.checked = i, super().check_for_whole_start_tag(i)
        return self.checked[1]

    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        if end >= 0 and self.rawdata[end - 1] == ">":
            return super().parse_starttag(i)
        end = self.rawdata.find(">", i)
        if end < 0:
            return len(self.rawdata)
        name = TAG_NAME.match(self.rawdata, i, end)
        found = ATTRIBUTE.findall(self.rawdata[name.end() : end])
        tag = name[1].lower()
        self.handle_starttag(tag, [(key.lower(), a or b or c) for key, a, b, c in found])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return end + 1

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        cdata = self.rawdata.startswith("<![CDATA[", i)
        end = self.rawdata.find("]]>" if cdata else ">", i)
        return end + (3 if cdata else 1) if end >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_ENDERS and self.open.get("p"):
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append(" " if tag == "br" else Node("hr", self.at))
            return
        node = Node(tag, self.at)
        node.skipped = self._unwanted(node, dict(attrs))
        self.at.children.append(node)
        self.at = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def _unwanted(self, node: Node, attrs: dict[str, str | None]) -> bool:
        tag = node.tag
        if tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        role = (attrs.get("role") or "").lower()
        if role in UNLIKELY_ROLES - {"form"}:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
            return True
        if tag == "header":
            return not (self.open.get("article") or self.open.get("main"))
        if tag in ("html", "body", "main"):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".strip()
        node.likely = bool(names and LIKELY.search(names))
        node.thread = bool(THREADS.search(names))
        unlikely = COMMENT_PARTS if tag == "article" else UNLIKELY
        node.doubtful = tag == "form" or role == "form" or tag not in HEADINGS and bool(unlikely.search(names))
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.at.children.append(" ")
        elif self.open.get(tag):
            while True:
                done = self.at
                self.open[done.tag] -= 1
                self.at = done.parent
                if done.tag == tag:
                    break

    def _close(self, kinds: set[str], borders: set[str]) -> None:
        """Close up to the nearest open element of these kinds, unless a border comes first."""
        if not any(self.open.get(k) for k in kinds):
            return
        node, last = self.at, None
        while node.parent is not None and node.tag not in borders:
            if node.tag in kinds:
                last = node
                if kinds == {"p"}:
                    break
            node = node.parent
        if last is not None:
            while self.at is not last.parent:
                self.open[self.at.tag] -= 1
                self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree_of(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    _settle(parser.root)
    return parser.root


def _settle(root: Node) -> None:
    """Decide on the elements whose names speak against them, by the text they hold."""
    nodes = _in_order(root)
    if not any(n.doubtful for n in nodes):
        return
    held: dict[Node, tuple[int, int, bool]] = {}  # unlinked text, outermost articles, whether main is among them
    for node in reversed(nodes):
        text = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        articles, main = 0, False
        for c in node.children:
            if isinstance(c, Node) and not c.skipped:
                more, inner, has_main = held[c]
                own = bool(more) and c.tag in ("article", "main") and not c.doubtful
                text, articles, main = text + more, articles + (1 if own else inner), main or has_main or own and c.tag == "main"
        held[node] = (0 if node.tag == "a" else text), articles, main
    whole = held[root][0]
    threads, small = [], []
    for node in nodes:
        if not node.doubtful:
            continue
        text, articles, main = held[node]
        if main or articles == 1:
            continue
        if text <= SMALL * whole:
            (threads if node.thread else small).append(node)
        elif node.thread and text <= THREAD * whole:
            threads.append(node)
    for node in threads:
        node.skipped = True
    # Only the outermost count, and none inside what is left out already.
    outer = {n for n in _in_order(root)} & set(small)
    rest = whole - sum(held[n][0] for n in threads if not _inside(n))
    for node in small:
        node.skipped = True
    if sum(held[n][0] for n in outer if not _inside(n)) > TOGETHER * rest:
        for node in small:
            node.skipped = node.tag == "form"  # blocks of a page that are all called alike


def _inside(node: Node) -> bool:
    up = node.parent
    while up is not None and not up.skipped:
        up = up.parent
    return up is not None


def _in_order(root: Node) -> list[Node]:
    """Every wanted node, parents before children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skipped)
    return found


def score(root: Node) -> list[Node]:
    """Text lengths, linked lengths and points of all wanted nodes."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = "".join(c for c in node.children if isinstance(c, str))
        own_length = len(" ".join(own.split()))
        node.length, node.commas = own_length, own.count(",") + own.count("，") + own.count("、")
        inline_length, inline_commas = own_length, node.commas
        for c in node.children:
            if isinstance(c, Node) and not c.skipped:
                node.length += c.length
                node.linked += c.linked
                node.commas += c.commas
                if c.tag not in BLOCKS:
                    inline_length += c.length
                    inline_commas += c.commas
        if node.tag == "a":
            node.linked = node.length
        if node.tag in PARAGRAPHS and inline_length >= 25:
            points = 1 + inline_commas + min(inline_length / 100, 3.0)
            share, up = 1.0, node.parent
            if node.tag not in ("p", "pre", "li", "td", "blockquote", "dd", *HEADINGS):
                node.points += points
                share = 0.5
            for level in range(4):
                if up is None or not up.tag:
                    break
                up.points += points * share
                share = 0.5 if level == 0 else share / 1.5
                up = up.parent
    for node in nodes:
        node.points *= 1 - density(node)
        if node.tag in ("article", "main") or node.likely:
            node.points *= 1.25
    return nodes


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def chosen(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    nodes = score(root)
    articles = [n for n in nodes if n.tag in ("article", "main") and n.length]
    best = max(articles or nodes, key=lambda n: (n.points, n.length))
    if not best.points:
        best = max(articles, key=lambda n: n.length) if articles else root
    up = best.parent
    if up is None or best is root:
        return [best]
    limit = max(10.0, best.points * 0.2)
    kept: list[Node] = []
    lead: list[Node] = []  # prose right ahead of the article
    for c in up.children:
        if not isinstance(c, Node) or c.skipped or c.doubtful and c is not best:
            if not isinstance(c, str) or c.strip():
                lead = []
            continue
        prose = c.tag in ("p", "pre", "blockquote") and density(c) < 0.25 and c.length > 80
        heading = c.tag in HEADINGS and density(c) < 0.5
        if c is best:
            kept += [n for n in lead if n not in kept]
        lead = [*lead, c] if prose else []
        if c is best or c.points >= limit and density(c) < 0.33 or (not articles and (prose or heading)):
            kept.append(c)
    return kept


def blocks_of(top: Node) -> Iterator[str]:
    """Lines of text of the wanted nodes below ``top``, cut at block elements."""
    parts: list[str] = []
    begun = top.tag not in ("", "html", "body")
    stack: list[Node | str | None] = [top]
    while stack:
        item = stack.pop()
        if item is None:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                begun = begun or len(line) >= 25
                yield line
        elif isinstance(item, str):
            parts.append(item)
        else:
            if item.tag in BLOCKS:
                stack.append(None)
            children = item.children
            if item.tag == "header":
                children = [c for c in children if isinstance(c, Node) and c.tag in HEADINGS | {"hgroup"}]
            if not begun and density(item) > 0.6 and item.tag in ("ul", "ol", "table") and item.linked > 0:
                children = []  # a list of links ahead of all text is the page's menu
            stack.extend(c for c in reversed(children) if isinstance(c, str) or not c.skipped)
            if item.tag in BLOCKS:
                stack.append(None)
    line = " ".join("".join(parts).split())
    if line:
        yield line


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(line for top in chosen(tree_of(html)) for line in blocks_of(top))


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The pages without their markup column, with the main text and its length ``n_chars``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py()) for page in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["row", "text", "n_chars"],
                )

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html, text, "n_chars")]
    rows = pages.select(F.struct(*rest).alias("row"), F.col(html).cast("string").alias("html"))
    schema = rows.select("row").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(extract, schema).select("row.*", F.col("text").alias(text), "n_chars")
