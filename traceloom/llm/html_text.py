"""Main text of web pages by removal of site templates.

Every element subtree that may be page furniture is hashed; Spark counts on how many different pages of a host each
hash stands, and subtrees that recur there are deleted. What a single page shows to be furniture (navigation, scripts,
adverts by their marks) goes too, and the article's blocks remain.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import by_text, cut

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
                   "tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg canvas object audio "
                    "video dialog menu math option datalist".split())
#: What a paragraph's start ends, and what the start of some elements ends in turn.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|banners?|promos?|promotions?|sponsor(?:ed|s)?|sidebars?|menus?|nav(?:bar|igation)?|"
                   r"breadcrumbs?|footers?|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notices?|popups?|modals?|overlay|"
                   r"newsletter|subscribe|signup|share|sharing|social|related|recommended|recommendations|comments?|comment-list|disqus|"
                   r"replies|reply|respond|widgets?|toolbar|pagination|pager|login|hidden)(?:$|[\s_-])", re.I)
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption summary tr".split())
KEPT_WHOLE = frozenset("html body article main".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "landmark", "digest")

    def __init__(self, tag: str, attrs: dict, landmark: bool):
        self.tag, self.attrs, self.children, self.landmark, self.digest = tag, attrs, [], landmark, b""


class Tree(HTMLParser):
    """A forgiving tree of the page; text is kept as strings among the children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, False)
        self.stack = [self.root]

    def close_to(self, tags: set[str] | frozenset[str], scopes: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                del self.stack[i:]
                return
            if t in scopes or t in KEPT_WHOLE or t in ("div", "section", "table", "td", "th"):
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            self.stack[0].attrs.update({k: v for k, v in attrs if k not in ("class", "id")})
            return
        if tag in ENDS_P:
            self.close_to({"p"}, {"button"})
        if tag in SIBLINGS:
            for t in SIBLINGS[tag]:
                if t != tag:
                    self.close_to({t}, SCOPES.get(tag, {"table"}) | {tag})
            self.close_to({tag}, SCOPES.get(tag, {"table"}))
        above = self.stack[-1]
        node = Node(tag, dict(attrs), above.landmark or tag in ("article", "main"))
        above.children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            # an end tag of a phrase does not close the block around it
            if tag not in BLOCKS and self.stack[i].tag in BLOCKS:
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def by_marks(n: Node) -> bool:
    """Whether an element's own name and marks show it to be furniture."""
    if n.tag in DROPPED:
        return True
    if n.tag == "header" and not n.landmark:
        return True
    if n.tag in KEPT_WHOLE:
        return False
    a = n.attrs
    if a.get("role") in ROLES or a.get("aria-hidden") == "true" or "hidden" in a:
        return True
    marks = f"{a.get('class') or ''} {a.get('id') or ''}"
    return bool(marks.strip() and MARKS.search(marks))


def digests(root: Node) -> None:
    """Hash of each subtree: tag, class, id and what it holds, white space folded. Children first, without recursion."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        h = blake2b(f"{n.tag}\0{n.attrs.get('class') or ''}\0{n.attrs.get('id') or ''}".encode("utf-8", "surrogatepass"), digest_size=8)
        for c in n.children:
            h.update(c.digest if isinstance(c, Node) else SPACE.sub(" ", c).strip().encode("utf-8", "surrogatepass"))
            h.update(b"\1")
        n.digest = h.digest()


def candidates(root: Node) -> list[int]:
    """Hashes of subtrees that hold text and may be template.

    Text-level elements of an article or main element are its words, however often they recur, and no
    template; elsewhere every element is a candidate.
    """
    out, todo = set(), [(root, False)]
    filled: dict[int, bool] = {}

    def has_text(n: Node) -> bool:
        stack = [n]
        while stack:
            for c in stack.pop().children:
                if isinstance(c, Node):
                    stack.append(c)
                elif c.strip():
                    return True
        return False
    while todo:
        n, _ = todo.pop()
        if n.tag in BLOCKS and n.tag not in KEPT_WHOLE and not (n.landmark and n.tag in TEXT_LEVEL) and filled.setdefault(id(n), has_text(n)):
            out.add(int.from_bytes(n.digest, "big", signed=True))
        todo += [(c, False) for c in n.children if isinstance(c, Node) and c.tag not in ("script", "style", "head")]
    return list(out)


def main_text(root: Node, templates: frozenset[int]) -> str:
    """Blocks of what remains, from the article elements when there are any, else main, else the whole page."""
    def gone(n: Node) -> bool:
        return by_marks(n) or (n.tag not in KEPT_WHOLE and not (n.landmark and n.tag in TEXT_LEVEL) and
                               int.from_bytes(n.digest, "big", signed=True) in templates)

    def find(tag: str) -> list[Node]:
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n is not root and gone(n):
                continue
            if n.tag == tag:
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        return found
    tops = find("article") or find("main") or [root]
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(words)).strip()
        if text:
            blocks.append(text)
        words.clear()
    todo: list = list(reversed(tops))
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            words.append(n)
        elif n.tag == "br":
            words.append(" ")
        elif not (n is not root and n not in tops and gone(n)):
            if n.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, least: int = 5, share: float = 0.2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    A subtree is template where it stands on at least ``least`` different pages of its host and on the ``share`` of them; pages with the
    same body count once, so copies of an article are no template. Null html is empty; a null url is a host of its own. Repeated ids
    and rows are extracted each on its own; other columns are not read. Only hosts that have templates need them beside the page:
    the list of a page's template hashes is a written table, joined by page, which Spark broadcasts only at a small measured size.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        row, hashes, body = [], [], []
        for i, html in enumerate(b.column(2).to_pylist()):
            root = parse(html or "")
            digests(root)
            found = candidates(root)
            row += [i] * len(found)
            hashes += found
            body += [int.from_bytes(root.digest, "big", signed=True)] * len(found)
        take = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(hashes, pa.int64()), pa.array(body, pa.int64())],
                                          ["id", "host", "hash", "body"])
    kind = base.schema["id"].dataType.simpleString()
    seen = cut(by_text(base.select("id", "host", "html"), hashed, f"id {kind}, host string, hash bigint, body bigint"))
    size = seen.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = seen.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    template = cut(often.join(size, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "hash"))
    mine = cut(seen.select("id", "host", "hash").join(template, ["host", "hash"]).groupBy("id").agg(F.collect_set("hash").alias("templates")))

    def texts(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for html, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            root = parse(html or "")
            if known:
                digests(root)
            out.append(main_text(root, frozenset(known or ())))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                          [id_col, url_col, "text", "n_chars"])
    return by_text(base.select("id", "url", "html").join(mine, "id", "left").select("id", "url", "html", "templates"), texts,
                   f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
