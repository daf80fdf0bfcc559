"""Main text of web pages: site templates are found by counting hashed element subtrees per host.

First pass: every page emits the distinct hashes of its element subtrees (tag, class, id and
role, text, children). Spark counts, per host, with how many different contents each subtree
occurs. A subtree is a template if it occurs with three contents or, on large hosts, with the
fourth root of the host's contents. Templates go back to the pages that hold them by a join on
(host, subtree), so a task holds the templates of one page at a time, never those of a host.

Second pass: templates are deleted, unless their place says that they are article text:

* a paragraph, heading, list or table inside an article stays, unless it is a list or paragraph
  of links only;
* outside of articles such a block stays if a block beside it is no template: headings and
  ingredients of recipes recur, but next to text that does not;
* a container without block elements stays if one beside it with equal tag, class, id and role
  is no template (pages whose paragraphs are ``div`` elements).

Elements that HTML itself defines as no text of the page (scripts, navigation, footers) go, and so
do elements whose class or id names a role outside the article, except where next to nothing of a
page without article would stay: then such an element with most of the page's text is its wrapper.
If an article is there and holds a quarter of what stays of the page, it is the text; smaller ones
with links are teasers and go.

Defined results: null or empty html gives the empty text; broken markup is read as browsers do in
outline (unclosed elements end with their parent, unknown end tags are ignored); copies of a page
count once as a content; hosts are found as in ``urls``. A page whose whole text would be deleted
keeps the text that recurrence alone took. Repeated rows give repeated results; only key, url and
html are read, so other columns' names do not matter.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import host


@dataclass(frozen=True)
class Settings:
    least_contents: int = 3  # a template recurs with at least so many different contents of its host
    root: float = 0.25  # and with this power of their number, which binds from 82 contents on
    salts: int = 16  # parts of the pages that hold a template
    copies: int = 32  # parts of the copies of a page


# Tags by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video map nav footer aside header button select option textarea input dialog menu title meta link".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p li ul ol dl dt dd pre blockquote figure figcaption table tbody thead tr td th".split()) | HEADINGS
LINKED = frozenset("p ul ol dl table".split())
FRAMES = frozenset(["", "html", "body", "article", "main"])
CLOSES_P = frozenset("address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li tr td th".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
    "social share sharing comment comments disqus reply replies respond related recommended form search login pagination pager toolbar widget copyright skip".split())
REPLIES = frozenset("comment comments disqus reply replies respond".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z0-9]+")


class Node:
    """An element; ``size`` and ``linked`` are the characters of its text and of its links.

    ``noise``: no text by its tag; ``role``: named as something beside the article, ``replies`` as reader comments.
    """

    __slots__ = ("tag", "noise", "role", "replies", "inner", "parts", "digest", "key", "size", "linked")

    def __init__(self, tag: str, attributes: str, inner: bool):
        self.tag, self.parts, self.inner = tag, [], inner  # parts: texts and nodes in order
        self.digest, self.key, self.size, self.linked = 0, tag, 0, 0
        self.noise, self.role, self.replies = tag in DROPPED, tag == "form", False
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.key += "".join(f" {k}={v}" for k, v in sorted(found.items()))
            self.noise = self.noise or "hidden" in found or found.get("aria-hidden") == "true"
            self.role = self.role or found.get("role", "").lower() in NOISE_ROLES
            if tag not in FRAMES:
                words = WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
                self.role = self.role or any(w in NOISE_WORDS for w in words)
                self.replies = any(w in REPLIES for w in words)


def parse(page: str) -> Node:
    """The element tree, with a hash of every subtree."""
    root = Node("", "", False)
    stack, opened = [root], {}

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            opened[node.tag] -= 1
            digest = xxhash.xxh3_64(node.key.encode("utf-8", "surrogatepass"))
            for p in node.parts:
                if isinstance(p, Node):
                    digest.update(p.digest.to_bytes(8, "little"))
                    if not p.noise:
                        node.size += p.size
                        node.linked += p.linked
                else:
                    text = " ".join(p.split())
                    node.size += len(text)
                    digest.update(b"\x00" + text.encode("utf-8", "surrogatepass"))
            if node.tag == "a":
                node.linked = node.size
            node.digest = digest.intdigest()

    def close_tag(tags: set[str], stops: set[str] = frozenset()) -> None:
        if any(opened.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    return close(k)
                if stack[k].tag in stops:
                    return None
        return None

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if opened.get(tag):
                close_tag({tag})
            continue
        if tag in CLOSES_P:
            close_tag({"p"}, {"article", "div", "section", "td", "li", "blockquote", "body"})
        if tag in SIBLINGS:
            close_tag(SIBLINGS[tag], STOPS[tag])
        node = Node(tag, attributes, stack[-1].inner or stack[-1].tag in ("article", "main"))
        stack[-1].parts.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            node.parts.append(page[at : end.start()])
            node.digest, at = xxhash.xxh3_64_intdigest(f"{node.key}\0{node.parts[0]}".encode("utf-8", "surrogatepass")), end.end()
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    opened[""] = 1
    close(0)
    return root


def walk(root: Node):
    """All elements, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]


def content_root(root: Node, through: frozenset[int] = frozenset()) -> list[Node]:
    """The articles that are in no other, else the main element, else the whole page."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            hidden = node.noise or node.role and id(node) not in through
            if node.tag == tag and not hidden:
                found.append(node)
            elif not hidden or node.tag == "form":  # some sites wrap the page in a form
                todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
        if found:
            return found
    return [root]


def leaf(node: Node) -> bool:
    return all(isinstance(p, str) or p.tag in INLINE for p in node.parts)


def removable(node: Node) -> bool:
    """Whether the subtree may go for recurring, wherever it stands."""
    if node.tag in INLINE or node.tag in FRAMES:
        return False
    return not (node.inner and node.tag in FLOW) or node.tag in LINKED and 0 < node.size == node.linked


def recurring(parent: Node, known: frozenset[int]) -> set[int]:
    """Ids of the children that are templates by their hash and their place."""
    seen = [p for p in parent.parts if isinstance(p, Node) and p.digest in known and removable(p)]
    if not seen:
        return set()
    other = [p for p in parent.parts if isinstance(p, Node) and p.size and not (p.noise or p.role or p.digest in known)]
    varied = any(p.tag in FLOW for p in other)
    alike = {p.key for p in other if p.tag not in FLOW and leaf(p)}
    links = lambda p: p.tag in LINKED and p.size == p.linked
    return {id(p) for p in seen if (links(p) or not varied if p.tag in FLOW else not (p.key in alike and leaf(p)))}


def text_of(roots: list[Node], known: frozenset[int] = frozenset(), through: frozenset[int] = frozenset(), left_out: frozenset[int] = frozenset()) -> str:
    """Blocks in page order, one a line, without noise and templates (``known``)."""
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        if line:
            text = entities.unescape("".join(line))
            line.clear()
            if text := " ".join(text.split()):
                blocks.append(text)

    for root in roots:
        todo: list = [(root, False)]  # with each part, whether it stands in a block that stays whole
        while todo:
            node, whole = todo.pop()
            if node is None:
                end_block()
            elif isinstance(node, str):
                line.append(node)
            elif id(node) in left_out or node is not root and (node.noise or node.role and id(node) not in through):
                if node.tag not in INLINE:
                    end_block()
            elif node.tag == "br":
                line.append(" ")
            else:
                block = node.tag not in INLINE
                if block:
                    end_block()
                    todo.append((None, whole))
                gone = recurring(node, known) if known and not whole else ()
                for p in reversed(node.parts):
                    if isinstance(p, str):
                        todo.append((p, whole))
                    elif id(p) in gone:
                        todo.append((None, whole))
                    else:
                        todo.append((p, whole or p.tag in FLOW and p.digest in known))
    end_block()
    return "\n".join(blocks)


def main_blocks(root: Node, known: frozenset[int], through: frozenset[int] = frozenset()) -> tuple[str, bool]:
    """The text of the articles or of the page, and whether articles gave it."""
    roots = content_root(root, through)
    text = text_of(roots, known, through)
    if roots == [root]:
        return text, False
    page = text_of([root], known, through)
    if 4 * len(text) >= len(page):
        return text, True
    teasers = frozenset(id(r) for r in roots if r.linked)
    return text_of([root], known, through, teasers), True


def extract(page: str, known: frozenset[int] = frozenset()) -> str:
    root = parse(page)
    text, article = main_blocks(root, known)
    if not article and 10 * len(text) < root.size:
        wrappers = frozenset(id(n) for n in walk(root) if n.role and not n.replies and 2 * n.size > root.size)
        if wrappers:
            text = main_blocks(root, known, wrappers)[0] or text
    return text or (extract(page) if known else text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pages(pages: DataFrame, url: str, html: str, s: Settings, *more) -> DataFrame:
    """(url, html, site, page): ``page`` is equal for rows of equal text and part, which have equal templates."""
    text, site = F.coalesce(F.col(html).cast("string"), F.lit("")), F.xxhash64(host(url))
    return pages.select(*more, F.col(url).alias("url"), text.alias("html"), site.alias("site"),
                        F.xxhash64(text, site, F.pmod(F.xxhash64(F.col(url)), F.lit(s.copies))).alias("page"))


def subtrees(pages: DataFrame, s: Settings = Settings(), url: str = "url", html: str = "html") -> DataFrame:
    """(site, page, content, subtree): the distinct subtrees of each page that may go, and the hash of its main text."""
    def run(batches):
        for b in batches:
            sites, ids, contents, trees = [], [], [], []
            for site, at, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                root = parse(page.as_py())
                found = {_signed(n.digest) for n in walk(root) if n.size and removable(n)}
                content = _signed(xxhash.xxh3_64_intdigest(text_of(content_root(root)).encode("utf-8", "surrogatepass")))
                for values, value in ((sites, site), (ids, at), (contents, content)):
                    values += [value] * len(found)
                trees += found
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sites, ids, contents, trees)], names=["site", "page", "content", "subtree"])

    return _pages(pages, url, html, s).select("site", "page", "html").mapInArrow(run, "site long, page long, content long, subtree long")


def templates(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(site, subtree): the hashes that recur with enough different contents of their host."""
    several = (found.select("site", "subtree", "content").distinct().groupBy("site", "subtree").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") >= s.least_contents))
    contents = found.select("site", "content").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("contents"))
    return several.join(contents, "site").where(F.col("n") >= F.pow("contents", F.lit(s.root))).select("site", "subtree")


def templates_of_pages(found: DataFrame, known: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page, subtrees): the templates that a page holds. A subtree on most pages of a hot host is dealt to ``salts`` keys."""
    salted = found.select("site", "subtree", "page").withColumn("salt", F.pmod("page", F.lit(s.salts)))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s.salts - 1).cast("long"))))
    return salted.join(spread, ["site", "subtree", "salt"]).groupBy("page").agg(F.collect_set("subtree").alias("subtrees"))


def main_text(pages: DataFrame, known: DataFrame, s: Settings = Settings(), key: str = "page_id", url: str = "url", html: str = "html",
              found: DataFrame | None = None) -> DataFrame:
    """(key, url, text) of every page, given the templates of the hosts.

    ``found``: the pages' :func:`subtrees`, where they are at hand; else they are taken from the pages.
    """
    rows = _pages(pages, url, html, s, F.col(key).alias("key"))
    held = templates_of_pages(subtrees(pages, s, url, html) if found is None else found, known, s)
    rows = rows.join(held, "page", "left").select("key", "url", "html", "subtrees")

    def run(batches):
        for b in batches:
            texts = [extract(page.as_py(), frozenset(x & (2**64 - 1) for x in t.as_py() or ())) for page, t in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    kind = dict(pages.dtypes)[key]
    return rows.mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", key)
