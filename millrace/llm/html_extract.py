"""Main text of web pages: site templates found by counting element subtrees per host, and boilerplate by its names.

Every container subtree (its tags and text) is hashed. Spark counts, per host, on how many pages that differ a subtree
stands; one on LEAST_PAGES of them is a template of the site and is deleted from its pages, but no subtree with more than
half of its page's text, so that copies of an article stay. What is new on every page, such as reader comments, no count
can find: there elements, roles and the nouns of class and id decide, except around the article itself. Of what is left
the article elements are taken, else the main element, if they hold a fair share of the text, else all. Pages are
parsed once; only hashes are shuffled, texts only where templates are too many to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Sequence
from hashlib import blake2b
from html import unescape
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_ROWS, join_counted, materialize
from millrace.llm.url_filter import host_of

#: A subtree is a template if it stands on this many different pages of a host, however many the host has.
LEAST_PAGES = 5

# Fixed values of the HTML standard: elements by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body br caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: A start tag closes an open element of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
CONTAINER = frozenset("aside center dialog div dl fieldset figure footer form header menu nav ol section table ul".split())

# Names of what is not the article: elements never read, elements of boilerplate, nouns of class and id, roles.
UNREAD = frozenset(
    "applet audio button canvas datalist embed frameset head iframe input label noembed noframes noscript object script select style "
    "svg template textarea title video xmp".split()
)
DROPPED = frozenset("aside dialog footer menu nav".split())
#: Dropped as those, unless they are around the article: some sites put all of a page into one form.
DROPPED_BUT_AROUND = frozenset("fieldset form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: What makes an article or main element one that is not the page's.
ARTICLE_WORDS = frozenset("ad ads advert advertisement comment comments promo related sponsored".split())
#: A name is judged by its noun, the last part that is none of these: comment-list is of comments, share-price-report of reports.
PLACES = frozenset(
    "area articles author bar block body box button buttons card center col column container content feed form group holder inner item "
    "items left link links list main message meta outer panel policy posts products reading region reply right row section slot space "
    "stack stories text thread title top bottom unit wrap wrapper zone".split()
)
_ABOUT = frozenset("has no with without".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A named element is around the article if it holds the only article or main element or, where there is none, if what is kept
#: outside it is less than this share of what is kept in it.
LEAST_OUTSIDE = 0.1
#: The articles, or the main element, are the page's if they hold this share of the text that is left.
LEAST_REGION = 0.25

_TAG = r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s=>/][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+|=)*+)>"""
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|" + _TAG + r"|<[!?/](?![a-zA-Z])[^>]*>?|</?[a-zA-Z][^>]*>?", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ROLE_MAIN = re.compile(r"""role\s*=\s*["']?main\b""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether the noun of a class or id is one of words; has-sidebar tells of something else, so does nav-fixed."""
    for name in value.split():
        parts = _WORDS.findall(_CAMEL.sub(r"\1-\2", name).lower())
        if not _ABOUT.isdisjoint(parts):
            continue
        while len(parts) > 1 and (parts[-1] in PLACES or parts[-1].isdigit()):
            parts.pop()
        if parts and parts[-1] in words:
            return True
    return False


#: What a start tag tells: kept, never read, boilerplate, boilerplate unless around the article.
KEPT, NEVER, BOILERPLATE, UNLESS_AROUND = range(4)


def _kind(name: str, attrs: str, in_main: bool) -> int:
    if name in UNREAD:
        return NEVER
    if name in DROPPED or name == "header" and not in_main:
        return BOILERPLATE
    kind = UNLESS_AROUND if name in DROPPED_BUT_AROUND else KEPT
    if not attrs or name in ("html", "body"):
        return kind
    words = ARTICLE_WORDS if name in ("article", "main") else DROPPED_WORDS
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value.lower()):
            return NEVER
        if key in ("class", "id") and _named(value, words) or key == "role" and value.strip().lower() in DROPPED_ROLES:
            kind = UNLESS_AROUND
    return kind


#: Where a piece of text stands.
IN_ARTICLE, IN_MAIN = 1, 2


def joined(pieces: Iterable[tuple[str, Sequence[int], int]], templates: Collection[int]) -> str:
    """The text of pieces that no template holds: of the articles, else of the main element, else all."""
    left = [(t, region) for t, owners, region in pieces if not any(o in templates for o in owners)]
    whole = sum(len("".join(t.split())) for t, _ in left)
    for wanted in (IN_ARTICLE, IN_MAIN):
        own = [t for t, region in left if region & wanted]  # runs end with their blocks
        size = sum(len("".join(t.split())) for t in own)
        if size and size >= LEAST_REGION * whole:
            return " ".join(" ".join(own).split())
    return " ".join("".join(t for t, _ in left).split())


class _Node:
    __slots__ = ("name", "kind", "region", "parts", "canon", "kept", "chars", "whole")

    def __init__(self, name: str, kind: int, region: int):
        self.name, self.kind, self.region = name, kind, region
        self.parts: list = []  # text, or (digest or None, node) of a child
        self.canon: list[str] = [name, "("]
        self.chars = self.kept = 0  # of all text that may be read; without what names may drop
        self.whole = bool(region)  # whether it holds an article or main element that is not boilerplate


class Page:
    """A parsed page: its container subtrees' hashes, and its text without given ones."""

    def __init__(self, html: str):
        self.hashes: set[int] = set()
        self.root = self._parse(html)

    def _close(self, stack: list[_Node]) -> None:
        node = stack.pop()
        parent = stack[-1]
        node.canon.append(")")
        digest = None
        if node.name in CONTAINER:
            raw = blake2b("".join(node.canon).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            digest = int.from_bytes(raw, "little", signed=True)
            if len(node.canon) > 3:
                self.hashes.add(digest)
            parent.canon.append(raw.hex())
        else:
            parent.canon += node.canon if len(node.canon) < 64 else [blake2b("".join(node.canon).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()]
        if node.kind == NEVER:
            return
        block = node.name in BLOCK
        if block:
            parent.parts.append(" ")
        parent.parts.append((digest, node))
        if block:
            parent.parts.append(" ")
        node.canon = []
        parent.chars += node.chars
        if node.kind == KEPT:
            parent.kept += node.kept
            parent.whole |= node.whole

    def _parse(self, html: str) -> _Node:
        stack = [_Node("#page", KEPT, 0)]
        open_names: dict[str, int] = {}

        def close() -> None:
            open_names[stack[-1].name] -= 1
            self._close(stack)

        def put(text: str) -> None:
            if not text:
                return
            if "&" in text:
                text = unescape(text)
            top = stack[-1]
            top.parts.append(text)
            size = 0 if text.isspace() else len(text) - text.count(" ")
            top.chars += size
            top.kept += size
            top.canon.append(text)

        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                put(html[at:])
                break
            put(html[at : m.start()])
            at = m.end()
            ends, name, attrs = m.groups()
            if name is None:
                m = _LOOSE.fullmatch(m[0])
                if m is None:
                    continue
                ends, name, attrs = m.groups()
            name = name.lower()
            if ends:
                if not open_names.get(name):
                    continue
                if name not in BLOCK:  # an inline end tag does not close blocks
                    depth = len(stack) - 1
                    while stack[depth].name != name and stack[depth].name not in BLOCK:
                        depth -= 1
                    if stack[depth].name != name:
                        continue
                while stack[-1].name != name:
                    close()
                close()
                continue
            if name in ENDS_P and open_names.get("p"):
                while stack[-1].name != "p":
                    close()
                close()
            if name in CLOSES:
                names, until = CLOSES[name]
                depth = len(stack) - 1
                while depth > 0 and stack[depth].name not in names and stack[depth].name not in until:
                    depth -= 1
                if depth > 0 and stack[depth].name in names:
                    while len(stack) > depth:
                        close()
            if name in VOID:
                if name in BLOCK:
                    stack[-1].parts.append(" ")
                    stack[-1].canon.append(" ")
                continue
            in_main = bool(open_names.get("article") or open_names.get("main"))
            region = IN_ARTICLE if name == "article" else IN_MAIN if name == "main" or attrs and _ROLE_MAIN.search(attrs) else 0
            stack.append(_Node(name, _kind(name, attrs, in_main), region))
            open_names[name] = open_names.get(name, 0) + 1
            if name in RAW:
                end = _RAW_ENDS[name].search(html, at)
                at = end.start() if end else size
        while len(stack) > 1:
            close()
        return stack[0]

    def pieces(self, named: bool = True) -> list[tuple[str, tuple[int, ...], int]]:
        """The text in order without boilerplate (all of it, if not named): each run with the hashes of the subtrees that
        may be deleted around it, and its region."""
        out: list[tuple[str, tuple[int, ...], int]] = []
        kept, whole = self.root.kept, self.root.whole
        todo: list = [(iter(self.root.parts), (), 0)]
        while todo:
            line, owners, region = todo[-1]
            part = next(line, None)
            if part is None:
                todo.pop()
            elif isinstance(part, str):
                out.append((part, owners, region))
            else:
                digest, node = part
                if named and node.kind != KEPT:
                    around = node.kind == UNLESS_AROUND and not whole and (node.whole or kept < LEAST_OUTSIDE * node.kept)
                    if not around:
                        continue
                    kept, whole = kept + node.kept, whole or node.whole
                deletable = digest is not None and 2 * node.chars <= self.root.chars
                todo.append((iter(node.parts), (*owners, digest) if deletable else owners, region | node.region))
        return [("".join(t for t, *_ in run), *where) for where, run in groupby(out, key=lambda x: x[1:])]

    def text(self, templates: Collection[int] = (), named: bool = True) -> str:
        """The main region's text, blocks joined by one space, without subtrees whose hash is in templates."""
        return joined(self.pieces(named), templates)

    def digest(self) -> int:
        """Of all that the page says."""
        return int.from_bytes(blake2b("".join(self.root.canon).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


PARSED = "struct<page:bigint,hashes:array<bigint>,text:string,pieces:array<struct<t:string,owners:array<bigint>,region:int>>>"


def parsed(pages: DataFrame, named: bool = True) -> DataFrame:
    """pages without html, with _mr_host and _mr (page: hash of the whole page; hashes of its containers; text or,
    where some subtree could be deleted from it, its pieces). Written to the shared folder."""

    @F.pandas_udf(PARSED)
    def parse(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            page = Page(h or "")
            pieces = page.pieces(named)
            deletable = any(o for _, o, _ in pieces)
            rows.append((page.digest(), sorted(page.hashes), None if deletable else joined(pieces, ()), [{"t": t, "owners": list(o), "region": r} for t, o, r in pieces] if deletable else None))
        return pd.DataFrame(rows, columns=["page", "hashes", "text", "pieces"])

    found = pages.withColumns({"_mr_host": host_of(F.col("url")), "_mr": parse("html")})
    return materialize(found.drop("html", "text"), "pages")


def site_templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_mr_host, subtree (hash) of parsed pages: container subtrees on at least least_pages pages of a host that differ.
    Copies of a page count once; pages without a host don't count. One row per host and subtree."""
    found = found.where("_mr_host <> ''").select("_mr_host", "_mr.page", F.explode("_mr.hashes").alias("subtree"))
    return found.distinct().groupBy("_mr_host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).drop("n")


def _held(found: DataFrame, templates: DataFrame) -> DataFrame:
    """_mr_host, _mr_page and _mr_templates (the templates among its own subtrees) of each different page that has any."""
    each = found.where("_mr_host <> '' and _mr.pieces is not null").select("_mr_host", F.col("_mr.page").alias("_mr_page"), F.explode(F.array_distinct(F.flatten("_mr.pieces.owners"))).alias("subtree"))
    each = join_counted(each.distinct(), templates, ["_mr_host", "subtree"])
    return each.groupBy("_mr_host", "_mr_page").agg(F.sort_array(F.collect_list("subtree")).alias("_mr_templates"))


def _without(pieces: Iterable[dict], templates: Collection[int]) -> str:
    return joined([(x["t"], x["owners"], x["region"]) for x in pieces], templates)


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, named: bool = True) -> DataFrame:
    """Replace html by text in every row of pages (url, html): the outermost articles, else the main element, else
    the page, without site templates and, if named, boilerplate by name. Null and empty pages have an empty text. A page without a host
    has no site. Repeated rows have equal texts. Other columns stay; a column named text is replaced."""
    found = parsed(pages, named)
    templates = materialize(site_templates(found, least_pages), "templates")
    few = templates.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:  # looked up where the pages are
        known = pages.sparkSession.sparkContext.broadcast(frozenset(map(tuple, few)))

        @F.pandas_udf("string")
        def without(pieces: pd.Series, host: pd.Series) -> pd.Series:
            held = known.value
            return pd.Series([None if p is None else _without(p, {o for x in p for o in x["owners"] if (h, o) in held}) for p, h in zip(pieces, host)], index=pieces.index, dtype=object)

        site = found.withColumn("_mr_text", without("_mr.pieces", "_mr_host"))
    else:

        @F.pandas_udf("string")
        def without(pieces: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([None if p is None else _without(p, frozenset(() if t is None else t)) for p, t in zip(pieces, own)], index=pieces.index, dtype=object)

        site = join_counted(found.withColumn("_mr_page", F.col("_mr.page")), materialize(_held(found, templates), "held"), ["_mr_host", "_mr_page"], "left")
        site = site.withColumn("_mr_text", without("_mr.pieces", "_mr_templates"))
    site = site.withColumn("text", F.coalesce("_mr_text", "_mr.text"))
    return site.select(*[c for c in pages.columns if c not in ("html", "text")], "text")
