"""Main text of web pages: site template removal.

* Every page's html is read into elements (unclosed paragraphs, list items and
  cells end where html says they do).  An element's subtree is hashed from its
  tag, its text with white space folded and its children's hashes; attributes
  do not count, as links and ids differ from page to page.
* Per host, Spark counts in how many different surroundings a subtree occurs.
  The surroundings are the page's article text outside that subtree, so copies
  of one article count once and their text is no template.
* A subtree with ``MIN_PAGES`` surroundings is part of the site's template and
  deleted from that host's pages.
* What is declared not to be the article goes too, recurring or not: elements,
  roles and class or id words of menus, headers, footers, sidebars, notices,
  adverts, forms, reader comments; scripts, styles and comments.  If the page
  declares an ``article`` or ``main``, text outside them goes as well.

Elements inside one that is declared no article go with it and are not counted
themselves.  Inside a declared article only boxes (``div``, ``section`` and the like) can be
template: a paragraph, heading, list or table there is the article's own even
if many articles share it, such as a licence line.  The page's root, its
article and what encloses it are never template.

The rest is cut into blocks at block-level tags, character references are
decoded, white space becomes one space, and blocks are joined by a newline.

Defined results: null or empty html gives an empty text; a page without a host
(null url or no ``://``) has no site, so only declared parts go; a repeated row
gives a row each time; a tag that never ends is text; unclosed quotes in a tag
end at its first ``>``, in the rest of that page as well; other columns pass
through.  Every page is read whole.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .registry import load, register

MIN_PAGES = 5  # different surroundings that make a subtree part of the template

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a span button select label svg math object canvas audio video picture".split())
# Tags that neither break a block nor are kept on the stack.
FORMAT = frozenset(
    "abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr output q rp rt ruby s samp "
    "small strike strong sub sup time tt u var wbr img input link meta param source track area base embed "
    "option optgroup".split())
IN_HEAD = RAW | frozenset("base link meta noscript template head".split())
BOXES = frozenset("div section aside nav form header footer details fieldset".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol dl table tbody thead tfoot menu".split())

NOT_ARTICLE = frozenset(
    "nav aside footer form dialog menu head script style template noscript iframe object svg math canvas audio "
    "video button select textarea datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead cookie cookies consent notice popup modal newsletter "
    "subscribe share sharing social related comment comments disqus respond reply replies".split())
BAR_HEADS = frozenset("has no with is without hide show".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "")."""
    at, n, quotes = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        head = page[lt + 1:lt + 4]
        if head == "!--":
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if head[:1] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = head[:1] == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False
            end = page.find(">", name.end())
            if end < 0:
                yield "text", page[lt:], ""
                return
            end += 1
        else:
            end = rest.end()
        tag = name[0].lower()
        at = end
        if closing:
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end():end - 1]
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = n if close is None else close.start()


def _declared(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element says of itself that it is not the article."""
    if tag in NOT_ARTICLE or (tag == "header" and not in_main):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in _ATTR.findall(attributes):
        value = "".join(values).lower()
        kind = name.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            return True
        if kind == "role":
            if value.strip() in ROLES:
                return True
        elif kind in ("class", "id"):
            for word in value.split():
                parts = [p for p in re.split(r"[-_]+", word) if p]
                if not parts or parts[0] in BAR_HEADS:
                    continue
                hit = {parts[0], parts[-1]} & WORDS
                if hit and not (in_main and hit == {"header"}):
                    return True
    return False


class _Open:
    __slots__ = ("tag", "gone", "in_main", "root", "hash", "first", "texts", "holds_main")

    def __init__(self, tag: str, gone: bool, in_main: bool, root: bool, first: int):
        self.tag, self.gone, self.in_main, self.root, self.first = tag, gone, in_main, root, first
        self.hash = blake2b(tag.encode() + b"<", digest_size=8)
        self.texts, self.holds_main = 0, root


class Page:
    """Blocks and subtrees of one page; subtrees in ``deleted`` leave no block."""

    def __init__(self, source: str, deleted: frozenset[int] = frozenset()):
        self.deleted = deleted
        self.blocks: list[tuple[str, bool]] = []  # text, inside a declared article
        self.words: list[str] = []                # of the block being read
        self.has_main = False
        self.subtrees: list[tuple[int, int, int, bool]] = []  # hash, first block, end, is in an article
        self.stack = [_Open("", False, False, False, 0)]
        self.open: dict[str, int] = {}
        for kind, value, attributes in tags(source):
            if kind == "text":
                self._text(value)
            elif kind == "start":
                self._start(value, attributes)
            else:
                self._end(value)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if top.tag in RAW:
            return
        if "&" in text:
            text = _html.unescape(text)
        folded = " ".join(text.split())
        if folded:
            top.hash.update(folded.encode("utf-8", "surrogatepass") + b"\n")
            top.texts += 1
        if not top.gone:
            self.words.append(text)

    def _flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words.clear()
            if text:
                self.blocks.append((text, self.stack[-1].in_main))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.words.append(" ")
            return
        if tag == "hr":
            self._flush()
            return
        if tag in FORMAT or tag in VOID:
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self._end("head")
        inline = tag in INLINE or tag in RAW
        if not inline:
            if self.open.get("p"):
                self._end("p")
            enders = ENDED_BY.get(tag)
            if enders:
                self._end_item(enders)
            self._flush()
        if tag in ("html", "body") and self.open.get(tag):
            return
        top = self.stack[-1]
        gone = top.gone or _declared(tag, attributes, top.in_main)
        root = tag in ("article", "main") and not gone
        self.has_main |= root
        self.stack.append(_Open(tag, gone, top.in_main or root, root, len(self.blocks)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end_item(self, enders: tuple[str, ...]) -> None:
        """End the open item that a next one of its list ends."""
        if not any(self.open.get(t) for t in enders):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in LISTS:
                return
            if tag in enders:
                while len(self.stack) > k:
                    self._pop()
                if enders == ENDED_BY["tr"] and tag != "tr":
                    self._end_item(enders)
                return

    def _end(self, tag: str) -> None:
        if tag in ("body", "html") or not self.open.get(tag):
            if tag not in FORMAT and tag not in INLINE:
                self._flush()
            return
        if tag in INLINE:
            if self.stack[-1].tag == tag:
                self._pop()
            return
        while self.stack[-1].tag != tag:
            self._pop()
        self._pop()

    def _pop(self) -> None:
        top = self.stack[-1]
        if top.tag not in INLINE and top.tag not in RAW:
            self._flush()
        self.stack.pop()
        self.open[top.tag] -= 1
        above = self.stack[-1]
        if top.tag in RAW:
            return
        above.holds_main |= top.holds_main
        if not top.texts:
            return
        digest = top.hash.digest()
        above.hash.update(digest)
        above.texts += top.texts
        if top.tag in INLINE or top.tag in ("html", "body") or top.holds_main or above.gone:
            return  # the last: it goes with what it is in
        if top.in_main and top.tag not in BOXES:
            return
        value = int.from_bytes(digest, "big", signed=True)
        if value in self.deleted:
            del self.blocks[top.first:]
        self.subtrees.append((value, top.first, len(self.blocks), top.in_main))

    def text(self) -> str:
        return "\n".join(t for t, inside in self.blocks if inside or not self.has_main)

    def surroundings(self) -> dict[int, int]:
        """Hash of each subtree -> hash of the article text outside it (a sum
        over blocks, so that a subtree's own can be taken off)."""
        sums = [0]
        for t, inside in self.blocks:
            h = int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            sums.append((sums[-1] + (h if inside or not self.has_main else 0)) % 2**64)
        out: dict[int, int] = {}
        for value, first, end, _ in self.subtrees:
            rest = (sums[-1] - sums[end] + sums[first]) % 2**64
            out.setdefault(value, rest - 2**64 if rest >= 2**63 else rest)
        return out


_PAIRS = "array<struct<subtree:bigint,around:bigint>>"
_ARROW_PAIRS = pa.list_(pa.struct([("subtree", pa.int64()), ("around", pa.int64())]))


def _subtrees(pages: pa.Array) -> pa.Array:
    return pa.array(
        [[{"subtree": s, "around": a} for s, a in Page(p.as_py() or "").surroundings().items()] for p in pages],
        _ARROW_PAIRS)


def _texts(pages: pa.Array, deleted: pa.Array) -> pa.Array:
    return pa.array(
        [Page(p.as_py() or "", frozenset(d.as_py() or ())).text() for p, d in zip(pages, deleted)], pa.string())


_subtrees.__annotations__ = {"pages": pa.Array, "return": pa.Array}
_texts.__annotations__ = {"pages": pa.Array, "deleted": pa.Array, "return": pa.Array}


def site_of(url: Column) -> Column:
    """Host of a url, '' if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def site_templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of subtrees with at least ``min_pages`` surroundings on
    a host, of (host, subtree, around) rows.  Both counts combine before they
    shuffle, so a subtree of a million pages arrives as one row a task."""
    return (
        found.select("host", "subtree", "around").distinct()
        .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages).select("host", "subtree"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              out: str = "text", min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with a column ``out``: the page's main text."""
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"))
    field = lambda c: F.col("row").getField(c)
    host = site_of(field(url_col))
    # 128 bits name a row; equal rows share what is deleted from them.
    of_row = [field(id_col), host, field(html_col)]
    key = F.struct(F.xxhash64(*of_row).alias("a"), F.xxhash64(F.lit(1), *of_row).alias("b"))
    pairs = F.arrow_udf(_subtrees, _PAIRS).asNondeterministic()  # evaluated once, though explode filters
    found = rows.where(host != "").select(
        key.alias("key"), host.alias("host"), F.explode(pairs(field(html_col))).alias("p"))
    # Written once: read for the counts and for the pages they concern.
    found = materialize(found.select("key", "host", "p.*"), "page-subtrees")
    hits = found.select("key", "host", "subtree").join(site_templates(found, min_pages), ["host", "subtree"])
    deleted = hits.groupBy("key").agg(F.collect_set("subtree").alias("deleted"))
    text = F.arrow_udf(_texts, "string").asNondeterministic()
    return rows.withColumn("key", key).join(deleted, "key", "left").select(
        "row.*", text(field(html_col), "deleted").alias(out))


@register("op12_html_extraction")
def op12_html_extraction(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
