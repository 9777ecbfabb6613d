"""Operator 3: main text of web pages, with removal of site templates.

A page is read once into blocks of text and the tree of elements around them; every element that shows text is hashed from
its tag, its own text and the hashes of the elements in it, bottom up.  Spark counts the hashes per host, once per distinct
content (the text of the page's main blocks), so that copies of one page count as one and keep their text; an element
whose hash recurs with at least ``MIN_PAGES`` contents is deleted with its text, however many pages its host has.
Paragraphs, headings and list items inside an article are never taken for a template (in other articles, quotations and near
copies they recur as content), containers inside an article are.  Elements that are no article text by their own account
(menus, headers and footers of the page, sidebars, adverts, notices, forms, scripts, styles, reader comments) go by tag,
role, class or id, however few pages a host has; so do blocks outside paragraphs and the like that are only a call
(``CALLS``: "Read more").  A class counts as a whole name ("sidebar", "site-header"), not as a modifier of something else
("has-sidebar", "no-comments"), and never on what holds the only article.  Inside a sentence a class removes adverts only.

Where a page has an article (or a main element), text outside counts as boilerplate.  The parsed pages are stored, with the
text that they have if no element of theirs is a template; only pages whose main text lies in countable elements meet the
counts.  Null and empty pages have the text "".  Pages without host take no part in counting.  An empty table gives no rows.
Rows are named by 128 bits of their values: ids and urls may be null or repeated, equal rows count as one page.
Other columns are not read.  HTML itself is never shuffled.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import ROWS_AT_ONCE
from .common import own_exchange, row_key, stored

MIN_PAGES = 6  # distinct contents of a host
PARSED = ["content", "hashes", "text", "packed"]

# Element names and words of HTML
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = set("head nav aside form noscript template iframe object svg math canvas audio video select button dialog menu footer".split())
ARTICLE = set("article main".split())
PROTECTED = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login paywall "
    "comment comments disqus replies share sharing social related recommended pagination pager toolbar".split())
COMMENTS = set("comment comments reply replies".split())
ADVERTS = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion".split())
MODIFIERS = set("has have had no not non with without is in on off hide hidden show shown open opened closed toggle enabled disabled before after below above".split())
OF_ARTICLES = set("post entry article story content".split())  # their headers are headings
CALLS = {"read more", "continue reading", "learn more", "show more", "load more", "share this", "back to top", "skip to content"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"((?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?)", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Element:
    name: str
    parent: "Element | None"
    hidden: bool  # boilerplate by tag, role or attribute, or inside such
    classed: bool  # boilerplate by its class or id
    article: bool  # an article, or inside one
    candidate: bool  # could be part of a template
    hasher: "xxhash.xxh3_64 | None"
    holds_article: bool = False
    gone: bool = False  # classed, or inside such
    shows: bool = False  # some block lies in it
    digest: int = 0


@dataclass
class Page:
    blocks: list[tuple[str, bool, int]] = field(default_factory=list)  # text, inside an article, innermost candidate around it or -1
    tree: list[tuple[int, int]] = field(default_factory=list)  # candidates that show text: hash, the next candidate around it or -1

    @property
    def main(self) -> list[tuple[str, int]]:
        inside = any(a for _, a, _ in self.blocks)
        return [(t, e) for t, a, e in self.blocks if a or not inside]

    @property
    def content(self) -> int:
        """Names the text of the page's main blocks."""
        return xxhash.xxh3_64_intdigest("\n".join(t for t, _ in self.main))

    def text(self, templates: set[int] = frozenset()) -> str:
        """Main blocks outside template elements.  An element comes behind those around it in the tree."""
        gone: list[bool] = []
        for digest, around in self.tree:
            gone.append(digest in templates or around >= 0 and gone[around])
        return "\n".join(t for t, e in self.main if e < 0 or not gone[e])


def _named(value: str, words: set[str]) -> bool:
    """Is one of the names in a class or id attribute one of ``words``, or made of one at its end or beginning?"""
    for name in value.split():
        parts = [w.lower() for w in WORD.findall(name)]
        if not parts or MODIFIERS.intersection(parts):
            continue
        some = {parts[0], parts[-1]} & words
        if some and not (some <= {"header", "banner"} and OF_ARTICLES.intersection(parts)):
            return True
    return False


def _attributes(name: str, tag: str) -> list[tuple[str, str, bool]]:
    """(key, value, has it a value?) of the attributes that count."""
    if "=" not in tag and "hidden" not in tag:
        return []
    return [(key.lower(), a or b or c, "=" in whole) for whole, key, a, b, c in ATTRIBUTE.findall(tag[len(name) + 1:])]


def _hidden(name: str, attributes: list[tuple[str, str, bool]], article: bool) -> bool:
    if name in HIDDEN or name == "header" and not article:
        return True
    return any(key == "hidden" and not valued or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES
               for key, value, valued in attributes)


def _classed(name: str, attributes: list[tuple[str, str, bool]], words: set[str]) -> bool:
    return name not in ("html", "body") and any(key in ("class", "id") and _named(value, words) for key, value, _ in attributes)


def parse(source: str) -> Page:
    """One pass over the tags; tolerant of elements that are never closed."""
    root = Element("", None, False, False, False, False, None)
    top = root
    found: list[tuple[str, Element]] = []  # text, the element that it lies in
    order: list[Element] = []  # as they open
    pieces: list[str] = []
    skipped: list[str] = []  # inline elements that are boilerplate and still open, and those in them
    opened: Counter[str] = Counter()  # elements that are open, by name
    at = 0

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                if top.hasher is not None:
                    top.hasher.update(text.encode("utf-8", "surrogatepass") + b"\0")
                if not top.hidden and (top.name in PROTECTED or text.lower().rstrip(" .…:>»›→") not in CALLS):
                    found.append((text, top))

    def close(until: Element) -> None:
        """Close all elements inside ``until``, and itself."""
        nonlocal top
        flush()
        while True:
            now = top
            if now.hasher is not None:
                now.digest = now.hasher.intdigest()
                if now.parent is not None and now.parent.hasher is not None:
                    now.parent.hasher.update(now.digest.to_bytes(8, "little"))
                now.hasher = None
            opened[now.name] -= 1
            top = now.parent or root
            if now is until:
                return

    while True:
        m = TOKEN.search(source, at)
        text = source[at:m.start() if m else len(source)]
        if text and not skipped and not top.hidden:
            pieces.append(text)
        if not m:
            break
        tag, at = m.group(), m.end()
        if tag[1] in "!?":
            continue
        name = NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name in INLINE:
                if name in skipped:  # what it holds ends with it, closed or not
                    while skipped.pop() != name:
                        pass
                continue
            if opened[name] > 0:
                node = top
                while node.name != name:
                    node = node.parent
                skipped.clear()
                close(node)
            elif name == "p":
                flush()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                pieces.append(" ") if name == "br" else flush()
            continue
        attributes = _attributes(name, tag)
        if name in INLINE:
            in_sentence = top.name in PROTECTED
            if skipped or _hidden(name, attributes, top.article) or _classed(name, attributes, ADVERTS if in_sentence else BOILERPLATE):
                if not tag.endswith("/>"):
                    skipped.append(name)
            continue
        skipped.clear()  # a block ends what was skipped inside the block before
        flush()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        # a new block ends an open paragraph; items end their like
        shut = CLOSES.get(name, set()) | {"p"}
        if top.name in shut:
            close(top)
            if top.name in CLOSES.get(name, ()):
                close(top)
        remark = name in ARTICLE and _classed(name, attributes, COMMENTS)
        article = top.article or name in ARTICLE and not remark
        hidden = top.hidden or remark or _hidden(name, attributes, article)
        classed = name not in ARTICLE and _classed(name, attributes, BOILERPLATE)
        candidate = not hidden and name not in ("html", "body") and name not in ARTICLE and not (article and name in PROTECTED)
        hasher = None
        if not hidden and (candidate or top.hasher is not None):
            hasher = xxhash.xxh3_64(" ".join(tag.split()).encode("utf-8", "surrogatepass"))
        top = Element(name, top, hidden, classed, article, candidate, hasher)
        opened[name] += 1
        order.append(top)
    flush()
    while top.parent is not None:
        close(top)
    return _page(found, order)


def _page(found: list[tuple[str, Element]], order: list[Element]) -> Page:
    """Class rules, decided once the whole page is known, and the tree of what is left.  Elements come in the order in which they
    open, so each behind its parent."""
    def decide() -> None:
        for e in order:
            e.gone = e.parent is not None and e.parent.gone or e.classed and not e.holds_article

    decide()
    if not any(e.name in ARTICLE and e.article and not e.gone and not e.hidden for e in order):
        for e in reversed(order):  # classes on what holds the only articles say nothing
            if (e.holds_article or e.name in ARTICLE and e.article and not e.hidden) and e.parent is not None:
                e.parent.holds_article = True
        decide()
    page = Page()
    shown = [(t, e) for t, e in found if not e.gone]
    for _, e in shown:
        while e is not None and not e.shows:
            e.shows = True
            e = e.parent
    around: dict[int, int] = {}
    for e in order:
        outer = around.get(id(e.parent), -1)
        if e.candidate and e.shows:
            page.tree.append((e.digest, outer))
            outer = len(page.tree) - 1
        around[id(e)] = outer
    page.blocks = [(t, e.article, around.get(id(e), -1)) for t, e in shown]
    return page


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed pages: their text without templates, the hashes of their elements, and, where main text lies in countable elements,
    blocks and tree for another look."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(at, ROWS_AT_ONCE)
            content, hashes, texts, packed = [], [], [], []
            for source in rows.column("html").to_pylist():
                page = parse(source or "")
                content.append(_signed(page.content))
                hashes.append(sorted({_signed(h) for h, _ in page.tree}))
                texts.append(page.text())
                countable = any(e >= 0 for _, e in page.main)
                packed.append(packer.compress(json.dumps([page.blocks, page.tree]).encode()) if countable else None)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(k) for k in range(5)), pa.array(content, pa.int64()), pa.array(hashes, pa.list_(pa.int64())),
                 pa.array(texts, pa.string()), pa.array(packed, pa.binary())], [*batch.schema.names[:5], *PARSED])


def template_elements(pages: DataFrame) -> DataFrame:
    """(k1, k2, templates): for every page with any, the hashes of its elements that recur on its host.  ``pages`` has k1, k2, host,
    content, hashes and whether a page is ``countable``."""
    seen = pages.where("host is not null").select("k1", "k2", "host", "content", "countable", F.explode("hashes").alias("h"))
    counts = seen.select("host", "h", "content").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    templates = counts.where(F.col("n") >= MIN_PAGES).select("host", "h")
    asked = seen.where("countable").select("k1", "k2", "host", "h").distinct()  # equal rows are one page
    return asked.join(own_exchange(templates, "h"), ["host", "h"]).groupBy("k1", "k2").agg(F.collect_list("h").alias("templates"))  # of one page


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)", 1))
    keyed = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), *row_key(F.col(id_col), F.col(url_col), F.col(html_col)),
                      F.when(host != "", host).alias("host"), F.col(html_col).alias("html"))
    kinds = dict(keyed.dtypes)
    ends = f"id {kinds['id']}, url {kinds['url']}"
    pages = stored(keyed.mapInArrow(_parsed, f"{ends}, k1 long, k2 long, host string, content long, hashes array<long>, text string, packed binary"))
    pages = pages.withColumn("countable", F.col("packed").isNotNull())
    asked = pages.where("countable").join(template_elements(pages), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for text, packed, templates in zip(*(batch.column(c).to_pylist() for c in ("text", "packed", "templates"))):
                if templates:
                    blocks, tree = json.loads(unpacker.decompress(packed))
                    text = Page(blocks, tree).text({h & (1 << 64) - 1 for h in templates})
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    looked_at = asked.select("id", "url", "text", "packed", "templates").mapInArrow(run, f"{ends}, text string")
    texts = pages.where(~F.col("countable")).select("id", "url", "text").unionByName(looked_at)
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
