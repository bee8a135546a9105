"""Main text of web pages by a site style tree.

All pages of a host are merged into one tree of element paths (tag, class and
id with digits removed).  Every path has, over the pages that show it, a
distribution of presentations (its child elements) and of contents (its text).
Their entropies give its importance: a branch that looks and reads the same
on page after page has an importance near 0, an article near 1.  Copies of a
page are no evidence: of the pages of a host whose content is equal, one
counts.  Branches of low importance are cut from each page, together with those whose element says
that they are not the article (navigation, forms, advertising, comments, ...),
by tag, role or name, however important: what differs from page to page is not
therefore the article.  Only a name that tells what is around an element
(``has-sidebar``) gives way, where ``LEAST_PAGES`` pages of the host show the
element and it is of high importance.  Where a page declares an
article, text beside it goes, and its text elements stay however often a copy
of it occurs; a cut never takes html, body, the article or an element around
it, nor all of an article's text.

The tree is never built in one place: pages emit (host, path, presentation or
content) digests, which two aggregations turn into importances, so a host may
hold any share of the pages.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table
from .urls import url_parts

LEAST_PAGES, LEAST_IMPORTANCE, CONTENT_SHARE = 4, 0.2, 0.9
SMALL_TABLE = 100_000  # cut branches that may be broadcast: about 3 MB of digests

_MARKUP = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_TAG_PART = re.compile(r">|=\s*([\"'])")  # the tag's end, or a quoted value's begin
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript",
                                                                 "template", "iframe", "svg", "select", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
_BLOCK = _TEXT | frozenset("html body div article main section header footer nav aside form ul ol dl table thead "
                           "tbody tfoot tr figure fieldset address details summary dialog menu center hgroup "
                           "search option optgroup legend head".split())
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu head label fieldset canvas audio video object "
                        "search script style textarea title noscript template iframe svg select xmp".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_NOISE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sidebar|cookies?|consent|notices?|alert|comments?|replies|respond|menu|nav|"
    r"navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|promo\w*|popup|modal|newsletter|"
    r"subscribe|related|recommended|sponsor\w*|toolbar|pagination|widget|login|signup|search)(?:[-_\s]|$)", re.I)
_LAYOUT_NAME = re.compile(r"(?<!\S)(?:has|have|with|without|no|hide|show)[-_]\S*", re.I)  # says what is around
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_DIGITS = re.compile(r"\d+")
_KEYS: dict[tuple, int] = {}
CUT, NAMED, BESIDE = 1, 2, 3  # kinds of noise: low importance, by class or id, by tag or role


_NEVER_TEXT = frozenset("button head label canvas audio video object script style textarea title noscript template "
                        "iframe svg select xmp".split())


def _key(parent: int, tag: str, name: str) -> int:
    got = _KEYS.get((parent, tag, name))
    if got is None:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        got = _KEYS[parent, tag, name] = xxhash.xxh64_intdigest(f"{parent}/{tag}.{name}") - 2**63
    return got


class _Node:
    __slots__ = ("tag", "key", "noise", "declared", "text", "shape")

    def __init__(self, tag, key, noise, declared):
        self.tag, self.key, self.noise, self.declared = tag, key, noise, declared
        self.text = self.shape = 0


class Page:
    """One pass over a page: text blocks in order, each with its kind of noise
    (0: none) and whether it is declared article text; and, per element path,
    digests of its presentation and content."""

    def __init__(self, source: str, cut: frozenset = frozenset(), live: frozenset = frozenset()):
        self.cut, self.live = cut, live  # paths that importance decides on: of low importance, and others
        self.blocks: list[tuple[str, int, bool]] = []  # text, noise, declared
        self.paths: dict[int, list[int]] = {}
        self.prior: set[int] = set()  # paths whose element says it is not the article
        self._stack = [_Node("", 0, 0, False)]
        self._open: dict[str, int] = {}
        self._run: list[str] = []
        self._unclosed: set[str] = set()
        self._parse(source)

    def _parse(self, s: str) -> None:
        at, last = 0, s.rfind(">") + 1
        while at < len(s):
            m = _MARKUP.search(s, at, last) if at < last else None
            if m is None:
                # the rest is text, or a tag that the page's end cuts off
                tail = re.search(r"<[A-Za-z/!]", s[at:])
                self._run.append(s[at:at + tail.start()] if tail else s[at:])
                break
            if m.start() > at:
                self._run.append(s[at:m.start()])
            if m[2] is None:  # a comment, or a declaration
                end = s.find("-->", m.end(), last) if m[0] == "<!--" else s.find(">", m.end(), last)
                at = last if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            tag, end = m[2].lower(), self._tag_end(s, m.end(), last)
            attributes, at = s[m.end():end], end + 1
            if m[1]:
                self._end(tag)
                continue
            if tag in _RAW and not (attributes.endswith("/") and tag == "svg"):
                end = _RAW[tag].search(s, at)
                at = end.end() if end else len(s)
                continue
            self._start(tag, attributes)
        self._flush()
        while len(self._stack) > 1:
            self._pop()

    def _tag_end(self, s: str, start: int, last: int) -> int:
        """The tag's ``>``: the first outside quoted values, or, where a quote
        is never closed, the first of all.  That a quote has no end is found
        out once a page, so time stays linear."""
        at = start
        while m := _TAG_PART.search(s, at, last):
            if not m[1]:
                return m.start()
            end = -1 if m[1] in self._unclosed else s.find(m[1], m.end(), last)
            if end < 0:
                self._unclosed.add(m[1])
                break
            at = end + 1
        return s.find(">", start, last)

    def _flush(self) -> None:
        if self._run:
            text = " ".join(html.unescape("".join(self._run)).split())
            self._run.clear()
            if text:
                top = self._stack[-1]
                self.blocks.append((text, top.noise, top.declared))
                top.text = (top.text * 31 + xxhash.xxh64_intdigest(text)) & 0xFFFFFFFFFFFFFFFF

    def _pop(self) -> None:
        node = self._stack.pop()
        self._open[node.tag] -= 1
        up = self._stack[-1]
        up.text = (up.text * 31 + node.text) & 0xFFFFFFFFFFFFFFFF
        got = self.paths.setdefault(node.key, [0, 0])
        got[0] = (got[0] * 31 + node.shape) & 0xFFFFFFFFFFFFFFFF
        got[1] = (got[1] * 31 + node.text) & 0xFFFFFFFFFFFFFFFF

    def _close(self, tags) -> None:
        """Close the innermost open element of ``tags`` and what is in it, but
        not across a container."""
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i].tag
            if tag in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if tag not in ("p", "td", "th", "li", "dt", "dd", "option") and tag in _BLOCK:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self._run.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag not in _BLOCK and tag not in _NOISE_TAGS and not attributes:
            return  # plain inline markup shapes nothing
        if tag in _BLOCK:
            self._flush()
            if self._open.get("p"):
                self._close(("p",))
            if tag in _CLOSES:
                self._close(_CLOSES[tag])
        elif tag not in _NOISE_TAGS and not _NOISE_NAME.search(attributes):
            return
        else:
            self._flush()
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        up = self._stack[-1]
        role = found.get("role", "").lower()
        name = f"{found.get('class', '')} {found.get('id', '')}"
        article = tag in ("article", "main") or role == "main"
        # an outermost article is one whatever is said of the elements around it, unless they are beside it by tag or role
        inherited = 0 if article and not up.declared and up.noise in (CUT, NAMED) else up.noise
        key = _key(up.key, tag, _DIGITS.sub("", name))
        said = self._noise(tag, role, name, up)
        # importance cuts more; of what an element says of itself it overrules only a name that tells
        # what is around (``has-sidebar``); an article's own class or id never drops it
        weak = said == NAMED and (article or key in self.live and not _NOISE_NAME.search(_LAYOUT_NAME.sub(" ", name)))
        noise = 0 if weak else said
        declared = up.declared or (article and not max(noise, inherited))
        if not noise and key in self.cut and tag not in ("html", "body") \
                and not (declared and (tag in _TEXT or not up.declared)):
            noise = CUT
        noise = max(noise, inherited)
        self.prior.update([key] if said and tag not in _NEVER_TEXT else ())
        up.shape = (up.shape * 31 + key) & 0xFFFFFFFFFFFFFFFF
        self._stack.append(_Node(tag, key, noise, declared))
        self._open[tag] = self._open.get(tag, 0) + 1

    @staticmethod
    def _noise(tag: str, role: str, name: str, up: _Node) -> int:
        """What an element says of itself."""
        if tag in _NOISE_TAGS or role in _NOISE_ROLES or (tag == "header" and not up.declared):
            return BESIDE
        return NAMED if tag not in ("html", "body") and _NOISE_NAME.search(name) else 0

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._run.append(" ")
        elif tag in _BLOCK or self._open.get(tag):
            self._flush()
        if self._open.get(tag):
            while self._stack[-1].tag != tag:
                self._pop()
            self._pop()

    def main_text(self) -> str:
        kept = [(t, d) for t, noise, d in self.blocks if not noise]
        if not any(d for _, d in kept):  # cut out of a declared article: all of it, so none
            kept = [(t, d) for t, noise, d in self.blocks if d and noise <= CUT] or kept
        if any(d for _, d in kept):
            kept = [(t, d) for t, d in kept if d]
        return "\n\n".join(t for t, _ in kept)

    def content(self) -> bytes:
        """A digest that copies of a page share: of the declared article, or of all text."""
        texts = [t for t, _, d in self.blocks if d] or [t for t, _, _ in self.blocks]
        return xxhash.xxh3_128_digest("\0".join(texts))


_PATHS = pa.list_(pa.struct([("path", pa.int64()), ("shape", pa.int64()), ("text", pa.int64()),
                              ("prior", pa.bool_())]))


def _digest_rows(batches):
    """(host, content, paths) of every page: digests of each element path."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            content, paths = [], []
            part = batch.slice(i, 64)
            for source in part.column(1).to_pylist():
                page = Page(source or "")
                content.append(page.content())
                paths.append([{"path": p, "shape": both[0] - 2**63, "text": both[1] - 2**63, "prior": p in page.prior}
                              for p, both in sorted(page.paths.items())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), pa.array(paths, _PATHS)],
                                             names=["host", "content", "paths"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, prior (an element says it is not the article), pages, presentation, content, importance.  ``pages``: host
    (a digest) and html.  Both parts are entropies of the path's variants over
    the pages of different content that show it, to the base of their number:
    0 where all pages agree, 1 where all differ."""
    distinct = pages.select("host", "html").mapInArrow(
        _digest_rows, "host long, content binary, paths array<struct<path:long,shape:long,text:long,prior:boolean>>") \
        .groupBy("host", "content").agg(F.min("paths").alias("paths"))
    seen = distinct.select("host", F.explode("paths").alias("p")) \
        .select("host", "p.path", "p.prior", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in
                                                      ((0, "p.shape"), (1, "p.text"))])).alias("v")) \
        .groupBy("host", "path", "v.kind", "v.value").agg(F.count("*").alias("n"), F.max("prior").alias("prior"))
    merged = seen.groupBy("host", "path").agg(
        F.max("prior").alias("prior"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"m{k}") for k in (0, 1)],
        *[F.sum(F.when(F.col("kind") == k, F.col("n") * F.log(F.col("n").cast("double")))).alias(f"l{k}") for k in (0, 1)])
    entropy = [F.when(F.col(f"m{k}") > 1, 1 - F.col(f"l{k}") / (F.col(f"m{k}") * F.log(F.col(f"m{k}").cast("double"))))
               .otherwise(1.0) for k in (0, 1)]
    return merged.select("host", "path", "prior", F.col("m1").alias("pages"), entropy[0].alias("presentation"),
                         entropy[1].alias("content")) \
        .withColumn("importance", (1 - CONTENT_SHARE) * F.col("presentation") + CONTENT_SHARE * F.col("content"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, text, n_chars.

    Text blocks (character references decoded, white space runs as one space)
    in page order, joined by two line feeds.  Null and empty html, and pages
    without main text, give an empty text; pages without url form a host of
    their own; repeated rows and null ids are extracted like any other; an
    empty table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "html-text")
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                         F.xxhash64(url_parts(F.col(url_col))[0]).alias("host"), F.col(html_col).alias("html"))
    low = F.col("importance") < LEAST_IMPORTANCE
    decided = scratch.write(style_tree(pages).where((F.col("pages") >= LEAST_PAGES) & (low | F.col("prior")))
                            .select("host", "path", low.alias("low")), "decided")
    per_host = decided.groupBy(F.col("host").alias("h")).agg(
        F.collect_set(F.when(F.col("low"), F.col("path"))).alias("cut"),
        F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("live"))
    if decided.count() <= SMALL_TABLE:
        per_host = F.broadcast(per_host)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [Page(source or "", frozenset(c or ()), frozenset(e or ())).main_text() for source, c, e in
                         zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return pages.join(per_host, F.col("host") == F.col("h"), "left").select("id", "url", "html", "cut", "live").mapInArrow(
        run, "id long, url string, text string, n_chars long") \
        .withColumnsRenamed({"id": id_col, "url": url_col})


def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every row of pages."""
    return main_texts(table(spark, sf_dir, "pages"))
