"""Main text of web pages by equivalence-class templates (operator 10).

Pages of one host share a template.  A page is read as a sequence of tokens:
tags with their classes and whole text blocks, each told apart by the path of
containers that hold it.  A token's occurrence vector says how often it
occurs on each page of the host; tokens with the same vector form an
equivalence class.  Spark never builds the vectors: it sums two hashes of
(page, count) per (host, token), so equal vectors have equal sums and the
pages of a large host combine before the shuffle.

A class is valid when it holds a tag and another token and its pages are at
least ``MIN_PAGES`` and ``MIN_SHARE`` of the host's.  The tokens of a valid
class are ordered by where they first occur, summed over the host's pages;
the ordered classes are the host's template.  On each page the classes are
nested: a class that opens inside the gap of another is its child until a
token of the outer one follows.  A slot is the gap after a token of a class,
and the text that the template does not hold fills the slots.  Text inside
containers for menus, headers, footers, side bars, notices, adverts, forms
and reader comments is left out.  They are told by their element, by a whole
class, id or role from a short list, or by a hyphened part of one
(``comment-list``); a part leaves out nothing that holds an article or the
first-level heading, nor a paragraph or list item by itself, and no word
leaves out a heading inside an article.  Of several articles those inside such
containers, or named so themselves, are left out; where all articles of a page
are inside, the ones with a first-level heading are taken, or all of them if
the page says nothing else.  ``br`` is a blank.  Where a token of the template is inside
``article``, ``main`` or role main, the slots after such tokens are the main
ones and only their text is taken; else the text of all slots is.

Defined results
    * null or empty html, or no text: empty text;
    * a host with too few pages has no template; its pages are read by their
      containers alone; pages without a host are a host of their own;
    * a page that fills no main slot of its host's template, or has an article
      where the template has none, is read by its containers, too, less the
      template's text;
    * text of the template is dropped inside the article, too, but a page
      whose main slots hold nothing else (copies of one page) keeps it;
    * repeated rows get a row each; an empty table gives an empty result;
      extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

MIN_PAGES = 5
MIN_SHARE = 0.5

# Element names and container words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
LEAF = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr tbody thead tfoot option caption pre blockquote".split())
LEFT_OUT = frozenset(
    "head nav header footer aside form script style title textarea iframe noscript noembed noframes template button select "
    "menu dialog object svg canvas audio video".split()
)
LEFT_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside widget header masthead footer cookie cookies consent gdpr notice notices popup modal "
    "comment comments disqus social share sharing related recommended newsletter subscribe pagination pager "
    "cookie-notice cookie-banner cookie-bar cookie-consent site-header site-footer page-footer main-nav main-menu".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NEGATIONS = frozenset("no not non has with without".split())  # as in no-sidebar
# what a start tag ends when it is open innermost: HTML lets these go unclosed
ENDS = {name: ("p",) for name in (
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile("[a-z0-9]+")


class Block:
    __slots__ = ("text", "main", "token", "place")

    def __init__(self, text: str, main: bool, token: int, place: Place | None = None):
        self.text, self.main, self.token, self.place = text, main, token, place


class Place:
    """What the containers around a point of a page say of it."""

    __slots__ = ("out", "article", "maybe")

    def __init__(self, out: int = 0, article: Article | None = None, maybe: tuple[list[bool], ...] = ()):
        self.out = out  # 1: inside a container left out by a whole word, 2: by its element
        self.article = article
        self.maybe = maybe  # containers with a listed part in a name; whether each holds an article or heading


class Article:
    __slots__ = ("listed", "headed")

    def __init__(self, listed: bool):
        self.listed = listed  # inside a container left out by a word, or named so itself
        self.headed = False  # holds a first-level heading


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def _names_left_out(name: str) -> bool:
    parts = _WORD.findall(name)
    return len(parts) > 1 and NEGATIONS.isdisjoint(parts) and not LEFT_OUT_WORDS.isdisjoint(parts)


class Page:
    """What one page holds: text blocks outside left-out containers, tags, and whether there is an article slot.

    ``events``: tokens in page order, the block of each (None: a tag), and whether what follows is inside the article.
    """

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.events: list[tuple[int, Block | None, bool]] = []
        self.has_main = False
        self._articles: list[Article] = []
        self._places: list[Place] = []  # of every event
        self._stack: list[tuple[str, str, Place]] = []  # name, path, place
        self._text: list[str] = []
        self._at = Place()
        self._read(html)
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """Once all containers are known: which articles are the main ones, and what is left out."""
        best = [a for a in self._articles if not a.listed] or [a for a in self._articles if a.headed]
        if not best and not any(self._held(b.place) and b.place.article is None for b in self.blocks):
            best = self._articles
        chosen = {id(a) for a in best}
        self.has_main = bool(chosen)

        def main(place: Place) -> bool:
            return place.article is not None and id(place.article) in chosen and all(h[0] for h in place.maybe)

        def stays(place: Place) -> bool:
            return self._held(place) and (place.article is None or id(place.article) in chosen)

        self.blocks = [b for b in self.blocks if stays(b.place)]
        for b in self.blocks:
            b.main = main(b.place)
        self.events = [
            (token, block, not place.out and main(place))
            for (token, block, _), place in zip(self.events, self._places)
            if block is None or stays(place)
        ]

    @staticmethod
    def _held(place: Place) -> bool:
        return not place.out and all(h[0] for h in place.maybe)

    def _event(self, token: int, block: Block | None, place: Place) -> None:
        self.events.append((token, block, False))
        self._places.append(place)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                path = self._stack[-1][1] if self._stack else ""
                block = Block(text, False, _hash("text", path, text), self._at)
                self.blocks.append(block)
                self._event(block.token, block, self._at)
            self._text = []

    def _say(self, raw: str) -> None:
        place = self._stack[-1][2] if self._stack else Place()
        if raw and not place.out:
            if place.article is not self._at.article or place.maybe != self._at.maybe:
                self._flush()
            if not self._text:
                self._at = place
            self._text.append(_html.unescape(raw) if "&" in raw else raw)

    def _open(self, name: str, attributes: str) -> None:
        names = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []
        words = {w for _, v in names for w in _WORD.findall(v.lower())}
        is_main = name in MAIN or ("role", "main") in names
        inline = name in INLINE
        if not inline:
            self._flush()
        elif name == "br":
            self._say(" ")
        while self._stack and self._stack[-1][0] in ENDS.get(name, ()):
            self._stack.pop()
        _, path, place = self._stack[-1] if self._stack else ("", "", Place())
        whole = [w for _, v in names for w in v.lower().split()]
        framed = name not in ("html", "body")
        listed = framed and not LEFT_OUT_WORDS.isdisjoint(whole)
        out, article, maybe = place.out, place.article, place.maybe
        if is_main and out < 2:  # an article inside or named by a listed word waits for what the rest of the page holds
            if not (article is not None and not article.listed and not out and not listed):
                article = Article(bool(out or listed))
                self._articles.append(article)
            out = 0
            for held in maybe:
                held[0] |= not article.listed
        elif name in LEFT_OUT:
            out = 2
        elif listed and not (article is not None and name in HEADING):
            out = max(out, 1)
        elif framed and name not in LEAF and not inline and any(_names_left_out(w) for w in whole):
            maybe = (*maybe, [False])
        if name == "h1" and not out:
            for held in maybe:
                held[0] = True
            if article is not None:
                article.headed = True
        here = f"{path}/{name}.{'.'.join(sorted(w for w in words if not w.isdigit()))}"  # numbers of articles differ by page
        inner = place if (out, article, maybe) == (place.out, place.article, place.maybe) else Place(out, article, maybe)
        self._event(_hash("tag", here), None, inner)
        if name in VOID or ((inline or name in LEAF) and out == place.out and not is_main):
            return
        self._stack.append((name, here, inner))

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                here = self._stack[i][1]
                del self._stack[i:]
                break
        else:
            here = f"{self._stack[-1][1] if self._stack else ''}/{name}"
        if name not in INLINE:
            self._event(_hash("end", here), None, self._stack[-1][2] if self._stack else Place())

    def _read(self, html: str) -> None:
        at = 0
        for found in iter(lambda: _TOKEN.search(html, at), None):
            self._say(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name, attributes = name.lower(), found[3] or found[6] or ""
            if found[1] or found[4]:
                self._close(name)
                continue
            self._open(name, attributes)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
            elif attributes.endswith("/") and name not in VOID and self._stack and self._stack[-1][0] == name and name in ("svg",):
                self._close(name)
        self._say(html[at:])

    def tokens(self) -> dict[int, tuple[int, int, bool, bool]]:
        """Of each distinct token: occurrences, place of the first, whether a tag, whether the article goes on after it."""
        found: dict[int, tuple[int, int, bool, bool]] = {}
        for at, (token, block, inside) in enumerate(self.events):
            n, first, is_tag, main = found.get(token, (0, at, False, False))
            found[token] = n + 1, first, is_tag or block is None, main or inside
        return found

    def main_text(self, template: Template | None) -> str:
        if not template:
            return "\n".join(b.text for b in self.blocks if b.main or not self.has_main)
        slots = template.slots(self.events)
        if template.has_main and any(s is not None and template.is_main(s) for _, s in slots):
            held = [b for b, s in slots if s is not None and template.is_main(s)]
            own = [b for b in held if b.token not in template.places]
            return "\n".join(b.text for b in own or held)
        if self.has_main:
            held = [b for b in self.blocks if b.main]
            return "\n".join(b.text for b in [b for b in held if b.token not in template.places] or held)
        return "\n".join(b.text for b in self.blocks if b.token not in template.places)


class Template:
    """The ordered valid classes of a host, from rows of token, class and whether a slot after the token is a main one."""

    def __init__(self, rows: np.ndarray):
        self.places: dict[int, tuple[int, int]] = {}  # token: its class, its place in the class
        self._main: dict[tuple[int, int], bool] = {}
        sizes: Counter = Counter()
        for token, kind, main in rows.reshape(-1, 3).tolist():
            self.places[token] = here = kind, sizes[kind]
            self._main[here] = bool(main)
            sizes[kind] += 1
        self._sizes = sizes
        self.has_main = any(self._main.values())

    def __bool__(self) -> bool:
        return bool(self.places)

    def is_main(self, slot: tuple[int, int]) -> bool:
        return self._main[slot]

    def slots(self, events: list[tuple[int, Block | None, bool]]) -> list[tuple[Block, tuple[int, int] | None]]:
        """The slot of every block: the class that is open innermost and its last token before."""
        out, open_ = [], []  # open classes from the outermost, each with the place reached
        for token, block, _ in events:
            here = self.places.get(token)
            if here is not None:
                kind, place = here
                level = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == kind), None)
                if level is not None:  # goes on (or begins anew), and ends the classes inside
                    del open_[level:]
                while open_ and open_[-1][1] == self._sizes[open_[-1][0]] - 1:
                    open_.pop()  # complete: what opens now is beside it, not inside
                open_.append((kind, place))
            if block is not None:
                out.append((block, open_[-1] if open_ else None))
        return out


# ---------------------------------------------------------------- template
def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, token, is_tag, main, at, a, b of every distinct token of every page; a, b: hashes of (page, occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, tags, mains, places, keys = [], [], [], [], [], []
            for host, url, html in zip(*(batch.column(c).to_pylist() for c in ("host", "url", "html"))):
                page, key = Page(html or ""), xxhash.xxh64_intdigest(f"{url}\0{html}")
                for token, (n, first, is_tag, main) in page.tokens().items():
                    hosts.append(host)
                    tokens.append(token)
                    tags.append(is_tag)
                    mains.append(main)
                    places.append(first)
                    keys.append(xxhash.xxh64_intdigest(n.to_bytes(8, "little"), key))
            keys = np.array(keys, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(tags, pa.bool_()),
                 pa.array(mains, pa.bool_()), pa.array(places, pa.int64()),
                 pa.array((keys & np.uint64(0x7FFFFFFF)).astype(np.int64)), pa.array((keys >> np.uint64(33)).astype(np.int64))],
                ["host", "token", "is_tag", "main", "at", "a", "b"],
            )

    rows = pages.select(host_of().alias("host"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "host string, token bigint, is_tag boolean, main boolean, at bigint, a bigint, b bigint")


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template: (token, class, main) of the host's valid classes one after another, each class in its order.

    A token of a template is on a share ``min_share`` of the host's pages, so
    a template is no longer than 1 / min_share pages.
    """
    vectors = (
        page_tokens(pages)
        .groupBy("host", "token")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("is_tag").alias("is_tag"),
            F.max("main").alias("main"), F.sum("at").alias("at"),
        )
        .where(F.col("n") >= min_pages)
    )
    vectors = staged(vectors, "occurrence-vectors")
    sizes = pages.groupBy(host_of().alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    classes = (
        vectors.groupBy("host", "n", "a", "b")
        .agg(F.count(F.lit(1)).alias("size"), F.max("is_tag").alias("has_tag"))
        .where("size > 1 AND has_tag")
        .join(sizes, "host")
        .where(F.col("n") >= F.lit(min_share) * F.col("pages"))
        .select("host", "n", "a", "b")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64("n", "a", "b").alias("kind"), "at", "token", "main")))
    return vectors.join(classes, ["host", "n", "a", "b"]).groupBy("host").agg(
        F.flatten(F.transform(ordered, lambda x: F.array(x["token"], x["kind"], x["main"].cast("bigint")))).alias("template")
    )


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    templates = staged(host_templates(pages, min_pages, min_share), "templates").withColumnRenamed("host", "__cl_host")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of().alias("host"))
    joined = rows.join(templates, F.col("host") == F.col("__cl_host"), "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = [], {}
            for html, template in zip(batch.column("html").to_pylist(), batch.column("template")):
                rows = template.values.to_numpy() if template.is_valid else np.zeros(0, np.int64)
                name = rows.tobytes()
                if name not in known:
                    known[name] = Template(rows)
                texts.append(Page(html or "").main_text(known[name]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
