"""Main text of HTML pages by consensus host paths.

Every page scores its containers by the text they hold outside of boilerplate. The path of the
best one, generalised to tags and classes without digits, is the page's vote; votes are summed
per host in Spark, and each page is read again along its host's winning path. Where a page's own
best container holds more, that is kept as well, but for containers beside the path that most
pages of the host have: those belong to the host's layout.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
TAIL = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

# HTML elements by their part in a page.
RAW = set("script style title textarea noscript iframe template svg math object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("b i u s em strong small big font sub sup mark abbr cite code kbd samp var q tt del ins dfn time bdi bdo strike".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
BOILER_TAGS = set("nav footer aside form menu dialog button select head".split())
CONTAINERS = set("article main section div td body".split())
# Words in a class, id or role that mark what is not the article.
BOILER_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies newsletter subscribe signup share sharing social related recommended popup modal overlay pagination pager skip".split())
HEADER_WORDS = set("header masthead topbar banner site-header page-header".split())
GOOD_WORDS = set("content article post entry story text main body".split())
CLOSES_P = BLOCK - {"body", "html", "head"}
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = set("ul ol dl table article section div body main".split())


#: Bytes of all hosts' winning paths that may be broadcast.
MOST_BROADCAST = 32 << 20


def path_number(above: int, kind: str) -> int:
    """A path by the number of what stands above and its last part: 64 bits, however deep it is."""
    return xxhash.xxh3_64_intdigest(kind, seed=above & (1 << 64) - 1) - (1 << 63)


class Page:
    """Containers and text blocks of one page; block i stands in container owner[i].

    What is held of a container is of one size, and time is linear in a page but for end tags that
    are left out, so neither deep nor long pages cost more than their length.
    """

    def __init__(self, html: str):
        top = path_number(0, "html")
        self.paths, self.parent, self.weight = [top], [-1], [0.1]
        self.blocks: list[str] = []
        self.owner: list[int] = []
        self.links: list[int] = []
        # Open elements: tag, container, whether it is left out, path, whether it is in an article.
        self._stack: list[tuple[str, int, bool, int, bool]] = [("html", 0, False, top, False)]
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        self._linked = 0
        self._read(html)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            if text:
                self.blocks.append(text)
                self.owner.append(self._stack[-1][1])
                self.links.append(min(self._linked, len(text)))
            self._text, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        _, container, skip, path, inside = self._stack[-1]
        names = [a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)] if "=" in attributes else []
        words = {w for n in names for w in re.split(r"[^a-z]+", n.lower()) if w}
        whole = {w for n in names for w in n.lower().split()}
        if tag in CONTAINERS or tag in BLOCK:
            path = path_number(path, tag + "".join("." + re.sub(r"\d+", "#", x) for x in sorted(whole)))
        boiler = tag in BOILER_TAGS or bool(words & BOILER_WORDS and tag not in ("body", "html", "article", "main")) or (not inside and (tag == "header" or bool(whole & HEADER_WORDS and tag not in ("body", "html"))))
        if tag in CONTAINERS:
            bonus = {"article": 1.6, "main": 1.4, "body": 0.8}.get(tag, 1.3 if words & GOOD_WORDS else 1.0)
            self.paths.append(path)
            self.parent.append(container)
            self.weight.append(bonus)
            container = len(self.paths) - 1
        self._stack.append((tag, container, skip or boiler, path, inside or tag in ("article", "main")))
        self._open_tags[tag] += 1

    def _cut(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        for tag, *_ in self._stack[i:]:
            self._open_tags[tag] -= 1
        del self._stack[i:]

    def _close(self, tag: str) -> None:
        if self._open_tags[tag]:
            self._cut(next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i][0] == tag))

    def _imply(self, tag: str) -> None:
        """End tags that HTML lets a page leave out."""
        if tag in CLOSES_P and self._open_tags["p"]:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == "p":
                    self._cut(i)
                    break
                if self._stack[i][0] in BLOCK:
                    break
        if tag in ALIKE and any(self._open_tags[x] for x in ALIKE[tag]):
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in ALIKE[tag]:
                    self._cut(i)
                    break
                if self._stack[i][0] in STOPS:
                    break

    def _read(self, html: str) -> None:
        at, n, low = 0, len(html), None
        while at < n:
            m = TAG.search(html, at)
            text = html[at : m.start()] if m else TAIL.sub("", html[at:])
            if text and not self._stack[-1][2]:
                self._text.append(text)
                if any(s[0] == "a" for s in self._stack[-3:]):
                    self._linked += len(text)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in INLINE:
                continue
            if tag in BLOCK:
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                if not m[3].endswith("/>"):
                    low = low or html.lower() if html.isascii() else low or re.sub("[A-Z]+", lambda x: x[0].lower(), html)
                    end = low.find(f"</{tag}", at)
                    if end < 0:
                        break
                    end = html.find(">", end)
                    at = n if end < 0 else end + 1
            elif tag not in VOID:
                self._imply(tag)
                self._open(tag, m[3])
        self._flush()

    def scores(self) -> list[float]:
        """Text outside links that each container holds, weighted; outer ones count a little less."""
        own = [0.0] * len(self.paths)
        for c, text, link in zip(self.owner, self.blocks, self.links, strict=True):
            own[c] += len(text) - 0.7 * link
        for c in range(len(own) - 1, 0, -1):  # a container comes after the one it stands in
            own[self.parent[c]] += 0.9 * own[c]
        return [o * w for o, w in zip(own, self.weight, strict=True)]

    def best(self) -> tuple[int, float]:
        """The container of the highest score, the first of equals; -1 where there is no text."""
        s = self.scores()
        i = max(range(len(s)), key=lambda k: (s[k], -k))
        return (i, s[i]) if s[i] > 0 else (-1, 0.0)

    def own_paths(self) -> set[int]:
        """Paths of the containers that blocks stand in."""
        return {self.paths[c] for c in self.owner}

    def text(self, path: int | None, usual: list[int] | None = None) -> str:
        """Blocks along the path, and those of the page's own best container unless they stand in a `usual`
        one beside the path: neither in it nor around it.

        Where the path holds little, the own best container keeps all of its blocks.
        """
        i, score = self.best()
        if i < 0:
            return "\n".join(self.blocks)
        if path is None or path == self.paths[i]:
            along = own = self._under(self.paths[i])
            left_out, around = set(), along
        else:
            along, own, left_out = self._under(path), self._under(only=i), set(usual or ())
            if sum(s for s, p in zip(self.scores(), self.paths, strict=True) if p == path) < 0.5 * score:
                left_out = set()
            around = [p == path for p in self.paths]
            for c in range(len(around) - 1, 0, -1):
                around[self.parent[c]] |= around[c]
        return "\n".join(b for b, o in zip(self.blocks, self.owner, strict=True) if along[o] or (own[o] and (around[o] or self.paths[o] not in left_out)))

    def _under(self, path: int | None = None, only: int = -1) -> list[bool]:
        """For each container whether it is, or stands in, one of that path or that number."""
        under = [False] * len(self.paths)
        for k, up in enumerate(self.parent):
            under[k] = self.paths[k] == path or k == only or (up >= 0 and under[up])
        return under


def host(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        keys, sums = list(votes), list(votes.values())
        votes.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array([s[2] for s in sums], pa.int64())], ["host", "path", "votes", "weight", "seen"])

    for batch in batches:
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            i, score = page.best()
            if i >= 0:
                at = host(url)
                held = votes.setdefault((at, page.paths[i]), [0, 0, 0])
                held[0] += 1
                held[1] += int(score)
                for path in page.own_paths():
                    votes.setdefault((at, path), [0, 0, 0])[2] += 1
        if len(votes) > 20_000:
            yield out()
    if votes:
        yield out()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(h or "").text(p, u) for h, p, u in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "usual")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, usual): the path most pages of a host vote for; ties go to more text, then by number.

    usual are the other paths that hold text on more than half of the host's pages; they are fewer
    than twice the containers of a mean page.
    """
    votes = pages.mapInArrow(_vote, "host string, path long, votes long, weight long, seen long")
    summed = materialise(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("weight").alias("weight"), F.sum("seen").alias("seen")), "host-votes")
    won = summed.groupBy("host").agg(F.max(F.struct("votes", "weight", "path")).alias("w"), F.sum("votes").alias("pages")).select("host", F.col("w.path").alias("path"), "pages")
    usual = summed.filter("seen > 1").select("host", F.col("path").alias("other"), "seen").join(won, "host").filter((2 * F.col("seen") > F.col("pages")) & (F.col("path") != F.col("other")))
    return won.select("host", "path").join(usual.groupBy("host").agg(F.sort_array(F.collect_list("other")).alias("usual")), "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row: blocks joined by one newline, white space as one space.

    Null or empty html, or html without text, gives an empty text; a null url votes with the empty
    host. Repeated rows repeat; other columns are ignored. The winning paths, a row per host, are
    written first and broadcast if they take at most MOST_BROADCAST bytes; else Spark deals pages by host.
    """
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    winners = materialise(host_paths(pages.select("url", "html")), "host-paths")
    key = F.lower(F.coalesce(F.regexp_extract("url", HOST.pattern, 1), F.lit("")))
    size = winners.agg(F.sum(64 + F.length("host") + 8 * F.coalesce(F.size("usual"), F.lit(0))).alias("bytes")).first()["bytes"]
    if (size or 0) <= MOST_BROADCAST:
        winners = F.broadcast(winners)
    joined = pages.withColumn("host", key).join(winners, "host", "left").select("page_id", "url", "html", "path", "usual")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
