"""HTML extraction by consensus host paths.

Every page scores its own containers and votes for the generalised tag-class
path of the best one; the votes of a host are counted in Spark; each page is
then extracted again along the winning path of its host.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, short_batches, small_or_shuffled

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|</?\Z",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
SKIP = frozenset("nav header footer aside form button select option datalist fieldset input script style template svg math canvas object audio video map dialog menu head noscript iframe".split())
CONTAINERS = frozenset("html body article main section div td center details".split())
#: Words of a class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline captcha comment comments commentlist complementary consent contentinfo "
    "cookie cookies dialog discussion disqus footer form gdpr header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain overlay "
    "paging pager pagination paywall popup print promo promotion promoted recommendations recommended related replies reply search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription taboola toolbar tooltip tracking warning widget widgets".split()
)
#: Of these, words that the article itself may also bear: they count only where they
#: mark the smaller part of the page.
DOUBTFUL = frozenset(
    "advertorial banner byline captcha complementary consent dialog discussion form header login newsletter notice notification overlay paging paywall popup print promo "
    "promotion recommendations search share sharing skip social subscribe subscription toolbar tooltip tracking warning widget widgets modal".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A class such as "with-sidebar" tells of a neighbour.
NEIGHBOUR = frozenset("with has no without".split())
BONUS = {"article": 1.5, "main": 1.3}
#: What may be voted for.
BOXES = CONTAINERS | {"table"}
SENTENCE = tuple(".!?:;…。！？\"'»”’)")
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these kinds, up to the scope beside them.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",)),
}
MASK = (1 << 64) - 1


def step(path_hash: int, segment: str) -> int:
    return (path_hash * 0x9E3779B97F4A7C15 + zlib.crc32(segment.encode("utf-8", "replace")) + 1) & MASK


def path_hash(path: str) -> int:
    h = 0
    for segment in path.split(">"):
        h = step(h, segment)
    return h


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTR.findall(raw)}


def _unwanted(attrs: dict[str, str]) -> int:
    """2: not of the article, 1: only if it is the smaller part of the page, 0: may be the article."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return 2
    found = 0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split():
        words = set(WORDS.findall(CAMEL.sub("-", name).lower()))
        if words & BOILERPLATE and not words & NEIGHBOUR:
            found = max(found, 1 if words & BOILERPLATE <= DOUBTFUL else 2)
    return found


class Page:
    """Elements, blocks of text and container scores of one page.

    Of each element: its parent, tag, segment of the generalised path, hash
    of the whole path, and whether it lies in what is skipped. Inline markup
    makes no element. Block text has its character references decoded and
    white space runs turned into one space.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.segment, self.hash, self.skip = [-1], ["html"], ["html"], [step(0, "html")], [False]
        self.blocks: list[tuple[int, str, int]] = []
        #: What is decided once the whole page is read: 1 for doubtful elements, 2 for the header of an article.
        self.later: dict[int, int] = {}
        self._scan(html)
        if self.later:
            self._decide()

    def _decide(self) -> None:
        """Drop doubtful elements that hold half of the text at most, and all but headings of an article's header."""
        chars = [0] * len(self.tag)
        for node, _, own in self.blocks:
            chars[node] += own
        for i in range(len(chars) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        out, heading = [False] * len(self.tag), [False] * len(self.tag)
        header = list(out)
        for i in range(1, len(self.tag)):
            up, kind = self.parent[i], self.later.get(i)
            heading[i] = heading[up] or self.tag[i] in HEADINGS
            header[i] = header[up] or kind == 2
            out[i] = out[up] or kind == 1 and 2 * chars[i] <= chars[0]
        self.blocks = [b for b in self.blocks if not out[b[0]] and (not header[b[0]] or heading[b[0]])]

    def _scan(self, html: str) -> None:
        stack, parts, links, in_link = [0], [], 0, False
        tag_of, skip_of = self.tag, self.skip
        open_tags: dict[str, int] = {"html": 1}

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((stack[-1], text, max(0, len(text) - links)))
                parts.clear()
            links = 0

        def pop_to(i: int) -> None:
            for n in stack[i:]:
                open_tags[tag_of[n]] -= 1
            del stack[i:]

        def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
            if not any(open_tags.get(n) for n in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                t = tag_of[stack[i]]
                if t in scope:
                    return
                if t in names:
                    pop_to(i)
                    return

        pos, end = 0, len(html)
        while pos < end:
            m = TOKEN.search(html, pos)
            if m is None:
                if not skip_of[stack[-1]]:
                    parts.append(html[pos:])
                break
            if m.start() > pos and not skip_of[stack[-1]]:
                text = html[pos : m.start()]
                parts.append(text)
                if in_link:
                    links += len(text)
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, raw = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if name == "a":
                    in_link = False
                if name == "br":
                    parts.append(" ")
                elif name == "p" or open_tags.get(name):
                    if name in ("html", "body"):
                        continue
                    flush()
                    if open_tags.get(name):
                        for i in range(len(stack) - 1, 0, -1):
                            if tag_of[stack[i]] == name:
                                pop_to(i)
                                break
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in RAW:
                raw_end = RAW[name].search(html, pos)
                pos = raw_end.end() if raw_end else end
                continue
            attrs = _attrs(raw) if raw and "=" in raw or "hidden" in raw else {}
            unwanted = _unwanted(attrs) if attrs else 0
            if name in INLINE and not unwanted:
                in_link = in_link or name == "a"
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                    if open_tags.get("p"):
                        close(("p",), ())
                continue
            if name not in INLINE:
                flush()
                in_link = False
                if name in ENDS_P and open_tags.get("p"):
                    close(("p",), ("td", "th", "div", "article", "section", "li", "main", "body"))
                if name in IMPLIED:
                    close(*IMPLIED[name])
            elif parts and not skip_of[stack[-1]]:
                flush()
            if name == "html":
                continue
            if raw.endswith("/") and name not in CONTAINERS and name not in ENDS_P:
                continue
            up = stack[-1]
            classes = attrs.get("class", "")
            segment = name + "".join("." + c for c in sorted(set(re.sub(r"\d+", "#", classes).replace(">", "").split()))) if classes else name
            n = len(tag_of)
            self.parent.append(up)
            tag_of.append(name)
            self.segment.append(segment)
            self.hash.append(step(self.hash[up], segment))
            inner = name == "header" and bool(open_tags.get("article") or open_tags.get("main"))
            if name == "body":
                unwanted = 0
            if inner or unwanted == 1:
                self.later[n] = 2 if inner else 1
            skip_of.append(skip_of[up] or unwanted == 2 or name in SKIP and not inner)
            stack.append(n)
            open_tags[name] = open_tags.get(name, 0) + 1
        flush()

    def best(self) -> tuple[int, float]:
        """The outermost container that adds wanted text to what its heaviest part holds, and its characters outside links.

        From the root down, an element is left for its heaviest child if the
        rest is empty or mostly links. The body is the whole page: it is also
        left if the rest is only short scraps in containers of their own, or
        lies outside the page's one article or main part.
        """
        n = len(self.tag)
        own, links, prose = [0] * n, [0] * n, [False] * n
        for node, text, chars in self.blocks:
            own[node] += chars
            links[node] += len(text) - chars
            prose[node] = prose[node] or self.tag[node] == "h1" or 2 * chars > len(text) and (len(text) >= 80 or " " in text and text.endswith(SENTENCE))
        alone = list(own)
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if own[i] or links[i]:
                up = self.parent[i]
                own[up] += own[i]
                links[up] += links[i]
                prose[up] = prose[up] or prose[i]
                kids[up].append(i)
        self.prose = prose
        inside, tops, weight = [False] * n, [], 0.0
        for i in range(n):
            above = i > 0 and inside[self.parent[i]]
            inside[i] = above or self.tag[i] in BONUS
            if inside[i] and not above and own[i]:
                tops.append(i)
                weight += own[i] * BONUS[self.tag[i]]
        marked = weight > own[0] - sum(own[i] for i in tops)
        holds = [0] * n
        for i in tops:
            while i >= 0:
                holds[i] += 1
                i = self.parent[i]
        at = 0
        while kids[at]:
            # kids are in reverse order: the first of equals
            heaviest = max(reversed(kids[at]), key=own.__getitem__)
            page = self.tag[at] in ("html", "body")
            if page and marked and tops:
                heaviest = next((k for k in kids[at] if holds[k] == len(tops)), heaviest)
            rest = [k for k in kids[at] if k != heaviest and own[k] and own[k] >= links[k]]
            if page:
                bounded = bool(tops) and marked and holds[heaviest] == len(tops)
                rest = [k for k in rest if self.tag[k] not in BOXES or prose[k] and not bounded]
            if alone[at] or rest or not own[heaviest]:
                break
            at = heaviest
        while self.tag[at] not in BOXES:
            at = self.parent[at]
        return at, float(own[at])

    def path(self, node: int) -> str:
        found = []
        while node >= 0:
            found.append(self.segment[node])
            node = self.parent[node]
        return ">".join(reversed(found))

    def under(self, wanted: Callable[[int], bool]) -> set[int]:
        """Numbers of the blocks under the elements that are ``wanted``."""
        inside: list[bool] = []
        for i, up in enumerate(self.parent):
            inside.append(wanted(i) or up >= 0 and inside[up])
        return {k for k, (node, _, _) in enumerate(self.blocks) if inside[node]}

    def text(self, blocks: set[int]) -> str:
        """These blocks in page order."""
        return "\n".join(t for k, (_, t, _) in enumerate(self.blocks) if k in blocks)


def vote(html: str) -> tuple[str, float]:
    page = Page(html)
    node, score = page.best()
    return page.path(node), score


def extract_text(html: str, host_path: str | None) -> str:
    """Main text along the host's path, together with the page's own best.

    Where the two overlap, the path of the host may be the narrower one, so
    both are kept. Where they are apart, the part along the host's path is
    kept if it holds more than short scraps.
    """
    page = Page(html)
    best = page.best()[0]
    own = page.under(lambda i: i == best)
    if host_path:
        wanted = path_hash(host_path)
        host = page.under(lambda i: page.hash[i] == wanted)
        if host & own or any(page.prose[i] for i, h in enumerate(page.hash) if h == wanted):
            own |= host
    return page.text(own)


HOST = r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Edge cases: null or empty html gives the empty text; a null url belongs
    to the host ''; repeated rows get a row each; broken or cut-off markup is
    read as far as it goes; an empty table gives an empty result.

    Both passes run over the scan without shuffling pages. Votes are counted
    with map-side combine, so a host with a third of all pages is a few rows
    per task. The winners (one thin row per host) are broadcast only if their
    count is within bounds, and joined by a shuffle otherwise.
    """
    short_batches(pages.sparkSession, 500)
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = d.withColumn("host", F.coalesce(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], list[float]] = {}
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path, score = vote(html)
                if score > 0:
                    at = count.setdefault((host, path), [0, 0.0])
                    at[0] += 1
                    at[1] += score
            if len(count) > 50_000:
                yield rows(count)
                count = {}
        if count:
            yield rows(count)

    def rows(count: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in count]), pa.array([k[1] for k in count]), pa.array([int(v[0]) for v in count.values()], pa.int64()), pa.array([v[1] for v in count.values()], pa.float64())], names=["host", "path", "n", "score"])

    cast = d.select("host", "html").mapInArrow(votes, "host string, path string, n long, score double")
    cast = cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    # of the paths of a host, the one with most votes; max keeps one row per host and task
    winners = cast.groupBy("host").agg(F.max_by("path", F.struct("n", F.round("score"), "path")).alias("host_path"))
    winners = materialize(winners, "host-paths").withColumnRenamed("host", "host2")
    joined = d.join(small_or_shuffled(winners), F.col("host") == F.col("host2"), "left").select("page_id", "url", "html", "host_path")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract_text(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = d.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")
