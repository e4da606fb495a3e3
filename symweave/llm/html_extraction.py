"""HTML extraction: page containers scored, voted on per host as generalised paths, and read by the winning path."""

from __future__ import annotations

import hashlib
import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.common import small_enough, stored, text_batches
from symweave.llm.url_filter import url_host

#: Element names with a special part in HTML.
RAW = "script style noscript template iframe object svg math canvas textarea select title"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
BOILERPLATE = "nav header footer aside menu button dialog head label"
#: Elements that leave an open head open, and those whose text isn't markup, so that they reach the end tag or the page's end.
IN_HEAD = "html head base basefont bgsound link meta title script style noscript noframes template"
PLAIN = "script style title textarea iframe noscript"
#: Words of class, id and role for reader comments, and for other parts beside the article.
REMARKS = "comment comments respond reply replies disqus"
MARKS = "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header footer masthead banner sidebar side aside related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login pagination pager widget toolbar skip legal copyright form search contentinfo complementary"
#: Words that make a class one of layout or state, as in has-sidebar or share-enabled.
STATES = "no not non without with has have is are enabled disabled enable disable open opened closed on off visible hidden active inactive free ready fixed sticky left right top bottom full wide hoc less show hide"
#: Blocks of running text, which only a whole class name can mark.
RUNNING = "p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption address"
_RAW, _VOID, _BLOCK, _BESIDE, _IN_HEAD, _PLAIN, _REMARKS, _MARKS, _STATES, _RUNNING = (frozenset(x.split()) for x in (RAW, VOID, BLOCKS, BOILERPLATE, IN_HEAD, PLAIN, REMARKS, MARKS, STATES, RUNNING))
_CLOSES_P = _BLOCK - {"html", "body", "head"}
_REPEATS = frozenset(("li", "dt", "dd", "tr", "td", "th", "option"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+/\Z")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in _RAW}
#: Characters of a path, from which on it goes on from a digest: pages nested very deep then take no more room than others.
PATH_CHARS = 1000
#: How surely an element stands beside the article: not at all, by a part of a class, by a whole one, for reader comments.
NONE, WEAK, STRONG, REMARK = range(4)


class Element:
    """A block element: the path of names and classes, its parent's place in the list, depth, and what marks it."""

    __slots__ = ("depth", "mark", "name", "parent", "path")

    def __init__(self, name: str, path: str, parent: int, depth: int, mark: int):
        self.name, self.path, self.parent, self.depth, self.mark = name, path, parent, depth, mark


class _Tags:
    """Reads a page from left to right: (text before, name, whether an end tag, attributes); name is "" for what has none.

    Each character is read a bounded number of times, whatever is left open: what was sought in vain isn't sought again.
    """

    def __init__(self, page: str):
        self.page, self.at, self.lacks, self.wasted = page, 0, set(), 0

    def _after(self, mark: str, at: int) -> int:
        """The place after the next mark, or -1 if there is none."""
        found = -1 if mark in self.lacks else self.page.find(mark, at)
        if found < 0:
            self.lacks.add(mark)
            return -1
        return found + len(mark)

    def _tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes hide others, unless one isn't closed."""
        place = at
        while self.wasted <= len(self.page):
            m = _STOP.search(self.page, place)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            place = self._after(m[0], m.end())
            if place < 0:
                break
        end = self._after(">", at) - 1
        self.wasted += max(0, len(self.page) - max(end, at))
        return max(end, -1)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        page, begun = self.page, 0
        while True:
            open_ = page.find("<", self.at)
            if open_ < 0:
                yield page[begun:], "", False, ""
                return
            kind = page[open_ + 1 : open_ + 2]
            closing = kind == "/"
            if page.startswith("<!--", open_):
                end = self._after("-->", open_ + 2)
                name, rest, stop = "", "", end if end > 0 else len(page)
            elif page.startswith("<![CDATA[", open_) and (end := self._after("]]>", open_)) > 0:
                name, rest, stop = "", "", end
            elif kind in ("!", "?") and (end := self._after(">", open_)) > 0:
                name, rest, stop = "", "", end
            else:
                m = None if ">" in self.lacks else _NAME.match(page, open_ + 1 + closing)
                end = self._tag_end(m.end()) if m else -1
                if end < 0:  # a < that begins no tag is text
                    self.at = open_ + 1
                    continue
                name, rest, stop = m[0].lower(), page[m.end() : end], end + 1
            text, self.at, begun = page[begun:open_], stop, stop
            yield text, name, closing, rest
            begun = self.at

    def skip(self, name: str) -> None:
        """To the end tag of an element whose content isn't read; to the page's end if it is plain text without one."""
        m = None if name in self.lacks else _RAW_END[name].search(self.page, self.at)
        if m:
            end = self._after(">", m.end())
            self.at = end if end > 0 else len(self.page)
        else:
            self.lacks.add(name)
            self.at = len(self.page) if name in _PLAIN else self.at


class _Frame:
    """An open block element and the inline ones open in it."""

    __slots__ = ("beside", "counts", "index", "inline", "name")

    def __init__(self, name: str, index: int, beside: bool):
        self.name, self.index, self.beside = name, index, beside
        self.inline: list[tuple[str, bool]] = []
        self.counts: dict[str, int] = defaultdict(int)


def read_page(page: str) -> tuple[list[Element], list[tuple[int, str, int]]]:
    """The block elements that aren't surely beside the article, and text blocks in page order: (place of the innermost
    element or -1, text, characters that are links). A path has the names of an element and those around it, each with
    its sorted classes, digits as #."""
    elements: list[Element] = []
    blocks: list[tuple[int, str, int]] = []
    stack = [_Frame("", -1, False)]
    opened: dict[str, int] = defaultdict(int)
    buffer: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        if buffer:
            text = _SPACE.sub(" ", references.unescape("".join(buffer))).strip()
            if text:
                blocks.append((stack[-1].index, text, min(links, len(text))))
            buffer.clear()
        links = 0

    def close() -> None:
        flush()
        opened[stack.pop().name] -= 1

    def outside() -> bool:
        return stack[-1].inline[-1][1] if stack[-1].inline else stack[-1].beside

    tags = _Tags(page)
    for text, name, closing, rest in tags:
        if stack[-1].name == "head" and not stack[-1].inline and text.strip():
            close()
        if text and not outside():
            buffer.append(text)
            links += len(text) if in_link else 0
        if not name:
            continue
        if closing:
            in_link = in_link and name != "a"
            if name in _BLOCK:
                if opened[name] > 0:
                    while stack[-1].name != name:
                        close()
                    close()
            elif stack[-1].counts[name] > 0:
                while True:
                    gone = stack[-1].inline.pop()[0]
                    stack[-1].counts[gone] -= 1
                    if gone == name:
                        break
            continue
        if stack[-1].name == "head" and name not in _IN_HEAD:  # </head> may be left out
            close()
        if name in _RAW:
            if not (name in ("svg", "math") and rest.endswith("/") and not _UNQUOTED_END.search(rest)):
                tags.skip(name)
            continue
        if name == "br" and not outside():
            buffer.append(" ")
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        in_link = in_link or name == "a"
        if name not in _BLOCK:
            if not rest.rstrip().endswith("/"):
                stack[-1].inline.append((name, outside() or name in _BESIDE or _mark(name, rest) in (STRONG, REMARK, None)))
                stack[-1].counts[name] += 1
            continue
        flush()
        if name in _CLOSES_P and (stack[-1].name == "p" or stack[-1].name == name and name in _REPEATS):
            close()  # an open paragraph ends where a block begins, a list item where the next does
        in_article = opened["article"] > 0 or opened["main"] > 0
        beside = outside() or name in _BESIDE and not (name == "header" and in_article)
        mark = NONE if beside else _mark(name, rest)
        beside = beside or mark is None
        index = -1
        if not beside:
            classes = sorted({_DIGITS.sub("#", c) for c in _attributes(rest).get("class", "").split()}) if "class" in rest.lower() else []
            above = elements[stack[-1].index] if stack[-1].index >= 0 else None
            path = above.path if above else ""
            path = path if len(path) <= PATH_CHARS else f"~{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"
            elements.append(Element(name, f"{path}/{'.'.join([name, *classes])}", stack[-1].index, above.depth + 1 if above else 1, mark))
            index = len(elements) - 1
        stack.append(_Frame(name, index, beside))
        opened[name] += 1
    while len(stack) > 1:
        close()
    flush()
    return elements, blocks


def _attributes(text: str) -> dict[str, str]:
    return {a[0].lower(): references.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(text)}


def _mark(name: str, attributes: str) -> int | None:
    """What class, id and role say of an element: NONE, WEAK, STRONG or REMARK; None for a hidden one."""
    if name == "form":
        return STRONG
    if not attributes.strip() or name in ("html", "body"):
        return NONE
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return None
    most = NONE
    for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split():
        words = _WORD.findall(token)
        if not words or not _STATES.isdisjoint(words):
            continue
        if not _REMARKS.isdisjoint(words):
            return REMARK
        if token in _MARKS or all(w in _MARKS for w in words):
            most = STRONG
        elif (words[0] in _MARKS or words[-1] in _MARKS) and name not in _RUNNING and name in _BLOCK:
            most = max(most, WEAK)
    return NONE if name in ("article", "main") else most


class Page:
    """A page that was read, with what each element holds."""

    def __init__(self, page: str):
        self.elements, self.blocks = read_page(page)
        n = len(self.elements)
        self.chars, self.count, self.core = [0] * n, [0] * n, [e.name in ("article", "main") for e in self.elements]
        for at, text, _ in self.blocks:
            if at >= 0:
                self.chars[at] += len(text)
                self.count[at] += 1
        for i in range(n - 1, -1, -1):  # parents come before their children
            up = self.elements[i].parent
            if up >= 0 and self.elements[i].mark != REMARK:
                self.chars[up] += self.chars[i]
                self.count[up] += self.count[i]
                self.core[up] = self.core[up] or self.core[i]
        self.whole = sum(c for c, e in zip(self.chars, self.elements) if e.parent < 0) + sum(len(t) for at, t, _ in self.blocks if at < 0)

    def drop_votes(self) -> dict[str, float]:
        """Of each path with a mark, whether this page would drop it: 1, or -1 for a wrapper of the article.

        A wrapper holds half of the page's text, and an article or several blocks; by a part of a class name alone (WEAK)
        what holds two fifths is one too.
        """
        votes: dict[str, float] = defaultdict(float)
        for i, e in enumerate(self.elements):
            if e.mark != NONE:
                wraps = e.mark != REMARK and (2 * self.chars[i] >= self.whole and (self.core[i] or self.count[i] >= 3) or e.mark == WEAK and 5 * self.chars[i] >= 2 * self.whole)
                votes[e.path] += -1.0 if wraps else 1.0
        return votes

    def kept(self, host: dict[str, float]) -> list[bool]:
        """Whether each element is outside all dropped ones: by the host's votes for a path, else the page's own."""
        own, out = self.drop_votes(), []
        for i, e in enumerate(self.elements):
            dropped = e.mark != NONE and (host.get(e.path) or own[e.path]) > 0
            out.append((e.parent < 0 or out[e.parent]) and not dropped)
        return out

    def scores(self, kept: list[bool]) -> dict[str, float]:
        """The score of each container path: its share of the best, links counting against it, more for article and main,
        less for running text, and a little more for depth."""
        worth = [0.0] * len(self.elements)
        for at, text, links in self.blocks:
            if at >= 0 and kept[at]:
                worth[at] += max(0.0, len(text) - 2.0 * links)
        good: dict[str, float] = defaultdict(float)
        form: dict[str, Element] = {}
        for i in range(len(self.elements) - 1, -1, -1):
            e = self.elements[i]
            if e.parent >= 0:
                worth[e.parent] += worth[i]
            good[e.path] += worth[i]
            form[e.path] = e
        whole = max(good.values(), default=0.0)
        if not whole:
            return {}
        bonus = {"article": 1.5, "main": 1.3, "p": 0.5, "li": 0.5, "td": 0.5, "tr": 0.5}
        return {p: g / whole * bonus.get(form[p].name, 1.0) + 0.001 * min(form[p].depth, 50) for p, g in good.items() if g > 0}

    def text(self, path: str | None, host: dict[str, float]) -> str:
        """The kept blocks inside elements of that path, joined by one space; of the page's own best container where that
        path has no text, of the whole page where it has no container."""
        kept = self.kept(host)

        def inside(wanted: str) -> str:
            within: list[bool] = []
            for e in self.elements:
                within.append(e.path == wanted or e.parent >= 0 and within[e.parent])
            return " ".join(t for at, t, _ in self.blocks if at >= 0 and within[at] and kept[at])

        text = inside(path) if path is not None else ""
        if not text:
            own = self.scores(kept)
            best = min(own, key=lambda p: (-own[p], p), default=None)
            text = inside(best) if best is not None else " ".join(t for at, t, _ in self.blocks if at < 0 or kept[at])
        return text


def text_in(page: str, path: str | None = None, host: dict[str, float] | None = None) -> str:
    """The main text of a page by the path that its host chose and the host's votes on marked paths, or by itself."""
    return Page(page).text(path, host or {})


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str, bool], float] = defaultdict(float)
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            read = Page(page or "")
            for path, score in read.scores(read.kept({})).items():
                votes[host, path, False] += score
            for path, vote in read.drop_votes().items():
                votes[host, path, True] += vote
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array([k[2] for k in votes], pa.bool_()), pa.array(list(votes.values()), pa.float64())], ["host", "path", "beside", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, path, beside in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), batch.column("beside").to_pylist(), strict=True):
            texts.append(text_in(page or "", path, {x["path"]: x["score"] for x in beside or []}))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, beside: of each host, the container path with the most votes of its pages, ties to the first by name,
    and the votes on its marked paths (array of path, score; above 0: drop).

    Votes are summed within each batch and again before the shuffle, so a host with very many pages sends few rows.
    """
    votes = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, beside boolean, score double")
    summed = votes.groupBy("host", "path", "beside").agg(F.round(F.sum("score"), 6).alias("score"))
    best = F.min(F.when(~F.col("beside"), F.struct((-F.col("score")).alias("score"), "path")))
    marked = F.collect_list(F.when(F.col("beside"), F.struct("path", "score")))
    return summed.groupBy("host").agg(best.alias("best"), marked.alias("beside")).select("host", F.col("best.path").alias("path"), "beside")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of each page: page_id, url, text.

    Text is that of the blocks inside the host's winning container, without the elements named in BOILERPLATE and those
    that class, id or role mark: reader comments always, others where the pages of the host hold them to be no wrapper of
    the article. Every container of every page votes, with its share of the text. A page whose winning container has no
    text is read by its own best one. Character references are decoded, white space in a block is one space, blocks are
    joined by one.

    Null and empty html give an empty text, as do pages without any. Pages with a null or malformed url vote together as
    host "". Ties go to the first path by name. Very long or broken pages are read in a time that grows with their length.
    Repeated rows each give a row; an empty table gives none; other columns of pages, whatever their names, have no part.
    """
    text_batches(pages.sparkSession)
    winners = small_enough(stored(host_paths(pages)), 200_000)
    found = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host")).join(winners, "host", "left")
    return found.select("page_id", "url", "html", "path", "beside").mapInArrow(_extract, "page_id bigint, url string, text string")
