"""HTML extraction: consensus host paths.

1. Each page's containers are scored by the running text they hold directly. The page votes for the generalised
   tag-class paths (digits dropped) of its containers, in shares of the path's score; all containers on a path count.
2. Spark sums the votes by host and path; the path with most votes wins its host.
3. Each page is extracted again from the containers on its host's winning path, widened by `widened` to what belongs to
   the same article: its title, lead and sibling sections. Where they hold less than half of the page's running text,
   the page's own best path is added; a page without them uses that path alone.

Only the text of the container without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments is returned: block by block in page order, white space inside a block as one space. A class or id that is a
chrome word counts as chrome; one that has it as a part (site-header), and a form, only on elements with a small share
of the running text; where nothing else holds running text, names do not count.

Defined cases: null or empty html gives an empty text; text outside any element counts as the body's; a null or
unusable url counts as one host without a name; unclosed elements end with their parent; repeated rows repeat.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Bytes of hosts and paths up to which they are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article main section div td body".split())
_CHROME_TAGS = frozenset("nav header footer aside form button select menu dialog head".split()) | _RAW
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments "
    "respond disqus share sharing social related recommended newsletter subscribe signup login popup modal pagination pager "
    "toolbar widget skip".split()
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
#: Classes that begin with these say what the page has or is about, not what the element is: no-sidebar, tag-cookies.
_MODIFIERS = frozenset("has no not with without is category tag type format status".split())
#: Words for what readers, advertisers and other pages add. Other chrome words also describe how a whole page is laid out.
_ADDED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond disqus share sharing "
    "social related recommended newsletter subscribe signup login".split()
)
#: Kinds of chrome: LAYOUT and ADDED by a part of a class, whatever its size, but not around the page's own text (LAYOUT: its
#: heading, article, main or an element named as text; ADDED: its heading); NAMED by a whole class, SURE by tag, role or hidden.
LAYOUT, ADDED, NAMED, SURE = 1, 2, 3, 4
_TITLES = frozenset("h1 h2".split())
_TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
_GOOD_WORDS = frozenset("article content post entry story main body text".split())
#: Elements that an opening tag ends: p by any block, list items and table cells by their like.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl div article section main body html blockquote".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
#: Elements in elements, beyond which tags open nothing more and their text is that of the element around.
DEPTH = 512
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_WORD = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")


class Tags:
    """Tags of a page from left to right, in time linear in its length.

    As in the HTML standard, quotes count only where a value begins; a quote that is never closed does not count, and where
    the page ends inside a tag, tags from there on end with the next sign.
    """

    def __init__(self, source: str):
        self.source, self.last, self.plain = source, {c: source.rfind(c) for c in "\"'>"}, False

    def rest(self, at: int) -> tuple[list[tuple[str, str]], bool, int] | None:
        """Attributes, whether the tag closes itself, and its end, from behind its name; None where the page ends first."""
        source, out = self.source, []
        while True:
            at = _GAP.match(source, at).end()
            if at > self.last[">"]:
                return None
            if source[at] == ">":
                return out, source[at - 1] == "/", at + 1
            name = _ATTRIBUTE.match(source, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(source, at)
            if equals:
                at = equals.end()
                quote = source[at : at + 1]
                if quote in ("'", '"') and at < self.last[quote]:
                    end = source.find(quote, at + 1)
                    value, at = source[at + 1 : end], end + 1
                else:
                    found = _UNQUOTED.match(source, at)
                    value, at = found[0], found.end()
            out.append((name[0].lower(), value))

    def tag(self, mark: int) -> tuple[str, str, list[tuple[str, str]], bool, int] | None:
        """(kind, text or name, attributes, closes itself, end) at a sign, kind being text, skip, open or end; None: no tag."""
        source = self.source
        if source.startswith("<!--", mark):
            end = source.find("-->", mark + 2)
            return "skip", "", [], False, end + 3 if end >= 0 else len(source)
        if source.startswith("<![CDATA[", mark):
            end = source.find("]]>", mark)
            return "text", source[mark + 9 : end if end >= 0 else len(source)], [], False, end + 3 if end >= 0 else len(source)
        if mark >= self.last[">"]:
            return None
        if source[mark + 1] in "!?":
            return "skip", "", [], False, source.find(">", mark) + 1
        closing = source[mark + 1] == "/"
        name = _NAME.match(source, mark + 1 + closing)
        if name is None:
            return None
        rest = None if self.plain else self.rest(name.end())
        if rest is None:
            self.plain = True
            rest = [], False, source.find(">", name.end()) + 1
        return "end" if closing else "open", name[0].lower(), *rest


def _named_kind(tag: str, names: list[str]) -> int:
    """Whether classes and id name chrome: as a whole, or in a part. On an element that is also named as text, parts do not count."""
    kind, good = 0, not _GOOD_WORDS.isdisjoint(names)
    for name in names:
        words = _WORD.findall(name)
        if not words or words[0] in _MODIFIERS and len(words) > 1:
            continue
        if not _CHROME_WORDS.isdisjoint(words) and not ("header" in words and not _GOOD_WORDS.isdisjoint(words)):
            part = LAYOUT if _ADDED_WORDS.isdisjoint(words) else ADDED
            kind = max(kind, part if len(words) > 1 and not good else 0 if len(words) > 1 else NAMED)
    if kind == NAMED and (tag in ("article", "main") or good):
        return LAYOUT if _ADDED_WORDS.isdisjoint(names) else ADDED
    return kind


class Page:
    """Elements (parent, label, whether chrome) and text blocks (element, text, link characters) of one page.

    What is chrome is decided once the whole page was read, so text is kept with its element until then.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.label, self.kind, self.good = [-1], ["body"], ["body"], [0], [False]
        self.chrome: list[bool] = []
        self.blocks: list[tuple[int, str, int]] = []
        self._parts: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self._stack, self._text, self._link_depth = [0], [], 0
        self._read(source)
        self._judge()

    def _flush(self) -> None:
        if self._text:
            self._parts.append((self._stack[-1], self._text))
            self._text = []

    def _add(self, raw: str) -> None:
        if raw:
            self._text.append((self._stack[-1], entities.unescape(raw) if "&" in raw else raw, self._link_depth > 0))

    def _judge(self) -> None:
        """Sets chrome and blocks; where only elements named as chrome hold running text, names do not count."""
        self._keep(self._chrome())
        if any(0 < k < SURE for k in self.kind) and not any(len(text) > 2 * links for _, text, links in self.blocks):
            named = self.blocks, self.chrome
            self._keep(self._flags([k == SURE for k in self.kind]))
            if not any(len(text) > 2 * links for _, text, links in self.blocks):
                self.blocks, self.chrome = named

    def _flags(self, own: list[bool]) -> list[bool]:
        """Own flags, and those of the elements around."""
        for at in range(1, len(own)):
            own[at] = own[at] or (own[self.parent[at]] and self.tag[at] not in ("html", "body"))
        return own

    def _chrome(self) -> list[bool]:
        """Elements that are chrome, from the innermost out: what is chrome itself does not tell what is around it."""
        n = len(self.kind)
        own, title, heading, text = [False] * n, [False] * n, [False] * n, [False] * n
        for at in range(n - 1, 0, -1):
            tag, kind = self.tag[at], self.kind[at]
            title[at] |= tag == "h1"
            heading[at] |= tag in _TITLES
            text[at] |= not kind and (self.good[at] or tag in ("article", "main"))
            around = title[at] or (kind == LAYOUT and (text[at] or tag == "header" and heading[at]))
            own[at] = kind >= NAMED or (kind > 0 and not around)
            if not own[at]:
                up = self.parent[at]
                title[up], heading[up], text[up] = title[up] or title[at], heading[up] or heading[at], text[up] or text[at]
        return self._flags(own)

    def _keep(self, chrome: list[bool]) -> None:
        self.chrome, self.blocks = chrome, []
        for at, pieces in self._parts:
            kept = [(text, link) for piece, text, link in pieces if not chrome[piece]]
            if kept and (text := " ".join("".join(t for t, _ in kept).split())):
                self.blocks.append((at, text, sum(len(t) for t, link in kept if link)))

    def _close(self, depth: int) -> None:
        """Ends the elements above `depth` of the stack."""
        for at in self._stack[depth:]:
            self._link_depth -= self.tag[at] == "a"
        if any(self.tag[at] in _BLOCK for at in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _open(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        if self.tag[self._stack[-1]] == "head":  # its end may be left out
            self._close(len(self._stack) - 1)
        if tag in _BLOCK:
            for depth in range(len(self._stack) - 1, 0, -1):
                now = self.tag[self._stack[depth]]
                if now == "p" or tag in _ENDED_BY.get(now, ()):
                    self._close(depth)
                    break
                if now in _SCOPE:
                    break
            self._flush()
        names, role, hidden = [], "", False
        for key, value in attributes:
            value = value.lower()
            if key in ("class", "id"):
                names += value.split() if key == "class" else [value]
            elif key == "role":
                role = value
            elif key == "hidden" or (key == "style" and _NO_DISPLAY.search(value)):
                hidden = True
        words = {w for n in names for w in _WORD.findall(n)}
        up, kind = self._stack[-1], 0
        if tag not in ("html", "body"):
            kind = _named_kind(tag, names) if names else 0
            if tag == "form" or role == "form":  # some sites wrap the whole page in one
                kind = max(kind, LAYOUT)
            elif tag == "header" and any(self.tag[at] in ("article", "main") for at in self._stack):  # holds the article's heading, or is chrome
                kind = max(kind, LAYOUT)
            elif tag in _CHROME_TAGS or role in _CHROME_ROLES:
                kind = SURE
            kind = SURE if hidden else kind
        label = tag + "".join(f".{n}" for n in sorted({re.sub(r"\d+", "", n) for n in names}) if n)
        self.parent.append(up)
        self.tag.append(tag)
        self.label.append(label)
        self.kind.append(kind)
        self.good.append(bool(words & _GOOD_WORDS))
        self._stack.append(len(self.tag) - 1)
        self._link_depth += tag == "a"

    def _read(self, source: str) -> None:
        at, tags = 0, Tags(source)
        while (mark := source.find("<", at)) >= 0:
            found = tags.tag(mark)
            if found is None:  # a lone sign is text
                self._add(source[at : mark + 1])
                at = mark + 1
                continue
            if mark > at:
                self._add(source[at:mark])
            kind, tag, attributes, itself, at = found
            if kind == "text":
                self._add(tag)
            elif kind == "end":
                for depth in range(len(self._stack) - 1, 0, -1):
                    if self.tag[self._stack[depth]] == tag:
                        if tag not in ("html", "body"):  # what follows them is still the page's
                            self._close(depth)
                        break
                    if self.tag[self._stack[depth]] in _SCOPE and tag not in _SCOPE:
                        break
            elif kind == "skip":
                continue
            elif tag in _VOID:
                if tag == "hr":
                    self._flush()
                elif tag in ("br", "wbr", "img"):
                    self._add(" " if tag != "wbr" else "")
            elif tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                close = source.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(source)
            elif len(self._stack) >= DEPTH:
                if tag in _BLOCK:
                    self._flush()
            else:
                self._open(tag, attributes)
                if itself and tag not in _BLOCK:
                    self._close(len(self._stack) - 1)
        self._add(source[at:])
        self._flush()

    def path(self, at: int) -> str:
        out = []
        while at > 0:
            out.append(self.label[at])
            at = self.parent[at]
        return ">".join(reversed(out)) or "body"

    def scores(self) -> dict[int, float]:
        """Running text that containers hold: in full for the nearest one, halved for each one further out."""
        out: dict[int, float] = defaultdict(float)
        for at, text, links in self.blocks:
            worth = max(0, len(text) - 2 * links) * (1.0 if self.tag[at] in ("p", "pre", "blockquote", "h1", "h2", "h3") else 0.5)
            while at >= 0 and worth >= 1:
                if self.tag[at] in _CONTAINER:
                    out[at] += worth * (2.0 if self.tag[at] in ("article", "main") else 1.3 if self.good[at] else 1.0)
                    worth /= 2
                at = self.parent[at]
        return {k: v for k, v in out.items() if v > 0}

    def path_scores(self) -> list[tuple[str, float, set[int]]]:
        """Paths with the summed score of all their containers and these, best first."""
        at_path: dict[str, set[int]] = defaultdict(set)
        scores = self.scores()
        for at in scores:
            at_path[self.path(at)].add(at)
        rows = [(path, sum(scores[at] for at in sorted(on)), on) for path, on in at_path.items()]
        return sorted(rows, key=lambda x: (-x[1], min(x[2])))

    def inside(self, roots: set[int]) -> list[int]:
        """Numbers of the blocks within any root."""
        known = {-1: False} | {r: True for r in roots}
        out = []
        for k, (at, _, _) in enumerate(self.blocks):
            trail = []
            while at not in known:
                trail.append(at)
                at = self.parent[at]
            for t in trail:
                known[t] = known[at]
            if known[at]:
                out.append(k)
        return out

    def running(self, blocks: list[int]) -> int:
        return sum(max(0, len(self.blocks[k][1]) - 2 * self.blocks[k][2]) for k in blocks)

    def _home(self, at: int, kinds: frozenset[str]) -> int:
        """The element itself or the nearest around it of these kinds."""
        while at > 0 and self.tag[at] not in kinds:
            at = self.parent[at]
        return at

    def widened(self, roots: set[int]) -> set[int]:
        """Roots of one path, or containers around them that add to the same article.

        A container adds if it holds headings or paragraphs itself, is an article, main or named as text, or if it adds
        sections to sections; the first that adds something else ends the search. An article is widened only by a
        heading that its container holds itself, and the body only where it holds headings and paragraphs alone.
        """
        inner = self.inside(roots)
        up = roots
        while True:
            up = {self._home(self.parent[at], _CONTAINER) for at in up if self.parent[at] >= 0}
            if not up:
                return roots
            every = self.inside(up)
            own = set(inner)
            added = [k for k in every if k not in own]
            if self.running(added):
                homes = {k: self._home(self.blocks[k][0], _BLOCK) for k in added if self.running([k])}
                texts = [at for at in homes.values() if self.tag[at] in _TEXTS]
                direct = [at for at in texts if self._home(at, _CONTAINER) in up]
                if any(self.tag[at] == "article" for at in roots):
                    good = any(self.tag[at] in _TITLES for at in direct)
                else:
                    good = bool(direct) or any(self.good[at] or self.tag[at] in ("article", "main") for at in up)
                    good = good or (all(self.tag[at] == "section" for at in roots) and any(self.tag[self._home(at, _CONTAINER)] == "section" for at in texts))
                if any(self.tag[at] == "body" for at in up):
                    good = good and len(direct) == len(homes)
                if not good:
                    return roots
                roots, inner = up, every


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def votes(source: str | None) -> list[tuple[str, float]]:
    rows = Page(source or "").path_scores()
    total = sum(v for _, v, _ in rows)
    return [(path, v / total) for path, v, _ in rows]


def main_text(source: str | None, path: str | None) -> str:
    """Text of the containers on the path and what belongs to them, or else of the page's best path."""
    page = Page(source or "")
    every, found = range(len(page.blocks)), []
    if path:
        last = path.rsplit(">", 1)[-1]
        on = {at for at, label in enumerate(page.label) if label == last and not page.chrome[at] and page.path(at) == path}
        found = page.inside(page.widened(on)) if on and page.inside(on) else []
    if not found or 2 * page.running(found) < page.running(every):
        best = page.path_scores()
        own = page.inside(page.widened(best[0][2])) if best else [] if found else every
        found = sorted({*found, *own})
    return "\n\n".join(page.blocks[k][1] for k in found)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for url, source in zip(batch.column("url"), batch.column("html")):
            for path, share in votes(source.as_py()):
                sums[host_of(url.as_py()), path] += share
        hosts, paths = ([k[i] for k in sums] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(source.as_py(), path.as_py()) for source, path in zip(batch.column("html"), batch.column("path"))]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars", "host_path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path."""
    cast = pages.select("url", "html").mapInArrow(_votes, "host string, path string, votes double")
    sums = cast.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and host_path of every page."""
    winners = written(host_paths(pages), "host_paths")
    own = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", _HOST.pattern, 1)), F.lit("")).alias("host"))
    # paths have no fixed length: hosts are broadcast by the bytes of theirs
    size = winners.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.length("path")).alias("bytes")).first()
    winners = F.broadcast(winners) if 100 * size.n + 2 * (size["bytes"] or 0) <= BROADCAST_BYTES else winners
    own = own.join(winners, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path")
    return own.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, host_path string")
