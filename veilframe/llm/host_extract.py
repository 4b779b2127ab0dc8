"""HTML extraction by consensus of a host's pages.

1. Each page is parsed into blocks of text, each under a chain of elements. Containers are scored:
   the letters of blocks that look like prose, less what stands in links, discounted by depth
   below boilerplate. All containers vote, once for each generalised tag-class path (digits dropped, ids left
   out; a digest stands for it), with their share of the page's scores; the best one is marked.
2. Votes are summed by host and path in Spark, partly before the shuffle, so a hot host is a few
   rows a task. A host's winners are the paths that were best on a page, those of most pages first, ties by weight, then by
   name: a host may have several templates. Pages carry their host's winners, or, of a host with over ``TEMPLATES`` of them, look up the first among their own paths.
3. Pages are parsed again. A page takes the elements at the first of its host's winning paths that it
   has, or else its own best container. From there it climbs while the element above adds
   paragraphs, headings or other prose, and nothing else but that: a lead, a title or a closing beside
   the winning container. Menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and reader comments are left out. Names that an article's own sections may have as well (``SOFT``: related, notice,
   discussion ...) strike an element only if it does not read like a section, or if a quarter of the host's pages, three at least, have its very text.

Blocks are joined in page order by one space, white space inside them is one space, character
references are decoded; nothing else is dropped.

The winners are a row per host: they are broadcast if a count proves them few; else pages meet
them in a join that adaptive execution can split.

Defined cases: null, empty and text-free pages give the empty text; broken mark-up is parsed as
far as it goes, unclosed elements end with their parents, those nested deeper than ``DEEPEST`` count as
their parent's own text; time and memory grow with the page's length, whatever it holds; a null or odd url is a host of its own
kind, voting like others; repeated pages vote each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shipping import bounded, map_batches, settle

#: Winning paths up to which a host's pages carry them all; pages of other hosts look theirs up. The depth from which elements are not told apart, as browsers have it too.
TEMPLATES, DEEPEST = 16, 256
#: Elements without end tags, elements that never hold text to keep, elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title nav header footer aside form button select textarea menu dialog".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Elements that an opening tag of the first kind closes, if they are open inside the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOUNDARY = frozenset("article aside body div footer header main nav section table td th ul ol dl".split())
#: Words in class, id and role names of what is not the article, wherever they stand; of reader comments; and such as an article's own sections may have, too.
STRONG = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer colophon sidebar widget ad ads advert adverts advertisement advertising sponsor sponsored
    promo cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login disqus pagination pager toolbar adbox adslot toc skip social""".split())
COMMENT = frozenset("comment comments reply replies respond responses".split())
SOFT = frozenset("header banner aside notice share sharing related recommended discussion search".split()) | COMMENT
#: Words that say no more than that something is a part of a page.
GENERIC = frozenset("area bar block body box container content form inner item items link links list main module outer page panel post posts reader row section thread title user wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+")
#: Names of an article's own parts, which the words above would strike.
PART = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|content)-(?:header|banner|title|body|content)(?:$|[^a-z])")
_SPACE = re.compile(r"\s+")


_BEGIN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/><]*+)|[!?/])")
_UNQUOTED = re.compile(r"[^<>\"']*+")
#: Characters of what turned out to be no tag that are searched again for tags.
AGAIN = 4096


def _tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin and end of comments, declarations and tags, with a tag's "/" or "", name and attributes; a quoted value may be of any length.

    What looks like none of them is text. Each character is read a bounded number of times.
    """
    at, none = 0, {'"': len(html) + 1, "'": len(html) + 1}  # from where on there is no such quote
    while m := _BEGIN.search(html, at):
        if m[0] == "<!--":
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
            yield m.start(), at, "", "", ""
            continue
        end = m.end()
        while True:
            end = _UNQUOTED.match(html, end).end()
            mark = html[end : end + 1]
            if mark not in ("'", '"') or not mark:
                break
            close = html.find(mark, end + 1) if m[2] and end < none[mark] else -1
            if close < 0:
                none[mark] = min(none[mark], end) if m[2] else none[mark]
                end += 1  # a quote that none closes
            else:
                end = close + 1
        if mark == ">":
            at = end + 1
            yield m.start(), at, m[1] or "", m[2] or "", html[m.end() : end] if m[2] else ""
        else:
            at = end if end - m.start() > AGAIN else m.end()


_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements whose content is no mark-up.
RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


def _attributes(written: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(written)} if written and not written.isspace() else {}


def _doubt(names: str) -> int:
    """2 where names say that an element is not the article, 1 where they may."""
    found = 0
    for name in PART.sub(" ", names).split():
        words = set(_WORDS.findall(name))
        if words & STRONG or words & COMMENT and words <= COMMENT | GENERIC and words & {"comment", "comments"}:
            return 2
        found = max(found, int(bool(words & SOFT)))
    return found


class _Node:
    __slots__ = ("_path", "article", "at", "depth", "last", "link", "names", "noise", "parent", "suspect", "tag")

    def __init__(self, tag: str, parent: _Node | None, attrs: dict[str, str], at: int):
        self.tag, self.parent, self._path, self.names = tag, parent, None, attrs.get("class", "")
        self.at = self.last = at  # the number of this node and of the last below it
        self.depth = parent.depth + 1 if parent is not None else 0
        self.article = tag == "article" or parent is not None and parent.article
        self.noise = parent is not None and parent.noise or tag in SILENT and not (tag == "header" and parent is not None and parent.article)
        #: The topmost element around this one whose name alone speaks against it.
        self.suspect = parent.suspect if parent is not None and tag != "main" else None
        if attrs and not self.noise:
            names = " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs).lower().replace("_", "-")
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            doubt = 0 if tag in ("html", "body", "article", "main") else _doubt(names)
            self.noise = hidden or doubt == 2
            if doubt == 1 and self.suspect is None:
                self.suspect = self
        self.link = tag == "a" or parent is not None and parent.link

    @property
    def path(self) -> str:
        """A digest of tags and sorted classes from the root, digits dropped."""
        unknown, node = [], self
        while node is not None and node._path is None:
            unknown.append(node)
            node = node.parent
        for node in reversed(unknown):
            kinds = sorted(set(re.sub(r"\d+", "", node.names.lower()).split()))
            above = node.parent._path if node.parent is not None else ""
            node._path = hashlib.blake2b(f"{above}>{'.'.join([node.tag, *kinds])}".encode(), digest_size=12).hexdigest()
        return self._path


class Page:
    """``blocks``: (text, container, letters in links, tag of the block) in page order, boilerplate left out; ``doubtful``: such blocks under elements of doubtful names; ``nodes`` in page order."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, _Node, int, str]] = []
        self.doubtful: list[tuple[int, tuple[str, _Node, int, str]]] = []
        self._open = _Node("#", None, {}, 0)
        self.nodes = [self._open]
        self._is_open: Counter[str] = Counter()
        self._beyond: Counter[str] = Counter()
        self._text: list[str] = []
        self._holder: _Node | None = None
        self._linked, self._kind, at = 0, "", 0
        for begin, end, closing, name, written in _tokens(html):
            if begin < at:
                continue  # inside raw text
            if begin > at:
                self._data(html[at:begin])
            at = end
            if not name:
                continue
            tag = name.lower()
            if closing:
                self._end(tag)
                continue
            self._start(tag, written)
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.end() if end else len(html)
                self._end(tag)
        if at < len(html):
            self._data(html[at:])
        self._end_block()
        for node in reversed(self.nodes):
            if node.parent is not None and node.last > node.parent.last:
                node.parent.last = node.last

    def _end_block(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text and self._holder is not None:
            block = text, self._holder, self._linked, self._kind
            if self._holder.suspect is None:
                self.blocks.append(block)
            else:
                self.doubtful.append((len(self.blocks), block))
        self._text, self._holder, self._linked = [], None, 0

    def _up_to(self, node: _Node) -> None:
        """Close all that is open below ``node``."""
        while self._open is not node:
            self._is_open[self._open.tag] -= 1
            self._open = self._open.parent

    def _close_to(self, tags, inside=BOUNDARY) -> None:
        if not any(self._is_open[t] for t in tags):
            return
        node = self._open
        while node.parent is not None:
            if node.tag in tags:
                self._up_to(node.parent)
                return
            if node.tag in inside:
                return
            node = node.parent

    def _start(self, tag: str, written: str) -> None:
        if tag in CLOSES_P:
            self._close_to(("p",))
        if tag in CLOSES:
            self._close_to(CLOSES[tag], BOUNDARY - {"td", "th"} if tag in ("td", "th", "tr") else BOUNDARY)
        if tag in BLOCK:
            self._end_block()
        if tag in VOID:
            return
        if self._open.depth >= DEEPEST and tag not in SILENT:
            self._beyond[tag] += 1
            return
        self._open = _Node(tag, self._open, _attributes(written), len(self.nodes))
        self.nodes.append(self._open)
        self._is_open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        if self._beyond[tag]:
            self._beyond[tag] -= 1
        elif self._is_open[tag]:
            node = self._open
            while node.tag != tag:
                node = node.parent
            self._up_to(node.parent)

    def _data(self, data: str) -> None:
        if self._open.noise:
            return
        if "&" in data:
            data = unescape(data)
        if self._holder is None and data.strip():
            node, self._kind = self._open, ""
            while node.parent is not None and node.tag not in BOUNDARY:
                self._kind = self._kind or (node.tag if node.tag in BLOCK else "")
                node = node.parent
            self._kind, self._holder = self._kind or node.tag, node
        if self._holder is not None:
            self._text.append(data)
            if self._open.link:
                self._linked += len(data.strip())


#: Preference of elements made for the purpose, and the share that a container keeps of what lies deeper.
WEIGHT, DEPTH = {"article": 2.0, "main": 1.5, "section": 1.1, "body": 0.6, "html": 0.4, "#": 0.3}, 0.9


#: Elements whose text belongs to the article beside them.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption details summary".split())


def _prose(text: str) -> bool:
    return len(text) > 80 or text[-1:] in ".!?:…\"'"


def sections(page: Page) -> dict[int, list[str]]:
    """Elements of doubtful names that read like a section of an article: paragraphs of their own, a heading or more than one of them, hardly any links."""
    below: dict[int, list[tuple[str, _Node, int, str]]] = {}
    for _, block in page.doubtful:
        below.setdefault(block[1].suspect.at, []).append(block)
    found = {}
    for at, blocks in below.items():
        own = [b for b in blocks if b[1].at == at]
        said = [b for b in own if b[3] in TEXTUAL and b[3] != "li" and _prose(b[0])]
        letters, linked = sum(len(b[0]) for b in blocks), sum(b[2] for b in blocks)
        if len(own) >= 0.8 * len(blocks) and len(said) + any(b[3][:1] == "h" for b in own) >= 2 and 5 * linked <= letters and sum(len(b[0]) for b in said) >= 0.6 * letters:
            found[at] = [b[0] for b in blocks]
    return found


def containers(page: Page) -> list[tuple[float, _Node]]:
    """Candidates by falling score: prose letters of the blocks below, fading with distance, carried up once for each element."""
    score = [0.0] * len(page.nodes)
    for text, holder, linked, _ in page.blocks:
        score[holder.at] += max(0, len(text) - 2 * linked) * (1.0 if _prose(text) else 0.5)
    for node in reversed(page.nodes[1:]):
        score[node.parent.at] += DEPTH * score[node.at]
    found = [(s * WEIGHT.get(n.tag, 1.0), n) for s, n in zip(score, page.nodes) if s > 0 and (n.tag in BOUNDARY or n.parent is None)]
    return sorted(found, key=lambda x: (-x[0], x[1].path))


def _said(texts: list[str]) -> str:
    """The name of a doubtful section, by what it says."""
    return "=" + hashlib.blake2b("\n".join(texts).encode(), digest_size=12).hexdigest()


def votes(html: str | None) -> list[tuple[str, float, int]]:
    """path, share of the page's scores, and 1 for the page's best; of several elements at a path the best one speaks. Doubtful sections vote under their names, for 0."""
    page, found = Page(html or ""), {}
    for score, node in containers(page):
        found.setdefault(node.path, score)
    total = sum(found.values())
    return [(path, score / total, int(n == 0)) for n, (path, score) in enumerate(found.items())] + [(x, 0.0, 0) for x in sorted({_said(t) for t in sections(page).values()})]


class _Spans:
    """Elements as ranges of node numbers, those inside others left out."""

    def __init__(self, nodes: list[_Node]):
        self.ends, self.starts, top = [], [], -1
        for n in nodes:  # in page order
            if n.at > top:
                self.starts.append(n.at)
                self.ends.append(n.last)
                top = n.last

    def hold(self, at: int) -> bool:
        k = bisect_right(self.starts, at)
        return k > 0 and at <= self.ends[k - 1]


def _climbed(page: Page, chosen: list[_Node]) -> list[_Node]:
    """Up from the chosen elements as long as the ones above add text of an article and nothing else."""
    while True:
        above = list({n.parent.at: n.parent for n in chosen if n.parent is not None}.values())
        if not above or len(above) > 1 or above[0].tag in ("body", "html", "#") or any(n.tag in ("article", "main") for n in chosen):
            return chosen
        inside = _Spans(chosen)
        for text, holder, linked, kind in page.blocks:
            if above[0].at <= holder.at <= above[0].last and not inside.hold(holder.at) and not (2 * linked <= len(text) and (kind in TEXTUAL or _prose(text))):
                return chosen
        chosen = above


def main_text(html: str | None, paths: list[str] | None, repeated: list[str] | None = None) -> str:
    """By the first of ``paths`` that the page has; ``repeated`` are names of doubtful sections that many of the host's pages have."""
    page = Page(html or "")
    wanted, at = set(paths or ()), {}
    for n in page.nodes:
        if wanted and not n.noise and n.suspect is None and (n.tag in BOUNDARY or n.parent is None) and n.path in wanted:
            at.setdefault(n.path, []).append(n)
    chosen = next((at[p] for p in paths or () if p in at), [])
    spans = _Spans(chosen)
    if not any(spans.hold(b[1].at) for b in page.blocks):
        chosen = [n for _, n in containers(page)[:1]]
    spans = _Spans(_climbed(page, chosen))
    kept = {k for k, texts in sections(page).items() if _said(texts) not in set(repeated or ())} if page.doubtful else set()
    doubtful = [(k, b[0]) for k, b in page.doubtful if b[1].suspect.at in kept and spans.hold(b[1].suspect.at)]
    out, done = [], 0
    for k, text in [*doubtful, (len(page.blocks), "")]:
        out += [b[0] for b in page.blocks[done:k] if spans.hold(b[1].at)]
        done = k
        if text:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` per page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    picked = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"), F.col(f"`{url_col}`").alias("url"), host.alias("host"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *vote) for k, html in enumerate(batch.column(1).to_pylist()) for vote in votes(html)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], names=["host", "path", "weight", "best"])

    cast = map_batches(picked.select("host", "html"), vote, "host string, path string, weight double, best long")
    sums = settle(cast.groupBy("host", "path").agg(F.round(F.sum("weight"), 6).alias("weight"), F.sum("best").alias("best"), F.count(F.lit(1)).alias("n")).filter("best > 0 or n > 2"))
    pages_of = sums.groupBy("host").agg(F.sum("best").alias("pages"))
    repeated = sums.filter("path like '=%'").join(pages_of, "host").filter("n > 2 and 4 * n >= pages").groupBy("host").agg(F.collect_list("path").alias("repeated"))
    order = Window.partitionBy("host").orderBy(F.desc("best"), F.desc("weight"), "path")
    ranked = sums.filter("best > 0").withColumn("rank", F.row_number().over(order))
    winners = ranked.filter(F.col("rank") <= TEMPLATES + 1).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("won")).select("host", F.col("won.path").alias("paths"))
    known = settle(winners.join(repeated, "host", "left"))
    joined = picked.join(bounded(known), "host", "left")
    if not known.filter(F.size("paths") > TEMPLATES).isEmpty():  # each page of such a host brings its own paths, and the best of them comes back
        name = F.sha2(F.coalesce("html", F.lit("")), 256)
        rest = picked.join(known.filter(F.size("paths") > TEMPLATES).select("host", "repeated"), "host").withColumn("page", name)

        def own(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(k, path) for k, html in enumerate(batch.column(1).to_pylist()) for path in dict.fromkeys(n.path for _, n in containers(Page(html or "")))]
            at = pa.array([r[0] for r in rows], pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([r[1] for r in rows], pa.string())], names=["host", "page", "path"])

        has = map_batches(rest.select("host", "html", "page").dropDuplicates(["host", "page"]), own, "host string, page string, path string")
        best = has.join(ranked.select("host", "path", "rank"), ["host", "path"]).groupBy("host", "page").agg(F.min_by("path", "rank").alias("path"))
        looked_up = rest.join(best, ["host", "page"], "left").withColumn("paths", F.array("path")).select(*joined.columns)
        joined = joined.filter(F.coalesce(F.size("paths"), F.lit(0)) <= TEMPLATES).unionByName(looked_up)
    kind, url_kind = dict(pages.dtypes)[id_col], dict(pages.dtypes)[url_col]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, p, r) for h, p, r in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return map_batches(joined.select("id", "html", "url", "paths", "repeated"), cut, f"`{id_col}` {kind}, `{url_col}` {url_kind}, text string")
