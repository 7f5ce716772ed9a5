"""Main text of web pages by consensus host paths.

Every page's containers are scored: clean text counts for a container, text of menus, adverts, forms and the
like and of link lists against it. A page votes for its best container's path of tags and classes, with digits
generalised, and votes are summed per host in Spark. Pages are then extracted again with their host's winning
path; a page without an element on that path uses its own best container.

A class, id or role marks noise by a whole token or its end (`site-footer`, `sidebar-left`), not by a word of another
meaning in it (`no-sidebar`, `share-prices`). The mark is lifted from what holds nearly all of a page's text, and from
a main element, or a lone article of a page without another one, below it. Of what the winning container holds, only
noise is left out; link lists stay.

A page is read once from left to right and its elements are kept in document order with their parents' places, so that
all that is inherited or summed over the tree takes one pass: time and memory grow with the page's length, whatever
its depth.

Defined results: null and empty pages give an empty text; a null or odd URL is a host of its own; tags that aren't
closed end where HTML lets them end; very long and very deep pages are read whole; equal scores go to the deepest
container, then to the first, and equal votes to the first path in alphabetical order; repeated rows and null ids are
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, through_disk

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|/|$)", re.I)
SPACES = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
WORD = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div main section table tbody td tr blockquote".split())
#: Which open elements a start tag ends, and what they don't reach beyond.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("button table td th".split())
#: Elements that hold no article text.
NOISE_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object select svg template".split())
#: Words of classes, ids and roles that mark what surrounds an article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary "
    "consent contentinfo cookie cookies dialog discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing shoutbox sidebar "
    "signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
#: Words before a noise word that turn its meaning, and words after it that keep it.
TURNS = frozenset("with without no not has hide hidden non".split())
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons col column container content count form group head header heading icon icons inner item items left link links "
    "list main outer panel post posts primary right row secondary section slot small title top unit wide wrap wrapper zone".split()
)
#: Where clean text is less than a part of what a marked element holds, the mark is lifted.
LIFT = 10
EXEMPT = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())



class Page:
    """Elements in document order, the root first, and the texts of blocks, each with its owner's place."""

    def __init__(self) -> None:
        self.tag, self.parent, self.path, self.hard, self.marked = ["body"], [-1], [0], [False], [False]
        self.label, self.above = ["body"], [-1]  # of paths
        self.ids: dict[tuple[int, str], int] = {(-1, "body"): 0}
        self.owner: list[int] = []
        self.text: list[str] = []
        self.links: list[bool] = []
        self.noise: list[bool] = []

    def add(self, tag: str, parent: int, label: str | None, hard: bool, marked: bool) -> int:
        path = self.path[parent]
        if label is not None:
            key = (path, label)
            path = self.ids.get(key, -1)
            if path < 0:
                path = self.ids[key] = len(self.label)
                self.label.append(label)
                self.above.append(key[0])
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(path)
        self.hard.append(hard)
        self.marked.append(marked)
        return len(self.tag) - 1

    def path_text(self, path: int) -> str:
        out = []
        while path >= 0:
            out.append(self.label[path])
            path = self.above[path]
        return ">".join(reversed(out))

    def path_id(self, text: str | None) -> int:
        """Of a path as text; -1 if the page has none such."""
        at = -1
        for label in text.split(">") if text else ():
            at = self.ids.get((at, label), -1)
            if at < 0:
                break
        return at


def _attributes(rest: str) -> tuple[str, str, bool]:
    """Class and id, role, and whether it is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}
    hidden = "hidden" in found or bool(BARE_HIDDEN.search(ATTRIBUTE.sub("", rest))) or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    return f"{found.get('class', '')} {found.get('id', '')}", found.get("role", ""), hidden


def _marked(names: str, header: bool) -> bool:
    """Whether a token of classes, ids or roles is a noise word, or ends in one but for words of layout."""
    for token in CAMEL.sub("-", names).lower().split():
        parts = WORD.findall(token)
        while len(parts) > 1 and (parts[-1] in LAYOUT or parts[-1].isdigit()) and not (header and parts[-1] == "header"):
            parts.pop()
        if parts and (parts[-1] in NOISE_WORDS or header and parts[-1] == "header") and not TURNS.intersection(parts[:-1]):
            return True
    return False


def _label(tag: str, names: str) -> str:
    """A tag with its classes, digits generalised."""
    words = sorted({DIGITS.sub("#", w) for w in names.lower().replace(">", "").split()})
    return ".".join([tag.replace(">", ""), *words])


def parse(html: str) -> Page:
    page = Page()
    stack = [0]
    #: places in the stack of each open tag, and of groups of tags that are looked for together
    open_at: dict[str, list[int]] = {}
    parts: list[str] = []
    owner, linked, inside = 0, 0, 0
    tags, hard = page.tag, page.hard

    def cut() -> None:
        nonlocal owner, linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                page.owner.append(owner)
                page.text.append(text)
                page.links.append(2 * linked > len(text) and tags[owner] not in HEADINGS)
            parts.clear()
            linked = 0
        owner = stack[-1]

    def close(at: int) -> None:
        nonlocal inside
        block = False
        while len(stack) > at:
            tag = tags[stack.pop()]
            open_at[tag].pop()
            block = block or tag in BLOCK
            inside -= tag in ("article", "main")
        if block:
            cut()

    def last(names: Iterable[str]) -> int:
        return max((at[-1] for t in names if (at := open_at.get(t))), default=0)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text and (hard[owner] or not hard[stack[-1]]):  # else of an inline element that holds no article text
            text = unescape(text)
            parts.append(text)
            if open_at.get("a"):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            if html.startswith("<![CDATA[", m.start()):
                parts.append(html[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["close"]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = done.end() if done else end
            if tag not in ("script", "style", "title"):
                parts.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and last("p") > last(SCOPE):
            close(last("p"))
        if tag in ENDS:
            ended, border = ENDS[tag]
            if last(ended) > last(border):
                close(last(ended))
        if tag in BLOCK and tags[stack[-1]] == "head":
            close(len(stack) - 1)
        if tag in VOID:
            if tag == "hr":
                cut()
            continue
        parent = stack[-1]
        names, role, hidden = _attributes(m["rest"]) if m["rest"].strip(" /") else ("", "", False)
        if m["rest"].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        noise = hard[parent] or tag in NOISE_TAGS or hidden or tag == "header" and not inside
        new = page.add(tag, parent, _label(tag, names) if tag in CONTAINER else None, noise, _marked(f"{names} {role}", not inside and tag not in EXEMPT))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(new)
        inside += tag in ("article", "main")
        if tag in BLOCK:
            cut()
    cut()
    _settle(page)
    return page


def _inherited(page: Page, own: Callable[[int, int], int]) -> list[int]:
    """own(place, the parent's value) of each element, the root's parent -1."""
    out: list[int] = []
    for e, parent in enumerate(page.parent):
        out.append(own(e, out[parent] if e else -1))
    return out


def _settle(page: Page) -> None:
    """Finds which elements are noise: hard ones, and what is below a mark that isn't lifted."""
    tags, hard = page.tag, page.hard
    marks = [e for e in range(len(tags)) if page.marked[e] and not hard[e] and tags[e] not in EXEMPT]
    on = set(marks)
    fresh: set[int] = set()
    if marks:
        sized = [(e, len(t)) for e, t, links in zip(page.owner, page.text, page.links) if not hard[e] and not links]
        mains = {e for e in range(len(tags)) if tags[e] in ("article", "main") and not hard[e]}
        near = _inherited(page, lambda e, above: e if e in on or tags[e] in ("article", "main") else above)
        lone: dict[int, list[int]] = {}
        for e in mains:
            lone.setdefault(near[page.parent[e]], []).append(e)
        outside = set(lone.get(-1, []))
        within = _inherited(page, lambda e, above: 1 if e in outside else max(above, 0))
        other = any(within[e] for e, _ in sized)
        for m in marks:
            new = lone.get(m, [])
            fresh.update(e for e in new if not page.marked[e] and (tags[e] == "main" or len(new) == 1 and not other))
        top = _inherited(page, lambda e, above: -1 if e in fresh else e if e in on else above)
        clean, held = 0, dict.fromkeys(marks, 0)
        for e, n in sized:
            if top[e] < 0:
                clean += n
            else:
                held[top[e]] += n
        both = clean + sum(held.values())
        largest = [(-n, e) for e, n in held.items()]
        heapify(largest)
        goes_to: dict[int, int] = {}
        while largest:
            n, m = heappop(largest)
            if m not in on or held[m] != -n:
                continue
            if held[m] <= LIFT * clean or 2 * held[m] <= both:
                break
            on.remove(m)
            goes_to[m] = -1 if m in fresh else top[page.parent[m]]
            chain = []
            to = goes_to[m]
            while to >= 0 and to not in on:
                chain.append(to)
                to = goes_to[to]
            for c in chain:
                goes_to[c] = to
            goes_to[m] = to
            if to < 0:
                clean += held[m]
            else:
                held[to] += held[m]
                heappush(largest, (-held[to], to))
    noise: list[bool] = []
    for e, parent in enumerate(page.parent):
        noise.append(e > 0 and (hard[e] or e not in fresh and (noise[parent] or e in on)))
    page.noise = noise


def best(page: Page) -> tuple[float, int] | None:
    """Score and place of the best container, the deepest of equals; none without clean text.

    A score is the share of the page's clean text times the container's share of clean text.
    """
    clean, dirt = [0] * len(page.tag), [0] * len(page.tag)
    for e, text, links in zip(page.owner, page.text, page.links):
        (dirt if page.noise[e] or links else clean)[e] += len(text)
    total = sum(clean)
    if not total:
        return None
    for e in range(len(page.tag) - 1, 0, -1):
        clean[page.parent[e]] += clean[e]
        dirt[page.parent[e]] += dirt[e]
    depth = _inherited(page, lambda e, above: above + 1)
    fit = [e for e in range(len(page.tag)) if clean[e] and not page.noise[e] and page.tag[e] in CONTAINER]
    score = {e: clean[e] * clean[e] / (total * (clean[e] + dirt[e])) for e in fit}
    e = max(fit, key=lambda e: (round(score[e], 9), depth[e], -e))
    return score[e], e


def best_path(html: str) -> tuple[str, float] | None:
    """The path and score of the page's best container; none without clean text."""
    page = parse(html)
    found = best(page)
    return (page.path_text(page.path[found[1]]), found[0]) if found else None


def extract(html: str, path: str | None) -> str:
    """Text of the outermost elements on the path, else of the page's best container."""
    page = parse(html)
    wanted = page.path_id(path)
    chosen = {e for e in range(len(page.tag)) if page.path[e] == wanted and page.tag[e] in CONTAINER and not page.noise[e]} if wanted >= 0 else set()
    if not chosen:
        found = best(page)
        if not found:
            return ""
        chosen = {found[1]}
    held = _inherited(page, lambda e, above: 1 if e in chosen else max(above, 0))
    return "\n\n".join(t for e, t in zip(page.owner, page.text) if held[e] and not page.noise[e])


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host of pages (host, html); ties go to the first path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [(h, found[0], round(found[1] * 1e6)) for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist()) if t and (found := best_path(t))]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in votes], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "vote"])

    # whole numbers, so that sums don't depend on their order
    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, vote long").groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""
    arrow_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    # a table of its own, so that the join's way follows from its size: broadcast if small, else by host with skew split
    paths = through_disk(host_paths(rows), "paths")
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(t, p) if t else "" for t, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    found = rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
