"""Main text of web pages, with the templates of their sites removed.

A page is parsed into a light tree. Elements that name themselves as furniture (``nav``, ``footer``,
``class="cookie-notice"`` and the like) go. All other blocks of the page, inside and outside a marked article (``article`` or
``main``), are hashed by tags and text, and Spark counts each hash per host over pages of different prose; a subtree that recurs
on a share of the host's pages is template and is deleted. Article prose (paragraphs, lists and tables of a marked article) must
recur on more pages and a larger share of them, so a passage or licence line that some articles share stays. Blocks outside the
article stay if they are no template; on a host with too few pages to tell, the article alone is the main text.

Counting is by host and hash with partial sums, so a host with a third of all pages is added up by
all tasks, its pages are counted as one more subtree, and the recurring hashes go back to their pages by a join that adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import as_text, written
from forecourt.llm.url_rules import url_host

#: Pages of different prose on which a subtree must recur within a host to be template, and their least share of the host's.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: The same for prose of a marked article.
FIRM_PAGES, FIRM_SHARE = 20, 0.5
#: Stands for the page itself among its subtrees, so that a host's pages are counted with them; plus one if nothing lies outside its article.
WHOLE = 0

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
    title tr ul""".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
FURNITURE = set("""aside audio button canvas dialog embed footer form head header iframe input menu nav noscript object script select style
    svg template textarea title video""".split())
#: Words in class, id or role that name furniture; a name may join them with hyphens, underscores or capitals.
NAMES = set("""ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs byline-share comment comments
    complementary consent contentinfo cookie cookies dialog disclaimer disqus footer gdpr header infobar login masthead menu menubar modal nav navbar
    navigation newsletter notice notices pager pagination popup promo promotion recommended related reply replies respond search share
    sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets""".split())
#: An open element of the key's name ends where one of these begins.
_CLOSES = {"p": BLOCKS - {"br", "hr", "option", "title"} | {"hr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
           "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements that an ending inner element does not reach across.
_FENCES = set("article aside body div footer form header html main nav section table td th ul ol li".split())


class Page(HTMLParser):
    """The tree of one page: per node its tag, parent and whether it is furniture; text and block borders in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.bad, self.main = ["#root"], [-1], [False], [False]
        self.events: list[tuple[int, str | None]] = []
        self.open = [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        top = self.tag[self.open[-1]]
        while tag in _CLOSES.get(top, ()):
            self._end()
            top = self.tag[self.open[-1]]
        if tag in BLOCKS or tag == "hr":  # an inline element left open does not keep a paragraph open
            for depth in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[depth]]
                if tag in _CLOSES.get(name, ()):
                    del self.open[depth:]
                    break
                if name in _FENCES:
                    break
        node = len(self.tag)
        names = {k: v or "" for k, v in attrs}
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.main.append(tag in ("article", "main") or names.get("role") in ("main", "article") or names.get("itemprop") == "articleBody")
        self.bad.append(tag in FURNITURE or "hidden" in names or tag not in ("html", "body") and _names_furniture(names))
        if tag in BLOCKS:
            self.events.append((node, None))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                for _ in range(len(self.open) - depth):
                    self._end()
                return

    def _end(self):
        node = self.open.pop()
        if self.tag[node] in BLOCKS:
            self.events.append((node, None))

    def handle_data(self, data):
        self.events.append((self.open[-1], data))


def _names_furniture(attrs: dict[str, str]) -> bool:
    said = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
    if not said:
        return False
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", said).lower()
    return not NAMES.isdisjoint(re.split(r"[^a-z]+", words))


def _kept(page: Page) -> tuple[list[bool], list[bool], bool]:
    """Which nodes hold main text by the page alone: no furniture, and inside a marked article if the page has one; which
    blocks lie outside the article and are no furniture; and whether there is an article.

    A wrapper that is named like furniture but holds the only article is none.
    """
    n = len(page.tag)
    around = [False] * n
    for i in range(n - 1, 0, -1):
        if around[i] or page.main[i] and not page.bad[i]:
            around[page.parent[i]] = True
    alive = [True] * n
    for excused in (False, True):
        for i in range(1, n):
            bad = page.bad[i] and not (excused and around[i] and page.tag[i] not in FURNITURE)
            alive[i] = alive[page.parent[i]] and not bad
        for only in ("article", None):
            inside = [False] * n
            for i in range(1, n):
                top = page.main[i] and (only is None or page.tag[i] == only)
                inside[i] = alive[i] and (inside[page.parent[i]] or top)
            if any(inside):
                return inside, _outside(page, alive, inside), True
        if not excused:
            unmarked = alive.copy()
    return unmarked, [False] * n, False


def _outside(page: Page, alive: list[bool], inside: list[bool]) -> list[bool]:
    """Nodes of blocks beside the article; not the elements around it, nor loose text in those."""
    n = len(page.tag)
    holds = inside.copy()
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] |= holds[i]
    out = [False] * n
    for i in range(1, n):
        out[i] = alive[i] and not holds[i] and (out[page.parent[i]] or page.tag[i] in BLOCKS and page.tag[i] not in ("html", "body"))
    return out


def _hashes(page: Page, inside: list[bool], outside: list[bool], marked: bool) -> dict[int, int]:
    """Key of each block with text: a hash by tags and text without attributes or furniture, even, plus one for article prose."""
    n = len(page.tag)
    kept = [a or b for a, b in zip(inside, outside)]
    holds_prose, has_text = [False] * n, [False] * n
    said: list[list[str]] = [[] for _ in range(n)]
    for node, text in page.events:
        if text and kept[node]:
            said[node].append(text)
            has_text[node] |= not text.isspace()
    inner: list[list[str]] = [[] for _ in range(n)]
    found = {}
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        holds_prose[up] |= holds_prose[i] or page.tag[i] in PROSE
        if not kept[i]:
            continue
        has_text[up] |= has_text[i]
        digest = xxhash.xxh64_intdigest(f"{page.tag[i]} {' '.join(''.join(said[i]).split())} {''.join(inner[i][::-1])}".encode("utf-8", "replace")) >> 1
        inner[up].append(f"<{digest:x}>")
        if has_text[i] and (outside[i] or inside[up]) and page.tag[i] in BLOCKS and page.tag[i] not in ("html", "body"):
            prose = marked and inside[i] and (holds_prose[i] or page.tag[i] in PROSE or page.tag[up] in PROSE)
            found[i] = digest & ~1 | prose
    return found


def main_text(html: str, template: frozenset[int] = frozenset()) -> str:
    """The main text's blocks with white space made one space, without subtrees whose key is in ``template``.

    With ``WHOLE`` in it the host has pages enough to tell template, and blocks outside the article that are none stay.
    """
    page = Page(html)
    inside, outside, marked = _kept(page)
    kept = [a or b for a, b in zip(inside, outside)] if WHOLE in template else inside
    if template - {WHOLE}:
        gone = [False] * len(kept)
        hashes = _hashes(page, inside, outside, marked)
        kept = kept.copy()
        for i in range(1, len(kept)):
            gone[i] = gone[page.parent[i]] or hashes.get(i) in template
            kept[i] = kept[i] and not gone[i]
    out = [" " if text is None else text for node, text in page.events if text is None or kept[node]]
    return " ".join("".join(out).split())


def template_candidates(html: str) -> tuple[int, list[int]]:
    """A hash of the page's prose, and the distinct keys of its blocks; none if it has no block with text."""
    page = Page(html)
    inside, outside, marked = _kept(page)
    found = _hashes(page, inside, outside, marked)
    if not found:
        return 0, []
    prose = "".join(t for node, t in page.events if t and inside[node] and page.tag[node] in PROSE)
    return xxhash.xxh64_intdigest(prose.encode("utf-8", "replace")) >> 1, sorted({WHOLE | (not any(outside)), *found.values()})


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``row`` (all input columns) with ``text``, the page's main text without its site's template.

    Null or empty html gives empty text. The site is the URL's host; pages without one share the
    empty host. Template recurs on ``min_pages`` pages and on ``min_share`` of the host's, so that what a few pages of a
    large host share stays; for article prose it is at least ``FIRM_PAGES`` and ``FIRM_SHARE``. Pages of equal prose count once, so copies of an article do not turn it
    into template; repeated rows are extracted alike, and an empty table gives no rows.
    """

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [template_candidates(x) for x in batch["body"]]
            yield pd.DataFrame({"row_key": batch["row_key"], "host": batch["host"], "prose": [p for p, _ in found],
                                "hashes": [h for _, h in found]})[[bool(h) for _, h in found]]

    seen = pages.select(F.struct("*").alias("row"))
    body, address = as_text(F.col("row").getField(html)), F.col("row").getField(url).cast("string")
    seen = seen.select("row", body.alias("body"), F.coalesce(url_host(address), F.lit("")).alias("host"), F.xxhash64(address, body).alias("row_key"))
    nodes = written(seen.select("row_key", "host", "body").mapInPandas(
        candidates, "row_key long, host string, prose long, hashes array<long>"), "subtrees")
    subtrees = nodes.select("row_key", "host", "prose", F.explode("hashes").alias("key")).withColumn("subtree", F.col("key").bitwiseAND(F.lit(~1)))
    recurring = written(subtrees.select("host", "subtree", "prose").distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages"))
                        .where(F.col("pages") >= min_pages), "recurring")
    hosts = recurring.where(F.col("subtree") == WHOLE).select("host", F.col("pages").alias("of"))
    template = (recurring.join(hosts, "host").where(F.col("pages") >= min_share * F.col("of"))
                .select("host", "subtree", ((F.col("subtree") != WHOLE) & (F.col("pages") >= FIRM_PAGES) & (F.col("pages") >= FIRM_SHARE * F.col("of"))).alias("firm")))
    found = subtrees.join(template, ["host", "subtree"]).where(F.col("firm") | (F.col("key") == F.col("subtree")))
    dropped = found.groupBy("row_key").agg(F.collect_set("key").alias("dropped"))
    dropped = written(dropped, "template")

    @F.pandas_udf("string")
    def extract(bodies: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([main_text(b, frozenset(d.tolist()) if d is not None else frozenset()) for b, d in zip(bodies, dropped)], dtype=object)

    return seen.join(dropped, "row_key", "left").select("row", extract("body", "dropped").alias("text"))
