"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of words and tags. Each has a score: the weight of its place, learned from pages
whose article is marked up. A word's place is the chain of elements it stands in, a tag's place its
name; weights are log odds of standing inside against outside the article. One linear scan finds the
contiguous run with the highest sum, the content region. Elements that are never part of an article
(menus, forms, scripts and the like, by name or by the words of their class, id or role) are taken out
of the region. Inside an article only a class that says nothing else counts ("widget", "share-buttons",
not "elementor-widget-container"); on a page without an article no element that holds most of the words
is taken out by its class, unless it is reader comments. The time grows with the page, whatever is left
open or ended in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Labelled pages the weights are learned from, about.
SAMPLE = 2_000
#: Scores without an example: a word and a tag at a place never seen, a word and a tag taken out, and
#: the most that anything beside a marked article counts.
NEW_WORD, NEW_TAG, NOISE_WORD, NOISE_TAG, OUTSIDE = 0.5, -0.25, -0.5, -2.0, -0.5
# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object".split())
NEVER = frozenset(
    "nav header footer aside form script style noscript template svg iframe object button select "
    "option textarea input label dialog menu head title figcaption audio video canvas".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of the right closes an open one of the left.
CLOSES = {
    "p": BLOCK - {"body", "html"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "tr": frozenset({"tr"}),
    "option": frozenset({"option"}),
}
#: Words of a class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer header masthead related recommended comment comments commentlist "
    "respond reply replies disqus discussion widget toolbar pagination pager search complementary "
    "contentinfo form skip".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Words that may stand beside those without saying that there is content.
FURNITURE = frozenset(
    "area bar block box button buttons container group holder icon icons inner item items link links list "
    "module panel post posts row section slot thread title unit wrap wrapper".split()
)
CONTENT = frozenset("article main content post entry story text body".split())
#: Words that make a class token the name of a layout: one of these anywhere, or last.
LACKING = frozenset("has have no non not with without hide".split())
LAYOUT = frozenset("page layout site template theme".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
    r"<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<(?P<cut>/?[A-Za-z][^<>]*+)\Z|"
    r"[^<]+|<",  # no part can look past the next <, so a page is read in linear time
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+|[0-9]+")
SPACE = re.compile(r"\s+")


def marks(rest: str, inside: bool = False) -> frozenset[str]:
    """Lower-case words of the class, id and role of a tag. Of a token that names a layout ("has-sidebar",
    "search-page") or the header of content ("entry-header") no word counts that marks noise; nor, inside
    an article, of one with any word that neither marks noise nor is :data:`FURNITURE`."""
    if "=" not in rest:
        return frozenset()
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(rest):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = PARTS.findall(token)
            layout = words and words[-1] in LAYOUT or not LACKING.isdisjoint(words)
            titled = words and words[-1] == "header" and not CONTENT.isdisjoint(words)
            mixed = inside and not NOISE.union(FURNITURE).issuperset(words)
            out.update(set(words) - NOISE if layout or titled or mixed else words)
    return frozenset(out)


def noisy(name: str, words: frozenset[str], inside: bool) -> bool:
    """Whether an element is never part of an article. The header and title lines inside an article
    belong to it."""
    if name in NEVER:
        return not (name == "header" and inside) and name != "figcaption"
    if name in ("main", "body", "html"):
        return False
    return bool(words & NOISE) and (name == "article" or "article" not in words)


class Run:
    """Words or a tag at one place: ``kind`` is its place for the weights, ``words`` how many, ``text``
    the decoded text (None for a tag), ``block`` whether a block begins here, ``never`` whether it stands
    in an element that is noise by its name."""

    __slots__ = ("block", "inside", "kind", "never", "noise", "text", "words")

    def __init__(self, kind: str, text: str | None, block: bool, noise: bool, inside: bool, never: bool = False):
        self.kind, self.text, self.block, self.noise, self.inside = kind, text, block, noise, inside
        self.never = never
        self.words = len(text.split()) if text else 0


def runs(page: str) -> list[Run]:
    """The page as runs, in order. Where every article stands in elements that are noise by their class,
    these enclose the content, and those around the longest article are no noise. Without an article,
    those are none that hold more than half of the words."""
    articles: list[tuple[list[int], tuple | None]] = []
    taken: list[list] = []
    out = parsed(page, frozenset(), articles, taken)
    if any(around is None for _, around in articles):
        return out
    before = [0]
    for r in out:
        before.append(before[-1] + (0 if r.never else r.words))
    spared: set[int] = set()
    if articles:
        _, around = max(articles, key=lambda a: before[a[0][1]] - before[a[0][0]])
        while around:
            spared.add(around[0])
            around = around[1]
    else:
        spared.update(first for first, last, said in taken if not said and 2 * (before[last] - before[first]) > before[-1])
    return parsed(page, frozenset(spared), [], []) if spared else out


def parsed(page: str, spared: frozenset[int], articles: list, taken: list) -> list[Run]:
    """Runs of the page; elements whose first run is in ``spared`` are no noise by class. Adds (first and
    last run, noise elements around) of every article that is not noise of itself, and (first run, last
    run, whether it is comments) of every element that is noise by its class."""
    out: list[Run] = []
    marked: tuple | None = None  # (first run, the one around) of the open elements that are noise by class
    # Of every open element: first run, place in articles and in taken (or -1).
    opened: list[tuple[int, int, int]] = []
    # Name, noisy (or inside noise), inside an article, in an element that is noise by its name.
    stack: list[tuple[str, bool, bool, bool]] = []
    count: dict[str, int] = {}  # open elements by name
    at, end = 0, len(page)

    def close(depth: int) -> None:
        nonlocal marked
        while len(stack) > depth:
            name, noise, inside, never = stack.pop()
            _, which, own = opened.pop()
            count[name] -= 1
            if which >= 0:
                articles[which][0][1] = len(out)
            if own >= 0:
                taken[own][1] = len(out)
                marked = marked[1]
            out.append(Run("/" + name, None, name in BLOCK, noise, inside, never))

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m["name"]
        if not name:
            piece = m[0]
            if m["cut"] or piece.startswith(("<!", "<?")):
                continue
            place, noise, inside, never = stack[-1] if stack else ("", False, False, False)
            out.append(Run("w " + ("noise" if noise else place), html.unescape(piece), False, noise, inside, never))
            continue
        name = name.lower()
        if m["end"]:
            if count.get(name):
                # All that is walked over is closed.
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in BLOCK:
                _, noise, inside, never = stack[-1] if stack else ("", False, False, False)
                out.append(Run("/" + name, None, True, noise, inside, never))
            continue
        while stack and name in CLOSES.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if name in BLOCK and count.get("p"):  # a block ends an open paragraph, also through inline elements
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        above = stack[-1] if stack else ("", False, False, False)
        inside = above[2] or name in ("article", "main")
        words = marks(m["rest"], above[2])
        own = noisy(name, words, above[2])
        by_class = own and (name == "form" or name not in NEVER)
        here = len(out)
        own = own and not (by_class and here in spared)
        noise = above[1] or own
        never = above[3] or (noise and name in NEVER and name != "form")
        out.append(Run(name if not noise else "noise " + name, None, name in BLOCK, noise, inside, never))
        if name == "br":
            out.append(Run("w " + above[0], " ", False, noise, inside, never))
        if name in VOID or m["rest"].endswith("/") and name not in BLOCK:
            continue
        which = place = -1
        if name in ("article", "main") and not own and not above[3]:
            which = len(articles)
            articles.append(([here, here], marked))
        if own and by_class:
            place = len(taken)
            taken.append([here, here, not words.isdisjoint(COMMENTS)])
            marked = (here, marked)
        stack.append((name, noise, inside, never))
        opened.append((here, which, place))
        count[name] = count.get(name, 0) + 1
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else end
    close(0)
    return out


def weighted(found: list[Run], weights: dict[str, float]) -> list[float]:
    """Score of every run. Words count each. What is taken out of the region anyway costs nothing inside
    an article; where a page marks its article, words beside it are against the region."""
    marked = any(r.inside for r in found)
    out = []
    for r in found:
        size = 1 if r.text is None else r.words
        if r.noise:
            weight = 0.0 if r.inside else NOISE_TAG if r.text is None else NOISE_WORD
        elif marked and not r.inside:
            weight = min(OUTSIDE, weights.get(r.kind, 0.0))
        else:
            weight = weights.get(r.kind, NEW_TAG if r.text is None else NEW_WORD)
        out.append(weight * size)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run with the largest sum; the first and longest among equals;
    empty when nothing is positive."""
    best, start, stop, total, begin = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, begin = 0.0, k
        total += s
        if total > 0 and (total > best or total == best and begin == start):
            best, start, stop = total, begin, k + 1
    return start, stop


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text; empty without a page or without content."""
    if not page:
        return ""
    found = runs(page)
    start, stop = best_run(weighted(found, weights))
    blocks: list[list[str]] = [[]]
    for r in found[start:stop]:
        if r.block:
            blocks.append([])
        if r.text is not None and not r.noise:
            blocks[-1].append(r.text)
    lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(x for x in lines if x)


def counted(page: str | None) -> dict[str, list[int]]:
    """kind -> [inside, outside] the article of a labelled page; empty for a page without one."""
    if not page or "<article" not in page.lower():
        return {}
    out: dict[str, list[int]] = {}
    for r in runs(page):
        if not r.noise:
            both = out.setdefault(r.kind, [0, 0])
            both[0 if r.inside else 1] += r.words if r.text is not None else 1
    return out


def train(pages: DataFrame, page_id: str, page: str) -> dict[str, float]:
    """Weight of each place, from about ``SAMPLE`` pages with an article element: log odds of standing
    inside it, at most 2 either way, for words raised so that text in a usual place is positive. There are
    as many places as element names in these pages."""
    labelled = pages.where(F.lower(F.col(page)).contains("<article"))
    total = labelled.count()
    share = int((1 << 20) * min(1.0, SAMPLE / max(1, total)))
    rows = labelled.where(F.pmod(F.xxhash64(F.col(page_id)), F.lit(1 << 20)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            for value in batch.column("html").to_pylist():
                for kind, (a, b) in counted(value).items():
                    both = total.setdefault(kind, [0, 0])
                    both[0] += a
                    both[1] += b
            yield pa.RecordBatch.from_pydict(
                {
                    "kind": pa.array(list(total), pa.string()),
                    "a": pa.array([v[0] for v in total.values()], pa.int64()),
                    "b": pa.array([v[1] for v in total.values()], pa.int64()),
                }
            )

    sums = (
        rows.select(F.col(page).alias("html"))
        .mapInArrow(count, "kind string, a long, b long")
        .groupBy("kind")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .collect()
    )
    weights = {}
    for r in sums:
        odds = max(-2.0, min(2.0, math.log((r["a"] + 1) / (r["b"] + 1))))
        weights[r["kind"]] = max(0.25, odds) if r["kind"].startswith("w ") and r["a"] else odds if r["kind"].startswith("w ") else min(-0.05, odds / 4)
    for name in ("article", "main"):
        weights[name] = weights["/" + name] = -0.05
    return weights


def extracted(page: Column, weights: dict[str, float]) -> Column:
    """The main text of a page."""

    @arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return extract(page)


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row of ``pages``.

    Null, empty and contentless pages give an empty text; repeated rows are answered each, also with a null
    id. Pages of any length are read whole, in time that grows with them. Of equal regions the first and
    longest counts. Other columns of ``pages``, whatever their names, are not looked at. An empty table
    gives no rows.
    """
    d = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")
    )
    weights = train(d, "page_id", "html")
    return d.select("page_id", "url", extracted(F.col("html"), weights).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
