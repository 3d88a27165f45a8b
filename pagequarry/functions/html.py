"""Fields and links of a fetched page.

Links are read with JVM regular expressions. Fields picked by CSS-like selectors need the nesting of
open elements, which no built-in expresses, so one Arrow UDF reads all of a page's fields in a single
pass and stops as soon as the last wanted element has closed.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_TYPE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("title", "description", "image")]
)

# HTML elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer keygen menuitem".split()
)
# Elements whose own text is not page text.
SILENT = frozenset(("script", "style", "template", "rt", "rp"))

_OPENING = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
# A tag without "<" in it: tried first, as it never looks past the next "<".
_PLAIN = re.compile(
    r"<(/?)([A-Za-z][^\s/>\"'<]*+)(?=[\s/>])((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
)
_NAME_END = re.compile(r"[\s/>]|\Z")
_SPECIAL = re.compile(r"[>\"']|\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_STEP = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)(?::nth-of-type\((\d+)\))?\Z")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if not source:
        return found
    for name, value in _ATTRIBUTE.findall(source):
        found[name.lower()] = _entities.unescape(value.strip("\"'") if value[:1] in "\"'" else value)
    return found


@lru_cache(maxsize=10_000)
def _compiled(selector: str | None):
    """Descendant steps ``tag``, ``.class``, ``#id``, ``:nth-of-type(n)``; none if unsupported."""
    steps = []
    for word in (selector or "").split():
        match = _STEP.match(word)
        if not match:
            raise ValueError(f"selector step not supported: {word}")
        tag, marks, nth = match.groups()
        classes = re.findall(r"\.([\w-]+)", marks)
        ids = re.findall(r"#([\w-]+)", marks)
        steps.append((tag.lower() if tag and tag != "*" else None, classes, ids, int(nth or 0)))
    return steps


def _fits(step, node) -> bool:
    tag, classes, ids, nth = step
    name, attributes, position = node
    if (tag and tag != name) or (nth and nth != position):
        return False
    if classes and not set(classes) <= set(attributes.get("class", "").split()):
        return False
    return not ids or attributes.get("id") in ids


class _Ahead:
    """The next match of a pattern from rising places, without searching the same stretch twice."""

    def __init__(self, pattern: re.Pattern, source: str):
        self.pattern, self.source, self.start, self.found = pattern, source, 0, -1

    def __call__(self, place: int) -> int:
        if not self.start <= place <= self.found:
            self.start, self.found = place, self.pattern.search(self.source, place).start()
        return self.found


def _markup(source: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing?, name, attributes) of tags, name None for comments and declarations.

    A tag ends at the first ``>`` outside quotes; what never ends is text. Time is linear: a quote from
    which no end was found is not followed a second time. A consumer that has passed over some text
    sends the place to go on from.
    """
    size, last = len(source), source.rfind(">")
    name_end, special = _Ahead(_NAME_END, source), _Ahead(_SPECIAL, source)
    dead: set[int] = set()
    place = 0
    while match := _OPENING.search(source, place):
        start, place = match.start(), match.end()
        kind = source[start + 1]
        if kind in "!?":
            if source.startswith("!--", start + 1):
                end = source.find("-->", place)
                place = end + 3 if end >= 0 else size
            elif start < last:
                place = source.index(">", start) + 1
            else:
                continue
            place = (yield start, place, False, None, "") or place
            continue
        if start > last:
            continue
        if plain := _PLAIN.match(source, start):
            place = plain.end()
            slash, name, rest = plain.groups()
            place = (yield start, place, slash == "/", name.lower(), rest) or place
            continue
        closing = kind == "/"
        first = start + 1 + closing
        begin = name_end(first)
        at, quotes = special(begin), []
        while at < size and source[at] != ">" and at not in dead:
            quotes.append(at)
            close = source.find(source[at], at + 1)
            at = _SPECIAL.search(source, close + 1).start() if close >= 0 else size
        if at < size and source[at] == ">":
            place = at + 1
            place = (yield start, place, closing, source[first:begin].lower(), source[begin:at]) or place
        else:
            dead.update(quotes)


def page_fields(source, title, description, image, image_attr) -> tuple[str, str, str]:
    """First match of each selector, as an end tag closes everything opened since its start tag."""
    selectors = [_compiled(title), _compiled(description), _compiled(image)]
    results: list[str | None] = [None if steps else "" for steps in selectors]
    captures: list[tuple[int, int, list[str], str]] = []  # field, depth, texts, own tag
    # Name, innermost silent element, and of each selector how many leading steps the path has met.
    stack: list[tuple[str, str | None, tuple[int, ...]]] = []
    opened: Counter[str] = Counter()
    siblings: list[dict[str, int]] = [{}]
    text: list[str] = []

    def end_text():
        run = _entities.unescape("".join(text)).strip()
        text.clear()
        if run:
            silent = stack[-1][1] if stack else None
            for _, _, texts, own in captures:
                if silent == (own if own in SILENT else None):
                    texts.append(run)

    def close_to(depth):
        opened.subtract(node[0] for node in stack[depth:])
        del stack[depth:]
        del siblings[depth + 1 :]
        for capture in [c for c in captures if c[1] > depth]:
            results[capture[0]] = "".join(capture[2])
            captures.remove(capture)

    source = source or ""
    place, moved = 0, None
    tags = _markup(source)
    while any(found is None for found in results):
        try:
            start, end, closing, name, rest = tags.send(moved)
        except StopIteration:
            start = end = len(source)
            closing, name, rest = False, None, ""
        moved = None
        if captures:
            text.append(source[place:start])
        end_text()
        place = end
        if start == len(source):
            break
        if name is None:
            continue
        if closing:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close_to(depth)
            continue
        position = siblings[-1][name] = siblings[-1].get(name, 0) + 1
        attributes = _attributes(rest)
        node = (name, attributes, position)
        met = stack[-1][2] if stack else (0,) * len(selectors)
        # A field that is found needs no more matching.
        fits = [
            result is None and _fits(steps[min(done, len(steps) - 1)], node)
            for steps, done, result in zip(selectors, met, results)
        ]
        silent = name if name in SILENT else stack[-1][1] if stack else None
        now = met
        if any(fits):
            now = tuple(
                done + (fit and done < len(steps) - 1) for steps, done, fit in zip(selectors, met, fits)
            )
        stack.append((name, silent, now))
        opened[name] += 1
        siblings.append({})
        for field, steps in enumerate(selectors):
            waiting = results[field] is None and all(c[0] != field for c in captures)
            if waiting and fits[field] and met[field] == len(steps) - 1:
                if field == 2:
                    results[2] = attributes.get(image_attr or "src", "")
                else:
                    captures.append((field, len(stack), [], name))
        if name in VOID or rest.rstrip().endswith("/"):
            close_to(len(stack) - 1)
        elif name in ("script", "style"):
            body = re.compile(r"</" + name + r"\s*>", re.I).search(source, place)
            body_end = body.start() if body else len(source)
            if captures:
                text.append(source[place:body_end])
            place = moved = body_end
    close_to(0)
    return tuple(found or "" for found in results)


@F.pandas_udf(FIELD_TYPE)
def _fields_udf(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    for columns in batches:
        rows = [page_fields(*row) for row in zip(*columns)]
        yield pd.DataFrame(rows, columns=["title", "description", "image"])


def fields(html: Column, selectors: Column) -> Column:
    """Struct (title, description, image) for the page's site ``selectors`` struct."""
    return _fields_udf(
        html,
        selectors["title_selector"],
        selectors["description_selector"],
        selectors["image_selector"],
        F.coalesce(selectors["image_attr"], F.lit("src")),
    )


# Comments and script or style bodies can hold text that looks like links.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]++)"""
_ANCHOR_HREF = (
    r"(?is)<a(?:\s++(?!href\b)[^\s=>]++(?:\s*+=\s*+" + _VALUE + r")?)*+\s++href\s*+=\s*+(" + _VALUE + r")"
)


_BASIC = r"&(?:quot|#39|lt|gt|amp);"


def _basic_unescaped(value: Column) -> Column:
    plain = value
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda row: None if row is None else [_entities.unescape(v) for v in row])


def raw_hrefs(html: Column) -> Column:
    """The href of every anchor in page order, quotes off, entities still in place."""
    found = F.regexp_extract_all(
        F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, ""), F.lit(_ANCHOR_HREF), F.lit(1)
    )
    return F.transform(found, lambda href: F.regexp_replace(href, r"""^["']|["']\z""", ""))


def unescaped_hrefs(hrefs: Column) -> Column:
    """Entities decoded. Rows with only the usual five stay on the JVM side of the ``CASE``;
    the UDF sees null for them."""
    rare = F.exists(hrefs, lambda h: F.regexp_replace(h, _BASIC, "").contains("&"))
    decoded = _unescape_udf(F.when(rare, hrefs))
    return F.coalesce(decoded, F.transform(hrefs, _basic_unescaped))


def last_https(url: Column) -> Column:
    """Image-fix hook: of several ``https://`` in one value keep the text from the last."""
    pieces = F.split(url, "https://")
    return F.when(F.size(pieces) > 2, F.concat(F.lit("https://"), F.element_at(pieces, -1))).otherwise(url)
