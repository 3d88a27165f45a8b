"""URL expressions: normal form, parts, slug, and resolving relative links. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic URI layout (RFC 3986 appendix B): scheme, authority, path, query, fragment.
_LAYOUT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _LAYOUT, group)


def normalised(url: Column) -> Column:
    """The URL up to its first ``#``, without trailing slashes."""
    return F.regexp_replace(F.substring_index(url, "#", 1), r"/+\z", "")


def url_hash(url: Column) -> Column:
    return F.sha1(normalised(url))


def path_of(url: Column) -> Column:
    """Path without ``;params`` of the last segment, query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(_part(url, 3), r";[^/]*\z", ""), r"/+\z", "")


def slug_of(url: Column) -> Column:
    """Last slash-separated piece of the whole URL (query included), ``-`` and ``_`` as spaces."""
    last = F.element_at(F.split(F.regexp_replace(url, r"/+\z", ""), "/"), -1)
    return F.translate(last, "-_", "  ")


def origin_of(url: Column) -> Column:
    """``scheme://authority``."""
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def cleaned_reference(ref: Column) -> Column:
    """A link as a URL parser sees it: no leading blanks or controls, no tab or line breaks inside."""
    return F.regexp_replace(ref, r"^[\x00-\x20]+|[\t\r\n]", "")


def base_parts(url: Column) -> Column:
    """What resolving needs of a page URL. Compute once per page, before exploding its links."""
    path = _part(url, 3)
    origin = origin_of(url)
    return F.struct(
        _part(url, 1).alias("scheme"),
        F.when(origin != "", origin).otherwise(F.lit("")).alias("origin"),
        path.alias("path"),
        F.regexp_replace(path, r"[^/]*\z", "").alias("folder"),
        F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1).alias("query"),
        url.alias("url"),
    )


def without_dot_segments(path: Column) -> Column:
    """``.`` and ``..`` folded away; a climb above the root is dropped."""
    pieces = F.split(path, "/")
    inner = F.filter(
        F.transform(
            pieces,
            lambda piece, i: F.when(
                (piece != "") | (i == 0) | (i == F.size(pieces) - 1), piece
            ),
        ),
        lambda piece: piece.isNotNull(),
    )
    folded = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda done, piece: F.when(
            piece == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(piece == ".", done)
        .otherwise(F.concat(done, F.array(piece))),
    )
    ends_in_dots = F.element_at(pieces, -1).isin(".", "..")
    closed = F.when(ends_in_dots, F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(closed, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of link ``ref`` on the page whose :func:`base_parts` are ``base``.

    Root-relative links without dot segments, by far the most common, take one ``concat``.
    """
    return resolve_cleaned(base, cleaned_reference(ref))


def resolve_all(base: Column, refs: Column) -> Column:
    """:func:`resolve` for an array of links: each is cleaned and resolved once, also if the results
    are filtered later (a filter on a plain column would be pushed down together with a copy of it)."""
    return F.transform(F.transform(refs, cleaned_reference), lambda link: resolve_cleaned(base, link))


def resolve_cleaned(base: Column, link: Column) -> Column:
    scheme = F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    # A link that names the page's own scheme but no host is still relative.
    same_scheme = (scheme != "") & (scheme == F.lower(base["scheme"]))
    relative = F.when(same_scheme, F.regexp_replace(link, r"^[^:]*:", "")).otherwise(link)
    path = F.regexp_extract(relative, r"^([^?#]*)", 1)
    tail = F.regexp_extract(relative, r"(?s)^[^?#]*(.*)$", 1)
    # An empty query or fragment leaves no separator behind.
    tidy_tail = F.regexp_replace(F.regexp_replace(tail, r"#\z", ""), r"^\?(?=#|\z)", "")
    rooted = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(base["folder"] == "", F.lit("/")).otherwise(base["folder"]), path)
    )
    folded = F.when(rooted.rlike(_DOT_SEGMENT), without_dot_segments(rooted)).otherwise(rooted)
    return (
        F.when((link == "") | link.isNull(), base["url"])
        .when(
            link.startswith("/") & ~link.startswith("//") & ~link.rlike(r"/\.|[?#]"),
            F.concat(base["origin"], link),
        )
        .when((scheme != "") & ~same_scheme, link)
        .when(relative.startswith("//"), F.concat(base["scheme"], F.lit(":"), relative))
        .when(
            path == "",
            F.concat(
                base["origin"],
                base["path"],
                F.when(tidy_tail.startswith("?"), F.lit("")).otherwise(base["query"]),
                tidy_tail,
            ),
        )
        .otherwise(F.concat(base["origin"], folded, tidy_tail))
    )


def percent_decoded(value: Column) -> Column:
    """%XX sequences decoded as UTF-8; stray percent signs and plus signs stay as they are."""
    guarded = F.regexp_replace(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(value.contains("%"), F.url_decode(guarded)).otherwise(value)
