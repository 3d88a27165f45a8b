"""Tokens, character n-grams, content strings and hashes. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of a-z0-9 with no letter, digit or underscore of any script beside it, so
# "café" and "foo_bar" give none. Java's \b disagrees about combining marks, hence look-arounds;
# the possessive run keeps matching linear.
TOKEN = r"(?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def char_ngrams(word: Column, n: int = 3) -> Column:
    """All substrings of length ``n`` with repeats; a shorter word is its own only n-gram."""
    whole = F.array(word)
    return F.when(F.length(word) < n, whole).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))),
            lambda start: F.substring(word, start, F.lit(n)),
        )
    )


def content_string(title: Column, description: Column, slug: Column) -> Column:
    """The indexed text: exactly two separating spaces, also around empty parts."""
    return F.concat_ws(" ", *[F.coalesce(part, F.lit("")) for part in (title, description, slug)])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it. A plain
    column could be copied into the inner lambdas by the optimizer and computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(token_array: Column) -> Column:
    """One (term, frequency) struct per distinct token of the row.

    Sorting the row's tokens and reading off run lengths counts terms without leaving the row, so
    no posting is shuffled to be counted and a term found in every document is no hot key.
    """

    def starts(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda token, i: F.when((i == 0) | (token != F.get(ordered, i - 1)), i),
        )
        return F.filter(marked, lambda i: i.isNotNull())

    def runs(ordered: Column, begins: Column) -> Column:
        def run(begin: Column, i: Column) -> Column:
            end = F.coalesce(F.get(begins, i + 1), F.size(ordered))
            return F.struct(
                F.get(ordered, begin).alias("term"), (end - begin).cast("long").alias("frequency")
            )

        return F.transform(begins, run)

    return _bound(
        F.sort_array(token_array),
        lambda ordered: _bound(starts(ordered), lambda begins: runs(ordered, begins)),
    )
