"""Ranked, boolean and fuzzy search over postings.

Inputs are ``hits``: ``term, doc_id, frequency, doc_length``. From stored tables they come from
:func:`with_lengths`; straight from texts from ``index_build.postings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.text import char_ngrams, tokens
from pagequarry.operators.index_build import token_counts
from pagequarry.operators.joins import is_small, lookup_join, salted_join
from pagequarry.session import pinned

K1, B = 1.2, 0.75
# Scores are compared after rounding, so the order in which a sum was taken cannot decide a tie.
SCORE_DIGITS = 6
# What bounds on scores leave for that rounding.
MARGIN = 4 * 10.0**-SCORE_DIGITS


def with_lengths(postings: DataFrame, documents: DataFrame) -> DataFrame:
    return postings.join(documents.select("doc_id", "doc_length"), "doc_id")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and their average length in tokens."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_length").alias("avg_length")
    )


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, term) of whole query texts."""
    terms = F.array_distinct(tokens(F.col(text)))
    return queries.select(key, F.explode(terms).alias("term"))


def _joined(facts: DataFrame, queries: DataFrame, key: str, small: bool, how: str = "inner") -> DataFrame:
    """Query tables are broadcast if measured small, else common keys of the facts are salted."""
    if small:
        return facts.join(F.broadcast(queries), key, how)
    return salted_join(facts, queries, key, ["doc_id"], how)


def _term_hits(hits: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Hits of the query terms only."""
    return _joined(hits, terms.select("term").distinct(), "term", small, "left_semi")


def _saturation(avg_length: Column) -> Column:
    """BM25's use of a term's frequency; below K1 + 1 whatever the document."""
    tf = F.col("frequency")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doc_length") / avg_length))


def _idf(df: Column, n_docs: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def bm25_part(df: Column, n_docs: Column, avg_length: Column) -> Column:
    return _idf(df, n_docs) * _saturation(avg_length)


def tfidf_part(df: Column, n_docs: Column, avg_length: Column) -> Column:
    return F.col("frequency") * F.log(n_docs / df)


def scores(
    hits: DataFrame, stats: DataFrame, queries: DataFrame, part=bm25_part, small: bool | None = None
) -> DataFrame:
    """``query_id, doc_id, score`` for every document with a query term. ``small`` says that the
    queries may be broadcast; they are measured if it is not given.

    The hits are read twice, for the document frequencies and for the parts. A document's parts lie
    in one map task, so they are summed there before the shuffle on (query, document).
    """
    small = is_small(queries) if small is None else small
    wanted = _term_hits(hits, queries, small)
    frequencies = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = queries.select("query_id", "term").distinct().join(frequencies, "term")
    matched = _joined(wanted, weighted, "term", small)
    # One row of statistics.
    scored = matched.crossJoin(F.broadcast(stats)).withColumn(
        "_part", part(F.col("_df"), F.col("n_docs"), F.col("avg_length"))
    )
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("_part"), SCORE_DIGITS).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents of a single query; every task keeps only its own best ``k``."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def top_k_per_query(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query with their ``rank``; map tasks send at most ``k`` per query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch_scores(
    hits: DataFrame, stats: DataFrame, queries: DataFrame, k: int, small: bool | None = None
) -> DataFrame:
    """BM25 scores of all documents that can be among the best ``k`` of a query; others may be left
    out, so the best ``k`` are the same as with :func:`scores`.

    A common word pairs its query with much of the corpus and decides little. The k-th best single
    part of a query's terms bounds its k-th best score from below. Terms that even together stay
    under that bound (each gives less than idf * (K1 + 1)) cannot lift a document into the result:
    documents are found through the other terms. Of these only the ones are scored in full that the
    terms left out could still lift over the k-th best sum so far.
    """
    small = is_small(queries) if small is None else small
    # One row, but a whole pass over the texts to compute it.
    stats = pinned(stats)
    wanted = pinned(
        _term_hits(hits, queries, small)
        .crossJoin(F.broadcast(stats))
        .withColumn("_part", _saturation(F.col("avg_length")))
        .select("term", "doc_id", "_part")
    )
    best = Window.partitionBy("term").orderBy(F.desc("_part"))
    bounds = (
        wanted.withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") <= k)
        .groupBy("term")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("_part")).alias("_kth"))
    )
    frequencies = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    terms = frequencies.join(bounds, "term").crossJoin(F.broadcast(stats))
    weighted = queries.select("query_id", "term").distinct().join(terms, "term").select(
        "query_id", "term", _idf(F.col("_df"), F.col("n_docs")).alias("_idf"), "_kth"
    )
    query = Window.partitionBy("query_id")
    up_to = query.orderBy("_idf", "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.max(F.col("_idf") * F.col("_kth")).over(query)
    reach = F.sum(F.col("_idf") * (K1 + 1)).over(up_to)
    weighted = pinned(
        weighted.withColumns(
            {"_bound": bound, "_finds": F.coalesce(reach + MARGIN >= bound, F.lit(True))}
        )
    )
    limits = weighted.groupBy("query_id").agg(
        F.coalesce(F.max("_bound"), F.lit(0.0)).alias("_bound"),
        F.coalesce(F.sum(F.when(~F.col("_finds"), F.col("_idf") * (K1 + 1))), F.lit(0.0)).alias("_others"),
    )

    def side(finds: bool) -> DataFrame:
        return weighted.where(F.col("_finds") == finds).select("query_id", "term", "_idf")

    summed = (
        _joined(wanted, side(True), "term", small)
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("_idf") * F.col("_part")).alias("_sum"))
    )
    able = F.col("_sum") + F.col("_others") + MARGIN >= F.col("_bound")
    found = pinned(_joined(summed, limits, "query_id", small).where(able))
    # What the finding terms alone give the k-th best document is a closer bound.
    ranks = Window.partitionBy("query_id").orderBy(F.desc("_sum"))
    closer = (
        found.withColumn("_rn", F.row_number().over(ranks))
        .where(F.col("_rn") <= k)
        .groupBy("query_id")
        .agg(F.greatest(F.max("_bound"), F.when(F.count(F.lit(1)) == k, F.min("_sum"))).alias("_bound"))
    )
    found = pinned(_joined(found.drop("_bound"), closer, "query_id", small).where(able).select("query_id", "doc_id", "_sum"))
    # (term, doc_id) is unique among the hits: no hot key in this join.
    asked = _joined(found.select("query_id", "doc_id"), side(False), "query_id", small)
    rest = wanted.join(F.broadcast(asked) if is_small(asked) else asked, ["term", "doc_id"]).select(
        "query_id", "doc_id", (F.col("_idf") * F.col("_part")).alias("_sum")
    )
    return found.unionByName(rest).groupBy("query_id", "doc_id").agg(
        F.round(F.sum("_sum"), SCORE_DIGITS).alias("score")
    )


def text_hits(texts: DataFrame, key: str, text: str, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits of the words, statistics) in one pass over the texts."""
    counts = token_counts(texts, key, text)
    kept = F.filter("terms", lambda t: t["term"].isin(words))
    slim = pinned(counts.select(F.col(key).alias("doc_id"), "doc_length", kept.alias("terms")))
    hits = slim.select("doc_id", "doc_length", F.explode("terms").alias("_t"))
    return hits.select("_t.term", "doc_id", "_t.frequency", "doc_length"), corpus_stats(slim)


def literal_query(hits: DataFrame, terms: list[str]) -> DataFrame:
    """A one-query ``queries`` table from given words."""
    return hits.sparkSession.createDataFrame([(0, t) for t in dict.fromkeys(terms)], "query_id INT, term STRING")


def docs_with_all(hits: DataFrame, terms: list[str]) -> DataFrame:
    wanted = hits.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return wanted.where(F.col("_n") == len(set(terms))).select("doc_id")


def docs_with_any(hits: DataFrame, terms: list[str]) -> DataFrame:
    return hits.where(F.col("term").isin(terms)).select("doc_id").distinct()


def docs_with_none(hits: DataFrame, documents: DataFrame, terms: list[str]) -> DataFrame:
    return documents.select("doc_id").join(docs_with_any(hits, terms), "doc_id", "left_anti")


def _bits(grams: str) -> Column:
    """64 bits, one set for each n-gram: of a word's bits those another word lacks are as many n-grams, or
    more, that it lacks."""
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.crc32(g.cast("binary")), F.lit(64)).cast("int"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda bits, g: bits.bitwiseOR(bit(g)))


def _rarest_grams(grams: DataFrame, counts: DataFrame, word: str, threshold: float) -> DataFrame:
    """(``word``, ngram, ``<word>_at``, ``<word>_n``, ``<word>_bits``): of each word's n-grams the rarest,
    enough that two words as similar as ``threshold`` have one of them in common; its place by rarity, the
    number of the word's n-grams and their :func:`_bits`.

    Of a set of n grams at least threshold * n / (2 - threshold) are in every similar set, so one of them
    is left when one less than that are put aside: the commonest ones, by the same order for all words.
    """
    rated = lookup_join(grams, counts, "ngram", [word])
    by_rarity = F.sort_array(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("count"), "ngram")))
    # A word has at most as many n-grams as letters.
    sets = rated.groupBy(word).agg(by_rarity["ngram"].alias("_grams"))
    size = F.size("_grams")
    needed = F.ceil(size * threshold / (2 - threshold)).cast("int")
    kept = F.slice("_grams", F.lit(1), size - F.greatest(needed, F.lit(1)) + 1)
    # Two steps: beside the generator the bits would be computed for each of its rows.
    sized = sets.select(word, size.alias(f"{word}_n"), _bits("_grams").alias(f"{word}_bits"), kept.alias("_kept"))
    return sized.select(word, f"{word}_n", f"{word}_bits", F.posexplode("_kept").alias(f"{word}_at", "ngram"))


def _most_shared(word: str, other: str) -> Column:
    """A bound on the n-grams in common, seen from ``word``: those it has from the found one on (exact for
    the rarest in common), and those whose bit the other has."""
    lacking = F.bit_count(F.col(f"{word}_bits").bitwiseAND(F.bitwise_not(f"{other}_bits")))
    return F.col(f"{word}_n") - F.greatest(F.col(f"{word}_at"), lacking)


def similar_terms(
    ngrams: DataFrame, words: DataFrame, k: int, threshold: float = 0.5, n: int = 3
) -> DataFrame:
    """Up to ``k`` index terms per ``query_term`` by Dice similarity of their distinct n-grams, for few
    words or many.

    ``ngrams`` are distinct (ngram, term), read twice. Terms are found through the rarest n-grams of both
    words only, common n-grams are split over tasks, and a pair is compared in the task that finds it:
    pairs below the threshold are never shuffled. A find is compared only where :func:`_most_shared`
    leaves enough n-grams; for a similar pair the find by its rarest n-gram in common does.
    """
    least = threshold - 10.0**-SCORE_DIGITS
    query = words.where(F.col("query_term").isNotNull()).select("query_term").distinct()
    asked = query.select("query_term", F.explode(F.array_distinct(char_ngrams(F.col("query_term"), n))).alias("ngram"))
    counts = pinned(ngrams.groupBy("ngram").agg(F.count(F.lit(1)).alias("_count")))
    rare = _rarest_grams(ngrams.select("ngram", "term"), counts, "term", least)
    sought = pinned(_rarest_grams(asked, counts, "query_term", least))
    if is_small(sought):
        pairs = rare.join(F.broadcast(sought), "ngram")
    else:
        pairs = salted_join(pinned(rare), sought, "ngram", ["term"])
    total = F.col("query_term_n") + F.col("term_n")
    most = F.least(_most_shared("query_term", "term"), _most_shared("term", "query_term"))
    one, two = (char_ngrams(F.col(c), n) for c in ("query_term", "term"))
    # explode keeps the comparison out of the join's condition, which would then not be compiled.
    count = F.size(F.array_intersect(one, two)).cast("long")
    shared = pairs.where(2 * most >= least * total).select(
        "query_term", "term", total.alias("_total"), F.explode(F.array(count)).alias("shared")
    )
    dice = F.round(2 * F.col("shared") / F.col("_total"), SCORE_DIGITS)
    found = shared.select("query_term", "term", "shared", dice.alias("dice")).where(F.col("dice") >= threshold)
    order = Window.partitionBy("query_term").orderBy(F.desc("dice"), "term")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_term", "term", "shared", "dice", "rank")
    )
