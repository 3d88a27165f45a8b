"""Tokens, postings, n-grams and search over ``documents.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import content_hash, content_string, tokens
from pagequarry.operators import index_build, search
from pagequarry.operators.ordered import global_rank
from pagequarry.plans.common import (
    SQL_DOCUMENT_TOKENS,
    SQL_POSTINGS,
    sql_ngrams,
    sql_tokens,
    table,
    texts,
)
from pagequarry.session import pinned

WORDS = ["the", "of", "tion", "wh", "eau"]
MISSPELT = ["ththed", "whch", "erion", "entwh", "leau"]
ALL_OF = ["the", "of"]
K = 10


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "documents")


def _counts(spark, folder):
    return index_build.token_counts(_documents(spark, folder), "doc_id", "text")


def _hits(spark, folder):
    return index_build.postings(_documents(spark, folder), "doc_id", "text")


def tokenise_counts(spark, folder):
    text = tokens(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.size(text).cast("long").alias("n_tokens"), F.array_join(text, " ").alias("tokens")
    )


def postings(spark, folder):
    return _hits(spark, folder).select("term", "doc_id", "frequency")


def unique_terms(spark, folder):
    return _counts(spark, folder).select("doc_id", "unique_terms")


def corpus_stats(spark, folder):
    stats = search.corpus_stats(_counts(spark, folder))
    return stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


def document_frequencies(spark, folder):
    return index_build.vocabulary(_hits(spark, folder))


def _terms(spark, folder):
    return index_build.distinct_terms(_documents(spark, folder), "text")


def term_ngrams(spark, folder):
    return index_build.term_ngrams(_terms(spark, folder))


def term_ngrams_4(spark, folder):
    return index_build.term_ngrams(_terms(spark, folder), n=4)


def ngram_multiset(spark, folder):
    return index_build.ngram_multiset(_hits(spark, folder))


def _fuzzy(spark, folder, words):
    # The n-grams are read twice: the texts are read for their terms once.
    return search.similar_terms(index_build.term_ngrams(pinned(_terms(spark, folder))), words, 5)


def fuzzy_terms_topk(spark, folder):
    words = spark.createDataFrame([(w,) for w in MISSPELT], "query_term STRING")
    return _fuzzy(spark, folder, words)


def fuzzy_batch_topk(spark, folder):
    """Index terms like each token of the benchmark."""
    bench = search.query_terms(table(spark, folder, "benchmark"), "item_id", "text")
    return _fuzzy(spark, folder, bench.withColumnRenamed("term", "query_term"))


def _ranked(spark, folder, part):
    hits, stats = search.text_hits(_documents(spark, folder), "doc_id", "text", WORDS)
    scored = search.scores(hits, stats, search.literal_query(hits, WORDS), part, small=True)
    return search.top_k(scored, K).select("doc_id", "score")


def bm25_topk(spark, folder):
    return _ranked(spark, folder, search.bm25_part)


def tfidf_topk(spark, folder):
    return _ranked(spark, folder, search.tfidf_part)


def bm25_batch_topk(spark, folder):
    """Every benchmark text, with all its distinct tokens, as a query."""
    bench = table(spark, folder, "benchmark").withColumnRenamed("item_id", "query_id")
    queries = search.query_terms(bench, "query_id", "text")
    stats = search.corpus_stats(_counts(spark, folder))
    scored = search.batch_scores(_hits(spark, folder), stats, queries, K)
    return search.top_k_per_query(scored, K).select(
        "query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank")
    )


def boolean_and(spark, folder):
    return search.docs_with_all(_hits(spark, folder), ALL_OF)


def boolean_or(spark, folder):
    return search.docs_with_any(_hits(spark, folder), ALL_OF)


def boolean_not(spark, folder):
    return search.docs_with_none(_hits(spark, folder), _documents(spark, folder), ALL_OF)


def hashed_contents(spark, folder):
    content = content_string(F.col("source"), F.col("text"), F.col("lang"))
    return _documents(spark, folder).select(
        "doc_id", F.length(content).cast("long").alias("content_length"), content_hash(content).alias("content_hash")
    )


def page_hashes(spark, folder):
    return texts(spark, folder, "pages").select("page_id", content_hash(F.col("html")).alias("content_hash"))


def term_ranks(spark, folder):
    """All terms numbered by document frequency: a total order over a whole table."""
    vocabulary = index_build.vocabulary(_hits(spark, folder))
    return global_rank(vocabulary, [F.desc("df"), "term"], "rank")


QUERIES = {
    "tokenise_counts": tokenise_counts,
    "postings": postings,
    "unique_terms": unique_terms,
    "corpus_stats": corpus_stats,
    "document_frequencies": document_frequencies,
    "term_ngrams": term_ngrams,
    "term_ngrams_4": term_ngrams_4,
    "ngram_multiset": ngram_multiset,
    "fuzzy_terms_topk": fuzzy_terms_topk,
    "fuzzy_batch_topk": fuzzy_batch_topk,
    "bm25_topk": bm25_topk,
    "tfidf_topk": tfidf_topk,
    "bm25_batch_topk": bm25_batch_topk,
    "boolean_and": boolean_and,
    "boolean_or": boolean_or,
    "boolean_not": boolean_not,
    "content_hash": hashed_contents,
    "page_hashes": page_hashes,
    "term_ranks": term_ranks,
}


def _in(words):
    return ", ".join(f"'{w}'" for w in words)


_PART = {
    "bm25": "ln(1 + (n - df + 0.5) / (df + 0.5)) * frequency * 2.2"
    " / (frequency + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))",
    "tfidf": "frequency * ln(n / df)",
}
_STATS = "st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens)"
_DF = "df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"


def _top_sql(part):
    return f"""WITH {SQL_POSTINGS}, {_STATS}, {_DF}
SELECT doc_id, round(sum({_PART[part]}), 6) AS score
FROM post JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN st
WHERE term IN ({_in(WORDS)}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {K}"""


def _ngram_sql(n):
    return f"""WITH {SQL_DOCUMENT_TOKENS}, terms AS (SELECT DISTINCT unnest(tokens) AS term FROM tok)
SELECT DISTINCT ngram, term FROM (SELECT unnest({sql_ngrams('term', n)}) AS ngram, term FROM terms)"""


_HAS = f"SELECT DISTINCT doc_id FROM post WHERE term IN ({_in(ALL_OF)})"

def _fuzzy_sql(queries: str) -> str:
    return f"""WITH {SQL_DOCUMENT_TOKENS},
terms AS (SELECT DISTINCT unnest(tokens) AS term FROM tok),
tg AS (SELECT DISTINCT unnest({sql_ngrams('term')}) AS ngram, term FROM terms),
tn AS (SELECT term, count(*) AS n2 FROM tg GROUP BY term),
q AS ({queries}),
qg AS (SELECT DISTINCT unnest({sql_ngrams('query_term')}) AS ngram, query_term FROM q),
qn AS (SELECT query_term, count(*) AS n1 FROM qg GROUP BY query_term),
s AS (SELECT query_term, term, count(*) AS shared FROM qg JOIN tg USING (ngram) GROUP BY ALL),
d AS (SELECT query_term, term, shared, round(2.0 * shared / (n1 + n2), 6) AS dice
      FROM s JOIN qn USING (query_term) JOIN tn USING (term))
SELECT query_term, term, shared, dice, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_term ORDER BY dice DESC, term) AS rank
  FROM d WHERE dice >= 0.5) WHERE rank <= 5"""


SQL = {
    "tokenise_counts": f"""WITH {SQL_DOCUMENT_TOKENS}
SELECT doc_id, len(tokens) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM tok""",
    "postings": f"WITH {SQL_POSTINGS} SELECT term, doc_id, frequency FROM post",
    "unique_terms": f"WITH {SQL_DOCUMENT_TOKENS} SELECT doc_id, len(list_distinct(tokens)) AS unique_terms FROM tok",
    "corpus_stats": f"WITH {SQL_POSTINGS} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_length FROM lens",
    "document_frequencies": f"WITH {SQL_POSTINGS} SELECT term, count(*) AS df FROM post GROUP BY term",
    "term_ngrams": _ngram_sql(3),
    "term_ngrams_4": _ngram_sql(4),
    "ngram_multiset": f"""WITH {SQL_POSTINGS}
SELECT ngram, term, count(*) AS copies
FROM (SELECT unnest({sql_ngrams('term')}) AS ngram, term FROM post) GROUP BY ngram, term""",
    "fuzzy_terms_topk": _fuzzy_sql(f"SELECT unnest([{_in(MISSPELT)}]) AS query_term"),
    "fuzzy_batch_topk": _fuzzy_sql(f"SELECT DISTINCT unnest({sql_tokens('text')}) AS query_term FROM benchmark"),
    "bm25_topk": _top_sql("bm25"),
    "tfidf_topk": _top_sql("tfidf"),
    "bm25_batch_topk": f"""WITH {SQL_POSTINGS}, {_STATS}, {_DF},
qt AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum({_PART['bm25']}), 6) AS score
      FROM qt JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN st
      GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
WHERE rank <= {K}""",
    "boolean_and": f"""WITH {SQL_POSTINGS} SELECT doc_id FROM post WHERE term IN ({_in(ALL_OF)})
GROUP BY doc_id HAVING count(*) = {len(ALL_OF)}""",
    "boolean_or": f"WITH {SQL_POSTINGS} {_HAS}",
    "boolean_not": f"""WITH {SQL_POSTINGS}
SELECT doc_id FROM documents WHERE doc_id NOT IN ({_HAS})""",
    "content_hash": """SELECT doc_id, length(c) AS content_length, sha256(c) AS content_hash
FROM (SELECT doc_id, source || ' ' || text || ' ' || lang AS c FROM documents)""",
    "page_hashes": "SELECT page_id, sha256(html) AS content_hash FROM pages",
    "term_ranks": f"""WITH {SQL_POSTINGS}
SELECT term, df, row_number() OVER (ORDER BY df DESC, term) AS rank
FROM (SELECT term, count(*) AS df FROM post GROUP BY term)""",
}
