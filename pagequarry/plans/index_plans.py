"""Index changes over ``documents``: every document is stored, and every document comes in again.

Of the incoming ones French texts have changed, German ones have a new URL, Spanish ones were first
fetched with a stale text; the rest are unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import content_hash, content_string, tokens
from pagequarry.functions.urls import slug_of
from pagequarry.operators import index_build, quality
from pagequarry.session import pinned
from pagequarry.plans.common import sql_ngrams, sql_tokens, table, texts

HOST = "https://docs.example/"
NOW = "2024-02-01 00:00:00"
BEFORE = "2024-01-01 00:00:00"


def _page(documents: DataFrame, host: Column, text: Column) -> DataFrame:
    url = F.concat(host, F.col("doc_id").cast("string"))
    return documents.select(
        "doc_id",
        "lang",
        url.alias("url"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
        text.alias("description"),
        "source",
        F.concat(F.lit("https://img.example/"), F.col("doc_id").cast("string")).alias("image"),
        slug_of(url).alias("slug"),
    )


def stored_documents(spark, folder) -> DataFrame:
    pages = _page(texts(spark, folder, "documents"), F.lit(HOST), F.col("text"))
    content = content_string(F.col("title"), F.col("description"), F.col("slug"))
    return pages.select(
        (F.col("doc_id") + 1).alias("doc_id"),
        "url",
        F.col("title").alias("novel_name"),
        "description",
        "source",
        F.lit("").alias("image_url"),
        F.size(tokens(content)).alias("doc_length"),
        F.lit(BEFORE).cast("timestamp_ntz").alias("last_crawled_at"),
        content_hash(content).alias("content_hash"),
    )


def stored_postings(spark, folder) -> DataFrame:
    stored = stored_documents(spark, folder)
    content = content_string(F.col("novel_name"), F.col("description"), slug_of(F.col("url")))
    return index_build.postings(stored.select("doc_id", content.alias("content"))).select("term", "doc_id", "frequency")


def incoming_pages(spark, folder) -> DataFrame:
    documents = texts(spark, folder, "documents")
    lang, text = F.col("lang"), F.col("text")
    changed = F.when(lang == "fr", F.concat(text, F.lit(" changed"))).otherwise(text)
    host = F.when(lang == "de", F.lit("https://new.example/")).otherwise(F.lit(HOST))
    last = _page(documents, host, changed).withColumn("fetch_seq", F.lit(2))
    stale = last.where(lang == "es").withColumns(
        {"description": F.concat(F.lit("stale "), "description"), "fetch_seq": F.lit(1)}
    )
    return last.unionByName(stale).drop("doc_id", "lang")


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _changes(spark, folder):
    return index_build.batch_changes(stored_documents(spark, folder), incoming_pages(spark, folder), _now())


def last_fetch_wins(spark, folder):
    """Events as fetches of an item's URL, of which the last counts."""
    fetches = table(spark, folder, "events").select(
        F.concat("event_type", F.lit("/"), "user_id").alias("url"), F.col("event_id").alias("fetch_seq"), "value"
    )
    return index_build.last_fetch(fetches)


def upsert_actions(spark, folder):
    return _changes(spark, folder).select("url", "doc_id", "action")


def _documents_after(spark, folder):
    return index_build.documents_after(stored_documents(spark, folder), _changes(spark, folder))


def upsert_documents(spark, folder):
    after = _documents_after(spark, folder)
    return after.withColumn("last_crawled_at", F.date_format("last_crawled_at", "yyyy-MM-dd")).withColumn(
        "doc_length", F.col("doc_length").cast("long")
    )


def upsert_postings(spark, folder):
    return index_build.postings_after(stored_postings(spark, folder), _changes(spark, folder))


def upsert_ngrams(spark, folder):
    stored = index_build.term_ngrams(stored_postings(spark, folder))
    return index_build.ngrams_after(stored, _changes(spark, folder))


def new_ids(spark, folder):
    """Ids for all pages of ``pages`` above the highest document id."""
    urls = texts(spark, folder, "pages").groupBy("url").agg(F.max("page_id").alias("page_id"))
    return index_build.with_new_ids(urls, stored_documents(spark, folder))


def _broken_store(spark, folder):
    """Stored documents with one URL per source, and postings of documents that are not stored."""
    documents = stored_documents(spark, folder).withColumn("url", F.concat(F.lit("https://one.example/"), "source"))
    documents = documents.withColumn("novel_name", F.col("description"))
    kept = documents.where(~F.col("description").contains("eau"))
    return kept, pinned(stored_postings(spark, folder))


def quality_report(spark, folder):
    documents, postings = _broken_store(spark, folder)
    long_terms = postings.withColumn("term", F.repeat("term", 40))
    ngrams = index_build.term_ngrams(postings).withColumn("term", F.repeat("term", 30))
    return quality.report(documents, long_terms, ngrams)


def repeated_urls(spark, folder):
    return quality.repeated_urls(_broken_store(spark, folder)[0])


def fk_check(spark, folder):
    documents, postings = _broken_store(spark, folder)
    return quality.orphans(postings, documents)


QUERIES = {
    "last_fetch_wins": last_fetch_wins,
    "upsert_actions": upsert_actions,
    "upsert_documents": upsert_documents,
    "upsert_postings": upsert_postings,
    "upsert_ngrams": upsert_ngrams,
    "new_ids": new_ids,
    "quality_report": quality_report,
    "repeated_urls": repeated_urls,
    "fk_check": fk_check,
}

_STORED = f"""stored AS (SELECT doc_id + 1 AS doc_id, 'https://docs.example/' || doc_id AS url,
  'Doc ' || doc_id AS novel_name, text AS description, source, '' AS image_url,
  'Doc ' || doc_id || ' ' || text || ' ' || doc_id AS content FROM documents),
st AS (SELECT *, sha256(content) AS content_hash, len({sql_tokens('content')}) AS doc_length FROM stored)"""
_POSTED = f"""posted AS (SELECT term, doc_id, count(*) AS frequency FROM
  (SELECT unnest({sql_tokens('content')}) AS term, doc_id FROM stored) GROUP BY ALL)"""
_CHANGES = f"""{_STORED}, inc AS (SELECT
    CASE WHEN lang = 'de' THEN 'https://new.example/' ELSE 'https://docs.example/' END || doc_id AS url,
    'Doc ' || doc_id AS novel_name, text || CASE WHEN lang = 'fr' THEN ' changed' ELSE '' END AS description, source,
    'https://img.example/' || doc_id AS image_url, doc_id AS slug, 2 AS fetch_seq FROM documents
  UNION ALL SELECT 'https://docs.example/' || doc_id, 'Doc ' || doc_id, 'stale ' || text, source,
    'https://img.example/' || doc_id, doc_id, 1 FROM documents WHERE lang = 'es'),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetch_seq DESC) AS rn FROM inc) WHERE rn = 1),
hashed AS (SELECT *, novel_name || ' ' || description || ' ' || slug AS content FROM lasts),
acted AS (SELECT h.*, sha256(h.content) AS content_hash, s.doc_id AS old_id, CASE WHEN s.doc_id IS NULL THEN 'new'
    WHEN s.content_hash = sha256(h.content) THEN 'unchanged' ELSE 'changed' END AS action
  FROM hashed h LEFT JOIN st s USING (url)),
changes AS (SELECT *, coalesce(old_id, (SELECT max(doc_id) FROM st) + row_number() OVER (
    PARTITION BY action = 'new' ORDER BY substr(sha1(url), 1, 3), url)) AS doc_id FROM acted)"""
_CHANGED_POSTINGS = f"""newp AS (SELECT term, doc_id, count(*) AS frequency FROM
  (SELECT unnest({sql_tokens('content')}) AS term, doc_id FROM changes WHERE action <> 'unchanged') GROUP BY ALL)"""
_BROKEN = f"""{_STORED}, {_POSTED}, broken AS (SELECT doc_id, 'https://one.example/' || source AS url,
  description AS novel_name, source FROM st WHERE NOT contains(description, 'eau'))"""
_GRAMS = f"(SELECT DISTINCT ngram, term FROM (SELECT unnest({sql_ngrams('term')}) AS ngram, term FROM {{}}))"

SQL = {
    "last_fetch_wins": """SELECT event_type || '/' || user_id AS url, max(event_id) AS fetch_seq,
  arg_max(value, event_id) AS value FROM events GROUP BY 1""",
    "upsert_actions": f"WITH {_CHANGES} SELECT url, doc_id, action FROM changes",
    "upsert_documents": f"""WITH {_CHANGES} SELECT s.doc_id, s.url,
  CASE WHEN c.action = 'changed' THEN c.novel_name ELSE s.novel_name END AS novel_name,
  CASE WHEN c.action = 'changed' THEN c.description ELSE s.description END AS description, s.source,
  CASE WHEN c.action = 'changed' THEN c.image_url ELSE s.image_url END AS image_url,
  CASE WHEN c.action = 'changed' THEN len({sql_tokens('c.content')}) ELSE s.doc_length END AS doc_length,
  CASE WHEN c.action IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_crawled_at,
  CASE WHEN c.action = 'changed' THEN c.content_hash ELSE s.content_hash END AS content_hash
FROM st s LEFT JOIN changes c ON c.old_id = s.doc_id
UNION ALL SELECT doc_id, url, novel_name, description, source, image_url, len({sql_tokens('content')}), '2024-02-01', content_hash
FROM changes WHERE action = 'new'""",
    "upsert_postings": f"""WITH {_CHANGES}, {_POSTED}, {_CHANGED_POSTINGS}
SELECT term, doc_id, frequency FROM posted WHERE doc_id NOT IN (SELECT doc_id FROM changes WHERE action = 'changed')
UNION ALL SELECT term, doc_id, frequency FROM newp""",
    "upsert_ngrams": f"""WITH {_CHANGES}, {_POSTED}, {_CHANGED_POSTINGS}
SELECT ngram, term FROM {_GRAMS.format('posted')} UNION SELECT ngram, term FROM {_GRAMS.format('newp')}""",
    "new_ids": """SELECT url, page_id, (SELECT max(doc_id) + 1 FROM documents) + row_number() OVER (
    ORDER BY substr(sha1(url), 1, 3), url) AS doc_id
FROM (SELECT url, max(page_id) AS page_id FROM pages GROUP BY url)""",
    "quality_report": f"""WITH {_BROKEN}, g AS (SELECT * FROM {_GRAMS.format('posted')})
SELECT 'documents.novel_name too long' AS check_name, count_if(length(novel_name) > 255)::BIGINT AS rows FROM broken
UNION ALL SELECT 'documents.source too long', count_if(length(source) > 255)::BIGINT FROM broken
UNION ALL SELECT 'documents.content_hash too long', 0
UNION ALL SELECT 'postings.term too long', count_if(length(term) * 40 > 255)::BIGINT FROM posted
UNION ALL SELECT 'ngrams.ngram too long', count_if(length(ngram) > 255)::BIGINT FROM g
UNION ALL SELECT 'ngrams.term too long', count_if(length(term) * 30 > 255)::BIGINT FROM g
UNION ALL SELECT 'documents.url repeated', count(*) FROM (SELECT url FROM broken GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'postings.doc_id without document', count(DISTINCT doc_id) FROM posted
  WHERE doc_id NOT IN (SELECT doc_id FROM broken)""",
    "repeated_urls": f"WITH {_BROKEN} SELECT url, count(*) AS copies FROM broken GROUP BY url HAVING count(*) > 1",
    "fk_check": f"WITH {_BROKEN} SELECT DISTINCT doc_id FROM posted WHERE doc_id NOT IN (SELECT doc_id FROM broken)",
}
