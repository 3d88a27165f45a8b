"""Pages to index tables: contents, postings, n-grams, and changes against a stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.html import fields, last_https
from pagequarry.functions.text import (
    char_ngrams,
    content_hash,
    content_string,
    term_counts,
    tokens,
)
from pagequarry.functions.urls import path_of, slug_of
from pagequarry.operators.ordered import first_rows
from pagequarry.operators.registry import path_allowed, with_site_config
from pagequarry.schemas import DOCUMENTS
from pagequarry.session import pinned

# Image fixes a registry row can name; each takes and gives a column.
IMAGE_FIXES = {"last_https": last_https}


def fixed_image(image: Column, fix_name: Column) -> Column:
    """The site's image fix, applied only to a non-empty image."""
    fixed = image
    for name, fix in IMAGE_FIXES.items():
        fixed = F.when((fix_name == name) & (image != ""), fix(image)).otherwise(fixed)
    return fixed


def item_pages(crawled: DataFrame, registry: DataFrame) -> DataFrame:
    """Fetched pages that belong in the index: the site is known and a pattern allows the path."""
    sited = with_site_config(crawled, registry, ["url"]).where(F.col("config").isNotNull())
    return sited.where(path_allowed(path_of(F.col("url")), F.col("config.allowindb")))


def parsed_pages(sited: DataFrame) -> DataFrame:
    """``title, description, source, image, slug`` of pages with ``url, html, config``."""
    kept = [c for c in sited.columns if c not in ("html", "config")]
    read = sited.select(*kept, "config", fields(F.col("html"), F.col("config.selectors")).alias("_f"))
    return read.select(
        *kept,
        "_f.title",
        "_f.description",
        F.col("config.name").alias("source"),
        fixed_image(F.col("_f.image"), F.col("config.image_fix")).alias("image"),
        slug_of(F.col("url")).alias("slug"),
    )


def with_content(pages: DataFrame) -> DataFrame:
    """Adds ``content`` and ``content_hash``."""
    content = content_string(F.col("title"), F.col("description"), F.col("slug"))
    return pages.withColumn("content", content).withColumn("content_hash", content_hash(F.col("content")))


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: ``doc_length`` (tokens with repeats), ``unique_terms`` and ``terms``."""
    read = texts.select(key, tokens(F.col(text)).alias("_tokens"))
    counted = read.select(
        key, F.size("_tokens").cast("long").alias("doc_length"), term_counts(F.col("_tokens")).alias("terms")
    )
    return counted.withColumn("unique_terms", F.size("terms").cast("long"))


def postings(texts: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """``term, doc_id, frequency, doc_length``, without a shuffle."""
    # explode would add a filter on the array's size, which the optimizer evaluates by counting
    # all terms a second time below; explode_outer adds none.
    each = token_counts(texts, key, text).select(F.explode_outer("terms").alias("_t"), key, "doc_length")
    return each.where(F.col("_t").isNotNull()).select("_t.term", key, "_t.frequency", "doc_length")


def distinct_terms(texts: DataFrame, text: str = "content") -> DataFrame:
    """``term``, each once; nothing is counted inside the texts."""
    each = texts.select(F.explode_outer(tokens(F.col(text))).alias("term"))
    return each.where(F.col("term").isNotNull()).distinct()


def vocabulary(terms: DataFrame) -> DataFrame:
    """Distinct terms with their document frequency (combined before the shuffle)."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_ngrams(terms: DataFrame, n: int = 3) -> DataFrame:
    """Distinct (ngram, term). Terms are made distinct first; what each then gives is distinct."""
    distinct = terms.select("term").distinct()
    return distinct.select(F.explode(F.array_distinct(char_ngrams(F.col("term"), n))).alias("ngram"), "term")


def ngram_multiset(terms: DataFrame, n: int = 3) -> DataFrame:
    """(ngram, term, copies): rows an insert per document and n-gram would have stored."""
    grams = vocabulary(terms).select(
        "term", "df", F.explode(char_ngrams(F.col("term"), n)).alias("ngram")
    )
    return grams.groupBy("ngram", "term").agg(F.sum("df").alias("copies"))


# --- changes ---------------------------------------------------------------------------------


def last_fetch(pages: DataFrame) -> DataFrame:
    """The last fetch of each URL in a batch wins."""
    return first_rows(pages, ["url"], [F.desc("fetch_seq")])


def with_actions(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``doc_id`` and ``action``: new, changed or unchanged by content hash. Of the stored
    documents the join reads only url, id and hash."""
    stored = documents.select("url", "doc_id", F.col("content_hash").alias("_old"))
    action = (
        F.when(F.col("doc_id").isNull(), "new")
        .when(F.col("_old") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    return pages.join(stored, "url", "left").withColumn("action", action).drop("_old")


def with_new_ids(rows: DataFrame, documents: DataFrame | int) -> DataFrame:
    """Ids above the highest stored one (read from the documents, or given) for rows without: dense, and
    the same in every run.

    Rows are numbered inside 4,096 buckets by URL hash; a table with one row per bucket gives each
    bucket's first number.
    """
    buckets = rows.withColumn("_bucket", F.substring(F.sha1("url"), 1, 3))
    sizes = buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    if isinstance(documents, int):
        highest = rows.sparkSession.range(1).select(F.lit(documents).alias("_highest"))
    else:
        highest = documents.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("_highest"))
    inside = Window.partitionBy("_bucket").orderBy("url")
    number = F.col("_highest") + F.col("_before") + F.row_number().over(inside)
    # 4,096 rows and one row.
    placed = buckets.join(F.broadcast(starts), "_bucket").crossJoin(F.broadcast(highest))
    return placed.withColumn("doc_id", number.cast("long")).drop("_bucket", "_before", "_highest")


def acted_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The pages that count of a batch, with content, hash, ``doc_id`` and ``action``.

    ``pages`` need ``url, title, description, source, image, slug, fetch_seq``.
    """
    return with_actions(with_content(last_fetch(pages)), documents)


def batch_changes(documents: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """One row per URL of the batch, as a document row with ``action`` and ``content``.

    The batch is pinned after its join with the stored documents, so that what follows does not
    join, or parse pages, again.
    """
    return changes_from(pinned(acted_pages(pages, documents)), documents, now)


def changes_from(acted: DataFrame, documents: DataFrame | int, now: Column) -> DataFrame:
    """Document rows from :func:`acted_pages` that lie on storage; of the documents only the highest id
    counts, which may be given instead."""
    fresh = with_new_ids(acted.where("action = 'new'").drop("doc_id"), documents)
    rows = acted.where("action <> 'new'").unionByName(fresh)
    return rows.select(
        "doc_id",
        "url",
        F.col("title").alias("novel_name"),
        "description",
        "source",
        F.col("image").alias("image_url"),
        # An unchanged page is not tokenised again.
        F.when(F.col("action") != "unchanged", F.size(tokens(F.col("content")))).alias("doc_length"),
        now.alias("last_crawled_at"),
        "content_hash",
        "action",
        "content",
    )


def documents_after(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Unchanged pages get only a new crawl time (also when their image differs); changed ones keep
    their id; new ones are added."""
    columns = DOCUMENTS.fieldNames()
    updates = changes.where("action <> 'new'").select(
        "doc_id", "action", F.struct(*columns).alias("_new")
    )
    replaced = [
        F.when(F.col("action") == "changed", F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        for c in columns
        if c not in ("doc_id", "url", "last_crawled_at")
    ]
    kept = documents.join(updates, "doc_id", "left").select(
        "doc_id",
        "url",
        *replaced,
        F.coalesce("_new.last_crawled_at", "last_crawled_at").alias("last_crawled_at"),
    )
    return kept.select(*columns).unionByName(changes.where("action = 'new'").select(*columns))


def changed_postings(changes: DataFrame) -> DataFrame:
    """Postings of new and changed pages."""
    return postings(changes.where("action <> 'unchanged'")).select("term", "doc_id", "frequency")


def postings_after(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Old postings of changed pages go, those of new and changed pages come."""
    gone = changes.where("action = 'changed'").select("doc_id")
    return stored.join(gone, "doc_id", "left_anti").select("term", "doc_id", "frequency").unionByName(
        changed_postings(changes)
    )


def ngrams_after(stored: DataFrame, changes: DataFrame, n: int = 3) -> DataFrame:
    """N-gram pairs only grow."""
    return stored.select("ngram", "term").unionByName(term_ngrams(changed_postings(changes), n)).distinct()


def apply_batch(
    documents: DataFrame, stored_postings: DataFrame, ngrams: DataFrame, pages: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a batch of pages; applying the batch again changes only crawl times."""
    changes = batch_changes(documents, pages, now)
    return (
        documents_after(documents, changes),
        postings_after(stored_postings, changes),
        ngrams_after(ngrams, changes),
    )
