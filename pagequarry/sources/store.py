"""The index on disk: documents, postings and n-grams in segments, one per committed batch.

A batch writes its segment folders and then one commit row; readers see only committed batches.
Running a batch again overwrites its own folders with the same rows, so replays are harmless. A
batch writes what it changed (of an unchanged page only the crawl time) and never rewrites the store.

Documents lie in buckets by URL, n-grams in buckets by n-gram, and the commit row holds the highest
id and the buckets a batch wrote: a batch reads the stored rows of its own buckets only.
:meth:`IndexStore.fold` folds the document segments of some buckets, :meth:`IndexStore.compact` all
segments of all tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions.text import char_ngrams, content_string
from pagequarry.functions.urls import slug_of
from pagequarry.operators import index_build
from pagequarry.operators.joins import is_small
from pagequarry.operators.ordered import first_rows
from pagequarry.schemas import DOCUMENTS, NGRAMS, POSTINGS

BUCKETS = 256
# ``version`` is the batch a document's postings are in; folding documents leaves it as it is.
VERSIONS = T.StructType([*DOCUMENTS.fields, T.StructField("version", T.IntegerType())])
TOUCHED = T.StructType([DOCUMENTS["doc_id"], DOCUMENTS["url"], DOCUMENTS["last_crawled_at"]])
BUCKET_LIST = T.ArrayType(T.IntegerType())
COMMIT = (
    T.StructType().add("compacted", "boolean").add("written", BUCKET_LIST).add("folded", BUCKET_LIST).add("highest", "long")
)


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def literal_bucket(term: str, buckets: int = BUCKETS) -> int:
    """:func:`term_bucket` of a known word, so a filter on it prunes folders when planned."""
    return zlib.crc32(term.encode()) % buckets


def write_clustered(df: DataFrame, path: str, column: str, order: list[str], buckets: int) -> None:
    """Parquet in folders by bucket of ``column``, sorted by ``order``.

    Rows are range-partitioned on the whole order, so a term with a third of all postings is spread
    over many tasks and files, and each file covers a narrow range for min/max skipping.
    """
    bucketed = df.withColumn("bucket", term_bucket(F.col(column), buckets))
    (
        bucketed.repartitionByRange("bucket", *order)
        .sortWithinPartitions("bucket", *order)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


class IndexStore:
    """Reads and grows an index below ``root``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def commits(self, before: int | None = None) -> list:
        """One small row for each committed batch, in their order."""
        schema = T.StructType([*COMMIT.fields, T.StructField("batch", T.IntegerType())])
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/commits").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r for r in rows if before is None or r["batch"] < before), key=lambda r: r["batch"])

    def batches(self, before: int | None = None) -> list[int]:
        """Committed batches that count, the newest compacted one first."""
        commits = self.commits(before)
        base = max((r["batch"] for r in commits if r["compacted"]), default=-1)
        return [r["batch"] for r in commits if r["batch"] >= base]

    def segments(self, before: int | None = None) -> dict[int, list[int]]:
        """For each bucket of documents the batches that hold rows of it and count."""
        held: dict[int, list[int]] = {}
        for row in self.commits(before):
            if row["compacted"]:
                held = {}
            for bucket in row["written"]:
                held.setdefault(bucket, []).append(row["batch"])
            held.update({bucket: [row["batch"]] for bucket in row["folded"]})
        return held

    def _none(self, schema: T.StructType) -> DataFrame:
        places = [T.StructField(name, T.IntegerType()) for name in ("batch", "bucket")]
        return self.spark.createDataFrame([], T.StructType([*schema.fields, *places]))

    def _segments(self, table: str, schema: T.StructType, batches: list[int]) -> DataFrame:
        none = self._none(schema)
        if not batches:
            return none
        rows = self.spark.read.schema(none.schema).parquet(f"{self.root}/{table}")
        return rows.where(F.col("batch").isin(batches))

    def _bucket_rows(
        self, table: str, schema: T.StructType, held: dict[int, list[int]]
    ) -> DataFrame:
        """Rows of the buckets of ``held`` from their segments that count; other folders are not read."""
        if not held:
            return self._none(schema)
        alike: dict[int, list[int]] = {}
        for bucket, batches in held.items():
            alike.setdefault(batches[0], []).append(bucket)
        rows = self._segments(table, schema, sorted({b for batches in held.values() for b in batches}))
        live = F.lit(False)
        for first, buckets in alike.items():
            live = live | ((F.col("batch") >= first) & F.col("bucket").isin(buckets))
        return rows.where(live)

    def versions(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Current documents (of the given buckets) as last written, with the ``version`` their postings
        are in. One row a URL: the result is partitioned by URL, as a join with a batch needs it."""
        return self._versions(self._held(before, buckets))

    def _held(self, before: int | None, buckets: list[int] | None) -> dict[int, list[int]]:
        held = self.segments(before)
        return held if buckets is None else {b: held[b] for b in buckets if b in held}

    def _versions(self, held: dict[int, list[int]], urls: DataFrame | None = None) -> DataFrame:
        rows = self._bucket_rows("documents", VERSIONS, held).drop("bucket")
        if urls is not None:
            rows = rows.join(urls, "url", "left_semi")
        several = any(len(batches) > 1 for batches in held.values())
        return (first_rows(rows, ["url"], [F.desc("batch")]) if several else rows).drop("batch")

    def _current(self, held: dict[int, list[int]]) -> DataFrame:
        touches = self._bucket_rows("touched", TOUCHED, held)
        latest = touches.groupBy("url").agg(F.max("last_crawled_at").alias("_touched"))
        rows = self._versions(held).join(latest, "url", "left")
        return rows.withColumn(
            "last_crawled_at", F.greatest("last_crawled_at", "_touched")
        ).select(*VERSIONS.fieldNames())

    def documents(self, before: int | None = None) -> DataFrame:
        """Current documents, with the crawl times of pages found unchanged since."""
        return self._current(self.segments(before)).drop("version")

    def postings(self, terms: list[str] | None = None, before: int | None = None) -> DataFrame:
        """Live postings with ``doc_length``. For given ``terms`` only their buckets are read."""
        rows = self._segments("postings", POSTINGS, self.batches(before))
        if terms is not None:
            wanted = sorted({literal_bucket(t, self.buckets) for t in terms})
            rows = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
        live = self.versions(before).select("doc_id", "doc_length", F.col("version").alias("batch"))
        return rows.join(live, ["doc_id", "batch"]).select("term", "doc_id", "frequency", "doc_length")

    def ngrams(self, before: int | None = None) -> DataFrame:
        """Distinct (ngram, term): a batch adds the pairs of terms the store did not have."""
        return self._segments("ngrams", NGRAMS, self.batches(before)).select("ngram", "term")

    def apply(self, batch: int, pages: DataFrame, now: Column) -> None:
        """Indexes ``pages`` as batch number ``batch``, against the state before it.

        The batch's contents are staged first, then joined with the stored documents of the buckets
        they fall in; of these only rows of the batch's URLs are kept before anything is shuffled,
        where the URLs are few enough to be broadcast. The highest id comes from the commit rows.
        """
        content = index_build.with_content(index_build.last_fetch(pages))
        read = self._staged(batch, "contents", content)
        touched = self._buckets_of(read.select(term_bucket(F.col("url"), self.buckets)))
        urls = read.select("url")
        stored = self._versions(
            self._held(batch, touched), F.broadcast(urls) if is_small(urls) else urls
        )
        staged = self._staged(batch, "acted", index_build.with_actions(read, stored))
        commits = self.commits(batch)
        highest = commits[-1]["highest"] if commits else 0
        changes = index_build.changes_from(staged, highest, now)
        same = F.col("action") == "unchanged"
        written = changes.where(~same).withColumn("version", F.lit(batch)).select(*VERSIONS.fieldNames())
        self._write_documents("documents", batch, written)
        self._write_documents("touched", batch, changes.where(same).select(*TOUCHED.fieldNames()))
        fresh = self.spark.read.schema(VERSIONS).parquet(self._folder("documents", batch))
        content = content_string(F.col("novel_name"), F.col("description"), slug_of(F.col("url")))
        self._write_terms(batch, index_build.postings(fresh.select("doc_id", content.alias("content"))), None)
        top = fresh.agg(F.max("doc_id")).first()[0]
        self._commit(batch, written=touched, highest=max(highest, top or 0))

    def _staged(self, batch: int, step: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/staged/{step}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _buckets_of(self, bucket: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(row[0] for row in bucket.distinct().collect())

    def _write_documents(self, table: str, batch: int, rows: DataFrame) -> None:
        write_clustered(rows, self._folder(table, batch), "url", ["url"], self.buckets)

    def fold(self, batch: int, most: int = 1) -> list[int]:
        """Folds the documents of every bucket that lies in more than ``most`` segments into one segment,
        as batch number ``batch``; gives these buckets. Other buckets, postings and n-grams stay as they
        are."""
        held = {b: batches for b, batches in self.segments(batch).items() if len(batches) > most}
        if held:
            self._write_documents("documents", batch, self._current(held))
            self._commit(batch, folded=sorted(held), highest=self.commits(batch)[-1]["highest"])
        return sorted(held)

    def compact(self, batch: int) -> None:
        """All live rows as one new batch; older segments are no longer read."""
        held, commits = self.segments(batch), self.commits(batch)
        documents = self._current(held).withColumn("version", F.lit(batch))
        self._write_documents("documents", batch, documents)
        self._write_documents("touched", batch, self.spark.createDataFrame([], TOUCHED))
        self._write_terms(batch, self.postings(before=batch), self.ngrams(before=batch))
        self._commit(batch, compacted=True, written=sorted(held), highest=commits[-1]["highest"] if commits else 0)

    def _write_terms(self, batch: int, postings: DataFrame, ngrams: DataFrame | None) -> None:
        columns, path = POSTINGS.fieldNames(), self._folder("postings", batch)
        write_clustered(postings.select(*columns), path, "term", ["term", "doc_id"], self.buckets)
        if ngrams is None:
            terms = self.spark.read.schema(POSTINGS).parquet(path).select("term").distinct()
            ngrams = index_build.term_ngrams(self._new_terms(batch, terms))
        write_clustered(ngrams, self._folder("ngrams", batch), "ngram", ["ngram", "term"], self.buckets)

    def _new_terms(self, batch: int, terms: DataFrame) -> DataFrame:
        """Terms whose n-grams the store does not have. A stored term has all its n-grams there, so one
        lookup by the first n-gram tells, in the buckets of the batch's first n-grams."""
        first = terms.select(F.element_at(char_ngrams(F.col("term")), 1).alias("ngram"), "term")
        first = self._staged(batch, "terms", first)
        touched = self._buckets_of(first.select(term_bucket(F.col("ngram"), self.buckets)))
        stored = self._segments("ngrams", NGRAMS, self.batches(batch)).where(F.col("bucket").isin(touched))
        known = stored.join(F.broadcast(first) if is_small(first) else first, ["ngram", "term"], "left_semi")
        return first.join(known.select("term"), "term", "left_anti")

    def _commit(
        self, batch: int, compacted: bool = False, written: list[int] = (), folded: list[int] = (), highest: int = 0
    ) -> None:
        row = self.spark.createDataFrame([(compacted, list(written), list(folded), highest)], COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(self._folder("commits", batch))


# Parents first; documents without image_url, as the copy has always been.
COPIED = {
    "documents": [c for c in DOCUMENTS.fieldNames() if c != "image_url"],
    "inverted_index": POSTINGS.fieldNames(),
    "term_ngrams": NGRAMS.fieldNames(),
}


def copy_store(
    tables: dict[str, DataFrame],
    write: Callable[[str, DataFrame], None],
    read_back: Callable[[str], DataFrame],
) -> dict[str, int]:
    """Copies the three tables in order; each is complete before the next begins, and the first
    that fails or comes back with another row count ends the copy. Returns the row counts."""
    counts = {}
    for name, columns in COPIED.items():
        table = tables[name].select(*columns)
        write(name, table)
        expected, counts[name] = table.count(), read_back(name).count()
        if counts[name] != expected:
            raise RuntimeError(f"{name}: {counts[name]} rows copied of {expected}")
    return counts


def parquet_target(spark: SparkSession, root: str):
    """``write`` and ``read_back`` for a folder of Parquet tables."""
    return (
        lambda name, df: df.write.mode("errorifexists").parquet(f"{root}/{name}"),
        lambda name: spark.read.parquet(f"{root}/{name}"),
    )


def jdbc_target(spark: SparkSession, options: dict[str, str]):
    """``write`` and ``read_back`` for a database whose driver is on the class path."""
    return (
        lambda name, df: df.write.format("jdbc").options(dbtable=name, **options).mode("append").save(),
        lambda name: spark.read.format("jdbc").options(dbtable=name, **options).load(),
    )
