import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import index_build, quality, search
from pagequarry.schemas import DOCUMENTS, NGRAMS, POSTINGS
from pagequarry.sources import store as stores

PAGE = "url STRING, title STRING, description STRING, source STRING, image STRING, slug STRING, fetch_seq LONG"
DAYS = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]


def _pages(spark, rows):
    """(url, description, image)"""
    made = [(u, "t", d, "src", i, u.split("/")[-1], n) for n, (u, d, i) in enumerate(rows)]
    return spark.createDataFrame(made, PAGE)


def _now(day):
    return F.lit(day).cast("timestamp_ntz")


def _sorted(df):
    return sorted(map(str, df.collect()))


FIRST = [("h/1", "one two", "a"), ("h/2", "two three", "a"), ("h/3", "x", "a"), ("h/3", "last three", "a")]
SECOND = [("h/1", "one two", "other image"), ("h/2", "changed words", "b"), ("h/9", "brand new", "c")]


def _check(documents, postings, ngrams):
    docs = {r["url"]: r for r in documents.collect()}
    assert set(docs) == {"h/1", "h/2", "h/3", "h/9"}
    assert sorted(r["doc_id"] for r in docs.values()) == [1, 2, 3, 4]
    assert docs["h/9"]["doc_id"] == 4
    assert (docs["h/1"]["image_url"], docs["h/1"]["last_crawled_at"]) == ("a", DAYS[1])
    assert (docs["h/2"]["description"], docs["h/2"]["image_url"]) == ("changed words", "b")
    assert (docs["h/3"]["description"], docs["h/3"]["last_crawled_at"]) == ("last three", DAYS[0])
    terms = {}
    for r in postings.collect():
        terms.setdefault(r["doc_id"], {})[r["term"]] = r["frequency"]
    for doc in docs.values():
        assert sum(terms[doc["doc_id"]].values()) == doc["doc_length"]
    assert set(terms[docs["h/2"]["doc_id"]]) == {"t", "changed", "words", "2"}
    pairs = {tuple(r) for r in ngrams.collect()}
    assert {("two", "two"), ("cha", "changed"), ("t", "t"), ("ree", "three")} <= pairs
    assert quality.orphans(postings, documents).count() == 0


def test_batches_as_tables(spark):
    tables = [spark.createDataFrame([], s) for s in (DOCUMENTS, POSTINGS, NGRAMS)]
    tables = index_build.apply_batch(*tables, _pages(spark, FIRST), _now(DAYS[0]))
    tables = index_build.apply_batch(*tables, _pages(spark, SECOND), _now(DAYS[1]))
    _check(*tables)
    again = index_build.apply_batch(*tables, _pages(spark, SECOND), _now(DAYS[1]))
    for before, after in zip(tables, again):
        assert _sorted(before) == _sorted(after)


def test_store_batches_replay_and_compaction(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    assert store.documents().count() == 0 and store.ngrams().count() == 0
    store.apply(0, _pages(spark, FIRST), _now(DAYS[0]))
    store.apply(1, _pages(spark, SECOND), _now(DAYS[1]))
    _check(store.documents(), store.postings(), store.ngrams())
    before = [_sorted(t) for t in (store.documents(), store.postings(), store.ngrams())]
    store.apply(1, _pages(spark, SECOND), _now(DAYS[1]))
    assert [_sorted(t) for t in (store.documents(), store.postings(), store.ngrams())] == before
    # A batch that never committed is not seen.
    store._write_terms(2, index_build.postings(spark.createDataFrame([(1, "ghost")], "doc_id LONG, content STRING")), None)
    assert store.postings(["ghost"]).count() == 0
    store.compact(3)
    assert store.batches() == [3]
    assert [_sorted(t) for t in (store.documents(), store.postings(), store.ngrams())] == before


def test_buckets_folded_one_by_one(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=64)
    assert store.fold(0) == []
    store.apply(0, _pages(spark, FIRST), _now(DAYS[0]))
    store.apply(1, _pages(spark, SECOND), _now(DAYS[1]))
    place = {u: stores.literal_bucket(u, 64) for u in ("h/1", "h/2", "h/3", "h/9")}
    assert len(set(place.values())) == 4
    assert store.segments() == {
        place["h/1"]: [0, 1], place["h/2"]: [0, 1], place["h/3"]: [0], place["h/9"]: [1]
    }
    before = [_sorted(t) for t in (store.documents(), store.postings(), store.ngrams())]
    # Only the buckets in two segments are folded; a second run finds none.
    assert store.fold(2) == sorted([place["h/1"], place["h/2"]])
    assert store.fold(3) == [] and store.segments()[place["h/1"]] == [2]
    assert [_sorted(t) for t in (store.documents(), store.postings(), store.ngrams())] == before
    # After folding, ids go on, and unchanged pages stay with their postings.
    store.apply(3, _pages(spark, [("h/1", "one two", "a"), ("h/4", "next", "a")]), _now(DAYS[2]))
    docs = {r["url"]: r for r in store.documents().collect()}
    assert (docs["h/4"]["doc_id"], docs["h/1"]["last_crawled_at"]) == (5, DAYS[2])
    assert store.postings(["one"]).count() == 1
    store.compact(4)
    assert store.batches() == [4] and store.documents().count() == 5


def test_batch_reads_only_its_own_buckets(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=64)
    store.apply(0, _pages(spark, [(f"h/{i}", f"word{i}", "a") for i in range(200)]), _now(DAYS[0]))
    touched = [stores.literal_bucket("h/7", 64)]
    read = store.versions(buckets=touched)
    assert read.where("url = 'h/7'").count() == 1
    assert {stores.literal_bucket(r["url"], 64) for r in read.collect()} == set(touched)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ngrams_of_known_terms_are_not_written_again(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.apply(0, _pages(spark, FIRST), _now(DAYS[0]))
    store.apply(1, _pages(spark, SECOND), _now(DAYS[1]))
    added = spark.read.parquet(store._folder("ngrams", 1)).select("term").distinct()
    assert {r[0] for r in added.collect()} == {"changed", "words", "brand", "new", "9"}
    assert store.ngrams().count() == store.ngrams().distinct().count()
    # An empty batch is a batch.
    store.apply(2, _pages(spark, FIRST).limit(0), _now(DAYS[2]))
    assert store.documents().count() == 4 and store.batches() == [0, 1, 2]


def test_store_reads_only_the_buckets_of_the_terms(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=8)
    store.apply(0, _pages(spark, FIRST), _now(DAYS[0]))
    hits = store.postings(["three"])
    assert {(r["term"], r["doc_length"]) for r in hits.collect()} == {("three", 4)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters: [" in plan
    words = spark.createDataFrame([("three",), ("é",)], "term STRING")
    buckets = [r[0] for r in words.select(stores.term_bucket(F.col("term"), 8)).collect()]
    assert buckets == [stores.literal_bucket("three", 8), stores.literal_bucket("é", 8)]


def test_hot_term_is_spread_over_files(spark, tmp_path):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("term"),
        F.col("id").alias("doc_id"),
        F.lit(1).cast("long").alias("frequency"),
    )
    path = str(tmp_path / "p")
    # At this size partitions would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stores.write_clustered(rows, path, "term", ["term", "doc_id"], 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(path).where("term = 'hot'").select(F.input_file_name()).distinct().count()
    assert files > 1 and spark.read.parquet(path).count() == 20000


def test_store_copy_stops_at_first_failure(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "index"), buckets=4)
    store.apply(0, _pages(spark, FIRST), _now(DAYS[0]))
    tables = {"documents": store.documents(), "inverted_index": store.postings(), "term_ngrams": store.ngrams()}
    write, read_back = stores.parquet_target(spark, str(tmp_path / "copy"))
    counts = stores.copy_store(tables, write, read_back)
    assert counts["documents"] == 3 and "image_url" not in read_back("documents").columns

    done = []

    def failing(name, df):
        if name == "inverted_index":
            raise OSError("disk")
        done.append(name)

    with pytest.raises(OSError):
        stores.copy_store(tables, failing, lambda name: tables[name])
    assert done == ["documents"]


def test_quality(spark):
    documents = spark.createDataFrame([(1, "u", "n", "s", "h"), (2, "u", "n" * 256, "s", "h")], "doc_id LONG, url STRING, novel_name STRING, source STRING, content_hash STRING")
    postings = spark.createDataFrame([("x" * 256, 1, 1), ("a", 5, 1)], POSTINGS)
    ngrams = spark.createDataFrame([("abc", "x" * 256)], NGRAMS)
    found = {r["check_name"]: r["rows"] for r in quality.report(documents, postings, ngrams).collect()}
    assert {k for k, v in found.items() if v} == {
        "documents.url repeated", "documents.novel_name too long", "postings.term too long",
        "ngrams.term too long", "postings.doc_id without document",
    }


def test_pruned_batch_search_equals_full(spark):
    """A word in every document and rare ones: the best k agree with scoring everything."""
    texts = [(i, " ".join(["the"] * (i % 7 + 1) + [f"w{i % 50}", f"v{i % 13}"] + ["pad"] * (i % 5))) for i in range(600)]
    documents = spark.createDataFrame(texts, "doc_id LONG, content STRING")
    hits = index_build.postings(documents)
    stats = search.corpus_stats(index_build.token_counts(documents, "doc_id", "content"))
    queries = spark.createDataFrame(
        [(1, "the w3 v3"), (2, "the"), (3, "pad the v1"), (4, "w7 nothing"), (5, "the pad")], "query_id INT, text STRING"
    )
    terms = search.query_terms(queries, "query_id", "text")
    for k in (1, 5, 30):
        full = search.top_k_per_query(search.scores(hits, stats, terms), k)
        pruned = search.top_k_per_query(search.batch_scores(hits, stats, terms, k), k)
        columns = ["query_id", "rank", "doc_id", "score"]
        assert _sorted(full.select(columns)) == _sorted(pruned.select(columns))
    salted = search.top_k_per_query(search.batch_scores(hits, stats, terms, 5, small=False), 5)
    plain = search.top_k_per_query(search.scores(hits, stats, terms, small=False), 5)
    assert _sorted(salted.select(columns)) == _sorted(plain.select(columns))
    assert search.batch_scores(hits, stats, terms, 1).count() < search.scores(hits, stats, terms).count()


def test_fuzzy_terms_equal_brute_force(spark, monkeypatch):
    """Words of few letters, so that n-grams are common, as few queries and as many."""
    random.seed(5)
    terms = sorted({"".join(random.choices("ab1", k=random.randint(1, 9))) for _ in range(400)})
    asked = terms[::9] + ["zzzz", "abzab", "", "aaaaaaaaaaaa"]

    def grams(word):
        return {word} if len(word) < 3 else {word[i : i + 3] for i in range(len(word) - 2)}

    ngrams = spark.createDataFrame([(g, t) for t in terms for g in grams(t)], NGRAMS)
    words = spark.createDataFrame([(w,) for w in asked + asked[:5]] + [(None,)], "query_term STRING")
    for threshold in (0.5, 0.8):
        expected = set()
        for word in asked:
            scored = [(round(2 * len(grams(word) & grams(t)) / (len(grams(word)) + len(grams(t))), 6), t) for t in terms]
            best = sorted(((-d, t) for d, t in scored if d >= threshold))[:5]
            expected |= {(word, t, -d, rank) for rank, (d, t) in enumerate(best, 1)}
        for small in (True, False):
            monkeypatch.setattr(search, "is_small", lambda df: small)
            got = search.similar_terms(ngrams, words, 5, threshold).select("query_term", "term", "dice", "rank")
            assert {tuple(r) for r in got.collect()} == expected
    assert search.similar_terms(ngrams.limit(0), words, 5).count() == 0


def test_fuzzy_batch_reads_texts_once_and_compares_few_pairs(spark):
    words = [f"{a}ab{b}cd{c}" for a in "pqrst" for b in "uvwxy" for c in "klmno"]
    ngrams = index_build.term_ngrams(spark.createDataFrame([(w,) for w in words], "term STRING"))
    query = spark.createDataFrame([(w[::-1],) for w in words] + [(w[1:],) for w in words], "query_term STRING")
    found = search.similar_terms(ngrams, query, 3)
    dice = {}
    for one in {w[::-1] for w in words} | {w[1:] for w in words}:
        for two in words:
            a, b = ({w[i : i + 3] for i in range(len(w) - 2)} for w in (one, two))
            dice.setdefault(one, []).append((-round(2 * len(a & b) / (len(a) + len(b)), 6), two))
    expected = {(q, t, -d) for q, of in dice.items() for d, t in sorted(of)[:3] if d <= -0.5}
    assert {(r["query_term"], r["term"], r["dice"]) for r in found.collect()} == expected and expected
    # Lambda functions in the join's condition would have it interpreted, pair by pair.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("lambda" in line for line in joins)


def test_distinct_terms_equal_the_terms_of_postings(spark):
    texts = spark.createDataFrame([(1, "One two two foo_bar"), (2, ""), (3, None), (4, "two caf\u00e9 3")], "doc_id LONG, content STRING")
    terms = sorted(r["term"] for r in index_build.distinct_terms(texts).collect())
    assert terms == ["3", "one", "two"]
    assert terms == sorted(r["term"] for r in index_build.postings(texts).select("term").distinct().collect())


def test_batch_scores_keep_only_documents_that_can_be_among_the_best(spark):
    rows = [("some", d, 1 + d % 2, 4) for d in range(20)] + [(t, d, 1, 4) for t in ("rare", "seldom") for d in (1, 2, 3)]
    rows += [("often", d, 1 + d % 3, 4) for d in range(300)]
    hits = spark.createDataFrame(rows, "term STRING, doc_id LONG, frequency LONG, doc_length LONG")
    stats = spark.createDataFrame([(400, 4.0)], "n_docs LONG, avg_length DOUBLE")
    asked = [(0, t) for t in ("some", "rare", "seldom", "often")] + [(1, "some"), (1, "often"), (2, "rare"), (3, "none")]
    queries = spark.createDataFrame(asked, "query_id INT, term STRING")
    for small in (True, False):
        some = search.batch_scores(hits, stats, queries, 3, small)
        whole = search.scores(hits, stats, queries, small=True)
        assert _sorted(search.top_k_per_query(some, 3)) == _sorted(search.top_k_per_query(whole, 3))
        assert some.where("query_id = 0").count() == 3
