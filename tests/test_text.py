import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagequarry.functions.text import char_ngrams, content_string, term_counts, tokens
from pagequarry.operators.index_build import ngram_multiset, postings, term_ngrams


def _tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    rows = df.select("i", tokens(F.col("text")).alias("t")).orderBy("i").collect()
    return [r["t"] for r in rows]


def test_token_edges(spark):
    texts = ["Café foo_bar x-1", "the THE the", "", "ét", "Kg", None]
    expected = [["x", "1"], ["the", "the", "the"], [], ["e", "t"], ["kg"], []]
    assert _tokens(spark, texts) == expected


def test_tokens_like_python(spark):
    random.seed(5)
    alphabet = "aZ09_- é́ß.ñ中\n²"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(400)]
    assert _tokens(spark, texts) == [re.findall(r"\b[a-z0-9]+\b", t.lower()) for t in texts]


def test_ngrams(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("aaaa",), ("hello",)], "w STRING")
    got = [r[0] for r in df.select(char_ngrams(F.col("w"))).collect()]
    assert got == [["ab"], ["abc"], ["aaa", "aaa"], ["hel", "ell", "llo"]]
    assert df.select(char_ngrams(F.col("w"), 4)).collect()[3][0] == ["hell", "ello"]


def test_content_string_keeps_both_blanks(spark):
    df = spark.createDataFrame([("A", None, "b")], "t STRING, d STRING, s STRING")
    assert df.select(content_string(F.col("t"), F.col("d"), F.col("s"))).first()[0] == "A  b"


def test_term_counts(spark):
    random.seed(6)
    lists = [[random.choice("abcdefg") for _ in range(n)] for n in (0, 1, 2, 30, 500)]
    df = spark.createDataFrame([(x,) for x in lists], "t ARRAY<STRING>")
    got = [dict(map(tuple, r[0])) for r in df.select(term_counts(F.col("t"))).collect()]
    assert got == [dict(Counter(x)) for x in lists]


def test_postings_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a b a")], "doc_id LONG, content STRING")
    plan = postings(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ngram_tables(spark):
    terms = spark.createDataFrame([("aaaa", 1), ("aaaa", 2), ("ab", 1)], "term STRING, doc_id LONG")
    assert sorted(map(tuple, term_ngrams(terms).collect())) == [("aaa", "aaaa"), ("ab", "ab")]
    assert sorted(map(tuple, ngram_multiset(terms).collect())) == [("aaa", "aaaa", 4), ("ab", "ab", 1)]
