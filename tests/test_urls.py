import hashlib
import random
from urllib.parse import unquote, urljoin

from pyspark.sql import functions as F

from pagequarry.functions import urls


def _apply(spark, expression, values):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, u STRING")
    return [r["v"] for r in df.select("i", expression(F.col("u")).alias("v")).orderBy("i").collect()]


URLS = [
    "https://h/a/#x",
    "https://h/a",
    "https://h/a//",
    "https://h/a.html;x=1?q#f",
    "https://h/",
    "https://h",
    "https://h/my-book_1.html",
    "https://h/list?page=2",
    "http://user@h:8080/p/q/?a=/b/#c#d",
    "https://h/a;b/c;d",
    "https://h/x?y/z-",
]


def test_normal_form_and_hash(spark):
    normal = [
        "https://h/a",
        "https://h/a",
        "https://h/a",
        "https://h/a.html;x=1?q",
        "https://h",
        "https://h",
        "https://h/my-book_1.html",
        "https://h/list?page=2",
        "http://user@h:8080/p/q/?a=/b",
        "https://h/a;b/c;d",
        "https://h/x?y/z-",
    ]
    assert _apply(spark, urls.normalised, URLS) == normal
    hashes = _apply(spark, urls.url_hash, URLS)
    assert hashes == [hashlib.sha1(n.encode()).hexdigest() for n in normal]


def test_path_slug_origin(spark):
    paths = ["/a", "/a", "/a", "/a.html", "", "", "/my-book_1.html", "/list", "/p/q", "/a;b/c", "/x"]
    assert _apply(spark, urls.path_of, URLS) == paths
    slugs = ["#x", "a", "a", "a.html;x=1?q#f", "h", "h", "my book 1.html", "list?page=2", "#c#d", "c;d", "z "]
    assert _apply(spark, urls.slug_of, URLS) == slugs
    assert _apply(spark, urls.origin_of, URLS) == 8 * ["https://h"] + ["http://user@h:8080"] + 2 * ["https://h"]


def _resolved(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i INT, b STRING, r STRING")
    df = df.withColumn("base", urls.base_parts(F.col("b")))
    one = df.select("i", urls.resolve(F.col("base"), F.col("r")).alias("v"))
    many = df.select("i", urls.resolve_all(F.col("base"), F.array("r"))[0].alias("w"))
    rows = one.join(many, "i").orderBy("i").collect()
    assert all(r["v"] == r["w"] for r in rows)
    return [r["v"] for r in rows]


def test_resolve_like_python(spark):
    bases = ["http://a/b/c/d;p?q", "https://h/", "https://h", "http://h/x/y.html#f", "http://h/x/?k=1"]
    refs = [
        "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../",
        "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g",
        "./g/.", "g/./h", "g/../h", "https://o/p", "http:g", "mailto:x@y", "javascript:void(0)", " /pad\n",
        "/a//b", "a b", "/a/../../b/", "#", "?",
    ]
    pairs = [(b, r) for b in bases for r in refs]
    wrong = [
        (p, got, urljoin(*p)) for p, got in zip(pairs, _resolved(spark, pairs)) if got != urljoin(*p)
    ]
    assert wrong == []


def test_resolve_random(spark):
    random.seed(9)
    pieces = ["a", "b", "..", ".", "/", "/", "?x=1", "#f", "c.html"]
    pairs = [
        ("https://h/p/q/r.html", "".join(random.choices(pieces, k=random.randint(1, 6)))) for _ in range(500)
    ]
    # An authority made by chance is covered above.
    pairs = [p for p in pairs if "//" not in p[1]]
    wrong = [(p, g) for p, g in zip(pairs, _resolved(spark, pairs)) if g != urljoin(*p)]
    assert not wrong


def test_percent_decoding(spark):
    values = ["/a%20b", "/a+b", "/100%", "/%zz%41", "/%C3%A9", "/plain", "%2B"]
    assert _apply(spark, urls.percent_decoded, values) == [unquote(v) for v in values]
