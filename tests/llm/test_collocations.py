"""Phrase collocations against a count of everything in plain Python, and against their SQL."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from pagequarry.llm import collocations, queries
from tests.oracle import compare, connect

DOCS = "doc_id long, text string, lang string, Prefix string, segment int, n long, PHRASE string"
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, least, most_words, top):
    f, n = {}, Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(CAPITALS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                counts.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(
                len(q) > len(p) and b >= a and any(q[k : k + len(p)] == p for k in range(len(q)))
                for q, b in often.items()
            ):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def documents(spark, texts):
    return spark.createDataFrame([(k, t, lang, "p", 1, 2, "x") for k, (t, lang) in enumerate(texts)], DOCS)


def check(spark, texts, least=3, most_words=5, top=50):
    rows = collocations.collocations(documents(spark, texts), least, most_words, top).collect()
    want = brute(texts, least, most_words, top)
    assert sorted(tuple(r) for r in rows) == want
    return want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = [*"abcdé", "A", "ÀB", "new york", "x\ty", "b.", "c,d", "\n", "e\x0bf", "\x00"]
    texts = [
        (" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]))
        for _ in range(60)
    ]
    assert check(spark, texts, least=4, top=200)


def test_awkward_texts(spark):
    texts = [(None, "en"), ("", "en"), (" \t ", None), (".,;", "en"), ("to be or not to be " * 50, "en")]
    texts += [("to be or not to be", "en")] * 3 + [("a a a a a a a a", "fr")] * 2 + [("x" * 100_000, "fr")]
    assert check(spark, texts)
    assert collocations.collocations(documents(spark, [])).collect() == []


def test_a_step_and_a_batch_may_end_anywhere(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROW_ENTRIES", 2)
    monkeypatch.setattr(collocations, "STEP_BYTES", 40)
    monkeypatch.setattr(collocations, "SHARE", 10)
    rng = random.Random(9)
    texts = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))), "en") for _ in range(40)]
    check(spark, texts)


def test_merging_in_pieces_is_merging_at_once():
    rows = [("en", "", 0, "a b", [1, 2]), ("en", "", 0, "a", [3]), ("en", "x", 0, "a", [5]), ("fr", "x", 0, "a", [7])]
    names = ["lang", "prefix", "segment", "next", "count"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64())]
    table = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})
    out, carried = collocations.merged_rows(table, 3)
    assert out.to_pydict()["next"] == [["a"], ["a"]] and out.to_pydict()["total"] == [6, 5]
    assert carried.to_pydict() == {"lang": ["fr"], "prefix": ["x"], "segment": [0], "next": ["a"], "count": [[7]]}


def test_frequent_map_has_every_phrase(spark):
    level = spark.createDataFrame([(list(range(k, k + 50)),) for k in range(0, 5_000, 50)], "hash array<long>")
    import numpy as np

    known = collocations.Frequent(collocations.frequent_map(level))
    assert known.has(np.arange(5_000, dtype=np.uint64)).all()


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows, difference = compare(queries.op11_collocations(spark, folder), queries.SQL["op11_collocations"], connect(folder))
    assert difference is None and rows > 0
