"""Best-fit packing against the tokenizer library and plain rules of a packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagequarry.llm import packing, queries

PATH = public_tokenizers.path(queries.PACKING_TOKENIZER)
DOCS = "doc_id long, text string, Chunk int, number string, length long"


def sequences(numbers, capacity, rows):
    """The number of sequences, after checking that they hold exactly the pieces given."""
    held = {}
    for times, inside in rows:
        assert times > 0 and sum(length * n for length, n in inside) <= capacity
        for length, n in inside:
            held[length] = held.get(length, 0) + times * n
    assert held == {length: n for length, n in numbers.items() if n}
    return sum(times for times, _ in rows)


@pytest.mark.parametrize("seed", range(40))
def test_plan_holds_every_piece_and_wastes_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 500])
    numbers = {}
    for _ in range(rng.choice([0, 1, 5, 100, 1_000])):
        length = rng.randint(1, capacity)
        numbers[length] = numbers.get(length, 0) + rng.choice([1, 1, 7])
    rows = packing.plan(numbers, capacity)
    n = sequences(numbers, capacity, rows)
    decreasing = packing.best_fit([], sorted(numbers.items(), reverse=True), capacity)
    assert n <= 1.02 * sequences(numbers, capacity, decreasing) + 1


def test_configurations_beat_plain_best_fit():
    numbers = {length: 20 + length % 7 for length in range(600, 901)}
    n = sequences(numbers, 2048, packing.plan(numbers))
    assert n < 0.97 * sequences(numbers, 2048, packing.best_fit([], sorted(numbers.items(), reverse=True), 2048))


def test_like_sequences_are_one_row_at_any_size():
    numbers = {length: 1_000 + length % 13 for length in range(1, 2049)}
    more = {length: n * 1_000_003 for length, n in numbers.items()}
    small, large = packing.plan(numbers), packing.plan(more)
    assert sequences(more, 2048, large) <= 1.001 * sum(k * n for k, n in more.items()) / 2048
    assert len(large) < 10_000 and len(small) < 10_000


def check(documents, placed, capacity):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    rows = placed.collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values(), default=0) <= capacity
    return used


def test_pack_awkward_rows(spark):
    texts = [None, "", " \t\n", "A b  c", "A b  c", "x" * 5_000, "word " * 3_000, "it's <|endoftext|>ok", "Ⅷ é́ ́x"]
    rows = [(k, t, 1, "n", 2) for k, t in enumerate(texts)] + [(None, "no id", 1, "n", 2), (3, "again", 1, "n", 2)]
    check([r[:2] for r in rows], packing.pack(spark.createDataFrame(rows, DOCS), PATH, 64), 64)
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_pack_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    used = check(documents.select("doc_id", "text").collect(), packing.pack(documents.repartition(5), PATH), 2048)
    assert len(used) <= 1.02 * sum(used.values()) / 2048 + 1


@pytest.mark.parametrize(
    "parts",
    [
        [*" \t\n\r\x0b\x0c\x85\xa0eE'sΣς1٣字İ.!\x00ﬁ가̣́　﻿", "<|endoftext|>", "<|", "👍🏽"],
        [*" aBz09ÀéßÿØ×÷ªµ²<|>.,-_~'[]", "<|endoftext|>", "<|startoftext|>", "the", "THE", "é"],
    ],
)
def test_words_with_odd_characters(parts):
    rng = random.Random(2)
    library, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = packing.token_ids(raw, np.array([0, len(raw)]), tokens)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_byte_of_a_plain_run_is_known():
    library, tokens = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    for code in [*range(33, 127), *range(192, 256)]:
        for text in (chr(code), f"ab{chr(code)}cd", chr(code) * 3):
            assert np.frombuffer(tokens.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
