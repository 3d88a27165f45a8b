"""Every operator of pagequarry.llm against brute force on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagequarry.llm import (
    decontamination,
    embedding_dedup,
    html_extraction,
    language_id,
    license_scan,
    mixing,
    pii,
    queries,
    shingle_join,
    stages,
    token_counts,
    toxicity,
)
from pagequarry.llm.arrow import utf8
from pagequarry.llm.components import components

SMALL = "/root/testdata/sf0.001"
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Columns an operator might use for itself, in other capitals too.
CLASHING = "Key string, component int, guess string, base int, n long, threshold int, LEAKS string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def random_words(rng, n, vocabulary=2_000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, langs=None, sources=None):
    rows = []
    for k, t in enumerate(texts):
        lang = langs[k] if langs else "en"
        source = sources[k] if sources else f"s{k % 3}"
        rows.append((k, t, lang, source, len(t or ""), "x", 1, "g", 2, 3, 4, "l"))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and wordless texts, repeats, a long text, and a row without id, language, source."""
    texts = [None, "", "  \t ", "same words in this text here", "same words in this text here", "x" * 300_000]
    d = table(spark, [*texts, "ab " * 100_000], sources=["s", None, "s", "t", "t", None, "t"])
    return d.union(spark.createDataFrame([(None, "no id at all here", *[None] * 10)], DOCS))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- near duplicates ---------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(CAPITALS))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in ids}


def near_copies(rng, bases, copies, most):
    texts = []
    for _ in range(bases):
        base = random_words(rng, rng.randint(12, 60))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts


def test_shingle_join_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SEEN_OFTEN", 2)
    rng = random.Random(5)
    texts = near_copies(rng, 12, 12, 2)
    common = " ".join(random_words(rng, 30))
    texts += [f"{common} {' '.join(random_words(rng, rng.randint(2, 12)))}" for _ in range(40)]
    texts += [texts[0].upper(), "a b", "A  b", "a", None, "", texts[3], texts[3]]
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    want = brute_components(
        list(sets), lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    )
    got = by_id(shingle_join.groups(table(spark, texts)))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}


def test_shingle_join_awkward_and_empty(spark, awkward):
    got = shingle_join.groups(awkward).collect()
    assert len(got) == 8
    ids = {r["doc_id"]: r["component_id"] for r in got}
    assert ids[3] == ids[4] == 3 and ids[0] == 0 and ids[1] == 1 and ids[2] == 2 and ids[None] is None
    assert shingle_join.groups(awkward.limit(0)).collect() == []


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 60)), dtype=np.uint64))
        y = x[rng.random(len(x)) < 0.9]
        if len(y) and 100 * len(y) >= 75 * len(x):
            for order in range(shingle_join.ORDERS):
                assert set(shingle_join.prefix(x, order, none)[0]) & set(shingle_join.prefix(y, order, none)[0])


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (9, 8)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- embeddings --------------------------------------------------------------------------------


@pytest.mark.parametrize("margin", [embedding_dedup.MARGIN, 0.437])
def test_embeddings_against_brute_force(spark, monkeypatch, margin):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    near = x[rng.integers(0, 60, 200)] + rng.normal(scale=0.08, size=(200, 16))
    rows = [list(map(float, v)) for v in np.concatenate([x, near, np.repeat(x[:1], 30, axis=0)]).astype(np.float32)]
    y = np.array(rows)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15]
    rows += [*bad, [1.0, 2.0], [1.0, 2.0]]
    table = spark.createDataFrame([(k, v, k % 4) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = by_id(embedding_dedup.dedupe(table, margin=margin), "vec_id")
    want = brute_components(list(range(530)), lambda a, b: linked[a, b])
    assert [got[k]["n_links"] for k in range(530)] == linked.sum(axis=1).tolist()
    assert {k: got[k]["component_id"] for k in range(530)} == want
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(530, 536))
    assert got[536]["n_links"] == 1 and got[537]["component_id"] == 536 and not got[537]["kept"]
    assert embedding_dedup.dedupe(table.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.9, 0.7])
def test_embeddings_of_few_dimensions(spark, monkeypatch, threshold):
    monkeypatch.setattr(embedding_dedup, "CELL", 5)
    angle = np.random.default_rng(2).random(400) * 2 * np.pi
    rows = np.stack([np.cos(angle), np.sin(angle)], axis=1).astype(np.float32)
    table = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = by_id(embedding_dedup.dedupe(table, threshold=threshold), "vec_id")
    y = rows.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= threshold).sum(axis=1) - 1
    assert [got[k]["n_links"] for k in range(400)] == want.tolist()


def test_embedding_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = by_id(embedding_dedup.dedupe(rows), "vec_id")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    want = (m @ m.T >= 0.9).sum(axis=1) - 1
    assert [got[i]["n_links"] for i in ids] == want.tolist()


# --- language ----------------------------------------------------------------------------------


def test_code_lengths_are_those_of_the_trees():
    symbols, size = b"", 4
    text = np.array([0, 0, 0, 1, 2, 1, 2, 3, 1, 2, 1], np.int64)
    keys = [int(sum(text[k - j] * size**j for j in range(4))) for k in range(3, len(text))]
    key, n = np.unique(keys, return_counts=True)
    bits = language_id.code_lengths(key, n, size).reshape(-1, size)
    assert np.allclose(np.exp2(-bits).sum(axis=1), 1)
    counts = {}
    for k in range(3, len(text)):
        for order in range(4):
            counts.setdefault(tuple(text[k - order : k]), []).append(text[k])

    def chance(context, symbol, barred=frozenset()):
        """By recursion over the contexts, longest first."""

        def full(context):
            lower = full(context[1:]) if context else np.full(size, 1 / size)
            seen = counts.get(tuple(context))
            if not seen:
                return lower
            kinds = set(seen)
            out, rest = np.zeros(size), sum(lower[s] for s in range(size) if s not in kinds)
            escape = 0 if len(kinds) == size else len(kinds) / (len(seen) + len(kinds))
            for s in range(size):
                out[s] = seen.count(s) / len(seen) * (1 - escape) if s in kinds else lower[s] / rest * escape
            return out

        return full(list(context))[symbol]

    for context in itertools.product(range(size), repeat=3):
        place = int(sum(c * size ** (2 - j) for j, c in enumerate(context)))
        for s in range(size):
            assert np.isclose(2.0 ** -bits[place, s], chance(context, s), rtol=1e-5)
    assert symbols == b""


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = by_id(language_id.identify(docs))
    want = by_id(docs.select("doc_id", "lang"))
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 150
    assert sum(got[i]["lang_pred"] == want[i]["lang"] for i in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_awkward_and_empty(spark, awkward):
    got = language_id.identify(awkward).collect()
    assert len(got) == 8
    kinds = {r["doc_id"]: r["lang_pred"] for r in got}
    assert kinds[0] == kinds[1] == kinds[2] == "und" and kinds[3] == "en"
    assert language_id.identify(awkward.limit(0)).collect() == []
    unknown = awkward.withColumn("lang", awkward["source"].substr(0, 0).cast("string")).where("doc_id = 3")
    assert len(language_id.identify(unknown.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()) == 1


# --- tokens ------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, awkward):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    path = public_tokenizers.path(queries.TOKENIZER)
    rng = random.Random(2)
    parts = ["'s", "'re", "'l", "'ll", "'", " ", "  ", "\n", "\t", "a", "the", "E9", "½", "é", "!", "<|endoftext|>", "日本", "😀", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(3_000)]
    texts += [None, "", "a" * 3_000, " " * 500, "'" * 600, "ab'll " * 400]
    got = token_counts.counts(*utf8(pa.array(texts)), token_counts.counter(path))
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got.tolist() == want
    rows = token_counts.count_tokens(awkward, path, 1024).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows}[0] == (0, 0) and len(rows) == 8
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)
    assert token_counts.count_tokens(awkward.limit(0), path, 1).collect() == []


def test_state_maps_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 11, 5_000).astype(np.uint8)
    whole = token_counts.piece_starts(kinds)
    for size, known in ((1, 1), (7, 3), (6_000, 16)):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        monkeypatch.setattr(token_counts, "SYNCHRONISED", known)
        assert (token_counts.piece_starts(kinds) == whole).all()


# --- personal data -----------------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d) if d else False,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans_against_brute_force(spark, awkward):
    rng = random.Random(8)
    parts = ["a@b.cd", "x.y%z@q-r.s.t", "@", ".", "1.2.3.4", "999.1.2.3", "0001.002.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", " ", "-", "12", "é😀", "7992739871300", "\n", "+", "1" * 25]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [" ".join(f"n{k}@h.org" for k in range(900))]
    got = by_id(pii.digest(pii.detect(table(spark, texts))))
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[k]["spans"].split(","))
        assert got[k]["n_email"] == want.count("email:")
    assert len(pii.digest(pii.detect(awkward)).collect()) == 8
    assert pii.digest(pii.detect(awkward.limit(0))).collect() == []


def test_boosted_trees_add_rewritten_addresses(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [f"{word()} {rng.choice(['mail', 'to'])} {word()}{rng.choice(['', '.x'])}@{word()}.com {word()} code {rng.randrange(10**15, 10**16)}" for _ in range(300)]
    texts.append("please write to some.one (at) example.org today")
    got = by_id(pii.digest(pii.detect(table(spark, texts))))
    assert "email:16:41" in got[300]["spans"] and got[300]["n_email"] == 0


def test_obfuscated_forms_may_outnumber_base_ones(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    number = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    part = lambda: rng.randrange(1, 256)

    def card():
        head = number(15)
        return head + next(str(c) for c in range(10) if luhn(head + str(c)))

    base = [
        lambda: f"{word()}@{word()}.com",
        lambda: f"{part()}.{part()}.{part()}.{part()}",
        lambda: card(),
        lambda: f"+1 ({rng.randrange(200, 999)}) {number(3)}-{number(4)}",
    ]
    hidden = [
        ("email", lambda: f"{word()} at {word()} dot com"),
        ("email", lambda: f"{word()} (at) {word()}.org"),
        ("email", lambda: f"{word()} [at] {word()} [dot] org"),
        ("ip", lambda: f"{part()}[.]{part()}[.]{part()}[.]{part()}"),
        ("ip", lambda: "2001:db8:" + ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(6))),
        ("card", lambda: re.sub(r"(\d{4})(?=\d)", r"\1.", card())),
        ("phone", lambda: f"({rng.randrange(200, 999)}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"{rng.randrange(200, 999)}-{number(3)}-{number(4)}"),
        ("phone", lambda: f"0049 ({number(3)}) {number(7)}"),
    ]
    wrong = [
        lambda: re.sub(r"(\d{4})(?=\d)", r"\1.", str(int(card()) + 1)),
        lambda: f"{word()} at home.Then {word()}",
    ]
    texts = [f"{word()} say {make()} {word()}" for make in base for _ in range(20)]
    cases = [(kind, f"x{k} ", make()) for k in range(400) for kind, make in [hidden[k % len(hidden)]]]
    texts += [f"{a}|{b}| {word()}" for _, a, b in cases]
    texts += [f"{word()} |{make()}| {word()}" for make in wrong for _ in range(15)]
    got = by_id(pii.digest(pii.detect(table(spark, texts))))
    for k, (kind, a, b) in enumerate(cases, 80):
        assert f"{kind}:{len(a) + 1}:{len(a) + 1 + len(b)}" in got[k]["spans"].split(","), (b, got[k]["spans"])
    assert all(not got[k]["spans"] for k in range(480, len(texts)))


def test_redaction(spark, awkward):
    d = table(spark, ["mail a@b.cd now +1 (555) 123-4567", "nothing", None, "é1.2.3.4"])
    got = {r["doc_id"]: r for r in pii.redacted(d).collect()}
    assert [got[k]["text"] for k in range(4)] == ["mail [EMAIL] now [PHONE]", "nothing", None, "é[IP]"]
    assert pii.redacted(awkward).columns == awkward.columns


# --- mixing ------------------------------------------------------------------------------------


def test_mix_comes_near_its_targets(spark, awkward):
    rng = random.Random(3)
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "é", None]) for _ in range(4_000)]
    texts = [" ".join(["w"] * rng.randint(1, 40)) for _ in sources]
    d = table(spark, texts, sources=sources)
    rows = mixing.mix(d).collect()
    assert rows == sorted(rows, key=lambda r: rows.index(r)) and len(rows) == 4_000
    of = dict(enumerate(sources))
    taken, target, size = {}, {}, {}
    for r in rows:
        s = of[r["doc_id"]]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    order = ["a", "b", "c", "é", None]
    weight = dict(zip(order, [1, 2, 3, 1, 2], strict=True))
    want, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        share = left / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 3 * size[s] <= share * weight[s]}
        if not more:
            want = {s: 3 * size[s] if s in full else share * weight[s] for s in order}
            break
        full |= more
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= 40
    assert sorted(mixing.mix(d.repartition(7)).collect()) == sorted(rows)
    assert len(mixing.mix(awkward).collect()) == 8
    assert mixing.mix(awkward.limit(0)).collect() == []
    kept = mixing.mixed(d).collect()
    assert len(kept) == sum(r["copies"] > 0 for r in rows)


# --- decontamination ---------------------------------------------------------------------------


def edit_distance_inside(item, text):
    """Least edits between the item and any piece of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_full_alignment(spark):
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 6))) for _ in range(12)) for _ in range(6)]
    ready = decontamination.Items(list(range(6)), [decontamination.normal(t) for t in items])
    texts = []
    for k in range(60):
        s = list(items[k % 6])
        for _ in range(rng.randint(0, 12)):
            p = rng.randrange(len(s))
            s[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        texts.append(" ".join(["ten tea"] * rng.randint(0, 9)) + " " + "".join(s).upper() + "\n tail text")
    got = decontamination.regions(texts, ready)
    for t, found in zip(texts, got, strict=True):
        for which, text in enumerate(ready.texts):
            least = edit_distance_inside(text, decontamination.normal(t))
            have = [e for w, _, _, e in found if w == which]
            assert (min(have) if have else None) == (least if least <= ready.budget[which] else None)


def test_contaminated_documents(spark, awkward):
    benchmark = spark.createDataFrame(
        [(1, "An item that is rather long and quite unlike the rest."), (2, None), (3, ""), (None, "x"), (4, "tiny")],
        "item_id long, text string",
    )
    d = table(spark, ["so AN ITEM that is rather  long and quite unlike the rest. end", "clean text", "Tiny", "tiny thing", None])
    got = [(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(d, benchmark).collect()]
    assert sorted(got) == [(0, 1, 0), (2, 4, 0)]
    assert sorted(r["doc_id"] for r in decontamination.clean(d, benchmark).collect()) == [1, 3, 4]
    assert decontamination.clean(awkward, benchmark).count() == 8
    assert decontamination.contaminated(awkward, benchmark.limit(0)).collect() == []


# --- toxicity, licenses, pages -----------------------------------------------------------------


def test_severity_follows_the_labels(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), by_id(labels.where("doc_id % 2 = 1"))
    got = by_id(toxicity.severity(docs, train))
    assert len(got) == docs.count()
    right = [got[i]["toxic"] == (r["toxic"] == 1) for i, r in test.items()]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    assert len(toxicity.severity(awkward, labels.limit(0)).collect()) == 8
    assert toxicity.severity(docs.limit(0), labels).collect() == []


def test_ordinal_cuts_stay_in_order():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, 2_000)
    grade = np.searchsorted([2, 4, 6], x + rng.normal(scale=0.3, size=2_000))
    w, cuts = toxicity.fit_ordinal(np.arange(2_000), np.zeros(2_000, int), x.astype(float), grade, 1)
    assert w[0] > 0 and (np.diff(cuts) > 0).all()
    over = toxicity.chances(x * w[0], cuts).sum(axis=1)
    assert np.corrcoef(over, grade)[0, 1] > 0.9


def test_license_windows_against_brute_force(spark, awkward):
    rng = random.Random(4)
    templates = license_scan.Templates({})
    vocabulary = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()})
    for _ in range(200):
        text, label = rng.choice(license_scan.TEMPLATES)
        w = [x for x in text.split() if rng.random() < 0.95]
        words = [x.encode() for x in random_words(rng, 10) + w + rng.sample(vocabulary, 8)]
        got = {lab for *_, lab, _, _ in license_scan.windows(words, templates)}
        want = set()
        for t, lab in license_scan.TEMPLATES:
            own = {x.encode() for x in t.split()}
            n = len(t.split())
            if any(100 * len(own & set(words[s : s + n])) >= 80 * len(own) for s in range(len(words))):
                want.add(lab)
        assert got == want
    d = table(spark, ["Licensed under the Apache License, Version 2.0. And CC-BY 4.0", "no such thing", None, "MIT  license mit LICENSE"])
    got = by_id(license_scan.digest(license_scan.scan(d)))
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["base_labels"]) == (13, 2, "apache,cc-by")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["score"]) == (2, 0, 2, 1.0)
    assert (got[1]["n_base"], got[1]["labels"], got[1]["score"], got[2]["n_words"]) == (0, "", 0.0, 0)
    assert len(license_scan.scan(awkward).collect()) == 8
    assert license_scan.scan(awkward.limit(0)).collect() == []


def test_license_phrases_at_the_ends_of_texts(spark):
    parts = ["MIT License", "released under the MIT License", "license mit licensex", "words", "é", "7", "", None, "Apache License", "cc by", "x."]
    texts = [a for pair in itertools.product(parts, parts) for a in pair]
    got = by_id(license_scan.digest(license_scan.scan(table(spark, texts).coalesce(1))))
    for k, t in enumerate(texts):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(CAPITALS))
        want = sorted(
            p
            for phrase, _ in license_scan.PHRASES
            for p in range(len(words))
            if words[p : p + len(phrase.split())] == phrase.split()
        )
        assert (got[k]["n_base"], got[k]["first_word"]) == (len(want), want[0] if want else None), (k, t)


def test_best_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = html_extraction.best_run([float(x) for x in s])
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == best and (best > 0) == (b > a)


def test_pages(spark):
    body = "<p>First &amp; <b>bold</b><br>line.<p>Second\n  one.<ul><li>item one<li>item two</ul>"
    html = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Title here</h1>" + body +
        "<script>var a='<p>no</p>'</script><form><label>Mail</label></form><div class=ad>Buy this now</div>"
        "<p>Last words.</p><section id=comments><p>Reader says</p></section></article>"
        "<aside>More text here</aside><footer>&copy; us</footer></body></html>"
    )
    want = "Title here\n\nFirst & bold line.\n\nSecond one.\n\nitem one\n\nitem two\n\nLast words."
    rows = [(k, "u", html) for k in range(6)]
    rows += [(6, "u", None), (7, None, ""), (8, "u", "plain words only"), (9, "u", "<p" * 50_000), (10, "u", "<a x\"y '" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = by_id(html_extraction.extract(pages), "page_id")
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want)
    assert got[6]["text"] == got[7]["text"] == "" and got[8]["text"] == "plain words only"
    assert html_extraction.extract(pages.limit(0)).collect() == []


def test_wrappers_of_articles_are_no_noise():
    weights = dict.fromkeys(("div", "/div", "p", "/p", "h1", "/h1", "article", "/article"), -0.05)
    body = "<article><div class='entry-header'><h1>Title</h1></div><p>Some words of text.</p><div class='ad'>Buy</div></article>"
    for wrap in ("div class='page has-sidebar'", "div class='content no-sidebar'", "div class='layout with-footer'", "section class='search-page'", "div class='search results'", "form id=form"):
        page = f"<body><{wrap}>{body}</{wrap.split()[0]}><div class='related'><article><p>Other</p></article></div></body>"
        assert html_extraction.main_text(page, weights) == "Title\n\nSome words of text.", wrap


def test_noise_words_among_others():
    """Names of layouts and page builders take nothing out; names of what is beside the article do."""
    weights = dict.fromkeys(("div", "/div", "p", "/p", "h1", "/h1", "article", "/article"), -0.05)
    text = "Some words of text that go on for a while."
    whole = {
        f"<article><div class='elementor-widget-container'><p>{text}</p></div></article>",
        f"<article class='post-body social-sharing-enabled'><p>{text}</p></article>",
        f"<article><p class='form-text'>{text}</p><div class='share-buttons'>Share</div><ol class='comment-list'><li>No</ol></article>",
        f"<div id='wrapper' class='sidebar-right'><p>{text}</p><div class='sidebar'>Other</div><nav>{text * 9}</nav></div>",
        f"<div class='widget'><div class='banner-wide'><p>{text}</p></div></div>",
        f"<div><p>{text}</p></div><div class='comments'><p>{'First! ' * 40}</p></div>",
    }
    for page in whole:
        assert html_extraction.main_text(f"<body>{page}</body>", weights) == text, page
    formula = f"<article><p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>"
    assert html_extraction.main_text(formula, weights) == text + " x=2"


def test_pages_left_open_take_linear_time():
    import time

    n = 50_000
    pages = ["<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n, "<article>" * n, "<div class=ad>" * n + "<article>" * n,
             "<p><b>" * n + "<div>" * n, "<section class=ad>" * n + "words " * n]
    for page in pages:
        began = time.process_time()
        html_extraction.main_text(page, {})
        assert time.process_time() - began < 5, page[:20]


def test_pages_with_awkward_rows(spark):
    """Nulls in every column, repeated rows, an empty table and columns of other names."""
    html = "<article><p>One two three four.</p></article>"
    rows = [(1, None, html, "a"), (None, "u", html, None), (1, None, html, "a"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.extract(pages.selectExpr("*", "'w p' AS kind", "'x' AS n_chars"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    expected = [(None, None, "", 0), (None, "u", "One two three four.", 19)] + [(1, None, "One two three four.", 19)] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


# --- pipeline ----------------------------------------------------------------------------------


def test_stages_on_awkward_rows(spark, awkward):
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, awkward, SMALL)
        assert out.columns == awkward.columns, name
        assert {r["doc_id"] for r in out.select("doc_id").collect()} >= {3}, name
        assert stage(spark, awkward.limit(0), SMALL).collect() == []
    assert stages.mixed(spark, awkward.limit(0), SMALL).collect() == []


def test_pipeline_over_the_small_table(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(1 <= r["copies"] <= mixing.MOST_COPIES for r in rows)


def test_sql_of_the_mix(spark):
    from tests.oracle import compare, connect

    df = queries.op2_mixing(spark, SMALL)
    assert compare(df, queries.SQL["op2_mixing"], connect(SMALL))[1] is None
