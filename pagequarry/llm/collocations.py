"""Phrase collocation mining with stripes.

A stripe belongs to a prefix of words and is an associative counter of the words that follow it. Tasks
build stripes of what they read; stripes of one prefix are merged elementwise. One merged table a level
(prefixes of 0, 1, ... words) gives everything: its entries are the extensions, that is the phrases one
word longer with their frequencies; the sums are prefix totals (the total of the empty prefix is the
number of words); the largest entry of a prefix is the most frequent longer phrase that begins with it,
and the largest of the entries that agree but for their first word, the one that ends with it.

A level only counts where both phrases inside, without the last and without the first word, are frequent
themselves, as all others cannot be. That is asked of a bit map of frequent phrases, of at most
``MOST_BITS`` bits; what it lets through wrongly is counted and then found too rare.

Hot prefixes: the stripe of the empty prefix, and those of prefixes that have more than one in ``SHARE``
of all words (there are at most so many), are split into segments by a hash of the next word. Rows of one
segment are sorted together by Spark and merged while they stream past, so a task holds one segment. Rows
of a stripe have at most ``ROW_ENTRIES`` entries, their next words end to end.

Defined cases: a null text is empty; a null language counts as ``und``, together with texts marked so;
texts without words add nothing; repeated rows count again; ids are not read and may be null; ties are
settled as stated; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.arrow import steps, utf8
from pagequarry.operators.joins import lookup_join
from pagequarry.session import pinned

#: Least frequency of a phrase, most words of one, and phrases returned of each language.
LEAST, MOST_WORDS, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Segments of the empty prefix and of other hot ones, and the share that makes a prefix hot.
EMPTY_SEGMENTS, HOT_SEGMENTS, SHARE = 1024, 64, 10_000
ROW_ENTRIES = 256
#: Bytes of text one step counts.
STEP_BYTES = 8 << 20
#: Bits of the map of frequent phrases: so many a phrase, between these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Parts of a language ranked apart before the last ranking.
RANK_PARTS = 64

STRIPES = "lang string, prefix string, segment int, next string, count array<int>"
MERGED = "lang string, prefix string, next array<string>, count array<long>, hash array<long>, total long"

_BREAKS = np.zeros(256, bool)
_BREAKS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_BLANKS = _BREAKS.copy()
_BLANKS[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- hashes ------------------------------------------------------------------------------------


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def mixed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    out = (phrase ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def bit_places(hashes, bits: int) -> tuple:
    """The two bits of a phrase in a map of ``bits`` (a power of two)."""
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(34)) & np.uint64(bits - 1)


class Frequent:
    """A bit map that has every frequent phrase of one length."""

    def __init__(self, sent: Broadcast):
        self.map = np.frombuffer(sent.value, np.uint8)
        self.bits = len(self.map) * 8

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in bit_places(hashes, self.bits):
            place = place.astype(np.int64)
            found &= (self.map[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return found


def frequent_map(stripes: DataFrame) -> Broadcast:
    """The bit map of the entries of merged stripes. It has a fixed bound, whatever the table's size."""
    phrases = stripes.agg(F.coalesce(F.sum(F.size("hash")), F.lit(0))).first()[0]
    bits = min(max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, phrases * BITS_EACH)))), MOST_BITS)
    mask = F.lit(bits - 1)
    hashed = stripes.select(F.explode("hash").alias("hash"))
    low, high = F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 34).bitwiseAND(mask)
    place = hashed.select(F.explode(F.array(low + 1, high + 1)).alias("place"))
    parts = (
        place.groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
        .collect()
    )
    size = bits // 8
    out = bytearray(size)
    for part in parts:
        at = (part.part - 1) * 4096
        out[at : at + 4096] = part.map[: size - at]
    return stripes.sparkSession.sparkContext.broadcast(bytes(out))


# --- stripes of what a task reads --------------------------------------------------------------


class Words:
    """The words of a step of texts: a number for each place, its piece and its language."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        raw = _LOWER[raw]
        inside = ~_BLANKS[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
        ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
        # A piece ends at a break and at the end of a text.
        self.piece = np.cumsum(_BREAKS[raw] | edge[:-1])[starts]
        row = np.searchsorted(offsets, starts, side="right") - 1
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(raw[inside]))
        encoded = words.dictionary_encode()
        self.word, self.words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        named = langs.dictionary_encode()
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy()[row].astype(np.int64)
        texts = self.words.to_pylist()
        self.word_hash = word_hashes(texts)[self.word] if texts else np.zeros(0, np.uint64)
        self.lang_hash = word_hashes(self.langs.to_pylist())[self.lang] if texts else np.zeros(0, np.uint64)

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the phrase of ``size`` words that begins at each place it can."""
        last = max(0, len(self.word) - size + 1)
        out = self.lang_hash[:last]
        for k in range(size):
            out = mixed(out, self.word_hash[k : k + last])
        return out

    def places(self, size: int, frequent: Frequent | None) -> np.ndarray:
        """Places where a phrase of ``size`` words begins whose two shorter ones may be frequent."""
        last = max(0, len(self.word) - size + 1)
        whole = self.piece[:last] == self.piece[size - 1 :][:last]
        if frequent is not None:
            known = frequent.has(self.hashes(size - 1))
            whole &= known[:last] & known[1 : last + 1]
        return np.flatnonzero(whole)

    def stripes(self, size: int, frequent: Frequent | None, hot: np.ndarray) -> pa.RecordBatch | None:
        """Stripes of the prefixes of ``size`` - 1 words; ``hot`` are the hashes of the hot ones, sorted."""
        at = self.places(size, frequent)
        if not len(at):
            return None
        many = len(self.words)
        prefix = self.lang[at]
        for k in range(size - 1):
            _, prefix = np.unique(prefix * many + self.word[at + k], return_inverse=True)
        entry, where, count = np.unique(
            prefix * many + self.word[at + size - 1], return_index=True, return_counts=True
        )
        prefix, at = prefix[where], at[where]
        following = self.word[at + size - 1]
        if size == 1:
            segments = np.full(len(at), EMPTY_SEGMENTS)
        else:
            segments = np.where(np.isin(self.hashes(size - 1)[at], hot), HOT_SEGMENTS, 1)
        segment = (self.word_hash[at + size - 1] >> np.uint64(11)).astype(np.int64) % segments
        order = np.lexsort((segment, prefix))
        prefix, at, following, segment, count = (x[order] for x in (prefix, at, following, segment, count))
        new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (segment[1:] != segment[:-1])])
        begin = np.flatnonzero(new)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(rank % ROW_ENTRIES == 0)
        bounds = pa.array(np.append(begin, len(at)), pa.int32())
        first = at[begin]
        texts = [self.words.take(pa.array(self.word[first + k])).cast(pa.string()) for k in range(size - 1)]
        joined = pc.binary_join_element_wise(*texts, " ") if texts else pa.array([""] * len(first))
        return pa.RecordBatch.from_arrays(
            [
                self.langs.take(pa.array(self.lang[first])).cast(pa.string()),
                joined,
                pa.array(segment[begin], pa.int32()),
                pc.binary_join(
                    pa.ListArray.from_arrays(bounds, self.words.take(pa.array(following)).cast(pa.string())), " "
                ),
                pa.ListArray.from_arrays(bounds, pa.array(count, pa.int32())),
            ],
            ["lang", "prefix", "segment", "next", "count"],
        )


def hot_prefixes(level: DataFrame, words: int) -> np.ndarray:
    """Hashes of the phrases of merged stripes that have more than one in ``SHARE`` of all words: at most
    ``SHARE`` phrases of one length can."""
    each = level.select(F.explode(F.arrays_zip("count", "hash")).alias("entry"))
    rows = each.where(F.col("entry.count") > words // SHARE).select("entry.hash").collect()
    return np.sort(np.array([r.hash for r in rows], np.int64).view(np.uint64))


def stripes(texts: DataFrame, size: int, frequent: Broadcast | None, hot: np.ndarray) -> DataFrame:
    """Stripes of ``texts`` (lang, text) for phrases of ``size`` words, one part for each step."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(frequent) if frequent else None
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            langs = batch.column("lang")
            for first, last in steps(offsets, STEP_BYTES):
                at = offsets[first : last + 1]
                words = Words(raw[at[0] : at[-1]], at - at[0], langs.slice(first, last - first))
                found = words.stripes(size, known, hot)
                if found is not None:
                    yield from pa.Table.from_batches([found]).to_batches(max_chunksize=10_000)

    return texts.mapInArrow(count, STRIPES)


# --- merging -----------------------------------------------------------------------------------


def merged_rows(table: pa.Table, least: int) -> tuple[pa.RecordBatch, pa.Table]:
    """The merged stripes of a sorted part of the table but the last, and the last one as a table, as more
    of it may follow."""
    keys = [table.column(c).combine_chunks() for c in ("lang", "prefix", "segment")]
    rows = len(table)
    new = np.zeros(rows, bool)
    new[0] = True
    for key in keys:
        new[1:] |= pc.not_equal(key.slice(1), key.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    counts = table.column("count").combine_chunks()
    following = pc.split_pattern(table.column("next").combine_chunks(), " ").flatten()
    sizes = pc.list_value_length(counts).to_numpy()
    entries = pa.table({"group": np.repeat(group, sizes), "next": following, "count": counts.flatten()})
    merged = entries.group_by(["group", "next"]).aggregate([("count", "sum")]).sort_by("group")
    group, count = (merged.column(c).to_numpy() for c in ("group", "count_sum"))
    last = len(begin) - 1
    cut = int(np.searchsorted(group, last))
    tail = merged.slice(cut)
    carried = pa.table(
        {
            **{name: key.slice(begin[last], 1) for name, key in zip(("lang", "prefix", "segment"), keys, strict=True)},
            "next": pa.array([" ".join(tail.column("next").to_pylist())]),
            "count": pa.array([tail.column("count_sum").to_pylist()], pa.list_(pa.int64())),
        }
    )
    group, count, following = group[:cut], count[:cut], merged.column("next").combine_chunks().slice(0, cut)
    total = np.zeros(last, np.int64)
    np.add.at(total, group, count)
    often = count >= least
    group, count, following = group[often], count[often], following.filter(pa.array(often))
    langs, prefixes = (key.take(pa.array(begin[:last])) for key in keys[:2])
    hashes = phrase_hashes(langs, prefixes, group, following)
    bounds = pa.array(np.searchsorted(group, np.arange(last + 1)), pa.int32())
    out = pa.RecordBatch.from_arrays(
        [
            langs,
            prefixes,
            pa.ListArray.from_arrays(bounds, following),
            pa.ListArray.from_arrays(bounds, pa.array(count, pa.int64())),
            pa.ListArray.from_arrays(bounds, pa.array(hashes.view(np.int64))),
            pa.array(total, pa.int64()),
        ],
        ["lang", "prefix", "next", "count", "hash", "total"],
    )
    return out, carried


def phrase_hashes(langs: pa.Array, prefixes: pa.Array, group: np.ndarray, following: pa.Array) -> np.ndarray:
    """Hashes of the phrases that end in ``following``, each behind the prefix of its group."""
    used, which = np.unique(group, return_inverse=True)
    if not len(used):
        return np.zeros(0, np.uint64)
    rows = pa.array(used)
    out = word_hashes(langs.take(rows).to_pylist())
    words = [p.split(" ") if p else [] for p in prefixes.take(rows).to_pylist()]
    for k in range(len(words[0])):
        out = mixed(out, word_hashes([w[k] for w in words]))
    return mixed(out[which], word_hashes(following.to_pylist()))


def merged(parts: DataFrame, least: int, totals: bool) -> DataFrame:
    """Stripes merged elementwise, with entries of at least ``least`` and the total of all. Without
    ``totals``, stripes that keep no entry are left out."""
    keys = ["lang", "prefix", "segment"]
    ordered = parts.repartition(*keys).sortWithinPartitions(*keys)
    schema = pa.schema(
        [
            ("lang", pa.string()),
            ("prefix", pa.string()),
            ("segment", pa.int32()),
            ("next", pa.string()),
            ("count", pa.list_(pa.int64())),
        ]
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = schema.empty_table()
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_arrays(
                    [batch.column(f.name).cast(f.type) for f in schema], schema=schema
                )
                out, carried = merged_rows(pa.concat_tables([carried.cast(schema), rows]), least)
                yield out
        if len(carried):
            # A row that differs closes the last stripe.
            end = pa.table(
                {"lang": [""], "prefix": [""], "segment": [-1], "next": [""], "count": [[0]]}, schema=schema
            )
            yield merged_rows(pa.concat_tables([carried.cast(schema), end]), least)[0]

    found = ordered.mapInArrow(merge, MERGED)
    return found if totals else found.where(F.size("next") > 0)


# --- phrases -----------------------------------------------------------------------------------


def levels(texts: DataFrame, least: int, most_words: int) -> list[DataFrame]:
    """Merged stripes of phrases of 1, 2, ... words, each pinned."""
    out = [pinned(merged(stripes(texts, 1, None, np.zeros(0, np.uint64)), least, totals=True))]
    words = out[0].agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    for size in range(2, most_words + 1):
        parts = stripes(texts, size, frequent_map(out[-1]), hot_prefixes(out[-1], words))
        out.append(pinned(merged(parts, least, totals=False)))
    return out


def entries(level: DataFrame) -> DataFrame:
    """(lang, phrase, f) of merged stripes."""
    each = level.select("lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("entry"))
    phrase = F.when(F.col("prefix") == "", F.col("entry.next")).otherwise(F.concat_ws(" ", "prefix", "entry.next"))
    return each.select("lang", phrase.alias("phrase"), F.col("entry.count").alias("f"))


def subsuming(longer: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): the most frequent phrase that is longer by one word, behind or in front. If
    any longer phrase holds all places of a phrase, one that is longer by a word does."""
    parts = None
    for level in longer:
        behind = level.select("lang", F.col("prefix").alias("phrase"), F.array_max("count").alias("most"))
        front = entries(level).select(
            "lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), F.col("f").alias("most")
        )
        both = behind.union(front)
        parts = parts.union(both) if parts is not None else both
    return parts.groupBy("lang", "phrase").agg(F.max("most").alias("most"))


def scored(candidates: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, a) with the lowest-scoring cut: l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        F.concat_ws(" ", F.expr("slice(words, 1, k)")).alias("first"),
        F.concat_ws(" ", F.expr("slice(words, k + 1, size(words) - k)")).alias("rest"),
    )
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"])
    cuts = cuts.join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = lookup_join(cuts, sizes, "lang", ["phrase"], "inner")
    # Products may pass 64 bits: whole decimals, and a whole division.
    score = F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def best_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, ranked in parts before the parts' best are ranked."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    inside = Window.partitionBy("lang", "part").orderBy(*order)
    few = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(
    documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP
) -> DataFrame:
    """The best phrases of each language of ``documents`` (lang, text); see the module's docstring."""
    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    found = levels(texts, least, most_words)
    sizes = found[0].groupBy("lang").agg(F.sum("total").alias("n"))
    candidates = entries(found[1])
    for level in found[2:]:
        candidates = candidates.union(entries(level))
    known = entries(found[0])
    for level in found[1:-1]:
        known = known.union(entries(level))
    candidates = candidates.toDF("lang", "phrase", "a")
    if len(found) > 2:
        inside = subsuming(found[2:])
        candidates = candidates.join(inside, ["lang", "phrase"], "left")
        candidates = candidates.where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")
    ranked = best_of_each(scored(candidates, known, sizes), top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
