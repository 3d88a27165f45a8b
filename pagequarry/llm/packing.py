"""Best-fit packing of documents into sequences, by linear grouping.

A document is its token ids and a closing id 0. Longer documents than a sequence are cut into whole
sequences and a rest; every rest, and every shorter document, is packed with others:

1. Large pieces, from the longest on, are dealt into ``GROUPS`` groups of equal cardinality, and all
   lengths of a group count as its longest one. What is large is tried at a few thresholds (``PARTS``);
   the plan with the fewest sequences counts.
2. For these few sizes the mix of configurations (how many pieces of each size share a sequence) that
   needs the fewest sequences is optimised: a linear program, its columns generated by a knapsack. Whole
   parts of the solution are taken.
3. Real pieces are substituted into the planned places, the last place of a sequence taking the longest
   piece that its real room holds; so rounding up leaves no slivers.
4. What is left over of the large pieces, and all small ones, go from long to short to the sequence with
   the least room that holds them; a new one is opened only where none does.

There are no more lengths than ``capacity``, so the number of pieces of each length says all the planner
needs, and like sequences are planned as one row with a count. Work and memory of the plan depend on the
capacity and not on the number of documents. The plan deals places by length and number: a piece's
number among those of its length (numbered inside the tasks that cut the texts, plus a running sum over
tasks) gives its sequence and offset by arithmetic. No sequence is ever gathered anywhere.

Tokens come from the library, which is asked once for each distinct word of a step: the tokenizer drops
blanks and no token crosses one, so a text's ids are those of its words end to end. Plain words (ASCII
and Latin-1 letters, digits, signs) are cut into runs here, as its rules say, and only new runs go to the
library's model; all other words go through the whole library.

Defined cases: a null, empty or blank text is one piece of the single id 0; rows with a null or repeated
id are packed like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.arrow import steps, utf8
from pagequarry.session import pinned

CAPACITY = 2048
#: A piece is large if it is more than one of so many parts of a sequence; the best plan counts. With two
#: parts each configuration is a single piece, and all else is best fit.
PARTS = (8, 4, 3, 2)
#: Groups of equal cardinality, so sizes that configurations are made of.
GROUPS = 64
#: Configurations tried beyond the first ones; any number gives a valid plan.
MOST_COLUMNS = 1_000
#: Words whose ids a task remembers, and the longest word it does so for.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64

#: Words whose normal form is their lower case and whose runs need no Unicode tables: no apostrophe
#: (contractions), and nothing that may begin a special token.
_PLAIN = re.compile(r"(?:[!-&(-;=-~À-ÖØ-öø-ÿ]|<(?!\|))+")
_RUNS = re.compile(r"\n|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
#: The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the
#: next one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
_BYTE_LEVEL = str.maketrans({b: chr(256 + k) for k, b in enumerate(_HIDDEN)})

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# --- tokens and pieces -------------------------------------------------------------------------


class WordTokens:
    """Ids of words by the tokenizer file ``path``, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"\n": b""}

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, from those of their runs. A line feed, which no word has, parts them."""
        runs = _RUNS.findall("\n".join(words).lower())
        new = list(dict.fromkeys(r for r in runs if r not in self.runs))
        shown = "\n".join(new).encode().decode("latin-1").translate(_BYTE_LEVEL).split(_BYTE_LEVEL[10])
        for run, text in zip(new, shown if new else [], strict=True):
            self.runs[run] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        out, word = [], []
        for run in runs:
            if run == "\n":
                out.append(b"".join(word))
                word = []
            else:
                word.append(self.runs[run])
        return [*out, b"".join(word)] if words else []

    def encode(self, words: list[str]) -> list[bytes]:
        """32-bit ids of each word."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        if len(self.runs) > CACHE_WORDS:
            self.runs = {"\n": b""}
        plain, odd = [], []
        for word in words:
            if word not in self.known:
                (plain if _PLAIN.fullmatch(word) else odd).append(word)
        fresh = dict(zip(plain, self.plain(plain), strict=True))
        found = self.library.encode_batch_fast(odd, add_special_tokens=False)
        fresh.update((w, array("I", e.ids).tobytes()) for w, e in zip(odd, found, strict=True))
        ids = [self.known[w] if w in self.known else fresh[w] for w in words]
        self.known.update((w, i) for w, i in fresh.items() if len(w) <= CACHE_LENGTH)
        return ids


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs without blanks, as a dictionary, and for each text the number of its first one (with the
    total at the end)."""
    inside = ~np.isin(raw, np.frombuffer(b" \t\n\r", np.uint8))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(raw[inside]))
    return words.dictionary_encode(), np.searchsorted(starts, offsets)


def token_ids(raw: np.ndarray, offsets: np.ndarray, tokens: WordTokens) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text's ids begin (with the total at the end)."""
    words, first = words_of(raw, offsets)
    encoded = tokens.encode(words.dictionary.to_pylist())
    ids = np.frombuffer(b"".join(encoded), np.uint32)
    sizes = np.array([len(e) // 4 for e in encoded], np.int64)
    places = np.cumsum(sizes) - sizes
    which = words.indices.to_numpy()
    size = sizes[which]
    ends = np.cumsum(size)
    where = np.repeat(places[which] - (ends - size), size) + np.arange(int(size.sum()))
    return ids[where], np.concatenate([[0], ends])[first]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document cut into pieces of at most ``capacity`` tokens, each numbered among the pieces of
    its length in its task (``chunk``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        tokens = WordTokens(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for first, last in steps(offsets):
                at = offsets[first : last + 1]
                ids, begins = token_ids(raw[at[0] : at[-1]], at - at[0], tokens)
                rows, numbers, starts, lengths, sums, places = [], [], [], [], [], []
                for k in range(last - first):
                    own = np.append(ids[begins[k] : begins[k + 1]], np.uint32(0)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append(first + k)
                        numbers.append(piece)
                        starts.append(start)
                        lengths.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        places.append(int(seen[len(part)]))
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(rows, pa.int64())).cast(pa.int64()),
                        pa.array(numbers, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array([chunk] * len(rows), pa.int32()),
                        pa.array(places, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "number"],
                )

    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


# --- the plan ----------------------------------------------------------------------------------


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to put into one sequence for the most worth: the best with one piece, then
    with one more at a time, as many as of the smallest size fit."""
    longest = np.array(sizes)
    room = np.arange(capacity + 1) - longest[:, None]
    value = np.zeros(capacity + 1)
    chosen = []
    for _ in range(capacity // int(longest.min())):
        gain = np.where(room >= 0, value[np.maximum(room, 0)] + worth[:, None], -1.0)
        best = gain.argmax(axis=0)
        more = gain[best, np.arange(capacity + 1)]
        better = more > value + 1e-12
        chosen.append(np.where(better, best, -1))
        value = np.where(better, more, value)
    counts, left = np.zeros(len(sizes), np.int64), capacity
    for best in reversed(chosen):
        if best[left] >= 0:
            counts[best[left]] += 1
            left -= sizes[best[left]]
    return counts


def configurations(sizes: list[int], numbers: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(sequences, pieces of each size in one) of the linear program's solution, rounded down. Together
    they never hold more pieces of a size than there are."""
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(numbers, float)
    for _ in range(MOST_COLUMNS):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)
        column = best_configuration(sizes, worth, capacity).astype(float)
        if worth @ column <= 1 + 1e-9:
            break
        amount, change = inverse @ need, inverse @ column
        ratio = np.full(len(sizes), np.inf)
        up = change > 1e-9
        ratio[up] = np.maximum(amount[up], 0) / change[up]
        basis[:, int(ratio.argmin())] = column
    left = np.array(numbers, np.int64)
    plan = []
    amounts = np.floor(np.linalg.solve(basis, need) + 1e-6)
    for k in np.argsort(-amounts, kind="stable"):
        config = np.rint(basis[:, k]).astype(np.int64)
        fits = left[config > 0] // config[config > 0]
        times = int(min(amounts[k], fits.min())) if len(fits) else 0
        if times > 0:
            left -= times * config
            plan.append((times, config))
    return plan


def grouped(large: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """(length, pieces) from long to short, dealt into groups of equal cardinality: the longest length of
    each group, with its pieces."""
    total = sum(count for _, count in large)
    out: dict[int, int] = {}
    done, group, size = 0, -1, 0
    for length, count in large:
        while count:
            if done * groups // total > group:
                group, size = done * groups // total, length
            end = -(-(group + 1) * total // groups)
            now = min(count, end - done)
            out[size] = out.get(size, 0) + now
            done += now
            count -= now
    return out


def substituted(large: list[tuple[int, int]], capacity: int, groups: int = GROUPS):
    """Sequences of ``large`` pieces, from long to short, as (count, ((length, pieces in one), ...)), and the pieces left over.

    A planned place takes the longest piece that is left and no longer than planned; the last place of a
    sequence, the longest one for the room there really is."""
    if not large:
        return [], []
    sizes = grouped(large, groups)
    order = sorted(sizes, reverse=True)
    have = np.zeros(capacity + 1, np.int64)
    for length, count in large:
        have[length] = count
    rows = []
    for times, config in configurations(order, [sizes[s] for s in order], capacity):
        planned = [size for size, n in zip(order, config, strict=True) for _ in range(n)]
        while times:
            inside: dict[int, int] = {}
            room = capacity
            for k, size in enumerate(planned):
                there = np.flatnonzero(have[: (room if k == len(planned) - 1 else size) + 1])
                if len(there):
                    length = int(there[-1])
                    inside[length] = inside.get(length, 0) + 1
                    have[length] -= 1
                    room -= length
            if not inside:
                break
            for length, n in inside.items():
                have[length] += n
            same = min(times, *(int(have[length]) // n for length, n in inside.items()))
            for length, n in inside.items():
                have[length] -= same * n
            rows.append((same, tuple(sorted(inside.items(), reverse=True))))
            times -= same
    return rows, [(int(length), int(have[length])) for length in np.flatnonzero(have)[::-1]]


def best_fit(rows, left: list[tuple[int, int]], capacity: int):
    """Adds the pieces ``left`` (from long to short) to the sequences ``rows``: each goes where it leaves
    the least room, into a new sequence only where it fits nowhere."""
    by_room: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    for times, inside in rows:
        by_room[capacity - sum(length * n for length, n in inside)].append((times, inside))
    for length, count in left:
        for room in range(length, capacity + 1):
            each = room // length
            while count and by_room[room]:
                times, inside = by_room[room].pop()
                full = min(times, count // each)
                if full:
                    by_room[room - each * length].append((full, (*inside, (length, each))))
                    count -= full * each
                if full < times:
                    rest = times - full
                    if count:
                        by_room[room - count * length].append((1, (*inside, (length, count))))
                        rest, count = rest - 1, 0
                    if rest:
                        by_room[room].append((rest, inside))
                    break
            if not count:
                break
        each = capacity // length
        if count >= each:
            by_room[capacity - each * length].append((count // each, ((length, each),)))
            count %= each
        if count:
            by_room[capacity - count * length].append((1, ((length, count),)))
    return [row for same in by_room for row in same]


def plan(numbers: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
    """All sequences for ``numbers[length]`` pieces, as (count, ((length, pieces in one), ...))."""
    whole = numbers.get(capacity, 0)
    order = sorted((item for item in numbers.items() if item[0] < capacity and item[1]), reverse=True)
    best = None
    for parts in PARTS:
        large = [item for item in order if item[0] * parts > capacity]
        small = [item for item in order if item[0] * parts <= capacity]
        planned, left = substituted(large, capacity, groups)
        rows = best_fit(planned, left + small, capacity)
        if best is None or sum(r[0] for r in rows) < sum(r[0] for r in best):
            best = rows
    return [(whole, ((capacity, 1),))] * bool(whole) + best


def places(rows, capacity: int) -> dict[str, np.ndarray]:
    """The plan by piece: pieces of a length from number ``first`` on stand ``each`` to a sequence, from
    sequence ``base`` and offset ``at`` on. Sorted by ``key`` (length and first)."""
    given = [0] * (capacity + 1)
    runs = []
    base = 0
    for times, inside in rows:
        at = 0
        for length, each in inside:
            runs.append((length, given[length], base, at, each))
            given[length] += times * each
            at += length * each
        base += times
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "base", "at", "each"), columns, strict=True))


# --- the operator ------------------------------------------------------------------------------


def numbered(cut: DataFrame) -> DataFrame:
    """Pieces with their number among all pieces of the same length; nothing but one row a task and
    length is sorted."""
    counts = cut.groupBy("length", "chunk").agg((F.max("number") + 1).alias("pieces"))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "chunk", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    return cut.join(starts, ["length", "chunk"]).withColumn("number", F.col("number") + F.col("before"))


def placed(cut: DataFrame, runs: dict[str, np.ndarray], capacity: int) -> DataFrame:
    """Pieces (numbered by length) with their sequence and offset."""
    # At most ``capacity`` lengths a sequence and a bounded number of rows in the plan: safe to send.
    sent = cut.sparkSession.sparkContext.broadcast(runs)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        starts = np.searchsorted(runs["length"], np.arange(capacity + 2))
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            k = np.empty(len(length), np.int64)
            for size in np.unique(length):
                low, high = starts[size], starts[size + 1]
                mine = length == size
                k[mine] = low + np.searchsorted(runs["first"][low:high], number[mine], side="right") - 1
            inside = number - runs["first"][k]
            sequence = runs["base"][k] + inside // runs["each"][k]
            offset = runs["at"][k] + inside % runs["each"][k] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    return cut.mapInArrow(look_up, PLACED)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Place of every piece of every document (doc_id, text); see the module's docstring."""
    cut = pinned(pieces(documents, tokenizer, capacity))
    # One row a length: at most ``capacity``.
    found = cut.groupBy("length").agg(F.count(F.lit(1)).alias("pieces")).collect()
    rows = plan({r.length: r.pieces for r in found}, capacity)
    return placed(numbered(cut), places(rows, capacity), capacity)
