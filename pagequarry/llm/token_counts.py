"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines count without building tokens:

* The *splitter* cuts text into pieces as the vocabulary's splitting pattern does. It has eleven
  states over classes of characters. A text is cut into chunks; every chunk computes its state map
  (the state it ends in, for each state it may begin in) in step with all other chunks; the maps
  compose through a parallel prefix scan, after which each chunk knows its first state and marks
  where pieces begin.
* The *counter* reads the bytes of a piece. The tokens of a prefix end in exactly one token, the one
  that may stand after the tokens before it, so a state needs only the last tokens at the places
  where a token can still begin. Each transition carries the number of tokens it adds or, where
  tokens join, takes away. States are compiled from the vocabulary when a text first needs them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagequarry.llm.arrow import steps, utf8

#: Counter states and counted pieces kept by a worker; beyond, they are dropped and compiled anew.
MOST_STATES, MOST_PIECES = 150_000, 600_000
#: Characters per chunk of the splitter.
CHUNK = 256
#: Characters after which a chunk is looked at for having forgotten its first state.
SYNCHRONISED = 16

# Classes of characters. The last four are letters that can follow an apostrophe in 's 't 'm 'd,
# 're 've, 'll; END closes a text.
LETTER, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, END, STMD, RV, L, E = range(11)
# States: what the piece being read is. AFTER: nothing (a piece just ended); QUOTE: an apostrophe
# that began a piece, alone so far; QUOTE_RV and QUOTE_L: and then r or v, or l; ONE and MANY: white
# space of one or more characters, ending in the blank (0x20) or in another space character.
AFTER, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_RV, QUOTE_L, ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE = range(11)
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state and class. Output HERE: a piece begins at this character;
    BEFORE: one begins at the character before."""
    step = np.zeros((11, 11), np.uint8)
    out = np.zeros((11, 11), np.uint8)
    letters = (LETTER, STMD, RV, L, E)

    def fresh(c: int) -> int:
        if c in letters:
            return LETTERS
        return {
            NUMBER: NUMBERS,
            SPACE: ONE_SPACE,
            BLANK: ONE_BLANK,
            OTHER: OTHERS,
            APOSTROPHE: QUOTE,
            END: AFTER,
        }[c]

    for c in range(11):
        for s in range(11):
            step[s, c], out[s, c] = fresh(c), HERE
        for s in (ONE_BLANK, ONE_SPACE, MANY_BLANK, MANY_SPACE):
            if c in (SPACE, BLANK):
                step[s, c], out[s, c] = (MANY_BLANK if c == BLANK else MANY_SPACE), 0
            elif c != END:
                joins = s in (ONE_BLANK, MANY_BLANK)  # the blank belongs to what follows
                if joins and c == APOSTROPHE:
                    step[s, c] = OTHERS
                out[s, c] = (0 if joins else HERE) | (BEFORE if s in (MANY_BLANK, MANY_SPACE) else 0)
        if c in letters:
            out[LETTERS, c] = 0
        if c == NUMBER:
            out[NUMBERS, c] = 0
        if c in (OTHER, APOSTROPHE):
            for s in (OTHERS, QUOTE):
                step[s, c], out[s, c] = OTHERS, 0
        if c == STMD:
            step[QUOTE, c], out[QUOTE, c] = AFTER, 0
        if c in (RV, L):
            step[QUOTE, c], out[QUOTE, c] = (QUOTE_RV if c == RV else QUOTE_L), 0
        for s, second in ((QUOTE_RV, E), (QUOTE_L, L)):
            if c == second:
                step[s, c], out[s, c] = AFTER, 0
            else:  # not a contraction: the letter began a piece
                step[s, c], out[s, c] = step[LETTERS, c], out[LETTERS, c] | BEFORE
    return step, out


_STEP, _OUT = splitter()
_CLASSES: list[np.ndarray] = []
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Class of every code point; built once per worker."""
    if not _CLASSES:
        kind_of = {"L": LETTER, "N": NUMBER}
        table = np.array(
            [kind_of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8
        )
        table[WHITE_SPACE] = SPACE
        for text, kind in ((" ", BLANK), ("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
            table[[ord(c) for c in text]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character (an END counts as one); ``kinds`` are classes."""
    count = -(-len(kinds) // CHUNK)
    lanes = np.full(count * CHUNK, END, np.uint8)
    lanes[: len(kinds)] = kinds
    lanes = np.ascontiguousarray(lanes.reshape(count, CHUNK).T)
    flat = _STEP.ravel()
    # State map of every chunk: row s is where state s leads. Almost every chunk forgets where it
    # began within a few characters; from there one state stands for all.
    maps = np.repeat(np.arange(11, dtype=np.uint8)[:, None], count, axis=1)
    for lane in lanes[:SYNCHRONISED]:
        maps = flat[maps * np.uint8(11) + lane]
    apart = np.flatnonzero((maps != maps[0]).any(axis=0))
    one, several = maps[0], maps[:, apart]
    for lane in lanes[SYNCHRONISED:]:
        one = flat[one * np.uint8(11) + lane]
        if len(apart):
            several = flat[several * np.uint8(11) + lane[apart]]
    maps = np.repeat(one[None, :], 11, axis=0)
    maps[:, apart] = several
    # Inclusive prefix scan of the composition, doubling the distance each round.
    distance = 1
    while distance < count:
        joined = np.take_along_axis(maps[:, distance:], maps[:, :-distance].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :distance], joined], axis=1)
        distance *= 2
    state = np.concatenate([[np.uint8(AFTER)], maps[AFTER, :-1]]).astype(np.uint8)
    marks = np.zeros((CHUNK, count), np.uint8)
    for k, lane in enumerate(lanes):
        at = state * np.uint8(11) + lane
        marks[k] = _OUT.ravel()[at]
        state = flat[at]
    marks = np.ascontiguousarray(marks.T).reshape(-1)
    begins = (marks & HERE) != 0
    begins[:-1] |= (marks[1:] & BEFORE) != 0
    return begins[: len(kinds)]


class Vocabulary:
    """Tokens as bytes, the rank of every merge, and the added tokens cut out of a text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Byte-level vocabularies write each byte as one visible character.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        as_byte = {chr(b): b for b in visible}
        hidden = [b for b in range(256) if b not in set(visible)]
        as_byte |= {chr(256 + k): b for k, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            return bytes(as_byte[c] for c in token)

        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        #: token -> (rank of the merge that makes it, its two parts)
        self.split = {}
        for k, (a, b) in enumerate(self.rank):
            self.split.setdefault(a + b, (k, a, b))
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}


class State(dict):
    """byte -> (next state, tokens added). ``tail`` are the last bytes at which a token can still
    begin, ``last`` the last token of the prefix ending at each place of the tail (None: the piece
    begins there), ``count`` the tokens up to there, relative to the end."""

    __slots__ = ("count", "last", "tail")


class Counter(dict):
    """piece -> number of tokens, by a transducer compiled as needed."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.begin = self.state(b"", (None,), (0,))

    def state(self, tail: bytes, last: tuple, count: tuple) -> State:
        key = (tail, last, count)
        found = self.states.get(key)
        if found is None:
            found = State()
            found.tail, found.last, found.count = key
            self.states[key] = found
        return found

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether ``left`` and ``right`` can be neighbours among the tokens of a text.

        The merges next to the border are undone, the latest first. The parts that met at the border
        in between would have merged if their merge came before the next merge on either side; of
        equal merges the one further left comes first.
        """
        rank, split = self.vocabulary.rank, self.vocabulary.split
        until = 1 << 40
        while True:
            if rank.get((left, right), 1 << 40) < until:
                return False
            made_left, made_right = split.get(left), split.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                until, left = made_left[0], made_left[2]
            else:
                until, right = made_right[0] + 1, made_right[1]

    def compile(self, state: State, byte: int) -> tuple[State, int]:
        """The transition of ``state`` under ``byte``."""
        text = state.tail + bytes([byte])
        for k in range(len(text)):  # the longest token that ends here and fits what stands before
            token = text[k:]
            if token in self.vocabulary.tokens and (
                state.last[k] is None or self.may_follow(state.last[k], token)
            ):
                break
        added = state.count[k] + 1
        keep = next(k for k in range(len(text) + 1) if not text[k:] or text[k:] in self.vocabulary.starts)
        last = (*state.last, token)[keep:]
        count = tuple(c - added for c in (*state.count, added)[keep:])
        made = state[byte] = (self.state(text[keep:], last, count), added)
        return made

    def __missing__(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state, total = self.begin, 0
        for byte in piece:
            state, added = state.get(byte) or self.compile(state, byte)
            total += added
            if len(self.states) > 2 * MOST_STATES:  # inside one very long piece
                old = state
                self.states = {}
                state = self.state(old.tail, old.last, old.count)
                self.begin = self.state(b"", (None,), (0,))
        if len(self) > MOST_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = total
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary(path))
    return _COUNTERS[path]


def counts(data: np.ndarray, offsets: np.ndarray, counter: Counter) -> np.ndarray:
    """Tokens of every text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    special = counter.vocabulary.special
    cut = re.compile(b"|".join(re.escape(s) for s in special)) if special else None
    for first, last in steps(offsets, 2 << 20):
        texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)]
        row, parts = list(range(first, last)), texts
        if cut and any(s in t for t in texts for s in special):
            row, parts = [], []
            for k, text in zip(range(first, last), texts, strict=True):
                pieces = cut.split(text)
                out[k] += len(pieces) - 1
                parts += pieces
                row += [k] * len(pieces)
        raw = b"\n".join(parts) + b"\n"
        flat = np.frombuffer(raw, np.uint8)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))  # byte of a character
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1  # bytes that separate the texts
        kinds = classes()[points]
        kinds[np.searchsorted(place, ends)] = END
        begins = place[np.flatnonzero(piece_starts(kinds) | (kinds == END))]
        is_end = np.zeros(len(flat), bool)
        is_end[ends] = True
        is_piece = ~is_end[begins]
        begin = begins[is_piece]
        stop = np.append(begins[1:], len(flat))[is_piece]
        found = np.fromiter(
            map(counter.__getitem__, [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]),
            np.int64,
            len(begin),
        )
        owner = np.asarray(row, np.int64)[np.searchsorted(ends, begin)]
        out += np.bincount(owner, weights=found, minlength=len(out)).astype(np.int64)
    return out


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text under the vocabulary file ``path``, which every executor can read.

    Special tokens written in a text count as one token each; null counts as empty, with 0 tokens.
    """

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = counter(path)
        for texts in batches:
            yield pa.array(counts(*utf8(texts), machine))

    return count(text)


def count_tokens(
    docs: DataFrame, path: str, limit: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row; repeated rows each."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
