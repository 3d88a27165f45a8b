"""Language identification by prediction by partial matching.

Every language has a context tree over bytes: for each context of up to ``ORDER`` symbols, how often
each symbol followed it. A symbol is coded in the longest context known to the language; a symbol new
to a context is reached by an escape, whose probability is that of method C (distinct symbols over
symbols plus distinct symbols), and then coded in the next shorter context over the symbols not
already ruled out. The statistics are frozen after training, so the code length of a text is a sum of
table entries: the trees are compiled into one table of code lengths, indexed by the last symbols.

Bytes are folded before: ASCII capitals to small letters, and bytes beyond the most frequent ones of
the training texts to one symbol. The language with the shortest code is predicted; the score is its
posterior probability under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagequarry.llm.arrow import steps, utf8
from pagequarry.session import pinned

ORDER = 3
#: Entries of the compiled table over all languages; bounds a worker's memory (4 bytes each).
TABLE_ENTRIES = 1 << 24
#: Expected training texts per language, and most languages learned (the most frequent).
ROWS_PER_LANGUAGE = 3_000
MAX_LANGUAGES = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``symbols`` maps bytes to symbols below ``size``; ``counts`` has per language the keys of
    (context, symbol) of full length and how often they occurred."""

    languages: tuple[str, ...]
    size: int
    symbols: bytes
    counts: tuple[tuple[np.ndarray, np.ndarray], ...]


def alphabet_size(languages: int) -> int:
    return max(2, min(64, int((TABLE_ENTRIES / max(1, languages)) ** (1 / (ORDER + 1)))))


def folded_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def choose_symbols(histogram: np.ndarray, size: int) -> bytes:
    """Symbol of each byte: 1.. for the most frequent folded bytes (ties: smaller byte), 0 for the rest."""
    fold = folded_bytes()
    weight = np.bincount(fold, weights=histogram, minlength=256)
    order = [b for b in sorted(range(256), key=lambda b: (-weight[b], b)) if weight[b] > 0]
    symbol = np.zeros(256, np.uint8)
    for k, byte in enumerate(order[: size - 1]):
        symbol[byte] = k + 1
    return symbol[fold].tobytes()


def gram_keys(data: np.ndarray, offsets: np.ndarray, symbols: bytes, size: int):
    """(keys, padded offsets, is_text): one key per padded position. Every text is preceded by
    ``ORDER`` symbols 0, so that its first bytes have a context and no text sees its neighbour."""
    rows = len(offsets) - 1
    at = offsets + ORDER * np.arange(1, rows + 2)
    padded = np.zeros(len(data) + ORDER * rows, np.int32)
    is_text = np.ones(len(padded), bool)
    pads = (at[:-1, None] - ORDER + np.arange(ORDER)).ravel()
    is_text[pads] = False
    padded[is_text] = np.frombuffer(symbols, np.uint8)[data]
    keys = padded.copy()
    for back in range(1, ORDER + 1):
        keys[back:] += padded[:-back] * np.int32(size**back)
    return keys, at - ORDER, is_text


def code_lengths(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Bits of every (context of ORDER symbols, symbol) for one language."""
    full = np.bincount(keys, weights=counts, minlength=size ** (ORDER + 1)).astype(np.float64, copy=False)
    lower = np.full((1, size), 1.0 / size)
    for order in range(ORDER + 1):
        # counts of (context of this order, symbol): sums over the symbols further back
        own = full if order == ORDER else full.reshape(-1, size ** (order + 1)).sum(axis=0)
        own = own.reshape(-1, size)
        seen = own > 0
        rest = np.tile(lower, (own.shape[0] // lower.shape[0], 1))
        rest[seen] = 0.0
        total, kinds = own.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        mass = rest.sum(axis=1, keepdims=True)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        escape = np.where(kinds == size, 0.0, escape)
        # In place: these are the largest arrays of the operator.
        own /= np.maximum(total, 1)
        own *= 1 - escape
        rest /= np.where(mass > 0, mass, 1)
        rest *= escape
        own += rest
        lower = own
    np.log2(lower, out=lower)
    return np.negative(lower, out=lower).ravel().astype(np.float32)


def compiled(model: Model) -> np.ndarray:
    """Table (key, language) of code lengths. A task builds its own and lets it go when it ends: kept for
    the life of a worker, it would take its memory from the stages that follow."""
    table = np.empty((model.size ** (ORDER + 1), len(model.languages)), np.float32)
    for k, (keys, counts) in enumerate(model.counts):
        table[:, k] = code_lengths(keys, counts, model.size)
    return table


def text_bits(data: np.ndarray, offsets: np.ndarray, model: Model, table: np.ndarray) -> np.ndarray:
    """Code length of every text under every language, by the ``compiled`` table."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    for first, last in steps(offsets, 1 << 20):
        at = offsets[first : last + 1]
        keys, starts, is_text = gram_keys(
            data[at[0] : at[-1]], at - at[0], model.symbols, model.size
        )
        bits = table[keys]
        bits[~is_text] = 0
        out[first:last] = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)
    return out


def training_rows(docs: DataFrame, text: str, lang: str, use: Column, row_key: Column) -> DataFrame:
    """(lang, text): for each of the most frequent languages about ``ROWS_PER_LANGUAGE`` rows, chosen
    by a hash of ``row_key``; all of them where there are fewer."""
    known = docs.where(use & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    if not top:
        return known.select(F.col(lang).alias("lang"), F.col(text).alias("text")).limit(0)
    share = F.create_map(
        *[
            F.lit(x)
            for r in top
            for x in (r["lang"], int((1 << 20) * min(1.0, ROWS_PER_LANGUAGE / r["rows"])))
        ]
    )
    return known.where(F.pmod(F.xxhash64(row_key), F.lit(1 << 20)) < share[F.col(lang)]).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )


def train(docs: DataFrame, text: str, lang: str, use: Column, row_key: Column) -> Model | None:
    """A model of the languages in ``lang`` from the rows where ``use`` holds; None without any."""
    rows = pinned(training_rows(docs, text, lang, use, row_key))

    def bytes_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(utf8(batch.column("text"))[0], minlength=256)
        yield pa.RecordBatch.from_pydict({"byte": np.arange(256, dtype=np.int32), "n": total})

    histogram = np.zeros(256)
    seen = rows.select("text").mapInArrow(bytes_seen, "byte int, n long")
    for r in seen.groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r["byte"]] = r["n"]
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    size = alphabet_size(len(languages))
    symbols = choose_symbols(histogram, size)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_numpy(zero_copy_only=False)
            for name in sorted(set(names)):
                data, offsets = utf8(batch.column("text").filter(pa.array(names == name)))
                keys, _, is_text = gram_keys(data, offsets, symbols, size)
                key, n = np.unique(keys[is_text], return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(key), pa.string()), "key": key, "n": n}
                )

    # At most TABLE_ENTRIES rows by construction of the keys, and no more than the sample has bytes.
    found = (
        rows.mapInArrow(grams, "lang string, key int, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    lang_of = np.asarray(found.column("lang").to_pylist(), dtype=object)
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    counts = []
    for name in languages:
        own = lang_of == name
        order = np.argsort(key[own])
        counts.append((key[own][order], n[own][order]))
    return Model(tuple(languages), size, symbols, tuple(counts))


def predicted(text: Column, model: Model | None) -> Column:
    """struct(lang_pred string, score double, bits double) of a text.

    ``lang_pred`` is ``und``, the score 0 and the bits null where the text is null or empty, has no
    letter, or no language was learned. Among equal code lengths the language first in code point
    order wins. ``bits`` is the code length under the predicted language.
    """
    kind = "struct<lang_pred:string,score:double,bits:double>"
    if model is None:
        return F.struct(
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("bits"),
        )

    @arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = None
        for texts in batches:
            data, offsets = utf8(texts)
            if len(offsets) == 1:
                yield pa.StructArray.from_arrays(
                    [pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.float64())],
                    ["lang_pred", "score", "bits"],
                )
                continue
            if table is None:
                table = compiled(model)
            bits = text_bits(data, offsets, model, table)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1.0 / np.exp2(-(bits - least[:, None])).sum(axis=1)
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.asarray(model.languages, dtype=object)[best], pa.string()),
                    pa.array(score),
                    pa.array(least),
                ],
                ["lang_pred", "score", "bits"],
            )
            pa.default_memory_pool().release_unused()

    none = F.struct(
        F.lit(UNKNOWN).alias("lang_pred"),
        F.lit(0.0).alias("score"),
        F.lit(None).cast("double").alias("bits"),
    )
    return F.when(text.rlike(r"\p{L}"), predict(text)).otherwise(none)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every row of ``docs``.

    Repeated rows are answered each; a row without id is never held out. Other columns, whatever
    their names, are neither read nor returned.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(d, "text", "lang", ~held_out(F.col("doc_id")), F.col("doc_id"))
    return d.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
