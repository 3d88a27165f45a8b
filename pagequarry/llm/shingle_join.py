"""N-gram Jaccard join with multiple-global-order filtering.

Documents with the same set of shingles form a class; the join runs over classes. Two sets whose
Jaccard similarity reaches the threshold share, under *any* total order of the shingles, one of the
first ``floor(n / 4) + 1`` of each set (for 0.75). The orders here put shingles known to be frequent
last, by frequency, and the others first, by a hash that differs from order to order. Candidates share
a prefix shingle under the first order (found by a shuffle on shingles) and under all the others
(tested on the pair); those left are verified exactly. Before texts move for that, pairs whose sets are
provably too far apart are refuted by parity bits, a quarter of a byte a shingle.

Only components are asked for, so pairs that are already connected need no test. In two rounds every
class is compared with one other class per shared shingle; what is still in different components is
then compared pair by pair. The first round takes the class with the smallest place in the list: edits
give a copy shingles of its own, which come before the shared ones, so that class is the least edited.
A group of thousands of near copies costs a few comparisons a document, and no link between components
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.arrow import bounded_batches, slices, utf8
from pagequarry.llm.components import components
from pagequarry.llm.shingles import scrambled, set_key, shingle_sets
from pagequarry.session import pinned

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Orders of the shingles used as filters.
ORDERS = 3
#: A shingle is reported as possibly frequent by a task that sees it in so many sets, 2 at least.
SEEN_OFTEN = 2
#: Most shingles whose frequency the orders use (16 bytes each in every worker). Any order gives the
#: right result; frequencies only keep the lists short.
MOST_FREQUENT = 262_144
#: Prefix shingles one group of the shuffle holds on average.
GROUP_SHINGLES = 400_000
#: Places in a prefix are kept in two bytes; a later one counts as this, which only weakens a filter.
LAST_PLACE = 65_535
#: Prefix shingles kept while pairs are tested.
HELD_SHINGLES = 300_000
#: Lists up to this long are searched pair by pair for entries that can link with no other.
LONG_LIST = 32
#: Bits of the filter that keeps sets without candidates out of the shuffle; its size is fixed.
FILTER_BITS = 1 << 23


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    """Prefix that sets of ``n`` must share one element of: n - ceil(n * PERCENT / 100) + 1."""
    return n + 1 + (-n * PERCENT) // 100


def prefix(found: np.ndarray, order: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix of a set under an order, in that order; whether each shingle is frequent).

    ``frequent`` has the frequent shingles, sorted, and the rank of each by rising frequency.
    """
    rank = np.full(len(found), -1, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], found), len(frequent[0]) - 1)
        hit = frequent[0][at] == found
        rank[hit] = frequent[1][at[hit]]
    take = prefix_length(len(found))
    key = scrambled(found, 10 + order)
    light = np.flatnonzero(rank < 0)
    if len(light) >= take:
        light = light[np.argpartition(key[light], take - 1)[:take]]
        chosen = light[np.argsort(key[light])]
    else:
        heavy = np.flatnonzero(rank >= 0)
        heavy = heavy[np.argsort(rank[heavy])[: take - len(light)]]
        chosen = np.concatenate([light[np.argsort(key[light])], heavy])
    return found[chosen], rank[chosen] >= 0


def repeated(sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of sets that have it) of those in at least ``SEEN_OFTEN`` sets. Empties ``sets``,
    so that the shingles of a whole batch are held once."""
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(list(sets.values()))
    sets.clear()
    every.sort()
    shingle, again = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
    often = again + 1 >= SEEN_OFTEN
    return shingle[often], again[often] + 1


def described(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): rows (doc_id, key, n) for documents, with key null and n 0 without words,
    and rows (shingle, seen) for shingles that a task saw in several sets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"]):
            rows = batch.num_rows
            if not rows:
                continue
            key, n = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            sets: dict[int, np.ndarray] = {}
            for row, found in shingle_sets(*utf8(batch.column("text"))):
                key[row], n[row] = set_key(found), len(found)
                sets.setdefault(key[row], found)
            shingle, seen = repeated(sets)
            none = len(shingle)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([pa.array(key, mask=n == 0), pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([pa.array(n), pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(shingle.view(np.int64))]),
                    pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(seen.astype(np.int64))]),
                ],
                ["doc_id", "key", "n", "shingle", "seen"],
            )

    return docs.mapInArrow(describe, "doc_id long, key long, n long, shingle long, seen long")


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles sorted, rank of each by rising frequency) of the most frequent ones."""
    top = (
        described.where("shingle is not null")
        .groupBy("shingle")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle")
        .limit(MOST_FREQUENT)
        .toArrow()
    )
    shingle = top.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], (len(shingle) - 1 - np.arange(len(shingle)))[order]


def can_link(n_x, place_x, n_y, place_y):
    """Whether sets of these sizes can link when their first common shingle has these places: neither is
    too long for the other, and what follows holds the intersection a link needs, (100 + PERCENT) *
    intersection >= PERCENT * (n + n)."""
    sizes = 100 * np.minimum(n_x, n_y) >= PERCENT * np.maximum(n_x, n_y)
    rest = np.minimum(n_x - place_x, n_y - place_y)
    return sizes & ((100 + PERCENT) * rest >= PERCENT * (n_x + n_y))


#: The same in SQL, for two sides x and y.
CAN_LINK = f"""100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)
    AND {100 + PERCENT} * least(x.n - x.place, y.n - y.place) >= {PERCENT} * (x.n + y.n)"""


def alive(shingle: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries, sorted by shingle, can link with another one of their list. Lists of more than
    ``LONG_LIST`` entries are kept as they are."""
    out = np.zeros(len(shingle), bool)
    for step in range(1, LONG_LIST + 1):
        same = np.flatnonzero(shingle[step:] == shingle[:-step]) if step < len(shingle) else []
        if not len(same):
            break
        other = same + step
        if step == LONG_LIST:
            out |= np.isin(shingle, shingle[same])
            break
        fine = can_link(n[same], place[same], n[other], place[other])
        out[same[fine]] = out[other[fine]] = True
    return out


def prefix_entries(texts: DataFrame, frequent, groups: int) -> DataFrame:
    """(shingle, key, n, place, first, last): prefix shingles under the first order of the classes that
    share them with a class they can link with. ``place`` counts from 0 in the prefix. Of the list of a
    shingle that is not among the frequent ones, ``first`` is the class with the smallest place and
    ``last`` the one with the largest key (the entry's own key where it cannot link with that class);
    for the frequent ones they are null and the entry may stand alone.

    Entries travel as packed arrays, one row per task and group; a frequent shingle is spread over the
    groups by class, so no group holds a whole long list.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"]):
            done: set[int] = set()
            shingles, keys, sizes, places, heavy = [], [], [], [], []
            for _, found in shingle_sets(*utf8(batch.column("text"))):
                key = set_key(found)
                if key in done:
                    continue
                done.add(key)
                own, often = prefix(found, 0, frequent)
                shingles.append(own)
                heavy.append(often)
                keys.append(np.full(len(own), key, np.int64))
                sizes.append(np.full(len(own), len(found), np.uint32))
                places.append(np.minimum(np.arange(len(own)), LAST_PLACE).astype(np.uint16))
            if not shingles:
                continue
            shingle, key, n, place, often = map(
                np.concatenate, (shingles, keys, sizes, places, heavy)
            )
            spread = np.where(often, scrambled(key.view(np.uint64), 3), scrambled(shingle, 4))
            group = (spread % np.uint64(groups)).astype(np.int64) * 2 + often
            order = np.argsort(group, kind="stable")
            group, shingle, key = group[order], shingle[order], key[order]
            n, place = n[order], place[order]
            edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            stop = np.append(edge[1:], len(group))
            yield pa.RecordBatch.from_pydict(
                {
                    "group": (group[edge] // 2).astype(np.int64),
                    "often": group[edge] % 2 == 1,
                    "shingles": [shingle[a:b].tobytes() for a, b in zip(edge, stop, strict=True)],
                    "keys": [key[a:b].tobytes() for a, b in zip(edge, stop, strict=True)],
                    "sizes": [n[a:b].tobytes() for a, b in zip(edge, stop, strict=True)],
                    "places": [place[a:b].tobytes() for a, b in zip(edge, stop, strict=True)],
                }
            )

    def lists(table: pa.Table) -> pa.Table:
        def unpacked(often: bool) -> tuple[np.ndarray, ...]:
            part = table.filter(pa.array(table.column("often").to_numpy() == often))
            return tuple(
                np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
                for c, kind in (
                    ("shingles", np.uint64),
                    ("keys", np.int64),
                    ("sizes", np.uint32),
                    ("places", np.uint16),
                )
            )

        shingle, key, n, place = unpacked(False)
        order = np.lexsort((key, shingle))
        shingle, key = shingle[order], key[order]
        n, place = n[order].astype(np.int64), place[order].astype(np.int64)
        if len(shingle):
            fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
            shingle, key, n, place = shingle[fresh], key[fresh], n[fresh], place[fresh]
            keep = alive(shingle, n, place)
            shingle, key, n, place = shingle[keep], key[keep], n[keep], place[keep]
        edge = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else order[:0]
        size = np.diff(np.append(edge, len(shingle)))
        by_place = np.lexsort((key, place, shingle))
        ends = []
        for end in (by_place[edge], edge + size - 1):
            far = np.repeat(end, size)
            ends.append(np.where(can_link(n, place, n[far], place[far]), key[far], key))
        heavy, heavy_key, heavy_n, heavy_place = unpacked(True)
        _, once = np.unique(np.stack([heavy.view(np.int64), heavy_key]), axis=1, return_index=True)
        none = pa.nulls(len(once), pa.int64())
        return pa.table(
            {
                "shingle": np.concatenate([shingle, heavy[once]]).view(np.int64),
                "key": np.concatenate([key, heavy_key[once]]),
                "n": np.concatenate([n, heavy_n[once]]).astype(np.int64),
                "place": np.concatenate([place, heavy_place[once]]).astype(np.int64),
                "first": pa.concat_arrays([pa.array(ends[0], pa.int64()), none]),
                "last": pa.concat_arrays([pa.array(ends[1], pa.int64()), none]),
            }
        )

    packed = texts.mapInArrow(pack, "group long, often boolean, shingles binary, keys binary, sizes binary, places binary")
    return packed.groupBy("group").applyInArrow(
        lists, "shingle long, key long, n long, place long, first long, last long"
    )


def parity_bits(found: np.ndarray) -> np.ndarray:
    """A set as bits: each shingle flips one of the first power of two, 64 at least, not under twice its
    size. Two sets of one width differ in at most as many bits as they have shingles apart."""
    width = max(64, 1 << int(2 * len(found) - 1).bit_length())
    at = (scrambled(found, 5) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8))


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """How many bits differ once the wider one is folded to the width of the other."""
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(folded ^ x).sum())


def candidate_sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, bits, text): the classes named by ``keys``, perhaps some others, with the size and the
    parity bits of the set and one of the texts that have it."""
    word = (F.pmod("key", F.lit(FILTER_BITS)) / 64).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(key, 64) AS INT))")
    # FILTER_BITS / 64 rows at most.
    filled = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().astype(np.int64).view(np.uint64)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ["text"]):
            column = batch.column("text")
            rows: dict[int, int] = {}
            sizes, bits = [], []
            for row, found in shingle_sets(*utf8(column)):
                key = set_key(found)
                place = key % FILTER_BITS
                if key not in rows and int(words[place // 64]) >> (place % 64) & 1:
                    rows[key] = row
                    sizes.append(len(found))
                    bits.append(parity_bits(found).tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(rows), pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(bits, pa.binary()),
                        column.take(pa.array(list(rows.values()), pa.int64())).cast(pa.string()),
                    ],
                    ["key", "n", "bits", "text"],
                )

    found = texts.mapInArrow(chosen, "key long, n long, bits binary, text string")
    return found.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "bits", "text")))


def both_sides(pairs: DataFrame, of_class: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of ``of_class`` for a (``left``) and b (``right``)."""
    own = F.struct(*(c for c in of_class.columns if c != "key"))
    a = of_class.select(F.col("key").alias("a"), own.alias("left"))
    b = of_class.select(F.col("key").alias("b"), own.alias("right"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "left.*", "right.*").toDF(
        "a", "b", *(f"{side}_{c}" for side in ("left", "right") for c in of_class.columns if c != "key")
    )


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose parity bits allow a link: sets that link have at most (100 - PERCENT) of
    (100 + PERCENT) of their shingles apart. A pair refuted here moved a quarter of a byte a shingle."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_bits"), batch.column("right_bits")
            apart = np.fromiter(
                (
                    bits_apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                    for x, y in zip(left, right, strict=True)
                ),
                np.int64,
                batch.num_rows,
            )
            total = batch.column("left_n").to_numpy() + batch.column("right_n").to_numpy()
            keep = pa.array((100 + PERCENT) * apart <= (100 - PERCENT) * total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"]
            )

    return both_sides(pairs, sets.select("key", "n", "bits")).mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """The pairs (a, b) of classes that link. Only texts of pairs that are still plausible move, and
    their sets are made again where they meet: a text is less than half of its shingles' hashes."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: dict[int, list[frozenset]] = {}
        held = 0

        def filters(key: int, found: np.ndarray) -> list[frozenset]:
            nonlocal held
            if key not in prefixes:
                if held > HELD_SHINGLES:
                    prefixes.clear()
                    held = 0
                made = [prefix(found, k, frequent)[0].tolist() for k in range(1, ORDERS)]
                held += sum(map(len, made))
                prefixes[key] = [frozenset(p) for p in made]
            return prefixes[key]

        for batch in slices(batches, ["left_text", "right_text"]):
            keep = np.zeros(batch.num_rows, bool)
            firsts, seconds = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # Every class has words, so both sides give each row in turn.
            lefts = shingle_sets(*utf8(batch.column("left_text")))
            rights = shingle_sets(*utf8(batch.column("right_text")))
            for (row, x), (_, y) in zip(lefts, rights, strict=True):
                small, large = sorted((len(x), len(y)))
                if 100 * small < PERCENT * large:
                    continue
                of_x, of_y = filters(firsts[row], x), filters(seconds[row], y)
                if any(p.isdisjoint(q) for p, q in zip(of_x, of_y, strict=True)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[row] = 100 * common >= PERCENT * (small + large - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"]
            )

    left = pinned(plausible(pairs, sets))
    needed = left.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = sets.select("key", "text").join(needed, "key", "left_semi")
    return both_sides(left, texts).mapInArrow(test, "a long, b long")


def linked(entries: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """(node, component) over classes; a class without links is missing."""
    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    ends = (
        entries.where("first is null")
        .groupBy("shingle")
        .agg(
            F.min(F.struct("place", "key", "n")).alias("low"),
            F.max(F.struct("key", "n", "place")).alias("high"),
            F.count(F.lit(1)).alias("entries"),
        )
        .where("entries > 1")
    )
    tested, links, label = None, None, None
    for end, far in (("first", "low"), ("last", "high")):
        light = entries.where("first is not null").select(F.col("key").alias("x"), F.col(end).alias("y"))
        heavy = (
            entries.where("first is null")
            .join(ends.select("shingle", F.col(far).alias("y")), "shingle")
            .select(F.struct("key", "n", "place").alias("x"), "y")
            .where(CAN_LINK)
            .select(F.col("x.key").alias("x"), F.col("y.key").alias("y"))
        )
        pairs = light.union(heavy).where("x <> y").select(*ordered).distinct()
        if label is not None:
            pairs = apart(pairs, label).join(tested, ["a", "b"], "left_anti")
        pairs = pinned(pairs)
        found = pinned(verified(pairs, sets, frequent))
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        label = pinned(components(links))
    # What is left: lists whose classes are still in several components, pair by pair.
    marked = (
        entries.select("shingle", "key", "n", "place")
        .join(label.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    split = (
        marked.groupBy("shingle")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("shingle")
    )
    rest = pinned(marked.join(split, "shingle"))
    # The first common shingle of a link meets the condition; a later one need not.
    x, y = rest.alias("x"), rest.alias("y")
    pairs = (
        x.join(
            y,
            F.expr(
                "x.shingle = y.shingle AND x.key < y.key AND x.component <> y.component AND " + CAN_LINK
            ),
        )
        .select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    found = pinned(verified(pinned(pairs), sets, frequent))
    if found.isEmpty():
        return label
    return components(links.union(found))


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    return (
        pairs.join(label.toDF("a", "of_a"), "a", "left")
        .join(label.toDF("b", "of_b"), "b", "left")
        .where("not coalesce(of_a = of_b, false)")
        .select("a", "b")
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    The component is the smallest id reachable by links, the document's own included. Null, empty and
    wordless texts have 0 shingles and are linked with nothing. Repeated rows are returned each; ids
    should be unique, and a row without id has no component. Sets are compared by 64-bit hashes of
    their shingles.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = pinned(described(d))
    rows = seen.where("shingle is null").select("doc_id", "key", "n")
    classes = pinned(
        rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"))
    )
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(least, -(-total * (100 - PERCENT) // (100 * GROUP_SHINGLES)))
    frequent = frequent_shingles(seen)
    texts = d.select("text").where("text is not null")
    entries = pinned(prefix_entries(texts, frequent, size))
    sets = pinned(candidate_sets(texts, entries.select("key").distinct()))
    label = linked(entries, sets, frequent)
    # The smallest document of a component: minimum over its classes.
    member = classes.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    low = member.groupBy("component").agg(F.min("low").alias("component_id"))
    named = pinned(member.join(low, "component").select("key", "component_id"))
    return (
        rows.join(named, "key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
