"""Personal data by candidate gradient boosting, in DataFrame functions only.

*Base* spans follow four fixed patterns with their checks (addresses of mail and of machines, card
numbers with a Luhn digit, international telephone numbers) and are always kept. *Generators* of high
recall propose further, overlapping spans: mail addresses with a spelled out at and dot, defanged or
version 6 machine addresses, numbers grouped in other ways. Boosted trees over features of the format
and of the context score these; a span is added when its score reaches the threshold of its kind and it
passes the check of its form.

The trees learn from the table itself. Base spans rewritten in the ways the generators look for are
positive; proposals that fail the check of their form (:func:`fails`) are negative. Proposals that pass
it may be true or not and teach nothing, however many there are. All features are small
whole numbers, so all examples of a table of any size are counted by feature vector
(``FEATURE_VECTORS`` at most), and the trees are fitted to these counts. Half of the rows is set aside
to calibrate the thresholds: the lowest score at which ``PRECISION`` of them are right.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.arrow import free_name
from pagequarry.session import pinned

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive forms match the same and never try a start again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = (EMAIL, IP, CARD, PHONE)
#: A text without a match of these has no match of the pattern; they are cheaper to look for.
HINTS = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
# Generators: (kind, pattern, hint).
GENERATORS = (
    (
        0,
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20|\x20@\x20)"
        r"[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
        r"[\[(]\x20?at\x20?[\])]|\x20@\x20|\x20at\x20[A-Za-z0-9-]+(?:\x20dot\x20|\.[A-Za-z0-9])",
    ),
    (1, r"(?<![0-9])[0-9]++(?:\[\.\][0-9]++){3}|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}", r"\[\.\]|[0-9A-Fa-f]:[0-9A-Fa-f]"),
    (2, r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{3,7}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])", r"[0-9]{12}|[0-9]{4}[./_][0-9]{4}"),
    (3, r"(?<![0-9+])(?:00[1-9][0-9\x20().-]{7,16}[0-9]|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])", r"00[1-9]|[0-9]{3}\)?[\x20.-][0-9]{3}"),
)
#: Words before a span that speak for one.
CUES = r"(?i)(?:mail|call|tel|phone|fax|mobile|card|visa|iban|contact|write|host|server|addr|ip)\W{0,3}$"
#: Number of values of each feature, in the order of :func:`features`.
SIZES = (4, 6, 4, 2, 4, 2, 2, 2, 5, 4)
FEATURE_VECTORS = math.prod(SIZES)
ROUNDS, RATE, PRECISION = 40, 0.3, 0.95
#: Shrinks leaves with few examples, so that one odd example decides nothing.
SHRINK = 20.0
#: Matches added up at once; lists are joined per block, so no list grows match by match.
BLOCK = 256


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_base(kind: int, match: Column) -> Column:
    """The check of a base match."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(256)) <= 255
        )
    only = digits(match)
    if kind == 2:
        return F.length(only).between(12, 19) & F.call_function("luhn_check", only)
    return F.length(only).between(9, 15)


def fails(kind: int, match: Column) -> Column:
    """The check of a proposal: whether it cannot be what its form says. Mail: a host without a last
    label of letters, or a sentence that ends before a capital ("at home.Then"); machine: a part above
    255; card: no 12 to 19 digits with a Luhn digit; telephone: no 9 to 15 digits after 00, or all the same."""
    only = digits(match)
    if kind == 0:
        return ~match.rlike(r"[.\x20\])][A-Za-z][A-Za-z0-9-]*[A-Za-z]$") | match.rlike(r"\x20at\x20[A-Za-z0-9.-]*[a-z0-9]\.[A-Z][a-z]")
    if kind == 1:
        parts = F.split(F.replace(match, F.lit("[.]"), F.lit(".")), r"\.")
        return ~match.contains(":") & F.exists(parts, lambda p: F.coalesce(p.try_cast("long"), F.lit(256)) > 255)
    if kind == 2:
        return ~(F.length(only).between(12, 19) & F.call_function("luhn_check", only))
    bare = F.when(match.startswith("00"), F.substr(only, F.lit(3))).otherwise(only)
    return ~F.length(bare).between(9, 15) | only.rlike(r"^(?:00)?([0-9])\1*$")


def features(kind: int, match: Column, left: Column, right: Column) -> Column:
    """One whole number that stands for the feature vector of a proposed span.

    Kind; number of digits (0 in a version 6 address); at sign (none, sign, spelled in brackets, spelled
    bare); Luhn digit; separators (none, blank or hyphen, dot, other); cue word before; glued to a letter
    or digit before, after; dots; beginning (plus, bracket, 00, other).
    """
    only = F.when(match.contains(":"), F.lit("")).otherwise(digits(match)) if kind == 1 else digits(match)
    n = F.length(only)
    dots = F.length(match) - F.length(F.replace(match, F.lit("."), F.lit("")))
    values = (
        F.lit(kind),
        F.when(n < 9, 0).when(n < 12, 1).when(n < 16, 2).when(n == 16, 3).when(n <= 19, 4).otherwise(5),
        F.when(match.contains("@"), 1).when(match.rlike(r"[\[(]\x20?at\x20?[\])]"), 2).when(match.contains(" at "), 3).otherwise(0),
        F.when(n.between(12, 19), F.call_function("luhn_check", only).cast("int")).otherwise(0),
        F.when(match.rlike(r"^[0-9A-Za-z]*$"), 0)
        .when(match.rlike(r"^[0-9A-Za-z\x20-]*$"), 1)
        .when(match.rlike(r"^[0-9A-Za-z.]*$"), 2)
        .otherwise(3),
        left.rlike(CUES).cast("int"),
        left.rlike(r"[0-9A-Za-z]$").cast("int"),
        right.rlike(r"^[0-9A-Za-z]").cast("int"),
        F.least(dots, F.lit(4)),
        F.when(match.startswith("+"), 0).when(match.startswith("("), 1).when(match.startswith("00"), 2).otherwise(3),
    )
    code = F.lit(0)
    for size, value in zip(SIZES, values, strict=True):
        code = code * size + value
    return code.cast("int")


def rewritten(kind: int, match: Column) -> list[Column]:
    """A base match as the generators' patterns would have it."""
    if kind == 0:
        at, dot = F.split(match, "@"), lambda c, to: F.replace(c, F.lit("."), F.lit(to))
        forms = ((" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."))
        return [F.concat(at[0], F.lit(a), dot(at[1], d)) for a, d in forms]
    if kind == 1:
        # The 32 bits in version 6 addresses: mapped, and as the network of 6to4.
        part = [F.lpad(F.hex(F.split(match, r"\.")[k].try_cast("long")), 2, "0") for k in range(4)]
        high, low = F.concat(part[0], part[1]), F.concat(part[2], part[3])
        return [
            F.replace(match, F.lit("."), F.lit("[.]")),
            F.concat(F.lit("0000:0000:0000:0000:0000:ffff:"), high, F.lit(":"), low),
            F.concat(F.lit("2002:"), high, F.lit(":"), low, F.lit(":0:0:0:0:1")),
        ]
    if kind == 2:
        only = digits(match)
        grouped = lambda by: F.regexp_replace(only, r"([0-9]{4})(?=[0-9])", "$1" + by)
        return [grouped("."), grouped("/"), only]
    national = lambda form: F.regexp_replace(F.right(digits(match), F.lit(10)), r"^([0-9]{3})([0-9]{3})([0-9]+)$", form)
    return [
        F.concat(F.lit("00"), F.substr(match, F.lit(2))),
        F.concat(F.lit("00"), digits(match)),
        *[national(form) for form in ("($1) $2-$3", "$1-$2-$3", "$1 $2 $3", "$1.$2.$3")],
    ]


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (gap, match, left, right), where gap is the
    number of code points since the match before, left and right the text around it."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        F.zip_with(found, F.slice(gaps, F.lit(2), F.size(found)), lambda m, after: F.struct(m.alias("m"), F.left(after, F.lit(2)).alias("right"))),
        lambda gap, x: F.struct(
            F.length(gap).alias("gap"), x["m"].alias("m"), F.right(gap, F.lit(12)).alias("left"), x["right"].alias("right")
        ),
    )
    kind = "array<struct<gap:int,m:string,left:string,right:string>>"
    return F.when(text.rlike(hint), rows).otherwise(F.array().cast(kind))


def placed(rows: Column, kept, made) -> Column:
    """``made(match, start, stop)`` of the rows for which ``kept`` holds, start and stop being places
    in the text. Running sums are taken block by block, and over the blocks."""
    kind = "struct<at:int,found:array<struct<start:int,kind:int,stop:int,codes:array<int>,wrong:boolean>>>"
    blocks = F.transform(
        F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)),
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.length(x["m"])
        more = F.when(kept(x), F.concat(acc["found"], F.array(made(x, start, stop)))).otherwise(acc["found"])
        return F.struct(stop.alias("at"), more.alias("found")).cast(kind)

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)
    sums = F.transform(blocks, lambda b: F.aggregate(b, empty, add))

    def join(acc: Column, b: Column) -> Column:
        moved = F.transform(
            b["found"],
            lambda s: F.struct(
                (s["start"] + acc["at"]).alias("start"),
                s["kind"].alias("kind"),
                (s["stop"] + acc["at"]).alias("stop"),
                s["codes"].alias("codes"),
                s["wrong"].alias("wrong"),
            ),
        )
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["found"], moved).alias("found")).cast(kind)

    return F.aggregate(sums, empty, join)["found"]


def spans(text: Column) -> tuple[Column, Column]:
    """(base spans, proposed spans) of a text, each an array of (start, kind, stop, codes, wrong). The
    codes of a base span are those of its rewritten forms, the code of a proposal its own; wrong is a
    proposal that fails its check."""
    base, more = [], []

    def made(kind: int, codes, wrong=lambda x: F.lit(False)) -> object:
        return lambda x, start, stop: F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            stop.alias("stop"),
            codes(x).alias("codes"),
            wrong(x).alias("wrong"),
        )

    for kind, (pattern, hint) in enumerate(zip(BASE, HINTS, strict=True)):
        codes = lambda x, k=kind: F.array(*[features(k, v, x["left"], x["right"]) for v in rewritten(k, x["m"])])
        kept = lambda x, k=kind: is_base(k, x["m"])
        base.append(placed(matches(text, pattern, hint), kept, made(kind, codes)))
    for kind, pattern, hint in GENERATORS:
        codes = lambda x, k=kind: F.array(features(k, x["m"], x["left"], x["right"]))
        more.append(placed(matches(text, pattern, hint), lambda x: F.lit(True), made(kind, codes, lambda x, k=kind: fails(k, x["m"]))))
    return F.flatten(F.array(*base)), F.flatten(F.array(*more))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (feature, border, (feature, border, below, above) below, and above)."""

    prior: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, values: list) -> float:
        total = self.prior
        for f, border, below, above in self.trees:
            g, inner, low, high = below if values[f] <= border else above
            total += low if values[g] <= inner else high
        return total

    def column(self, code: Column) -> Column:
        """The score (log odds) of a feature code."""
        values, rest = [], code
        for size in reversed(SIZES):
            values.insert(0, F.pmod(rest, F.lit(size)))
            rest = F.floor(rest / size).cast("int")
        total = F.lit(self.prior)
        for f, border, below, above in self.trees:
            leaf = [
                F.when(values[g] <= inner, F.lit(low)).otherwise(F.lit(high))
                for g, inner, low, high in (below, above)
            ]
            total = total + F.when(values[f] <= border, leaf[0]).otherwise(leaf[1])
        return total


def decoded(code: int) -> list[int]:
    values = []
    for size in reversed(SIZES):
        values.insert(0, code % size)
        code //= size
    return values


def best_split(rows: list, default: float) -> tuple:
    """(gain, feature, border, value below, value above) for rows (values, gradient, curvature)."""
    total_g, total_h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = RATE * total_g / (total_h + SHRINK) if rows else default
    best = (0.0, 0, SIZES[0], leaf, leaf)
    for f, size in enumerate(SIZES):
        g, h = [0.0] * size, [0.0] * size
        for values, gradient, curvature in rows:
            g[values[f]] += gradient
            h[values[f]] += curvature
        low_g = low_h = 0.0
        for border in range(size - 1):
            low_g, low_h = low_g + g[border], low_h + h[border]
            high_g, high_h = total_g - low_g, total_h - low_h
            gain = low_g**2 / (low_h + SHRINK) + high_g**2 / (high_h + SHRINK) - total_g**2 / (total_h + SHRINK)
            if gain > best[0] + 1e-9:
                best = (gain, f, border, RATE * low_g / (low_h + SHRINK), RATE * high_g / (high_h + SHRINK))
    return best


def fit(counts: list[tuple[int, int, int, int]]) -> Trees:
    """Trees and thresholds from (code, fold, positive, negative): fold 0 to learn, fold 1 to
    calibrate. Without examples, or without negatives to tell from, nothing can be added."""
    learn = [(decoded(c), p, n) for c, fold, p, n in sorted(counts) if fold == 0]
    positive, negative = sum(p for _, p, _ in learn), sum(n for _, _, n in learn)
    never = (math.inf,) * len(KINDS)
    if not positive:
        return Trees(0.0, (), never)
    prior = math.log((positive + 1) / (negative + 1))
    scores, trees = [prior] * len(learn), []
    for _ in range(ROUNDS if negative else 0):
        rows = []
        for (values, p, n), s in zip(learn, scores, strict=True):
            chance = 1 / (1 + math.exp(-s))
            rows.append((values, p - (p + n) * chance, (p + n) * chance * (1 - chance)))
        gain, f, border, *_ = best_split(rows, 0.0)
        if gain <= 1e-9:
            break
        sides = []
        for keep in (True, False):
            side = best_split([r for r in rows if (r[0][f] <= border) == keep], 0.0)
            sides.append(side[1:])
        trees.append((f, border, *sides))
        for k, (values, _, _) in enumerate(learn):
            g, inner, low, high = sides[0] if values[f] <= border else sides[1]
            scores[k] += low if values[g] <= inner else high
    model = Trees(prior, tuple(trees), never)
    thresholds = []
    for kind in range(len(KINDS)):
        seen: dict[float, list[int]] = {}
        for code, fold, p, n in counts:
            values = decoded(code)
            if fold == 1 and values[0] == kind:
                both = seen.setdefault(round(model.score(values), 9), [0, 0])
                both[0] += p
                both[1] += n
        right = wrong = 0
        lowest = math.inf
        for score in sorted(seen, reverse=True):
            right, wrong = right + seen[score][0], wrong + seen[score][1]
            if right >= PRECISION * (right + wrong):
                lowest = score
        thresholds.append(lowest)
    return Trees(prior, tuple(trees), tuple(thresholds))


def train(found: DataFrame) -> Trees:
    """Trees from the spans of all rows (base, more, fold)."""
    no = F.transform(F.filter("more", lambda s: s["wrong"]), lambda s: F.struct(s["codes"][0].alias("code"), F.lit(0).alias("label")))
    yes = F.transform(
        F.flatten(F.transform("base", lambda s: s["codes"])),
        lambda c: F.struct(c.alias("code"), F.lit(1).alias("label")),
    )
    counts = (
        found.where("size(base) + size(more) > 0")
        .select("fold", F.explode(F.concat(yes, no)).alias("e"))
        .groupBy("e.code", "fold")
        .agg(F.sum("e.label").alias("p"), F.sum(1 - F.col("e.label")).alias("n"))
    )
    # FEATURE_VECTORS rows a fold at most.
    return fit([(r["code"], r["fold"], r["p"], r["n"]) for r in counts.collect()])


def found_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base, more (proposals that touch no base span) and fold for training."""
    base, more = spans(F.coalesce(F.col(text), F.lit("")))
    apart = F.filter(
        "more",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])),
    )
    return docs.withColumns({"base": base, "more": more}).withColumn("more", apart)


def added(more: Column, trees: Trees) -> Column:
    """The proposals that pass their check and whose score reaches the threshold of their kind."""
    if all(math.isinf(t) for t in trees.thresholds):
        return F.filter(more, lambda s: F.lit(False))

    def enough(s: Column) -> Column:
        floor = F.lit(math.inf)
        for kind, t in enumerate(trees.thresholds):
            if not math.isinf(t):
                floor = F.when(s["kind"] == kind, F.lit(t - 1e-9)).otherwise(floor)
        return ~s["wrong"] & (trees.column(s["codes"][0]) >= floor)

    return F.filter(more, enough)


def listed(found: Column) -> Column:
    """``kind:start:stop`` of spans by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            order,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``base`` and ``added`` (arrays of (start, kind, stop), places in
    code points, kinds numbered as in ``KINDS``). Null and empty texts have none; repeated rows are
    answered each. Other columns are not read."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    found = pinned(found_spans(d, "text").select("doc_id", "base", "more", fold.alias("fold")))
    trees = train(found)
    return found.select(
        "doc_id",
        plain(F.col("base")).alias("base"),
        plain(added(F.col("more"), trees)).alias("added"),
    )


def plain(found: Column) -> Column:
    return F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    )


def digest(detected: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the list of all spans."""
    base = F.col("base")

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return detected.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, F.col("added"))).alias("spans"),
    )


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets (``[EMAIL]``); overlapping
    spans become one, named after the first. All columns are kept; a null text stays null.

    Two passes over the texts: one to train, one that finds, decides and rewrites in the row.
    """
    found = {c: free_name(docs, c) for c in ("base", "more")}
    small = docs.select(F.col(text).alias("text")).where(F.col(text).isNotNull())
    seen = pinned(
        found_spans(small, "text").select(
            "base", "more", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold")
        )
    )
    trees = train(seen)
    base, more = spans(F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumns({found["base"]: base, found["more"]: more})
    apart = F.filter(
        F.col(found["more"]),
        lambda m: ~F.exists(F.col(found["base"]), lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])),
    )
    every = F.array_sort(F.concat(plain(F.col(found["base"])), plain(added(apart, trees))))
    rows = rows.withColumn(found["base"], every)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = "struct<at:int,parts:array<string>>"

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        part = F.when(inside, F.array().cast("array<string>")).otherwise(
            F.array(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        )
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["parts"], part).alias("parts")
        ).cast(state)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(state)
    text_out = F.aggregate(
        F.col(found["base"]),
        empty,
        step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(F.col(text), acc["at"] + 1)),
    )
    changed = F.when(F.size(found["base"]) > 0, text_out).otherwise(F.col(text))
    return rows.withColumn(text, changed).select(*docs.columns)
