"""Secret scans with SQL functions alone: patterns, and a battery of randomness tests with false-discovery control.

*Base spans* come from three patterns: assignments to names such as ``token``, access keys, and long hexadecimal runs.
A span is a whole match, in code points, its end exclusive.

*Added spans* (kind ``random``) come from the battery. Candidates are runs of at least ``MIN_RUN`` symbols of the usual
encodings that hold a digit or a change to upper case. Each gets an inferred encoding (digits, hexadecimal, base 32,
lower-case base 36, letters and digits, base 64) with its alphabet's size, and three tests of randomness: chi-squared
for a uniform alphabet, Wald and Wolfowitz's runs of character classes, and serial correlation of neighbours. Two
decisions follow, both with the step-up rule of Benjamini and Hochberg among candidates of similar length, over the whole
table: a candidate is set aside when randomness is rejected; it is found when ordinary text, in which classes of
characters seldom change, is rejected and randomness is not. P-values are closed upper bounds (normal and Chernoff
tails), so decisions err towards silence. Their distribution is gathered as counts for each length class and step of
p: a table whose size is fixed, whatever the corpus.

Marker characters that texts may hold are first replaced by a stand-in, one for one, so positions stay right. Positions
are running sums, taken in blocks, and texts are put together from pieces, so that work grows with a text's length.

Edge cases: a null text is an empty text without spans; a table without candidates adds none; rows that repeat give rows
that repeat; the scan joins nothing, so ids may be null or repeat; what is added on the way is one column, under a name
that the table doesn't have, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short can't hold a longer match, so that the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGNED = 8
KINDS = ("assign", "access", "hex", "random")

MIN_RUN = 20
SYMBOLS = "A-Za-z0-9+/_=-"
#: A run that no found assignment has a part of: those are blotted out.
CANDIDATE = rf"(?<![\x03{SYMBOLS}])(?=[A-Za-z+/_=-]*(?:[0-9]|[a-z][A-Z]))[{SYMBOLS}]{{{MIN_RUN},}}+(?!\x03)"
#: Share of places in ordinary names at which a word or a number ends and another begins.
TEXT_CHANGES = 0.12
#: False-discovery rates: of setting aside what is random, and of finding what is text.
KEEP_RATE, FIND_RATE = 0.01, 0.01
#: Steps of -ln p in one unit, and the last step of either p-value.
STEPS, LAST_ODD, LAST_TOLD = 4, 100, 200

MARK, STAND_IN, BLOT = "\u0001", "\u0002", "\u0003"
#: Values of a block of a running sum, and characters of a piece of text.
BLOCK, PIECE = 64, 1024
SPAN = "array<struct<start:int,k:int,stop:int,kind:string>>"
REDACTED = "[SECRET]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is worked out once, and not wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK + BLOT, STAND_IN * 2)


def marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers what ``op`` (a sum or a maximum) makes of those before it, 0 for the first: within
    blocks, and over blocks first, as an array grows by copying."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    one_more = lambda acc, value: F.concat(acc, F.array(op(F.element_at(acc, -1), value)))
    ahead = lambda of: F.aggregate(of, F.array(F.lit(0)), lambda acc, block: one_more(acc, F.aggregate(block, F.lit(0), op)))
    inside = lambda block, start: F.slice(F.aggregate(block, F.array(start), one_more), F.lit(1), F.size(block))
    return let(blocks, lambda of: let(ahead(of), lambda starts: F.flatten(F.transform(of, lambda block, i: inside(block, F.get(starts, i))))))


def none_of(kind: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def matches(marks: Column) -> Column:
    """array<struct<start, stop, found>> of the marked matches: of the parts between marks, every other one."""
    starts = lambda parts: before(F.transform(parts, F.length), lambda a, b: a + b)
    every = lambda parts: F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i % 2 == 1)
    one = lambda parts, at, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(F.get(parts, i))).alias("stop"), F.get(parts, i).alias("found"))
    found = lambda text: let(F.split(text, MARK), lambda parts: let(starts(parts), lambda at: F.transform(every(parts), lambda i: one(parts, at, i))))
    return let(marks, lambda text: F.when(F.instr(text, MARK) > 0, found(text)).otherwise(none_of("struct<start:int,stop:int,found:string>")))


def long_enough(assign: Column) -> Column:
    return F.length(F.regexp_extract(assign, ASSIGN, 1)) >= ASSIGNED


def blotted(assign: Column) -> Column:
    """The text of marked assignments, those that count blotted out, each character by one."""
    out = F.transform(F.split(assign, MARK), lambda part, i: F.when((i % 2 == 1) & long_enough(part), F.repeat(F.lit(BLOT), F.length(part))).otherwise(part))
    return F.when(F.instr(assign, MARK) > 0, F.array_join(out, "")).otherwise(assign)


def spans(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))


def base_spans(assign: Column, access: Column, long_hex: Column) -> Column:
    assigned = F.filter(matches(assign), lambda m: long_enough(m["found"]))
    return F.array_sort(F.concat(spans(assigned, "assign"), spans(matches(access), "access"), spans(matches(long_hex), "hex")))


def alphabet(run: Column) -> Column:
    """Size of the smallest usual alphabet that has all symbols of a run."""
    ladder = ((r"^[0-9]+$", 10), (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16), (r"^[A-Z2-7]+$", 32), (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36), (r"^[0-9A-Za-z]+$", 62))
    return reduce(lambda rest, rung: F.when(run.rlike(rung[0]), rung[1]).otherwise(rest), reversed(ladder), F.lit(64)).cast("double")


def tail(z: Column) -> Column:
    """-ln of an upper bound of the normal tail beyond z."""
    return F.when(z > 0, z * z / 2 + math.log(2)).otherwise(0.0)


def prepared(found: Column) -> Column:
    """What the tests share of a candidate: its run without padding, letters, codes, and its string of classes."""
    run = F.regexp_replace(found["found"], "=+$", "")
    plain = F.regexp_replace(found["found"], "[-_/+=]", "")
    letters = F.filter(F.split(run, ""), lambda c: c != "")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "\u0003"), "[A-Z]+", "\u0004"), "[a-z]+", "\u0005")
    words = F.regexp_replace(plain, "[A-Z]?[a-z]+|[A-Z]+|[0-9]+", "w")
    return F.struct(
        found["start"].alias("start"), found["stop"].alias("stop"), run.alias("run"), letters.alias("letters"), alphabet(run).alias("k"),
        F.greatest(F.length(run), F.lit(2)).cast("double").alias("n"), F.greatest(F.length(plain), F.lit(2)).cast("double").alias("m"),
        F.length(F.regexp_replace(plain, "[^0-9]", "")).cast("double").alias("digits"), F.length(F.regexp_replace(plain, "[^A-Z]", "")).cast("double").alias("upper"),
        F.greatest(F.length(classes) - 1, F.lit(0)).cast("double").alias("changes"), F.greatest(F.length(words) - 1, F.lit(0)).cast("double").alias("breaks"),
    )


def measured(c: Column) -> Column:
    """Sums that the statistics are made of."""
    counts = F.transform(F.array_distinct(c["letters"]), lambda x: F.length(c["run"]) - F.length(F.replace(c["run"], x, F.lit(""))))
    codes = F.transform(c["letters"], lambda x: F.ascii(x).cast("double"))
    mean = F.aggregate(c["letters"], F.lit(0.0), lambda a, x: a + F.ascii(x)) / c["n"]
    lower = c["m"] - c["digits"] - c["upper"]
    return F.struct(
        c["start"].alias("start"), c["stop"].alias("stop"), *(c[x].alias(x) for x in ("k", "n", "m", "changes", "breaks")),
        F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x).alias("squares"),
        ((c["m"] * c["m"] - c["digits"] * c["digits"] - c["upper"] * c["upper"] - lower * lower) / c["m"]).alias("expected"), codes.alias("codes"), mean.alias("mean"),
    )


def battery(c: Column) -> Column:
    """struct<start, stop, size, odd, told>: the length class, and -ln p in steps of randomness and of ordinary text."""
    n, m, mean = c["n"], c["m"], c["mean"]
    # chi-squared by Wilson and Hilferty's cube root
    df = c["k"] - 1
    spread = 2 / (9 * df)
    chi_z = (F.pow(F.greatest(c["squares"] * c["k"] / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    # runs of classes, given how many symbols each class has
    runs_z = F.abs(c["changes"] - c["expected"]) / F.sqrt(F.greatest(c["expected"] * (1 - c["expected"] / m), F.lit(0.25)))
    # serial correlation of neighbours' code points
    deviation = F.aggregate(c["codes"], F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    ahead = F.zip_with(F.slice(c["codes"], F.lit(1), F.size(c["codes"]) - 1), F.slice(c["codes"], F.lit(2), F.size(c["codes"]) - 1), lambda a, b: (a - mean) * (b - mean))
    serial = F.aggregate(ahead, F.lit(0.0), lambda a, x: a + x) / F.greatest(deviation, F.lit(1e-9))
    serial_z = F.abs(F.when(deviation > 0, serial).otherwise(1.0) + 1 / n) * F.sqrt(n)

    odd = F.greatest(F.greatest(tail(chi_z), tail(runs_z), tail(serial_z)) - math.log(3), F.lit(0.0))
    share = F.least(c["breaks"] / (m - 1), F.lit(1.0))
    rest = F.when(share < 1, (1 - share) * F.log(F.greatest(1 - share, F.lit(1e-12)) / (1 - TEXT_CHANGES))).otherwise(0.0)
    told = F.when(share > TEXT_CHANGES, (m - 1) * (share * F.log(share / TEXT_CHANGES) + rest)).otherwise(0.0)
    step = lambda x, last: F.least(F.floor(x * STEPS), F.lit(last)).cast("int")
    size = F.least(F.floor(F.log2(n) * 2), F.lit(40)).cast("int")
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), size.alias("size"), step(odd, LAST_ODD).alias("odd"), step(told, LAST_TOLD).alias("told"))


def candidates(marks: Column) -> Column:
    """What the battery says of the marked runs that hold no access key or hexadecimal run; such lie within one run of symbols."""
    plain = F.filter(matches(marks), lambda m: ~m["found"].rlike(f"{ACCESS}|{HEX}"))
    return F.transform(F.transform(F.transform(plain, prepared), measured), battery)


def stepped_up(counts: dict[int, int], rate: float, last: int) -> int:
    """The least step of -ln p that the step-up rule rejects, or one beyond the last."""
    total, above, least = sum(counts.values()), 0, last + 1
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if math.exp(-step / STEPS) <= rate * above / total:
            least = step
    return least


def thresholds(scored: DataFrame) -> tuple[Column, Column]:
    """Maps from length class to the least steps that are rejected: of randomness, and of text among the rest. All rows are
    counted; the counts number at most length classes times steps times steps."""
    by_size: dict[int, list] = {}
    for size, odd, told, n in scored.groupBy("size", "odd", "told").count().collect():
        by_size.setdefault(size, []).append((odd, told, n))
    limits = {}
    for size, of in by_size.items():
        odds: dict[int, int] = {}
        for odd, _, n in of:
            odds[odd] = odds.get(odd, 0) + n
        most = stepped_up(odds, KEEP_RATE, LAST_ODD)
        tolds: dict[int, int] = {}
        for odd, told, n in of:
            if odd < most:
                tolds[told] = tolds.get(told, 0) + n
        limits[size] = most, stepped_up(tolds, FIND_RATE, LAST_TOLD) if tolds else LAST_TOLD + 1
    keys = [F.lit(size) for size in sorted(limits)] or [F.lit(-1)]
    column = lambda k: F.map_from_arrays(F.array(*keys), F.array(*([F.lit(limits[size][k]) for size in sorted(limits)] or [F.lit(-1)])))
    return column(0), column(1)


def with_spans(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with one more column: struct<base, added>, both arrays of spans. Two passes over the table, no shuffle of texts."""
    both = lambda t, assign: F.struct(base_spans(assign, marked(t, ACCESS), marked(t, HEX)).alias("base"), candidates(marked(blotted(assign), CANDIDATE)).alias("tested"))
    tested = docs.withColumn(name, let(clean(F.col(text)), lambda t: let(marked(t, ASSIGN), lambda assign: both(t, assign))))
    odd, told = thresholds(tested.select(F.explode(F.col(name)["tested"]).alias("c")).select("c.size", "c.odd", "c.told"))
    limit = lambda of, c, last: F.coalesce(F.element_at(of, c["size"]), F.lit(last + 1))
    chosen = F.filter(F.col(name)["tested"], lambda c: (c["odd"] < limit(odd, c, LAST_ODD)) & (c["told"] >= limit(told, c, LAST_TOLD)))
    return tested.withColumn(name, F.struct(F.col(name)["base"].alias("base"), spans(chosen, "random").alias("added")))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of each document."""
    name = free_name(docs.select(key, text), "found")
    found = with_spans(docs.select(F.col(key), F.col(text)), text, name)
    base, added = F.col(name)["base"], F.col(name)["added"]
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    everything = F.array_sort(F.concat(base, added))
    return found.select(key, count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(everything).alias("spans"), F.size(added).cast("long").alias("n_random"))


def replaced(text: Column, found: Column) -> Column:
    """A text with each of the sorted spans, or group of spans that overlap, replaced by REDACTED. What lies between spans
    is taken from pieces of the text, as a substring is counted from the beginning of what it is taken from."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(some, a - first * PIECE + 1, b - a)).otherwise("")

    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))
    pairs = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("stop"))

    def joined(pieces: Column, spans_of: Column, reach: Column) -> Column:
        # a span that starts before an earlier one ends belongs to that one
        apart = F.filter(F.sequence(F.lit(1), F.size(spans_of) - 1), lambda i: (F.get(spans_of, i)["start"] >= F.get(reach, i)) | (i == F.size(spans_of) - 1))
        return F.array_join(F.transform(apart, lambda i: between(pieces, F.get(reach, i), F.greatest(F.get(spans_of, i)["start"], F.get(reach, i)))), REDACTED)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(cut, lambda pieces: let(F.concat(F.array(begin), pairs, F.array(end)), lambda all_of: let(before(F.transform(all_of, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)), lambda reach: joined(pieces, all_of, reach))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span, or group of spans that overlap, replaced by REDACTED; other columns stay."""
    name = free_name(docs, "found")
    found = with_spans(docs, text, name)
    spans_of = F.array_sort(F.concat(F.col(name)["base"], F.col(name)["added"]))
    changed = F.when(F.size(spans_of) > 0, replaced(F.col(text), spans_of)).otherwise(F.col(text))
    return found.withColumn(text, changed).select(*docs.columns)
