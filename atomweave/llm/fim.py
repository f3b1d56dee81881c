r"""Fill-in-middle: a text is cut at two ends of lines and its parts are put in another order, between marks.

One full match of ``(line)*`` by the regex library keeps every repetition of its group, so that ``match.ends(1)`` gives the
number of lines and all places where a cut may fall. Quantifiers are possessive: a text is read once, whatever it holds.
Which cuts, and which form, follow from a hash of the document's id, and so don't hang on partitions or repeats.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; ``plain``
is the text itself. As a text with a mark in it stays plain, and no end of a part and a mark make another mark, the
first of each mark in an output is the one that was put there, and ``restored`` gives the text exactly.

Edge cases: a null text counts as empty; empty texts, and texts with a mark, are plain, with null lengths; a null id is
hashed as empty text; cuts may fall together, so parts may be empty; rows that repeat give the same rows again; only the
id and the text are read, so other columns, whatever their names, aren't passed on. A row is handled by itself, and one
text takes about 80 bytes for each of its lines while it is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_type, sliced

UNIT = r"[^\n]*+\n|[^\n]++"


@dataclass(frozen=True)
class Recipe:
    """``rate`` of 100 texts are cut, ``spm`` of 100 of these with the suffix first; marks of prefix, suffix and middle."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    unit: str = UNIT

    def __post_init__(self) -> None:
        if len(set(self.marks)) < 3 or any(len(m) < 3 or not (m[0] == "<" and m[-1] == ">") or "<" in m[1:] or ">" in m[:-1] for m in self.marks):
            raise ValueError("marks differ, and each stands in one pair of angle brackets")


def ends_of_units(text: str, matcher: regex.Pattern) -> list[int]:
    match = matcher.fullmatch(text)
    if match is None:
        raise ValueError("the unit doesn't cover the text")
    return match.ends(1)


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts(docs: DataFrame, recipe: Recipe, key: str, text: str) -> DataFrame:
    """(key, text, h3, h4, n, first, second): lines of each text, and where the prefix and the middle end."""
    h1, h2, h3, h4 = draws(F.col(key), recipe.seed)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    pattern = f"({recipe.unit})*+"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = regex.compile(pattern)
        for batch in sliced(batches, 256):
            n, first, second = [], [], []
            for t, a, b in zip(batch.column("t"), batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
                ends = [0, *ends_of_units(t.as_py(), matcher)]
                low, high = sorted((a % len(ends), b % len(ends)))
                n.append(len(ends) - 1)
                first.append(ends[low])
                second.append(ends[high])
            kept = [batch.column(c) for c in ("k", "t", "h3", "h4")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (n, first, second))], names=["k", "t", "h3", "h4", "n", "first", "second"])

    return rows.mapInArrow(run, f"k {column_type(docs, key)}, t string, h3 long, h4 long, n long, first long, second long")


def transform(docs: DataFrame, recipe: Recipe | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row."""
    recipe = recipe or Recipe()
    p, s, m = recipe.marks
    marked = F.lit(False)
    for mark in recipe.marks:
        marked = marked | F.contains("t", F.lit(mark))
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= recipe.rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < recipe.spm, "spm").otherwise("psm")
    cut = cuts(docs, recipe, key, text).withColumn("form", form)
    whole = lambda x: x.cast("int")
    prefix = F.substring("t", F.lit(1), whole(F.col("first")))
    middle = F.substring("t", whole(F.col("first") + 1), whole(F.col("second") - F.col("first")))
    suffix = F.substring("t", whole(F.col("second") + 1), F.length("t"))
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).otherwise(F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
    told = lambda x: F.when(F.col("form") != "plain", x)
    return cut.select(F.col("k").alias(key), "n", "form", told(F.col("first")).alias("prefix_chars"), told(F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, recipe: Recipe | None = None) -> Column:
    """The text again, from an output and its form alone."""
    p, s, m = (recipe or Recipe()).marks
    after = lambda x, mark: F.substring(x, F.instr(x, mark) + len(mark), F.length(x))
    before = lambda x, mark: F.substring(x, F.lit(1), F.instr(x, mark) - 1)
    one, two = lambda x: after(x, p), lambda x: after(x, s)
    psm = F.concat(before(one(output), s), after(output, m), before(two(output), m))
    spm = F.concat(before(one(output), m), after(output, m), before(two(output), p))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(cut: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """Outputs of ``transform``, and the texts restored from them, as lowercase hex of their hashes."""
    first = cut.columns[0]
    sha = lambda x: F.sha2(x, 256)
    return cut.select(first, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), recipe)).alias("restored_sha256"))
