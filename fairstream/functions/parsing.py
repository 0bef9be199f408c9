"""From text lines to typed rows. Bad input fails the job, it never turns into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: every sign that counts as white space in Unicode, and a number with a type suffix
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SUFFIXED = r"[0-9.][dDfF]\s*,"


def stripped(col: Column | str) -> Column:
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def _required(value: Column, source: Column, what: str) -> Column:
    """``value``, or an error naming the offending text. Independent of the ANSI setting."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"not {what}: "), source)))


def parse_points(lines: DataFrame, drop_blank: bool = False) -> DataFrame:
    """``value`` -> ``coords array<double>, label string``; other columns are kept.

    All fields but the last are coordinates, the last one is the label. A line without
    coordinates is an error unless it is blank and ``drop_blank`` is set.
    """
    others = [c for c in lines.columns if c != "value"]
    if drop_blank:
        lines = lines.filter(stripped("value") != "")
    fields = F.split(stripped("value"), ",", -1)
    numbers = F.slice(fields, 1, F.size(fields) - 1)
    coords = numbers.try_cast("array<double>")
    # try_cast makes a bad element NULL; one scan of the array finds it
    good = (F.size(fields) > 1) & ~F.exists(coords, lambda x: x.isNull())
    good = good & ~F.col("value").rlike(SUFFIXED)  # a cast would take 1.5d for a number
    return lines.select(
        *others,
        _required(F.when(good, coords), F.col("value"), "a labelled point").alias("coords"),
        stripped(F.element_at(fields, -1)).alias("label"),
    )


def parse_items(lines: DataFrame) -> DataFrame:
    """``value`` -> ``item bigint``; other columns are kept."""
    others = [c for c in lines.columns if c != "value"]
    item = stripped("value").try_cast("bigint")
    return lines.select(*others, _required(item, F.col("value"), "an integer").alias("item"))


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word: split at every single space, so empty words are words too."""
    others = [c for c in docs.columns if c != "value"]
    return docs.select(*others, F.explode(F.split("value", " ", -1)).alias("word"))


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A document is one line: cut longer texts at newlines into ``doc_id, line, value``."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line", "value"))
