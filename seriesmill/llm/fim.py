"""Fill-in-the-middle examples: repeated-capture matching gives the number of units and both cuts.

A text is units, runs of ASCII letters or single other code points. One full match of `(unit)*` by
the regex library keeps the end of every repetition of its group, so `ends(1)` is the list of all
places where a text may be cut: its length is the number of units, and the cut after u units is
its entry u - 1. No unit is looked at by Python code. Unit and repetition are possessive: no two
ways to match exist, so nothing is kept for backtracking.

Four numbers from a seeded hash of the id decide: two of them, modulo units + 1, are the cuts, the
third whether a text stays plain, the fourth the order of the parts (prefix, suffix, middle or
suffix, prefix, middle). The parts follow markers; a text that has a marker itself stays plain, so
every example can be taken apart again: no marker begins inside another, hence the first one found
is the one that was written.

Scale: one scan without a shuffle. Python gets texts and gives three numbers each; examples,
rebuilt texts and digests are built-in expressions. Memory is that of a batch of texts and the ends
of one text's units.

Defined results: a null text is an empty one; an empty text has 0 units and stays plain; a null id
is hashed as an empty string; rows with equal ids are cut alike where their texts are equal; plain
rows have null prefix_chars and middle_chars; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import named

UNITS = r"([A-Za-z]++|[^A-Za-z])*+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
PERCENT = 90
SUFFIX_FIRST_PERCENT = 20


def cuts(text: Column, one: Column, other: Column, units: str = UNITS) -> Column:
    """n, prefix_end and middle_end in code points; the cuts follow the smaller and the larger of
    one and other, modulo n + 1, units."""

    @F.pandas_udf("n long, prefix_end long, middle_end long")
    def cut(texts: pd.Series, ones: pd.Series, others: pd.Series) -> pd.DataFrame:
        match = regex.compile(units).fullmatch
        out = []
        for string, a, b in zip(texts, ones, others, strict=True):
            ends = [0, *match(string).ends(1)]
            low, high = sorted((a % len(ends), b % len(ends)))
            out.append((len(ends) - 1, ends[low], ends[high]))
        return pd.DataFrame(out, columns=["n", "prefix_end", "middle_end"])

    return cut(text, one, other)


def example(text: Column, form: Column, prefix_end: Column, middle_end: Column) -> Column:
    """The text in its form: the parts after their markers, or the text itself."""
    prefix = F.substring(text, F.lit(1), prefix_end.cast("int"))
    middle = F.substring(text, (prefix_end + 1).cast("int"), (middle_end - prefix_end).cast("int"))
    suffix = F.substring(text, (middle_end + 1).cast("int"), F.length(text))
    mark = {x: F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE)}
    return (
        F.when(form == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle))
        .when(form == "spm", F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle))
        .otherwise(text)
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from, out of the example and its form alone."""

    def between(second: str) -> tuple[Column, Column, Column]:
        """What follows the first marker, the second one and that of the middle."""
        width = len(second)
        start = F.instr(output, second)
        rest = F.substring(output, start + width, F.length(output))
        end = F.instr(rest, MIDDLE)
        first = F.substring(output, F.lit(width + 1), start - width - 1)
        return first, F.substring(rest, F.lit(1), end - 1), F.substring(rest, end + width, F.length(output))

    prefix, suffix, middle = between(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def hash_number(digest: Column, group: int) -> Column:
    """The group-th eight digits of a hexadecimal digest as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    percent: int = PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output."""
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (hash_number(digest, i) for i in range(4))
    rows = rows.withColumn("cut", cuts(F.col("text"), h1, h2))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    cut_up = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(cut_up, F.col("cut.prefix_end")).alias("prefix_chars"),
        F.when(cut_up, F.col("cut.middle_end") - F.col("cut.prefix_end")).alias("middle_chars"),
        example(F.col("text"), F.col("form"), F.col("cut.prefix_end"), F.col("cut.middle_end")).alias("output"),
    )
