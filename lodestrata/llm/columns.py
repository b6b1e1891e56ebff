"""Column building blocks that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blank_words(text: Column) -> Column:
    """Maximal runs of characters other than BLANKS; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def alnum_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def pairs(a: Column, b: Column, shift: int, combine) -> Column:
    """combine(a[i], b[i + shift]) for every i where both exist."""
    left = F.slice(a, F.lit(1), F.greatest(F.size(b) - F.lit(shift), F.lit(0)))
    right = F.slice(b, F.lit(shift + 1), F.size(b))
    return F.zip_with(left, right, lambda x, y: combine(x, y))


def with_grams(df: DataFrame, source: str, target: str, k: int, combine=F.xxhash64) -> DataFrame:
    """Add ``target``: one value for each run of ``k`` neighbours in ``source``.

    Runs are built by doubling, so k costs about log2(k) passes over the array.
    With ``combine`` a hash the values identify k-grams; with ``F.least`` they
    are sliding minima.  Overlapping halves are harmless for both.
    """
    have, size, step = source, 1, 0
    while size < k:
        shift = min(size, k - size)
        step += 1
        name = target if size + shift == k else f"{target}_{step}"
        df = df.withColumn(name, pairs(F.col(have), F.col(have), shift, combine))
        if have not in (source,):
            df = df.drop(have)
        have, size = name, size + shift
    return df if have == target else df.withColumn(target, F.col(source))


def unnested(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """``keep`` and one row ``x`` for each member of ``array`` that is not null.

    With a plain explode the optimiser adds a filter on the array's size and moves it
    down to the scan, which computes the array twice and, where it is built in many
    steps, writes out all of them in one huge expression.
    """
    return df.select(*keep, F.explode_outer(array).alias("x")).where(F.col("x").isNotNull())


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text (null counts as empty)."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def closed(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` under names of its own (``__in0``, ...), and the column of each old name.

    An operator that works on it can add any other name without a clash.
    """
    names = [f"__in{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {old: F.col(new) for old, new in zip(df.columns, names)}


def reopened(columns: dict[str, Column], *added: str) -> list[Column]:
    """The old columns under their names, but for those that ``added`` ones replace, and then these."""
    return [*(c.alias(name) for name, c in columns.items() if name not in added), *map(F.col, added)]
