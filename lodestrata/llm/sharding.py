"""Feistel sharding: a reproducible shuffle with computable places (native).

Every row gets a global row number that depends on the rows alone: rows are
dealt into buckets (of about BUCKET_ROWS rows) by a hash of id and text, numbered inside
their bucket in id order, and moved up by the sizes of the buckets before it.
A keyed Feistel network over Z_m x Z_m with m = ceil(sqrt(N)) then permutes the
numbers; a value of N or more is put through again (cycle walking) until it lies
below N.  Position p goes to shard ``p mod shards``, slot ``p div shards``, so
shard sizes differ by one row at most and anyone who knows N and the seed can
compute a row's place, or the row at a place, without data.

The domain m*m exceeds N by at most 2*sqrt(N) + 1, so almost no value walks.  The
walk is unrolled to WALK steps; for N up to 900 that covers the longest possible
walk, above it the chance of a longer one is below (2/sqrt(N))**64, and such a
value raises an error instead of a wrong place.

Skew: only ids, sizes and hashes are shuffled, by a hash of id *and* text, so
neither copies of a text nor a hot source share a bucket.

Defined cases: a null text counts as empty; a null id is a value like any other
(first in its bucket); repeated rows each get a place of their own (they are
interchangeable; so are rows whose id and text hash are equal); an empty table gives an empty result; columns other than id
and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import materialise

ROUNDS = 4
WALK = 64
BUCKET_ROWS = 100_000
#: Buckets at least; the table of their sizes, a row per bucket, is the only one that one task sees whole.
BUCKETS = 4096


def feistel_once(x: Column, side: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over [0, side * side)."""
    right = F.pmod(x, F.lit(side))
    left = F.call_function("div", x, F.lit(side))
    for i in range(rounds):
        mixed = F.pmod(F.xxhash64(right, F.lit(i), F.lit(seed)), F.lit(side))
        left, right = right, F.pmod(left + mixed, F.lit(side))
    return left * F.lit(side) + right


def permute(x: Column, rows: int, seed: int) -> Column:
    """The image of row number ``x`` under the permutation of [0, rows)."""
    side = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    first = feistel_once(x, side, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), first,
        lambda p, _: F.when(p < F.lit(rows), p).otherwise(feistel_once(p, side, seed)),
    )
    return F.when(first < F.lit(rows), first).otherwise(walked)


def row_numbers(df: DataFrame, rows: int, key: list[str], order: list[str], name: str = "row_number") -> DataFrame:
    """Add gapless numbers from 0 to the ``rows`` rows, without a sort of all of them in one task.

    ``key`` is hashed into buckets of about BUCKET_ROWS rows, BUCKETS at least, so neither
    a bucket's window nor the broadcast table of offsets grows with the square of the input:
    10**11 rows have a million buckets.
    """
    buckets = max(BUCKETS, -(-rows // BUCKET_ROWS))
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    numbered = bucketed.withColumn("__inside", inside)
    return (
        numbered.join(F.broadcast(offsets), "__bucket")
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("long"))
        .drop("__bucket", "__before", "__inside")
    )


def shard(docs: DataFrame, shards: int = 8, seed: int = 20_240_601, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard and slot of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    small = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole).cast("long").alias("text_crc32"),
            F.xxhash64(whole).alias("__text"),
        ),
        "shard-rows",
    )
    rows = small.count()
    numbered = row_numbers(small, rows, ["doc_id", "__text"], ["doc_id", "__text"]).drop("__text")
    placed = numbered.withColumn("position", permute(F.col("row_number"), rows, seed))
    checked = F.when(F.col("position") < F.lit(rows), F.col("position")).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    placed = placed.withColumn("position", checked)
    return placed.withColumns({
        "shard": F.pmod(F.col("position"), F.lit(shards)).cast("int"),
        "slot": F.call_function("div", F.col("position"), F.lit(shards)).cast("long"),
    })
