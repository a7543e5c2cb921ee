"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Below this many rows no key is worth a way of its own.
HOT_ROWS = 1_000_000
# A hot key has more than this share of the rows, so there are fewer than 1 / share.
HOT_SHARE = 0.001
# What may be broadcast, in rows and in bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Bits that tell which keys are asked for: so many a key, and powers of two of them at least and at most.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 27


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a table of strings and numbers is small enough to be broadcast."""
    size = reduce(
        lambda a, b: a + b,
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns),
        F.lit(0).cast("bigint"),
    )
    seen = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")
    ).first()
    return seen["rows"] <= BROADCAST_ROWS and seen["bytes"] <= BROADCAST_BYTES


def only_wanted(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The records whose key is asked for, whatever the number of keys.

    Few keys are broadcast to the scans. Many are joined by shuffle, after most records that
    are not asked for have gone at the scans by broadcast bits, at most 16 MB of them.
    """
    if fits_broadcast(keys):
        return records.join(F.broadcast(keys), on, "left_semi")
    return _likely_wanted(records, keys, on).join(keys, on, "left_semi")


def _likely_wanted(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``records`` without those whose key has not both its bits among those of ``keys``.

    No record of a key of ``keys`` goes; the fuller the bits, the more others stay.
    """
    spark, keys = records.sparkSession, keys.select(*on)
    digits = min(max((BITS_PER_KEY * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    hashed = F.xxhash64(*on)
    bits = [h.bitwiseAND(F.lit((1 << digits) - 1)) for h in (hashed, F.shiftrightunsigned(hashed, 32))]
    word, place = (lambda bit: F.shiftright(bit, 6).cast("int")), (lambda bit: bit.bitwiseAND(F.lit(63)).cast("int"))
    marks = keys.select(F.explode(F.array(*bits)).alias("bit")).select(
        word(F.col("bit")).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mark")
    )
    found = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    words = np.zeros(1 << (digits - 6), np.int64)
    words[found["word"].to_numpy()] = found["mark"].to_numpy()
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    asked = F.broadcast(spark.createDataFrame(pa.table([row], names=["_asked"])))
    both = [F.getbit(F.get("_asked", word(bit)), place(bit)) == 1 for bit in bits]
    return records.join(asked, both[0] & both[1], "left_semi")


def join_unique(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key.

    Keys that hold more than a thousandth of ``left`` take a broadcast join of their
    own, of fewer than a thousand rows; the others are joined as usual. ``left`` is a
    stored table, as it is read for the counts and for both joins.
    """
    total = left.count()
    if total <= hot_rows:
        return left.join(right, on, how)
    limit = max(hot_rows // 10, int(total * HOT_SHARE))
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*on)
    keys = F.broadcast(hot)
    hot_right = F.broadcast(right.join(keys, on, "left_semi"))
    parts = (
        left.join(keys, on, "left_semi").join(hot_right, on, how),
        left.join(keys, on, "left_anti").join(right, on, how),
    )
    return parts[0].unionByName(parts[1])


def first_rows(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each group; all but one per task are dropped before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")
