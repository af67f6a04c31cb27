"""A filter of bounded size in front of a shuffle: which rows may have a partner at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per value while they fit, and bits at most: 8 MB in every task.
BITS, MOST_BITS = 64, 1 << 26


def may_hold(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """Test for a 64-bit hash that is true for all of the ``n`` values of the only column, and for few others.

    Two bits per value are set.  Beyond ``MOST_BITS / BITS`` values the test lets more through, but never drops one.
    """
    size = min(MOST_BITS, max(1 << 12, 1 << (BITS * n).bit_length()))
    value = F.col(hashes.columns[0])

    def places(h: Column) -> list[Column]:
        return [part.bitwiseAND(F.lit(size - 1)) for part in (h, F.shiftrightunsigned(h, 32))]

    bit = hashes.select(F.explode(F.array(*places(value))).alias("at"))
    words = bit.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    every = hashes.sparkSession.range(size // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    listed = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    table = every.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")).scalar()

    def test(h: Column) -> Column:
        hits = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places(h)]
        return hits[0] & hits[1]

    return test
