"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of their ids. The number is written as two digits to bases a and b with a * b just above
the row count; a few Feistel rounds permute the pairs, and a result that is no row number is permuted again until it
is one (cycle walking), which keeps the whole a permutation of the row numbers. The permuted number modulo the shards is
the shard, the quotient the slot: both can be computed for any row from its number alone, and shards differ by one row
at most. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlens.session import materialize

_LOCAL = (1 << 33) - 1


@dataclass(frozen=True)
class Shuffle:
    shards: int = 8
    seed: int = 20240229
    rounds: int = 6


class Permutation:
    """A keyed permutation of 0..rows-1 as a column expression."""

    def __init__(self, rows: int, rule: Shuffle):
        self.rows, self.rule = rows, rule
        self.a = max(1, math.isqrt(max(0, rows - 1)) + 1)
        self.b = max(1, -(-rows // self.a))

    def _keyed(self, value: Column, turn: int, size: int) -> Column:
        """A pseudo-random digit of a base from the other digit."""
        text = F.concat(F.lit(f"{self.rule.seed}:{turn}:"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))

    def once(self, df: DataFrame, column: str) -> DataFrame:
        """One pass of the rounds over the numbers 0..a*b-1 in ``column``."""
        df = df.withColumn("__x", F.floor(F.col(column) / self.b)).withColumn("__y", F.pmod(F.col(column), F.lit(self.b)))
        for turn in range(self.rule.rounds):
            name, other, size = ("__x", "__y", self.a) if turn % 2 == 0 else ("__y", "__x", self.b)
            df = df.withColumn(name, F.pmod(F.col(name) + self._keyed(F.col(other), turn, size), F.lit(size)))
        return df.withColumn(column, F.col("__x") * self.b + F.col("__y")).drop("__x", "__y")

    def longest_walk(self, spark) -> int:
        """Passes that the longest cycle walk from a row number may need.

        A walk runs through numbers that are no row numbers; there are at most a + b of them, and following all of
        those at once, until they are row numbers or back where they began, tells how long any walk can be.
        """
        outside = spark.range(self.rows, self.a * self.b).select("id", F.col("id").alias("at"))
        passes = 1
        while not outside.isEmpty():
            moved = self.once(outside, "at")
            outside = materialize(moved.where((F.col("at") >= self.rows) & (F.col("at") != F.col("id"))), "walk")
            passes += 1
        return passes

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the numbers in ``column`` permuted."""
        df = self.once(df, column)
        for _ in range(self.longest_walk(df.sparkSession) - 1):
            walked = self.once(df.withColumn("__again", F.col(column)), "__again")
            df = walked.withColumn(column, F.when(F.col(column) >= self.rows, F.col("__again")).otherwise(F.col(column))).drop("__again")
        return df


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a global row number in ``number``, in the order of the named columns, nulls first.

    The rows are range-partitioned and sorted; a row's number is its place in its partition plus the rows of the
    partitions before it. Rows equal in ``order`` are spread by an extra key, so a repeated row is no hot key; which
    of them comes first is arbitrary.
    """
    keyed = rows.withColumn("__tie", F.monotonically_increasing_id())
    parted = keyed.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = parted.withColumn("__place", F.monotonically_increasing_id())
    frozen = materialize(placed, "numbered").withColumn("__part", F.shiftrightunsigned("__place", 33))
    sizes = frozen.groupBy("__part").agg(F.count(F.lit(1)).alias("__own"))
    # One row per partition: its size does not depend on the rows.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__own").over(before), F.lit(0))).drop("__own")
    number = F.col("__before") + F.col("__place").bitwiseAND(F.lit(_LOCAL))
    return frozen.join(F.broadcast(starts), "__part").withColumn("number", number).drop("__part", "__place", "__before")


def shard(docs: DataFrame, rule: Shuffle = Shuffle(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, number, shard, slot, grown_shard`` of every row.

    Rows are numbered by id, then checksum, then size. The law is ``rows``: shards differ by one row at most, slots run
    from 0 without gaps; a further shard would move rows, so ``grown_shard`` is null. A null text has size 1 and the
    checksum of the empty text; null ids come first.
    """
    raw = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    counted = numbered(rows, ["doc_id", "text_crc32", "size"])
    total = docs.count()
    permuted = Permutation(total, rule).apply(counted.withColumn("place", F.col("number")), "place")
    return permuted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(rule.shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / rule.shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
