"""Approximate nearest neighbours with a forest of sorted hash-prefix arrays.

Every vector has a string of 64 hash bits per tree, the sides of random hyperplanes it lies on. A tree is the sorted array of
these strings; the rows that share a prefix with a query stand together in it. A search descends in every tree to
the longest prefix the query shares with some rows, then ascends in all trees at the same pace, one bit at a time. The rows below
the prefixes are compared exactly, in double precision.

When to stop follows from the distances found, not from the number of rows. Two vectors at an angle a lie on the same side of
a random plane with probability p = 1 - a / pi, so a row is missed at d bits in all of t trees with probability (1 - p^d)^t.
The angle of a row not farther than the k-th best found is bounded by that distance and the lengths of the vectors; the ascent
ends where the probability to miss such a row is at most ``miss``. Clustered vectors stop after few rows. Where
neighbours are hardly nearer than other rows, the ascent goes on, to all rows if need be, where the answer is exact.

The index is partitioned: each task builds the forest of its own rows, shard by shard, and answers a block of queries on
it; only the best few of each shard are shuffled. Every row is indexed in some shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Forest:
    """``trees`` of 64 bits; ``miss``: probability, at most, to miss a row as near as the k-th found; ``floor``: rows per tree,
    besides k, below the prefixes from which the ascent starts. ``block_bytes`` of queries are broadcast at once; the forest is
    built anew for every such block, which costs little beside the block's searches."""

    trees: int = 12
    miss: float = 0.1
    floor: int = 16
    shard_rows: int = 1 << 16
    block_bytes: int = 64 << 20
    seed: int = 7

    def planes(self, dimension: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.seed)).standard_normal((dimension, 64 * self.trees))


def _strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as 64-bit numbers, most significant bit first: rows by trees."""
    out = np.empty((len(vectors), planes.shape[1] // 64), dtype=np.uint64)
    for low in range(0, len(vectors), 4096):
        sides = vectors[low : low + 4096] @ planes > 0
        out[low : low + 4096] = np.packbits(sides, axis=1).view(">u8")
    return out


class Shard:
    """The sorted arrays of some rows."""

    #: Queries searched together, each with a mark per row.
    GROUP = 64

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, planes: np.ndarray, rule: Forest):
        self.ids, self.vectors, self.rule, self.planes = ids, vectors, rule, planes
        strings = np.ascontiguousarray(_strings(vectors, planes).T)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        lengths = np.sqrt(np.square(vectors).sum(axis=1))
        self.shortest, self.longest = lengths.min(), lengths.max()

    def _ranges(self, queries: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the rows that share the query's leading ``bits`` bits."""
        rest = (64 - bits).astype(np.uint64)
        mask = np.where(bits == 0, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(rest, np.uint64(63))) - np.uint64(1))[:, None]
        low, high = queries & ~mask, queries | mask
        trees = range(queries.shape[1])
        first = np.stack([np.searchsorted(self.sorted[t], low[:, t], side="left") for t in trees], axis=1)
        last = np.stack([np.searchsorted(self.sorted[t], high[:, t], side="right") for t in trees], axis=1)
        return first, last

    def enough(self, distance: float, length: float) -> float:
        """Bits from which on down a row within ``distance`` of a query of this length is missed rarely enough."""
        if distance == 0:
            return 64.0
        # The widest angle at that distance is that of a tangent, if a row can be as long as that.
        own = np.clip(np.sqrt(max(length * length - distance * distance, 0.0)), self.shortest, self.longest)
        cosine = (length * length + own * own - distance * distance) / (2 * length * own)
        same = 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
        share = 1 - self.rule.miss ** (1 / self.rule.trees)
        if same <= 0:
            return 0.0
        return 64.0 if same >= 1 else np.log(share) / np.log(same)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """Query id, ids and distances of its nearest rows here, number of rows looked at."""
        for at in range(0, len(query_ids), self.GROUP):
            yield from self._group(query_ids[at : at + self.GROUP], queries[at : at + self.GROUP], k)

    def _start(self, strings: np.ndarray, k: int) -> np.ndarray:
        """The longest common prefix length below which some rows stand; the count falls as prefixes grow."""
        wanted = (self.rule.floor + k) * self.rule.trees
        low, high = np.zeros(len(strings), dtype=np.int64), np.full(len(strings), 64)
        while np.any(low < high):
            middle = (low + high + 1) // 2
            first, last = self._ranges(strings, middle)
            some = (last - first).sum(axis=1) >= wanted
            low, high = np.where(some, middle, low), np.where(some, high, middle - 1)
        return low

    def _group(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        strings = _strings(queries, self.planes)
        bits, lengths = self._start(strings, k), np.sqrt(np.square(queries).sum(axis=1))
        seen = self.ids[None, :] == query_ids[:, None]
        near = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(queries)
        looked, active = np.zeros(len(queries), dtype=np.int64), np.arange(len(queries))
        while len(active):
            first, last = self._ranges(strings[active], bits[active])
            ascending = []
            for i, begin, end in zip(active.tolist(), first.tolist(), last.tolist()):
                below = np.zeros(len(self.ids), dtype=bool)
                for t, (a, b) in enumerate(zip(begin, end)):
                    below[self.order[t, a:b]] = True
                rows = np.flatnonzero(below & ~seen[i])
                seen[i] |= below
                looked[i] += len(rows)
                distance = np.concatenate([near[i][1], np.sqrt(np.square(self.vectors[rows] - queries[i]).sum(axis=1))])
                ids = np.concatenate([near[i][0], self.ids[rows]])
                best = np.lexsort((ids, distance))[:k]
                near[i] = ids[best], distance[best]
                if bits[i] and (len(best) < k or self.enough(distance[best[-1]], lengths[i]) < bits[i]):
                    ascending.append(i)
            active = np.array(ascending, dtype=np.int64)
            bits[active] -= 1
        for i, query_id in enumerate(query_ids.tolist()):
            yield query_id, *near[i], int(looked[i])


def _search(shared, rule: Forest, k: int):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        planes = rule.planes(queries.shape[1])
        ids, vectors, held = [], [], 0

        def answers() -> Iterator[pa.RecordBatch]:
            shard = Shard(np.concatenate(ids), np.concatenate(vectors), planes, rule)
            for found in batched(shard.search(query_ids, queries, k), 4096):
                columns = [
                    np.repeat([x[0] for x in found], [len(x[1]) for x in found]),
                    np.concatenate([x[1] for x in found]),
                    np.concatenate([x[2] for x in found]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy())
            vectors.append(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64))
            held += batch.num_rows
            if held >= rule.shard_rows:
                yield from answers()
                ids, vectors, held = [], [], 0
        if held:
            yield from answers()

    return function


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part: an id, components that are finite numbers, not all zero."""
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(finite, F.lit(False)).alias("ok"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("ok") & F.exists("vector", lambda x: x != 0)).select("vec_id", "vector")


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    rule: Forest = Forest(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of all other rows, for ids divisible by ``every``.

    Vectors of another length than the most frequent one can't be compared and take no part. Of repeated query
    rows the smallest vector counts; repeated other rows are separate candidates. Queries come in blocks of consecutive ids,
    at most ``block_bytes`` each; only such a block is broadcast.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == lengths["length"])
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    width = every * max(1, rule.block_bytes // (8 * lengths["length"] + 8))
    starts = asked.select(F.floor(F.col("vec_id") / width).alias("block")).distinct().orderBy("block")
    found = None
    for (block,) in starts.toLocalIterator():
        own = asked.where((F.col("vec_id") >= block * width) & (F.col("vec_id") < (block + 1) * width)).toArrow()
        ids = own["vec_id"].to_numpy()
        queries = own["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, queries))
        # A shard keeps its best only, so what a task sends is bounded by queries and k.
        part = _best(rows.mapInArrow(_search(shared, rule, k), _FOUND), k)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found
