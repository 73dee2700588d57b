"""SimHash near duplicates with a hierarchical index over fingerprints in Gray order.

Fingerprints within ``distance`` bits agree on two of ``distance + 2`` blocks of bits, whichever bits differ. So for
each pair of blocks the distinct fingerprints are dealt out by those bits and sorted by their rank in the Gray code, which
puts fingerprints with few differing bits near each other. Over a sorted group stands an index: a node holds the bits that all
of its fingerprints share, with a mask. Two nodes whose shared bits differ in more than ``distance`` places are dropped
with everything below them; so are nodes that are connected already. Only a forest of links leaves a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.llm import graph
from reachlens.session import materialize

FAN = 8
PAIRS = 1 << 15
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Near:
    """``shingle`` words, at most ``distance`` differing bits; groups above ``slice_rows`` are joined in slices."""

    shingle: int = 4
    distance: int = 4
    seed: int = 42
    slice_rows: int = 1 << 17

    def masks(self) -> list[int]:
        """The bits of every pair of blocks."""
        blocks = self.distance + 2
        cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
        bits = [((1 << end) - 1) ^ ((1 << start) - 1) for start, end in zip(cuts, cuts[1:])]
        return [a | b for a, b in combinations(bits, 2)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes, rule: Near) -> int:
    """The fingerprint of a UTF-8 text: a bit is set if it is set in over half the shingle hashes; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(rule.shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, rule.seed
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(starts), 1 << 16):
        part = slice(low, low + (1 << 16))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part], ends[part])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints_of(text: Column, rule: Near) -> Column:
    """The fingerprint of a text column, as a signed number; a null text has no words."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        raw = (text.as_buffer().to_pybytes() if text.is_valid else b"" for text in texts)
        return pa.array([signed(fingerprint(text, rule)) for text in raw], type=pa.int64())

    return fingerprints(text)


def fingerprints(docs: DataFrame, rule: Near = Near(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), fingerprints_of(F.col(text_column), rule).alias("fp"))


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in the Gray code: every bit the parity of the bits from it upwards."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _forest(fps: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect everything that is within ``distance`` in a group; rows of a group stand together."""
    fps = fps.view(np.uint64)
    labels = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def unite(a: np.ndarray, b: np.ndarray) -> bool:
        nonlocal labels
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        differ = low != high
        if not differ.any():
            return False
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        _, pick = np.unique(low * len(fps) + high, return_index=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        used = []
        for i, x, y in zip(pick.tolist(), low[pick].tolist(), high[pick].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append(i)
        found.append((a[used], b[used]))
        changed = np.arange(len(fps))
        for x in list(parent):
            changed[x] = root(x)
        labels = changed[labels]
        return True

    def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[a] ^ fps[b]) <= distance

    for step in (1, 2):  # neighbours in Gray order
        a = np.flatnonzero(groups[:-step] == groups[step:])
        a = a[within(a, a + step)]
        unite(a, a + step)
    # Levels of nodes from the fingerprints up; ``bounds[k]`` has the children of the nodes of level k + 1.
    every, some, owner, bounds = [fps], [fps], [groups], []
    while np.any(owner[-1][1:] == owner[-1][:-1]):
        own = owner[-1]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        inside = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
        starts = np.flatnonzero(inside % FAN == 0)
        bounds.append(np.append(starts, len(own)))
        every.append(np.bitwise_and.reduceat(every[-1], starts))
        some.append(np.bitwise_or.reduceat(some[-1], starts))
        owner.append(own[starts])
    if not bounds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spread() -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below every node."""
        low, high, out = labels, labels, [(labels, labels)]
        for cut in bounds:
            low, high = np.minimum.reduceat(low, cut[:-1]), np.maximum.reduceat(high, cut[:-1])
            out.append((low, high))
        return out

    spans = spread()
    top = len(bounds)
    roots = np.arange(len(owner[top]))
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIRS:
            stack.append((level, a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        low, high = spans[level]
        open_ = ~((low[a] == high[b]) & (low[b] == high[a]))
        if level:
            shared = ~(every[level][a] ^ some[level][a]) & ~(every[level][b] ^ some[level][b])
            open_ &= np.bitwise_count((every[level][a] ^ every[level][b]) & shared) <= distance
        else:
            open_ &= within(a, b)
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        if not level:
            if unite(a, b):
                spans = spread()
            continue
        cut = bounds[level - 1]
        rows, columns = cut[a + 1] - cut[a], cut[b + 1] - cut[b]
        total = rows * columns
        pair = np.repeat(np.arange(len(a)), total)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        x, y = cut[a[pair]] + inside // columns[pair], cut[b[pair]] + inside % columns[pair]
        keep = (x <= y) if level > 1 else (x < y)
        keep |= a[pair] != b[pair]
        stack.append((level - 1, x[keep], y[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _link(distance: int):
    """Rows ``part, fp`` sorted by part: the links of every part, when it is complete."""

    def solve(keys: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch | None:
        new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
        together = np.repeat(sizes > 1, sizes)
        groups = np.cumsum(new)[together]
        fps = fps[together]
        if not len(fps):
            return None
        a, b = _forest(fps, groups, distance)
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], schema=_LINKS) if len(a) else None

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            same = np.all([k == k[-1] for k in columns[:-1]], axis=0)
            open_from = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if open_from:
                done = [np.concatenate(x) for x in zip(*parts, [c[:open_from] for c in columns])]
                if (out := solve(done[:-1], done[-1])) is not None:
                    yield out
                parts = []
            elif parts and any(k[-1] != c[0] for k, c in zip(parts[-1][:-1], columns[:-1])):
                done = [np.concatenate(x) for x in zip(*parts)]
                if (out := solve(done[:-1], done[-1])) is not None:
                    yield out
                parts = []
            parts.append([c[open_from:] for c in columns])
        if parts:
            done = [np.concatenate(x) for x in zip(*parts)]
            if (out := solve(done[:-1], done[-1])) is not None:
                yield out

    return function


def links(fps: DataFrame, rule: Near = Near()) -> DataFrame:
    """``a, b``: fingerprints of a forest whose components are those of all pairs within the distance.

    ``fps`` has distinct fingerprints in ``fp``. A group above ``slice_rows`` is cut into s slices and every two of them
    meet in a part of their own, so no task holds more than two slices.
    """
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(mask))) for mask in rule.masks()])
    rows = fps.select("fp", F.posexplode(keys).alias("blocks", "bits"))
    sizes = rows.groupBy("blocks", "bits").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > rule.slice_rows)
    large = sizes.select("blocks", "bits", F.ceil(F.col("size") / rule.slice_rows).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    # Slice pairs that this row takes part in, numbered low * slices + high.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda i: F.least(i, F.col("own")) * F.col("slices") + F.greatest(i, F.col("own")),
    )
    dealt = (
        rows.join(large, ["blocks", "bits"], "left")
        .withColumn("own", own)
        .withColumn("part", F.explode(F.when(F.col("slices").isNull(), F.array(F.lit(0))).otherwise(meets)))
    )
    sorted_rows = dealt.repartition("blocks", "bits", "part").sortWithinPartitions(
        "blocks", "bits", "part", gray_rank(F.col("fp"))
    )
    return sorted_rows.select("blocks", "bits", "part", "fp").mapInArrow(_link(rule.distance), "a long, b long")


def classes(found: DataFrame, rule: Near = Near()) -> DataFrame:
    """``fp, root, component_id``: for every distinct fingerprint the one that stands for its component, and the smallest
    document id that links reach from it.

    Ids that are null are passed over; a component of such documents only has a null id.
    """
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    stars = graph.components(links(distinct.select("fp"), rule))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, rule: Near = Near(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` in hex, ``component_id``.

    Null texts and texts without words have fingerprint zero and link like others. Repeated rows are in one component. Other
    columns are not read.
    """
    found = materialize(fingerprints(docs, rule, id_column, text_column), "simhash")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.join(classes(found, rule), "fp").select("doc_id", hexed, "component_id")


def keep_one(
    docs: DataFrame, rule: Near = Near(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of every component, that with the smallest id; all columns of ``docs`` stay as they are.

    Of rows that share that id one stays. If no row of a component has an id, one of its rows stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(name)] for name in (id_column, text_column))
    # Written with their fingerprints: reading the rows again costs far less than a second pass over the words.
    marked = materialize(docs.toDF(*names).withColumn("fp", fingerprints_of(F.col(own_text), rule)), "simhash")
    found = marked.select(F.col(own_id).cast("long").alias("doc_id"), "fp")
    named = classes(found, rule)
    # Of the smallest id's fingerprints in the component (an id may have several rows, in other components too) the smallest.
    chosen = (
        found.join(named, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.first("component_id").alias("__keep_id"), F.min("fp").alias("__keep_fp"))
        .drop("root")
    )
    same = F.col(own_id).cast("long").eqNullSafe(F.col("__keep_id")) & (F.col("fp") == F.col("__keep_fp"))
    once = marked.join(chosen, same, "left_semi").dropDuplicates([own_id, "fp"])
    return once.select(*[F.col(name).alias(c) for name, c in zip(names, docs.columns)])
