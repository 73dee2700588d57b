"""The trie of all prefixes of rebuilt conversations, with figures for every node.

No text travels. A turn is its SHA-256 and its size; a prefix is its depth and a 128-bit digest, the exclusive or of two
64-bit hashes of every turn together with its place. Digests of prefixes are therefore running values, which can be put
together from parts: turns are range-partitioned, and a conversation that spans many partitions is a running value within
each and a carry between them, so no conversation has to fit a task.

Which prefixes are shared is screened first. Every task counts the prefix digests it sees into a count-min sketch whose counters
stop at two; the sketches are added up and given back to all tasks. An estimate is never too small, so an estimate of one
proves that only one conversation has the prefix, and with it every longer one. Tails below a proven prefix are emitted where they lie:
their figures follow from their own conversation. Only prefixes that are possibly shared are shuffled and grouped by their
digests; that a group turns out to have one member (counters collide) changes nothing in the result.

Figures over subtrees need no walk over levels. A node is represented by its smallest member, and the nodes of one
representative are a run of depths on its conversation. A sum over the nodes below ``u`` is the sum of the runs of all
members of ``u``, less what the run of u's own representative has above u: one aggregation over the members of the shared nodes.

The sketch has eight counters a prefix in each of its two rows, and at most ``Screen.most_counters`` a row, so what is broadcast is bounded: of
a counter that has been added up one bit is left. With more prefixes than that holds, collisions send more of them to the
grouping, one at a time: a conversation's next prefix has its own estimate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachlens.llm.words import mix
from reachlens.session import materialize

_CHUNK_BITS = 16
_CHUNK = 1 << _CHUNK_BITS
_ROWS = 2


@dataclass(frozen=True)
class Screen:
    """``counters`` a prefix and row of the sketch; ``most_counters`` of a row (2 ** 27 are 32 MB for both rows).

    ``end_keys``: width of the range of conversation keys joined to one text when the ends of a node are listed.
    ``run``: depths of a run that are summed at once.
    """

    counters: int = 8
    most_counters: int = 1 << 27
    end_keys: int = 4096
    run: int = 1 << 16


@dataclass(frozen=True)
class Rebuild:
    """A conversation c gets the first h turns of conversation c - c % ``family`` for its own first h; h = crc32(c) % ``heads``."""

    family: int = 5
    heads: int = 9

    def head(self, conv: Column) -> Column:
        return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % self.heads


def running(df: DataFrame, key: str, part: str, order: str, values: dict[str, Column], total) -> DataFrame:
    """``df`` with running values within ``key``, in the order of ``part`` and then ``order``, this row included.

    ``total`` is ``F.sum`` or ``F.bit_xor``. A window holds one part of one key; the parts' totals are carried on in a
    second, far smaller pass, so it doesn't matter how many rows a key has as long as its parts are bounded.
    """
    own = Window.partitionBy(key, part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, part).agg(*[total(column).alias(name) for name, column in values.items()])
    carry = sums.select(key, part, *[total(name).over(earlier).alias(f"__{name}") for name in values])
    carry = carry.where(F.col(f"__{next(iter(values))}").isNotNull())
    local = df.withColumns({name: total(column).over(own) for name, column in values.items()})
    joined = local.join(carry, [key, part], "left")
    for name in values:
        before = F.coalesce(F.col(f"__{name}"), F.lit(0))
        joined = joined.withColumn(name, F.col(name).bitwiseXOR(before) if total is F.bit_xor else F.col(name) + before)
    return joined.drop(*[f"__{name}" for name in values])


def _turns(df: DataFrame) -> DataFrame:
    """``conv, part, place, digest, size``: turns in their order, numbered from 0 within their conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("size")
    )
    order = ["conv", "turn", "role", "digest", "tie"]
    parted = materialize(rows, "turns").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = parted.sortWithinPartitions(*order).select("conv", "digest", "size", F.monotonically_increasing_id().alias("seat"))
    seated = materialize(placed, "seated-turns").withColumn("part", F.shiftrightunsigned("seat", 33))
    one = {"place": F.lit(1).cast("long")}
    return running(seated, "conv", "part", "seat", one, F.sum).withColumn("place", F.col("place") - 1).drop("seat")


def _prefixes(turns: DataFrame, rule: Rebuild) -> tuple[DataFrame, DataFrame]:
    """``conv, depth, x, y, px, py, size, length``: every prefix of every rebuilt conversation, the root aside.

    The second frame has a row for every conversation, with its ``length``. ``px, py`` is the digest one turn shorter, ``size`` the bytes of the last turn, ``length`` the turns of the conversation.
    """
    turns = materialize(turns, "turns-in-place")
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    base = F.col("conv") - F.col("conv") % rule.family
    heads = own.select("conv", "own", base.alias("base"), rule.head(F.col("conv")).alias("head"))
    bases = own.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    joined = F.least("head", F.coalesce("base_turns", F.lit(0)))
    plans = heads.join(bases, "base", "left").withColumn("joined", joined)
    plans = plans.withColumn("length", F.col("joined") + F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    plans = materialize(plans, "rebuilds")
    tails = turns.join(plans, "conv").where(F.col("place") >= F.col("head"))
    tails = tails.select("conv", "part", (F.col("place") - F.col("head") + F.col("joined")).alias("place"), "digest", "size", "length")
    first = turns.where(F.col("place") < rule.heads - 1).withColumnRenamed("conv", "base").drop("part")
    front = first.join(plans, "base").where(F.col("place") < F.col("joined"))
    front = front.select("conv", F.lit(-1).cast("long").alias("part"), "place", "digest", "size", "length")
    x, y = (F.xxhash64(F.lit(lane), "place", "digest") for lane in ("x", "y"))
    rebuilt = tails.unionByName(front).select("conv", "part", "place", "size", "length", x.alias("tx"), y.alias("ty"))
    rebuilt = running(rebuilt, "conv", "part", "place", {"x": F.col("tx"), "y": F.col("ty")}, F.bit_xor)
    prefixes = rebuilt.select(
        "conv",
        (F.col("place") + 1).alias("depth"),
        "x",
        "y",
        F.col("x").bitwiseXOR(F.col("tx")).alias("px"),
        F.col("y").bitwiseXOR(F.col("ty")).alias("py"),
        F.col("size").cast("long").alias("size"),
        F.col("length").cast("long").alias("length"),
    )
    return prefixes, plans


def _cells(x: np.ndarray, y: np.ndarray, depth: np.ndarray, counters: int) -> list[np.ndarray]:
    """The counter of a prefix in each row of the sketch."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    seeds = (mix(x ^ depth.astype(np.uint64)), mix(y + depth.astype(np.uint64)))
    return [(s & np.uint64(counters - 1)).astype(np.int64) for s in seeds]


def _chunks(counters: int) -> int:
    """Chunks that the counters of a row take."""
    return max(1, counters >> _CHUNK_BITS)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("x", "y", "depth"))


def _count(counters: int):
    """The counters a batch touches, by chunk: those seen once and those seen more often, as 16-bit places."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, depth = _columns(batch)
            for row, cells in enumerate(_cells(x, y, depth, counters)):
                cell, times = np.unique(cells, return_counts=True)
                chunk = cell >> _CHUNK_BITS
                cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk)) if len(chunk) else [0]
                out = [(row * _chunks(counters) + int(chunk[a]), cell[a:b], times[a:b]) for a, b in zip(cuts, cuts[1:])]
                low = [(cell & (_CHUNK - 1)).astype("<u2") for _, cell, _ in out]
                columns = [
                    pa.array([chunk for chunk, _, _ in out], pa.int64()),
                    pa.array([c[t == 1].tobytes() for c, (_, _, t) in zip(low, out)], pa.binary()),
                    pa.array([c[t > 1].tobytes() for c, (_, _, t) in zip(low, out)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "once", "often"])

    return function


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of counters, one at a time, from rows sorted by chunk; a bit tells the counters at two."""
    current, counts = None, np.zeros(_CHUNK, dtype=np.uint8)

    def packed() -> pa.RecordBatch:
        bits = np.packbits(counts > 1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

    for batch in batches:
        for chunk, once, often in zip(*(column.to_pylist() for column in batch.columns)):
            if chunk != current:
                if current is not None:
                    yield packed()
                current, counts[:] = chunk, 0
            cells = np.frombuffer(once, "<u2")
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[np.frombuffer(often, "<u2")] = 2
    if current is not None:
        yield packed()


class Sketch:
    """Count-min counters that stop at two: a bit for each, set if it got there."""

    def __init__(self, counters: int, chunks: dict[int, bytes]):
        self.counters, self.row = counters, _chunks(counters) * _CHUNK
        self.twice = np.zeros(_ROWS * self.row // 8, dtype=np.uint8)
        for chunk, bits in chunks.items():
            self.twice[chunk * _CHUNK // 8 : (chunk + 1) * _CHUNK // 8] = np.frombuffer(bits, np.uint8)

    def proven(self, x: np.ndarray, y: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Prefixes, all counted, whose estimate is one: in some row nothing else has their counter."""
        single = np.zeros(len(x), dtype=bool)
        for row, cells in enumerate(_cells(x, y, depth, self.counters)):
            at = cells + row * self.row
            single |= (self.twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 0
        return single


def sketch_of(prefixes: DataFrame, rows: int, rule: Screen) -> Sketch:
    """The sketch of all prefixes. Counters a row: a power of two, ``most_counters`` at most."""
    counters = 1 << min((rule.counters * max(1, rows) - 1).bit_length(), rule.most_counters.bit_length() - 1)
    touched = prefixes.select("x", "y", "depth").mapInArrow(_count(counters), "chunk long, once binary, often binary")
    dealt = touched.repartition("chunk").sortWithinPartitions("chunk")
    found = materialize(dealt.mapInArrow(_add, "chunk long, bits binary"), "sketch")
    return Sketch(counters, dict(found.collect()))  # a bit a counter, most_counters at most


def _screen(shared):
    """Marks proven prefixes, and those whose parent is proven too."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            x, y, depth = _columns(batch)
            px, py = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("px", "py"))
            single = sketch.proven(x, y, depth)
            below = sketch.proven(px, py, depth - 1) & (depth > 1)
            marks = [pa.array(single | below), pa.array(below)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "single", "below"])

    return function


def _ends(prefixes: DataFrame, rule: Screen) -> DataFrame:
    """``depth, x, y, ends``: hash of the listed conversations that end at a node, for nodes where two or more do.

    Keys are joined to texts by range, at most ``end_keys`` in one, and a node's texts are hashed one after the other in order.
    """
    ended = prefixes.where(F.col("depth") == F.col("length"))
    texts = ended.groupBy("depth", "x", "y", F.floor(F.col("conv") / rule.end_keys).alias("range")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("keys")
    )
    order = ["depth", "x", "y", "range"]
    return texts.repartition("depth", "x", "y").sortWithinPartitions(*order).select(*order, "keys").mapInArrow(
        _hash_in_order, "depth long, x long, y long, ends string"
    )


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None

    def done(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)]
        ends = pa.array([r[1] for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([*columns, ends], names=["depth", "x", "y", "ends"])

    for batch in batches:
        rows = []
        for depth, x, y, _, keys in zip(*(column.to_pylist() for column in batch.columns)):
            if (depth, x, y) != node:
                if node is not None:
                    rows.append((node, state.hexdigest()))
                node, state = (depth, x, y), hashlib.sha256(keys.encode())
            else:
                state.update(b"," + keys.encode())
        yield done(rows)
    if node is not None:
        yield done([(node, state.hexdigest())])


_NODE = ["depth", "x", "y"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _tails(screened: DataFrame) -> DataFrame:
    """Nodes proven to have one member. Whose parent is proven as well has its parent's key: its own."""
    last = F.col("depth") == F.col("length")
    return screened.where("single").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("below"), F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
        "px",
        "py",
        "below",
    )


def trie(df: DataFrame, screen: Screen = Screen(), rebuild: Rebuild = Rebuild()) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    Rows without ``conv_id`` belong to no conversation. Turns with equal numbers, null ones included, are taken in the order
    of their roles and then of their digests; repeated rows are turns of their own. For a negative key the remainder has the
    key's sign. A table without conversations has no nodes, not even a root.
    """
    prefixes, plans = _prefixes(_turns(df), rebuild)
    prefixes = materialize(prefixes, "prefixes")
    smallest, n_prefixes = plans.agg(F.min("conv"), F.sum("length")).first()
    shared = df.sparkSession.sparkContext.broadcast(sketch_of(prefixes, n_prefixes or 0, screen))
    schema = f"{', '.join(f'{n} {t}' for n, t in prefixes.dtypes)}, single boolean, below boolean"
    screened = materialize(prefixes.mapInArrow(_screen(shared), schema), "screened")
    shared.unpersist()

    # The root stands for every conversation; it is a shared prefix without turns.
    zero = F.lit(0).cast("long")
    roots = plans.select("conv", *[zero.alias(n) for n in ("depth", "x", "y", "px", "py", "size")], F.col("length").cast("long").alias("length"))
    common = screened.where(~F.col("single")).drop("single", "below").unionByName(roots)
    grouped = common.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count(F.when(F.col("depth") == F.col("length"), 1)).alias("n_ends"),
        F.max(F.when(F.col("depth") == F.col("length"), F.col("conv"))).alias("last_end"),
        *[F.first(name).alias(name) for name in ("px", "py", "size")],
    )
    nodes = materialize(grouped, "shared-prefixes")
    tails = _tails(screened)
    entries = tails.where(~F.col("below"))
    parents = nodes.where(F.col("depth") > 0).select("depth", "px", "py").unionByName(entries.select("depth", "px", "py"))
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.withColumn("own", own).withColumn("part", F.floor(F.col("depth") / screen.run))
    nodes = materialize(running(nodes, "conv_id", "part", "depth", {"run": F.col("own")}, F.sum), "runs")

    # A conversation brings its run of nodes to all nodes it is a member of: what they save, and its leaf.
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    runs = nodes.select(F.col("conv_id").alias("conv"), "own", leaf.alias("leaf"))
    lonely = screened.where(F.col("single") & (F.col("depth") == F.col("length")))
    runs = runs.unionByName(lonely.select("conv", zero.alias("own"), F.lit(1).cast("long").alias("leaf")))
    brought = runs.groupBy("conv").agg(F.sum("own").alias("brought"), F.sum("leaf").alias("leaves"))
    brought = brought.where((F.col("brought") > 0) | (F.col("leaves") > 0))
    members = common.select("conv", *_NODE).join(brought, "conv")
    below = members.groupBy(*_NODE).agg(F.sum("brought").alias("brought"), F.sum("leaves").alias("n_leaves"))
    several = nodes.where(F.col("n_ends") > 1).select(*_NODE)
    listed = _ends(common.join(several, _NODE, "left_semi"), screen)
    keys = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))

    full = nodes.join(below, _NODE).join(listed, _NODE, "left")
    one = F.when(F.col("n_ends") == 1, F.sha2(F.col("last_end").cast("string"), 256)).otherwise(F.lit(_NO_ENDS))
    inner = full.select(
        "conv_id",
        "depth",
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("brought") - F.col("run") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends", one).alias("ends_sha256"),
        "px",
        "py",
    )
    result = [name for name in inner.columns if name not in ("px", "py")]
    waiting = inner.unionByName(entries.drop("below"))
    # Nodes right below the root get its key as a literal, so that the root is no hot key of the join.
    top = waiting.where(F.col("depth") <= 1).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")))
    # A parent that was not grouped has been proven by a shorter prefix; it has the one member that this node has.
    lower = waiting.where(F.col("depth") > 1).join(keys, ["depth", "px", "py"], "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent", "conv_id"))
    return reduce(DataFrame.unionByName, [frame.select(*result) for frame in (tails.where("below"), top, lower)])
