import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reachlens.llm import prefix_trie
from reachlens.llm.prefix_trie import Screen

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """Every node by its sequence of turns, its figures by walking over all nodes below it."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in own.items():
        own[conv] = [(t[2], t[3]) for t in sorted(turns, key=lambda t: (t[0], t[1], t[2], digest(t[2], t[3])))]
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5 if conv >= 0 else -(abs(conv) % 5))
        path = tuple([*own.get(base, [])[:head], *turns[head:]])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        yield path
        for child in children[path]:
            yield from below(child)

    out = []
    for path, convs in members.items():
        inside = list(below(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children[path]),
            sum(not children[p] for p in inside),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in inside if p),
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def check(df, screen=Screen()):
    found = sorted((tuple(r) for r in prefix_trie.trie(df, screen).collect()), key=repr)
    assert found == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    return found


def talks(chance, convs, kinds=3, most=14):
    rows = []
    for c in range(convs):
        rows += [(c, t, "user" if t % 2 else "bot", chance.choice("abc"[:kinds])) for t in range(chance.randint(1, most))]
    return rows


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/conversations.parquet"))


@pytest.mark.parametrize("counters", [1, 2, 16, 1 << 27])
def test_sketches_of_any_size(spark, counters):
    """With few counters most estimates are too large and proven prefixes lie above unproven ones."""
    rows = talks(random.Random(7), 60)
    assert len(check(frame(spark, *rows), Screen(most_counters=counters))) > 200


def test_copies_and_long_runs(spark):
    """Many copies, a conversation with a large share of all rows, and runs and ends that are summed in parts."""
    rows = [(5 * c, t, "user", f"turn {t % 7}") for c in range(40) for t in range(6)]
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(300)] + [(1005, t, "user", f"turn {t % 7}") for t in range(280)]
    check(frame(spark, *rows).repartition(6), Screen(end_keys=16, run=8))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody"), (0, None, "user", "first"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "", ""), (0, 1, "a", "b"),
        (1, 3, "", "only"), (2, 1, "12", "3:x"), (2, 1, "1", "23:x"), (-3, 0, "user", "first"), (-5, 0, "user", "é"), (-4, 7, "user", "é"),
        (1 << 40, 0, "user", "x" * 100000), ((1 << 40) + 5, 0, "user", "x" * 100000), (7, 0, "u", "t"), (8, 0, "u", "t"), (9, 0, "u", "t"),
    ]
    rows += [(c, t, "u", "same") for c in range(20, 40) for t in range(10)]
    df = frame(spark, *rows).select("*", *[F.lit(1).alias(n) for n in ("conv", "part", "place", "digest", "size", "depth", "x", "own")])
    check(df)


def test_conversations_without_turns(spark):
    """Own turns that all give way to a conversation that is not there."""
    rows = [(c, 0, "user", "gone") for c in range(1, 200) if c % 5]
    found = check(frame(spark, *rows))
    assert found[0][1] in (0, 1)
    gone = [(c, 0, "u", "t") for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert [r[1] for r in check(frame(spark, *gone))] == [0]


def test_empty_table(spark):
    assert check(frame(spark)) == []
    assert check(frame(spark, (None, 1, "user", "x"))) == []


def test_running_values_over_parts(spark):
    rows = [(k, p, o, k * 100 + 10 * p + o) for k in range(3) for p in range(k + 1) for o in range(5)]
    df = spark.createDataFrame(rows, "k int, p int, o int, v long")
    found = {tuple(r)[:3]: (r.s, r.z) for r in prefix_trie.running(
        prefix_trie.running(df, "k", "p", "o", {"s": F.col("v")}, F.sum), "k", "p", "o", {"z": F.col("v")}, F.bit_xor
    ).collect()}
    for k, p, o, _ in rows:
        before = [v for kk, pp, oo, v in rows if kk == k and (pp, oo) <= (p, o)]
        assert found[k, p, o] == (sum(before), int(np.bitwise_xor.reduce(before)))


def test_estimates_are_never_too_small():
    chance = np.random.default_rng(1)
    x = chance.integers(-(1 << 62), 1 << 62, 3000)
    x[1000:2000], depth = x[:1000], np.ones(3000, dtype=np.int64)
    for counters in (64, 1 << 12, 1 << 17):
        names = pa.RecordBatch.from_arrays([pa.array(x), pa.array(x), pa.array(depth)], names=["x", "y", "depth"])
        touched = pa.Table.from_batches(prefix_trie._count(counters)(iter([names.slice(0, 1500), names.slice(1500)]))).sort_by("chunk")
        added = pa.Table.from_batches(prefix_trie._add(iter(touched.to_batches())))
        sketch = prefix_trie.Sketch(counters, dict(zip(*(c.to_pylist() for c in added.columns))))
        proven = sketch.proven(x, x, depth)
        assert not proven[:2000].any()
        assert counters < 1 << 17 or proven[2000:].mean() > 0.9
