import zlib
from collections import Counter, defaultdict

import frames

from reachlens.llm import sharding
from reachlens.llm.sharding import Permutation, Shuffle


def check(df, shards=8):
    rows = sharding.shard(df, Shuffle(shards=shards)).collect()
    texts = [(i, (t or "").encode()) for i, t in df.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    ordered = sorted(rows, key=lambda r: r.number)
    assert [r.number for r in ordered] == list(range(len(rows)))
    keys = [(r.doc_id is not None, r.doc_id, r.text_crc32, r.size) for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or 0, *k[2:]))
    return ordered


def test_whole_table(documents):
    once = check(documents)
    again = check(documents.repartition(5))
    assert once == again
    order = [r.slot * 8 + r.shard for r in once]
    assert sum(b == a + 1 for a, b in zip(order, order[1:])) < len(order) / 10


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, None), (3, "same"), (3, "same"), (4, "é" * 50000)] + [(7, "hot")] * 40
    df = frames.with_clashes(frames.docs(spark, *rows), "size", "place", "slot", "number", "law", "shard")
    check(df)
    check(df, 3)
    check(df, 100)


def test_empty_table(spark):
    assert check(frames.docs(spark)) == []


def test_permutations_of_all_small_sizes(spark):
    """Cycle walking included: row numbers are permuted onto themselves."""
    for rows in (1, 2, 3, 5, 7, 10, 13, 50):
        df = spark.range(rows).selectExpr("id", "id as to")
        moved = Permutation(rows, Shuffle(seed=rows)).apply(df, "to").collect()
        assert sorted(r["to"] for r in moved) == list(range(rows))
