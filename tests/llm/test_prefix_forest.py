import numpy as np

from reachlens.llm import prefix_forest
from reachlens.llm.prefix_forest import Forest, Shard

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    """Exact neighbours of the queries among usable rows."""
    usable = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % every == 0:
            near = sorted((float(np.sqrt(np.square(w - v).sum())), j) for j, w in usable if j != i)
            out[i] = near[:k]
    return out


def found(df, **settings):
    out = {}
    for r in sorted(prefix_forest.search(df, **settings).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def recall(result, exact):
    hits = sum(len({j for _, j in result.get(i, [])} & {j for _, j in near}) for i, near in exact.items())
    return hits / sum(map(len, exact.values()))


def test_recall_on_whole_table(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    exact = brute([(r.vec_id, r.embedding) for r in vectors.collect()], every=10)
    result = found(vectors, every=10, rule=Forest(floor=2))
    assert set(result) == set(exact) and recall(result, exact) >= 0.9
    for i, near in result.items():
        scores = dict((j, s) for s, j in near)
        assert near == sorted(near) and all(abs(scores[j] - s) < 1e-12 for s, j in exact[i] if j in scores)


def test_shards_and_query_blocks_change_little(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").repartition(3)
    exact = brute([(r.vec_id, r.embedding) for r in vectors.collect()], every=10)
    result = found(vectors, every=10, rule=Forest(floor=2, shard_rows=40, block_bytes=4096))
    assert set(result) == set(exact) and recall(result, exact) >= 0.9


def test_ranges_are_those_of_common_prefixes():
    chance = np.random.Generator(np.random.PCG64(1))
    vectors = chance.standard_normal((200, 5))
    rule = Forest(trees=3)
    shard = Shard(np.arange(200), vectors, rule.planes(5), rule)
    strings = prefix_forest._strings(vectors, rule.planes(5))
    for bits in (0, 1, 5, 63, 64):
        first, last = shard._ranges(strings[:9], np.full(9, bits))
        for q in range(9):
            for t in range(3):
                same = {j for j in range(200) if bits == 0 or int(strings[j, t]) >> (64 - bits) == int(strings[q, t]) >> (64 - bits)}
                assert set(shard.order[t, first[q, t] : last[q, t]].tolist()) == same


def looked_and_recall(vectors, rule, queries=60, k=10):
    ids = np.arange(len(vectors))
    shard = Shard(ids, vectors, rule.planes(vectors.shape[1]), rule)
    looked = hits = 0
    for i, near, distance, rows in shard.search(ids[:queries], vectors[:queries], k):
        exact = np.sqrt(np.square(vectors - vectors[i]).sum(axis=1))
        exact[i] = np.inf
        hits += len(set(near.tolist()) & set(np.argsort(exact, kind="stable")[:k].tolist()))
        looked += rows
        assert np.array_equal(distance, exact[near])
    return looked / queries / len(vectors), hits / queries / k


def test_clustered_vectors_stop_early_and_others_go_on():
    chance = np.random.Generator(np.random.PCG64(3))
    centres = chance.standard_normal((200, 32))
    clustered = centres[np.arange(20000) % 200] + 0.1 * chance.standard_normal((20000, 32))
    looked, recall_found = looked_and_recall(clustered, Forest())
    assert looked < 0.05 and recall_found >= 0.9
    looked, recall_found = looked_and_recall(chance.standard_normal((5000, 32)), Forest())
    assert recall_found >= 0.9


def test_rows_looked_at_do_not_follow_the_size():
    """Four times the rows in four times the clusters: about the same rows are looked at."""
    shares = []
    for clusters in (100, 400):
        chance = np.random.Generator(np.random.PCG64(4))
        centres = chance.standard_normal((clusters, 32))
        rows = centres[np.arange(clusters * 100) % clusters] + 0.05 * chance.standard_normal((clusters * 100, 32))
        shares.append(looked_and_recall(rows, Forest())[0] * len(rows))
    assert shares[1] < 2 * shares[0]


def test_the_bound_on_bits_is_that_of_the_widest_angle():
    chance = np.random.Generator(np.random.PCG64(5))
    vectors = chance.standard_normal((300, 6))
    rule = Forest()
    shard = Shard(np.arange(300), vectors, rule.planes(6), rule)
    q, length = vectors[0], np.linalg.norm(vectors[0])
    for r in (0.5, 1.0, 2.0, 4.0):
        bits = shard.enough(r, length)
        for w in vectors[np.linalg.norm(vectors - q, axis=1) <= r][1:]:
            same = 1 - np.arccos(np.clip(q @ w / length / np.linalg.norm(w), -1, 1)) / np.pi
            assert (1 - same**bits) ** rule.trees <= rule.miss + 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [3.0, 4.0]), (200, None), (0, [1.0, 0.0]), (-100, [1.0, 1.0]),
    ]
    from frames import with_clashes

    df = with_clashes(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), "vector", "score", "rank", "query_id", "ok")
    result = found(df)
    assert set(result) == {0, 100, -100}
    assert [j for _, j in result[0]] == [1, 2, -100, 100, 10]
    assert result[100][0] == (np.sqrt(2.0), -100) and [j for _, j in result[100]].count(0) == 2


def test_hot_vector(spark):
    """A third of the rows is one vector: its nearest are the equal ones with the smallest ids."""
    chance = np.random.Generator(np.random.PCG64(2))
    rows = [(i, ([0.5] * 8 if i % 3 == 0 else chance.standard_normal(8).tolist()), 0) for i in range(900)]
    result = found(spark.createDataFrame(rows, SCHEMA))
    assert result[300] == [(0.0, j) for j in range(0, 30, 3)]


def test_few_rows_and_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0], 1), (5, [3.0], 1)], SCHEMA)) == {0: [(2.0, 5)]}
