import random
import re

import frames
import numpy as np
import xxhash

from reachlens.llm import graph, simhash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, ids, distance=4):
    fps = np.array(fps, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= distance) for f in fps]
    labels = np.array(ids)
    while True:
        lower = np.array([labels[n].min() for n in near])
        if (lower == labels).all():
            return labels.tolist()
        labels = lower


def test_whole_table(spark, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    expected = brute_classes(fps, [r.doc_id for r in rows])
    found = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert len(found) == len(rows)
    assert [found[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [found[r.doc_id].component_id for r in rows] == expected
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(expected))


def clusters(count, size, flips, seed):
    chance = random.Random(seed)
    out = []
    for _ in range(count):
        value = chance.getrandbits(64)
        for _ in range(size):
            value ^= sum(1 << b for b in chance.sample(range(64), chance.randint(0, flips)))
            out.append(value)
    return out


def check_links(spark, fps, rule):
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    found = {r.fp & (2**64 - 1): r.component_id for r in simhash.classes(df, rule).collect()}
    assert [found[f] for f in fps] == brute_classes(fps, list(range(len(fps))), rule.distance)


def test_chains_of_fingerprints(spark):
    """Walks of up to five flips: some steps link, some don't."""
    check_links(spark, clusters(40, 12, 5, 1), simhash.Near())


def test_dense_group_in_slices(spark):
    """Many fingerprints that share most bits, joined slice by slice."""
    check_links(spark, [simhash.signed(0) | (x * 0x9E37 & 0xFFFF) for x in range(600)], simhash.Near(distance=2, slice_rows=40))


def test_other_distance(spark):
    check_links(spark, clusters(30, 8, 3, 2), simhash.Near(distance=2))


def test_index_drops_nothing():
    chance = np.random.Generator(np.random.PCG64(3))
    base = chance.integers(0, 1 << 62, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(7), base ^ np.uint64(1 << 40)]))
    a, b = simhash._forest(fps.view(np.int64), np.zeros(len(fps), dtype=np.int64), 4)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 4).all()
    labels = np.arange(len(fps))
    for x, y in zip(a, b):
        labels[labels == max(labels[x], labels[y])] = min(labels[x], labels[y])
    assert labels.tolist() == brute_classes(fps, list(range(len(fps))))


def test_odd_rows(spark):
    long = "word " * 30000
    rows = [(4, None), (3, ""), (None, "a b c d e"), (9, "a b c d e"), (9, "A B C D E"), (7, "x"), (None, "alone here now ok"), (8, long), (2, long)]
    df = frames.with_clashes(frames.docs(spark, *rows), "fp", "component_id", "fingerprint", "u", "c0")
    found = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    classes = {(i, f): c for i, f, c in found}
    assert classes[3, "0" * 16] == classes[4, "0" * 16] == 3
    assert {c for (i, _), c in classes.items() if i == 9} == {9} and len(found) == len(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, 2), (False, 3), (False, 7), (False, 9), (True, 0)]


def test_empty_table(spark):
    assert simhash.near_duplicates(frames.docs(spark)).collect() == []
    assert simhash.keep_one(frames.docs(spark)).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5), (None, 3)], "a long, b long")
    found = {r.u: r.v for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 101)}, 201: 200}


def test_an_id_with_unrelated_texts(spark):
    """Each text is the smallest id of a component of its own, and none of the components is lost; nor do more stay."""
    one, two = "alpha beta gamma delta " * 9, "red green blue yellow black " * 9
    df = frames.docs(spark, (1, one), (1, two), (5, one), (6, two))
    assert len({r.fingerprint for r in simhash.near_duplicates(df).collect()}) == 2
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == sorted([(1, one), (1, two)])


def test_near_copies_without_ids(spark):
    """One row of a component stays, whatever the number of its fingerprints."""
    words = [f"word{i}" for i in range(600)]
    texts = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(0, 600, 60)]
    df = frames.docs(spark, *[(None, t) for t in texts])
    found = simhash.fingerprints(df, simhash.Near(), "doc_id", "text")
    classes = simhash.classes(found).collect()
    assert len({r.fp for r in classes}) > len({r.root for r in classes}) == simhash.keep_one(df).count()
