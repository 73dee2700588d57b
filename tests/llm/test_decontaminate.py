import random
import re

import frames

from reachlens.llm import decontaminate
from reachlens.llm.decontaminate import Containment

WORDS = re.compile("[^\x00-/:-`{-\x7f]+")


def shingles(text, size=5):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + size]) for i in range(max(min(len(words), 1), len(words) - size + 1))}


def brute(docs, items, least=0.8):
    out = []
    for doc, text in docs:
        own = shingles(text)
        for item, wanted in items:
            asked = shingles(wanted)
            if asked and len(asked & own) >= least * len(asked):
                out.append((doc, item, len(asked), len(asked & own)))
    return sorted(out, key=str)


def items_of(spark, *rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_whole_table(spark, small, documents):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    found = sorted((tuple(r)[:4] for r in decontaminate.leaks(documents, benchmark).collect()), key=str)
    assert found == brute(rows, items) and found
    kept = decontaminate.remove_leaks(documents, benchmark)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, _ in rows} - {f[0] for f in found}


def test_parts_in_long_documents(spark):
    """Items of 4 to 200 words, whole, cut, with changed words or scattered over a long document; small blocks."""
    chance = random.Random(5)
    word = lambda: "".join(chance.choice("abcdefghij") for _ in range(4))
    items, docs = [], []
    for i, size in enumerate([4, 5, 6, 9, 15, 30, 31, 60, 120, 200] * 4):
        own = [word() for _ in range(size)]
        items.append((i, " ".join(own)))
        part = own[: max(1, int(size * chance.uniform(0.75, 1.1)))]
        if chance.random() < 0.3 and len(part) > 8:
            part[len(part) // 2] = word()
        filler = [word() for _ in range(chance.choice([0, 50, 3000]))]
        cut = chance.randint(0, len(filler))
        docs.append((i, " ".join(filler[:cut]) + ", " + " ".join(part).upper() + ". " + " ".join(filler[cut:])))
    df, benchmark = frames.docs(spark, *docs), items_of(spark, *items)
    expected = brute(docs, items)
    assert 10 < len(expected) < 40
    for rule in (Containment(), Containment(block_items=7)):
        found = sorted((tuple(r)[:4] for r in decontaminate.leaks(df, benchmark, rule).collect()), key=str)
        assert found == expected


def test_minima_of_larger_items_are_enough(spark):
    """Items above the exact size go through their bins only."""
    rule = Containment()
    items = decontaminate.Items([(0, " ".join(f"w{i}" for i in range(300)))], rule)
    for bits in (0, 3, 8):
        assert len(items.lookup(bits)[0]) <= 2**bits
    assert rule.exact_below() < 40


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (5, "a b " * 20000)]
    items = [(1, "Alpha, beta: gamma; delta epsilon!"), (2, None), (3, ""), (4, "..."), (None, "a b a b a b"), (1, "zzz")]
    df = frames.with_clashes(frames.docs(spark, *docs), "item_id", "containment", "lowered", "c1")
    found = sorted((tuple(r)[:4] for r in decontaminate.leaks(df, items_of(spark, *items)).collect()), key=str)
    assert found == brute(docs, items)
    kept = decontaminate.remove_leaks(df, items_of(spark, *items))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_empty_tables(spark, documents):
    assert decontaminate.leaks(documents, items_of(spark)).collect() == []
    assert decontaminate.leaks(frames.docs(spark), items_of(spark, (1, "a b c d e"))).collect() == []
    assert decontaminate.remove_leaks(documents, items_of(spark)).count() == documents.count()
