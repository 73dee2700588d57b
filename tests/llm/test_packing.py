import random
import zlib
from collections import Counter, defaultdict

import frames
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reachlens.llm import packing
from reachlens.llm.queries import tokenizer_file

FILE = str(tokenizer_file())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


ODD = [
    "", " ", "  two  blanks ", "tab\there", "line \n break", "\n\nx\n\n y", "<|endoftext|> mid <|endoftext|>", "it's we'll DON'T", "日本語 text",
    "naïve café", "a b", "x\r\ny", "12 345 6_7 __ --", "emoji 😀 end", "ends with blank ", " starts", "a\n\nb c\nd", "“quoted” …", "\x00nul",
]


def test_ids_are_those_of_the_tokenizer(tokenizer, documents):
    texts = ODD + [r.text or "" for r in documents.select("text").collect()]
    chance = random.Random(1)
    texts += ["".join(chance.choice("ab ',.\n1é日'\t  s") for _ in range(60)) for _ in range(300)]
    encoder = packing.Encoder(packing.Packing(FILE))
    for text, found in zip(texts, encoder(pa.array(texts))):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(df, tokenizer, capacity=1024):
    rule = packing.Packing(FILE, capacity=capacity)
    rows = packing.pack(df, rule).collect()
    expected = Counter()
    for doc_id, text in df.select("doc_id", "text").collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[start:end], dtype="<u4").tobytes())
            expected[doc_id, piece, start, end - start, crc] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r.length for r in rows) // capacity)


def test_whole_table(documents, tokenizer):
    used, bound = check(documents, tokenizer)
    assert used <= 1.05 * bound + 1


def test_odd_rows(spark, tokenizer):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(1, None), (None, "no id"), (3, "same"), (3, "same"), (9, "long word " * 9000)]
    df = frames.with_clashes(frames.docs(spark, *rows), "length", "task", "number", "piece", "own", "before")
    check(df, tokenizer)
    check(df, tokenizer, capacity=7)
    check(df, tokenizer, capacity=1)


def test_empty_table(spark, tokenizer):
    assert check(frames.docs(spark), tokenizer) == (0, 0)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole(seed):
    chance = random.Random(seed)
    capacity = chance.choice([5, 16, 64, 256])
    counts = {n: chance.randint(0, 10 ** chance.randint(0, 6)) for n in range(1, capacity + 1)}
    for depth in range(4):
        plan = packing.Plan(counts, capacity, depth)
        used = Counter()
        for lengths, times in plan.groups:
            assert sum(lengths) <= capacity and times > 0
            for n in lengths:
                used[n] += times
        assert all(used[n] == k for n, k in counts.items())
    fewest = packing.Plan.fewest(counts, capacity)
    assert fewest.sequences() <= packing.Plan(counts, capacity, 0).sequences()
    segments = fewest.segments()
    assert len(segments) == sum(len(lengths) for lengths, _ in fewest.groups)


def test_exact_complements():
    assert packing.Plan({6: 2, 4: 2}, 10).groups == [((6, 4), 2)]
    assert packing.Plan({7: 3, 2: 3, 1: 3}, 10).groups == [((7, 2, 1), 3)]
    assert packing.Plan({5: 1, 3: 1, 1: 2}, 10).groups == [((5, 3, 1, 1), 1)]
    assert packing.Plan({5: 3}, 10).groups[0] == ((5, 5), 1)
