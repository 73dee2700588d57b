import random
import re

import frames
import pytest

from reachlens.llm import licenses
from reachlens.llm.licenses import Licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, rule=Licenses()):
    """Counts, labels and blocks by trying every place and every block."""
    w = words(text)
    base = sorted(
        (i, label) for phrase, label in rule.phrases for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()
    )
    blocks = []
    for label, template in rule.templates:
        t, k = words(template), rule.shingle
        tokens = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        for first in range(0, len(w), len(t)):
            block = w[first : first + 2 * len(t)]
            share = len(tokens & {tuple(block[i : i + k]) for i in range(len(block) - k + 1)}) / len(tokens)
            if share >= rule.least - 1e-9:
                blocks.append((first, first + len(block), label, share))
    known = {label for _, label in base}
    score = 1.0 if base else max((b[3] for b in blocks), default=0.0)
    labels = ",".join(sorted(known | {b[2] for b in blocks}))
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(known)), labels, score, sorted(blocks)


def check(df, rule=Licenses()):
    found = licenses.scan(df, rule).collect()
    texts = df.select("doc_id", "text").collect()
    got = sorted(((r[0], *r[1:8], sorted(tuple(b) for b in r.blocks)) for r in found), key=repr)
    assert got == sorted(((i, *brute(t, rule)) for i, t in texts), key=repr)
    return found


def test_whole_table(documents):
    assert any(r.labels for r in check(documents))


def noisy(chance, text, rate):
    return " ".join(w for w in text.split() if chance.random() > rate)


def test_notices_with_words_missing(spark):
    """Parts of notices, anywhere in a text, around the share that decides."""
    chance, rows = random.Random(5), []
    for i in range(150):
        _, template = chance.choice(licenses.TEMPLATES)
        filler = " ".join(chance.choice("alpha the of License software this is granted".split()) for _ in range(chance.randint(0, 90)))
        rows.append((i, filler + " " + noisy(chance, template, chance.choice([0, 0.01, 0.04])) + ".\n" + filler))
    found = check(frames.docs(spark, *rows))
    assert 0 < sum(not r.labels for r in found) < len(found)


def test_odd_rows(spark):
    mit = "Released under the MIT License. "
    rows = [
        (1, None), (2, ""), (None, mit), (None, mit), (3, "mit"), (4, "license mit license"), (5, "MIT\n--License mit.license"),
        (6, mit * 3000), (7, "ÀMIT License É apache license"), (8, "general public LICENSE"), (9, "x " * 40000 + mit), (9, "x"),
    ]
    df = frames.with_clashes(frames.docs(spark, *rows), "row", "at", "token", "block", "rank", "words", "labels", "size")
    found = check(df)
    assert len(found) == len(rows)


def test_tokens_in_both_blocks_and_repeats(spark):
    rule = Licenses(templates=(("a", "one two three four five six"), ("b", "one two three four five")), phrases=(("five six", "p"),))
    rows = [(i, "z " * i + "One, two; three four five six seven one two three four five") for i in range(20)]
    check(frames.docs(spark, *rows), rule)


def test_empty_table(spark):
    assert check(frames.docs(spark)) == []


def test_template_without_a_shingle(spark):
    with pytest.raises(ValueError):
        licenses.Vocabulary(Licenses(templates=(("a", "too short"),)))
