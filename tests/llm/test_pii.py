import random
import re

import frames
import pytest
from test_secret_scan import brute as brute_spans

from reachlens.llm import pii


def luhn(number):
    return sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(number))) % 10 == 0


def only(m):
    return re.sub("[^0-9]", "", m[0])


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
]
BASE = [k for k, _, _ in PATTERNS]


def check(df, rows):
    found = pii.scan(df).collect()
    expected = sorted(str((i, *brute_spans(t, PATTERNS)[:2])) for i, t in rows)
    assert sorted(str((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256)) for r in found) == expected
    for r in found:
        kept = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in BASE)
        assert kept == brute_spans(dict(rows)[r.doc_id], PATTERNS)[2] or [i for i, _ in rows].count(r.doc_id) > 1
    return found


def test_whole_table(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sum(r.n_email + r.n_phone for r in check(documents, rows)) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_texts(spark, seed):
    chance = random.Random(seed)
    parts = ["a", "b.c", "_x", "@", "@d.e", ".", "-", " ", "  ", "+", "(", ")", "4111111111111111", "1", "23", "256", "0255", "1.2.3.4", "%", "é", "日", "\n", "55-5", "12 34"]
    rows = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(1, 40)))) for i in range(400)]
    check(frames.docs(spark, *rows), rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "a@b.co"), (3, "a@b.com_x@y.org"), (4, "1" * 30000), (5, "a.a." * 20000 + "@b.c"), (6, "1." * 20000), (7, "+1" + " 2" * 20000),
        (8, "x@" + "a." * 20000 + "b"), (9, "😀 +1 (443) 555-5793 é 4485 2753 3022 3391 9"), (9, "same id"), (10, "12 -34 4111-1111-1111-1111 300.1.1.1.1"),
    ]
    check(frames.with_clashes(frames.docs(spark, *rows), "base", "loose", "found", "start", "kind", "c0", "masked", "match"), rows)


def test_empty_table(spark):
    assert pii.scan(frames.docs(spark)).collect() == []
    assert pii.mask(frames.docs(spark)).collect() == []


def test_mask(spark):
    rows = [(1, "mail ab@c.de, call +1 (443) 555-5793."), (2, "nothing"), (3, None), (4, "1.2.3.4"), (4, "é 4111111111111111 é")]
    df = frames.with_clashes(frames.docs(spark, *rows), "found", "base", "masked", "c1")
    out = pii.mask(df)
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    masked = [(1, "mail <EMAIL>, call <PHONE>."), (2, "nothing"), (3, None), (4, "<IP>"), (4, "é <CARD> é")]
    assert texts == sorted(((i, t, len(t or "")) for i, t in masked), key=str)


def test_mask_of_overlapping_spans(spark):
    text = "+4111111111111 x"
    (row,) = pii.mask(frames.docs(spark, (1, text))).collect()
    assert "4111" not in row.text and row.text.endswith(" x")


def test_weak_labels_separate_good_from_bad_candidates(spark):
    """Numbers without a known format: with cue words and clean borders they count, inside paths and versions not."""
    chance = random.Random(3)
    number = lambda: f"{chance.randint(200, 999)}-{chance.randint(200, 999)}-{chance.randint(1000, 9999)}"
    good = [(i, f"please call my phone {number()} today") for i in range(120)]
    bad = [(200 + i, f"see http://host/doc/id={number()}x and page") for i in range(120)]
    found = {r.doc_id: r.spans for r in pii.scan(frames.docs(spark, *good, *bad)).collect()}
    assert sum("phone_like" in found[i] for i, _ in good) >= 0.9 * len(good)
    assert sum("_like" in found[i] for i, _ in bad) <= 0.1 * len(bad)


def test_reliabilities_from_vote_patterns():
    """Votes drawn from labelers of known quality: the estimated order is theirs."""
    chance = random.Random(1)
    quality = dict(zip(pii.LABELERS, (0.95, 0.9, 0.8, 0.7, 0.6)))
    counts = {}
    for _ in range(20000):
        truth = chance.random() < 0.6
        vote = tuple((1 if truth else -1) if chance.random() < q else (-1 if truth else 1) for q in quality.values())
        counts[vote] = counts.get(vote, 0) + 1
    patterns = [{"kind": "x", "n": n, **dict(zip(pii.LABELERS, vote))} for vote, n in counts.items()]
    posterior, agree = pii._estimate(patterns, pii.Weak())
    for name, q in quality.items():
        assert agree["x"][name] == pytest.approx(q, abs=0.05)
    assert posterior["x", (1, 1, 1, 1, 1)] > 0.99 and posterior["x", (-1, -1, -1, -1, -1)] < 0.01
