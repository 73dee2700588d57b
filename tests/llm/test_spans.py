import random

import frames
from pyspark.sql import functions as F

from reachlens.llm import pii, secret_scan
from reachlens.llm import spans as S

SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def replaced(text, spans):
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_overlaps_and_replacement_against_brute_force(spark):
    chance = random.Random(4)
    rows = []
    for i in range(300):
        text = "".join(chance.choice("ab é日😀\n") for _ in range(chance.choice([0, 1, 30, 255, 256, 257, 512, 1500])))

        def some(most):
            places = [chance.randrange(len(text)) for _ in range(chance.randint(0, most))] if text else []
            return [(a, chance.randint(0, 2), min(len(text), a + chance.choice([1, 3, 40, 300])), chance.choice("xy")) for a in places]

        rows.append((i, text, some(12), some(3)))
    df = spark.createDataFrame(rows, f"i int, text string, own {SPANS}, other {SPANS}")
    got = df.select("i", S.apart(F.col("own"), F.col("other")).alias("apart"), S.replaced(F.col("text"), F.col("own")).alias("told")).collect()
    for r in got:
        _, text, own, other = rows[r.i]
        assert [tuple(s) for s in r.apart] == [s for s in own if not any(s[0] < o[2] and o[0] < s[2] for o in other)]
        assert r.told == replaced(text, own)


def test_parts_and_running_values(spark):
    text = "".join(random.Random(5).choice("abc日😀\n") for _ in range(1000))
    cuts = [(0, 0), (0, 1), (255, 257), (256, 256), (0, 1000), (990, 2000), (1000, 1008), (511, 513)]
    df = spark.createDataFrame([(text, cuts)], "t string, cuts array<struct<a:int,b:int>>")
    got = df.select(F.transform("cuts", lambda c: S.part(S.chunks(F.col("t")), c["a"], c["b"])).alias("x")).first().x
    assert got == [text[a:b] for a, b in cuts]
    sums = spark.range(1).select(
        S.running(F.sequence(F.lit(1), F.lit(100)), lambda x, y: x + y).alias("up"),
        S.running(F.sequence(F.lit(1), F.lit(100)), F.greatest, backward=True).alias("down"),
        S.running(F.array().cast("array<int>"), F.greatest).alias("none"),
    ).first()
    assert sums.up == [i * (i + 1) // 2 for i in range(1, 101)] and sums.down == [100] * 100 and sums.none == []


def test_a_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    text = " ".join(f"user{i:06d}@ex.com" for i in range(n))
    found = pii.scan(frames.docs(spark, (1, text))).select("n_email", F.size("found").alias("n"), F.element_at("found", -1).alias("last")).first()
    assert (found.n_email, found.n) == (n, n)
    assert (found.last.start, found.last.end) == (len(text) - 17, len(text))
    assert pii.mask(frames.docs(spark, (1, text)), length_column=None).first().text == " ".join(["<EMAIL>"] * n)
    keys = " ".join(f"{i * 2654435761:020x}"[:20] for i in range(n))
    got = secret_scan.scan(frames.docs(spark, (1, keys))).select("n_hex", F.size("found").alias("n")).first()
    assert got.n_hex == n and got.n >= n
