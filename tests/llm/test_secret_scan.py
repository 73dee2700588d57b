import hashlib
import math
import random
import re
import string

import frames
import pytest
from pyspark.sql import functions as F

from reachlens.llm import secret_scan

PATTERNS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def brute(text, patterns=PATTERNS):
    spans = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(patterns) for m in re.finditer(p, text or "") if ok(m))
    line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return [sum(s[3] == k for s in spans) for k, _, _ in patterns], hashlib.sha256(line.encode()).hexdigest(), line


def check(df, rows):
    found = secret_scan.scan(df).collect()
    expected = sorted(str((i, *brute(t)[:2])) for i, t in rows)
    assert sorted(str((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256)) for r in found) == expected
    for r in found:
        kept = ",".join(s for s in r.spans.split(",") if not s.startswith("random"))
        assert hashlib.sha256(kept.encode()).hexdigest() == r.base_sha256
    return found


def test_whole_table(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sum(r.n_hex for r in check(documents, rows)) > 0


def test_generated_texts(spark):
    chance = random.Random(4)
    parts = ["token", "Secret", "api_key", "APIKEY", "passwd", "pass", "=", ":", " ", '"', "'", "AKIA", "0a1b2c3d4e5f", "abcdef0123456789", "Zz9", "é", "日", "-", ".", "\n", "ABCDEFGH12345678"]
    rows = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(1, 40)))) for i in range(400)]
    check(frames.docs(spark, *rows), rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "token=abcdefghijkl"), (3, "password: token:abcdefghijkl"), (4, "AKIAAKIA" + "A" * 10), (5, "f" * 100000), (5, "f" * 100000),
        (6, "secret = 'short' api-key=abcdefghijklm token = \"abc.def/ghi=jkl\""), (7, "x " * 50000 + "é😀 deadbeefdeadbeef"), (8, "token" + " " * 50000 + "x"),
    ]
    check(frames.with_clashes(frames.docs(spark, *rows), "start", "row", "base", "tokens", "token", "p", "class", "n"), rows)


def test_empty_table(spark):
    assert secret_scan.scan(frames.docs(spark)).collect() == []


def test_random_tokens_are_told_from_words(spark):
    chance = random.Random(8)
    key = lambda letters, n: "".join(chance.choice(letters) for _ in range(n))
    letters = string.ascii_letters + string.digits
    keys = [key(letters, 40) for _ in range(60)] + [key(string.ascii_uppercase + "234567", 32) for _ in range(40)]
    words = ["ThisIsTheLongestNameOfAnyMethod" + str(i) * 2 + "InTheWholeLibraryOfThings" for i in range(1, 60)] + ["Aa1" * 14] * 20 + ["aaaaBBBB1111" * 3] * 20
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + words)]
    found = {r.doc_id: r.spans for r in secret_scan.scan(frames.docs(spark, *rows)).collect()}
    flagged = [i for i in found if "random" in found[i]]
    assert sum(i < len(keys) for i in flagged) >= 0.9 * len(keys)
    assert sum(i >= len(keys) for i in flagged) <= 0.1 * len(words)
    assert found[flagged[0]] == f"random:4:{4 + len(keys[flagged[0]])}"


def test_statistics_of_the_battery(spark):
    """The p-value against direct formulas."""
    token, size = "3f9a01bc77d2e845", 16
    codes = [int(c, 16) for c in token]
    n = len(codes)
    chi = size / n * sum(codes.count(c) for c in codes) - n
    z1 = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = [c >= 8 for c in codes]
    ones = sum(high)
    expected = 2 * ones * (n - ones) / n + 1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    z2 = (runs - expected) / math.sqrt((expected - 1) * (expected - 2) / (n - 1))
    total = sum(codes)
    lag = (sum(a * b for a, b in zip(codes, codes[1:] + codes[:1])) - total**2 / n) / (sum(c * c for c in codes) - total**2 / n)
    z3 = (lag + 1 / (n - 1)) / math.sqrt(n * n / ((n - 1) ** 2 * (n - 2)))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    s = -math.log(tail(z1) * 2 * tail(abs(z2)) * 2 * tail(abs(z3)))
    df = spark.createDataFrame([(token,)], "token string").withColumn("encoding", secret_scan.encoding(F.col("token")))
    row = secret_scan._tested(df).first()
    assert row.encoding == "hex" and row.p == pytest.approx(math.exp(-s) * (1 + s + s * s / 2), rel=1e-4)


def test_values_behind_an_equals_sign(spark):
    chance = random.Random(15)
    letters = string.ascii_letters + string.digits
    keys = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ83vLk0Tu", *("".join(chance.choice(letters) for _ in range(40)) for _ in range(59))]
    forms = ["AWS_ACCESS_ID={}", "see https://host.example/f?a=1&sig={}&b=2", "level=info sig={} done", "padded== {}="]
    rows = [(i, forms[i % len(forms)].format(key)) for i, key in enumerate(keys)]
    found = {r.doc_id: r.spans.split(",") for r in secret_scan.scan(frames.docs(spark, *rows)).collect()}
    whole = [f"random:{text.index(key)}:{text.index(key) + 40}" in found[i] for (i, text), key in zip(rows, keys)]
    assert sum(whole) >= 0.9 * len(keys)


def test_every_token_is_judged(spark):
    """Alphabets without lower case, with signs or without digits are flagged where random and not where they are text."""
    chance = random.Random(23)
    kinds = [
        string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits + "-_", string.ascii_uppercase + string.digits + "-_",
        string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + "-_", string.ascii_letters + "+/",
    ]
    keys = [("".join(chance.choice(k) for _ in range(40)), i) for i, k in enumerate(kinds) for _ in range(30)]
    plain = ["-" * 40, "_" * 200, "A" * 60, "/" * 20, "z" * 200_000, "ABCDEFGH" * 8, "abcdefghij" * 5, "aaaa-bbbb-aaaa-bbbb-aaaa-bbbb"]
    plain += ["the-same-words-again-and-again-" * 3 + str(i) for i in range(20)] + ["SENTENCEENDSEENASENSEDTENNESSEE" * 2] * 10
    rows = [(i, f"see {t} here") for i, t in enumerate([k for k, _ in keys] + plain)]
    found = {r.doc_id: r.spans for r in secret_scan.scan(frames.docs(spark, *rows)).collect()}
    flagged = {i for i, spans in found.items() if "random" in spans}
    for kind in range(len(kinds)):
        own = [i for i, (_, k) in enumerate(keys) if k == kind]
        assert len(flagged.intersection(own)) >= 0.85 * len(own), kind
    assert sum(i >= len(keys) for i in flagged) <= 0.1 * len(plain)
