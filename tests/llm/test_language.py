import math
import random
import zlib
from collections import Counter, defaultdict

import frames
import pytest

from reachlens.llm import language
from reachlens.llm.language import Training

FOLD = {b: (ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 0x20) for b in range(256)}


class Brute:
    """PPM with method C escapes on dictionaries, in the plain recursive form."""

    def __init__(self, texts, order, symbols):
        folded = [(lang, [FOLD[b] for b in text.encode()]) for lang, text in texts]
        seen = Counter(b for _, t in folded for b in t)
        ranked = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:symbols]
        self.known = sorted(b for b, _ in ranked if b != 0x20)
        self.size, self.order = len(self.known) + 2, order
        self.follow = defaultdict(Counter)
        for lang, text in folded:
            codes = [0] * order + self.codes(text)
            for i in range(order, len(codes)):
                for depth in range(order + 1):
                    self.follow[lang, tuple(codes[i - depth : i])][codes[i]] += 1
        self.langs = sorted({lang for lang, _ in texts})

    def codes(self, text):
        return [0 if b == 0x20 else self.known.index(b) + 1 if b in self.known else self.size - 1 for b in text]

    def cost(self, lang, context, symbol):
        counts = self.follow[lang, context]
        total, distinct = sum(counts.values()), len(counts)
        if counts[symbol]:
            return -math.log2(counts[symbol] / (total + distinct))
        escape = -math.log2(distinct / (total + distinct)) if total else 0.0
        return escape + (self.cost(lang, context[1:], symbol) if context else math.log2(self.size))

    def bits(self, lang, text):
        codes = [0] * self.order + self.codes([FOLD[b] for b in text.encode()])
        return sum(self.cost(lang, tuple(codes[i - self.order : i]), codes[i]) for i in range(self.order, len(codes)))


@pytest.mark.parametrize("order", [1, 3])
def test_code_lengths(spark, order):
    chance = random.Random(order)
    make = lambda letters: "".join(chance.choice(letters) for _ in range(80))
    kinds = {"aa": "abc éX9", "bb": "bcd ö.", "cc": "xyz 日"}
    rows = [(i, make(kinds[lang]), lang, "s", 1) for i, lang in enumerate(list(kinds) * 12)]
    df = frames.docs(spark, *rows)
    rule = Training(order=order, symbols=6)
    model = language.train(df, rule)
    training = [(lang, text) for i, text, lang, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    brute = Brute(training, order, 6)
    assert model.languages == brute.langs and model.size == brute.size
    for r in language.identify(df, rule).collect():
        text = rows[r.doc_id][1]
        bits = {lang: brute.bits(lang, text) for lang in brute.langs}
        assert r.bits_per_symbol == pytest.approx(min(bits.values()) / len(text.encode()), rel=1e-5)
        assert bits[r.lang_pred] == pytest.approx(min(bits.values()), rel=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.score == pytest.approx(1 / sum(2.0 ** min(0, min(bits.values()) - b) for b in bits.values()), rel=1e-2)


def test_held_out_accuracy(spark, documents):
    found = {r.doc_id: r for r in language.identify(documents).collect()}
    held = [(r.lang, found[r.doc_id]) for r in documents.collect() if r.lang and found[r.doc_id].held_out]
    assert len(held) > 40
    assert sum(lang == f.lang_pred for lang, f in held) >= 0.97 * len(held)
    assert all(0 <= f.score <= 1 for f in found.values())


def test_labels_do_not_leak(spark, documents):
    """Held-out labels change nothing, nor do source and other columns."""
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("qq")).otherwise(F.col("lang")))
    changed = changed.withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(str, language.identify(documents).collect())) == sorted(map(str, language.identify(changed).collect()))


def test_odd_rows(spark):
    rows = [
        (0, "the cat and the dog " * 20, "en", "s", 1), (4, "der hund und die katze " * 20, "de", "s", 1), (3, None, "en", "s", 1), (7, "", "de", "s", 0),
        (5, "123 !?", None, "s", 1), (6, "日本", None, "s", 1), (None, "the dog", None, None, None), (0, "the cat", "en", "s", 1), (9, "die katze " * 50000, None, "s", 1),
    ]
    df = frames.with_clashes(frames.docs(spark, *rows), "score", "lang_pred", "held_out", "c0", "bits_per_symbol")
    found = Counter((r.doc_id, r.lang_pred) for r in language.identify(df).collect())
    assert found[3, "und"] == found[7, "und"] == found[5, "und"] == 1
    assert found[0, "en"] == 2 and found[9, "de"] == 1 and found[None, "en"] == 1
    assert sum(n for (i, lang), n in found.items() if i == 6 and lang in ("de", "en")) == 1
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(spark):
    assert language.identify(frames.docs(spark)).collect() == []
    rows = language.identify(frames.docs(spark, (1, "text", None, None, None))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_every_byte_has_its_own_symbol(spark):
    """Code lengths over all bytes, with more of them than a dense table has room for, some never seen in training."""
    chance = random.Random(5)
    kinds = {"aa": "abcdefghijklmnopqrstuvwxyz áàâãäåæç", "bb": "abcdefghijklmnopqrstuvwxyz абвгдежз", "cc": "zyx ςστυφχψω日本語"}
    rows = [(i, "".join(chance.choice(kinds[lang]) for _ in range(200)), lang, "s", 1) for i, lang in enumerate(list(kinds) * 12)]
    rows += [(100, "ñ͸ \U0001f600 éa ß", None, "s", 1), (101, "a", None, "s", 1)]
    df = frames.docs(spark, *rows)
    brute = Brute([(r[2], r[1]) for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1], 3, 0)
    brute.known = sorted({b for b in FOLD.values() if b != 0x20})
    brute.size = len(brute.known) + 1
    brute.follow.clear()
    for i, text, lang, *_ in rows:
        codes = [0] * 3 + brute.codes([FOLD[b] for b in text.encode()])
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for at in range(3, len(codes)):
                for depth in range(4):
                    brute.follow[lang, tuple(codes[at - depth : at])][codes[at]] += 1
    assert language.train(df).size == brute.size == 155
    texts = {r[0]: r[1] for r in rows}
    for r in language.identify(df).collect():
        bits = {lang: brute.bits(lang, texts[r.doc_id]) for lang in brute.langs}
        assert r.bits_per_symbol == pytest.approx(min(bits.values()) / len(texts[r.doc_id].encode()), rel=1e-5)
        assert bits[r.lang_pred] == pytest.approx(min(bits.values()), rel=1e-5)
