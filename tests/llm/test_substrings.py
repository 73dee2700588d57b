import hashlib
import random
import re

import frames
import pytest

from reachlens.llm import substrings

BLANKS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """Words, removed words and the digest of what is kept, by comparing every window; rows are (id, text)."""
    first = {}
    for doc, text in rows:
        words = BLANKS.findall(text or "")
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            place = (doc is None, doc or 0, i)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc, text in rows:
        words = BLANKS.findall(text or "")
        cut = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (doc is None, doc or 0, i):
                cut[i : i + window] = [True] * window
        kept = " ".join(w for w, c in zip(words, cut) if not c)
        out.append((doc, len(words), sum(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, rule):
    return sorted((tuple(r)[:4] for r in substrings.remove_repeats(df, rule).collect()), key=str)


def test_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    result = found(documents, substrings.Passages())
    assert result == brute(rows, 20)
    assert sum(r[2] for r in result) > 0


@pytest.mark.parametrize("window, anchor", [(4, 2), (6, 6), (5, 1)])
def test_few_words(spark, window, anchor):
    """A vocabulary of three words: paths branch, overlap themselves and repeat within a document."""
    chance = random.Random(window)
    rows = [(i, " ".join(chance.choice("abc") for _ in range(chance.randint(0, 30)))) for i in range(60)]
    assert found(frames.docs(spark, *rows), substrings.Passages(window, anchor)) == brute(rows, window)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [
        (5, None), (6, ""), (7, " \t\n "), (None, passage), (3, "x " + passage + " y"), (9, passage), (9, passage),
        (2, "é ü " + passage[:20]), (8, "z " * 3000), (10, "　" + passage),
    ]
    df = frames.with_clashes(frames.docs(spark, *rows), "doc", "place", "path", "anchor", "places", "kept", "text_key")
    assert found(df, substrings.Passages(8, 3)) == brute(rows, 8)


def test_texts_of_one_id(spark):
    """Rows that share an id are one document, each with its own words."""
    one, two = " ".join("abcdefgh"), " ".join("xyabcdefgh")
    rows = [(1, one), (1, two)]
    assert found(frames.docs(spark, *rows), substrings.Passages(5, 2)) == brute(rows, 5)


@pytest.mark.parametrize("doc", [None, 4])
def test_many_texts_of_one_id(spark, doc):
    """Coordinates found in one text are told to rows of that text only, whether the shared id is null or not."""
    chance = random.Random(5)
    texts = [" ".join(chance.choice("abcd") for _ in range(chance.randint(0, 25))) for _ in range(40)]
    rows = [(doc, text) for text in texts + texts[:5]]
    df = frames.docs(spark, *rows)
    assert found(df, substrings.Passages(5, 2)) == brute(rows, 5)
    told = substrings.repeats(df, substrings.Passages(5, 2)).groupBy("doc", "text_key").count().count()
    assert 1 < told <= len(set(texts))


def test_empty_table(spark):
    assert found(frames.docs(spark), substrings.Passages()) == []


def test_kept_text_and_spans(spark):
    passage = "one two three four five"
    df = frames.docs(spark, (1, passage), (2, "a " + passage + " b"))
    rows = {r.doc_id: r for r in substrings.remove_repeats(df, substrings.Passages(4, 2)).collect()}
    assert rows[1].kept == passage and rows[1].spans == []
    assert rows[2].kept == "a b" and [tuple(s) for s in rows[2].spans] == [(1, 6)]


def test_bad_settings():
    with pytest.raises(ValueError):
        substrings.Passages(4, 5)
