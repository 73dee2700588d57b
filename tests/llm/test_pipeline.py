"""The pipeline against a brute-force version of all its stages but the language models' code lengths."""

import re
from collections import Counter

import frames
from test_decontaminate import brute as leaks
from test_pii import PATTERNS
from test_secret_scan import brute as spans
from test_simhash import brute_classes, brute_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from reachlens.llm.queries import tokenizer_file
from reachlens.session import materialize


def masked(text):
    """Known formats replaced by their kinds; overlapping spans are one."""
    out, at = "", 0
    for kind, start, end in (s.split(":") for s in spans(text, PATTERNS)[2].split(",") if s):
        start, end = int(start), int(end)
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return out + text[at:]


def brute(docs, items):
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    classes = brute_classes([brute_fingerprint(t) for _, t in docs], [i for i, _ in docs])
    docs = [d for d, c in zip(docs, classes) if d[0] == c]
    dirty = {d for d, *_ in leaks(docs, items)}
    docs = [(i, masked(t)) for i, t in docs if i not in dirty]
    tokenizer = Tokenizer.from_file(str(tokenizer_file()))
    return {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}


def test_run(spark, small, documents):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    expected = brute([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.collect()])
    rows = corpus_pipeline.run(spark, small).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert dict(lengths) == expected
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_stages_keep_the_columns(spark, small, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes, name
        docs = materialize(out, name)
    assert 0 < docs.count() < documents.count()


def test_odd_rows_and_empty_table(spark, small):
    rows = [(1, None), (2, ""), (None, "some words without an id"), (3, "same text here now"), (3, "same text here now"), (5, "x " * 20000), (6, "mail a@b.com +1 (443) 555-5793"), (7, "words to learn a language from")]
    for df in (frames.docs(spark, *rows), frames.docs(spark)):
        docs = frames.with_clashes(df, "fp", "c0", "found", "masked", "length")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, small), name)
        counted = Counter(r.doc_id for r in docs.collect())
        assert set(counted) == ({None, 3, 5, 6, 7} if df.count() else set())
        assert counted[3] <= 1


def test_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names and all(any(re.match(f"op{n}_", x) for x in names) for n in range(1, 14))
    assert not any(re.search(r"\b(limit|tablesample)\b", sql.lower()) for n, sql in contract.oracle_sql().items() if n.startswith("op"))
