"""Benchmark items in documents: size-partitioned MinHash containment search with exact verification.

Items are short, documents long, so their Jaccard similarity says nothing; what counts is the share of an item's shingles
that a document contains. Both sides hash their distinct shingles into bins by the leading bits and keep the smallest
hash of each bin (MinHash with one permutation). Documents are partitioned by size into powers of two, and the number of bins
follows the partition's upper bound, so that about one shingle falls into a bin whatever the document's length. A shingle
that both hold is the smallest of its bin on both sides with a chance of 63 % or more; an item of ``n`` shingles, of which
``t n`` are in the document, stays without a common minimum with a chance below ``0.37 ** (t n)``. Items too small
for that to be negligible are looked up with all their shingles. What has a common minimum is verified: the share
is counted exactly on the shingles' words.

A text of fewer words than a shingle has its whole sequence as its only shingle. So an item that short is found only in
a document that is just these words; longer documents have full shingles only, even if they hold it word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import words as W

_HITS_SQL = "doc_id long, item_id long, n_shingles long, n_contained long, containment double"


@dataclass(frozen=True)
class Containment:
    """``shingle`` words; share ``least``; ``miss``: greatest chance to lose an item at that share; items per block."""

    shingle: int = 5
    least: float = 0.8
    miss: float = 1e-9
    block_items: int = 20_000
    block_chars: int = 32_000_000

    def exact_below(self) -> int:
        """Items with fewer shingles are looked up with all of them."""
        return int(np.ceil(np.log(self.miss) / np.log(np.exp(-1.0)) / self.least)) + 1


def _normal(column):
    """Words are runs of letters, digits and characters beyond ASCII, in lower case."""
    return F.lower(column)


def _shingle_hashes(words: W.Words, sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; a shorter text has its whole sequence as its only shingle."""
    counts = words.counts()
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), number)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    starts = words.first[text] + inside
    return text, W.sequence_hashes(sums, starts, np.minimum(size, counts)[text])


def _bin_bits(shingles: int) -> int:
    """Bits of the bin number for documents with so many distinct shingles: the power of two that is not below."""
    return max(0, int(shingles - 1).bit_length())


def _minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The smallest of the sorted hashes in each of ``2 ** bits`` bins."""
    if not bits:
        return hashes[:1]
    bins = hashes >> np.uint64(64 - bits)
    return hashes[np.append(True, bins[1:] != bins[:-1])]


class Items:
    """A block of items: their shingles, and by partition the hashes to look up with the items they belong to."""

    def __init__(self, rows: list[tuple[int, str]], rule: Containment):
        self.ids, self.hashes, self.shingles = [], [], []
        self.rule = rule
        column = pa.array([text for _, text in rows], type=pa.string())
        for words in W.chunks(column, W.NO_LETTER_OR_DIGIT):
            text, hashes = _shingle_hashes(words, W.sequence_sums(words.hashes()), rule.shingle)
            bounds = np.searchsorted(text, np.arange(len(words.rows) + 1))
            for i, row in enumerate(words.rows):
                if bounds[i] < bounds[i + 1]:
                    self.ids.append(rows[row][0])
                    self.hashes.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
                    self.shingles.append(frozenset(shingles_of(words, i, rule.shingle)))
        self._by_bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        every = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[every >> np.uint64(42)] = True

    def lookup(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their items for documents of the partition."""
        if bits not in self._by_bits:
            small = self.rule.exact_below()
            picked = [h if len(h) < small else _minima(h, bits) for h in self.hashes]
            hashes = np.concatenate(picked) if picked else np.zeros(0, np.uint64)
            items = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
            order = np.argsort(hashes, kind="stable")
            self._by_bits[bits] = hashes[order], items[order]
        return self._by_bits[bits]

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items that may be contained in a text with these sorted distinct shingle hashes."""
        bits = _bin_bits(len(hashes))
        near = hashes[self.sieve[hashes >> np.uint64(42)]]
        if not len(near):
            return []
        known, items = self.lookup(bits)
        low, high = np.searchsorted(known, near, side="left"), np.searchsorted(known, near, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        least = np.zeros(0, np.uint64)
        if any(len(self.hashes[i]) >= self.rule.exact_below() for k in hit for i in items[low[k] : high[k]]):
            least = _minima(hashes, bits)
        found = set()
        for k in hit:
            minimum = len(least) and least[min(np.searchsorted(least, near[k]), len(least) - 1)] == near[k]
            for i in items[low[k] : high[k]].tolist():
                if minimum or len(self.hashes[i]) < self.rule.exact_below():
                    found.add(i)
        return sorted(found)

    def contained(self, item: int, shingles: set) -> int:
        return len(self.shingles[item] & shingles)


def shingles_of(words: W.Words, text: int, size: int) -> Iterator[tuple[bytes, ...]]:
    low, high = int(words.first[text]), int(words.first[text + 1])
    raw = [words.data[s:e].tobytes() for s, e in zip(words.starts[low:high].tolist(), words.ends[low:high].tolist())]
    return (tuple(raw[i : i + size]) for i in range(max(min(len(raw), 1), len(raw) - size + 1)))


def _hits(column: pa.Array, items: Items, rule: Containment) -> Iterator[tuple[int, int, int]]:
    """Row, item and number of its shingles that the row's text contains, where the share is large enough."""
    for words in W.chunks(column, W.NO_LETTER_OR_DIGIT):
        text, hashes = _shingle_hashes(words, W.sequence_sums(words.hashes()), rule.shingle)
        # A text without any shingle of an item needs no signature.
        touched = np.unique(text[items.sieve[hashes >> np.uint64(42)]])
        low, high = np.searchsorted(text, touched, side="left"), np.searchsorted(text, touched, side="right")
        for i, start, end in zip(touched.tolist(), low.tolist(), high.tolist()):
            if found := items.candidates(np.unique(hashes[start:end])):
                own = set(shingles_of(words, i, rule.shingle))
                for item in found:
                    count = items.contained(item, own)
                    if count >= rule.least * len(items.shingles[item]):
                        yield words.rows.start + i, item, count


def blocks(benchmark: DataFrame, rule: Containment, id_column: str = "item_id", text_column: str = "text") -> Iterator[Items]:
    """The items in blocks of bounded number and text, read one after another from the driver's iterator.

    Items without words are passed over. Every block costs one more pass over the documents.
    """
    rows, chars = [], 0
    texts = benchmark.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long"), _normal(F.col(text_column)))
    for item_id, text in texts.toLocalIterator():
        rows.append((item_id, text))
        chars += len(text)
        if len(rows) >= rule.block_items or chars >= rule.block_chars:
            yield Items(rows, rule)
            rows, chars = [], 0
    if rows:
        yield Items(rows, rule)


def _search(shared, rule: Containment):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            rows = list(_hits(batch.column(1), items, rule))
            if rows:
                row, item, count = (list(x) for x in zip(*rows))
                sizes = [len(items.shingles[i]) for i in item]
                columns = [batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], type=pa.int64())]
                columns += [pa.array(sizes, type=pa.int64()), pa.array(count, type=pa.int64())]
                columns.append(pa.array([c / n for c, n in zip(count, sizes)], type=pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "n_shingles", "n_contained", "containment"])

    return function


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: Containment = Containment(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row for every document and item of which it holds ``least`` of the distinct shingles or more.

    Null and empty texts hold nothing; a null document id stays null; repeated rows are reported once each. Only a block
    of items, of bounded size, is broadcast.
    """
    texts = docs.select(F.col(id_column).cast("long"), _normal(F.col(text_column)))
    context = docs.sparkSession.sparkContext
    found = None
    for items in blocks(benchmark, rule):
        part = texts.mapInArrow(_search(context.broadcast(items), rule), _HITS_SQL)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], _HITS_SQL) if found is None else found


def _clean(shared, rule: Containment):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), dtype=bool)
        keep[[row for row, _, _ in _hits(texts, shared.value, rule)]] = False
        return pa.array(keep)

    return clean


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, rule: Containment = Containment(), text_column: str = "text"
) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay as they are, and so do rows with a null text."""
    context = docs.sparkSession.sparkContext
    for items in blocks(benchmark, rule):
        docs = docs.where(_clean(context.broadcast(items), rule)(_normal(F.col(text_column))))
    return docs
