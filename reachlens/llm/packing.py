"""Documents as token sequences of bounded length, packed into as few sequences as possible.

The plan depends on the number of pieces of every length only, at most ``capacity`` numbers, so it is made on the driver
from an aggregate that doesn't grow with the corpus; the pieces themselves are never moved. A piece's gap is filled exactly by
one, two or three lengths whose sum is the gap: sums of single lengths, pairs and triples are keys of a hash index, and a
combination is used as often as the counts of its lengths allow. All gaps are looked up among the singles before the pairs
and among the pairs before the triples. What no exact complement fills is packed best fit. Pairs and triples of short
lengths would use up the pieces that best fit needs at the end, so lengths below a reserve stay out of them; the reserve
with the fewest sequences is used. Pieces of a length are interchangeable, so a piece finds its sequence by its number among those of
its length: its number within its task plus the pieces of the tasks before it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlens.session import materialize

# The pre-token pattern of byte-level vocabularies, as published with them.
LOOK_AHEAD = r"\s+(?!\S)|"
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" + LOOK_AHEAD + r"\s+"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


@dataclass(frozen=True)
class Packing:
    """``capacity`` tokens a sequence; ``end`` id behind every document."""

    tokenizer: str
    capacity: int = 1024
    end: int = 2


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to those of the ``tokenizers`` file.

    Texts of Latin letters are encoded whole by ``tiktoken`` on the vocabulary of that file, which is several times as fast.
    Where no white space follows on white space, the pattern's look-ahead never decides anything and is left out. Texts with
    special tokens or with other characters go to ``tokenizers``.
    """

    _ODD = re.compile("[^ -~\n\u00c0-\u024f]")
    _RUNS = re.compile("[ \n][ \n]")

    def __init__(self, rule: Packing):
        self._tokenizer = Tokenizer.from_file(rule.tokenizer)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        unicode_bytes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in unicode_bytes}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(unicode_bytes))}
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in self._special}
        self._runs = tiktoken.Encoding("runs", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        single = PRE_TOKENS.replace(LOOK_AHEAD, "")
        self._singles = tiktoken.Encoding("singles", pat_str=single, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> list[int]:
        if self._ODD.search(text) or any(token in text for token in self._special):
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return self._runs(text) if self._RUNS.search(text) else self._singles(text)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text; a null text has none."""
        for low in range(0, len(texts), 500):
            for text in texts.slice(low, 500).to_pylist():
                yield np.array(self._ids(text or ""), dtype="<u4").tobytes()


#: One per worker process; it takes a second to make.
_ENCODERS: dict[Packing, Encoder] = {}


def _cut(rule: Packing):
    """Pieces of documents, numbered by length within the task."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rule not in _ENCODERS:
            _ENCODERS[rule] = Encoder(rule)
        encode = _ENCODERS[rule]
        task, seen = TaskContext.get().partitionId(), [0] * (rule.capacity + 1)
        end = np.array([rule.end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                total = len(ids) // 4
                start, piece = 0, 0
                while start < total:
                    length = (total - start) % rule.capacity or rule.capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((doc_id, piece, start, length, crc, task, seen[length]))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return function


class Plan:
    """Groups of equal sequences for given counts of pieces by length.

    Gaps are filled exactly by one length, then by two, then by three, found in an index of their sums, the longest pieces
    first. ``reserve``: lengths below it are no part of a pair or triple, so that enough short pieces stay for the gaps that nothing
    fills exactly. ``even``: of several combinations take the one of most equal lengths first, else the most unequal one. ``depth``: most
    lengths in a combination. ``fewest`` makes the plan with several reserves, in both orders, and takes the one with the
    fewest sequences.
    """

    def __init__(self, counts: dict[int, int], capacity: int, depth: int = 3, reserve: int = 0, even: bool = True):
        self.capacity, self.even, self.groups = capacity, even, []
        self._left = left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            left[length] = count
        for parts in range(1, depth + 1):
            if parts == 2:
                self._parts = [n for n in range(max(1, reserve), capacity) if left[n]]
                self._pairs = self._index_pairs()
                self._triples: dict[int, list[int]] = {}
            for length in range(capacity, 0, -1):
                while left[length] and (lengths := self._exact(length, parts)):
                    self._use(lengths)
        self._best_fit()

    @classmethod
    def fewest(cls, counts: dict[int, int], capacity: int) -> Plan:
        choices = [(reserve, even) for reserve in (0, *(capacity // k for k in (32, 16, 8, 4, 2))) for even in (True, False)]
        return min((cls(counts, capacity, 3, reserve, even) for reserve, even in choices), key=cls.sequences)

    def sequences(self) -> int:
        return sum(times for _, times in self.groups)

    def _use(self, lengths: tuple[int, ...]) -> None:
        wanted = Counter(lengths)
        times = min(int(self._left[n]) // need for n, need in wanted.items())
        for n, need in wanted.items():
            self._left[n] -= times * need
        self.groups.append((lengths, times))

    def _index_pairs(self) -> dict[int, list[int]]:
        """The longer lengths of all pairs by the pair's sum, the one to take first at the end."""
        index: dict[int, list[int]] = {}
        for longer in reversed(self._parts) if self.even else self._parts:
            for shorter in self._parts:
                if shorter > longer or shorter + longer > self.capacity:
                    break
                index.setdefault(shorter + longer, []).append(longer)
        return index

    def _pair(self, total: int, taken: Counter) -> tuple[int, int] | None:
        """An available pair with this sum. Pairs that have run out leave the index, as counts never rise."""
        longer = self._pairs.get(total, [])
        while longer and not self._has(Counter((longer[-1], total - longer[-1]))):
            longer.pop()
        for n in reversed(longer):
            if self._has(taken + Counter((n, total - n))):
                return n, total - n
        return None

    def _triple(self, total: int, taken: Counter) -> tuple[int, int, int] | None:
        """A length and an indexed pair. The lengths that can go with pairs are indexed by the sum when it is first asked for."""
        if total not in self._triples:
            with_pair = [n for n in self._parts if self._pairs.get(total - n)]
            self._triples[total] = [n for n in with_pair if 3 * n >= total][::-1] if self.even else with_pair
        firsts = self._triples[total]
        for n in reversed(firsts):
            if self._has(taken + Counter([n])) and (pair := self._pair(total - n, taken + Counter([n]))):
                return n, *pair
        self._triples[total] = [n for n in firsts if self._left[n] and self._pairs.get(total - n)]
        return None

    def _has(self, wanted: Counter) -> bool:
        return all(self._left[n] >= need for n, need in wanted.items())

    def _exact(self, length: int, parts: int) -> tuple[int, ...] | None:
        """The length with as many others as fill its gap."""
        gap, one = self.capacity - length, Counter([length])
        if not gap:
            return (length,)
        if parts == 1:
            return (length, gap) if self._has(one + Counter([gap])) else None
        found = self._pair(gap, one) if parts == 2 else self._triple(gap, one)
        return (length, *found) if found else None

    def _best_fit(self) -> None:
        """What is left, longest first, each into the fullest sequence that takes it."""
        open_: dict[int, list[list]] = {}
        for length in range(self.capacity, 0, -1):
            while count := int(self._left[length]):
                gap = min((g for g in open_ if g >= length), default=None)
                if gap is None:
                    each = self.capacity // length
                    taken, sequences = ((count // each) * each, count // each) if count >= each else (count, 1)
                    lengths = (length,) * (taken // sequences)
                    open_.setdefault(self.capacity - sum(lengths), []).append([lengths, sequences])
                else:
                    group = open_[gap][-1]
                    taken = min(count, group[1])
                    group[1] -= taken
                    if not group[1]:
                        open_[gap].pop()
                        if not open_[gap]:
                            del open_[gap]
                    open_.setdefault(gap - length, []).append([(*group[0], length), taken])
                self._left[length] -= taken
        self.groups += [(lengths, times) for groups in open_.values() for lengths, times in groups]

    def segments(self) -> np.ndarray:
        """Rows length, first number, sequence of that number, offset; sorted."""
        rows, used, base = [], Counter(), 0
        for lengths, times in self.groups:
            offset = 0
            for length in lengths:
                rows.append((length, used[length], base, offset))
                used[length] += times
                offset += length
            base += times
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _place(segments: np.ndarray):
    key = (segments[:, 0] << 44) | segments[:, 1]

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(key, (length << 44) | number, side="right") - 1
            found = segments[row]
            columns = [pa.array(found[:, 2] + number - found[:, 1]), pa.array(found[:, 3])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return function


def pack(docs: DataFrame, rule: Packing, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per piece: document, number, start, length, checksum of its ids, sequence and place there.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null id stays null. A document longer
    than the capacity is cut into pieces of the capacity with the shorter one first.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = materialize(texts.mapInArrow(_cut(rule), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(by_task.withColumn("before", before), "piece-counts")
    counts = offsets.groupBy("length").agg(F.sum("own")).collect()  # one row for each length at most
    plan = Plan.fewest({length: count for length, count in counts}, rule.capacity)
    numbered = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("number")
    )
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(_place(plan.segments()), schema)
