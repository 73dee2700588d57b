"""Language identification by prediction by partial matching: the language whose model gives the text the shortest code.

Each language has a tree of byte contexts of up to ``order`` bytes with the counts of the byte that followed. The
cost of a byte is that of the longest known context that has seen it, after an escape for every longer one; the escape
probability is that of method C (distinct followers against all followers), and below the empty context bytes are
equally likely. Statistics are frozen after training, so the code length is a sum over the windows of ``order + 1`` bytes, and
each window has a fixed cost in every language. The trees are sparse: sorted arrays have the costs of the windows that
some language has seen and the escapes of their contexts, of every length; any other window escapes to a shorter one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_PREDICTED = "lang_pred string, score double, bits_per_symbol double"
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Training:
    """``order``: longest context; ``documents``: expected size of the sample drawn per language; ``symbols``: None
    gives every byte its own symbol, a number only that many of the most frequent ones, and the others share one."""

    order: int = 3
    documents: int = 4000
    symbols: int | None = None


def learnable(docs: DataFrame, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Labelled texts outside the held-out third."""
    known = F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & ~held_out(F.col(id_column))
    return docs.where(F.coalesce(known, F.lit(False)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


def _folded() -> np.ndarray:
    """Lower-case ASCII; digits, punctuation, control bytes and blanks are one separator."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        table[b] = ord(chr(b).lower()) if chr(b).isalpha() else 0x20
    return table


_FOLD = _folded()


def _bytes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, folded bytes and text bounds, some text at a time. A separator stands before and after every text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, side="right")) - 1)
        yield row, _FOLD[data[offsets[row] : offsets[end]]], offsets[row : end + 1] - offsets[row]
        row = end


def _windows(codes: np.ndarray, bounds: np.ndarray, order: int, size: int) -> np.ndarray:
    """The number of the window that ends at each position; before a text stand separators (symbol 0)."""
    window = codes.astype(np.int64)
    shifted = codes
    for back in range(1, order + 1):
        shifted = np.concatenate([[0], shifted[:-1]]).astype(codes.dtype)
        # What lies before the text's start is a separator.
        for lead in range(back):
            at = bounds[:-1] + lead
            shifted[at[at < bounds[1:]]] = 0
        window += shifted.astype(np.int64) * size**back
    return window


class Model:
    """Costs in bits of every window, per language."""

    def __init__(self, languages: list[str], alphabet: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], order: int):
        """``counts``: per language the windows seen and how often; ``alphabet`` maps bytes to symbols 0..size-1."""
        self.languages, self.alphabet, self.order = languages, alphabet, order
        self.size = size = int(alphabet.max()) + 1
        windows = np.unique(np.concatenate([w for w, _ in counts])) if counts else np.zeros(0, np.int64)
        seen = np.zeros((len(windows), len(languages)))
        for i, (own, times) in enumerate(counts):
            seen[np.searchsorted(windows, own), i] = times
        levels = [(windows, seen)]
        for depth in range(order, 0, -1):
            # Sum away the first symbol.
            shorter, place = np.unique(levels[-1][0] % size**depth, return_inverse=True)
            sums = np.zeros((len(shorter), len(languages)))
            np.add.at(sums, place, levels[-1][1])
            levels.append((shorter, sums))
        #: Of every depth the windows, their costs, the contexts and their escapes. All of them are sorted.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for windows, seen in levels[::-1] if len(levels[0][0]) else []:
            contexts, first, place = np.unique(windows // size, return_index=True, return_inverse=True)
            total = np.add.reduceat(seen, first, axis=0)
            distinct = np.add.reduceat(seen > 0, first, axis=0, dtype=np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                known = -np.log2(seen / (total + distinct)[place])
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            costs = np.where(seen > 0, known, escape[place] + self.costs(windows)).astype(np.float32)
            self.levels.append((windows, costs, contexts, escape.astype(np.float32)))

    def costs(self, windows: np.ndarray) -> np.ndarray:
        """Bits of each window in every language, by the levels there are."""
        out = np.zeros((len(windows), len(self.languages)), dtype=np.float32)
        rest = np.arange(len(windows))
        for depth in range(len(self.levels) - 1, -1, -1):
            known, costs, contexts, escapes = self.levels[depth]
            own = windows[rest] % self.size ** (depth + 1)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[place] == own
            out[rest[hit]] += costs[place[hit]]
            rest, own = rest[~hit], own[~hit] // self.size
            place = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            met = contexts[place] == own
            out[rest[met]] += escapes[place[met]]
        out[rest] += np.float32(np.log2(self.size))
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior share, and bits per symbol, of every text."""
        names, scores, bits = [], np.zeros(len(column)), np.full(len(column), np.nan)
        for row, folded, bounds in _bytes(column):
            windows = _windows(self.alphabet[folded], bounds, self.order, self.size)
            lengths = np.diff(bounds)
            sums = np.zeros((len(lengths), len(self.languages)))
            filled = np.flatnonzero(lengths)
            if len(filled):
                costs = self.costs(windows)
                sums[filled] = np.add.reduceat(costs, bounds[filled], axis=0, dtype=np.float64)
            letters = np.zeros(len(lengths), dtype=bool)
            plain = np.append(0, np.cumsum((folded >= 0x61) & (folded <= 0x7A)))
            letters = plain[bounds[1:]] > plain[bounds[:-1]]
            for i in np.flatnonzero(~letters & (lengths > 0)).tolist():
                letters[i] = any(c.isalpha() for c in column[row + i].as_py() or "")
            best = sums.argmin(axis=1) if self.languages else np.zeros(len(lengths), np.int64)
            for i, ok in enumerate(letters.tolist()):
                if ok and self.languages:
                    own = sums[i]
                    names.append(self.languages[best[i]])
                    scores[row + i] = 1.0 / np.exp2(np.clip(own[best[i]] - own, -1000, 0)).sum()
                    bits[row + i] = own[best[i]] / lengths[i]
                else:
                    names.append(UNDETERMINED)
        return names, scores, bits


def _count(order: int, languages: list[str], alphabet: np.ndarray):
    """Windows of the sample counted within a task, with the language's number in front."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = int(alphabet.max()) + 1
        number = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            keys = []
            for row, folded, bounds in _bytes(batch.column(1)):
                windows = _windows(alphabet[folded], bounds, order, size)
                keys.append(windows + np.repeat(langs[row : row + len(bounds) - 1], np.diff(bounds)) * size ** (order + 1))
            key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count.astype(np.int64))], names=["key", "n"])

    return function


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for _, folded, _ in _bytes(batch.column(1)):
            counts += np.bincount(folded, minlength=256)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["key", "n"])


def train(
    docs: DataFrame,
    rule: Training = Training(),
    id_column: str = "doc_id",
    lang_column: str = "lang",
    text_column: str = "text",
) -> Model:
    """A model from labelled texts. Of every language about ``documents`` texts, chosen by a hash of their id, are counted,
    whole; the model is what comes to the driver, a count per language and window that the sample really has."""
    known = learnable(docs, id_column, lang_column, text_column)
    sizes = {row[0]: row[1] for row in known.groupBy(lang_column).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(256, np.int64), [], 0)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, rule.documents / sizes[name]))])
    drawn = F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(1 << 20)) < share[F.col(lang_column)] * (1 << 20)
    sample = known.where(drawn).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    if rule.symbols is None:
        own = np.setdiff1d(_FOLD, [0x20])
        others = 0
    else:
        by_byte = sample.mapInArrow(_count_bytes, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
        own = sorted((row["key"] for row in sorted(by_byte, key=lambda r: (-r["n"], r["key"]))[: rule.symbols] if row["key"] != 0x20))
        others = 1
    # Symbol 0 is the separator; if symbols are capped, the last one is every other byte.
    alphabet = np.full(256, len(own) + others, dtype=np.int64)
    alphabet[0x20] = 0
    alphabet[own] = np.arange(1, len(own) + 1)
    size = len(own) + 1 + others
    counted = sample.mapInArrow(_count(rule.order, languages, alphabet), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    arrow = counted.toArrow()
    language, window = np.divmod(arrow["key"].to_numpy(), size ** (rule.order + 1))
    times = arrow["n"].to_numpy()
    counts = [(window[language == i], times[language == i]) for i in range(len(languages))]
    return Model(languages, alphabet, counts, rule.order)


def _predict(shared):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, bits = shared.value.predict(batch.column(batch.num_columns - 1))
            columns = [pa.array(names, type=pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_symbol"]
            )

    return function


def identify(
    docs: DataFrame, rule: Training = Training(), id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_symbol`` of every row; only the text is used for a prediction.

    A null text or one without any letter is ``und`` with score 0, and so is every text if nothing can be learned. A null
    id is neither held out nor learned from. Equal code lengths go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rule, id_column, lang_column, text_column))
    own = F.col(id_column)
    texts = docs.select(own.cast("long").alias("doc_id"), F.coalesce(held_out(own), F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    return texts.mapInArrow(_predict(model), "doc_id long, held_out boolean, " + _PREDICTED)


def keep_identified(
    docs: DataFrame, rule: Training = Training(), id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text"
) -> DataFrame:
    """The rows whose language can be told; all columns stay as they are.

    Null texts and texts without a letter go. Without a single labelled text no language can be told, so no row stays.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rule, id_column, lang_column, text_column))

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([name != UNDETERMINED for name in model.value.predict(texts)[0]], type=pa.bool_())

    return docs.where(told(F.col(text_column)))
