"""Words that repeat a long passage from earlier in the corpus, found on a compacted De Bruijn graph of token k-mers.

A window of ``window`` words is an edge of the graph; consecutive windows of a document are consecutive edges. Edges
are never shipped one by one. Every window contains an *anchor*, the k-mer with the smallest hash in it, so equal windows
have equal anchors; the maximal stretch of consecutive windows around one anchor is a *path* of up to
``window - anchor + 1`` edges and travels as one row with its anchor, the hash of its words and its source coordinates.

1. Among some documents of a task, and then per anchor across all (one shuffle, sorted, streamed in constant memory),
   equal paths meet. A path at a later coordinate than an equal one is repeated whole.
2. An anchor that has one path only does not branch there: nothing else can be equal. Where an anchor has several
   different paths the graph branches; the first copy of each is joined with its text by source coordinates and split
   into its edges, and equal edges meet by anchor and edge hash.
3. Repeated paths and edges are joined to their documents by coordinates; overlapping ones merge into spans.

Equality is decided on the anchor's and the sequence's hash together, 128 bits. A row is known by its id and the 64-bit
hash of its text, so coordinates never reach another text, and rows without an id, or with one id, are no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlens.llm import words as W
from reachlens.session import materialize

_INDEX_BITS, _EDGE_BITS, _LAST = 24, 8, (1 << 63) - 1
#: Paths that a task compares among themselves before it ships them.
_HELD_PATHS = 1 << 20
_REPEATED, _PATH = 0, 1
_RUNS_SQL = "kind byte, anchor long, path long, doc long, place long, text_key long"
_FOUND_SQL = "kind byte, anchor long, doc long, place long, text_key long"
_RUNS = pa.schema([("kind", pa.int8()), *((name, pa.int64()) for name in ("anchor", "path", "doc", "place", "text_key"))])
_FOUND = pa.schema([("kind", pa.int8()), *((name, pa.int64()) for name in ("anchor", "doc", "place", "text_key"))])
_ROW = ["doc", "text_key"]


@dataclass(frozen=True)
class Passages:
    """``window``: words of the shortest passage that counts; ``anchor``: words of the k-mers that paths meet by."""

    window: int = 20
    anchor: int = 6

    def __post_init__(self):
        if not 1 <= self.anchor <= self.window or self.window - self.anchor >= 255:
            raise ValueError("1 <= anchor <= window < anchor + 255 must hold")

    @property
    def most(self) -> int:
        """Edges of the longest path."""
        return self.window - self.anchor + 1


def _place(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Coordinates in a document in one number: first word, edges."""
    return (at.astype(np.int64) << _EDGE_BITS) | edges.astype(np.int64)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> _EDGE_BITS, place & ((1 << _EDGE_BITS) - 1)


def _paths(words: W.Words, sums: np.ndarray, rule: Passages):
    """First word, edges, text, anchor and hash of every path in the words of some texts."""
    n, texts = len(words.starts), words.texts()
    kmers = W.sequence_hashes(sums, np.arange(n - rule.anchor + 1), rule.anchor)
    index = np.arange(len(kmers)).astype(np.uint64)
    # The leftmost smallest of the leading 40 bits; any content-given choice will do.
    least = (kmers >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | (index & np.uint64((1 << _INDEX_BITS) - 1))
    width = 1
    while width < rule.most:
        step = min(width, rule.most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    edges = np.arange(n - rule.window + 1)
    within = texts[edges] == texts[edges + rule.window - 1]
    edges, low = edges[within], (least[within] & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    anchors = edges + ((low - edges) & ((1 << _INDEX_BITS) - 1))
    new = np.ones(len(edges), dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (edges[1:] != edges[:-1] + 1)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(edges)))
    starts = edges[heads]
    hashes = W.sequence_hashes(sums, starts, counts + rule.window - 1)
    return starts, counts, texts[starts], kmers[anchors[heads]].view(np.int64), hashes.view(np.int64)


def _ship_paths(rule: Passages):
    def settled(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """What an earlier document of these has is settled: it only travels along, spread evenly."""
        anchors, hashes, doc, place, key = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, doc, hashes, anchors))
        anchors, hashes, doc, place, key = (x[order] for x in (anchors, hashes, doc, place, key))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (anchors[1:] == anchors[:-1]) & (hashes[1:] == hashes[:-1])
        # The same coordinate once more is a repeated row, not an earlier passage.
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        again &= (doc != doc[first]) | (place >> _EDGE_BITS != place[first] >> _EDGE_BITS)
        spread = W.mix(doc.view(np.uint64) * np.uint64(31) + place.view(np.uint64)).view(np.int64)
        kind = np.where(again, _REPEATED, _PATH).astype(np.int8)
        columns = [kind, np.where(again, spread, anchors), np.where(again, 0, hashes), doc, place, key]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_RUNS)

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs, keys = (batch.column(name).to_numpy(zero_copy_only=False) for name in _ROW)
            for words in W.chunks(batch.column("text"), W.WHITE_SPACE):
                if len(words.starts) < rule.window:
                    continue
                sums = W.sequence_sums(words.hashes())
                starts, counts, texts, anchors, hashes = _paths(words, sums, rule)
                rows = words.rows.start + texts
                parts.append((anchors, hashes, docs[rows], _place(starts - words.first[texts], counts), keys[rows]))
                held += len(anchors)
                if held >= _HELD_PATHS:
                    yield settled(parts)
                    parts, held = [], 0
        if parts:
            yield settled(parts)

    return function


def _meet(whole: bool):
    """Rows sorted by kind, anchor, path, doc, place, key: give out what repeats an earlier row; the state is one row.

    With ``whole``, the first copies of the paths of an anchor that has several are given out as well.
    """

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, given = None, False  # the first copy of the path reached so far; whether it has been given out
        for batch in batches:
            kind, *columns = (batch.column(i).to_numpy() for i in range(len(_RUNS)))
            settled = kind == _REPEATED
            out = [(_REPEATED, *(columns[i][settled] for i in (0, 2, 3, 4)))]
            columns = [c[~settled] for c in columns]
            if len(columns[0]):
                if carried is not None:
                    columns = [np.concatenate([[x], c]) for x, c in zip(carried, columns)]
                anchor, path, doc, place, key = columns
                new_anchor = np.append(True, anchor[1:] != anchor[:-1])
                head = new_anchor | np.append(True, path[1:] != path[:-1])
                first = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                again = ~head & ((doc != doc[first]) | (place >> _EDGE_BITS != place[first] >> _EDGE_BITS))
                out.append((_REPEATED, anchor[again], doc[again], place[again], key[again]))
                of = np.cumsum(new_anchor) - 1
                several = np.bincount(of[head]) > 1
                several[0] |= given
                ask = head & several[of]
                ask[0] &= not given
                if whole:
                    out.append((_PATH, anchor[ask], doc[ask], place[ask], key[ask]))
                last = first[-1]
                given = bool(several[of[last]])
                carried = [c[last] for c in columns]
            if rows := sum(len(x[1]) for x in out):
                kinds = np.concatenate([np.full(len(x[1]), x[0], dtype=np.int8) for x in out])
                merged = [np.concatenate([x[i] for x in out]).astype(np.int64) for i in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in [kinds, *merged]], schema=_FOUND)

    return function


def _split_paths(rule: Passages):
    """Text and the paths asked of it: every edge of those paths with its own hash."""

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(name).to_numpy() for name in _ROW)
            asked = batch.column("asked")
            bounds = asked.offsets.to_numpy()
            values = asked.values
            anchors, places = values.field(0).to_numpy(), values.field(1).to_numpy()
            for words in W.chunks(batch.column("text"), W.WHITE_SPACE):
                sums = W.sequence_sums(words.hashes())
                rows = np.arange(words.rows.start, words.rows.stop)
                sizes = bounds[rows + 1] - bounds[rows]
                low = bounds[words.rows.start]
                anchor, place = anchors[low : low + sizes.sum()], places[low : low + sizes.sum()]
                text = np.repeat(np.arange(len(rows)), sizes)
                at, edges = _unplace(place)
                which = np.repeat(np.arange(len(at)), edges)
                step = np.arange(len(which)) - np.repeat(np.cumsum(edges) - edges, edges)
                starts = words.first[text[which]] + at[which] + step
                hashes = W.sequence_hashes(sums, starts, rule.window).view(np.int64)
                single, row = _place(at[which] + step, np.ones(len(which))), rows[text[which]]
                columns = [np.full(len(which), _PATH, np.int8), anchor[which], hashes, docs[row], single, keys[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_RUNS)

    return function


def _sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions("kind", "anchor", "path", "doc", "place", "text_key")


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents without an id count as later than all others; ``doc`` and ``text_key`` tell rows of different texts apart."""
    own, text = F.col(id_column).cast("long"), F.col(text_column)
    return docs.select(F.coalesce(own, F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"), own.alias("doc_id"))


def repeats(docs: DataFrame, rule: Passages = Passages(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc, text_key, place``: the stretches of windows whose words also start earlier, in coordinates of their documents.

    Earlier is a smaller id, or the same id and an earlier word. Rows that share an id are one document: at the
    same coordinate neither is earlier. A null id comes after all others; null and short texts have no windows.
    """
    texts = _texts(docs, id_column, text_column).drop("doc_id")
    paths = texts.mapInArrow(_ship_paths(rule), _RUNS_SQL)
    met = materialize(_sorted_by(paths, "anchor").mapInArrow(_meet(whole=True), _FOUND_SQL), "substring-paths")
    asked = (
        met.where(F.col("kind") == _PATH)
        .groupBy(*_ROW)
        .agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    )
    edges = texts.join(asked, _ROW).mapInArrow(_split_paths(rule), _RUNS_SQL)
    branched = _sorted_by(edges, "anchor", "path").mapInArrow(_meet(whole=False), _FOUND_SQL)
    return met.where(F.col("kind") == _REPEATED).select(*_ROW, "place").unionByName(branched.select(*_ROW, "place"))


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>, kept string"


def _cut(rule: Passages, with_text: bool):
    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            places = batch.column(2)
            bounds, values = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False)
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()
                at, edges = _unplace(values[bounds[row] : bounds[row + 1]])
                spans = []
                for start, end in sorted(zip(at.tolist(), (at + edges + rule.window - 1).tolist())):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                kept, place = [], 0
                for start, end in spans:
                    kept += words[place:start]
                    place = end
                kept = b" ".join(kept + words[place:] if spans else words)
                removed = sum(end - start for start, end in spans)
                rows.append(
                    (doc_id, len(words), removed, hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans], kept.decode() if with_text else None)
                )
            schema = pa.schema(
                [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                 ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())]
            )
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return function


def remove_repeats(
    docs: DataFrame,
    rule: Passages = Passages(),
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Per document its words, the spans of words that repeat an earlier passage, and what is left without them.

    One row per row of ``docs``; other columns of ``docs`` are not read. A null or empty text has no words.
    """
    found = repeats(docs, rule, id_column, text_column).groupBy(*_ROW).agg(F.collect_set("place").alias("places"))
    with_spans = _texts(docs, id_column, text_column).join(found, _ROW, "left").select(
        "doc_id", "text", F.coalesce("places", F.array().cast("array<long>")).alias("places")
    )
    out = with_spans.mapInArrow(_cut(rule, with_text), _KEPT)
    return out if with_text else out.drop("kept")
