"""Spans of pattern matches in texts, as arrays of (start, end, match) in code points, from built-in functions.

``regexp_extract_all`` gives the matches and ``split`` what lies between them, both from left to right without
overlap, so the places follow from the lengths. Quantifiers in patterns are possessive where that changes nothing, and
a match can only begin where the original pattern's could, so a long run without a match costs one pass.

Work grows with the text and with n log n of its n matches: running values come from passes at doubling distances, overlaps from
one sort, and parts of a text from chunks of it, as a place in a string can only be found by counting from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string>"
#: Code points in a chunk; what is cut out around a span is at most so long.
CHUNK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, combine: Callable[[Column, Column], Column], backward: bool = False) -> Column:
    """``combine`` of all values up to each place, or from each place on; for combinations that may take values in any grouping."""

    def double(acc: Column, step: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            other = F.get(acc, i + step if backward else i - step)
            return F.coalesce(combine(x, other), x, other)

        return F.transform(acc, one)

    distances = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(distances, values, double)


def with_matches(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """``df`` with the spans of ``pattern`` in the (non-null) column ``text`` as column ``name``."""
    hits = f"__{name}_hits"
    df = df.withColumn(hits, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    gaps = F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(gaps, F.col(hits), lambda gap, hit: F.length(gap) + F.length(hit))
    ends = bound(steps, lambda s: running(s, lambda x, y: x + y))
    placed = F.zip_with(
        ends, F.col(hits), lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("match"))
    )
    return df.withColumn(name, F.when(F.size(hits) > 0, placed).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(hits)


def named(spans: Column, kind: str, order: int) -> Column:
    """Spans with the place of their kind in the list of kinds, ready to be sorted."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _overlapping(places: Column) -> Column:
    """The numbers of the spans, among sorted (start, number or null for others, end), that overlap any of the others."""
    ends = F.transform(places, lambda p: F.when(p["number"].isNull(), p["end"]))
    starts = F.transform(places, lambda p: F.when(p["number"].isNull(), p["start"]))

    def test(reached: Column, ahead: Column) -> Column:
        before = lambda p, i: F.coalesce(F.get(reached, i) > p["start"], F.lit(False))
        after = lambda p, i: F.coalesce(F.get(ahead, i) < p["end"], F.lit(False))
        told = F.transform(places, lambda p, i: F.when(p["number"].isNotNull() & (before(p, i) | after(p, i)), p["number"]))
        return F.filter(told, lambda n: n.isNotNull())

    return bound(
        bound(ends, lambda e: running(e, F.greatest)),
        lambda reached: bound(bound(starts, lambda s: running(s, F.least, backward=True)), lambda ahead: test(reached, ahead)),
    )


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. No span is empty."""

    def of(own: Column, other: Column) -> Column:
        place = lambda s, number: F.struct(s["start"].alias("start"), number.cast("int").alias("number"), s["end"].alias("end"))
        places = F.array_sort(
            F.concat(F.transform(own, lambda s, i: place(s, i)), F.transform(other, lambda s: place(s, F.lit(None))))
        )
        out = bound(places, _overlapping)
        # Both arrays of numbers are in order of the spans, so a set difference keeps it.
        kept = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), out)
        return F.transform(kept, lambda n: F.get(own, n))

    def chosen(own: Column) -> Column:
        return F.when(F.size(own) == 0, own).otherwise(
            bound(others, lambda other: F.when(F.size(other) == 0, own).otherwise(of(own, other)))
        )

    return bound(spans, chosen)


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in chunks; an end beyond the text is its end."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor(F.greatest(end - 1, start) / CHUNK).cast("int")
    touched = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substr(touched, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""

    def told(pieces: Column, found: Column, reached: Column) -> Column:
        def mark(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reached, i - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(part(pieces, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

        last = F.get(reached, F.size(reached) - 1)
        rest = part(pieces, last, F.size(pieces) * CHUNK)
        return F.array_join(F.concat(F.transform(found, mark), F.array(rest)), "")

    def sorted_spans(found: Column) -> Column:
        ends = bound(F.transform(found, lambda s: s["end"]), lambda e: running(e, F.greatest))
        return bound(chunks(text), lambda pieces: bound(ends, lambda reached: told(pieces, found, reached)))

    return F.when(F.size(spans) > 0, bound(F.array_sort(spans), sorted_spans)).otherwise(text)
