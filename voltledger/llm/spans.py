"""Spans of regular-expression matches as Columns: whole-stage SQL functions, no Python on the executors.

``re_spans(text, pattern, kind)`` gives array<struct<start, kind_no, end, value>> of the leftmost non-overlapping matches, in code
points, end exclusive. The text between matches (split) and the matches (extract all) have known lengths, so every start is a running
sum, made in chunks: time and memory grow in proportion to the matches. Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


CHUNK = 256


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: higher-order functions are not searched for common parts."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(steps: Column) -> Column:
    """Running sums of an array<int>, by an array that grows: for short arrays."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    return F.aggregate(steps, begin, step, lambda acc: acc["out"])


def running(steps: Column, chunk: int = CHUNK) -> Column:
    """Running sums of an array<int> of any length: sums of chunks, then of the chunks' totals, so that no growing array gets long."""

    def chunked(xs):
        n = F.ceil(F.size(xs) / chunk).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda c: _sums(F.slice(xs, c * chunk + 1, F.lit(chunk))))

    def joined(parts):
        before = F.concat(F.array(F.lit(0)), _sums(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda v: v + b)))

    return let(steps, lambda xs: F.when(F.size(xs) <= chunk, _sums(xs)).otherwise(let(chunked(xs), joined)))


def re_spans(text: Column, pattern: str, kind: int, gate: Column | None = None) -> Column:
    """Matches of a Java pattern. ``gate`` says cheaply whether there can be one."""
    none = F.array().cast(SPAN)

    def spans(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, value: gap + F.length(value)))
        return F.zip_with(found, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))

    matches = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))
    return matches if gate is None else F.when(gate, matches).otherwise(none)


def rendered(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
