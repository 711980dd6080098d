"""Positions of regular-expression matches, in DataFrame expressions only.

Every match is bracketed by a control character, the text is split there, and
the lengths of the pieces add up to positions in code points.  Patterns must
not match that character; where a text holds it, another control character
stands in for it, of the same length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
_SPAN = "array<struct<start:int,end:int,kind:int,match:string,before:string,after:string>>"


def clean(text: Column) -> Column:
    return F.translate(text, _MARK, "\u0002")


def matches(text: Column, pattern: str, kind: int, *, guard: Column | None = None,
            keep: Callable[[Column], Column] | None = None, context: int = 24) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as ``start, end, kind, match, before, after``.

    ``keep`` drops matches without a retry; ``guard`` is a cheap test that
    must hold for any text with a match.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("gap"), none.alias("out"))

    def step(held: Column, part: Column) -> Column:
        end = held["at"] + F.char_length(part)
        is_match = held["n"] % 2 == 1
        wanted = is_match if keep is None else is_match & keep(part)
        span = F.struct(
            held["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("match"),
            F.right(held["gap"], F.lit(context)).alias("before"), F.lit("").alias("after"))
        return F.struct(end.alias("at"), (held["n"] + 1).alias("n"), F.when(is_match, "").otherwise(part).alias("gap"),
                        F.when(wanted, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda held: held["out"])
    hit = F.rlike(text, F.lit(pattern)) if guard is None else guard
    return F.when(hit, found).otherwise(none)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(order, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(listed(spans, kinds).cast("binary"), 256)


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with every span replaced; of overlapping spans the earliest, then longest, stays."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(held: Column, s: Column) -> Column:
        piece = F.substring(text, held["at"] + 1, s["start"] - held["at"])
        taken = F.struct((-s["back"]).alias("at"), F.concat(held["out"], F.array(piece, put(s["kind"]))).alias("out"))
        covered = F.struct(F.greatest(held["at"], -s["back"]).alias("at"), held["out"].alias("out"))
        return F.when(s["start"] >= held["at"], taken).otherwise(covered)

    done = F.aggregate(order, first, step)
    rest = F.substring(text, done["at"] + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), rest))
