"""Column expressions that several operators share. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 256
SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is computed once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
    return F.aggregate(values, zero, step, lambda a: a["out"])


def sums_before(values: Column) -> Column:
    """For each element of a non-empty array<bigint>, the sum of those before it. Two levels, so that long arrays are not copied over and over."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK))
    shifted = lambda parts, bases: F.transform(parts, lambda part, i: F.transform(_scan(part), lambda x: x + F.get(bases, i)))
    return let(values, lambda xs: let(cut(xs), lambda parts: let(_scan(F.transform(parts, total)), lambda bases: F.flatten(shifted(parts, bases)))))


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), code points, end exclusive; empty for a null or empty text.

    The built-in functions return the matches and the pieces between them, not their places; running sums of both lengths give those.
    The pattern must not match the empty string.
    """
    none = F.array().cast(SPAN)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))

    def place(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.get(gaps, i) + F.length(h))
        found = lambda h, i, before: (before + F.get(gaps, i)).alias("start")
        return let(
            sums_before(steps),
            lambda before: F.transform(
                hits,
                lambda h, i: F.struct(found(h, i, F.get(before, i)), (F.get(before, i) + F.get(gaps, i) + F.length(h)).alias("end"), h.alias("match")),
            ),
        )

    placed = let(hits, lambda hs: let(gaps, lambda gs: place(hs, gs)))
    return F.when(text.rlike(pattern), placed.cast(SPAN)).otherwise(none)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs with these fields, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
