"""Places of regular expressions in whole texts as native Columns, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,hit:string,gap:string>>"
#: Matches are laid out in blocks of so many, so that the arrays that a fold copies stay short.
BLOCK = 128


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, regex: str) -> Column:
    """array of (start, end, hit, gap: the text between it and the match before) of the leftmost non-overlapping
    matches (never empty ones), in order.

    The text splits at its matches; the lengths of what lies between and of the matches add up to the places.
    """
    def zipped(hits: Column) -> Column:
        pairs = F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, regex, -1), 1, F.size(hits)).alias("gap"))
        return F.when(F.size(hits) > 0, bound(pairs, _laid)).otherwise(F.array().cast(PLACE))

    return bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), zipped)


def _laid(pairs: Column) -> Column:
    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["gap"].alias("gap")))).alias("out"))

    width = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
    lay = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(PLACE).alias("out")), place, lambda acc: acc["out"])

    def next_start(acc: Column, part: Column) -> Column:
        return F.struct((acc["at"] + width(part)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def blocks(parts: Column) -> Column:
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), next_start, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(parts, starts, lay))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(pairs) <= BLOCK, lay(pairs, F.lit(0))).otherwise(bound(parts, blocks))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def listed(kinds: list[str], spans: Column) -> Column:
    """array of (start, kind: place in kinds, end) as kind:start:end, by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def clear_of(found: Column, *others: Column) -> Column:
    """The elements of found that overlap no span of the others; each of these is in order and without overlaps."""
    held = F.struct(*[o.alias(f"s{i}") for i, o in enumerate(others)])

    def kept(spans: Column) -> Column:
        def clear(x: Column) -> Column:
            meets = [overlaps(x, spans[f"s{i}"]) for i in range(len(others))]
            return ~F.greatest(*meets) if len(meets) > 1 else ~meets[0]

        return F.filter(found, clear)

    return bound(held, kept)


def overlaps(x: Column, spans: Column) -> Column:
    """Whether x meets one of the spans, which are in order and without overlaps: a search by halves for the last one
    that starts before x ends."""
    def half(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        return F.when(F.get(spans, middle)["start"] < x["end"], F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), half, lambda acc: acc["lo"] - 1)
    many = bound(last, lambda i: (i >= 0) & F.coalesce(F.get(spans, i)["end"] > x["start"], F.lit(False)))
    few = F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    return F.when(F.size(spans) <= 8, few).otherwise(many)
