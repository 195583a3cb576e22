"""Spans of patterns in whole texts, as column expressions, with places in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts by place, then kind.
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,before:string,after:string>"
NONE = f"array<{SPAN}>"
_CONTEXT = 24
_PART = 64


def no_spans() -> Column:
    return F.array().cast(NONE)


def matches(text: Column, pattern: str, kind: int, needs: Column | None = None) -> Column:
    """All matches of ``pattern``, leftmost and without overlap, as an array of spans in order, each with some
    characters before it and one after. No pattern may match nothing; ``needs``, if given, is a cheap test that all
    texts with a match pass.

    What lies between matches comes from ``split`` and the matches from ``regexp_extract_all``, so that the places
    are sums of lengths.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    found = F.regexp_like(text, F.lit(pattern))
    return F.when(found if needs is None else needs & found, _placed(values, gaps, kind)).otherwise(no_spans())


def _placed(values: Column, gaps: Column, kind: int) -> Column:
    """Sums up lengths, ``_PART`` matches at a time, so that long arrays are not copied once for each match."""
    parts = F.transform(
        F.sequence(F.lit(0), F.size(values) - 1, F.lit(_PART)), lambda at: F.struct(
            at.alias("at"), F.slice(values, at + 1, _PART).alias("values"), F.slice(gaps, at + 1, _PART + 1).alias("gaps")))

    def total(strings: Column) -> Column:
        return F.aggregate(strings, F.lit(0).cast("bigint"), lambda n, s: n + F.char_length(s))

    sums = F.transform(parts, lambda p: total(p["values"]) + total(F.slice(p["gaps"], F.lit(1), F.size(p["values"]))))
    begins = F.aggregate(
        sums, F.array(F.lit(0).cast("bigint")), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)))

    def add(state: Column, x: Column) -> Column:
        start = (state["at"] + F.char_length(x["gap"])).cast("bigint")
        end = (start + F.char_length(x["value"])).cast("bigint")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"),
                        F.right(x["gap"], F.lit(_CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")).cast(SPAN)
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def of_part(part: Column, begin: Column) -> Column:
        rows = F.zip_with(
            part["values"], F.zip_with(F.slice(part["gaps"], F.lit(1), F.size(part["values"])),
                                       F.slice(part["gaps"], F.lit(2), F.size(part["values"])),
                                       lambda g, n: F.struct(g.alias("gap"), n.alias("next"))),
            lambda v, g: F.struct(v.alias("value"), g["gap"].alias("gap"), g["next"].alias("next")))
        return F.aggregate(rows, F.struct(begin.alias("at"), no_spans().alias("found")), add)["found"]

    return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), of_part))


def places(spans: str | Column) -> Column:
    """Spans without their texts."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def written_out(spans: str | Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind in the order of ``kinds``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _before(spans: str, end: Column) -> Column:
    """How many of the column ``spans``, which stand in order without overlap, begin before ``end``: by halving."""
    step = lambda r: F.when(
        r["low"] < r["high"], F.when(
            F.get(F.col(spans), F.floor((r["low"] + r["high"]) / 2).cast("int"))["start"] < end,
            F.struct((F.floor((r["low"] + r["high"]) / 2) + 1).cast("int").alias("low"), r["high"].alias("high"))).otherwise(
            F.struct(r["low"].alias("low"), F.floor((r["low"] + r["high"]) / 2).cast("int").alias("high")))).otherwise(r)
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), lambda r, _: step(r))["low"]


def overlaps(span: Column, *others: str) -> Column:
    """Whether ``span`` shares a character with a span of the columns ``others``, each of them in order without overlap.
    The last that begins before the span's end has the farthest end, so time grows with the logarithm of their number."""
    met = F.lit(False)
    for name in others:
        met = met | (F.size(name) > 0) & F.coalesce(
            F.get(F.col(name), _before(name, span["end"]) - 1)["end"] > span["start"], F.lit(False))
    return met
