"""Ordered columns over tracks: previous and next rows, running totals, running peaks.

``extend`` adds such columns in one go. Tracks of ordinary size use plain window
functions: one shuffle on the track, then sorts. A track that is too long for one task
is cut into consecutive pieces by range partitioning on (track, order); each piece is
scanned on its own, and what earlier (or later) pieces contribute comes from a table
with one row per piece, which has at most two rows per partition and is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.session import written

MAX_TRACK_ROWS = 4_000_000
MAX_TRACK_ROWS_SETTING = "spark.cuespan.maxTrackRows"
PIECES_SETTING = "spark.cuespan.pieces"


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def prev(value) -> Scan:
    """Value of the row before (NULL on the first)."""
    return Scan("prev", _col(value))


def following(value) -> Scan:
    """Value of the row after (NULL on the last)."""
    return Scan("following", _col(value))


def position() -> Scan:
    """1, 2, 3 … along the track."""
    return Scan("position", F.lit(1))


def total(value) -> Scan:
    """Running sum up to and including this row."""
    return Scan("total", _col(value))


def total_before(value) -> Scan:
    """Running sum of the rows before this one (0 on the first)."""
    return Scan("total_before", _col(value))


def peak(value) -> Scan:
    """Largest value up to and including this row."""
    return Scan("peak", _col(value))


def peak_before(value) -> Scan:
    """Largest value among the rows before this one."""
    return Scan("peak_before", _col(value))


def last_seen(value) -> Scan:
    """Latest non-null value up to and including this row."""
    return Scan("last_seen", _col(value))


def last_seen_before(value) -> Scan:
    """Latest non-null value among the rows before this one."""
    return Scan("last_seen_before", _col(value))


def next_seen(value) -> Scan:
    """First non-null value from this row on."""
    return Scan("next_seen", _col(value))


def next_seen_after(value) -> Scan:
    """First non-null value among the rows after this one."""
    return Scan("next_seen_after", _col(value))


def whole_min(value) -> Scan:
    return Scan("whole_min", _col(value))


def whole_max(value) -> Scan:
    return Scan("whole_max", _col(value))


def whole_sum(value) -> Scan:
    return Scan("whole_sum", _col(value))


_WHOLE = {"whole_min": F.min, "whole_max": F.max, "whole_sum": F.sum}


def too_long(df: DataFrame, keys: Sequence[str] = ("track",)) -> bool:
    """Whether some track has more rows than one task should hold.

    One pass over the key columns with map-side counting. Ask it of the source table and
    hand the answer on, so that derived tables are not computed just to be counted.
    """
    limit = int(df.sparkSession.conf.get(MAX_TRACK_ROWS_SETTING, str(MAX_TRACK_ROWS)))
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return largest is not None and largest > limit


def extend(
    df: DataFrame,
    order: Sequence[str],
    columns: Mapping[str, Scan],
    keys: Sequence[str] = ("track",),
    hot: bool | None = None,
) -> DataFrame:
    """Add one column per entry of ``columns``, computed along ``order`` within each key.

    ``order`` must be a total order within a key. ``hot`` says whether some key is too
    long for one task; None asks the table itself.
    """
    if hot is None:
        hot = too_long(df, keys)
    if not hot:
        return df.select("*", *_local(columns, keys, order))
    return _in_pieces(df, list(order), columns, list(keys))


def _local(columns: Mapping[str, Scan], keys, order) -> list[Column]:
    forward = Window.partitionBy(*keys).orderBy(*[F.asc(c) for c in order])
    backward = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    start = Window.unboundedPreceding

    def column(scan: Scan) -> Column:
        upto, before = forward.rowsBetween(start, 0), forward.rowsBetween(start, -1)
        since, after = backward.rowsBetween(start, 0), backward.rowsBetween(start, -1)
        v = scan.value
        match scan.kind:
            case "prev":
                return F.lag(v).over(forward)
            case "following":
                return F.lead(v).over(forward)
            case "position":
                return F.row_number().over(forward).cast("bigint")
            case "total":
                return F.sum(v).over(upto)
            case "total_before":
                return F.coalesce(F.sum(v).over(before), F.lit(0))
            case "peak":
                return F.max(v).over(upto)
            case "peak_before":
                return F.max(v).over(before)
            case "last_seen":
                return F.last(v, ignorenulls=True).over(upto)
            case "last_seen_before":
                return F.last(v, ignorenulls=True).over(before)
            case "next_seen":
                return F.last(v, ignorenulls=True).over(since)
            case "next_seen_after":
                return F.last(v, ignorenulls=True).over(after)
            case kind:
                return _WHOLE[kind](v).over(Window.partitionBy(*keys))

    return [column(scan).alias(name) for name, scan in columns.items()]


def pieces(df: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``df`` written in consecutive pieces along (keys, order), numbered by ``_piece``."""
    wanted = df.sparkSession.conf.get(PIECES_SETTING, None)
    by = [*keys, *order]
    ranged = df.repartitionByRange(int(wanted), *by) if wanted else df.repartitionByRange(*by)
    return written(ranged.withColumn("_piece", F.spark_partition_id()))


def _in_pieces(df, order, columns, keys) -> DataFrame:
    names = df.columns
    wrapped = {}
    for i, (name, scan) in enumerate(columns.items()):
        value = F.struct(scan.value.alias("v")) if scan.kind in ("prev", "following") else scan.value
        df = df.withColumn(f"_v{i}", value)
        wrapped[name] = Scan(scan.kind, F.col(f"_v{i}"))
    cut = pieces(df, order, keys)
    where = F.struct(*order)

    def of_piece(scan: Scan) -> Column:
        v, seen = scan.value, F.when(scan.value.isNotNull(), where)
        match scan.kind:
            case "position":
                return F.count(F.lit(1))
            case "total" | "total_before" | "whole_sum":
                return F.sum(v)
            case "peak" | "peak_before" | "whole_max":
                return F.max(v)
            case "whole_min":
                return F.min(v)
            case "prev" | "last_seen" | "last_seen_before":
                return F.max_by(v, seen)
            case _:
                return F.min_by(v, seen)

    summary = cut.groupBy(*keys, "_piece").agg(
        *[of_piece(scan).alias(name) for name, scan in wrapped.items()]
    )
    along = Window.partitionBy(*keys).orderBy("_piece")
    back = Window.partitionBy(*keys).orderBy(F.desc("_piece"))
    every = Window.partitionBy(*keys)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str, scan: Scan) -> Column:
        match scan.kind:
            case "position" | "total" | "total_before":
                return F.sum(name).over(earlier)
            case "peak" | "peak_before":
                return F.max(name).over(earlier)
            case "prev" | "last_seen" | "last_seen_before":
                return F.last(name, ignorenulls=True).over(earlier)
            case "following" | "next_seen" | "next_seen_after":
                return F.last(name, ignorenulls=True).over(later)
            case kind:
                return _WHOLE[kind](name).over(every)

    # Only keys that span pieces need the table: at most two rows per partition.
    carry = (
        summary.withColumn("_spans", F.count(F.lit(1)).over(every))
        .filter("_spans > 1")
        .select(*keys, "_piece", *[carried(n, s).alias(f"_c_{n}") for n, s in wrapped.items()])
    )
    local = cut.select("*", *[c.alias(f"_l_{n}") for n, c in _named(wrapped, [*keys, "_piece"], order)])
    joined = local.join(F.broadcast(carry), [*keys, "_piece"], "left")

    def combined(name: str, scan: Scan) -> Column:
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        match scan.kind:
            case "prev" | "following":
                return F.coalesce(here, there)["v"]
            case "position" | "total_before":
                return here + F.coalesce(there, F.lit(0))
            case "total":
                return F.when(here.isNull(), there).otherwise(here + F.coalesce(there, F.lit(0)))
            case "peak" | "peak_before":
                return F.greatest(here, there)
            case "last_seen" | "last_seen_before" | "next_seen" | "next_seen_after":
                return F.coalesce(here, there)
            case _:
                return F.coalesce(there, here)

    return joined.select(*names, *[combined(n, s).alias(n) for n, s in wrapped.items()])


def _named(columns, keys, order):
    return zip(columns, _local(columns, keys, order))
