"""Joins of intervals and points on a track.

None of them pairs rows up. The two sides are laid on one time axis per track and swept
once: what a row needs to know of the other side is a running peak, a running count, or
the nearest row before or after. The work stays linear, however many intervals overlap.

Cues and zones have ``track, line, start_ms, end_ms``; points have ``track, at_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import stamps
from cuespan.functions.text import soft_wrap


def renumbered(cues: DataFrame, order=("start_ms", "line"), hot: bool | None = None) -> DataFrame:
    """Set ``line`` to 1, 2, 3 … along ``order``."""
    names = cues.columns
    return seq.extend(cues, order, {"_line": seq.position()}, hot=hot).select(
        *[F.col("_line").alias("line") if c == "line" else F.col(c) for c in names]
    )


def clip_drop(cues: DataFrame, zones: DataFrame, min_ms: int = 100, hot: bool | None = None) -> DataFrame:
    """Keep cues out of blocked zones.

    A cue that starts inside a zone is dropped; one that runs into a zone ends where the
    zone starts; what is then shorter than ``min_ms`` is dropped too (untouched cues as
    well). Lines are numbered anew, in the order they had.
    """
    if hot is None:
        hot = seq.too_long(cues) or seq.too_long(zones)
    names = cues.columns
    axis = cues.withColumn("_side", F.lit(1)).unionByName(
        zones.select(
            "track", "start_ms", "line",
            F.lit(0).alias("_side"),
            F.col("start_ms").alias("_zone_start"),
            F.col("end_ms").alias("_zone_end"),
        ),
        allowMissingColumns=True,
    )
    swept = seq.extend(
        axis,
        ["start_ms", "_side", "line"],
        {"_blocked_to": seq.peak("_zone_end"), "_next_zone": seq.next_seen("_zone_start")},
        hot=hot,
    )
    clear = F.col("_blocked_to").isNull() | (F.col("_blocked_to") <= F.col("start_ms"))
    kept = (
        swept.filter((F.col("_side") == 1) & clear)
        .withColumn("end_ms", F.least("end_ms", "_next_zone"))
        .filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .select(*names)
    )
    return renumbered(kept, ("line", "start_ms"), hot=hot)


def valid_segments(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments that lie inside their track. ``lengths``: ``track, length_ms``."""
    return (
        segments.join(lengths, "track")
        .filter((F.col("start_ms") >= 0) & (F.col("end_ms") <= F.col("length_ms")))
        .drop("length_ms")
    )


def _points_and_starts(points: DataFrame, zones: DataFrame, tie: str) -> DataFrame:
    return points.withColumn("_side", F.lit(1)).unionByName(
        zones.select(
            "track",
            F.col("start_ms").alias("at_ms"),
            F.col("line").cast(points.schema[tie].dataType).alias(tie),
            F.lit(0).alias("_side"),
            F.col("end_ms").alias("_zone_end"),
        ),
        allowMissingColumns=True,
    )


def _reach(points: DataFrame, zones: DataFrame, tie: str, hot: bool | None) -> DataFrame:
    """Points with ``_reach``: the farthest end of the zones started so far."""
    if hot is None:
        hot = seq.too_long(points) or seq.too_long(zones)
    axis = _points_and_starts(points, zones, tie)
    swept = seq.extend(axis, ["at_ms", "_side", tie], {"_reach": seq.peak("_zone_end")}, hot=hot)
    return swept.filter("_side = 1").select(*points.columns, "_reach")


def mask(points: DataFrame, zones: DataFrame, tie: str, value: str = "value", hot: bool | None = None) -> DataFrame:
    """Silence the points that lie in some zone (start inside, end outside)."""
    inside = F.coalesce(F.col("_reach") > F.col("at_ms"), F.lit(False))
    return (
        _reach(points, zones, tie, hot)
        .withColumn(value, F.when(inside, F.lit(0.0)).otherwise(F.col(value)))
        .drop("_reach")
    )


def enabled(points: DataFrame, cues: DataFrame, tie: str, hot: bool | None = None) -> DataFrame:
    """Flag ``enabled``: the point lies in some cue, both ends included."""
    inside = F.coalesce(F.col("_reach") >= F.col("at_ms"), F.lit(False))
    return _reach(points, cues, tie, hot).withColumn("enabled", inside).drop("_reach")


def overlay(points: DataFrame, zones: DataFrame, tie: str, value: str = "value", hot: bool | None = None) -> DataFrame:
    """Keep only what lies in zones; where zones overlap the value is added once for each."""
    if hot is None:
        hot = seq.too_long(points) or seq.too_long(zones)
    kind = points.schema[tie].dataType

    def edges(at: str, side: int, change: int) -> DataFrame:
        return zones.select(
            "track", F.col(at).alias("at_ms"), F.col("line").cast(kind).alias(tie),
            F.lit(side).alias("_side"), F.lit(change).alias("_change"),
        )

    axis = (
        points.withColumn("_side", F.lit(2))
        .unionByName(edges("end_ms", 0, -1), allowMissingColumns=True)
        .unionByName(edges("start_ms", 1, 1), allowMissingColumns=True)
    )
    swept = seq.extend(axis, ["at_ms", "_side", tie], {"_open": seq.total("_change")}, hot=hot)
    depth = F.coalesce(F.col("_open"), F.lit(0))
    return (
        swept.filter("_side = 2")
        .withColumn(value, F.col(value) * depth)
        .select(*points.columns)
    )


def snap_to_anchor(points: DataFrame, anchors: DataFrame, tie: str, hot: bool | None = None) -> DataFrame:
    """Add ``snapped_ms``: the nearest anchor of the track, the earlier one at equal
    distance, the point itself where there is none. ``anchors``: ``track, at_ms``."""
    if hot is None:
        hot = seq.too_long(points) or seq.too_long(anchors)
    axis = points.withColumn("_side", F.lit(1)).unionByName(
        # Equal anchors count once; that also gives the axis a total order.
        anchors.select("track", "at_ms").distinct()
        .withColumns({"_side": F.lit(0), "_anchor": F.col("at_ms"), tie: F.lit(0).cast(points.schema[tie].dataType)}),
        allowMissingColumns=True,
    )
    swept = seq.extend(
        axis,
        ["at_ms", "_side", tie],
        {"_before": seq.last_seen("_anchor"), "_after": seq.next_seen("_anchor")},
        hot=hot,
    )
    at, a, b = F.col("at_ms"), F.col("_before"), F.col("_after")
    nearest = F.when(a.isNull(), F.coalesce(b, at)).when(b.isNull() | (at - a <= b - at), a).otherwise(b)
    return swept.filter("_side = 1").withColumn("snapped_ms", nearest).select(*points.columns, "snapped_ms")


def merge_sources(*sources: DataFrame, hot: bool | None = None) -> DataFrame:
    """One list of cues from several, by start; at equal starts earlier sources first, in
    their own line order. Lines are numbered anew."""
    if hot is None:
        hot = any(seq.too_long(s) for s in sources)
    merged = None
    for i, source in enumerate(sources):
        source = source.withColumn("_source", F.lit(i))
        merged = source if merged is None else merged.unionByName(source)
    return renumbered(merged, ("start_ms", "_source", "line"), hot=hot).drop("_source")


def adjacent_overlaps(cues: DataFrame, hot: bool | None = None) -> DataFrame:
    """Neighbours by start where the first runs past the start of the second; 0-based
    positions of both."""
    out = seq.extend(
        cues,
        ["start_ms", "line"],
        {
            "_no": seq.position(),
            "next_start_ms": seq.following("start_ms"),
            "next_end_ms": seq.following("end_ms"),
        },
        hot=hot,
    )
    return out.filter("end_ms > next_start_ms").select(
        "track",
        (F.col("_no") - 1).alias("first_idx"),
        F.col("_no").alias("second_idx"),
        "start_ms", "end_ms", "next_start_ms", "next_end_ms",
    )


def complement(zones: DataFrame, totals: DataFrame, hot: bool | None = None) -> DataFrame:
    """What zones leave of ``0 … total_ms``. After each zone the sweep goes on from that
    zone's own end, even where an earlier zone reached farther. ``totals``: ``track,
    total_ms``, one row for every track."""
    axis = zones.select("track", "start_ms", "end_ms", F.lit(0).alias("_rank")).unionByName(
        totals.select("track", F.col("total_ms").alias("start_ms"), F.col("total_ms").alias("end_ms"), F.lit(1).alias("_rank"))
    )
    swept = seq.extend(axis, ["_rank", "start_ms", "end_ms"], {"_from": seq.prev("end_ms")}, hot=hot)
    begin = F.coalesce(F.col("_from"), F.lit(0))
    return swept.filter(begin < F.col("start_ms")).select(
        "track", begin.alias("start_ms"), F.col("start_ms").alias("end_ms")
    )


def _remapped(at: Column, s: Column, first: Column, last: Column, fps) -> Column:
    span = s["orig_end"] - s["orig_start"]
    inside = s["new_start"] + ((at - s["orig_start"]) / span) * s["new_ms"]
    return (
        F.when(first.isNull(), at)
        .when(
            s.isNotNull() & (s["orig_start"] <= at),
            F.when(span <= 0, s["new_start"]).otherwise(stamps.snapped(inside, fps)),
        )
        .when(at > last["orig_end"], stamps.snapped(last["new_end"] + (at - last["orig_end"]), fps))
        .otherwise(stamps.snapped(first["new_start"] - (first["orig_start"] - at), fps))
    )


def remap(points: DataFrame, timeline: DataFrame, tie: str, fps: float | str = 30.0, hot: bool | None = None) -> DataFrame:
    """Add ``new_ms``: where each point lies on the new timeline.

    The first segment that holds the point (both ends included) interpolates it, a segment
    of no length gives its new start; after the last segment the point is shifted along
    with its end; before the first, or in a hole, along with the first start. Results lie
    on frames. A track without timeline is left as it is. Segments come in start order,
    numbered by ``seg_no``. ``fps`` may name a column of the timeline with the track's frame rate.
    """
    if hot is None:
        hot = seq.too_long(points) or seq.too_long(timeline)
    # Of the segments in start order, the first to end at or after a point is one that
    # reaches farther than all before it; if that one starts too late, none holds it.
    reach = seq.extend(timeline, ["seg_no"], {"_before": seq.peak_before("orig_end")}, hot=hot)
    record = F.col("_before").isNull() | (F.col("orig_end") > F.col("_before"))
    body = F.struct("orig_start", "orig_end", "new_start", "new_end", F.col("new_chunk_dur").alias("new_ms"))
    segments = reach.select(
        "track",
        F.col("orig_end").cast("double").alias("_at"),
        F.lit(1).alias("_side"),
        F.col("seg_no").cast(points.schema[tie].dataType).alias(tie),
        F.when(record, body).alias("_seg"),
        F.struct("seg_no", "orig_start", "orig_end", "new_start", "new_end", stamps.rate(fps).alias("rate")).alias("_ends"),
    )
    axis = points.withColumns({"_at": F.col("at_ms").cast("double"), "_side": F.lit(0)}).unionByName(
        segments, allowMissingColumns=True
    )
    swept = seq.extend(
        axis,
        ["_at", "_side", tie],
        {"_hit": seq.next_seen("_seg"), "_first": seq.whole_min("_ends"), "_last": seq.whole_max("_ends")},
        hot=hot,
    ).filter("_side = 0")
    new = _remapped(F.col("_at"), F.col("_hit"), F.col("_first"), F.col("_last"), F.col("_first.rate"))
    return swept.withColumn("new_ms", new).select(*points.columns, "new_ms")


def anchored(cues: DataFrame, timeline: DataFrame, within_ms: int = 100, hot: bool | None = None) -> DataFrame:
    """Add ``anchor``: the first speech segment that starts less than ``within_ms`` from the
    cue's start, as a struct (clip_ms, new_end); NULL where there is none."""
    if hot is None:
        hot = seq.too_long(cues) or seq.too_long(timeline)
    axis = cues.withColumns({"_at": (F.col("start_ms") - within_ms).cast("double"), "_side": F.lit(1)}).unionByName(
        timeline.filter("kind = 'tts'").select(
            "track",
            F.col("orig_start").cast("double").alias("_at"),
            F.lit(0).alias("_side"),
            F.col("seg_no").cast(cues.schema["line"].dataType).alias("line"),
            F.struct("orig_start", "clip_ms", "new_end").alias("_seg"),
        ),
        allowMissingColumns=True,
    )
    swept = seq.extend(axis, ["_at", "_side", "line"], {"_near": seq.next_seen("_seg")}, hot=hot).filter("_side = 1")
    near = F.col("_near")
    hit = F.when(
        near["orig_start"] - F.col("start_ms") < within_ms,
        F.struct(near["clip_ms"].alias("clip_ms"), near["new_end"].alias("new_end")),
    )
    return swept.withColumn("anchor", hit).select(*cues.columns, "anchor")


def retime(
    cues: DataFrame, timeline: DataFrame, fps: float | str = 30.0, by_clip: bool = False, width: int = 0,
    hot: bool | None = None,
) -> DataFrame:
    """Move cues to the new timeline. ``by_clip`` ends a cue with its clip, where it has one
    of some length, though not after its slot. A cue lasts 100 ms if nothing else. Texts are
    wrapped softly where ``width`` is given."""
    if hot is None:
        hot = seq.too_long(cues) or seq.too_long(timeline)
    names = cues.columns
    source = anchored(cues, timeline, hot=hot) if by_clip else cues
    # Line numbers may repeat within a track, so cues are told apart by their place.
    source = seq.extend(source, ["start_ms", "line", "end_ms"], {"_pos": seq.position()}, hot=hot)
    carried = [c for c in source.columns if c not in ("track", "_pos", "start_ms", "end_ms")]
    # Both ends of a cue go through one sweep; the payload travels with the start only.
    ends = source.select(
        "track", "_pos",
        F.explode(
            F.array(
                F.struct(
                    F.col("start_ms").alias("at_ms"), F.lit(0).alias("which"),
                    F.struct(*carried, F.lit(1).alias("_one")).alias("load"),
                ),
                F.struct(F.col("end_ms").alias("at_ms"), F.lit(1).alias("which"), F.lit(None).alias("load")),
            )
        ).alias("p"),
    ).select("track", "_pos", "p.*")
    moved = remap(ends, timeline, "_pos", fps, hot)
    start, end = (F.max(F.when(F.col("which") == i, F.col("new_ms"))) for i in (0, 1))
    both = moved.groupBy("track", "_pos").agg(
        start.alias("_start"), end.alias("_end"), F.first("load", ignorenulls=True).alias("_load")
    )
    both = both.select("track", "_start", "_end", *[F.col(f"_load.{c}").alias(c) for c in carried])
    end = F.col("_end")
    if by_clip:
        clip = F.col("anchor.clip_ms")
        end = F.when(clip > 0, F.least(F.col("_start") + clip, F.col("anchor.new_end"))).otherwise(end)
    end = F.when(end <= F.col("_start"), F.col("_start") + 100).otherwise(end)
    made = {"start_ms": F.rint("_start").cast("bigint"), "end_ms": F.rint(end).cast("bigint")}
    if width > 0:
        made["text"] = soft_wrap("text", width)
    return both.select(*[made[c].alias(c) if c in made else F.col(c) for c in names])
