"""Queries on interval joins, neighbours, and figures per track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.operators import aggregates, intervals, neighbours
from cuespan.plans.registry import query
from cuespan.plans.views import Views


@query
def clip_drop_cues(v: Views) -> DataFrame:
    kept = intervals.clip_drop(v.speech(), v.mutes(), hot=v.hot)
    return kept.select("track", "line", "event_id", "start_ms", "end_ms", "text")


@query
def merge_sources(v: Views) -> DataFrame:
    merged = intervals.merge_sources(v.speech(), v.mutes(), hot=v.hot)
    return merged.select("track", "line", "event_id", "start_ms", "end_ms", "text")


@query
def adjacent_overlaps(v: Views) -> DataFrame:
    return intervals.adjacent_overlaps(v.cues(), hot=v.hot)


def _lengths(v: Views) -> DataFrame:
    """Track length told by the speech alone, so that some mutes lie outside."""
    return v.speech().groupBy("track").agg(F.max("end_ms").alias("length_ms"))


@query
def valid_segments(v: Views) -> DataFrame:
    return intervals.valid_segments(v.mutes(), _lengths(v)).select("track", "line", "start_ms", "end_ms")


@query
def segment_totals(v: Views) -> DataFrame:
    return aggregates.segment_totals(intervals.valid_segments(v.mutes(), _lengths(v)))


@query
def mute_series(v: Views) -> DataFrame:
    inside = intervals.valid_segments(v.mutes(), _lengths(v))
    return intervals.mask(v.series(), inside, "event_id", hot=v.hot)


@query
def extract_series(v: Views) -> DataFrame:
    lengths = v.series().groupBy("track").agg(F.max("at_ms").alias("length_ms"))
    kept = intervals.overlay(v.series(), intervals.valid_segments(v.speech(), lengths), "event_id", hot=v.hot)
    return kept.withColumn("value", F.round("value", 6))


@query
def enabled_points(v: Views) -> DataFrame:
    # Points some time before the cues begin, so that some lie in none.
    points = v.series().select("track", "event_id", (F.col("at_ms") - F.col("event_id") % 1000 * 1000).alias("at_ms"))
    return intervals.enabled(points, v.cues(), "event_id", hot=v.hot)


@query
def snap_to_anchor(v: Views) -> DataFrame:
    points = v.series().select("track", "event_id", "at_ms")
    anchors = v.mutes().select("track", F.col("end_ms").alias("at_ms"))
    return intervals.snap_to_anchor(points, anchors, "event_id", hot=v.hot)


@query
def interval_complement(v: Views) -> DataFrame:
    return intervals.complement(v.mutes(), v.totals(), hot=v.hot)


@query
def timeline_complement(v: Views) -> DataFrame:
    """Where ambience may play: what the mutes leave of the new timeline."""
    timeline = v.timeline()
    muted = timeline.filter("kind = 'mute'").select(
        "track", F.col("new_start").alias("start_ms"), F.col("new_end").alias("end_ms")
    )
    total = timeline.groupBy("track").agg(F.max("new_end").alias("total_ms"))
    left = intervals.complement(muted, total, hot=v.hot)
    return left.select("track", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))


def _kinds(v: Views) -> DataFrame:
    return v.cues().select("track", "line", "start_ms", "end_ms", F.col("kind").alias("text"))


@query
def merge_close(v: Views) -> DataFrame:
    return neighbours.merge_close(_kinds(v), max_gap_ms=500, hot=v.hot)


@query
def collapse_repeats(v: Views) -> DataFrame:
    timed = v.lines().withColumns({"start_ms": F.col("line") * 1000, "end_ms": F.col("line") * 1000 + 900})
    return neighbours.collapse_repeats(timed, hot=False)


@query
def collapse_similar(v: Views) -> DataFrame:
    timed = v.lines().withColumns({"start_ms": F.col("line") * 1000, "end_ms": F.col("line") * 1000 + 900})
    return neighbours.collapse_similar(timed, 0.70, hot=False)


@query
def clamp_durations(v: Views) -> DataFrame:
    return neighbours.clamp_durations(_kinds(v), 1000, 7000, hot=v.hot)


@query
def deduplicated_cues(v: Views) -> DataFrame:
    """Repeats merged (exactly), then durations set right."""
    return neighbours.deduplicated(_kinds(v), threshold=1.0, hot=v.hot)


@query
def renumbered_cues(v: Views) -> DataFrame:
    longer = v.cues().filter("end_ms - start_ms >= 1000000").select("track", "line", "event_id", "start_ms")
    return intervals.renumbered(longer, hot=v.hot)


@query
def fixed_batches(v: Views) -> DataFrame:
    return neighbours.batched(v.cues().select("track", "line", "event_id"), 30, hot=v.hot)


@query
def time_batches(v: Views) -> DataFrame:
    return neighbours.time_batches(v.cues(), 86_400_000, hot=v.hot)


@query
def long_time_batches(v: Views) -> DataFrame:
    """The same by doubled pointers, as for tracks that are too long for one task."""
    return neighbours.time_batches(v.cues(), 3_600_000, hot=True)


@query
def time_batch_spans(v: Views) -> DataFrame:
    return neighbours.batch_spans(neighbours.time_batches(v.cues(), 86_400_000, hot=v.hot), hot=v.hot)


@query
def carried_context(v: Views) -> DataFrame:
    stamped = F.concat(F.lit("[00:01.00 --> 00:02.50] "), F.replace("text", F.lit("\n"), F.lit("\n\n[00:03.00 --> 00:04.00]  ")))
    turns = v.turns().select(
        F.col("conv_id").alias("track"), "turn", "role",
        F.when(F.col("role") == "assistant", stamped).otherwise(F.col("text")).alias("text"),
    )
    return neighbours.carried_context(turns, hot=v.hot_turns).select("track", "turn", "role", "context")


@query
def track_statistics(v: Views) -> DataFrame:
    return aggregates.track_statistics(v.cues(), v.cues()).withColumns(
        {"avg_ms": F.round("avg_ms", 4), "avg_chars": F.round("avg_chars", 4)}
    )


@query
def quiet_edges(v: Views) -> DataFrame:
    lengths = v.totals().withColumnRenamed("total_ms", "length_ms")
    return aggregates.quiet_edges(v.series(), lengths, level=60.0, hot=v.hot)
