"""Queries on slots, timelines, retiming and clip layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.operators import aggregates, intervals, layout
from cuespan.plans.registry import query
from cuespan.plans.views import Views
from cuespan.session import written

FPS = 30.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _cleared(v: Views) -> DataFrame:
    return intervals.clip_drop(v.speech(), v.mutes(), hot=v.hot)


@query
def clip_lookup(v: Views) -> DataFrame:
    v.store()
    found = layout.with_clips(_cleared(v), v.clips())
    return found.select("track", "line", "event_id", "clip_ms", "clip_missing")


@query
def classify_slots(v: Views) -> DataFrame:
    return v.slots()


@query
def slot_speeds(v: Views) -> DataFrame:
    return rounded(layout.with_speeds(v.slots()))


@query
def slot_speeds_uncapped(v: Views) -> DataFrame:
    return rounded(layout.with_speeds(v.slots(), no_cap=True))


@query
def build_timeline(v: Views) -> DataFrame:
    return rounded(v.timeline(FPS).drop("seg_no"))


@query
def timeline_with_head_and_tail(v: Views) -> DataFrame:
    """A timeline of the speech slots alone: the time before and after them is filled in."""
    speech = layout.with_speeds(v.slots()).filter("kind = 'tts'")
    return rounded(layout.timeline(speech, v.totals(), FPS, hot=v.hot))


@query
def rebase_timeline(v: Views) -> DataFrame:
    cut = layout.realised(v.timeline(FPS), FPS)
    return rounded(layout.rebase(cut, FPS, hot=v.hot).drop("seg_no"))


@query
def rebase_on_measured(v: Views) -> DataFrame:
    """Measured lengths come as a table of their own, a tenth shorter; each timeline ends where they do."""
    timeline = written(v.timeline(FPS))
    length = timeline.groupBy("track").agg(F.count("*").alias("_n"))
    measured = layout.realised(timeline, FPS).join(length, "track").filter("10 * seg_no <= 9 * _n").select(
        "track", "seg_no", (F.col("actual_frames") + F.col("seg_no") % 2).alias("actual_frames")
    )
    return rounded(layout.rebase(layout.measured(timeline, measured), FPS, hot=v.hot))


@query
def realised_frames(v: Views) -> DataFrame:
    counts = layout.realised(v.timeline(FPS), FPS)
    return rounded(counts.select("track", "orig_start", "orig_end", "kind", "actual_frames"))


@query
def remap_points(v: Views) -> DataFrame:
    timeline = v.timeline(FPS)
    points = v.cues().select("track", "event_id", F.col("start_ms").alias("at_ms"))
    return rounded(intervals.remap(points, timeline, "event_id", FPS, hot=v.hot))


@query
def retime_cues(v: Views) -> DataFrame:
    timeline = v.timeline(FPS)
    cues = v.speech().select("track", "line", "start_ms", "end_ms", "text")
    return intervals.retime(cues, timeline, FPS, hot=v.hot)


@query
def retime_by_clip(v: Views) -> DataFrame:
    # Anchoring and remapping both read the timeline.
    timeline = written(v.timeline(FPS))
    cues = _cleared(v).select("track", "line", "start_ms", "end_ms", "text")
    return intervals.retime(cues, timeline, FPS, by_clip=True, hot=v.hot)


@query
def drift_audit(v: Views) -> DataFrame:
    return rounded(aggregates.drift_audit(v.timeline(FPS), FPS, hot=v.hot))


def _cues_with_clips(v: Views) -> DataFrame:
    v.store()
    cues = v.cues().select("track", "line", "start_ms", "end_ms", (F.col("line") - 1).alias("clip_no"))
    return cues.join(v.clips(), ["track", "clip_no"], "left").drop("clip_no")


@query
def adjacent_slots(v: Views) -> DataFrame:
    return layout.adjacent_slots(_cues_with_clips(v), v.totals(), hot=v.hot)


@query
def compression_targets(v: Views) -> DataFrame:
    slotted = layout.adjacent_slots(_cues_with_clips(v), v.totals(), hot=v.hot)
    return layout.compression(slotted, 1.5)


@query
def aligned_layout(v: Views) -> DataFrame:
    slotted = layout.adjacent_slots(_cues_with_clips(v), v.totals(), hot=v.hot)
    return layout.aligned(slotted, 1.5, hot=v.hot)


@query
def serial_layout(v: Views) -> DataFrame:
    return layout.serial(_cues_with_clips(v), v.totals(), hot=v.hot)


@query
def paused_schedule(v: Views) -> DataFrame:
    return layout.with_pauses(v.clips(), 250, hot=v.hot)
