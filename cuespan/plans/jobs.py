"""Whole jobs made of the operators: one plan each, over all tracks at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import text as rules
from cuespan.operators import aggregates, frames, intervals, layout, models, neighbours, segment
from cuespan.session import written


def dub(
    cues: DataFrame, mutes: DataFrame, total: DataFrame, clips: DataFrame, fps: float = 30.0, cap: float = 0.5,
    no_cap: bool = False, hot: bool | None = None, rates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The timeline of a dubbed track, as really cut, and its cues on it.

    Cues are cleared of the mutes, get their clips and slots, slots get speeds and places on
    the new axis, and cues end with their clips. ``rates`` (``track, fps``) gives each track a frame rate of its own.
    """
    if hot is None:
        hot = seq.too_long(cues) or seq.too_long(mutes)
    clear = intervals.clip_drop(cues, mutes, hot=hot)
    blocks = layout.slots(layout.with_clips(clear, clips), mutes, total, hot)
    if rates is not None:
        fps, rates = "fps", rates.select("track", F.col("fps").cast("double").alias("fps"))
        blocks, total = blocks.join(rates, "track"), total.join(rates, "track")
    planned = layout.timeline(layout.with_speeds(blocks, cap, no_cap), total, fps, hot)
    # The timeline is a result, and retiming reads it twice.
    cut = written(layout.rebase(layout.realised(planned, fps), fps, hot))
    return cut, intervals.retime(clear, cut, fps, by_clip=True, hot=hot)


def screen_text(
    images: DataFrame, item: str, model: Callable, interval: int = 1, max_distance: int = 4, min_frames: int = 0,
    fps: float = 30.0, passed: Column | None = None, script: str | None = None, threshold: float = 0.70,
    hot: bool | None = None,
) -> DataFrame:
    """Cues of the text seen on frames: sample, find changes, gate, read, drop junk, merge.

    ``images``: ``track, frame_no, hash`` and the column handed to the model. Only frames
    that open a cue reach the model. ``script`` keeps text of one script alone.
    """
    if hot is None:
        hot = seq.too_long(images)
    sampled = frames.every_nth(images, interval, fps)
    changed = frames.changes(sampled, max_distance, hot)
    if passed is not None:
        changed = changed.withColumn("passed", passed)
    if min_frames > interval:
        changed = frames.debounced(changed, min_frames, hot)
    spans = frames.change_cues(changed, hot=hot)
    opened = spans.join(sampled.select("track", "frame_no", item), ["track", "frame_no"])
    read = models.recognise(opened, item, model)
    kept = rules.without_junk("text")
    if script:
        kept = rules.script_or_null(kept, script)
    cues = read.select(
        "track", "line", F.rint(F.col("start_s") * 1000).cast("bigint").alias("start_ms"),
        F.rint(F.col("end_s") * 1000).cast("bigint").alias("end_ms"), kept.alias("text"),
    ).filter("text <> ''")
    return neighbours.deduplicated(cues, threshold, hot)


def translate(
    cues: DataFrame, model: Callable, batch_size: int = 30, template: str = "{batch_input}", context: str = "",
    attempts: int = 3, parallel: int | None = None, hot: bool | None = None, full_context: str | None = None,
    ledger: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Translated cues, and one row per batch on how it went. A batch whose reply cannot be
    used keeps its texts. ``cues`` may bring their ``time`` line. ``full_context``, a template with ``{text}`` in it,
    gives each track its own whole text as context. With a ``ledger`` (see ``models.call_once``) what has been answered
    before is not sent again."""
    if "time" not in cues.columns:
        cues = cues.withColumn("time", aggregates.clock_range())
    split = neighbours.batched(cues, batch_size, hot=hot)
    contexts = aggregates.own_context(cues, full_context) if full_context else None
    messages = aggregates.batch_messages(split, template, context, contexts)
    # The replies are used twice; they are written so that the model is asked once.
    if ledger:
        replies = written(models.call_once(messages, model, ledger, models.reply_problem, attempts))
    else:
        # A track's context came with each of its batches; nobody reads it again.
        replies = written(models.call_batches(messages, model, models.reply_problem, attempts, parallel).drop("context"))
    merged = models.merge_replies(split, replies)
    # What counts is whether the texts were replaced.
    outcome = merged.groupBy("track", "batch").agg(F.max("status").alias("status"))
    return merged, replies.drop("status").join(outcome, ["track", "batch"])


def speech_to_cues(
    segments: DataFrame, words: DataFrame | None, longest_ms: int, pause_ms: int = 800, least_ms: int = 1000,
    most_chars: int = 80, width: int = 0, spaced: bool = True, hot: bool | None = None,
) -> DataFrame:
    """Cues of recognised speech: long segments cut at words, short ones joined, sentences
    split, lines broken. Without ``words``, segments bring their own (see ``cut_speech``)."""
    if hot is None:
        hot = words is not None and seq.too_long(words)
    cut = segment.cut_speech(segments, words, longest_ms, pause_ms, spaced, hot)
    joined = segment.merge_short(cut, least_ms, spaced, hot)
    split = segment.split_by_marks(joined, most_chars, least_ms, spaced, hot)
    return split.withColumn("text", rules.break_near("text", width)) if width > 0 else split


def words_to_cues(
    transcripts: DataFrame, least: int = 8, most: int = 40, on_comma: bool = False, offset_s: float = 0.24,
    hot: bool | None = None,
) -> DataFrame:
    """Cues of recognised words and the full text they come from."""
    words = segment.punctuated(transcripts)
    # A track's words come from one row, hence in order.
    return segment.token_cues(words, least, most, most or None, on_comma, offset_s, hot, arranged=True)
