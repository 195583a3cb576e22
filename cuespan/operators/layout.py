"""Slots, new timelines and clip layouts along a track."""

from __future__ import annotations

from bisect import bisect_left
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.folds import Fold, fold_tracks
from cuespan.functions import stamps
from cuespan.functions.speeds import compressed_length, speeds
from cuespan.operators.intervals import clip_drop


def totals(cues: DataFrame) -> DataFrame:
    """Length of each track, taken as its last end."""
    return cues.groupBy("track").agg(F.max("end_ms").alias("total_ms"))


def with_clips(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Length of each cue's clip, found by the cue's 0-based place; 0 where there is none
    (flagged ``clip_missing``). ``clips``: ``track, clip_no, clip_ms``."""
    at = cues.withColumn("clip_no", F.col("line") - 1)
    return (
        at.join(clips.select("track", "clip_no", "clip_ms"), ["track", "clip_no"], "left")
        .withColumn("clip_missing", F.col("clip_ms").isNull())
        .withColumn("clip_ms", F.coalesce("clip_ms", F.lit(0)))
        .select(*cues.columns, "clip_ms", "clip_missing")
    )


SLOT_COLUMNS = "kind string, start_ms bigint, end_ms bigint, slot_ms bigint, hard_limit_ms bigint, clip_ms bigint"


class _TiedSlots(Fold):
    """Slots of tracks where several cues start at once.

    A cue is open until an event starts at or after the cursor; events met meanwhile wait.
    The state is the cursor, the waiting events, in order of their starts, and how many of these are done with. Events
    that wait reach no farther than the overlap does; the one that closes a cue is found by bisection.
    """

    def fresh(self):
        return [0, [], 0]

    def step(self, state, row):
        cursor, waiting, done = state
        waiting.append(list(row))
        out: list[tuple] = []
        while done < len(waiting):
            k, s, e, c = waiting[done]
            if k == "end":
                if cursor < s:
                    out.append(("gap", cursor, s, s - cursor, None, 0))
                done += 1
                continue
            begin = max(cursor, s)
            limit = None
            if k == "mute":
                slot = max(begin, e) - begin
            else:
                # The end of the track, wherever it lies, comes last and closes what is open.
                events = len(waiting) - (waiting[-1][0] == "end")
                later = bisect_left(waiting, begin, done + 1, events, key=itemgetter(1))
                if later == len(waiting):
                    break
                slot = waiting[later][1] - begin
                limit = slot if waiting[later][0] == "mute" else None
                if slot <= 0:
                    slot = max(begin, e) - begin
            if begin > cursor:
                out.append(("gap", cursor, begin, begin - cursor, None, 0))
            out.append((k, begin, begin + slot, slot, limit, c))
            cursor = begin + slot
            done += 1
        if 2 * done > len(waiting):
            del waiting[:done]
            done = 0
        return [cursor, waiting, done], out


def slots(cues: DataFrame, mutes: DataFrame, total: DataFrame, hot: bool | None = None) -> DataFrame:
    """Cut each track into speech, mute and gap slots.

    ``cues`` are clear of the mutes (see ``clip_drop``) and may carry ``clip_ms``. A cue's
    slot runs to the next event, or to the end of the track; when that event is a mute the
    slot is a hard limit. Mutes keep their own length. What is left is gaps. ``total``:
    ``track, total_ms``, one row per track.
    """
    if hot is None:
        hot = seq.too_long(cues) or seq.too_long(mutes)
    clip = F.col("clip_ms") if "clip_ms" in cues.columns else F.lit(0)

    def events(df: DataFrame, kind: str, side: int, clip_ms) -> DataFrame:
        return df.select(
            "track", F.lit(0).alias("_rank"), F.col("start_ms").cast("bigint"), F.lit(side).alias("_side"),
            F.col("line").cast("bigint"), F.lit(kind).alias("kind"), F.col("end_ms").cast("bigint"),
            clip_ms.cast("bigint").alias("clip_ms"),
        )

    # The end of the track is one more event, after all others.
    end = total.select(
        "track", F.lit(1).alias("_rank"), F.col("total_ms").cast("bigint").alias("start_ms"), F.lit(2).alias("_side"),
        F.lit(0).cast("bigint").alias("line"), F.lit("end").alias("kind"),
        F.col("total_ms").cast("bigint").alias("end_ms"), F.lit(0).cast("bigint").alias("clip_ms"),
    )
    axis = events(mutes, "mute", 0, F.lit(0)).union(events(cues, "tts", 1, clip)).union(end)
    order = ["_rank", "start_ms", "_side", "line"]
    swept = seq.extend(
        axis,
        order,
        {
            "_muted_to": seq.peak_before(F.when(F.col("kind") == "mute", F.greatest("start_ms", "end_ms"))),
            "_before": seq.prev("kind"),
            "_next": seq.following("start_ms"),
            "_next_kind": seq.following("kind"),
        },
        hot=hot,
    )
    tie = (F.col("kind") == "tts") & (F.col("_next_kind") == "tts") & (F.col("_next") == F.col("start_ms"))
    flagged = seq.extend(swept, order, {"_tied": seq.whole_max(F.coalesce(tie, F.lit(False)))}, hot=hot)

    reached = F.coalesce(F.col("_muted_to"), F.lit(0))
    begin = F.greatest("start_ms", reached)
    own = F.greatest(begin, F.col("end_ms")) - begin
    to_next = F.col("_next") - begin
    is_cue = F.col("kind") == "tts"
    slot = F.when(is_cue & (to_next > 0), to_next).otherwise(own)
    limit = F.when(is_cue & (F.col("_next_kind") == "mute"), to_next)
    null = F.lit(None).cast("bigint")

    def row(kind, start, end, length, hard, clip_ms):
        return F.struct(
            kind.alias("kind"), start.alias("start_ms"), end.alias("end_ms"), length.alias("slot_ms"),
            hard.alias("hard_limit_ms"), clip_ms.alias("clip_ms"),
        )

    gap = F.when(
        (F.coalesce(F.col("_before"), F.lit("")) != "tts") & (reached < begin),
        row(F.lit("gap"), reached, begin, begin - reached, null, F.lit(0).cast("bigint")),
    )
    block = F.when(F.col("kind") != "end", row(F.col("kind"), begin, begin + slot, slot, limit, F.col("clip_ms")))
    plain = (
        flagged.filter("not _tied")
        .select("track", F.explode(F.filter(F.array(gap, block), lambda b: b.isNotNull())).alias("b"))
        .select("track", "b.*")
    )
    tied = fold_tracks(
        flagged.filter("_tied"), _TiedSlots(), ["kind", "start_ms", "end_ms", "clip_ms"], order, SLOT_COLUMNS, hot=hot
    )
    return plain.unionByName(tied)


def slots_of(cues: DataFrame, mutes: DataFrame, total: DataFrame, clips: DataFrame | None = None,
             hot: bool | None = None) -> DataFrame:
    """``slots`` from raw cues: cleared of the mutes first, clips attached by place."""
    clear = clip_drop(cues, mutes, hot=hot)
    if clips is not None:
        clear = with_clips(clear, clips)
    return slots(clear, mutes, total, hot)


def with_speeds(blocks: DataFrame, cap: float = 0.5, no_cap: bool = False) -> DataFrame:
    """Add ``video_speed, audio_speed, new_ms``; only speech is ever stretched. A block
    whose speed cannot be told is flagged ``needs_review``."""
    fit = speeds("clip_ms", "slot_ms", "hard_limit_ms", cap, no_cap)
    one = F.lit(1.0)
    still = F.struct(
        one.alias("video_speed"), one.alias("audio_speed"), F.col("slot_ms").cast("double").alias("new_ms")
    )
    chosen = blocks.withColumn("_s", F.when(F.col("kind") == "tts", fit).otherwise(still))
    return chosen.select(
        *blocks.columns, "_s.*",
        (F.col("_s.video_speed").isNull() | F.col("_s.audio_speed").isNull()
         | (F.coalesce(F.col("_s.video_speed"), one) <= 0)).alias("needs_review"),
    )


def timeline(blocks: DataFrame, total: DataFrame | None = None, fps: float | str = 30.0, hot: bool | None = None) -> DataFrame:
    """Lay blocks with speeds on a new time axis, on whole frames.

    Starts are running sums of whole frames. Unless the first block is a gap, the time
    before it becomes one; time after the last block becomes a tail. A block of unknown or
    zero speed keeps its length. ``fps`` may name a column of ``blocks`` and ``total`` with each track's frame
    rate; the timeline then has it too.
    """
    own = [fps] if isinstance(fps, str) else []
    if hot is None:
        hot = seq.too_long(blocks)
    vs = F.when(F.col("video_speed") > 0, F.col("video_speed")).otherwise(F.lit(1.0))
    rows = blocks.select(
        "track", F.lit(0).alias("_rank"), "start_ms", (F.col("start_ms") + F.col("slot_ms")).alias("_end"),
        "kind", "slot_ms", "clip_ms", vs.alias("video_speed"), "audio_speed", *own,
    )
    order = ["_rank", "start_ms", "_end", "kind", "clip_ms"]
    if total is not None:
        rows = rows.unionByName(
            total.select(
                "track", F.lit(1).alias("_rank"), F.col("total_ms").cast("bigint").alias("start_ms"),
                F.col("total_ms").cast("bigint").alias("_end"), F.lit("tail").alias("kind"),
                F.lit(0).cast("bigint").alias("slot_ms"), F.lit(0).cast("bigint").alias("clip_ms"),
                F.lit(1.0).alias("video_speed"), F.lit(1.0).alias("audio_speed"), *own,
            )
        )
    near = seq.extend(rows, order, {"_no": seq.position(), "_prev_end": seq.prev("_end")}, hot=hot)
    tail = F.col("kind") == "tail"
    near = near.filter(~tail | (F.col("_prev_end") < F.col("start_ms"))).withColumns(
        {
            "orig_start": F.when(tail, F.col("_prev_end")).otherwise(F.col("start_ms")).cast("double"),
            "orig_end": F.col("_end").cast("double"),
        }
    )
    head = (F.col("_no") == 1) & (F.col("start_ms") > 0) & (F.col("kind") != "gap")
    near = near.withColumns(
        {
            "_frames": F.when(tail, stamps.frames(F.col("orig_end") - F.col("orig_start"), fps)).otherwise(
                stamps.planned_frames("slot_ms", "video_speed", fps)
            ),
            "_head": F.when(head, stamps.frames("start_ms", fps)).otherwise(F.lit(0.0)),
            "_has_head": head,
        }
    )
    laid = seq.extend(near, order, {"_before": seq.total_before(F.col("_frames") + F.col("_head"))}, hot=hot)

    def segment(first_frame, count, orig_start, orig_end, kind, video, audio, clip):
        return F.struct(
            orig_start.alias("orig_start"), orig_end.alias("orig_end"),
            stamps.frames_to_ms(first_frame, fps).alias("new_start"),
            stamps.frames_to_ms(first_frame + count, fps).alias("new_end"),
            video.alias("video_speed"), audio.alias("audio_speed"),
            stamps.frames_to_ms(count, fps).alias("new_chunk_dur"),
            kind.alias("kind"), clip.alias("clip_ms"),
        )

    one = F.lit(1.0)
    first = F.when(
        F.col("_has_head"),
        segment(F.col("_before"), F.col("_head"), F.lit(0.0), F.col("orig_start"), F.lit("gap"), one, one,
                F.lit(0).cast("bigint")),
    )
    body = segment(F.col("_before") + F.col("_head"), F.col("_frames"), F.col("orig_start"), F.col("orig_end"),
                   F.col("kind"), F.col("video_speed"), F.col("audio_speed"), F.col("clip_ms"))
    # Numbers stay in order when the head, if any, takes number 0.
    return laid.select(
        "track", F.posexplode(F.array(first, body)).alias("_i", "s"), "_no", *own
    ).filter("s is not null").select(
        "track", F.when(F.col("_i") == 0, F.lit(0)).otherwise(F.col("_no")).cast("bigint").alias("seg_no"), "s.*", *own
    )


def realised(segments: DataFrame, fps: float | str = 30.0) -> DataFrame:
    """Add ``actual_frames``: how many frames a cutter makes of each segment."""
    length = F.col("orig_end") - F.col("orig_start")
    return segments.withColumn("actual_frames", stamps.realised_frames(length, "video_speed", fps))


def measured(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Add ``actual_frames`` from a table ``track, seg_no, actual_frames``. Segments it does
    not tell of fall away."""
    return segments.join(lengths.select("track", "seg_no", "actual_frames"), ["track", "seg_no"])


def rebase(segments: DataFrame, fps: float | str = 30.0, hot: bool | None = None) -> DataFrame:
    """Lay a timeline anew from the frames its segments really have (``actual_frames``)."""
    names = [c for c in segments.columns if c != "actual_frames"]
    laid = seq.extend(segments, ["seg_no"], {"_before": seq.total_before("actual_frames")}, hot=hot)
    made = {
        "new_start": stamps.frames_to_ms("_before", fps),
        "new_end": stamps.frames_to_ms(F.col("_before") + F.col("actual_frames"), fps),
        "new_chunk_dur": stamps.frames_to_ms("actual_frames", fps),
    }
    return laid.select(*[made[c].alias(c) if c in made else F.col(c) for c in names])


def adjacent_slots(cues: DataFrame, total: DataFrame, hot: bool | None = None) -> DataFrame:
    """Slots that run from each cue to the next, the last to the end of the track. A missing
    clip (NULL ``clip_ms``) counts as long as its slot."""
    axis = cues.withColumn("_rank", F.lit(0)).unionByName(
        total.select("track", F.lit(1).alias("_rank"), F.col("total_ms").alias("start_ms"), F.lit(0).alias("line")),
        allowMissingColumns=True,
    )
    out = seq.extend(axis, ["_rank", "start_ms", "line"], {"_next": seq.following("start_ms")}, hot=hot)
    slot = F.col("_next") - F.col("start_ms")
    return out.filter("_rank = 0").select(
        *[c for c in cues.columns if c not in ("end_ms", "clip_ms")],
        F.col("_next").alias("end_ms"),
        slot.alias("slot_ms"),
        F.coalesce("clip_ms", slot).alias("clip_ms"),
    )


def compression(slotted: DataFrame, max_rate: float = 1.5) -> DataFrame:
    """Clips longer than their slot, with the length to squeeze them to."""
    return slotted.withColumn("target_ms", compressed_length("clip_ms", "slot_ms", max_rate)).filter(
        "clip_ms > slot_ms"
    )


def aligned(slotted: DataFrame, max_rate: float = 1.5, hot: bool | None = None) -> DataFrame:
    """Lay squeezed clips one slot after the other from 0; each is padded or cut to its slot.
    An empty slot takes the clip's own length."""
    target = F.coalesce(compressed_length("clip_ms", "slot_ms", max_rate), F.col("clip_ms"))
    room = F.when(F.col("slot_ms") <= 0, F.greatest(F.lit(1), F.col("clip_ms"))).otherwise(F.col("slot_ms"))
    rows = slotted.withColumns({"_room": room, "_clip": target})
    laid = seq.extend(rows, ["line"], {"_from": seq.total_before("_room")}, hot=hot)
    return laid.select(
        "track", "line",
        F.col("_from").cast("bigint").alias("start_ms"),
        (F.col("_from") + F.col("_room")).cast("bigint").alias("end_ms"),
        F.col("_clip").cast("bigint").alias("laid_ms"),
        F.greatest(F.lit(0), F.col("_room") - F.col("_clip")).cast("bigint").alias("padded_ms"),
        F.greatest(F.lit(0), F.col("_clip") - F.col("_room")).cast("bigint").alias("cut_ms"),
    )


def serial(cues: DataFrame, total: DataFrame, hot: bool | None = None) -> DataFrame:
    """Play clips one after another without retiming: each starts at its cue or when the one
    before is over, and lasts as long as the longer of clip and cue.

    With S the running sum of lengths, the end of clip i is S_i plus the largest wait
    (start_j - S_{j-1}) seen up to i, or plus 0: two running columns instead of a loop.
    """
    if hot is None:
        hot = seq.too_long(cues)
    own = F.col("end_ms") - F.col("start_ms")
    length = F.greatest(F.coalesce("clip_ms", own), own)
    rows = cues.withColumn("_len", length)
    summed = seq.extend(rows, ["line"], {"_sum": seq.total_before("_len")}, hot=hot)
    waits = seq.extend(
        summed, ["line"], {"_wait": seq.peak(F.col("start_ms") - F.col("_sum")), "_last": seq.following("line")}, hot=hot
    )
    end = F.col("_sum") + F.col("_len") + F.greatest(F.lit(0), F.col("_wait"))
    placed = waits.select("track", "line", (end - F.col("_len")).alias("start_ms"), end.alias("end_ms"), "_last")
    tail = F.when(F.col("_last").isNull(), F.greatest(F.lit(0), F.col("total_ms") - F.col("end_ms"))).otherwise(F.lit(0))
    return placed.join(total, "track", "left").select(
        "track", "line", "start_ms", "end_ms", F.coalesce(tail, F.lit(0)).alias("tail_ms")
    )


def with_pauses(clips: DataFrame, pause_ms: int = 0, hot: bool | None = None) -> DataFrame:
    """Start of each clip when clips are joined with a fixed pause between them (none after
    the last). Missing clips are left out beforehand."""
    laid = seq.extend(
        clips.filter("clip_ms is not null"), ["clip_no"],
        {"_from": seq.total_before(F.col("clip_ms") + pause_ms)}, hot=hot,
    )
    return laid.select(
        "track", "clip_no", F.col("_from").cast("bigint").alias("start_ms"),
        (F.col("_from") + F.col("clip_ms")).cast("bigint").alias("end_ms"),
    )
