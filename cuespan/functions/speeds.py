"""Speed decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespan.functions.stamps import _col


def speeds(clip_ms, slot_ms, hard_limit_ms=None, cap: float = 0.5, no_cap: bool = False) -> Column:
    """How to fit a clip into its slot: struct (video_speed, audio_speed, new_ms).

    The clip fits: nothing changes. Else the picture is slowed, down to ``cap`` of its
    speed; what is still missing is made up by speeding the clip. ``no_cap`` slows the
    picture as far as needed. Division by an empty slot gives NULL, to be reviewed.
    """
    clip, slot = _col(clip_ms).cast("double"), _col(slot_ms).cast("double")
    room = slot if hard_limit_ms is None else F.coalesce(_col(hard_limit_ms).cast("double"), slot)
    one, most = F.lit(1.0), room / F.lit(float(cap))

    def outcome(video, audio, length) -> Column:
        return F.struct(video.alias("video_speed"), audio.alias("audio_speed"), length.alias("new_ms"))

    slowed = outcome(F.try_divide(room, clip), one, clip)
    choice = F.when(clip <= room, outcome(one, one, slot))
    if no_cap:
        return choice.otherwise(slowed)
    return choice.when(clip <= most, slowed).otherwise(
        outcome(F.lit(float(cap)), F.try_divide(clip, most), most)
    )


def compressed_length(clip_ms, slot_ms, max_rate: float) -> Column:
    """Length to squeeze a clip to: NULL when it fits, the slot when the rate allows, else
    the clip at the highest rate (truncated)."""
    clip, slot = _col(clip_ms), _col(slot_ms)
    rate = F.try_divide(clip.cast("double"), slot.cast("double"))
    return F.when(
        clip > slot,
        F.when(rate <= max_rate, slot).otherwise((clip / F.lit(float(max_rate))).cast("bigint")),
    )
