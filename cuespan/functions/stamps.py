"""Time stamps and time arithmetic as column expressions (milliseconds unless named _s)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


#: The characters that ``strip`` removes, for Python values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+\z", "")


def clock_to_seconds(stamp) -> Column:
    """``HH:MM:SS,mmm`` (or ``.mmm``) to seconds; NULL where it is no such stamp."""
    parts = F.split(F.translate(_col(stamp), ",", "."), ":")
    # Casts pass over white space around a number.
    h, m = (F.get(parts, F.lit(i)).try_cast("bigint") for i in (0, 1))
    s = F.get(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) >= 3, (h * 3600 + m * 60) + s)


def clock_to_ms(stamp) -> Column:
    """``HH:MM:SS,mmm`` to milliseconds. The product is truncated, not rounded, so some
    stamps come out one millisecond low, as the format's common readers give them."""
    return (clock_to_seconds(stamp) * 1000).cast("bigint")


def tolerant_seconds(stamp) -> Column:
    """Seconds of a stamp, 0.0 where it cannot be read."""
    return F.coalesce(clock_to_seconds(stamp), F.lit(0.0))


def flexible_seconds(stamp) -> Column:
    """``MM:SS.ff`` or ``HH:MM:SS.ff`` to seconds; NULL for any other number of parts."""
    parts = F.split(F.translate(_col(stamp), ",", "."), ":")

    def whole(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("bigint")

    def real(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("double")

    return F.when(F.size(parts) == 2, whole(0) * 60 + real(1)).when(
        F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2)
    )


def ms_to_clock(ms) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``."""
    ms = _col(ms)
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000),
        F.floor(F.pmod(ms, F.lit(3600000)) / 60000),
        F.floor(F.pmod(ms, F.lit(60000)) / 1000),
        F.pmod(ms, F.lit(1000)),
    )


def seconds_to_clock(seconds) -> Column:
    """Seconds to ``HH:MM:SS,mmm``; negative counts as 0, milliseconds are truncated."""
    s = F.greatest(_col(seconds), F.lit(0.0))
    whole = s.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(whole / 3600),
        F.floor(F.pmod(whole, F.lit(3600)) / 60),
        F.pmod(whole, F.lit(60)),
        ((s - whole) * 1000).cast("bigint"),
    )


def ms_to_centi(ms) -> Column:
    """Milliseconds to ``H:MM:SS.cc``."""
    ms = _col(ms)
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(ms / 3600000),
        F.floor(F.pmod(ms, F.lit(3600000)) / 60000),
        F.floor(F.pmod(ms, F.lit(60000)) / 1000),
        F.floor(F.pmod(ms, F.lit(1000)) / 10),
    )


def centi_to_ms(stamp) -> Column:
    """``H:MM:SS.cc`` to milliseconds; no fraction counts as 0, malformed gives NULL."""
    parts = F.split(_col(stamp), ":")
    tail = F.split(F.get(parts, F.lit(2)), r"\.")
    h, m = (F.get(parts, F.lit(i)).try_cast("bigint") for i in (0, 1))
    s = F.get(tail, F.lit(0)).try_cast("bigint")
    cs = F.when(F.size(tail) > 1, F.get(tail, F.lit(1)).try_cast("bigint")).otherwise(F.lit(0))
    return F.when(F.size(parts) == 3, (h * 3600 + m * 60 + s) * 1000 + cs * 10)


def clock_to_centi(stamp) -> Column:
    """``HH:MM:SS,mmm`` to ``H:MM:SS.cc``; NULL on malformed input."""
    fields = r"^\s*(\d+):([^:]*):([^:.,]*)[.,](\d+)\s*$"
    stamp = _col(stamp)
    part = [F.regexp_extract(stamp, fields, i) for i in range(1, 5)]
    centi = F.floor(part[3].try_cast("bigint") / 10)
    return F.when(
        stamp.rlike(fields),
        F.format_string("%d:%s:%s.%02d", part[0].try_cast("bigint"), part[1], part[2], centi),
    )


def centi_to_clock(stamp) -> Column:
    """``H:MM:SS.cc`` to ``HH:MM:SS,mmm``; NULL on malformed input."""
    fields = r"^\s*(\d+):([^:]*):([^:.]*)\.(\d+)\s*$"
    stamp = _col(stamp)
    part = [F.regexp_extract(stamp, fields, i) for i in range(1, 5)]
    return F.when(
        stamp.rlike(fields),
        F.format_string(
            "%02d:%s:%s,%03d", part[0].try_cast("bigint"), part[1], part[2], part[3].try_cast("bigint") * 10
        ),
    )


def scaled(ms, speed: float) -> Column:
    """Time at another speed: at least 1 ms, halves to even."""
    if speed <= 0:
        raise ValueError("speed must be above 0")
    return F.greatest(F.lit(1), F.rint(_col(ms) / F.lit(float(speed))).cast("bigint"))


def rate(fps) -> Column:
    """A frame rate: a number for all rows, or the name of a column that has each row's."""
    return F.lit(float(fps)) if isinstance(fps, (int, float)) else _col(fps)


def frames(ms, fps) -> Column:
    """Whole frames nearest to a length in milliseconds, halves to even."""
    return F.rint((_col(ms) / 1000.0) * rate(fps))


def frames_to_ms(count, fps) -> Column:
    return (_col(count) / rate(fps)) * 1000.0


def snapped(ms, fps) -> Column:
    """A time moved to the nearest frame."""
    return frames_to_ms(frames(ms, fps), fps)


def planned_frames(ms, video_speed, fps) -> Column:
    """Frames a piece is planned to take at a new speed."""
    return F.rint(frames(ms, fps) * (F.lit(1.0) / _col(video_speed)))


def realised_frames(ms, video_speed, fps) -> Column:
    """Frames a cutter really makes of a piece: rounded up, after 4-digit rounding. Not
    the same as the plan, on purpose."""
    stretched = (frames(ms, fps) / rate(fps)) / _col(video_speed)
    return F.ceil(F.bround(stretched * rate(fps), 4)).cast("double")


def padded_window(start_ms, end_ms, pad_s: float) -> Column:
    """Window in seconds around an interval; the left pad stops at 0."""
    start, end = _col(start_ms) / 1000.0, _col(end_ms) / 1000.0
    left = F.least(F.lit(float(pad_s)), start)
    return F.struct(
        left.alias("left_pad_s"),
        (start - left).alias("from_s"),
        (end + F.lit(float(pad_s))).alias("to_s"),
    )
