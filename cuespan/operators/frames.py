"""Sampling frames, finding changes, and turning changes into cues.

Frames have ``track, frame_no`` and a ``hash`` (a word or an array of words) or an array of features; pixels are not
decoded here. Where operators take ``keys``, these name a sequence of frames: a track, or a track and a box.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespan import sequence as seq
from cuespan.folds import Fold, fold_tracks


def every_nth(frames: DataFrame, interval: int, fps: float = 30.0) -> DataFrame:
    """Every ``interval``-th frame, with its time in seconds. ``frame_no`` is a stored or
    already computed column, so this filter comes before any costly step."""
    rate = float(fps) if fps else 30.0
    return frames.filter(F.col("frame_no") % interval == 0).withColumn("ts_s", F.col("frame_no") / F.lit(rate))


def evenly_spaced(frames: DataFrame, count: int) -> DataFrame:
    """``count`` frames spread evenly from the first to the last of each track; short tracks
    give some frames more than once (``sample_no`` tells them apart)."""
    sizes = frames.groupBy("track").agg(F.count(F.lit(1)).alias("_n"))
    steps = sizes.select("track", "_n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample_no"))
    if count > 1:
        spread = F.floor(F.col("sample_no") * ((F.col("_n") - 1) / F.lit(float(count - 1))))
        at = F.when(F.col("sample_no") == count - 1, F.col("_n") - 1).otherwise(spread)
    else:
        at = F.lit(0)
    wanted = steps.select("track", F.col("sample_no").cast("bigint").alias("sample_no"), at.cast("bigint").alias("frame_no"))
    return wanted.join(frames, ["track", "frame_no"])


def sign_hash(features: str) -> Column:
    """Hash of an array, as 64-bit words: bit i of the words in a row is set where item i is positive."""
    zero = F.lit(0).cast("bigint")

    def word(number):
        bits = F.transform(
            F.slice(features, number * 64 + 1, 64),
            lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero),
        )
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    words = F.greatest(F.lit(1), F.ceil(F.size(features) / 64)).cast("int")
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def hash_distance(frames: DataFrame, a: str, b: str) -> Column:
    """Number of bits in which two hashes differ, be they one word or an array of words."""
    if isinstance(frames.schema[a].dataType, T.ArrayType):
        differ = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(differ, F.lit(0).cast("bigint"), lambda n, d: n + d)
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))).cast("bigint")


def clamped_box(x, y, w, h, width, height) -> Column:
    """Corners of a box cut to the frame, and whether anything is left of it."""

    def within(v, most) -> Column:
        return F.greatest(F.lit(0), F.least(v, most))

    x, y, w, h, width, height = (F.col(c) for c in (x, y, w, h, width, height))
    x1, y1, x2, y2 = within(x, width), within(y, height), within(x + w, width), within(y + h, height)
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), ((x1 < x2) & (y1 < y2)).alias("valid")
    )


def clamped_boxes(boxes: DataFrame, sizes: DataFrame, key: str = "source") -> DataFrame:
    """Boxes ``key, x, y, w, h`` cut to the frame size of their source (``sizes``: ``key, width, height``). Spark
    broadcasts the sizes if they are known to be small, and else shuffles both sides."""
    sized = boxes.join(sizes, key)
    return sized.withColumn("_box", clamped_box("x", "y", "w", "h", "width", "height")).select(*boxes.columns, "_box.*")


def box_regions(frames: DataFrame, boxes: DataFrame, sizes: DataFrame, cells: str = "cells") -> DataFrame:
    """What each frame shows in each box of its track: ``track, box, frame_no, region`` and the other columns of ``frames``.

    ``cells`` is a grid, row by row, of the size that ``sizes`` (``track, width, height``) has for the track. A box
    (``track, box, x, y, w, h``, in cells) is cut to the grid; one that lies outside is left out. Boxes are joined by track, and
    no frame meets a box of another track.
    """
    cut = clamped_boxes(boxes, sizes, "track").filter("valid").join(sizes.select("track", "width"), "track")
    met = frames.join(cut.select("track", "box", "x1", "y1", "x2", "y2", "width"), "track")
    rows = F.transform(
        F.sequence(F.col("y1"), F.col("y2") - 1),
        lambda y: F.slice(cells, (y * F.col("width") + F.col("x1") + 1).cast("int"), (F.col("x2") - F.col("x1")).cast("int")))
    others = [c for c in frames.columns if c not in ("track", "frame_no", cells)]
    return met.select("track", "box", "frame_no", *others, F.flatten(rows).alias("region"))


def active_enough(cells, level: float, min_share: float = 0.03) -> Column:
    """Whether enough cells are active. Empty is not; cells that cannot be judged (NULL) pass."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    active = F.size(F.filter(cells, lambda x: F.abs(x) > F.lit(float(level))))
    return F.when(cells.isNull(), True).otherwise(
        (F.size(cells) > 0) & (active / F.greatest(F.lit(1), F.size(cells)) >= F.lit(float(min_share)))
    )


def changes(frames: DataFrame, max_distance: int = 4, hot: bool | None = None, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Add ``distance`` to the frame before and ``changed``. The first frame is changed; the
    comparison is always with the frame right before."""
    near = seq.extend(frames, ["frame_no"], {"_hash": seq.prev("hash")}, keys=keys, hot=hot)
    return near.withColumn("distance", hash_distance(near, "hash", "_hash")).withColumn(
        "changed", F.col("_hash").isNull() | (F.col("distance") > max_distance)
    ).drop("_hash")


def cell_changes(
    frames: DataFrame, cells: str, noise: float = 25.0, percent: float = 1.5, hot: bool | None = None
) -> DataFrame:
    """``changed`` without hashes: the share of cells that differ by more than ``noise``
    exceeds ``percent``."""
    near = seq.extend(frames, ["frame_no"], {"_cells": seq.prev(cells)}, hot=hot)
    moved = F.size(
        F.filter(F.zip_with(cells, "_cells", lambda a, b: F.abs(a - b) > F.lit(float(noise))), lambda d: d)
    )
    share = moved / F.size(cells) * 100
    return near.withColumn("changed", F.col("_cells").isNull() | (share > percent)).drop("_cells")


class _Debounce(Fold):
    """State: the last accepted change."""

    def __init__(self, min_frames: int):
        self.min_frames = min_frames

    def fresh(self):
        return None

    def step(self, last, row):
        (frame,) = row
        if last is None or frame - last >= self.min_frames:
            return frame, [(frame,)]
        return last, []


def debounced(frames: DataFrame, min_frames: int, hot: bool | None = None, keys: Sequence[str] = ("track",)) -> DataFrame:
    """Take back changes that come sooner than ``min_frames`` after the last accepted one.
    Needed only where frames lie closer together than that."""
    if hot is None:
        hot = seq.too_long(frames, keys)
    accepted = fold_tracks(
        frames.filter("changed"), _Debounce(min_frames), ["frame_no"], ["frame_no"], "frame_no bigint", keys=keys, hot=hot
    ).withColumn("_kept", F.lit(True))
    return (
        frames.join(accepted, [*keys, "frame_no"], "left")
        .withColumn("changed", F.coalesce("_kept", F.lit(False)))
        .drop("_kept")
    )


def change_cues(
    frames: DataFrame, default_s: float = 3.0, hot: bool | None = None, keys: Sequence[str] = ("track",)
) -> DataFrame:
    """Turn changes into cues: each accepted change that passes the gate opens a cue, every
    later frame up to the next one moves its end; a cue of one frame lasts ``default_s``.

    ``frames``: ``track, frame_no, ts_s, changed`` and, if there is a gate, ``passed``.
    """
    opens = F.col("changed") & F.col("passed") if "passed" in frames.columns else F.col("changed")
    runs = seq.extend(
        frames.select(*keys, "frame_no", "ts_s", F.when(opens, 1).otherwise(0).alias("_open")),
        ["frame_no"], {"_cue": seq.total("_open")}, keys=keys, hot=hot,
    ).filter("_cue > 0")
    cues = runs.groupBy(*keys, F.col("_cue").alias("line")).agg(
        F.min("frame_no").alias("frame_no"), F.min("ts_s").alias("start_s"),
        F.max("ts_s").alias("_last"), F.count(F.lit(1)).alias("_n"),
    )
    end = F.when(F.col("_n") > 1, F.col("_last")).otherwise(F.col("start_s") + F.lit(float(default_s)))
    return cues.select(*keys, "line", "frame_no", "start_s", end.alias("end_s"))


BOX = ("track", "box")


def box_changes(
    regions: DataFrame, max_distance: int = 4, min_frames: int = 0, level: float = 0.25, min_share: float = 0.03,
    hot: bool | None = None,
) -> DataFrame:
    """``regions`` of ``box_regions`` with ``distance, changed, passed``, each box of each track for itself.

    A box changes by the hash of its region against that of the frame before; a change sooner than ``min_frames`` after
    the last accepted one is taken back. ``passed``: whether enough of the region is active to be worth reading.
    """
    if hot is None:
        hot = seq.too_long(regions, BOX)
    hashed = regions.withColumns({"hash": sign_hash("region"), "passed": active_enough("region", level, min_share)}).drop("region")
    found = changes(hashed, max_distance, hot=hot, keys=BOX).drop("hash")
    return debounced(found, min_frames, hot=hot, keys=BOX) if min_frames else found
