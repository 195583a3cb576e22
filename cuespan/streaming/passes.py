"""The single-pass loops, over streams: changes of frames, time batches, merging of cues.

``watch`` takes ``delay``, ``idle_ms`` and ``keys`` of ``stream_fold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.folds import Fold
from cuespan.operators.frames import BOX, active_enough, box_regions, sign_hash
from cuespan.streaming.folds import stream_fold


class ChangeRuns(Fold):
    """State: frames seen, last hash, last accepted change, and the open cue (number, first
    frame, start, end, frames)."""

    def __init__(self, max_distance: int, min_frames: int = 0, default_s: float = 3.0):
        self.max_distance, self.min_frames, self.default_s = max_distance, min_frames, default_s

    def fresh(self):
        return [0, None, None, 0, None]

    @staticmethod
    def _distance(a, b):
        return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))

    def _row(self, cue):
        line, frame, start, end, n = cue
        return line, frame, start, end if n > 1 else start + self.default_s

    def step(self, state, row):
        hash_, ts, passed = row
        frame, before, accepted, line, cue = state
        words = [int(w) for w in hash_] if hasattr(hash_, "__len__") else [hash_]
        changed = before is None or self._distance(words, before) > self.max_distance
        if changed and accepted is not None and frame - accepted < self.min_frames:
            changed = False
        out = []
        if changed:
            accepted = frame
        if changed and passed:
            if cue:
                out.append(self._row(cue))
            line += 1
            cue = [line, frame, ts, ts, 1]
        elif cue:
            cue = [*cue[:3], ts, cue[4] + 1]
        return [frame + 1, words, accepted, line, cue], out

    def finish(self, state):
        return [self._row(state[4])] if state[4] else []


def stream_changes(frames: DataFrame, max_distance: int = 4, min_frames: int = 0, default_s: float = 3.0, **watch) -> DataFrame:
    """Cues from frames as they arrive. ``frames``: ``track, ts, at_s, hash, passed``."""
    return stream_fold(
        frames, ChangeRuns(max_distance, min_frames, default_s), ["hash", "at_s", "passed"], ["at_s"],
        "line bigint, frame_no bigint, start_s double, end_s double", **watch,
    )


def stream_box_changes(
    frames: DataFrame, boxes: DataFrame, sizes: DataFrame, cells: str, max_distance: int = 4, min_frames: int = 0,
    default_s: float = 3.0, level: float = 0.25, min_share: float = 0.03, **watch,
) -> DataFrame:
    """Cues of each box from frames as they arrive, ``track, box, …`` as ``stream_changes`` gives them for a track.

    The stream of frames (``track, ts, at_s`` and ``cells``) meets the table of boxes before the state, so that each
    track and box has a state of its own. ``boxes`` and ``sizes`` are as in ``operators.frames.box_regions``.
    """
    met = box_regions(frames.withColumn("frame_no", F.lit(0)), boxes, sizes, cells)
    judged = met.select("track", "box", "ts", "at_s", sign_hash("region").alias("hash"), active_enough("region", level, min_share).alias("passed"))
    return stream_changes(judged, max_distance, min_frames, default_s, keys=BOX, **watch)


class BatchSpans(Fold):
    """State: the open batch (number, start, last row, rows, text of its last row) and the
    context that the batch before left."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def fresh(self):
        return None

    def step(self, state, row):
        at, text = row
        if state is None:
            return [0, at, at, 1, text, ""], []
        no, start, _, rows, said, context = state
        if at - start >= self.span_ms:
            return [no + 1, at, at, 1, text, said], [(no, start, at, rows, context)]
        return [no, start, at, rows + 1, text, context], []

    def finish(self, state):
        if state is None:
            return []
        no, start, last, rows, _, context = state
        return [(no, start, last, rows, context)]


def stream_batches(cues: DataFrame, span_ms: int = 60_000, **watch) -> DataFrame:
    """Time batches as cues arrive, each with the last text of the batch before."""
    return stream_fold(
        cues, BatchSpans(span_ms), ["start_ms", "text"], ["start_ms", "line"],
        "batch bigint, start_ms bigint, end_ms bigint, rows bigint, context string", **watch,
    )


class MergeRuns(Fold):
    """State: the open run (number, start, end, text)."""

    def __init__(self, max_gap_ms: int):
        self.max_gap_ms = max_gap_ms

    def fresh(self):
        return None

    def step(self, run, row):
        start, end, text = row
        if run is None:
            return [1, start, end, text], []
        if text == run[3] and start - run[2] <= self.max_gap_ms:
            return [run[0], run[1], end, run[3]], []
        return [run[0] + 1, start, end, text], [tuple(run)]

    def finish(self, run):
        return [tuple(run)] if run else []


def stream_merges(cues: DataFrame, max_gap_ms: int = 500, **watch) -> DataFrame:
    """Equal neighbours merged as cues arrive."""
    return stream_fold(
        cues, MergeRuns(max_gap_ms), ["start_ms", "end_ms", "text"], ["start_ms", "line"],
        "line bigint, start_ms bigint, end_ms bigint, text string", **watch,
    )
