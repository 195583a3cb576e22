"""Boxes of frames, batch and streamed; batches by doubled pointers; many cues at one time."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from cuespan.operators import aggregates, frames, layout, neighbours
from cuespan.streaming import folds, passes
from tests.conftest import rows

SIZES = [(1, 4, 3), (2, 6, 2), (3, 2, 2)]
BOXES = [
    (1, "all", -2, -1, 20, 20), (1, "row", 1, 1, 2, 1), (1, "cut", 3, 2, 5, 5), (1, "out", 4, 0, 2, 2), (1, "empty", 1, 1, 0, 3),
    (2, "all", 0, 0, 6, 2), (2, "left", -1, 0, 2, 2), (9, "none", 0, 0, 1, 1),
]


def _frames(seed=4, n=60):
    rnd = random.Random(seed)
    data = []
    for track, width, height in SIZES:
        cells = [rnd.uniform(-1, 1) for _ in range(width * height)]
        for i in range(n):
            if rnd.random() < 0.4:
                for at in rnd.sample(range(len(cells)), 2):
                    cells[at] = rnd.uniform(-1, 1)
            data.append((track, i, list(cells)))
    return data


def _tables(spark):
    return (spark.createDataFrame(BOXES, "track bigint, box string, x bigint, y bigint, w bigint, h bigint"),
            spark.createDataFrame(SIZES, "track bigint, width bigint, height bigint"))


def _cut(data):
    """Regions by plain loops."""
    sizes = {t: (w, h) for t, w, h in SIZES}
    out = {}
    for track, name, x, y, w, h in BOXES:
        if track not in sizes:
            continue
        width, height = sizes[track]
        x1, y1, x2, y2 = max(0, min(x, width)), max(0, min(y, height)), max(0, min(x + w, width)), max(0, min(y + h, height))
        if x1 < x2 and y1 < y2:
            for t, frame, cells in data:
                if t == track:
                    out[track, name, frame] = [cells[r * width + c] for r in range(y1, y2) for c in range(x1, x2)]
    return out


def _flags(data, max_distance, min_frames, level=0.25, share=0.5):
    """(track, box, frame) to (distance, changed, passed), by plain loops."""
    regions, out, last, accepted = _cut(data), {}, {}, {}
    for (track, box, frame), region in sorted(regions.items()):
        before = last.get((track, box))
        distance = None if before is None else sum((a > 0) != (b > 0) for a, b in zip(region, before))
        changed = before is None or distance > max_distance
        if changed and (track, box) in accepted and frame - accepted[track, box] < min_frames:
            changed = False
        if changed:
            accepted[track, box] = frame
        out[track, box, frame] = (distance, changed, sum(abs(v) > level for v in region) / len(region) >= share)
        last[track, box] = region
    return out


def test_regions_are_cut_by_box(spark):
    data = _frames()
    boxes, sizes = _tables(spark)
    got = frames.box_regions(spark.createDataFrame(data, "track bigint, frame_no bigint, cells array<double>"), boxes, sizes)
    assert {(r.track, r.box, r.frame_no): r.region for r in got.collect()} == _cut(data)


def test_changes_by_box_equal_a_loop(spark, hot):
    data = _frames()
    boxes, sizes = _tables(spark)
    df = spark.createDataFrame(data, "track bigint, frame_no bigint, cells array<double>")
    got = frames.box_changes(frames.box_regions(df, boxes, sizes), 0, 3, min_share=0.5)
    want = _flags(data, 0, 3)
    assert {(r.track, r.box, r.frame_no): (r.distance, r.changed, r.passed) for r in got.collect()} == want
    totals = {(r.track, r.box): (r.frames, r.processed, r.calls) for r in aggregates.box_totals(df, got).collect()}
    for key in {k[:2] for k in want}:
        own = [v for k, v in want.items() if k[:2] == key]
        assert totals.pop(key) == (60, len(own), sum(c and p for _, c, p in own))
    assert not totals


def test_streamed_boxes_equal_the_batch(spark):
    boxes, sizes = _tables(spark)
    df = spark.createDataFrame(_frames(7), "track bigint, frame_no bigint, cells array<double>")
    timed = df.withColumns({"at_s": F.col("frame_no") / 10.0, "ts": F.timestamp_millis(F.col("frame_no") * 100 + 1000)})
    stream = folds.file_stream(spark, folds.stored_in_parts(timed, "frame_no", 5))
    given = folds.run_to_end(passes.stream_box_changes(stream, boxes, sizes, "cells", 0, 3, min_share=0.5, delay="1 second"))
    assert given.agg(F.max("version")).first()[0] >= 5 and given.filter("settled").count() > 0
    flags = frames.box_changes(frames.box_regions(timed, boxes, sizes).withColumnRenamed("at_s", "ts_s"), 0, 3, min_share=0.5, hot=False)
    want = frames.change_cues(flags, hot=False, keys=frames.BOX)
    columns = ["track", "box", "line", "frame_no", "start_s", "end_s"]
    assert rows(folds.latest(given, frames.BOX), *columns) == rows(want, *columns)


def test_batches_by_doubling_equal_a_loop(spark, hot):
    rnd = random.Random(8)
    data, want = [], []
    for track in range(4):
        at, line, start, batch = 0, 0, None, -1
        for _ in range((0, 1, 40, 300)[track]):
            at += rnd.choice([0, 0, 3, 20, 59, 60, 61, 400])
            line += 1
            data.append((track, line, at))
            if start is None or at - start >= 60:
                start, batch = at, batch + 1
            want.append((track, line, at, batch, start))
    df = spark.createDataFrame(data, "track bigint, line bigint, start_ms bigint")
    assert rows(neighbours.time_batches(df, 60, hot=True)) == sorted(want, key=repr)
    assert neighbours.time_batches(df.filter("false"), 60, hot=True).count() == 0


def _slow_slots(events):
    """The rule as it reads: a cue waits until something starts at or after the cursor."""
    cursor, out = 0, []
    for i, (k, s, e, c) in enumerate(events):
        if k == "end":
            if cursor < s:
                out.append(("gap", cursor, s, s - cursor, None, 0))
            continue
        begin, limit = max(cursor, s), None
        if k == "mute":
            slot = max(begin, e) - begin
        else:
            later = next(w for w in events[i + 1:] if w[1] >= begin or w[0] == "end")
            slot = later[1] - begin
            limit = slot if later[0] == "mute" else None
            if slot <= 0:
                slot = max(begin, e) - begin
        if begin > cursor:
            out.append(("gap", cursor, begin, begin - cursor, None, 0))
        out.append((k, begin, begin + slot, slot, limit, c))
        cursor = begin + slot
    return out


def _folded(events):
    fold, out = layout._TiedSlots(), []
    state = fold.fresh()
    for event in events:
        state, given = fold.step(state, event)
        out += given
    return out


def test_tied_slots_equal_the_rule():
    rnd = random.Random(11)
    for _ in range(200):
        events, at = [], 0
        for _ in range(rnd.randrange(0, 25)):
            at += rnd.choice([0, 0, 1, 5])
            events.append((rnd.choice(["tts", "tts", "mute"]), at, at + rnd.randrange(0, 8), 3))
        events.append(("end", rnd.choice([0, at, at + 9]), 0, 0))
        assert _folded(events) == _slow_slots(events)


def test_many_cues_at_one_time_take_linear_time():
    events = [("tts", 5, 5 + i % 7, 1) for i in range(100_000)] + [("end", 10**9, 0, 0)]
    begun = time.time()
    assert len(_folded(events)) > 100_000
    assert time.time() - begun < 20
