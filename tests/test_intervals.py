import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import intervals
from tests.conftest import rows

CUES = "track int, line bigint, start_ms bigint, end_ms bigint, text string"


def _cues(spark, items, track=1):
    return spark.createDataFrame([(track, i + 1, s, e, t) for i, (s, e, t) in enumerate(items)], CUES)


def _random(rnd, n, span, longest):
    starts = sorted(rnd.sample(range(span), n))
    return [(s, s + rnd.randrange(1, longest), f"t{i}") for i, s in enumerate(starts)]


def test_cues_are_clipped_and_dropped(spark, hot):
    cues = _cues(spark, [(0, 5000, "A"), (6000, 10000, "B"), (11000, 15000, "C")])
    zones = _cues(spark, [(4000, 7000, "m")])
    got = rows(intervals.clip_drop(cues, zones), "line", "start_ms", "end_ms", "text")
    assert got == [(1, 0, 4000, "A"), (2, 11000, 15000, "C")]


def test_clip_drop_against_the_loop(spark, hot):
    rnd = random.Random(5)
    cues, zones = _random(rnd, 60, 9000, 900), _random(rnd, 12, 9000, 700)
    want = []
    for s, e, t in cues:
        for zs, ze, _ in zones:
            if e <= zs or s >= ze:
                continue
            e = None if s >= zs else zs
            break
        if e is not None and e - s >= 100:
            want.append((len(want) + 1, s, e, t))
    got = rows(intervals.clip_drop(_cues(spark, cues), _cues(spark, zones)), "line", "start_ms", "end_ms", "text")
    assert got == sorted(want, key=repr)


def test_neighbours_that_overlap(spark, hot):
    cues = _cues(spark, [(0, 1500, "A"), (1000, 2500, "B"), (2000, 3500, "C")])
    assert rows(intervals.adjacent_overlaps(cues), "first_idx", "second_idx") == [(0, 1), (1, 2)]


def test_touching_neighbours_do_not_overlap(spark):
    cues = _cues(spark, [(0, 1000, "A"), (1000, 2000, "B")])
    assert rows(intervals.adjacent_overlaps(cues, hot=False)) == []


def test_merged_sources_keep_their_order_at_equal_starts(spark, hot):
    a = _cues(spark, [(0, 10, "a1"), (50, 60, "a2")])
    b = _cues(spark, [(0, 10, "b1"), (20, 30, "b2")])
    got = rows(intervals.merge_sources(a, b), "line", "text")
    assert got == [(1, "a1"), (2, "b1"), (3, "b2"), (4, "a2")]


def _points(spark, at):
    return spark.createDataFrame([(1, i, t, 1.0) for i, t in enumerate(at)], "track int, id bigint, at_ms bigint, value double")


def test_masks_overlays_and_flags_against_the_loop(spark, hot):
    rnd = random.Random(8)
    zones = _random(rnd, 15, 2000, 300)
    at = rnd.sample(range(2400), 120) + [z[0] for z in zones[:3]] + [z[1] for z in zones[:3]]
    z, p = _cues(spark, zones), _points(spark, at)
    masked = rows(intervals.mask(p, z, "id"), "id", "value")
    assert masked == sorted(((i, 0.0 if any(s <= t < e for s, e, _ in zones) else 1.0) for i, t in enumerate(at)), key=repr)
    added = rows(intervals.overlay(p, z, "id"), "id", "value")
    assert added == sorted(((i, float(sum(s <= t < e for s, e, _ in zones))) for i, t in enumerate(at)), key=repr)
    flags = rows(intervals.enabled(p, z, "id"), "id", "enabled")
    assert flags == sorted(((i, any(s <= t <= e for s, e, _ in zones)) for i, t in enumerate(at)), key=repr)


def test_no_zones_mute_nothing_and_extract_nothing(spark):
    p, none = _points(spark, [1, 2]), _cues(spark, [(0, 1, "x")], track=9)
    assert rows(intervals.mask(p, none, "id", hot=False), "value") == [(1.0,), (1.0,)]
    assert rows(intervals.overlay(p, none, "id", hot=False), "value") == [(0.0,), (0.0,)]


def test_nearest_anchor(spark, hot):
    anchors = spark.createDataFrame([(1, 0), (1, 1000), (1, 2000), (1, 1000)], "track int, at_ms bigint")
    got = rows(intervals.snap_to_anchor(_points(spark, [400, 500, 1600, 5000, 1000]), anchors, "id"), "id", "snapped_ms")
    assert got == [(0, 0), (1, 0), (2, 2000), (3, 2000), (4, 1000)]


def test_point_without_anchors_stays(spark):
    anchors = spark.createDataFrame([(2, 0)], "track int, at_ms bigint")
    assert rows(intervals.snap_to_anchor(_points(spark, [400]), anchors, "id", hot=False), "snapped_ms") == [(400,)]


def test_complement(spark, hot):
    zones = _cues(spark, [(10, 30, "m")])
    total = spark.createDataFrame([(1, 50), (2, 20)], "track int, total_ms bigint")
    assert rows(intervals.complement(zones, total)) == [(1, 0, 10), (1, 30, 50), (2, 0, 20)]


def test_complement_goes_on_from_the_last_end(spark, hot):
    zones = _cues(spark, [(0, 40, "long"), (10, 20, "inner")])
    total = spark.createDataFrame([(1, 50)], "track int, total_ms bigint")
    assert rows(intervals.complement(zones, total), "start_ms", "end_ms") == [(20, 50)]


TIMELINE = (
    "track int, seg_no bigint, orig_start double, orig_end double, new_start double, new_end double, "
    "new_chunk_dur double, kind string, clip_ms bigint"
)


def _timeline(spark, segments, track=1):
    data = [
        (track, i, float(a), float(b), float(c), float(d), float(d - c), k, clip)
        for i, (a, b, c, d, k, clip) in enumerate(segments)
    ]
    return spark.createDataFrame(data, TIMELINE)


@pytest.mark.parametrize(
    "at, new", [(500, 500), (1500, 2000), (1000, 1000), (2000, 3000), (-500, -500), (3500, 4500), (3000, 4000)]
)
def test_points_on_a_new_timeline(spark, at, new):
    timeline = _timeline(spark, [(0, 1000, 0, 1000, "gap", 0), (1000, 2000, 1000, 3000, "tts", 0), (2000, 3000, 3000, 4000, "gap", 0)])
    got = intervals.remap(_points(spark, [at]), timeline, "id", hot=False)
    assert rows(got, "new_ms") == [(pytest.approx(new),)]


def test_remap_against_the_loop_with_holes_and_nested_segments(spark, hot):
    rnd = random.Random(11)
    segments, at, new = [], 200, 50.0
    for _ in range(25):
        at += rnd.choice([0, 0, 40])
        length = rnd.choice([0, 30, 120, 333])
        took = rnd.choice([length, length * 2, 10])
        segments.append((at, at + length, new, new + took, "tts", 0))
        at, new = at + rnd.choice([length, max(0, length - 20)]), new + took
    segments.sort(key=lambda s: s[0])
    times = list(range(0, at + 400, 7)) + [s[0] for s in segments] + [s[1] for s in segments]

    def snap(x):
        return round(x / 1000.0 * 30.0) / 30.0 * 1000.0

    def moved(t):
        for a, b, c, d, *_ in segments:
            if a <= t <= b:
                return c if b - a <= 0 else snap(c + ((t - a) / (b - a)) * (d - c))
        if t > segments[-1][1]:
            return snap(segments[-1][3] + (t - segments[-1][1]))
        return snap(segments[0][2] - (segments[0][0] - t))

    got = rows(intervals.remap(_points(spark, times), _timeline(spark, segments), "id"), "id", "new_ms")
    assert [(i, round(x, 6)) for i, x in got] == sorted(((i, round(moved(t), 6)) for i, t in enumerate(times)), key=repr)


def test_track_without_timeline_is_left_alone(spark):
    got = intervals.remap(_points(spark, [77]), _timeline(spark, [(0, 1, 0, 1, "gap", 0)], track=5), "id", hot=False)
    assert rows(got, "new_ms") == [(77.0,)]


def test_cues_are_retimed_by_timeline_or_clip(spark, hot):
    timeline = _timeline(
        spark, [(0, 10000, 0, 10000, "gap", 0), (10000, 20000, 10000, 25000, "tts", 12000), (20000, 30000, 25000, 35000, "gap", 0)]
    )
    cues = _cues(spark, [(10050, 15000, "A"), (20000, 20001, "B")])
    plain = rows(intervals.retime(cues, timeline), "line", "start_ms", "end_ms", "text")
    assert plain == [(1, 10067, 17500, "A"), (2, 25000, 25100, "B")]
    by_clip = rows(intervals.retime(cues, timeline, by_clip=True), "line", "start_ms", "end_ms", "text")
    assert by_clip == [(1, 10067, 22067, "A"), (2, 25000, 25100, "B")]


def test_retimed_texts_may_be_wrapped(spark):
    timeline = _timeline(spark, [(0, 10000, 0, 10000, "gap", 0)])
    got = intervals.retime(_cues(spark, [(0, 1000, "one two three")]), timeline, width=7, hot=False)
    assert rows(got, "text") == [("one two\nthree",)]


def test_segments_outside_the_track_are_left_out(spark):
    lengths = spark.createDataFrame([(1, 100)], "track int, length_ms bigint")
    zones = _cues(spark, [(-1, 10, "a"), (0, 100, "b"), (50, 101, "c")])
    assert rows(intervals.valid_segments(zones, lengths), "text") == [("b",)]


def test_renumbering(spark, hot):
    cues = _cues(spark, [(i * 10, i * 10 + 5, str(i)) for i in range(20)]).filter("line % 3 = 0")
    got = rows(intervals.renumbered(cues), "line", "text")
    assert got == sorted(((i + 1, str(3 * i + 2)) for i in range(6)), key=repr)


def test_interval_operators_keep_tracks_apart(spark, hot):
    cues = _cues(spark, [(0, 500, "A")]).unionByName(_cues(spark, [(0, 500, "B")], track=2))
    zones = _cues(spark, [(200, 300, "m")], track=2)
    got = rows(intervals.clip_drop(cues, zones).select("track", F.col("end_ms")))
    assert got == [(1, 500), (2, 200)]


def test_clipped_cues_keep_their_order_and_repeated_lines_are_retimed(spark):
    columns = "track int, line bigint, start_ms bigint, end_ms bigint, text string"
    cues = spark.createDataFrame([(1, 1, 9000, 9500, "late"), (1, 2, 1000, 2000, "early"), (1, 3, 5000, 5500, "gone")], columns)
    zones = spark.createDataFrame([(1, 1, 4000, 6000)], "track int, line bigint, start_ms bigint, end_ms bigint")
    assert rows(intervals.clip_drop(cues, zones), "line", "text") == [(1, "late"), (2, "early")]
    timeline = spark.createDataFrame(
        [(1, 1, 0.0, 10000.0, 0.0, 20000.0, 20000.0, "tts", None)],
        "track int, seg_no bigint, orig_start double, orig_end double, new_start double, new_end double, new_chunk_dur double,"
        " kind string, clip_ms bigint")
    again = cues.withColumn("line", F.when(F.col("text") == "gone", 2).otherwise(1).cast("bigint"))
    for by_clip in (False, True):
        got = intervals.retime(again, timeline, by_clip=by_clip)
        assert rows(got, "line", "start_ms", "end_ms", "text") == [(1, 18000, 19000, "late"), (1, 2000, 4000, "early"), (2, 10000, 11000, "gone")]
