import random

import pytest
from pyspark.sql import functions as F

from cuespan.operators import aggregates, layout
from tests.conftest import rows
from tests.test_intervals import _cues, _random


def _total(spark, ms):
    return spark.createDataFrame([(1, ms)], "track int, total_ms bigint")


SLOT = ["kind", "start_ms", "end_ms", "slot_ms", "hard_limit_ms"]


def _in_order(df):
    return [tuple(r) for r in df.orderBy("start_ms", "end_ms").select(*SLOT).collect()]


def test_slots_of_speech_mutes_and_gaps(spark, hot):
    cues = _cues(spark, [(10000, 15000, "A"), (20000, 25000, "B"), (45000, 50000, "C")])
    mutes = _cues(spark, [(30000, 40000, "m")])
    assert _in_order(layout.slots_of(cues, mutes, _total(spark, 60000))) == [
        ("gap", 0, 10000, 10000, None),
        ("tts", 10000, 20000, 10000, None),
        ("tts", 20000, 30000, 10000, 10000),
        ("mute", 30000, 40000, 10000, None),
        ("gap", 40000, 45000, 5000, None),
        ("tts", 45000, 60000, 15000, None),
    ]


def test_slots_are_contiguous(spark, hot):
    cues = _cues(spark, [(82500, 84700, "A"), (84766, 87366, "B")])
    mutes = _cues(spark, [(84233, 87566, "m")])
    got = _in_order(layout.slots_of(cues, mutes, _total(spark, 100000)))
    assert got[0][1] == 0 and got[-1][2] == 100000
    assert all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_track_without_cues_is_one_gap(spark):
    empty = _cues(spark, [(0, 1, "x")]).filter("false")
    assert _in_order(layout.slots_of(empty, empty, _total(spark, 70), hot=False)) == [("gap", 0, 70, 70, None)]


def _slots_by_hand(cues, mutes, total):
    events = sorted(
        [("mute", s, e) for s, e, _ in mutes] + [("tts", s, e) for s, e, _ in cues], key=lambda x: (x[1], x[0] != "mute")
    )
    cursor, out = 0, []
    for i, (kind, start, end) in enumerate(events):
        begin = max(cursor, start)
        if begin > cursor:
            out.append(("gap", cursor, begin, begin - cursor, None))
        own, limit = max(begin, end) - begin, None
        slot = own
        if kind == "tts":
            later = [e for e in events[i + 1 :] if e[1] >= begin]
            slot = (later[0][1] if later else total) - begin
            if later and later[0][0] == "mute":
                limit = slot
            if slot <= 0:
                slot = own
        out.append((kind, begin, begin + slot, slot, limit))
        cursor = begin + slot
    if cursor < total:
        out.append(("gap", cursor, total, total - cursor, None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_slots_against_the_loop_with_and_without_ties(spark, hot, seed):
    rnd = random.Random(seed)
    mutes = _random(rnd, 5, 4000, 300)
    clear = [
        (s, e, t) for s, e, t in _random(rnd, 25, 4000, 500)
        if not any(ms <= s < me for ms, me, _ in mutes)
    ]
    if seed % 2:
        clear += [(s, s + rnd.randrange(100, 900), "tie") for s, _, _ in rnd.sample(clear, 4)]
        clear.sort(key=lambda c: c[0])
    got = layout.slots(_cues(spark, clear), _cues(spark, mutes), _total(spark, 5000))
    assert rows(got, *SLOT) == sorted(_slots_by_hand(clear, mutes, 5000), key=repr)


@pytest.mark.parametrize(
    "clip, slot, limit, want",
    [
        (8000, 10000, None, (1.0, 1.0, 10000.0)),
        (15000, 10000, None, (2 / 3, 1.0, 15000.0)),
        (25000, 10000, None, (0.5, 1.25, 20000.0)),
        (9000, 10000, 8000, (8 / 9, 1.0, 9000.0)),
    ],
)
def test_speeds(spark, clip, slot, limit, want):
    df = spark.createDataFrame([("tts", slot, limit, clip)], "kind string, slot_ms bigint, hard_limit_ms bigint, clip_ms bigint")
    got = layout.with_speeds(df).select("video_speed", "audio_speed", "new_ms").first()
    assert tuple(got) == pytest.approx(want)


def test_speed_without_cap_and_of_an_empty_slot(spark):
    df = spark.createDataFrame(
        [("tts", 10000, None, 40000), ("tts", 0, None, 10)], "kind string, slot_ms bigint, hard_limit_ms bigint, clip_ms bigint"
    )
    free = layout.with_speeds(df, no_cap=True).collect()
    assert (free[0].video_speed, free[0].new_ms) == (0.25, 40000.0)
    assert free[1].needs_review
    assert layout.with_speeds(df).collect()[1].needs_review


BLOCKS = (
    "track int, kind string, start_ms bigint, slot_ms bigint, clip_ms bigint, video_speed double, audio_speed double"
)


def test_timeline_gets_a_tail(spark, hot):
    blocks = spark.createDataFrame(
        [(1, "gap", 0, 10000, 0, 1.0, 1.0), (1, "tts", 10000, 10000, 15000, 2 / 3, 1.0),
         (1, "tts", 20000, 15000, 100, 1.0, 1.0), (1, "mute", 35000, 10000, 0, 1.0, 1.0)], BLOCKS
    )
    got = layout.timeline(blocks, _total(spark, 50000)).orderBy("seg_no").collect()
    assert [(r.kind, r.orig_start, r.orig_end) for r in got][-1] == ("tail", 45000.0, 50000.0)
    assert [round(r.new_start) for r in got] == [0, 10000, 25000, 40000, 50000]
    assert round(got[-1].new_end) == 55000
    assert [r.seg_no for r in got] == [1, 2, 3, 4, 5]


def test_timeline_gets_a_head(spark, hot):
    blocks = spark.createDataFrame([(1, "tts", 1000, 2000, 0, 1.0, 1.0)], BLOCKS)
    got = layout.timeline(blocks).orderBy("seg_no").collect()
    assert [(r.kind, r.orig_start, r.orig_end, round(r.new_start)) for r in got] == [
        ("gap", 0.0, 1000.0, 0), ("tts", 1000.0, 3000.0, 1000)
    ]


def test_rebased_timeline_follows_actual_lengths(spark, hot):
    blocks = spark.createDataFrame([(1, "tts", i * 1000, 1000, 0, 1.0, 1.0) for i in range(12)], BLOCKS)
    timeline = layout.timeline(blocks)
    lengths = timeline.filter("seg_no <= 10").select("track", "seg_no", (F.col("seg_no") * 3.0).alias("actual_frames"))
    got = layout.rebase(layout.measured(timeline, lengths)).orderBy("seg_no").collect()
    assert len(got) == 10
    assert [round(r.new_end / 100) for r in got] == [sum(range(1, i + 1)) for i in range(1, 11)]


def test_planned_and_realised_frames_differ_on_purpose(spark):
    blocks = spark.createDataFrame([(1, "tts", 0, 1000, 0, 0.7, 1.0)], BLOCKS)
    got = layout.realised(layout.timeline(blocks)).first()
    assert (round(got.new_chunk_dur / 1000 * 30), got.actual_frames) == (43, 43.0)
    blocks = spark.createDataFrame([(1, "tts", 0, 1000, 0, 0.71, 1.0)], BLOCKS)
    got = layout.realised(layout.timeline(blocks)).first()
    assert (round(got.new_chunk_dur / 1000 * 30), got.actual_frames) == (42, 43.0)


def test_serial_layout_against_the_loop(spark, hot):
    rnd = random.Random(2)
    cues = _random(rnd, 40, 20000, 600)
    clips = [rnd.choice([None, rnd.randrange(50, 1500)]) for _ in cues]
    data = [(1, i + 1, s, e, c) for i, ((s, e, _), c) in enumerate(zip(cues, clips))]
    df = spark.createDataFrame(data, "track int, line bigint, start_ms bigint, end_ms bigint, clip_ms bigint")
    end, want = 0, []
    for _, line, s, e, c in data:
        length = max(e - s if c is None else c, e - s)
        begin = max(end, s)
        end = begin + length
        want.append((line, begin, end, 0))
    want[-1] = (*want[-1][:3], max(0, 30000 - end))
    assert rows(layout.serial(df, _total(spark, 30000)), "line", "start_ms", "end_ms", "tail_ms") == sorted(want, key=repr)


def test_adjacent_slots_squeeze_and_align(spark, hot):
    data = [(1, 1, 1000, 1500, 3000), (1, 2, 2000, 2500, 400), (1, 3, 3000, 3500, None), (1, 4, 3000, 3100, 50)]
    df = spark.createDataFrame(data, "track int, line bigint, start_ms bigint, end_ms bigint, clip_ms bigint")
    slotted = layout.adjacent_slots(df, _total(spark, 4200))
    assert rows(slotted, "line", "slot_ms", "clip_ms") == [(1, 1000, 3000), (2, 1000, 400), (3, 0, 0), (4, 1200, 50)]
    assert rows(layout.compression(slotted, 1.5), "line", "target_ms") == [(1, 2000)]
    assert rows(layout.aligned(slotted, 1.5), "line", "start_ms", "end_ms", "padded_ms", "cut_ms") == [
        (1, 0, 1000, 0, 1000), (2, 1000, 2000, 600, 0), (3, 2000, 2001, 1, 0), (4, 2001, 3201, 1150, 0)
    ]


def test_clips_joined_with_pauses(spark, hot):
    clips = spark.createDataFrame([(1, 0, 100), (1, 1, None), (1, 2, 50)], "track int, clip_no bigint, clip_ms bigint")
    assert rows(layout.with_pauses(clips, 10), "clip_no", "start_ms", "end_ms") == [(0, 0, 100), (2, 110, 160)]


def test_missing_clip_counts_as_zero(spark):
    cues = _cues(spark, [(0, 10, "a"), (10, 20, "b")])
    clips = spark.createDataFrame([(1, 1, 77)], "track int, clip_no bigint, clip_ms bigint")
    assert rows(layout.with_clips(cues, clips), "line", "clip_ms", "clip_missing") == [(1, 0, True), (2, 77, False)]


def test_audit_passes_a_sound_timeline_and_fails_a_torn_one(spark, hot):
    blocks = spark.createDataFrame([(1, "tts", i * 1000, 1000, 0, 1.0, 1.0) for i in range(8)], BLOCKS)
    timeline = layout.timeline(blocks)
    assert aggregates.drift_audit(timeline).first().verdict == "PASS"
    torn = timeline.withColumn("new_start", F.when(F.col("seg_no") == 5, F.col("new_start") - 2000).otherwise(F.col("new_start")))
    got = aggregates.drift_audit(torn).first()
    assert (got.verdict, got.not_rising, got.seams) == ("FAIL", 1, 1)
