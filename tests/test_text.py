import pytest
from pyspark.sql import functions as F

from cuespan.functions import stamps, text as rules
from cuespan.operators import aggregates, frames, neighbours, segment
from cuespan.plans.views import Views
from tests.conftest import rows


@pytest.fixture
def one(spark):
    """Value of an expression for one text."""

    def value(expression, text=""):
        return spark.createDataFrame([(text,)], "t string").select(expression.alias("v")).first()["v"]

    return value


def test_script_text_keeps_letters_then_marks(one):
    got = one(rules.script_text("t"), "Hi 你好，world 世界！𠀀")
    assert (got.kept, got.char_count, got.has_script, got.removed_chars) == ("你好世界𠀀，！", 7, True, 9)
    blank = one(rules.script_text("t"), "  ")
    assert (blank.kept, blank.char_count, blank.has_script, blank.removed_chars) == ("", 0, False, 0)
    assert one(rules.script_text("t"), "，。").kept == ""


def test_script_filters(one):
    assert one(rules.script_or_null("t"), "a好") is None
    assert one(rules.script_or_null("t"), "a好。") == "好。"
    assert one(rules.script_ratio("t"), "a好好，") == 0.5
    assert one(rules.script_ratio("t"), "") == 0.0


def test_script_runs_come_with_context(one):
    got = one(rules.script_runs("t", context=2), "ab你好cd𠀀")
    assert [tuple(r) for r in got] == [("你好", 2, 4, "ab你好cd"), ("𠀀", 6, 7, "cd𠀀")]


@pytest.mark.parametrize(
    "text, kept",
    [
        ("", ""), (" None ", ""), ("EMPTY", ""), ("图片中没有字", ""), ("No visible text here", ""), ("see https://a.b", ""),
        ("1\n2\n3", ""), ("12", ""), ("123", "123"), ("aaaaaaaaa", ""), ("aaaaaaaa", "aaaaaaaa"), ("d", ""), ("好", "好"),
        (" fine text ", "fine text"),
    ],
)
def test_junk(one, text, kept):
    assert one(rules.without_junk("t"), text) == kept


def test_lenient_junk_lets_single_letters_pass(one):
    assert one(rules.without_junk("t", strict=False), "d") == "d"


def test_markup_goes(one):
    assert one(rules.without_thinking("t"), "<think>a\nb</think> hi") == "hi"
    assert one(rules.without_references("t"), "<|ref|>x<|/ref|><|det|>[1]\n<|/det|>hi") == "hi"
    assert one(rules.without_tags("t"), "<b>a</b> <i class=x>b</I>") == "a <i class=x>b"
    assert one(rules.tagged_payload("t", "out"), "<think><out>no</out></think><OUT> yes\n</out> x") == "yes"
    assert one(rules.tagged_payload("t", "out"), "<out>open end") == "open end"
    assert one(rules.tagged_payload("t", "out"), "nothing") is None


def test_wraps(one):
    assert one(rules.hard_wrap("t", 3), r"abcdefg\Nxy") == r"abc\Ndef\Ng\Nxy"
    assert one(rules.hard_wrap("t", 14), "abcdefghijk") == "abcdefghijk"
    assert one(rules.newline_to_break("t"), "a\r\nb\nc\rd") == r"a\Nb\Nc\Nd"
    assert one(rules.soft_wrap("t", 15), "This is a very long text") == "This is a very\nlong text"
    assert one(rules.soft_wrap("t", 3), "unbreakable is") == "unbreakable\nis"
    assert one(rules.soft_wrap("t", 4), "これは日本。語の文") == "これは日\n本。語の\n文"
    assert one(rules.soft_wrap("t", 3), "これは。日本") == "これは。\n日本"
    assert one(rules.soft_wrap("t", 0), "a  b") == "a  b"


def test_breaks_near_the_width(one):
    got = one(rules.break_near("t", 8), "one two three four")
    assert got == "one two \nthree \nfour"
    assert one(rules.break_near("t", 5), "abcdefghijkl") == "abcde\nfghijkl"
    assert one(rules.break_near("t", 20), "  short  ") == "short"


def test_languages(one):
    assert [one(rules.is_cjk_language("t"), x) for x in ("zh", "JA-jp", "zh-TW", "en", "vi")] == [True, True, True, False, False]
    assert one(rules.is_cjk("t"), "abc한") and not one(rules.is_cjk("t"), "abc")


@pytest.mark.parametrize(
    "text, ms", [("00:01:24,233", 84233), (" 01:30:45.500 ", 5445500), ("00:00:01,001", 1000), ("x", None), ("1:2", None), ("00:00:00,000", 0)]
)
def test_clock_to_ms(one, text, ms):
    assert one(stamps.clock_to_ms("t"), text) == ms


def test_stamps_convert(one):
    assert one(stamps.ms_to_clock(F.lit(5445500))) == "01:30:45,500"
    assert one(stamps.seconds_to_clock(F.lit(-2.0))) == "00:00:00,000"
    assert one(stamps.seconds_to_clock(F.lit(3661.999))) == "01:01:01,998"
    assert one(stamps.clock_to_centi("t"), "00:01:24,233") == "0:01:24.23"
    assert one(stamps.clock_to_centi("t"), "01:24,233") is None
    assert one(stamps.centi_to_clock("t"), "1:30:45.50") == "01:30:45,500"
    assert one(stamps.centi_to_clock("t"), "bad") is None
    assert one(stamps.centi_to_ms("t"), "0:01:24.23") == 84230
    assert one(stamps.centi_to_ms("t"), "0:01:24") == 84000
    assert one(stamps.ms_to_centi(F.lit(84239))) == "0:01:24.23"
    assert one(stamps.flexible_seconds("t"), "02:03.50") == 123.5
    assert one(stamps.flexible_seconds("t"), "01:02:03") == 3723.0
    assert one(stamps.flexible_seconds("t"), "5") is None
    assert one(stamps.tolerant_seconds("t"), "bad") == 0.0


def test_scaling(one):
    assert one(stamps.scaled(F.lit(10000), 0.65)) == 15385
    assert one(stamps.scaled(F.lit(10000), 1.5)) == 6667
    assert one(stamps.scaled(F.lit(0), 2.0)) == 1
    with pytest.raises(ValueError):
        stamps.scaled(F.lit(1), 0)


CUES = "track int, line bigint, start_ms bigint, end_ms bigint, text string"


def test_durations_are_clamped(spark, hot):
    data = [(1, 1, 0, 200, "a"), (1, 2, 500, 9000, "b"), (1, 3, 20000, 20100, "c"), (1, 4, 20500, 40000, "d"), (1, 5, 41000, 41100, "e")]
    got = rows(neighbours.clamp_durations(spark.createDataFrame(data, CUES)), "line", "end_ms")
    assert got == [(1, 500), (2, 7500), (3, 20500), (4, 27500), (5, 42000)]


def test_equal_neighbours_merge_within_the_gap(spark, hot):
    data = [(1, 1, 0, 1000, "a"), (1, 2, 1400, 1200, "a"), (1, 3, 1700, 2000, "a"), (1, 4, 2600, 3000, "a"), (1, 5, 3000, 3100, "b")]
    df = spark.createDataFrame(data, CUES)
    assert rows(neighbours.merge_close(df), "line", "start_ms", "end_ms", "text") == [
        (1, 0, 2000, "a"), (2, 2600, 3000, "a"), (3, 3000, 3100, "b")
    ]
    assert rows(neighbours.collapse_repeats(df), "line", "start_ms", "end_ms") == [(1, 0, 3000), (2, 3000, 3100)]


def test_time_batches_open_at_their_first_row(spark, hot):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 10, 30, 59, 60, 90, 119, 125, 200])], "track int, line bigint, start_ms bigint")
    batches = neighbours.time_batches(df, 60)
    assert [r.batch for r in batches.orderBy("line").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 3]
    assert rows(neighbours.batch_spans(batches), "batch", "start_ms", "end_ms", "rows") == [(0, 0, 60, 4), (1, 60, 125, 3), (2, 125, 200, 1), (3, 200, 200, 1)]


def test_statistics_of_a_track_without_cues(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "ab"), (1, 2, 0, 3000, "abcd")], CUES)
    tracks = spark.createDataFrame([(1,), (2,)], "track int")
    assert rows(aggregates.track_statistics(cues, tracks)) == [
        (1, 2, 4000, 6, 2000.0, 3.0, 1000, 3000), (2, 0, 0, 0, 0.0, 0.0, None, None)
    ]


def test_quiet_edges(spark, hot):
    levels = [(t, 5.0 if t < 500 or t >= 1500 else 50.0) for t in range(0, 2000, 50)]
    series = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(levels)], "track int, event_id bigint, at_ms bigint, value double")
    quiet = series.withColumns({"track": F.lit(2), "value": F.lit(1.0)})
    lengths = spark.createDataFrame([(1, 2000), (2, 2000)], "track int, length_ms bigint")
    assert rows(aggregates.quiet_edges(series.union(quiet), lengths, 10.0)) == [(1, 470, 1530, 940), (2, 0, 2000, 0)]


def test_frames_changes_and_cues(spark, hot):
    hashes = [0, 0, 0b11111, 0b11111, 0b11110, 0, 0]
    df = spark.createDataFrame([(1, i, h, i / 2) for i, h in enumerate(hashes)], "track int, frame_no bigint, hash bigint, ts_s double")
    changed = frames.changes(df, 4)
    assert [r.changed for r in changed.orderBy("frame_no").collect()] == [True, False, True, False, False, False, False]
    assert rows(frames.change_cues(changed), "line", "start_s", "end_s") == [(1, 0.0, 0.5), (2, 1.0, 3.0)]
    single = frames.change_cues(changed.filter("frame_no = 0"))
    assert rows(single, "start_s", "end_s") == [(0.0, 3.0)]
    busy = changed.withColumn("changed", F.lit(True))
    assert [r.frame_no for r in frames.debounced(busy, 3).filter("changed").orderBy("frame_no").collect()] == [0, 3, 6]


def test_sampling_spreads_evenly(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "track int, frame_no bigint")
    assert rows(frames.evenly_spaced(df, 4), "track", "sample_no", "frame_no") == [
        (1, 0, 0), (1, 1, 3), (1, 2, 6), (1, 3, 9), (2, 0, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0)
    ]
    assert rows(frames.every_nth(df, 4, 0), "track", "frame_no") == [(1, 0), (1, 4), (1, 8), (2, 0)]


def test_activity_gate(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0]), (2, []), (3, None), (4, [0.0] * 99 + [9.0])], "i int, cells array<double>")
    assert [r.ok for r in df.select("i", frames.active_enough("cells", 1.0).alias("ok")).orderBy("i").collect()] == [True, False, True, False]


def test_text_in_parts_is_whole(spark, hot):
    df = spark.createDataFrame([(1, i, 0, 0, f"t{i}") for i in range(10)], CUES)
    parts = aggregates.full_text(df, part_rows=4).orderBy("part").collect()
    assert [p.text for p in parts] == ["t0\nt1\nt2\nt3", "t4\nt5\nt6\nt7", "t8\nt9"]


def test_transcript_prefers_the_given_text(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, " a  b "), (1, 2, 0, 0, ""), (1, 3, 0, 0, "c"), (2, 1, 0, 0, "x")], CUES)
    full = spark.createDataFrame([(2, " given ")], "track int, full_text string")
    assert rows(aggregates.transcript(df, True, full, hot=False), "track", "text") == [(1, "a b c"), (2, "given")]
    assert rows(aggregates.transcript(df.filter("track = 1"), False, hot=False), "text") == [("a  bc",)]


def test_hash_of_many_features(spark):
    low, high = [1.0] * 64 + [-1.0] * 64, [1.0] * 128
    df = spark.createDataFrame([(1, 0, low), (1, 1, high), (1, 2, high)], "track int, frame_no bigint, features array<double>")
    hashed = df.withColumn("hash", frames.sign_hash("features"))
    assert hashed.first()["hash"] == [-1, 0]
    assert rows(frames.changes(hashed, 4, hot=False), "frame_no", "distance", "changed") == [(0, None, True), (1, 64, True), (2, 0, False)]


def _plan(spark, column):
    df = spark.createDataFrame([("a",)], "text string").repartition(2).select(column.alias("x"))
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_matched_once_for_each_pattern(spark):
    """Patterns that several results share are not matched anew for each."""
    assert _plan(spark, rules.script_or_null("text", "a-z", "!?", 2)).count("regexp_extract_all") == 2
    assert _plan(spark, segment.sentence_parts(F.col("text"), 50, True)).count("regexp_extract_all") == 1


def test_documents_of_one_row_group_are_spread(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    for made in (views.lines(), views.tokens()):
        assert "hashpartitioning(doc_id" in made._jdf.queryExecution().executedPlan().toString()
