import itertools
import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from cuespan.folds import slices
from cuespan.operators import models
from cuespan.plans import jobs, stand_ins
from cuespan.sources import ass, files, srt
from tests.conftest import rows
from tests.test_intervals import TIMELINE

SRT = """1
00:01:24,233 --> 00:01:27,566
<b>Hello</b> <i class="x">world</i>

2
00:01:28,000 --> 00:01:30,000
two

lines

x
00:01:31,000 --> 00:01:32,000
no index

4
invalid --> timestamp
bad

5
00:02:00,000 --> 00:01:00,000
backwards

6
00:02:00,000 --> 00:02:01,000

7
00:02:02,000 -> 00:02:03,000
no arrow

8
00:02:04.500 --> 00:02:05.500
first\r
second
"""


def test_srt_files_are_read(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(SRT.encode())
    (tmp_path / "b.srt").write_text("1\r\n00:00:00,000 --> 00:00:01,001\r\nonly\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\nnext\r\n")
    got = srt.read_srt(spark, str(tmp_path / "*.srt")).withColumn("track", F.regexp_extract("track", "[^/]*$", 0))
    assert rows(got, "track", "line", "start_ms", "end_ms", "text") == [
        ("a.srt", 1, 84233, 87566, 'Hello <i class="x">world'), ("a.srt", 2, 88000, 90000, "two"),
        ("a.srt", 8, 124500, 125500, "first\nsecond"), ("b.srt", 1, 0, 1000, "only"), ("b.srt", 2, 2000, 3000, "next"),
    ]
    texts = srt.read_texts(spark, str(tmp_path / "a.srt"))
    reasons = [r.reason for r in srt.bad_blocks(texts).orderBy("block").collect()]
    assert reasons == ["too few lines", "no index", "bad stamp", "no length", "empty text", "no arrow"]
    kept = srt.blocks_to_cues(texts, skip_empty=False).filter("text = ''")
    assert rows(kept, "line", "start_raw", "time") == [(6, "00:02:00,000", "00:02:00,000 --> 00:02:01,000")]
    strict = srt.read_strict(texts)
    assert [r.line for r in strict.orderBy("line").collect()] == [1, 2, 4, 5, 8]
    assert strict.filter("line = 5").first().end_s == 121.0


def test_written_tracks_read_back(spark, tmp_path):
    data = [(t, i + 1, i * 1000, i * 1000 + 900, f"line {i}" if i else "") for t in (1, 2) for i in range(30)]
    cues = spark.createDataFrame(data, "track int, line bigint, start_ms bigint, end_ms bigint, text string").repartition(5)
    srt.write_srt(cues, str(tmp_path / "out"))
    for t in (1, 2):
        text = "\n".join(p.read_text().rstrip("\n") + "\n" for p in sorted((tmp_path / "out" / f"track={t}").glob("part-*")))
        assert text.startswith("1\n00:00:00,000 --> 00:00:00,900\n\n2\n")
        parsed = srt.blocks_to_cues(spark.createDataFrame([(t, text)], "track int, content string"))
        assert [r.line for r in parsed.orderBy("block").collect()] == list(range(2, 31))
    srt.write_minified(cues, str(tmp_path / "mini"))
    srt.write_text(cues, str(tmp_path / "txt"))
    mini = "".join(p.read_text() for p in sorted((tmp_path / "mini" / "track=1").glob("part-*")))
    assert mini.splitlines() == [f"line {i}" for i in range(1, 30)]
    stamped = "".join(p.read_text() for p in sorted((tmp_path / "txt" / "track=1").glob("part-*")))
    assert stamped.splitlines()[3] == "[00:00:03,000] line 3"


ASS = """[Script Info]
ScriptType: v4.00+
Title: a: b

[V4+ Styles]
Format: Name, Fontname
Style: One,Sans
Style: Two,Serif

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.00,0:00:10.50,One,,0,0,0,,Hello, with, commas
Comment: 0,ignored
Dialogue: 0,0:00:11.00,0:00:12.00,One,,0,0
"""


def test_ass_files_are_read_scaled_and_retimed(spark, tmp_path):
    (tmp_path / "a.ass").write_text(ASS)
    texts = srt.read_texts(spark, str(tmp_path / "a.ass")).withColumn("track", F.lit(1))
    lines = ass.sections(texts)
    head = ass.headers(lines).first()
    assert head.script_info == {"ScriptType": "v4.00+", "Title": "a: b"}
    assert head.styles == ["Style: One,Sans", "Style: Two,Serif"] and head.events_format.startswith("Format: Layer")
    said = ass.dialogues(lines).orderBy("line_no").collect()
    assert [(r.complete, r.start_ms, r.text) for r in said] == [(True, 1000, "Hello, with, commas"), (False, 11000, None)]
    scaled = [r.value for r in ass.scaled(ass.dialogues(lines), 0.5).orderBy("line_no").collect()]
    assert scaled[0] == "Dialogue: 0,0:00:02.00,0:00:21.00,One,,0,0,0,,Hello, with, commas"
    assert scaled[1] == "Dialogue: 0,0:00:11.00,0:00:12.00,One,,0,0"
    timeline = spark.createDataFrame([(1, 1, 0.0, 20000.0, 0.0, 40000.0, 40000.0, "gap", 0)], TIMELINE)
    moved = [r.value for r in ass.retimed(ass.dialogues(lines), timeline, 15, hot=False).orderBy("line_no").collect()]
    assert moved[0] == "Dialogue: 0,0:00:02.00,0:00:21.00,One,,0,0,0,,Hello, with, co\\Nmmas"
    assert moved[1] == scaled[1]


def test_ass_is_written_after_its_header(spark, tmp_path):
    cues = spark.createDataFrame([(1, 2, 84233, 87566, "b"), (1, 1, 0, 1000, "first\nline that is long")],
                                 "track int, line bigint, start_ms bigint, end_ms bigint, text string")
    ass.write_ass(cues, str(tmp_path / "out"), ass.header_text({"ScriptType": "v4.00+"}, ["Style: NoteStyle,Sans"], "Format: Layer"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "track=1").glob("part-*"))).splitlines()
    assert text[:2] == ["[Script Info]", "ScriptType: v4.00+"]
    assert text[-2:] == [
        "Dialogue: 0,0:00:00.00,0:00:01.00,NoteStyle,,0,0,0,,first\\Nline that is l\\Nong",
        "Dialogue: 0,0:01:24.23,0:01:27.56,NoteStyle,,0,0,0,,b",
    ]


def test_transcripts_boxes_and_manifests(spark, tmp_path):
    raw = "[00:03.20 --> 00:06.80] 你好世界\nmore\n[00:09.00 --> 00:08.00] reversed\n[01:00:00.00 --> 01:00:01:50] late"
    replies = spark.createDataFrame([(1, 60.0, raw), (2, 0.0, "nothing")], "track int, offset_s double, raw string")
    got = rows(files.transcript_cues(replies), "line", "start_s", "end_s", "text")
    assert got[0] == (1, 63.2, 66.8, "你好世界\nmore") and len(got) == 1

    (tmp_path / "boxes.txt").write_text("# comment\n\nsubtitle 370 930 1180 140\nnote 1 2 3 4 extra\nbad 1 2 3\nworse a b c d\n")
    assert rows(files.read_boxes(spark, str(tmp_path / "boxes.txt"))) == [("note", 1, 2, 3, 4), ("subtitle", 370, 930, 1180, 140)]

    (tmp_path / "tasks.json").write_text(json.dumps([
        {"input": "in/a.mp4", "output": "out/x.srt"}, {"input": "in/b.mp4", "output": "out/dir"}, {"input": "c.mp4"}, {"output": "lost"}
    ]))
    got = rows(files.read_manifest(spark, str(tmp_path / "tasks.json"), ".srt"), "input", "output", "rejected")
    assert got == sorted([("in/a.mp4", "out/x.srt", False), ("in/b.mp4", "out/dir/b.srt", False), ("c.mp4", "c.srt", False), (None, None, True)], key=repr)
    assert files.read_manifest(spark, str(tmp_path / "tasks.json"), ".srt", "dflt").filter("input = 'c.mp4'").first().output == "dflt/c.srt"


def test_a_manifest_routes_what_was_read(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.srt").write_text(f"1\n00:00:00,000 --> 00:00:01,000\n{name}\n")
    (tmp_path / "tasks.json").write_text(json.dumps([{"input": str(tmp_path / "a.srt"), "output": "out/x.srt"}, {"input": str(tmp_path / "b.srt")}]))
    manifest = files.read_manifest(spark, str(tmp_path / "tasks.json"), ".txt")
    got = files.routed(srt.read_srt(spark, str(tmp_path / "*.srt")), manifest)
    assert rows(got, "text", "output") == [("a", "out/x.srt"), ("b", str(tmp_path / "b.txt"))]


def test_files_are_listed_by_kind(spark, tmp_path):
    for name in ("a.MP4", "b.wav", "c.srt", "d.ass", "e.txt", "f", "g.webm"):
        (tmp_path / name).write_text("x")
    listed = files.list_files(spark, str(tmp_path))
    assert {r.media: r["count"] for r in listed.groupBy("media").count().collect()} == {
        "video": 2, "audio": 1, "srt": 1, "ass": 1, "unknown": 2
    }
    assert [r.path[-5:] for r in files.list_videos(spark, str(tmp_path)).collect()] == ["a.MP4"]


def test_queues_and_word_json(spark, hot):
    cues = spark.createDataFrame([(1, 1, 0, 10, "a"), (1, 2, 20, 30, "b")], "track int, line bigint, start_ms bigint, end_ms bigint, text string")
    assert rows(srt.speech_queue(cues, "d"), "clip_no", "filename", "total_ms") == [(0, "d/dubb-0.wav", 30), (1, "d/dubb-1.wav", 30)]
    words = spark.createDataFrame([(1, 0, "Hi, ", 0.0, 0.5), (1, 1, "you", 1.0, 1.5)], "track int, tok_idx bigint, text string, start_s double, end_s double")
    got = json.loads(files.word_json(words, "en").first().json)
    assert got == {"language": "en", "text": "Hi, you", "time_stamps": [
        {"text": "Hi, ", "start_time": 0.0, "end_time": 0.5}, {"text": "you", "start_time": 1.0, "end_time": 1.5}]}


def test_replies_are_merged_by_position_or_not_at_all(spark):
    batched = spark.createDataFrame(
        [(1, b, p, 10 * b + p, f"t{b}{p}") for b in range(4) for p in range(2)], "track int, batch bigint, pos int, line bigint, text string"
    )

    def blocks(*texts):
        return "\n\n".join(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i + 1},000\n{t}" for i, t in enumerate(texts))

    replies = spark.createDataFrame(
        [(1, 0, f"<think>x</think><TRANSLATE_TEXT>\n{blocks('A', 'B')}"), (1, 1, f"<TRANSLATE_TEXT>{blocks('A')}</TRANSLATE_TEXT>"), (1, 2, blocks("A", "B"))],
        "track int, batch bigint, reply string",
    )
    got = rows(models.merge_replies(batched, replies), "batch", "pos", "text", "status")
    assert got == [
        (0, 0, "A", "ok"), (0, 1, "B", "ok"), (1, 0, "t10", "mismatch"), (1, 1, "t11", "mismatch"),
        (2, 0, "t20", "failed"), (2, 1, "t21", "failed"), (3, 0, "t30", "failed"), (3, 1, "t31", "failed"),
    ]


def test_only_unusable_replies_are_asked_for_again(spark):
    def model():
        asked = {}

        def call(message):
            asked[message] = asked.get(message, 0) + 1
            if message == "broken":
                raise ValueError("no service")
            if message == "slow" and asked[message] < 3:
                return "no payload"
            if message == "reversed":
                return "<TRANSLATE_TEXT>1\n00:00:02,000 --> 00:00:01,000\nx</TRANSLATE_TEXT>"
            return "" if message == "empty" else "<TRANSLATE_TEXT>1\n00:00:00,000 --> 00:00:01,000\nx</TRANSLATE_TEXT>"

        return call

    df = spark.createDataFrame([(1, i, 1, m) for i, m in enumerate(["fine", "slow", "broken", "empty", "reversed"])], "track int, batch bigint, blocks bigint, message string")
    got = models.call_batches(df, model, models.reply_problem, 3, parallel=1)
    assert rows(got, "message", "status", "attempts") == [("broken", "failed", 1), ("empty", "failed", 3), ("fine", "ok", 1), ("reversed", "failed", 3), ("slow", "ok", 3)]
    again = models.call_batches(df, model, models.reply_problem, 0, parallel=1).filter("message = 'slow'").first()
    assert (again.status, again.attempts) == ("failed", 1)


def test_recogniser_batches_and_missing_items(spark):
    def model():
        def call(items):
            if "bad" in items:
                raise ValueError
            return [i.upper() for i in items]

        return call

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "c"), (5, "d")], "id int, item string").coalesce(1)
    assert [r.text for r in models.recognise(df, "item", model, 2).orderBy("id").collect()] == ["A", "", "", "", "D"]


def test_clips_are_made_only_where_missing(spark):
    queue = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (1, 2, "abc"), (1, 3, "boom")], "track int, clip_no bigint, text string")

    def model():
        def call(text):
            if text == "boom":
                raise ValueError
            return len(text)

        return call

    done = spark.createDataFrame([(1, 0)], "track int, clip_no bigint")
    assert rows(models.make_clips(queue, model, done)) == [(1, 2, 3, True), (1, 3, None, False)]


def test_translation_job_reports_what_it_did(spark):
    cues = spark.createDataFrame([(1, i + 1, i * 1000, i * 1000 + 500, f"t{i}") for i in range(70)],
                                 "track int, line bigint, start_ms bigint, end_ms bigint, text string")
    merged, replies = jobs.translate(cues, stand_ins.translator, 30, attempts=2, hot=False)
    assert rows(replies, "batch", "blocks", "status", "attempts") == [(0, 30, "ok", 1), (1, 30, "failed", 2), (2, 10, "failed", 2)]
    texts = [r.text for r in merged.orderBy("line").collect()]
    assert texts[:2] == ["»0 t0", "»0 t1"] and texts[30] == "t30" and texts[69] == "t69"


def test_contexts_are_preloaded_or_put_into_messages(spark):
    df = spark.createDataFrame([(t, b, 1, "say {context_block}!", f"about {t}") for t in (1, 2) for b in (0, 1)],
                               "track int, batch bigint, blocks bigint, message string, context string")

    def model():
        class Echo:
            held = None

            def preload(self, context):
                self.held = context
                return context == "about 1"

            def __call__(self, message):
                return f"{message} {self.held}"

        return Echo()

    got = models.call_batches(df.coalesce(1), model)
    assert rows(got, "track", "reply") == [(1, "say ! about 1")] * 2 + [(2, "say about 2! about 2")] * 2
    assert [r.reply for r in models.call_batches(df.coalesce(1), lambda: str.upper).orderBy("track", "batch").collect()][0] == "SAY ABOUT 1!"


def _by_ranges(spark, tmp_path, size, make):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = srt.read_lines(spark, str(tmp_path / "*"))
        assert lines.select("track", "at.from").distinct().count() > 20
        return make(lines)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_srt_files_by_ranges_equal_whole_files(spark, tmp_path, hot):
    rnd = random.Random(3)
    for name, end in (("a.srt", "\n"), ("b.srt", "\r\n")):
        blocks = []
        for i in range(1, 120):
            text = rnd.choice(["one", "zwei — drei", "<i>x</i>" + end + "y", "漢字 " * 30, ""])
            blocks.append(f"{i if i % 9 else 'x'}{end}00:00:{i % 60:02d},100 --> 00:01:{i % 60:02d},200{end}{text}{end}")
            blocks.append(rnd.choice([end, end * 3, " \t" + end + "\u3000" + end]))
        (tmp_path / name).write_bytes((end + "  " + "".join(blocks) + end).encode())
    whole = rows(srt.blocks_to_cues(srt.read_texts(spark, str(tmp_path / "*"))))
    assert len(whole) > 100
    assert _by_ranges(spark, tmp_path, 500, lambda lines: rows(srt.blocks_to_cues(srt.block_ranges(lines)))) == whole
    bad = rows(srt.bad_blocks(srt.read_texts(spark, str(tmp_path / "*"))), "track", "block", "reason")
    assert _by_ranges(spark, tmp_path, 500, lambda lines: rows(srt.bad_blocks(srt.block_ranges(lines)), "track", "block", "reason")) == bad


def test_srt_blocks_by_ranges_are_cut_as_lines_come(spark, tmp_path):
    rnd = random.Random(5)
    lines, want = [], []
    for track in ("a", "b", "c", "d"):
        values = [rnd.choice(["", " ", "x", "y", "z"]) if track != "c" else "" for _ in range(300)]
        values[100:160] = ["long"] * 60
        values = values if track != "c" else [""] * 300
        edges = sorted(rnd.sample(range(1, 300), 12))
        for i, value in enumerate(values):
            part = max([0, *(e for e in edges if e <= i)])
            lines.append((track, (part * 10, 1000 * part + i), value))
        runs = "\n".join(v if v.strip() else "" for v in values).strip("\n")
        want += [(track, n, raw) for n, raw in enumerate(r for r in re.split("\n{2,}", runs) if r)]
    ranges = [list(g) for _, g in itertools.groupby(lines, key=lambda r: (r[0], r[1][0]))]
    rnd.shuffle(ranges)
    df = spark.createDataFrame([row for some in ranges for row in some], "track string, at struct<from: bigint, no: bigint>, value string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for tasks in (1, 5):
            blocks = srt.block_ranges(df.coalesce(tasks))
            assert rows(blocks, "track", "block", "raw") == sorted(want, key=repr)
            # Runs of lines are numbered, not lines.
            assert "Window" not in blocks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ass_files_by_ranges_equal_whole_files(spark, tmp_path, hot):
    text = "[Script Info]\r\nTitle: a\x1cb\r\n\r\n[V4+ Styles]\nStyle: x\n" + "[Events]\n" + "".join(f"Dialogue: {i},é\r\n" for i in range(900))
    (tmp_path / "a.ass").write_bytes(text.encode())
    whole = rows(ass.sections(srt.read_texts(spark, str(tmp_path / "*"))))
    assert len(whole) == 903
    assert _by_ranges(spark, tmp_path, 400, lambda lines: rows(ass.sections(lines))) == whole


class _Flaky:
    """Fails on some messages until a file is there."""

    def __init__(self, mark):
        self.mark = mark

    def __call__(self, message):
        import os

        if message.startswith("bad") and not os.path.exists(self.mark):
            raise RuntimeError("no answer")
        return message.upper()


def test_answered_messages_are_not_sent_again(spark, tmp_path):
    mark, ledger = str(tmp_path / "mark"), str(tmp_path / "ledger")
    texts = ["a", "b", "bad one", "a", "c", None, "bad two", "d"]
    df = spark.createDataFrame([(1, i, t, 1) for i, t in enumerate(texts) if t], "track bigint, batch bigint, message string, blocks bigint")

    def model():
        return _Flaky(mark)

    def run(rows_per_round):
        got = {r.batch: (r.status, r.reply) for r in models.call_once(df, model, ledger, rows_per_task=2, rows_per_round=rows_per_round).collect()}
        sent = spark.read.parquet(ledger).groupBy("run").count().collect()
        return got, {r["run"]: r["count"] for r in sent}

    got, sent = run(3)
    assert sent == {0: 6} and got[2] == ("failed", None) and got[0] == got[3] == ("ok", "A")
    open(mark, "w").close()
    got, sent = run(10)
    assert sent == {0: 6, 1: 2} and got[2] == ("ok", "BAD ONE") and all(s == "ok" for s, _ in got.values())
    assert run(10) == (got, sent)
    assert models.call_once(df.filter("false"), model, str(tmp_path / "none")).count() == 0


def test_rounds_read_their_own_messages_and_leave_few_files(spark, tmp_path, monkeypatch):
    df = spark.range(100).selectExpr("1L as track", "id as batch", "concat('m', id) as message", "1L as blocks")
    plans, send = [], models.call_batches
    monkeypatch.setattr(models, "call_batches", lambda own, *a, **k: plans.append(own._jdf.queryExecution().executedPlan().toString()) or send(own, *a, **k))
    ledger = str(tmp_path / "ledger")
    got = models.call_once(df, lambda: str.upper, ledger, rows_per_task=4, rows_per_round=25).collect()
    assert sorted(r.reply for r in got) == sorted(f"M{i}" for i in range(100))
    assert len(plans) == 4 and all("PartitionFilters: [isnotnull(_round" in p for p in plans)
    assert len(list((tmp_path / "ledger").glob("*.parquet"))) <= 4


class _Noting:
    """Notes what it is sent in a file, and ends the worker at one message."""

    def __init__(self, notes, deadly):
        self.notes, self.deadly = notes, deadly

    def __call__(self, message):
        import os

        with open(self.notes, "a") as notes:
            notes.write(f"{message}\n")
        if message == self.deadly:
            os._exit(1)
        return None if message == "m0" else message.upper()


def test_a_lost_task_sends_few_messages_again(spark, tmp_path):
    notes, kept = str(tmp_path / "notes"), str(tmp_path / "kept")
    df = spark.range(20).selectExpr("1L as track", "id as batch", "concat('m', id) as message", "1L as blocks", "concat('k', id) as message_key")

    def run(deadly):
        called = models.call_batches(df.coalesce(1), lambda: _Noting(notes, deadly), attempts=1, kept=kept, kept_rows=4)
        return sorted((r.message_key, r.reply, r.status) for r in called.collect())

    with pytest.raises(Exception, match="exited|crashed"):
        run("m10")
    # What the lost task was writing when it was lost is cut off.
    (part,) = tmp_path.glob("kept/*/*")
    (part.parent / "cut").write_bytes(part.read_bytes()[:-100])
    (part.parent / "empty").write_bytes(b"")
    expected = sorted((f"k{i}", f"M{i}" if i else None, "ok" if i else "failed") for i in range(20))
    assert run(None) == expected
    sent = open(notes).read().split()
    assert sent == [f"m{i}" for i in (*range(11), *range(8, 20))]
    assert run(None) == expected and open(notes).read().split() == sent


@pytest.mark.parametrize("mounted", [True, False])
def test_a_round_takes_few_tasks_where_they_keep_replies(spark, tmp_path, monkeypatch, mounted):
    df = spark.range(600).selectExpr("id % 7 as track", "id as batch", "concat('m', id % 500) as message", "1L as blocks")
    tasks, send = [], models.call_batches

    def call(own, *args, **named):
        called = send(own, *args, **named)
        tasks.append(called.rdd.getNumPartitions())
        return called

    monkeypatch.setattr(models, "call_batches", call)
    if not mounted:
        monkeypatch.setattr(models, "mounted", lambda *_: None)
    ledger, before = str(tmp_path / "ledger"), written_paths(spark)
    for _ in range(2):
        got = models.call_once(df, lambda: str.upper, ledger, rows_per_task=1, rows_per_round=250).collect()
        assert sorted(r.reply for r in got) == sorted(f"M{i % 500}" for i in range(600))
    most = 4 * spark.sparkContext.defaultParallelism
    assert tasks == [most if mounted else 250] * 2
    assert spark.read.parquet(ledger).count() == 500 and len(list((tmp_path / "ledger").glob("*.parquet"))) == 2
    assert written_paths(spark) == before and not list(Path(shared_dir(spark).removeprefix("file:")).glob("cuespan-*/[0-9]*"))


def test_texts_become_values_a_slice_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"a": ["x" * 400] * 10 + [None, "y" * 5000], "b": ["z" * 600] * 12})
    parts = list(slices(batch, batch.column(0), batch.column(1), most_bytes=2000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) <= 3 and parts[-1].num_rows <= 2

    cues = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 500, f"text {i}") for i in range(1, 40)],
                                 "track bigint, line bigint, start_ms bigint, end_ms bigint, text string")
    # The whole text goes to the model with each batch of its track, and is not written with each reply.
    _, replies = jobs.translate(cues, stand_ins.translator, 10, "{context_block}" + stand_ins.PARTED + "{batch_input}", full_context="{text}", hot=False)
    assert "context" not in replies.columns and replies.count() == 4
