"""Streams in several micro-batches give what batch jobs give."""

import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from cuespan.folds import Fold
from cuespan.operators import frames, neighbours
from cuespan.plans.queries import QUERIES
from cuespan.streaming import folds, passes
from tests.conftest import rows

EVENTS = "track bigint, line bigint, start_ms bigint, end_ms bigint, text string"


def _stored(spark, tmp_path, df, order, files):
    """One file per stretch of time, in order."""
    edges = df.approxQuantile(order, [i / files for i in range(1, files)], 0.0)
    part = sum((F.col(order) > e).cast("int") for e in edges)
    for i in range(files):
        df.filter(part == i).coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
    names = []
    for i in range(files):
        for p in (tmp_path / f"s{i}").glob("part-*.parquet"):
            target = tmp_path / "in"
            target.mkdir(exist_ok=True)
            p.rename(target / f"{i}.parquet")
            names.append(i)
            import os
            os.utime(target / f"{i}.parquet", (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    assert len(names) == files
    return str(tmp_path / "in")


def _cues(spark):
    rnd = random.Random(6)
    data, at = [], [0, 0, 0]
    for i in range(300):
        t = rnd.choice([0, 0, 0, 1, 2])
        at[t] += rnd.randrange(100, 3000)
        data.append((t, i, at[t], at[t] + rnd.randrange(100, 2500), rnd.choice("aab")))
    return spark.createDataFrame(data, EVENTS).withColumn("ts", F.timestamp_millis("start_ms"))


def test_streamed_merges_and_batches(spark, tmp_path):
    cues = _cues(spark)
    folder = _stored(spark, tmp_path, cues, "start_ms", 4)
    stream = folds.file_stream(spark, folder)
    given = folds.run_to_end(passes.stream_merges(stream, 500))
    assert given.agg(F.max("version")).first()[0] > 1
    numbered = neighbours.batched(cues, 1_000_000, ("start_ms", "line"), hot=False).withColumn("line", F.col("pos") + 1)
    want = neighbours.merge_close(numbered.select(*cues.columns[:5]), 500, hot=False)
    columns = ["track", "line", "start_ms", "end_ms", "text"]
    assert rows(folds.latest(given), *columns) == rows(want, *columns)

    spans = folds.latest(folds.run_to_end(passes.stream_batches(stream, 60_000)))
    batches = neighbours.batch_spans(neighbours.time_batches(cues, 60_000, hot=False), hot=False)
    columns = ["track", "batch", "start_ms", "end_ms", "rows"]
    assert rows(spans, *columns) == rows(batches, *columns)


def test_streamed_changes(spark, tmp_path):
    rnd = random.Random(2)
    data = [(t, i, rnd.choice([0, 0, 255, 2**63 - 1, -1]), i / 10, rnd.random() < 0.8) for t in (1, 2) for i in range(80)]
    df = spark.createDataFrame(data, "track bigint, frame_no bigint, hash bigint, at_s double, passed boolean")
    df = df.withColumn("ts", F.timestamp_millis((F.col("at_s") * 1000).cast("bigint") + 1000))
    folder = _stored(spark, tmp_path, df, "at_s", 3)
    stream = folds.file_stream(spark, folder)
    got = folds.latest(folds.run_to_end(passes.stream_changes(stream, 4, min_frames=3)))
    changed = frames.debounced(frames.changes(df, 4, hot=False), 3, hot=False).withColumn("ts_s", F.col("at_s"))
    want = frames.change_cues(changed, hot=False)
    columns = ["track", "line", "frame_no", "start_s", "end_s"]
    assert rows(got, *columns) == rows(want, *columns)


def _files(tmp_path, parts):
    """Each part a file, to be read in this order."""
    import os

    (tmp_path / "in").mkdir()
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
        part = next((tmp_path / f"s{i}").glob("part-*.parquet"))
        target = tmp_path / "in" / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    return str(tmp_path / "in")


def test_rows_in_any_order_within_the_delay(spark, tmp_path):
    cues = _cues(spark).cache()
    part = F.pmod(F.xxhash64("line"), F.lit(5))
    folder = _files(tmp_path, [cues.filter(part == i) for i in range(5)])
    stream = folds.file_stream(spark, folder)
    got = folds.latest(folds.run_to_end(passes.stream_merges(stream, 500, delay="2 hours")))
    numbered = neighbours.batched(cues, 1_000_000, ("start_ms", "line"), hot=False).withColumn("line", F.col("pos") + 1)
    want = neighbours.merge_close(numbered.select(*cues.columns[:5]), 500, hot=False)
    columns = ["track", "line", "start_ms", "end_ms", "text"]
    assert rows(got, *columns) == rows(want, *columns)


def _at(spark, *rows_):
    return spark.createDataFrame([(1, s, s, s + 100, t) for s, t in rows_], EVENTS).withColumn("ts", F.timestamp_millis("start_ms"))


def test_rows_older_than_the_watermark_are_left_out(spark, tmp_path):
    parts = [_at(spark, (5_000, "a"), (100_000, "b")), _at(spark, (99_500, "b"), (200_000, "c")), _at(spark, (6_000, "x"), (201_000, "c"))]
    stream = folds.file_stream(spark, _files(tmp_path, parts))
    given = folds.run_to_end(passes.stream_merges(stream, 5000, delay="10 seconds"))
    assert rows(folds.latest(given)) == [(1, 1, 5_000, 5_100, "a"), (1, 2, 99_500, 100_100, "b"), (1, 3, 200_000, 201_100, "c")]
    settled = given.filter("settled")
    assert settled.count() == settled.select("line").distinct().count() == 1


def test_idle_tracks_are_settled_and_forgotten(spark, tmp_path):
    parts = [_at(spark, (5_000, "a")), _at(spark, (900_000, "z")).withColumn("track", F.lit(2).cast("bigint")),
             _at(spark, (901_000, "z")).withColumn("track", F.lit(2).cast("bigint"))]
    stream = folds.file_stream(spark, _files(tmp_path, parts))
    given = folds.run_to_end(passes.stream_merges(stream, 5000, delay="10 seconds", idle_ms=60_000))
    assert rows(given.filter("settled"), "track", "line", "text") == [(1, 1, "a")]


def test_tables_whose_files_are_in_no_order_of_time(spark, tmp_path):
    """The newest rows come in the oldest file; none is late."""
    source, folder = "/root/testdata/sf0.001", tmp_path / "sf"
    for name, by in (("embeddings", "vec_id"), ("events", "ts")):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "embeddings":  # frames of 25 minutes
            table = table.unionByName(table.withColumn("vec_id", F.col("vec_id") + 15_000))
        edge = table.select(F.percentile_approx(F.col(by).cast("timestamp") if by == "ts" else F.col(by), 0.5).alias("m")).first()["m"]
        value = F.col(by).cast("timestamp") if by == "ts" else F.col(by)
        for part in (value > F.lit(edge), value <= F.lit(edge)):
            table.filter(part).coalesce(1).write.mode("append").parquet(str(folder / f"{name}.parquet"))
        table.coalesce(1).write.parquet(str(tmp_path / "one" / f"{name}.parquet"))
    for query in ("streamed_changes", "streamed_merges", "streamed_batches"):
        got, want = (QUERIES[query](spark, str(f)) for f in (folder, tmp_path / "one"))
        assert rows(got) == rows(want)
        assert got.count() > 0


class _Echo(Fold):
    """Gives each row as it is."""

    def fresh(self):
        return 0

    def step(self, state, row):
        return state + 1, [row]


def test_values_go_through_a_stream_as_they_are(spark, tmp_path):
    texts = ["a", None, "  \"q\" \\ \x01 漢😀", ""] * 200
    data = [(1, i, x, [0.5, None, x or 1.0], bool(i % 3), t, 2**62 + i) for i, (x, t) in enumerate(zip([0.1, float("inf"), None, -1e300] * 200, texts))]
    df = spark.createDataFrame(data, "track bigint, i bigint, x double, xs array<double>, b boolean, t string, n bigint")
    df = df.withColumn("ts", F.timestamp_millis(F.col("i") * 1000 + 1000))
    stream = folds.file_stream(spark, _stored(spark, tmp_path, df, "i", 2))
    names = ["i", "x", "xs", "b", "t", "n"]
    made = folds.stream_fold(stream, _Echo(), names, ["i"], "i bigint, x double, xs array<double>, b boolean, t string, n bigint", delay="10 seconds")
    assert rows(folds.latest(folds.run_to_end(made)), *names) == rows(df, *names)


def test_a_short_track_takes_few_calls_of_the_state():
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    class Handle:
        def getValueState(self, *_):
            return State()

        def getListState(self, *_):
            return State()

        def registerTimer(self, *_):
            calls.append("registerTimer")

    class Water:
        def getCurrentWatermarkInMs(self):
            return 0

    fold = folds._FoldProcessor(_Echo(), ["x"], ["i"], ["x"], None, ["track"], ["x", "i"], ["x"])
    fold.init(Handle())
    told = [(1, datetime(2024, 1, 1, 0, 0, i), f'{{"0":{i}.5,"1":{i}}}') for i in (2, 0, 1)]
    (out,) = fold.handleInputRows((1,), iter(told), Water())
    assert calls == ["get", "update", "registerTimer"]
    assert [r["x"] for r in json.loads(out["_made"])] == [0.5, 1.5, 2.5] and (out["track"], out["version"], out["late"]) == (1, 1, 0)
