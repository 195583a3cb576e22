"""Queries that run as streams over the table files, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.operators import frames
from cuespan.plans.registry import query
from cuespan.plans.views import Views
from cuespan.streaming import folds, passes


def _cue_stream(v: Views) -> DataFrame:
    """Events as cues on the absolute axis: a stream does not know a track's first event. The table's files are in no order of
    time, so they come at once."""
    events = folds.file_stream(v.spark, f"{v.sf_dir}/events.parquet", files_per_batch=None)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    start = F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) / 1000)
    length = F.greatest(F.lit(1), (F.col("value") * 600000).cast("bigint"))
    return events.select(
        F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("line"),
        start.alias("start_ms"), (start + length).alias("end_ms"), F.col("event_type").alias("text"),
    )


@query
def streamed_changes(v: Views) -> DataFrame:
    """Four files of frames in the order of time, whatever files the table has."""
    folder = folds.stored_in_parts(v.table("embeddings"), "vec_id", 4)
    images = folds.file_stream(v.spark, folder).select(
        F.col("label").cast("bigint").alias("track"), F.timestamp_millis(F.col("vec_id") * 100 + 1000).alias("ts"),
        (F.col("vec_id") / 10.0).alias("at_s"), frames.sign_hash("embedding").alias("hash"),
        frames.active_enough("embedding", 0.25, 0.03).alias("passed"),
    )
    cues = folds.latest(folds.run_to_end(passes.stream_changes(images, max_distance=30)))
    return cues.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query
def streamed_box_changes(v: Views) -> DataFrame:
    """Four files of frames, one in each micro-batch, against the table of boxes."""
    folder = folds.stored_in_parts(v.table("embeddings"), "vec_id", 4)
    images = folds.file_stream(v.spark, folder).select(
        F.col("label").cast("bigint").alias("track"), F.timestamp_millis(F.col("vec_id") * 100 + 1000).alias("ts"),
        (F.col("vec_id") / 10.0).alias("at_s"), "embedding")
    cues = passes.stream_box_changes(images, v.boxes(), v.grids(), "embedding", max_distance=2, min_frames=5, delay="10 seconds")
    return folds.latest(folds.run_to_end(cues), frames.BOX).withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query
def streamed_batches(v: Views) -> DataFrame:
    return folds.latest(folds.run_to_end(passes.stream_batches(_cue_stream(v), 86_400_000)))


@query
def streamed_merges(v: Views) -> DataFrame:
    return folds.latest(folds.run_to_end(passes.stream_merges(_cue_stream(v), 500)))
