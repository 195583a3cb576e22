"""Figures and texts per track. Sums are reduced before the shuffle; texts are joined in
parts of a bounded number of rows, so that no track becomes one huge value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import stamps, text as rules

PART_ROWS = 1000


def track_statistics(cues: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Count, lengths and characters per track. With ``tracks``, those without cues get
    zeros, and no smallest or largest length."""
    length, chars = F.col("end_ms") - F.col("start_ms"), F.length("text")
    figures = cues.groupBy("track").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(length).alias("total_ms"),
        F.sum(chars).alias("total_chars"),
        F.avg(length).alias("avg_ms"),
        F.avg(chars).alias("avg_chars"),
        F.min(length).alias("min_ms"),
        F.max(length).alias("max_ms"),
    )
    if tracks is None:
        return figures
    return tracks.select("track").distinct().join(figures, "track", "left").fillna(
        0, ["entries", "total_ms", "total_chars", "avg_ms", "avg_chars"]
    )


def in_parts(
    rows: DataFrame, text: Column, order=("line",), sep: str = "\n", part_rows: int = PART_ROWS, hot: bool | None = None
) -> DataFrame:
    """Join texts along each track: ``track, part, text``, parts of ``part_rows`` rows. The
    parts of a track joined by ``sep`` are the whole text."""
    placed = seq.extend(rows.withColumn("_text", text), order, {"_no": seq.position()}, hot=hot)
    ordered = F.array_sort(F.collect_list(F.struct("_no", "_text")))
    return placed.groupBy("track", F.floor((F.col("_no") - 1) / part_rows).alias("part")).agg(
        F.array_join(F.transform(ordered, lambda s: s["_text"]), sep).alias("text")
    )


def full_text(rows: DataFrame, order=("line",), part_rows: int = PART_ROWS, hot: bool | None = None) -> DataFrame:
    """All texts of a track, one per line."""
    return in_parts(rows, F.col("text"), order, "\n", part_rows, hot)


def transcript(
    cues: DataFrame, spaced: bool = True, full: DataFrame | None = None, order=("line",),
    part_rows: int = PART_ROWS, hot: bool | None = None,
) -> DataFrame:
    """Running text of each track: the given full text (``track, full_text``) where there is
    one, else its cues joined, with blanks collapsed where words are spaced."""
    sep = " " if spaced else ""
    told = cues.filter("text <> ''")
    parts = in_parts(told, rules.strip("text"), order, sep, part_rows, hot)
    if spaced:
        parts = parts.withColumn("text", rules.strip(F.regexp_replace("text", r"(?U)\s+", " ")))
    if full is None:
        return parts
    given = full.filter("full_text <> ''").select(
        "track", F.lit(0).cast("bigint").alias("part"), rules.strip("full_text").alias("text")
    )
    return parts.join(given, "track", "left_anti").unionByName(given)


def segment_totals(segments: DataFrame) -> DataFrame:
    """Summed length of segments; overlaps count twice."""
    return segments.groupBy("track").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms")
    )


def run_totals(frames: DataFrame) -> DataFrame:
    """Per track: all frames, those sampled, and those handed to the recogniser.
    ``frames``: ``track`` and flags ``sampled, called``."""
    return frames.groupBy("track").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("sampled").alias("processed"),
        F.count_if("called").alias("calls"),
    )


def box_totals(frames: DataFrame, judged: DataFrame) -> DataFrame:
    """Per track and box: the track's frames, those in which the box was looked at, and those handed to the recogniser.
    ``judged``: ``track, box`` and flags ``changed, passed``, one row per sampled frame and box."""
    all_frames = frames.groupBy("track").agg(F.count(F.lit(1)).alias("frames"))
    looked = judged.groupBy("track", "box").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("changed") & F.col("passed")).alias("calls"))
    return looked.join(all_frames, "track").select("track", "box", "frames", "processed", "calls")


def outcome_counts(rows: DataFrame, ok: Column, by=("track",)) -> DataFrame:
    """How many rows went well and how many did not."""
    return rows.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("err"))


def batch_report(batches: DataFrame) -> DataFrame:
    """Blocks, batches, and how many batches succeeded or failed, per track.
    ``batches``: ``track, batch, blocks, status``."""
    return batches.groupBy("track").agg(
        F.sum("blocks").alias("total_blocks"),
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(F.col("status") == "ok").alias("success"),
        F.count_if(F.col("status") != "ok").alias("failed"),
    )


def clock_range(start="start_ms", end="end_ms") -> Column:
    return F.concat(stamps.ms_to_clock(start), F.lit(" --> "), stamps.ms_to_clock(end))


def own_context(cues: DataFrame, template: str = "{text}") -> DataFrame:
    """``(track, context)``: each track's whole text, line by line, put into a template that holds ``{text}``."""
    ordered = F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text"))))
    told = F.array_join(F.transform(ordered, lambda s: s["text"]), "\n")
    return cues.groupBy("track").agg(told.alias("_text")).select(
        "track", F.replace(F.lit(template), F.lit("{text}"), F.col("_text")).alias("context"))


def batch_messages(
    batched: DataFrame, template: str = "{batch_input}", context: str = "", contexts: DataFrame | None = None
) -> DataFrame:
    """One message per batch: line, time and text of its cues, put into a template that may
    hold ``{batch_input}`` and ``{context_block}``. ``batched`` has ``batch, pos, time``.

    The context is one for all, or each track's own out of ``contexts`` (``track, context``). Then it comes as a
    column of its own, for ``call_batches`` to put in its place.
    """
    block = F.concat_ws("\n", F.col("line").cast("string"), "time", rules.strip("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), block.alias("block"))))
    joined = batched.groupBy("track", "batch").agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("_input"),
        F.count(F.lit(1)).alias("blocks"),
    )
    filled = F.replace(F.lit(template), F.lit("{batch_input}"), F.col("_input"))
    if contexts is not None:
        own = joined.join(contexts.select("track", "context"), "track", "left")
        return own.select("track", "batch", "blocks", filled.alias("message"), "context")
    filled = F.replace(filled, F.lit("{context_block}"), F.lit(context))
    return joined.select("track", "batch", "blocks", filled.alias("message"))


def quiet_edges(
    series: DataFrame, lengths: DataFrame, level: float, min_quiet_ms: int = 100, pad_ms: int = 30,
    tie: str = "event_id", hot: bool | None = None,
) -> DataFrame:
    """Where to trim quiet ends of each track: ``keep_from_ms, keep_to_ms, removed_ms``.

    A sample holds until the next one. Quiet at an end is cut if it lasts ``min_quiet_ms``,
    but for ``pad_ms``; a track that is quiet throughout is left whole. ``lengths``:
    ``track, length_ms``.
    """
    near = seq.extend(series, ["at_ms", tie], {"_next": seq.following("at_ms")}, hot=hot)
    loud = F.col("value") >= F.lit(float(level))
    edges = near.groupBy("track").agg(
        F.min(F.when(loud, F.col("at_ms"))).alias("_first"),
        F.max(F.when(loud, F.struct("at_ms", F.col(tie).alias("tie"), F.col("_next").alias("next")))).alias("_last"),
    )
    with_length = edges.join(lengths, "track")
    first, length = F.col("_first"), F.col("length_ms")
    over = F.coalesce(F.col("_last.next"), length)
    begin = F.when(first >= min_quiet_ms, F.greatest(F.lit(0), first - pad_ms)).otherwise(F.lit(0))
    end = F.when(length - over >= min_quiet_ms, F.least(length, over + pad_ms)).otherwise(length)
    begin = F.when(first.isNull(), F.lit(0)).otherwise(begin).cast("bigint")
    end = F.when(first.isNull(), length).otherwise(end)
    return with_length.select(
        "track", begin.alias("keep_from_ms"), end.alias("keep_to_ms"), (length - (end - begin)).alias("removed_ms")
    )


def drift_audit(
    timeline: DataFrame, fps: float | str = 30.0, tolerance_frames: int = 3, batch_size: int = 100, hot: bool | None = None
) -> DataFrame:
    """One row per track on how far a timeline strays from the frames a cutter would make:
    total drift, starts that do not rise, seams that are not contiguous, steps from one frame to the next that
    are more than half a frame off, worst batch, verdict. Within a segment frames follow each other evenly, so
    steps are judged where segments meet."""
    if hot is None:
        hot = seq.too_long(timeline)
    rate = stamps.rate(fps)
    frame_ms = F.lit(1000.0) / rate
    should = stamps.realised_frames(F.col("orig_end") - F.col("orig_start"), "video_speed", fps)
    has = F.rint(F.col("new_chunk_dur") / 1000.0 * rate)
    near = seq.extend(
        timeline, ["seg_no"],
        {"_no": seq.position(), "_start": seq.prev("new_start"), "_end": seq.prev("new_end"), "_frames": seq.prev(should)}, hot=hot,
    )
    off_step = F.abs(F.col("new_start") - F.col("_start") - F.col("_frames") * frame_ms)
    near = near.withColumn("_rate", rate)
    batches = near.groupBy("track", F.floor((F.col("_no") - 1) / batch_size).alias("_batch")).agg(
        F.count(F.lit(1)).alias("segments"), F.max("_rate").alias("_rate"),
        F.sum(should).alias("_should"),
        F.sum(has).alias("_has"),
        F.count_if((F.col("new_start") <= F.col("_start")) & (F.col("new_chunk_dur") > 0)).alias("not_rising"),
        F.count_if(F.abs(F.col("new_start") - F.col("_end")) > frame_ms * 0.5).alias("seams"),
        F.count_if(off_step > frame_ms * 0.5).alias("uneven_steps"),
        F.coalesce(F.max(off_step), F.lit(0.0)).alias("worst_step_ms"),
    )
    off = F.abs(F.col("_has") - F.col("_should"))
    summed = batches.groupBy("track").agg(
        F.sum("segments").alias("segments"), F.max("_rate").alias("_rate"),
        F.sum("_should").cast("bigint").alias("expected_frames"),
        F.sum("_has").cast("bigint").alias("actual_frames"),
        F.sum("not_rising").alias("not_rising"),
        F.sum("seams").alias("seams"),
        F.sum("uneven_steps").alias("uneven_steps"), F.max("worst_step_ms").alias("worst_step_ms"),
        F.max(off).cast("bigint").alias("worst_batch_frames"),
    )
    total = F.abs(F.col("actual_frames") - F.col("expected_frames"))
    good = (
        (total <= tolerance_frames) & (F.col("not_rising") == 0) & (F.col("seams") == 0)
        & (F.col("uneven_steps") == 0) & (F.col("worst_batch_frames") <= tolerance_frames)
    )
    return summed.withColumns(
        {
            "drift_frames": total,
            "drift_ms": total / F.col("_rate") * 1000.0,
            "verdict": F.when(good, "PASS").otherwise("FAIL"),
        }
    ).drop("_rate")
