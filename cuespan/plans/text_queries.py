"""Queries on text rules, stamps, frames and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions import stamps, text as rules
from cuespan.operators import aggregates, frames
from cuespan.plans.registry import query
from cuespan.plans.views import Views

# The tables hold no Han text: accented Latin letters stand for the script to keep.
ACCENTED = r"\x{c0}-\x{ff}"
MARKS = r".,;:!?"


def _documents(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "text")


@query
def script_extraction(v: Views) -> DataFrame:
    return _documents(v).select("doc_id", rules.script_text("text", ACCENTED, MARKS).alias("s")).select("doc_id", "s.*")


@query
def script_count_filter(v: Views) -> DataFrame:
    kept = v.lines().withColumn("kept", rules.script_or_null("text", ACCENTED, MARKS, 5))
    return kept.filter("kept is not null").select("track", "line", "kept")


@query
def script_ratio_filter(v: Views) -> DataFrame:
    rated = v.lines().withColumns(
        {"ratio": rules.script_ratio("text", ACCENTED), "kept": rules.script_or_null("text", ACCENTED, MARKS, 2)}
    )
    return rated.filter("ratio >= 0.05 and kept is not null").select("track", "line", F.round("ratio", 9).alias("ratio"), "kept")


@query
def script_runs_with_context(v: Views) -> DataFrame:
    runs = v.lines().select("track", "line", F.explode(rules.script_runs("text", ACCENTED, 5)).alias("r"))
    return runs.select(
        "track", "line", F.col("r.run").alias("run"), F.col("r.start").alias("start_at"), F.col("r.end").alias("end_at"),
        F.col("r.context").alias("context"),
    )


def _replies(v: Views) -> DataFrame:
    """Lines as a recogniser might return them, junk included."""
    first = F.substring("text", 1, 1)
    k = F.col("track") % 7
    reply = (
        F.when(k == 1, first).when(k == 2, F.lit(" None\n")).when(k == 3, F.concat("text", F.lit(" https://x.example/y")))
        .when(k == 4, F.col("line").cast("string")).when(k == 5, F.repeat(first, F.col("line").cast("int")))
        .when(k == 6, F.concat(F.col("line").cast("string"), F.lit("\n"), F.col("track").cast("string")))
        .otherwise(F.col("text"))
    )
    return v.lines().withColumn("text", reply)


@query
def junk_filter(v: Views) -> DataFrame:
    return _replies(v).select(
        "track", "line", rules.reject_reason("text").alias("reason"), rules.without_junk("text").alias("kept")
    )


@query
def junk_filter_lenient(v: Views) -> DataFrame:
    judged = _replies(v).select("track", "line", rules.reject_reason("text", strict=False).alias("reason"))
    return judged.filter("reason is not null")


@query
def reasoning_removed(v: Views) -> DataFrame:
    thought = F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), F.col("text"))
    marked = F.concat(F.lit("<|ref|>"), F.col("role"), F.lit("<|/ref|><|det|>[[1, 2]]<|/det|>"), "text")
    return v.turns().select(
        "conv_id", "turn", rules.without_thinking(thought).alias("spoken"), rules.without_references(marked).alias("bare")
    )


@query
def tagged_payload(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", rules.tagged_payload("html", "title").alias("title"))


@query
def inline_tags_removed(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", rules.without_tags("html").alias("html"))


@query
def latin_warnings(v: Views) -> DataFrame:
    found = v.lines().filter(rules.has_latin_or_digit("text"))
    return found.groupBy("track").agg(F.count(F.lit(1)).alias("warnings"))


@query
def stamp_conversions(v: Views) -> DataFrame:
    clock = stamps.ms_to_clock("start_ms")
    return v.cues().select(
        "track", "line",
        clock.alias("clock"),
        stamps.clock_to_ms(clock).alias("back_ms"),
        stamps.ms_to_centi("start_ms").alias("centi"),
        stamps.clock_to_centi(clock).alias("clock_centi"),
        stamps.centi_to_clock(stamps.ms_to_centi("start_ms")).alias("centi_clock"),
        stamps.centi_to_ms(stamps.ms_to_centi("start_ms")).alias("centi_ms"),
        stamps.seconds_to_clock(F.col("start_ms") / 1000.0 - 5.0).alias("seconds_clock"),
    )


@query
def tolerant_stamps(v: Views) -> DataFrame:
    """Stamps of two, three and four parts, readable or not."""
    k = F.col("event_id") % 5
    clock = stamps.ms_to_clock("start_ms")
    raw = (
        F.when(k == 0, clock).when(k == 1, F.substring(clock, -9, 9)).when(k == 2, F.concat(clock, F.lit(":x")))
        .when(k == 3, F.replace(clock, F.lit(":"), F.lit("-"))).otherwise(F.replace(clock, F.lit(","), F.lit(".")))
    )
    rows = v.cues().select("track", "line", raw.alias("raw"))
    return rows.select(
        "track", "line", "raw",
        F.round(stamps.tolerant_seconds("raw"), 6).alias("tolerant_s"),
        F.round(stamps.flexible_seconds("raw"), 6).alias("flexible_s"),
    )


@query
def scaled_times(v: Views) -> DataFrame:
    start, end = stamps.scaled("start_ms", 0.65), stamps.scaled("end_ms", 0.65)
    return v.cues().select(
        "track", "line", start.alias("start_ms"), F.when(end <= start, start + 1).otherwise(end).alias("end_ms")
    )


@query
def padded_windows(v: Views) -> DataFrame:
    w = stamps.padded_window("start_ms", "end_ms", 0.5)
    return v.mutes().select("track", "line", w.alias("w")).select(
        "track", "line", *[F.round(f"w.{c}", 6).alias(c) for c in ("left_pad_s", "from_s", "to_s")]
    )


@query
def hard_wrapped(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id", rules.hard_wrap(rules.newline_to_break("text"), 14).alias("wrapped")
    )


@query
def soft_wrapped(v: Views) -> DataFrame:
    return v.lines().select("track", "line", rules.soft_wrap("text", 40).alias("wrapped"))


@query
def broken_near(v: Views) -> DataFrame:
    return v.lines().select("track", "line", rules.break_near("text", 30).alias("broken"))


@query
def cjk_flags(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id", rules.is_cjk("text").alias("cjk_text"), rules.is_cjk_language("lang").alias("cjk_language")
    )


@query
def sampled_frames(v: Views) -> DataFrame:
    return frames.every_nth(v.frames().select("track", "frame_no"), 3).withColumn("ts_s", F.round("ts_s", 6))


@query
def evenly_spaced_frames(v: Views) -> DataFrame:
    return frames.evenly_spaced(v.frames().select("track", "frame_no"), 16)


@query
def clamped_boxes(v: Views) -> DataFrame:
    boxes = v.table("part").select(
        "p_partkey", F.col("p_brand").alias("source"), (F.col("p_size") * 41 - 300).cast("bigint").alias("x"),
        (F.col("p_partkey") % 1200 - 60).alias("y"), (F.col("p_partkey") % 700).alias("w"), (F.col("p_size") * 3).cast("bigint").alias("h"),
    )
    # Frames of each source have a size of their own.
    sizes = v.table("part").groupBy(F.col("p_brand").alias("source")).agg(
        (F.min("p_partkey") + 600).alias("width"), (F.max("p_size") * 9).cast("bigint").alias("height"))
    return frames.clamped_boxes(boxes, sizes).select("p_partkey", "x1", "y1", "x2", "y2", "valid")


@query
def active_frames(v: Views) -> DataFrame:
    return v.table("embeddings").select("vec_id", frames.active_enough("embedding", 0.25, 0.03).alias("active"))


@query
def frame_changes(v: Views) -> DataFrame:
    changed = frames.changes(v.frames().select("track", "frame_no", "hash"), 30, hot=v.hot_frames)
    return changed.select("track", "frame_no", "distance", "changed")


@query
def cell_changes(v: Views) -> DataFrame:
    changed = frames.cell_changes(v.frames().select("track", "frame_no", "embedding"), "embedding", 0.2, 20.0, hot=v.hot_frames)
    return changed.select("track", "frame_no", "changed")


def _flagged(v: Views) -> DataFrame:
    changed = frames.changes(v.frames(), 30, hot=v.hot_frames)
    return changed.select(
        "track", "frame_no", (F.col("frame_no") / 10.0).alias("ts_s"), "changed",
        frames.active_enough("embedding", 0.25, 0.03).alias("passed"),
    )


@query
def change_cues(v: Views) -> DataFrame:
    cues = frames.change_cues(_flagged(v), hot=v.hot_frames)
    return cues.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query
def debounced_changes(v: Views) -> DataFrame:
    return frames.debounced(_flagged(v), 5, hot=v.hot_frames).select("track", "frame_no", "changed")


@query
def run_totals(v: Views) -> DataFrame:
    judged = _flagged(v).select(
        "track", (F.col("frame_no") % 3 == 0).alias("sampled"),
        ((F.col("frame_no") % 3 == 0) & F.col("changed") & F.col("passed")).alias("called"),
    )
    return aggregates.run_totals(judged)


def _box_flags(v: Views) -> DataFrame:
    """Every other frame by the boxes of its track, on grids of 8 by 8."""
    sampled = frames.every_nth(v.frames().select("track", "frame_no", "embedding"), 2, 10.0)
    return frames.box_changes(frames.box_regions(sampled, v.boxes(), v.grids(), "embedding"), 2, 5, hot=v.hot_frames)


@query
def box_changes(v: Views) -> DataFrame:
    return _box_flags(v).select("track", "box", "frame_no", "distance", "changed", "passed")


@query
def box_cues(v: Views) -> DataFrame:
    cues = frames.change_cues(_box_flags(v), hot=v.hot_frames, keys=frames.BOX)
    return cues.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query
def box_totals(v: Views) -> DataFrame:
    return aggregates.box_totals(v.frames(), _box_flags(v))
