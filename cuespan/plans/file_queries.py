"""Queries on subtitle texts, other inputs and outputs, model hooks, and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.functions import stamps, text as rules
from cuespan.operators import aggregates, frames, intervals, models, neighbours
from cuespan.plans import jobs, stand_ins
from cuespan.plans.layout_queries import FPS, rounded
from cuespan.plans.registry import query
from cuespan.plans.views import Views
from cuespan.session import shared_dir, written
from cuespan.sources import ass, files, srt

PART_ROWS = 40


@query
def srt_write(v: Views) -> DataFrame:
    return srt.srt_parts(v.cues(), part_rows=PART_ROWS, hot=v.hot)


@query
def srt_write_untimed(v: Views) -> DataFrame:
    """Without texts."""
    return srt.srt_parts(v.mutes(), with_text=False, part_rows=PART_ROWS, hot=v.hot)


def _spoiled(v: Views, twice: bool = False) -> DataFrame:
    """SRT texts of 40 cues, every few blocks of which cannot be used. ``twice`` adds blocks with two arrows."""
    k = F.col("event_id") % 20
    number = F.when(k == 1, F.lit("x")).otherwise(F.col("line").cast("string"))
    arrow = F.when(k == 2, F.lit(" -> ")).otherwise(F.lit(" --> "))
    start = F.when(k == 3, F.lit("00:bad:00,000")).otherwise(stamps.ms_to_clock("start_ms"))
    end = F.when(k == 4, F.lit("00:00:00,000")).otherwise(stamps.ms_to_clock("end_ms"))
    if twice:
        end = F.when(k == 7, F.concat(end, F.lit(" --> 00:00:09,000"))).otherwise(end)
    body = (
        F.when(k == 5, F.lit("<i></i>")).when(k == 6, F.concat(F.lit("<b>"), "text", F.lit("</b>\r\n<i>two</i>")))
        .otherwise(F.col("text"))
    )
    block = F.concat(number, F.lit("\n"), start, arrow, end, F.lit("\n"), body)
    return aggregates.in_parts(
        v.cues().select("track", "line", block.alias("b")), F.col("b"), ("line",), "\n\n", PART_ROWS, v.hot
    ).withColumnRenamed("text", "content")


@query
def srt_parse(v: Views) -> DataFrame:
    return srt.blocks_to_cues(_spoiled(v), ["track", "part"]).drop("part")


@query
def srt_by_ranges(v: Views) -> DataFrame:
    """All cues written to files of many tracks each, which are read back by byte ranges."""
    cues = v.cues().select("track", "line", "start_ms", "end_ms", F.concat(F.col("track").cast("string"), F.lit(": "), "text").alias("text"))
    folder = f"{shared_dir(v.spark)}/cuespan-srt-{uuid.uuid4().hex}"
    block = F.concat_ws("\n", F.col("line").cast("string"), aggregates.clock_range(), "text", F.lit(""))
    cues.repartitionByRange("track", "line").sortWithinPartitions("track", "line").select(block.alias("value")).write.text(folder)
    return srt.read_srt(v.spark, folder, by_ranges=True).select("line", "start_ms", "end_ms", "text")


@query
def srt_rejects(v: Views) -> DataFrame:
    return srt.bad_blocks(_spoiled(v), ["track", "part"]).drop("raw")


@query
def srt_parse_strict(v: Views) -> DataFrame:
    return rounded(srt.read_strict(_spoiled(v, twice=True), ["track", "part"]).drop("part"))


HEADER = {"ScriptType": "v4.00+", "PlayResX": "1920"}
STYLES = ["Style: NoteStyle,Sans,60,&H00000000"]
EVENTS = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


@query
def ass_render(v: Views) -> DataFrame:
    cues = v.cues()
    return cues.select("track", "line", ass.rendered(cues, 14).alias("value"))


def _ass_texts(v: Views) -> DataFrame:
    """ASS texts of 40 cues each; the track is the text's name."""
    cues = v.cues().withColumn("text", F.concat("text", F.lit(", "), "kind"))
    rendered = cues.select("track", "line", ass.rendered(cues, 14).alias("value"))
    parts = aggregates.in_parts(rendered, F.col("value"), ("line",), "\n", PART_ROWS, v.hot)
    content = F.concat(F.lit(ass.header_text(HEADER, STYLES, EVENTS) + "\n"), "text")
    return parts.select(F.concat_ws("/", "track", "part").alias("track"), content.alias("content"))


def _ass_lines(v: Views) -> DataFrame:
    return ass.sections(_ass_texts(v))


@query
def ass_dialogues(v: Views) -> DataFrame:
    return ass.dialogues(_ass_lines(v)).select(
        "track", "line_no", "layer", "start", "end", "style", "text", "complete", "start_ms", "end_ms"
    )


@query
def ass_headers(v: Views) -> DataFrame:
    head = ass.headers(_ass_lines(v))
    return head.select(
        "track", F.col("script_info").getItem("ScriptType").alias("script_type"),
        F.size("script_info").cast("bigint").alias("entries"), F.array_join("styles", "|").alias("styles"), "events_format",
    )


@query
def ass_scaled(v: Views) -> DataFrame:
    return ass.scaled(ass.dialogues(_ass_lines(v)), 1.5).select("track", "line_no", "value")


@query
def ass_scaled_files(v: Views) -> DataFrame:
    """Whole files at another speed, headers included."""
    texts = _ass_texts(v)
    return ass.with_all_lines(texts, ass.scaled(ass.dialogues(ass.sections(texts)), 1.5))


@query
def ass_retimed(v: Views) -> DataFrame:
    """Dialogues on the dubbed timeline of the track they belong to."""
    timeline = v.timeline(FPS)
    cues = v.cues()
    rendered = cues.select(
        "track", F.col("line").alias("line_no"), F.lit("events").alias("section"),
        ass.rendered(cues, 14).alias("value"),
    )
    return ass.retimed(ass.dialogues(rendered), timeline, 15, FPS, hot=v.hot)


@query
def stamped_text(v: Views) -> DataFrame:
    return aggregates.in_parts(v.cues(), srt.stamped_line(), ("line",), "\n", PART_ROWS, v.hot)


@query
def minified_text(v: Views) -> DataFrame:
    return aggregates.in_parts(srt.minified(v.lines()), F.col("text"), ("line",), "\n", PART_ROWS, False)


@query
def latin_report(v: Views) -> DataFrame:
    return srt.latin_warnings(v.cues())


@query
def word_json(v: Views) -> DataFrame:
    words = rounded(v.tokens(by_track=True), 3)
    return files.word_json(words, "en", part_rows=PART_ROWS, hot=False)


@query
def speech_queue(v: Views) -> DataFrame:
    return srt.speech_queue(v.cues(), "clips", hot=v.hot)


@query
def whole_text_queue(v: Views) -> DataFrame:
    return srt.whole_text_queue(
        v.table("documents").select(F.col("doc_id").alias("track"), F.col("text").alias("content"))
    )


@query
def transcript_cues(v: Views) -> DataFrame:
    """Model replies of 40 stamped lines each, stamps relative to the first cue."""
    split = neighbours.batched(v.cues().select("track", "line", "start_ms", "end_ms", "text"), PART_ROWS, hot=v.hot)
    first = split.filter("pos = 0").select("track", "batch", F.col("start_ms").alias("_t0"))

    def stamp(at: str):
        # Within the hour only: minutes, seconds and hundredths.
        ms = F.pmod(F.col(at) - F.col("_t0"), F.lit(3_600_000))
        return F.substring(stamps.ms_to_centi(ms), 3, 8)

    joined = split.join(first, ["track", "batch"])
    line = F.concat(F.lit("["), stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.lit("] "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    replies = joined.groupBy("track", "batch").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("raw"),
        (F.first("_t0") / 1000.0).alias("offset_s"),
    )
    return rounded(files.transcript_cues(replies, ["track", "batch"]), 3)


@query
def manifest_outputs(v: Views) -> DataFrame:
    k = F.col("page_id") % 6
    path = F.concat(F.lit("in/"), F.regexp_replace("url", "[?#].*$", ""), F.lit(".mp4"))
    given = (
        F.when(k == 1, F.lit("out/folder")).when(k == 2, F.lit("out/named.txt")).when(k == 3, F.lit("out/v1.2/"))
        .when(k == 4, F.lit(""))
    )
    rows = v.table("pages").select("page_id", F.when(k != 5, path).alias("input"), given.alias("output"))
    return files.resolve_outputs(rows.drop("page_id"), ".srt")


@query
def routed_lines(v: Views) -> DataFrame:
    """A manifest end to end: lines of the pages, all of which it names, with the file each goes to. Beside them it has
    entries without an input, and inputs that no page has."""
    path = F.concat(F.lit("in/"), F.regexp_replace("url", "[?#].*$", ""), F.lit(".mp4"))
    pages = v.table("pages").select("page_id", path.alias("track"), F.posexplode(F.split("html", "\n")).alias("line", "text"))
    named = pages.filter("line = 0").select("page_id", "track")
    given = F.when(F.col("page_id") % 2 == 0, F.lit("out/folder"))
    lost = F.explode(F.array(F.lit(None).cast("string"), F.concat(F.lit("in/none/"), F.col("page_id").cast("string"), F.lit(".mp4"))))
    # Pages with one address are one input, so its output comes from the address.
    manifest = named.groupBy(F.col("track").alias("input")).agg(F.min("page_id").alias("page_id")).select("input", given.alias("output")).unionByName(
        named.select(lost.alias("input"), F.lit("out/folder").alias("output")))
    return files.routed(pages, files.resolve_outputs(manifest, ".srt")).select("page_id", "line", "output", "output_stem")


@query
def boxes(v: Views) -> DataFrame:
    k = F.col("p_partkey") % 7
    body = F.concat_ws(" ", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey", "p_size", F.col("p_size") * 2, F.lit("80"))
    value = (
        F.when(k == 1, F.concat(F.lit("# "), body)).when(k == 2, F.lit("  ")).when(k == 3, F.concat(F.lit("x "), body))
        .when(k == 4, F.lit("short 1 2 3")).when(k == 5, F.concat(F.lit("  "), F.replace(body, F.lit(" "), F.lit("\t ")), F.lit(" extra")))
        .otherwise(body)
    )
    return files.parse_boxes(v.table("part").select(value.alias("value")))


@query
def media_types(v: Views) -> DataFrame:
    endings = F.array(*[F.lit(e) for e in (".MP4", ".wav", ".srt", ".Ass", "", ".tar.gz", ".mkv", "/.mp4", ".flac")])
    path = F.concat("url", F.get(endings, (F.col("page_id") % 9).cast("int")))
    return v.table("pages").groupBy(files.media_type(path).alias("media")).agg(F.count(F.lit(1)).alias("files"))


@query
def full_text(v: Views) -> DataFrame:
    turns = v.turns().select(F.col("conv_id").alias("track"), "turn", "text")
    return aggregates.full_text(turns, ("turn",), 3, hot=v.hot_turns)


@query
def transcript(v: Views) -> DataFrame:
    given = v.table("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("track"), F.col("text").alias("full_text"))
    return aggregates.transcript(v.lines(), True, given, part_rows=PART_ROWS, hot=False)


@query
def batch_messages(v: Views) -> DataFrame:
    split = neighbours.batched(v.cues(), 30, hot=v.hot).withColumn("time", aggregates.clock_range())
    return aggregates.batch_messages(split, "Translate.\n{context_block}\n{batch_input}\nEnd.", "No context.")


def _translated(v: Views) -> tuple[DataFrame, DataFrame]:
    cues = v.lines().filter(rules.strip("text") != "").select(
        "track", "line", (F.col("line") * 10000).alias("start_ms"), (F.col("line") * 10000 + 9000).alias("end_ms"), "text"
    )
    template = "{context_block}" + stand_ins.PARTED + "{batch_input}"
    return jobs.translate(cues, stand_ins.translator, 30, template, attempts=2, hot=False, full_context="All of it:\n{text}")


@query
def translated_cues(v: Views) -> DataFrame:
    return _translated(v)[0].select("track", "line", "batch", "pos", "text", "status")


@query
def translation_report(v: Views) -> DataFrame:
    return aggregates.batch_report(_translated(v)[1])


@query
def ledgered_calls(v: Views) -> DataFrame:
    """A job that broke off after every other batch, and was run again, twice: how often each run asked the model, by track."""
    split = neighbours.batched(v.cues().withColumn("time", aggregates.clock_range()), 30, hot=v.hot)
    # Every run reads them twice.
    messages = written(aggregates.batch_messages(split).withColumn("message", F.concat(F.col("track").cast("string"), F.lit("/"), "message")))
    ledger = f"{shared_dir(v.spark)}/cuespan-ledger-{uuid.uuid4().hex}"
    models.call_once(messages.filter("batch % 2 = 0"), stand_ins.echo, ledger)
    models.call_once(messages, stand_ins.echo, ledger)
    replies = models.call_once(messages, stand_ins.echo, ledger)
    asked = v.spark.read.parquet(ledger).groupBy(F.split("reply", "/")[0].cast("bigint").alias("track")).pivot("run", [0, 1, 2]).count()
    found = replies.groupBy("track").agg(F.count(F.lit(1)).alias("batches"), F.count_if((F.col("status") == "ok") & (F.col("reply") == F.col("message"))).alias("answered"))
    return found.join(asked, "track").select(
        "track", "batches", "answered", *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(f"asked_{r}") for r in range(3)])


@query
def batch_merge(v: Views) -> DataFrame:
    """Ready-made replies put in place by position; some are a block short, some missing."""
    split = neighbours.batched(v.cues().select("track", "line", "start_ms", "end_ms", "text"), 30, hot=v.hot)
    odd = F.col("batch") % 4
    block = F.concat_ws("\n", F.col("pos") + 1, aggregates.clock_range(), F.upper("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))
    told = split.filter(~((odd == 1) & (F.col("pos") == 0)) & (odd != 3))
    replies = told.groupBy("track", "batch").agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n").alias("reply"))
    return models.merge_replies(split, replies, payload=False).select("track", "line", "text", "status")


@query
def recognised_items(v: Views) -> DataFrame:
    items = v.cues().select("track", "line", F.when(F.col("line") % 5 != 0, F.col("kind")).alias("item"))
    return models.recognise(items, "item", stand_ins.recogniser, 8).select("track", "line", "text")


def _clips_made(v: Views) -> DataFrame:
    v.store()
    return models.make_clips(srt.speech_queue(v.cues(), hot=v.hot), stand_ins.speaker, v.clips())


@query
def missing_clips_made(v: Views) -> DataFrame:
    return _clips_made(v)


@query
def clip_outcomes(v: Views) -> DataFrame:
    return aggregates.outcome_counts(_clips_made(v), F.col("ok"))


def _rates(v: Views) -> DataFrame:
    """Tracks of two frame rates."""
    return v.totals().select("track", F.when(F.col("track") % 2 == 0, 25.0).otherwise(30.0).alias("fps"))


@query
def dubbed_cues(v: Views) -> DataFrame:
    v.store()
    cues = v.speech().select("track", "line", "start_ms", "end_ms", "text")
    return jobs.dub(cues, v.mutes(), v.totals(), v.clips(), hot=v.hot, rates=_rates(v))[1]


@query
def dubbed_timeline(v: Views) -> DataFrame:
    v.store()
    cues = v.speech().select("track", "line", "start_ms", "end_ms", "text")
    return rounded(jobs.dub(cues, v.mutes(), v.totals(), v.clips(), hot=v.hot, rates=_rates(v))[0].drop("seg_no", "fps"))


@query
def screen_text_cues(v: Views) -> DataFrame:
    """Fuzzy merging at the usual likeness."""
    return _screen_text(v, 0.70)


@query
def screen_text_cues_exact(v: Views) -> DataFrame:
    return _screen_text(v, 1.0)


def _screen_text(v: Views, threshold: float) -> DataFrame:
    return jobs.screen_text(
        v.frames(), "hash", stand_ins.scene_recogniser, interval=2, max_distance=30, fps=10.0,
        passed=frames.active_enough("embedding", 0.25, 0.03), threshold=threshold, hot=v.hot_frames,
    )


@query
def overlap_report(v: Views) -> DataFrame:
    """How many neighbours overlap in two merged sources, per track."""
    merged = intervals.merge_sources(v.speech(), v.mutes(), hot=v.hot)
    return intervals.adjacent_overlaps(merged, hot=v.hot).groupBy("track").agg(F.count(F.lit(1)).alias("overlaps"))
