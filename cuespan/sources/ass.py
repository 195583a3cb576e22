"""ASS subtitle files: reading into lines and headers, and rendering cues as dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import stamps, text as rules
from cuespan.operators.intervals import remap
from cuespan.sources.srt import LINE_ENDS, read_texts, write_lines

# Fixed value: the format line of styles.
STYLE_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
    "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, "
    "MarginR, MarginV, Encoding"
)


def sections(texts: DataFrame, hot: bool | None = None) -> DataFrame:
    """Lines of ASS texts with the section they stand in: ``track, line_no, section, value``.

    ``texts`` has whole files, as ``content``, or their lines, ``at`` and ``value``, as ``srt.read_lines`` gives them. In the
    first case a file is one row, so its lines are numbered and labelled within one task.
    """
    if "content" in texts.columns:
        lines = F.transform(F.split("content", LINE_ENDS), lambda x: rules.strip(x))
        numbered = texts.select("track", F.posexplode(lines).alias("_i", "value")).withColumn("line_no", F.col("_i").cast("bigint"))
        hot = False
    else:
        hot = seq.too_long(texts) if hot is None else hot
        lines = F.transform(F.split("value", LINE_ENDS), lambda x: rules.strip(x))
        parts = texts.select("track", "at", F.posexplode(lines).alias("_i", "value"))
        placed = seq.extend(parts, ["at", "_i"], {"_no": seq.position()}, hot=hot)
        numbered = placed.withColumn("line_no", F.col("_no") - 1)
    head = F.when(F.col("value").rlike(r"^\[.*\]\z"), F.lower(F.regexp_extract("value", r"^\[(.*)\]\z", 1)))
    marked = seq.extend(
        numbered.select("track", "line_no", "value", head.alias("_head")), ["line_no"], {"section": seq.last_seen("_head")}, hot=hot)
    return marked.filter("_head is null and value <> ''").select("track", "line_no", "section", "value")


def with_all_lines(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """Whole files ``track, line_no, value``: the lines of ``changed`` in place of their own, all others, headers,
    comments and blank lines too, as they stand in ``texts``."""
    lines = texts.select("track", F.posexplode(F.split("content", LINE_ENDS)).alias("_i", "_raw"))
    return (
        lines.withColumn("line_no", F.col("_i").cast("bigint"))
        .join(changed.select("track", "line_no", "value"), ["track", "line_no"], "left")
        .select("track", "line_no", F.coalesce("value", "_raw").alias("value"))
    )


def headers(lines: DataFrame) -> DataFrame:
    """Per file: ``script_info`` map, ``styles``, and the format line of the events."""
    info = lines.filter("section = 'script info' and contains(value, ':')").select(
        "track", "line_no",
        rules.strip(F.regexp_extract("value", "^([^:]*):(.*)", 1)).alias("k"),
        rules.strip(F.regexp_extract("value", "^([^:]*):(.*)", 2)).alias("v"),
    )
    # A later key takes the place of an earlier one.
    info = info.groupBy("track", "k").agg(F.max_by("v", "line_no").alias("v"))
    info = info.groupBy("track").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("script_info")
    )
    style = lines.filter("section = 'v4+ styles' and startswith(value, 'Style:')")
    styles = style.groupBy("track").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda s: s["value"]).alias("styles")
    )
    formats = lines.filter("section = 'events' and startswith(value, 'Format:')").groupBy("track").agg(
        F.max_by("value", "line_no").alias("events_format")
    )
    return (
        lines.select("track").distinct()
        .join(info, "track", "left").join(styles, "track", "left").join(formats, "track", "left")
    )


def dialogues(lines: DataFrame) -> DataFrame:
    """Dialogue lines as fields; the text keeps its commas. Lines of fewer than ten fields
    come with ``complete`` false."""
    spoken = lines.filter("section = 'events' and startswith(value, 'Dialogue:')")
    parts = F.split("value", ",", 10)
    names = ["layer", "start", "end", "style", "name", "margin_l", "margin_r", "margin_v", "effect", "text"]
    fields = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]
    split = spoken.select("track", "line_no", "value", (F.size(parts) >= 10).alias("complete"), *fields)
    return split.withColumns(
        {
            "layer": rules.strip(F.regexp_replace("layer", "^Dialogue:", "")),
            "start_ms": stamps.centi_to_ms("start"),
            "end_ms": stamps.centi_to_ms("end"),
        }
    )


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    return dialogues(sections(read_texts(spark, path)))


def rendered(cues: DataFrame, width: int = 14, style: str = "NoteStyle") -> Column:
    """A cue as a ``Dialogue:`` line; stamps as they were read are used where there are any."""
    def stamp(raw: str, ms: str) -> Column:
        plain = stamps.ms_to_centi(ms)
        return F.coalesce(stamps.clock_to_centi(raw), plain) if raw in cues.columns else plain

    body = rules.hard_wrap(rules.newline_to_break("text"), width)
    return rules.dialogue_line(stamp("start_raw", "start_ms"), stamp("end_raw", "end_ms"), body, style)


def header_text(script_info: dict[str, str], styles: list[str], events_format: str) -> str:
    """Everything before the first dialogue."""
    info = [f"{k}: {v}" for k, v in script_info.items()]
    return "\n".join(
        ["[Script Info]", *info, "", "[V4+ Styles]", STYLE_FORMAT, *styles, "", "[Events]", events_format]
    )


def write_ass(cues: DataFrame, path: str, header: str, width: int = 14, style: str = "NoteStyle") -> None:
    """Write dialogue lines per track, after the header of a template."""
    lines = cues.select("track", F.col("line").cast("bigint").alias("line"), rendered(cues, width, style).alias("value"))
    heads = lines.select("track").distinct().select(
        "track", F.lit(-1).cast("bigint").alias("line"), F.lit(header).alias("value")
    )
    write_lines(heads.unionByName(lines), F.col("value"), path)


def scaled(lines: DataFrame, speed: float) -> DataFrame:
    """Dialogue lines at another speed; lines that cannot be read stay as they are."""
    start = stamps.scaled("start_ms", speed)
    end = stamps.scaled("end_ms", speed)
    end = F.when(end <= start, start + 1).otherwise(end)
    return lines.withColumn("value", _with_times(start, end, F.col("text")))


def _with_times(start: Column, end: Column, text: Column) -> Column:
    parts = F.split("value", ",", 10)
    line = F.concat_ws(
        ",", F.get(parts, F.lit(0)), stamps.ms_to_centi(start), stamps.ms_to_centi(end),
        *[F.get(parts, F.lit(i)) for i in range(3, 9)], text,
    )
    readable = F.col("complete") & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    return F.when(readable, line).otherwise(F.col("value"))


def retimed(lines: DataFrame, timeline: DataFrame, width: int = 15, fps: float | str = 30.0, hot: bool | None = None) -> DataFrame:
    """Dialogue lines on a new timeline, texts hard-wrapped; incomplete lines pass through."""
    ends = lines.select(
        "track", "line_no",
        F.explode(F.array(*[F.struct(F.col(c).alias("at_ms"), F.lit(i).alias("which"))
                            for i, c in enumerate(("start_ms", "end_ms"))])).alias("p"),
    ).select("track", "line_no", "p.*").filter("at_ms is not null")
    moved = remap(ends, timeline, "line_no", fps, hot).groupBy("track", "line_no").agg(
        *[F.max(F.when(F.col("which") == i, F.rint("new_ms").cast("bigint"))).alias(n)
          for i, n in enumerate(("_start", "_end"))]
    )
    joined = lines.join(moved, ["track", "line_no"], "left")
    value = _with_times(F.col("_start"), F.col("_end"), rules.hard_wrap("text", width))
    return joined.withColumn("value", value).select("track", "line_no", "value")
