"""Subtitle (SRT) text to cues, and cues to SRT, plain text and speech queues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import stamps, text as rules
from cuespan.operators.aggregates import clock_range, in_parts
from cuespan.session import ship, written

# Fixed value: what ends a line, beyond the usual newlines.
LINE_ENDS = r"\R|[\x1c-\x1e]"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files under a path or glob: ``track`` (the file) and ``content``."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("track"), F.col("value").alias("content"))
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("track"),
        F.struct(F.col("_metadata.file_block_start").alias("from"), F.monotonically_increasing_id().alias("no")).alias("at"),
        F.regexp_replace("value", r"\r\z", "").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under a path or glob, by byte ranges, so that a file may be larger than a task: ``track`` (the
    file), ``at`` and ``value``.

    ``at`` orders a file's lines: where the range begins in the file, and the line's place in what its task read. Lines end
    at line feeds, and a carriage return before one belongs to it; what follows the last one is a line if it is not empty.
    """
    return written(_lines(spark, path))


def _blocks_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lines ``track, from, no, value, blank`` that come in order: ``track, from, no`` of the run of consecutive lines
    they stand in, ``nth`` there, ``raw``, and whether they hold the run's first and its last line. A run that begins with
    a blank line has a row without ``raw``."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []  # the lines of the block that is open
    last = run = None  # the line before: track, from, no; the place of its run's first line
    held_begins, told = False, 0  # whether the open block begins its run; blocks of the run that were given out

    def begins_run(rows: pa.RecordBatch) -> np.ndarray:
        track, part, no = rows.column(0), rows.column(1).to_numpy(), rows.column(2).to_numpy()
        apart = np.ones(len(no), bool)
        apart[1:] = (part[1:] != part[:-1]) | (no[1:] != no[:-1] + 1) | pc.not_equal(track[1:], track[:-1]).to_numpy(zero_copy_only=False)
        apart[0] = last != (track[0].as_py(), part[0], no[0] - 1)
        return apart

    def cut(rows: pa.RecordBatch, starts: np.ndarray, over: bool) -> pa.RecordBatch:
        nonlocal held, held_begins, run, told
        n = rows.num_rows
        filled = ~rows.column(4).to_numpy(zero_copy_only=False)
        first, after = starts.copy(), np.ones(n, bool)
        first[0] = True
        first[1:] |= ~filled[:-1]
        after[:-1] = starts[1:] | ~filled[1:]
        begins, ends = np.flatnonzero(filled & first), np.flatnonzero(filled & after)
        closes = np.append(starts[1:], True)[ends]
        # Each line's run: 0 for the one that was open.
        of = np.cumsum(starts)
        places = np.flatnonzero(starts)
        part = np.append(run[0] if run else 0, rows.column(1).to_numpy()[places])
        no = np.append(run[1] if run else 0, rows.column(2).to_numpy()[places])
        before = np.append(-told, np.searchsorted(begins, places))
        nth = np.arange(len(begins)) - before[of[begins]]
        kept = len(begins)
        held = []
        if not over and kept and ends[-1] == n - 1:
            kept -= 1
            held, held_begins = [rows.slice(begins[-1])], bool(starts[begins[-1]])
        run, told = (int(part[-1]), int(no[-1])), int(kept - before[-1])
        begins, ends, closes, nth = begins[:kept], ends[:kept], closes[:kept], nth[:kept]
        sizes = ends - begins + 1
        inside = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        lines = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), rows.column(3).take(pa.array(inside)))
        marks = places[~filled[places]]
        at = np.append(begins, marks)
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(at)), pa.array(part[of[at]]), pa.array(no[of[at]]), pa.array(np.append(nth, np.full(len(marks), -1))),
             pa.concat_arrays([pc.binary_join(lines, "\n"), pa.nulls(len(marks), pa.string())]), pa.array(starts[at]), pa.array(np.append(closes, np.zeros(len(marks), bool)))],
            ["track", "from", "no", "nth", "raw", "opens", "closes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = begins_run(batch)
        last = tuple(batch.column(i)[-1].as_py() for i in range(3))
        if held and not starts.any() and not pc.any(batch.column(4)).as_py():
            held.append(batch)
            continue
        if held:
            size = sum(b.num_rows for b in held)
            starts = np.concatenate([[held_begins], np.zeros(size - 1, bool), starts])
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        yield cut(batch, starts, False)
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield cut(rows, np.append(held_begins, np.zeros(rows.num_rows - 1, bool)), True)


def block_ranges(lines: DataFrame) -> DataFrame:
    """Blocks of SRT files, ``track, block, raw``, from their lines as ``read_lines`` gives them. Blank lines part blocks; a block
    has to fit a task, a file has not. A file of blanks only has none.

    Each task cuts its lines as they come, a batch at a time; no line is shuffled. Runs of consecutive lines have a row each, by which
    blocks are numbered, and blocks that lie on both sides of a run's end are joined.
    """
    ship(lines.sparkSession)
    kind = lines.schema["track"].dataType.simpleString()
    told = lines.select("track", "at.from", "at.no", "value", (~F.col("value").rlike(r"(?U)\S")).alias("blank")).mapInArrow(
        _blocks_of_runs, f"track {kind}, from bigint, no bigint, nth bigint, raw string, opens boolean, closes boolean")
    cut = written(told)
    along = Window.partitionBy("track").orderBy("from", "no")
    runs = cut.groupBy("track", "from", "no").agg(
        F.count("raw").alias("_n"), F.max(F.col("opens") & F.col("raw").isNotNull()).alias("_opens"), F.max("closes").alias("_closes"))
    joined = F.col("_opens") & F.coalesce(F.lag("_closes").over(along), F.lit(False))
    runs = runs.withColumn("_joined", joined).select(
        "track", "from", "no", "_n", "_joined", F.coalesce(F.lead("_joined").over(along), F.lit(False)).alias("_goes_on"),
        (F.sum("_n").over(along) - F.col("_n") - F.sum(F.col("_joined").cast("bigint")).over(along)).alias("_before"))
    placed = cut.filter("raw is not null").join(written(runs), ["track", "from", "no"]).withColumn("block", F.col("_before") + F.col("nth"))
    part = (F.col("_joined") & (F.col("nth") == 0)) | (F.col("_goes_on") & (F.col("nth") == F.col("_n") - 1))
    ordered = F.array_sort(F.collect_list(F.struct("from", "no", "raw")))
    parts = placed.filter((F.col("opens") | F.col("closes")) & part).groupBy("track", "block").agg(
        F.array_join(F.transform(ordered, lambda s: s["raw"]), "\n").alias("raw"))
    return placed.filter(~part).select("track", "block", "raw").unionByName(parts)


def parsed_blocks(texts: DataFrame, keys=("track",), min_lines: int = 2, arrow: str = "-->") -> DataFrame:
    """All blocks of SRT texts with what was read and why a block is unusable (``reason``). ``texts`` has whole texts, as
    ``content``, or blocks, as ``block`` and ``raw``."""
    if "raw" in texts.columns:
        blocks = texts.select(*keys, "block", "raw", F.split(rules.strip("raw"), LINE_ENDS).alias("_lines"))
    else:
        body = F.regexp_replace(rules.strip("content"), "\r\n", "\n")
        split = F.transform(
            F.split(body, r"\n(?U:\s)*\n"),
            lambda raw: F.struct(raw.alias("raw"), F.split(rules.strip(raw), LINE_ENDS).alias("_lines")),
        )
        blocks = texts.select(*keys, F.posexplode(split).alias("block", "_b")).select(*keys, "block", "_b.*")
    line = [F.get("_lines", F.lit(i)) for i in (0, 1)]
    times = F.split(line[1], arrow)
    rest = F.array_join(F.slice("_lines", 3, F.greatest(F.size("_lines") - 2, F.lit(0))), "\n")
    untagged = rules.without_tags(rules.strip(rest))
    start, end = (F.trim(F.get(times, F.lit(i))) for i in (0, 1))
    fields = {
        "_n": F.size("_lines"),
        "_arrow": F.contains(line[1], F.lit(arrow)),
        "line": line[0].try_cast("bigint"),
        "time": rules.strip(line[1]),
        "start_raw": start,
        "end_raw": end,
        "start_ms": stamps.clock_to_ms(start),
        "end_ms": stamps.clock_to_ms(end),
        "text": rules.strip(F.regexp_replace(untagged, "\n{2,}", "\n")),
    }
    parsed = blocks.select(*keys, "block", "raw", *[c.alias(n) for n, c in fields.items()])
    # Through a generator, so that filters on the fields are not pushed back into the parsing.
    read = parsed.select(*keys, "block", "raw", F.inline(F.array(F.struct(*fields))))
    reason = (
        F.when(F.col("_n") < min_lines, "too few lines")
        .when(F.col("line").isNull(), "no index")
        .when(~F.coalesce("_arrow", F.lit(False)), "no arrow")
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad stamp")
        .when(F.col("end_ms") <= F.col("start_ms"), "no length")
    )
    return read.select(
        *keys, F.col("block").cast("bigint").alias("block"), "line", "start_ms", "end_ms", "start_raw", "end_raw",
        "time", "text", "raw", reason.alias("reason"),
    )


def blocks_to_cues(texts: DataFrame, keys=("track",), skip_empty: bool = True) -> DataFrame:
    """Usable blocks of SRT texts (``content``) as cues; the others are passed over."""
    good = parsed_blocks(texts, keys).filter("reason is null")
    good = good.filter("text <> ''") if skip_empty else good
    return good.drop("raw", "reason")


def bad_blocks(texts: DataFrame, keys=("track",), skip_empty: bool = True) -> DataFrame:
    """The blocks passed over, with the reason."""
    blocks = parsed_blocks(texts, keys)
    reason = F.coalesce("reason", F.when(F.col("text") == "", "empty text")) if skip_empty else F.col("reason")
    return blocks.withColumn("reason", reason).filter("reason is not null").select(*keys, "block", "reason", "raw")


def read_srt(spark: SparkSession, path: str, skip_empty: bool = True, by_ranges: bool = False) -> DataFrame:
    """Cues of all SRT files under a path or glob. ``by_ranges`` reads files of any size in many tasks."""
    texts = block_ranges(_lines(spark, path)) if by_ranges else read_texts(spark, path)
    return blocks_to_cues(texts, skip_empty=skip_empty)


def read_strict(texts: DataFrame, keys=("track",)) -> DataFrame:
    """The stricter reading in seconds: blocks part at an empty line, have three lines or more, a number, and
    exactly one `` --> `` between two stamps. Texts stay as they stand. Unreadable stamps count as 0, and a cue
    that ends before it starts lasts one second."""
    body = rules.strip(F.regexp_replace("content", "\r\n?", "\n"))
    lines = F.transform(F.split(body, "\n\n"), lambda block: F.split(rules.strip(block), "\n"))
    blocks = texts.select(*keys, F.explode(F.filter(lines, lambda b: F.size(b) >= 3)).alias("_lines"))
    times = F.split(F.get("_lines", F.lit(1)), " --> ")
    start, end = (stamps.tolerant_seconds(F.get(times, F.lit(i))) for i in (0, 1))
    read = blocks.select(
        *keys, F.get("_lines", F.lit(0)).try_cast("bigint").alias("line"), F.size(times).alias("_stamps"),
        *[c.alias(n) for c, n in zip(valid_seconds(start, end), ("start_s", "end_s"))],
        F.array_join(F.slice("_lines", 3, F.size("_lines")), "\n").alias("text"),
    )
    return read.filter("line is not null and _stamps = 2").drop("_stamps")


def valid_seconds(start: Column, end: Column) -> tuple[Column, Column]:
    """Start not before 0; an end before the start becomes one second after it."""
    start = F.when(start < 0, 0.0).otherwise(start)
    return start, F.when(end < start, start + 1.0).otherwise(end)


def srt_block(with_text: bool = True) -> Column:
    """One cue as SRT text, with the blank line after it."""
    lines = [F.col("line").cast("string"), clock_range()]
    if with_text:
        lines.append(F.when(F.col("text") != "", F.col("text")))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def srt_parts(cues: DataFrame, with_text: bool = True, part_rows: int = 1000, hot: bool | None = None) -> DataFrame:
    """SRT text of each track in parts of ``part_rows`` cues; the parts in order are the file."""
    return in_parts(cues, srt_block(with_text), ("line",), "\n", part_rows, hot)


def stamped_line() -> Column:
    return F.concat(F.lit("["), stamps.ms_to_clock("start_ms"), F.lit("] "), F.col("text"))


def minified(cues: DataFrame) -> DataFrame:
    """Texts on one line each, without empty ones."""
    flat = F.replace(rules.strip("text"), F.lit("\n"), F.lit(" "))
    return cues.withColumn("text", flat).filter("text <> ''")


def latin_warnings(cues: DataFrame) -> DataFrame:
    """Cues with Latin letters or digits, as report lines."""
    report = F.concat(F.lit("["), clock_range(), F.lit("]\n"), F.col("text"))
    return cues.filter(rules.has_latin_or_digit("text")).select("track", "line", report.alias("report"))


def speech_queue(cues: DataFrame, folder: str = "", hot: bool | None = None) -> DataFrame:
    """Cues as work for a clip maker: 0-based number, file name, and the track's last end."""
    if hot is None:
        hot = seq.too_long(cues)
    prefix = f"{folder}/dubb-" if folder else "dubb-"
    placed = seq.extend(
        cues, ["line"],
        {"_no": seq.position(), "_last": seq.whole_max(F.struct("line", "end_ms"))}, hot=hot,
    )
    number = F.col("_no") - 1
    return placed.select(
        "track", "line", "start_ms", "end_ms", "text", number.alias("clip_no"),
        F.concat(F.lit(prefix), number.cast("string"), F.lit(".wav")).alias("filename"),
        F.col("_last.end_ms").alias("total_ms"),
    )


def whole_text_queue(texts: DataFrame) -> DataFrame:
    """A whole text as one piece of work, without times."""
    zero = F.lit(0).cast("bigint")
    return texts.select(
        "track", F.lit(1).cast("bigint").alias("line"), zero.alias("start_ms"), zero.alias("end_ms"),
        F.col("content").alias("text"), zero.alias("clip_no"), F.lit("dubb-0.wav").alias("filename"),
        zero.alias("total_ms"),
    )


def write_lines(rows: DataFrame, line: Column, path: str, order=("line",), by: str = "track") -> None:
    """Write one text line per row, one folder per track, in order.

    Rows are range partitioned on (track, order), so a long track spreads over several
    files whose names sort in the order of the text.
    """
    (
        rows.select(by, *order, line.alias("value"))
        .repartitionByRange(by, *order)
        .sortWithinPartitions(by, *order)
        .select(by, "value")
        .write.partitionBy(by)
        .text(path)
    )


def write_srt(cues: DataFrame, path: str, with_text: bool = True) -> None:
    write_lines(cues, srt_block(with_text), path)


def write_text(cues: DataFrame, path: str, stamped: bool = True) -> None:
    write_lines(cues, stamped_line() if stamped else F.col("text"), path)


def write_minified(cues: DataFrame, path: str) -> None:
    write_lines(minified(cues), F.col("text"), path)
