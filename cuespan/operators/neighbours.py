"""Operators that look at rows next to each other on a track."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.folds import Fold, fold_tracks
from cuespan.session import written


def _islands(cues: DataFrame, breaks: Column, looks_at: dict, hot: bool | None) -> DataFrame:
    """Merge runs of rows into one row each: first start, last end, first text."""
    if hot is None:
        hot = seq.too_long(cues)
    near = seq.extend(cues, ["line"], looks_at, hot=hot).withColumn("_break", F.when(breaks, 1).otherwise(0))
    runs = seq.extend(near, ["line"], {"_run": seq.total("_break")}, hot=hot)
    # One run may be most of the table: it is reduced before the shuffle.
    return runs.groupBy("track", F.col("_run").alias("line")).agg(
        F.min_by("start_ms", "line").alias("start_ms"),
        F.max_by("end_ms", "line").alias("end_ms"),
        F.min_by("text", "line").alias("text"),
    )


def merge_close(cues: DataFrame, max_gap_ms: int = 500, hot: bool | None = None) -> DataFrame:
    """Merge neighbours of equal text no more than ``max_gap_ms`` apart. The merged end is
    that of the last row, not the largest."""
    same = (F.col("text") == F.col("_text")) & (F.col("start_ms") - F.col("_end") <= max_gap_ms)
    looks_at = {"_text": seq.prev("text"), "_end": seq.prev("end_ms")}
    return _islands(cues, ~F.coalesce(same, F.lit(False)), looks_at, hot)


def collapse_repeats(cues: DataFrame, hot: bool | None = None) -> DataFrame:
    """Merge neighbours of equal text, however far apart."""
    same = F.col("text") == F.col("_text")
    return _islands(cues, ~F.coalesce(same, F.lit(False)), {"_text": seq.prev("text")}, hot)


def clean_for_likeness(text: str) -> str:
    return re.sub(r"[^\w\s]", "", text).replace(" ", "")


def alike(a: str, b: str, threshold: float) -> bool:
    """Equal, or alike once punctuation and blanks are gone."""
    if a == b:
        return True
    if threshold >= 1.0:
        return False
    a, b = clean_for_likeness(a), clean_for_likeness(b)
    if not a or not b:
        return False
    if 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < threshold:
        return False  # no ratio of texts of such lengths can reach the threshold
    return difflib.SequenceMatcher(None, a, b).ratio() >= threshold


class _KeepOne(Fold):
    """State: the kept row. A row like the kept text extends it and may lend it its text."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def fresh(self):
        return None

    def step(self, kept, row):
        line, start, end, text = row
        if kept is None:
            return [line, start, end, text], []
        if alike(kept[3], text, self.threshold):
            return [kept[0], kept[1], end, text if len(text) > len(kept[3]) else kept[3]], []
        return [line, start, end, text], [tuple(kept)]

    def finish(self, kept):
        return [tuple(kept)] if kept else []


def collapse_similar(cues: DataFrame, threshold: float = 0.70, hot: bool | None = None) -> DataFrame:
    """Merge neighbours of like text; the longer text is kept and compared on. Lines are
    numbered anew."""
    if hot is None:
        hot = seq.too_long(cues)
    if threshold >= 1.0:
        return collapse_repeats(cues, hot)
    # Exact repeats are merged first, without Python.
    fewer = collapse_repeats(cues, hot)
    kept = fold_tracks(
        fewer, _KeepOne(threshold), ["line", "start_ms", "end_ms", "text"], ["line"],
        "line bigint, start_ms bigint, end_ms bigint, text string", hot=hot,
    )
    return seq.extend(kept, ["line"], {"_no": seq.position()}, hot=hot).select(
        "track", F.col("_no").alias("line"), "start_ms", "end_ms", "text"
    )


def clamp_durations(cues: DataFrame, min_ms: int = 1000, max_ms: int = 7000, hot: bool | None = None) -> DataFrame:
    """Stretch short and cut long cues, never past the start of the next one."""
    near = seq.extend(cues, ["start_ms", "line"], {"_next": seq.following("start_ms")}, hot=hot)
    length = F.col("end_ms") - F.col("start_ms")
    end = (
        F.when(length < min_ms, F.col("start_ms") + min_ms)
        .when(length > max_ms, F.col("start_ms") + max_ms)
        .otherwise(F.col("end_ms"))
    )
    return near.withColumn("end_ms", F.least(end, F.col("_next"))).select(*cues.columns)


def deduplicated(cues: DataFrame, threshold: float = 0.70, hot: bool | None = None) -> DataFrame:
    """Merge repeats, then set durations right."""
    return clamp_durations(collapse_similar(cues, threshold, hot), hot=hot)


def batched(rows: DataFrame, size: int, order=("line",), hot: bool | None = None) -> DataFrame:
    """Add ``batch`` and ``pos``: consecutive slices of ``size`` rows, both 0-based."""
    placed = seq.extend(rows, order, {"_no": seq.position()}, hot=hot)
    no = F.col("_no") - 1
    return placed.withColumns({"batch": F.floor(no / size), "pos": F.pmod(no, F.lit(size))}).drop("_no")


class _Anchored(Fold):
    """State: start of the open batch and its number."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def fresh(self):
        return None

    def step(self, state, row):
        at, line = row
        if state is None or at - state[0] >= self.span_ms:
            state = [at, 0 if state is None else state[1] + 1]
        return state, [(line, at, state[1], state[0])]


def batch_openers(rows: DataFrame, span_ms: int, at: str = "start_ms", hot: bool | None = None) -> DataFrame:
    """``(track, at_ms)``: the times at which batches open, for tracks of any length.

    Each time points to the first one ``span_ms`` later or more. A track's openers are what its first time reaches: in a
    round, all openers found so far follow pointers that lead as many batches on as there were openers before, and
    the pointers are joined to themselves. Rounds number the logarithm of the most batches that a track has.
    """
    times = written(rows.select("track", F.col(at).alias("at_ms")).distinct())
    later = times.select("track", (F.col("at_ms") + span_ms).alias("at"), F.lit(0).alias("real"), F.col("at_ms").alias("origin"))
    both = later.unionByName(times.select("track", F.col("at_ms").alias("at"), F.lit(1).alias("real"), F.lit(None).cast("bigint").alias("origin")))
    # A time that is just one span later comes after the question for it.
    asked = seq.extend(both, ["at", "real"], {"next": seq.next_seen(F.when(F.col("real") == 1, F.col("at")))}, hot=hot)
    pointers = written(asked.filter("real = 0 and next is not null").select("track", F.col("origin").alias("at_ms"), "next"))
    found = written(times.groupBy("track").agg(F.min("at_ms").alias("at_ms")))
    while True:
        reached = written(found.join(pointers, ["track", "at_ms"]).select("track", F.col("next").alias("at_ms")))
        if reached.isEmpty():
            return found
        found = found.unionByName(reached)
        on = pointers.select("track", F.col("at_ms").alias("next"), F.col("next").alias("_beyond"))
        pointers = written(pointers.join(on, ["track", "next"]).select("track", "at_ms", F.col("_beyond").alias("next")))


def time_batches(rows: DataFrame, span_ms: int = 60_000, at: str = "start_ms", hot: bool | None = None) -> DataFrame:
    """Batches that open at their first row and close at the first row ``span_ms`` later.

    Gives ``track, line, at_ms, batch, batch_start_ms``; the anchor drifts with the data,
    so this is no fixed window: a fold, or for tracks too long for one task, pointers that are doubled.
    """
    if hot is None:
        hot = seq.too_long(rows)
    if not hot:
        return fold_tracks(
            rows, _Anchored(span_ms), [at, "line"], [at, "line"],
            "line bigint, at_ms bigint, batch bigint, batch_start_ms bigint", hot=hot,
        )
    openers = batch_openers(rows, span_ms, at, hot).withColumn("_opens", F.lit(True))
    placed = rows.select("track", "line", F.col(at).alias("at_ms"))
    # Only the first of the rows at an opener's time opens its batch.
    near = seq.extend(placed, ["at_ms", "line"], {"_before": seq.prev("at_ms")}, hot=hot)
    marked = near.join(openers, ["track", "at_ms"], "left").withColumn(
        "_opens", F.col("_opens").isNotNull() & ~F.col("_before").eqNullSafe(F.col("at_ms")))
    return seq.extend(
        marked, ["at_ms", "line"],
        {"_no": seq.total(F.when(F.col("_opens"), 1).otherwise(0)), "_start": seq.last_seen(F.when(F.col("_opens"), F.col("at_ms")))}, hot=hot,
    ).select("track", "line", "at_ms", (F.col("_no") - 1).cast("bigint").alias("batch"), F.col("_start").alias("batch_start_ms"))


def batch_spans(batches: DataFrame, hot: bool | None = None) -> DataFrame:
    """Start, end and size of time batches; a batch ends where the next one opens, the last
    with its own last row."""
    if hot is None:
        hot = seq.too_long(batches)
    each = batches.groupBy("track", "batch").agg(
        F.min("batch_start_ms").alias("start_ms"), F.max("at_ms").alias("_last"), F.count(F.lit(1)).alias("rows")
    )
    near = seq.extend(each, ["batch"], {"_next": seq.following("start_ms")}, hot=hot)
    return near.select("track", "batch", "start_ms", F.coalesce("_next", "_last").alias("end_ms"), "rows")


def carried_context(turns: DataFrame, hot: bool | None = None) -> DataFrame:
    """Add ``context`` to each turn: the assistant's text before it, without stamps and blank
    lines ('' where there is none). ``turns``: ``track, turn, role, text``."""
    said = F.when(F.col("role") == "assistant", F.col("text"))
    near = seq.extend(turns, ["turn"], {"_said": seq.last_seen_before(said)}, hot=hot)
    bare = F.regexp_replace("_said", r"\[.*?-->.*?\]\s*", "")
    lines = F.transform(F.split(bare, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    context = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return near.withColumn("context", F.coalesce(context, F.lit(""))).drop("_said")
