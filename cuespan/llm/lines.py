"""Line dedup within one word of edits, by deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.llm.texts import text_key, whole
from cuespan.session import written

LEAST_WORDS = 8
#: Hashes that are summed up keep so many bits: no line has enough words for the sum to overflow.
_BITS = (1 << 36) - 1


def _lines(docs: DataFrame, text: str) -> DataFrame:
    """Lines that are not blank, with their places, a 128-bit identity and their number of words."""
    line = F.col("line")
    cut = docs.select("doc_id", text_key(text).alias("text_key"), F.posexplode(F.split(whole(text), "\n")).alias("at", "line"))
    return cut.where(F.trim(line) != "").select(
        F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b")).alias("id"),
        F.struct("doc_id", "text_key", "at").alias("place"),
        (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"), "line")


def _half_keys() -> Column:
    """Lines within one edit share their first or their last words, half of the shorter line's."""
    def words(count: Column) -> Column:
        return F.call_function("substring_index", F.col("line"), F.lit(" "), count)

    keys = []
    for shorter in (F.col("words"), F.col("words") - 1):
        half = F.floor(shorter / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), shorter, words(half)), F.xxhash64(F.lit("last"), shorter, words(-half))]
    return F.array(*keys)


def _summed(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _short(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(_BITS))


def _variants(lines: DataFrame) -> DataFrame:
    """``(id, first, key)``: the lines with one word left out, as hashed keys.

    ``gap`` keys name the place of the missing word: lines that share one differ in the word there. ``less``
    keys are those of the line without the word, by its words and its pairs of neighbours, as ``full`` keys are
    of whole lines: a line without one word meets the line that it then is. Each variant takes a few sums.
    """
    w = F.split("line", " ")
    lines = lines.select("id", "first", w.alias("w"), F.size(w).alias("n"))
    ends = F.concat(F.array(F.lit("\n")), F.col("w"), F.array(F.lit("\n")))
    lines = lines.withColumns({
        "one": F.transform("w", lambda x, i: _short(x, i)), "two": F.transform("w", lambda x, i: _short(i, x)),
        "each": F.transform("w", lambda x: _short(x)),
        "pair": F.transform(F.arrays_zip(F.slice(ends, 1, F.col("n") + 1).alias("x"), F.slice(ends, 2, F.col("n") + 1).alias("y")),
                            lambda p: _short(p["x"], p["y"])),
        "over": F.transform(F.arrays_zip(F.slice(ends, 1, F.col("n")).alias("x"), F.slice(ends, 3, F.col("n")).alias("y")),
                            lambda p: _short(p["x"], p["y"])),
    })
    lines = lines.withColumns({f"{c}_sum": _summed(F.col(c)) for c in ("one", "two", "each", "pair")})
    at = F.sequence(F.lit(0), F.col("n") - 1)
    gap = F.transform(at, lambda i: F.xxhash64(
        F.lit("gap"), "n", i, F.col("one_sum") - F.get("one", i), F.col("two_sum") - F.get("two", i)))
    less = F.transform(at, lambda i: F.xxhash64(
        F.lit("full"), F.col("n") - 1, F.col("each_sum") - F.get("each", i),
        F.col("pair_sum") - F.get("pair", i) - F.get("pair", i + 1) + F.get("over", i)))
    full = F.xxhash64(F.lit("full"), "n", "each_sum", "pair_sum")
    return lines.select("id", "first", F.explode(F.concat(
        F.transform(gap, lambda k: F.struct(F.lit("gap").alias("kind"), k.alias("key"))),
        F.transform(F.array_distinct(less), lambda k: F.struct(F.lit("less").alias("kind"), k.alias("key"))),
        F.array(F.struct(F.lit("full").alias("kind"), full.alias("key"))))).alias("v")).select("id", "first", "v.kind", "v.key")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether word lists differ in one word at most: put in, left out or changed."""
    def missing(short: Column, long: Column) -> Column:
        same = F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x == y)
        head = F.array_position(same, False)
        head = F.when(head == 0, F.size(short)).otherwise(head - 1).cast("int")
        return F.slice(short, head + 1, F.size(short)) == F.slice(long, head + 2, F.size(long))

    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d)) <= 1
    return (F.when(F.size(a) == F.size(b), changed).when(F.size(a) + 1 == F.size(b), missing(a, b))
            .when(F.size(a) == F.size(b) + 1, missing(b, a)).otherwise(False))


def alive_lines(places: DataFrame) -> DataFrame:
    """``(id)`` of distinct lines that share half of their words, at either end, with another: no other line
    can be one edit away from any, so only these emit variants."""
    halves = places.where("halves is not null").select("id", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("id.a").alias("low"), F.max("id.a").alias("high")).where("low <> high")
    return halves.join(written(met.select("half")), "half", "left_semi").select("id").distinct()


def near_lines(lines: DataFrame) -> DataFrame:
    """``(id)`` of those of the distinct lines ``(id, first, line)`` that have an earlier one at most one word away."""
    variants = written(_variants(lines))
    gaps = variants.where("kind = 'gap'")
    # Lines that share a gap are all one word apart, so the earliest stands for all others.
    earliest = gaps.groupBy("key").agg(F.min(F.struct("first", "id")).alias("least"), F.min("id").alias("low"), F.max("id").alias("high"))
    earliest = written(earliest.where("low <> high").select("key", F.col("least.id").alias("other")))
    changed = gaps.join(earliest, "key").where("other <> id").select("id", "other")
    less = variants.where("kind = 'less'").select("key", F.col("id").alias("long"), F.col("first").alias("long_first"))
    full = variants.where("kind = 'full'").select("key", F.col("id").alias("short"), F.col("first").alias("short_first"))
    later = F.col("long_first") > F.col("short_first")
    left_out = less.join(full, "key").select(
        F.when(later, F.col("long")).otherwise(F.col("short")).alias("id"),
        F.when(later, F.col("short")).otherwise(F.col("long")).alias("other"))
    pairs = written(changed.unionByName(left_out).distinct())
    texts = lines.select(F.col("id").alias("__id"), F.split("line", " ").alias("w"))
    return (
        pairs.join(texts, F.col("id") == F.col("__id")).select("id", "other", F.col("w").alias("a"))
        .join(texts, F.col("other") == F.col("__id")).where(_one_edit(F.col("a"), F.col("w"))).select("id").distinct()
    )


def drop_repeated_lines(docs: DataFrame, least: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped, text)`` per row of ``docs``: the text without the lines that are
    repeated, and the numbers of the dropped lines, from 0, comma-joined.

    Lines part at line feeds; blank ones stay. Of equal lines the earliest stays, by doc_id, then place, nulls
    first. A line of ``least`` words or more also goes if an earlier one differs from it by one word put in, left
    out or changed (words part at single spaces), whether or not that one stays itself. Null texts count as
    empty; rows that repeat a doc_id and its text are one document and come out alike; no rows give no rows.
    Other columns are not read.
    """
    lines = _lines(docs, text)
    places = written(lines.select("id", "place", F.when(F.col("words") >= least, _half_keys()).alias("halves")))
    alive = written(alive_lines(places)).select(F.col("id").alias("__id"), F.lit(True).alias("alive"))
    firsts = places.groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = written(
        firsts.join(alive, F.col("id") == F.col("__id"), "left")
        .select("id", "first", (~F.col("first").eqNullSafe(F.col("last"))).alias("again"), F.coalesce("alive", F.lit(False)).alias("alive"))
        .where("again or alive"))
    candidates = written(
        lines.join(firsts.where("alive").select(F.col("id").alias("__id"), "first"), F.col("id") == F.col("__id"))
        .where(F.col("place").eqNullSafe(F.col("first"))).select("id", "first", "line").dropDuplicates(["id"]))
    near = near_lines(candidates).select(F.col("id").alias("__id"), F.lit(True).alias("near"))
    marked = written(
        firsts.join(near, F.col("id") == F.col("__id"), "left").where("again or near")
        .select(F.col("id").alias("__id"), "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = (
        places.join(marked, F.col("id") == F.col("__id")).where(F.col("near") | ~F.col("place").eqNullSafe(F.col("first")))
        .groupBy("place.doc_id", "place.text_key").agg(F.array_sort(F.collect_set("place.at")).alias("gone"))
        .select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "gone")
    )
    kept = docs.select("doc_id", text_key(text).alias("text_key"), whole(text).alias("text")).join(
        written(gone), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    kept = kept.select("doc_id", "text", F.split("text", "\n").alias("cut"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), F.col("gone"))
    return kept.select(
        "doc_id", F.size("cut").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"),
        F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("dropped"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("cut", i)), "\n")).alias("text"))
