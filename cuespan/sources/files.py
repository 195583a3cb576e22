"""Other inputs and outputs: model transcripts, boxes, manifests, file listings, word JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.functions import stamps, text as rules

# File endings by kind of medium.
MEDIA_ENDINGS = {
    "video": ("mp4", "mkv", "mov", "avi", "webm", "flv", "wmv"),
    "audio": ("wav", "mp3", "m4a", "flac", "aac", "ogg", "wma"),
    "srt": ("srt",),
    "ass": ("ass",),
}
VIDEO_LISTING = ("mp4", "avi", "mkv", "mov", "wmv")

# Fixed value: ``[MM:SS.ff --> MM:SS.ff] text``, hours allowed, up to the next such line.
TRANSCRIPT_STAMP = r"\d{1,2}:\d{2}(?::\d{2})?[\.:]\d{2}"
TRANSCRIPT_CUE = rf"(?s)\[({TRANSCRIPT_STAMP})\s*-->\s*({TRANSCRIPT_STAMP})\]\s*(.+?)(?=\n\[|\z)"


def transcript_cues(replies: DataFrame, keys=("track",)) -> DataFrame:
    """Cues from model replies (``raw``), shifted by each reply's ``offset_s``. Cues without
    text, with a bad stamp or no length are left out; the rest are numbered per reply."""
    found = F.arrays_zip(
        *[F.regexp_extract_all("raw", F.lit(TRANSCRIPT_CUE), F.lit(i)).alias(n)
          for i, n in ((1, "start"), (2, "end"), (3, "text"))]
    )
    rows = replies.select(*keys, "offset_s", F.posexplode(found).alias("_i", "c")).select(
        *keys, "_i",
        (stamps.flexible_seconds("c.start") + F.col("offset_s")).alias("start_s"),
        (stamps.flexible_seconds("c.end") + F.col("offset_s")).alias("end_s"),
        rules.strip("c.text").alias("text"),
    )
    good = rows.filter("text <> '' and start_s is not null and end_s > start_s")
    return seq.extend(good, ["_i"], {"line": seq.position()}, keys=keys, hot=False).select(
        *keys, "line", "start_s", "end_s", "text"
    )


def parse_boxes(lines: DataFrame) -> DataFrame:
    """Boxes from lines ``name x y w h`` (``value``); comments, blank and bad lines are left out."""
    parts = F.split(rules.strip("value"), r"(?U)\s+")
    fields = [F.get(parts, F.lit(i + 1)).try_cast("bigint").alias(n) for i, n in enumerate("xywh")]
    boxes = lines.filter((rules.strip("value") != "") & ~rules.strip("value").startswith("#")).select(
        F.get(parts, F.lit(0)).alias("name"), *fields
    )
    return boxes.dropna(subset=list("xywh"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return parse_boxes(spark.read.text(path))


def file_ending(path) -> Column:
    """Lower-case ending of the last part of a path, '' if it has none."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def media_type(path) -> Column:
    ending = file_ending(path)
    kind = F.lit("unknown")
    for name, endings in MEDIA_ENDINGS.items():
        kind = F.when(ending.isin(*endings), name).otherwise(kind)
    return kind


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their kind; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", media_type("path").alias("media")
    )


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """Videos of the kinds looked for in a folder, endings all lower or all upper case."""
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return list_files(spark, path).filter(ending.isin(*VIDEO_LISTING, *[e.upper() for e in VIDEO_LISTING]))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def resolve_outputs(manifest: DataFrame, ending: str, default_dir: str | None = None) -> DataFrame:
    """Where each input's output goes: the file named, or a file in the folder named (a name
    without ending), or in the default folder, or beside the input. Rows without input are
    flagged ``rejected``."""
    source, given = F.col("input"), F.regexp_replace(F.coalesce("output", F.lit("")), "/+$", "")
    name = F.concat(_stem(source), F.lit(ending))
    beside = F.when(source.contains("/"), F.concat(_parent(source), F.lit("/"), name)).otherwise(name)
    unset = F.concat(F.lit(f"{default_dir}/"), name) if default_dir else beside
    has_ending = F.regexp_extract(given, r"([^/]*)$", 1).rlike(r"^.+\.[^.]+$")
    output = F.when(given == "", unset).when(has_ending, given).otherwise(F.concat(given, F.lit("/"), name))
    return manifest.select(
        "input",
        F.when(source.isNotNull(), output).alias("output"),
        F.when(source.isNotNull(), _parent(output)).alias("output_dir"),
        F.when(source.isNotNull(), _stem(output)).alias("output_stem"),
        source.isNull().alias("rejected"),
    )


def read_manifest(spark: SparkSession, path: str, ending: str, default_dir: str | None = None) -> DataFrame:
    """A JSON list of ``{"input", "output"}``."""
    rows = spark.read.schema("input string, output string").json(path, multiLine=True)
    return resolve_outputs(rows, ending, default_dir)


def routed(cues: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cues of the inputs a manifest names, with the ``output`` each goes to. Cues are known
    by the path they were read from; the manifest names as many paths as it has rows."""
    path = F.regexp_replace("track", "^file:/*", "/")
    wanted = manifest.filter("not rejected").select(F.col("input").alias("_path"), "output", "output_dir", "output_stem")
    return cues.withColumn("_path", path).join(wanted, "_path").drop("_path")


def word_json(
    words: DataFrame, language: str, texts: DataFrame | None = None, part_rows: int = 1000, hot: bool | None = None
) -> DataFrame:
    """``{language, text, time_stamps: […]}`` per track, in parts of a bounded number of words.
    ``texts``: ``track, full_text``; without it the text is the words joined."""
    placed = seq.extend(words, ["tok_idx"], {"_no": seq.position()}, hot=hot)
    ordered = F.array_sort(
        F.collect_list(
            F.struct("_no", F.struct("text", F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time")).alias("w"))
        )
    )
    parts = placed.groupBy("track", F.floor((F.col("_no") - 1) / part_rows).alias("part")).agg(
        F.transform(ordered, lambda s: s["w"]).alias("stamps")
    )
    whole = F.array_join(F.transform("stamps", lambda w: w["text"]), "")
    if texts is not None:
        parts = parts.join(texts, "track", "left")
        # The given text belongs to the track; it goes with the first part.
        whole = F.when(F.col("part") == 0, F.col("full_text")).otherwise("")
    body = F.struct(F.lit(language).alias("language"), whole.alias("text"), F.col("stamps").alias("time_stamps"))
    return parts.select("track", "part", F.to_json(body).alias("json"))
