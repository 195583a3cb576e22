"""Timed-text tables derived by Spark from the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import sequence as seq
from cuespan.operators import frames, layout, segment
from cuespan.session import ship, written

CLIP_UNIT_MS = 600_000


class Views:
    """Views over one folder of tables. Whether a user's or a label's rows are too many for
    one task is asked of the source tables once, and handed to every operator."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)
        self._tables: dict[str, DataFrame] = {}
        self._keep = False

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def hot(self) -> bool:
        return seq.too_long(self.table("events"), ["user_id"])

    @cached_property
    def hot_frames(self) -> bool:
        return seq.too_long(self.table("embeddings"), ["label"])

    @cached_property
    def hot_turns(self) -> bool:
        return seq.too_long(self.table("conversations"), ["conv_id"])

    def _on_axis(self) -> DataFrame:
        """Events with the milliseconds since their track's first one."""
        events = self.table("events").withColumnRenamed("user_id", "track")
        timed = seq.extend(events, ["ts", "event_id"], {"_t0": seq.whole_min("ts")}, hot=self.hot)
        since = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts"))
        return timed.withColumn("start_ms", F.floor(since / 1000).cast("bigint")).drop("_t0")

    def _derived_cues(self) -> DataFrame:
        length = F.greatest(F.lit(1), (F.col("value") * 600000).cast("bigint"))
        numbered = seq.extend(self._on_axis(), ["start_ms", "event_id"], {"line": seq.position()}, hot=self.hot)
        return numbered.select(
            "track", "line", "event_id", F.col("event_type").alias("kind"), "start_ms",
            (F.col("start_ms") + length).alias("end_ms"),
            F.concat_ws(" ", "event_type", "props").alias("text"),
        )

    @cached_property
    def _stored_cues(self) -> DataFrame:
        return written(self._derived_cues())

    def store(self) -> Views:
        """Write the cues once and read them from there on: for jobs that use them often."""
        self._keep = True
        return self

    def cues(self) -> DataFrame:
        return self._stored_cues if self._keep else self._derived_cues()

    def speech(self) -> DataFrame:
        return self.cues().filter("kind <> 'error'")

    def mutes(self) -> DataFrame:
        return self.cues().filter("kind = 'error'")

    def totals(self) -> DataFrame:
        return layout.totals(self.cues())

    def clips(self) -> DataFrame:
        """Clip lengths by 0-based place of the cue; one in seven is missing."""
        k = F.get_json_object(F.substring_index("text", " ", -2), "$.k").cast("bigint")
        numbered = self.cues().select("track", (F.col("line") - 1).alias("clip_no"), k.alias("_k"))
        return numbered.filter("_k % 7 <> 0").select("track", "clip_no", (F.col("_k") * CLIP_UNIT_MS).alias("clip_ms"))

    def series(self) -> DataFrame:
        """Sampled values on the track's axis."""
        return self._on_axis().select("track", "event_id", F.col("start_ms").alias("at_ms"), "value")

    def slots(self) -> DataFrame:
        self.store()
        return layout.slots_of(self.speech(), self.mutes(), self.totals(), self.clips(), hot=self.hot)

    def timeline(self, fps: float = 30.0) -> DataFrame:
        return layout.timeline(layout.with_speeds(self.slots()), self.totals(), fps, hot=self.hot)

    def documents(self) -> DataFrame:
        """Documents spread over the tasks, however few row groups they are stored in."""
        return self.table("documents").repartition("doc_id")

    def lines(self) -> DataFrame:
        """Lines of the documents. A track is one document, hence one row's text."""
        return self.documents().select(
            F.col("doc_id").alias("track"), F.posexplode(F.split("text", "\n")).alias("line", "text")
        ).withColumn("line", F.col("line").cast("bigint") + 1)

    def tokens(self, by_track: bool = False) -> DataFrame:
        """Words of the documents with the space after them, and times that follow from the
        number of characters before. A document's words come in order, in one partition."""
        if by_track:
            # For what needs tokens by track: they are shuffled once, before they get times.
            cut = self.table("documents").select(
                F.col("doc_id").alias("track"),
                F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), "(?<= )")).alias("_i", "text"),
            ).select("track", F.col("_i").cast("bigint").alias("tok_idx"), "text")
            counted = seq.extend(cut, ["tok_idx"], {"_chars": seq.total_before(F.length("text"))}, hot=False)
        else:
            counted = segment.spaced_tokens(self.documents().select(F.col("doc_id").alias("track"), "text"))
        start = F.col("_chars") * 0.06
        return counted.select(
            "track", "tok_idx", "text", start.alias("start_s"), (start + F.length("text") * 0.05).alias("end_s")
        )

    def turns(self) -> DataFrame:
        return self.table("conversations")

    def frames(self) -> DataFrame:
        """Frames of a track with a hash of their features' signs."""
        features = self.table("embeddings").select(
            F.col("label").cast("bigint").alias("track"), "vec_id", "embedding"
        )
        numbered = seq.extend(features, ["vec_id"], {"_no": seq.position()}, hot=self.hot_frames)
        return numbered.select("track", (F.col("_no") - 1).alias("frame_no"), frames.sign_hash("embedding").alias("hash"), "embedding")

    def grids(self) -> DataFrame:
        """The grid that each track's features make: 8 by 8."""
        return self.table("embeddings").select(F.col("label").cast("bigint").alias("track")).distinct().withColumns(
            {"width": F.lit(8).cast("bigint"), "height": F.lit(8).cast("bigint")})

    def boxes(self) -> DataFrame:
        """Boxes of tracks, some of which reach over the grid or lie outside."""
        key = F.col("n_nationkey").cast("bigint")
        return self.table("nation").select(
            (key % 10).alias("track"), F.col("n_name").alias("box"), (F.col("n_regionkey") * 2 - 1).cast("bigint").alias("x"),
            (key % 6 - 1).alias("y"), (key % 5).alias("w"), (key % 4 + 1).alias("h"))
