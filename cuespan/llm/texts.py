"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.session import ship, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z in lower case and every other character as it is. ``lower`` does just that to
    plain ASCII and is much faster there than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(whole(text))


#: Filters of keys have 2 to this power of bits, in rows of 64.
FILTER_BITS = 26


def rows_of(docs: DataFrame) -> Column:
    """All columns of ``docs``, whatever their names, as one: ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def key_filter(keys: DataFrame, *key: str | Column) -> DataFrame:
    """``(bucket, mask)``: a bit for each key. At most 2 to the power of ``FILTER_BITS`` - 6 rows, so that it may be broadcast."""
    place = F.xxhash64(*key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return written(
        keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("bucket"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("bucket").agg(F.bit_or("bit").alias("mask")))


def parted(rows: DataFrame, keys: DataFrame, *key: str | Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is in the filter ``keys``, as all rows with a key that went into it are, and the others.

    The others need not meet the table of keys at all, so they need no shuffle.
    """
    names = keys.select(F.col("bucket").alias("__bucket"), F.col("mask").alias("__mask"))
    placed = rows.withColumn("__place", F.xxhash64(*key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    met = placed.join(F.broadcast(names), F.shiftright("__place", 6) == F.col("__bucket"), "left")
    inside = F.coalesce(F.expr("__mask & shiftleft(1L, cast(__place & 63 as int))"), F.lit(0)) != 0
    return met.where(inside).select(rows.columns), met.where(~inside).select(rows.columns)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives memory that this worker has freed back to the system: workers live on for other stages and should not hold
    what this one needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets an Arrow batch of this session end at 4 MB, unless a limit has been set: texts are long, and an executor and its
    workers hold some batches of each task, of up to 64 MB else."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, "4m")


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df`` with ``make`` applied to each of its Arrow batches, on executors that have been given the package."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield make(batch)
                give_back()

    return df.mapInArrow(run, schema)
