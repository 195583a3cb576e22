"""Sharding by a two-pass external shuffle of whole records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuespan.llm.texts import key_filter, parted, rows_of, text_key, whole
from cuespan.session import written

SEED = 42
BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 100_000


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with ``doc_id`` is highest. One more shard takes only the rows for
    which its own hash beats all others. Null ids go together."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), doc_id).alias("hash"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*ranked) if shards > 1 else ranked[0])["shard"]


def size_of(text: str | Column = "text") -> Column:
    """UTF-8 bytes plus 1, null as empty."""
    return (F.octet_length(whole(text)) + 1).cast("bigint")


def shuffled(docs: DataFrame, shards: int = 8, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES,
             bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(shard, bucket, at, row)``: whole records of ``docs``, a random order of each bucket of each shard, ``at`` without
    gaps from 0.

    First pass: a record goes to a shard by ``shard_of`` and within it, by a second seeded hash, to one of so many
    buckets that one holds about ``bucket_bytes`` of text and ``bucket_rows`` rows. Second pass: each bucket, a
    task of its own, is put in the order of its keys and through a Fisher-Yates shuffle (the built-in ``shuffle``, whose
    seed is then that of the bucket).

    The order depends on the rows and the seed only, not on settings or the number of partitions. Rows that repeat a doc_id and its text are
    dealt over buckets by their place in the input, so that no bucket takes them all. Null texts count as empty; no
    rows give no rows. Other columns may have any name, and types that can be put in order.
    """
    keyed = docs.select(rows_of(docs), F.col("doc_id").alias("own"), text_key(text).alias("text_key"), size_of(text).alias("size"))
    groups = written(keyed.groupBy("own", "text_key").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    total = groups.agg(F.sum("size"), F.sum("n")).first()
    buckets = 1 + max((total[0] or 0) // (shards * bucket_bytes), (total[1] or 0) // (shards * bucket_rows))
    rows, again = keyed.drop("size").withColumn("nth", F.lit(0).cast("bigint")), groups.where("n > 1")
    if not again.isEmpty():
        copied, alone = parted(rows, key_filter(again, "own", "text_key"), "own", "text_key")
        rows = alone.unionByName(copied.withColumn("nth", F.monotonically_increasing_id()))
    dealt = rows.select(
        shard_of(F.col("own"), shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "own", "text_key", "nth"), F.lit(buckets)).cast("int").alias("bucket"), "own", "text_key", "row")
    return (
        dealt.withColumn("part", F.col("shard") * buckets + F.col("bucket")).repartitionById(shards * buckets, F.col("part"))
        .groupBy("part", "shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("own", "text_key", "row"))).alias("rows"))
        .select("shard", "bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("at", "one"))
        .select("shard", "bucket", "at", "one.row")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES,
                 bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes ``shuffled`` as a folder for each shard, with a file for each bucket; names sort in the buckets' order, and
    rows stand in their order within each."""
    shuffled(docs, shards, seed, text, bucket_bytes, bucket_rows).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``(shard, slot, row)`` of shards that ``write_shards`` has written from rows of ``schema``; slots have no gaps, from 0."""
    form = StructType().add("bucket", "integer").add("at", "integer").add("row", schema).add("shard", "integer")
    found = spark.read.schema(form).parquet(path)
    # One row for each bucket, written, so that the join knows its size.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(found.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select(
        F.col("shard").alias("__shard"), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")))
    return found.join(starts, (F.col("shard") == F.col("__shard")) & (F.col("bucket") == F.col("__bucket"))).select(
        "shard", (F.col("start") + F.col("at")).alias("slot"), "row")


def shard_report(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of shards written to ``path``, by reading them back."""
    write_shards(docs, path, shards, seed, text, bucket_bytes, bucket_rows)
    name = "row.`" + text.replace("`", "``") + "`"
    return read_shards(docs.sparkSession, path, docs.schema).select(
        "row.doc_id", size_of(F.col(name)).alias("size"), F.crc32(whole(F.col(name)).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("row.doc_id"), shards + 1, seed).alias("grown_shard"))
