"""Exact dedup that takes the most frequent digests out of the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.texts import key_filter, lowered, parted, rows_of, whole
from cuespan.session import written

HEAVY = 256
TRACKED = 8192


def text_digest(text: str = "text") -> Column:
    """SHA-256, in hex, of the text with A-Z in lower case; null counts as empty."""
    return F.sha2(lowered(whole(text)), 256)


def _heavy_winners(digests: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """``(digest, keep_id, group_size)`` of at most ``heavy`` digests.

    The frequent-items sketch is a mergeable Misra-Gries summary of ``tracked`` counters, so a digest
    with more than about 1/``tracked`` of the rows cannot escape it. Its counts are estimates: what the
    candidates really have is counted again, over all rows.
    """
    found = written(
        digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
        .select(F.explode("top.item").alias("digest")))
    return written(
        digests.join(F.broadcast(found), "digest").groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))


def exact_groups(docs: DataFrame, text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` per row of ``docs``.

    Texts are equal if identical with A-Z in lower case; null counts as empty. The largest doc_id of
    equal texts stays (a null one only if the group has no other). A row that repeats a doc_id with the same
    text counts in ``group_size`` and is marked like its twin. No rows give no rows. Other columns are
    not read.

    At most ``heavy`` winners are broadcast, so frequent digests never cross the network; what is left has no
    group above about 1/``tracked`` of the rows and is grouped by an ordinary shuffle of short rows.
    """
    digests = written(docs.select("doc_id", text_digest(text).alias("digest")))
    winners = _heavy_winners(digests, heavy, tracked)
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("digest", "doc_id", F.max("doc_id").over(group).alias("keep_id"),
                       F.count("*").over(group).alias("group_size"))
    return hot.unionByName(rest).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact_copies(docs: DataFrame, text: str = "text", heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``docs`` with one row for each distinct text, columns as they are, whatever their names: the one that
    ``exact_groups`` keeps. Rows repeated whole leave one; no rows give no rows.

    A filter of the digests that have several rows tells which rows may have copies. Rows without stay where they are.
    """
    groups = exact_groups(docs, text, heavy, tracked)
    several = written(groups.where("group_size > 1 and kept").select("digest", "keep_id", "group_size").distinct())
    rows = docs.select(rows_of(docs), text_digest(text).alias("digest"))
    copied, alone = parted(rows, key_filter(several, "digest"), "digest")
    kept = F.col("keep_id").isNull() & F.col("group_size").isNull() | F.col("row.doc_id").eqNullSafe(F.col("keep_id"))
    winners = several.orderBy(F.desc("group_size")).limit(heavy)
    # Losers of the largest groups go before the shuffle.
    left = copied.join(F.broadcast(winners), "digest", "left").where(kept).select("row", "digest")
    one = Window.partitionBy("digest").orderBy(F.lit(1))
    met = left.join(several.hint("merge"), "digest", "left").where(kept).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return alone.select("row.*").unionByName(met.select("row.*"))
