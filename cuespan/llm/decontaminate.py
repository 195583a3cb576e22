"""Benchmark decontamination over a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.texts import by_batch, give_back, key_filter, parted, rows_of, text_key, whole
from cuespan.session import ship, written

WINDOW = 13
ANCHORS = 3
BLOCK_TERMS = 500_000
#: Digits, letters and everything beyond ASCII make words; the rest parts them.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The term under which the index keeps each row's number of words.
SIZE = ""


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, window_id, terms)``: each item's runs of ``window`` words, or all of its words if fewer."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, runs = [], []
        for i, value in enumerate(batch.column(1)):
            words = words_of(value.as_py())
            for j in range(max(1, len(words) - window + 1) if words else 0):
                at.append(i)
                runs.append([w.decode() for w in words[j:j + window]])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(runs, pa.list_(pa.string()))], ["item_id", "terms"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return by_batch(benchmark.select("item_id", whole("text").alias("text")), make,
                    f"item_id {kind}, terms array<string>").select(
        "item_id", F.xxhash64("terms").alias("window_id"), "terms").distinct()


def positional_index(docs: DataFrame, terms: DataFrame, text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Postings ``(term, doc_id, text_key, positions)`` of all words of ``docs`` that are in ``terms``, and for
    each row its number of words as the one position of ``SIZE``.

    Terms are given to tasks ``block_terms`` at a time at most; more of them take more passes over the texts.
    """
    ship(docs.sparkSession)
    total = terms.count()
    blocks = 1 + max(0, total - 1) // block_terms
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block) if blocks > 1 else terms
        known = sorted(r[0] for r in own.collect())
        shared = docs.sparkSession.sparkContext.broadcast(known)
        made = docs.select("doc_id", text_key(text).alias("text_key"), whole(text).alias("text")).mapInArrow(
            _postings(shared, block == 0), f"term string, doc_id {kind}, text_key bigint, positions array<int>")
        index = made if index is None else index.unionByName(made)
    return written(index)


def _postings(shared, sizes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids = {t.encode(): i for i, t in enumerate(known)}
        names = pa.array([*known, SIZE], pa.string())
        find = ids.get
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                rows, found, places, counts = [], [], [], []
                for i, value in enumerate(batch.column(2)):
                    words = words_of(value.as_py())
                    own = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
                    place = np.flatnonzero(own >= 0)
                    rows.append(np.full(len(place), i))
                    found.append(own[place])
                    places.append(place)
                    counts.append(len(words))
                row, term, place = (np.concatenate(x) for x in (rows, found, places))
                key = row * len(names) + term
                order = np.argsort(key, kind="stable")
                key, place = key[order], place[order]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                if sizes:
                    n = len(counts)
                    owner = np.concatenate([key[starts] // len(names), np.arange(n)])
                    term = np.concatenate([key[starts] % len(names), np.full(n, len(known))])
                    offsets = np.concatenate([starts, len(place) + np.arange(n + 1)])
                    place = np.concatenate([place, counts])
                else:
                    owner, term, offsets = key[starts] // len(names), key[starts] % len(names), np.append(starts, len(place))
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(term)), batch.column(0).take(owner), batch.column(1).take(owner),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place.astype(np.int32)))],
                    ["term", "doc_id", "text_key", "positions"])
            give_back()

    return run


def _adjusted(lists: DataFrame) -> DataFrame:
    """Where a window would begin, by each position of its term."""
    return lists.withColumn("start", F.explode("positions")).withColumn("start", F.col("start") - F.col("at")).where("start >= 0")


def phrase_matches(index: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """``(doc_id, text_key, window_id, start, size)``: every place where a window's terms stand in a row.

    The lists of a window's ``anchors`` rarest terms, adjusted by their offsets, are intersected first. Places
    that are in all of them are checked against the lists of the other terms.
    """
    distinct = windows.select("window_id", "terms").distinct()
    parts = distinct.select("window_id", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    # A table, so that words that stand in very many windows can be split in the join.
    common = written(index.where(F.col("term") != SIZE).groupBy("term").agg(F.sum(F.size("positions")).alias("common")))
    # A window with a term that no document has cannot match.
    ranked = parts.join(common, "term").withColumns({
        "here": F.count("*").over(Window.partitionBy("window_id")),
        "nth": F.row_number().over(Window.partitionBy("window_id").orderBy("common", "at"))}).where("here = size")
    ranked = written(ranked.drop("here", "common"))
    rare = ranked.where(F.col("nth") <= anchors)
    row = ["doc_id", "text_key", "window_id", "start"]
    # Rows that repeat a doc_id and its text have a list each: which terms are there counts, not how often.
    places = written(
        _adjusted(index.join(rare, "term")).groupBy(*row, "size").agg(F.bit_or(F.expr("shiftleft(1L, nth - 1)")).alias("n"))
        .where(F.bit_count("n") == F.least("size", F.lit(anchors))).drop("n"))
    rest = places.join(ranked.where(F.col("nth") > anchors).select("window_id", "at", "term"), "window_id")
    lists = index.where(F.col("term") != SIZE).select("term", F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "positions")
    checked = (
        rest.join(lists, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key"))
                  & (rest["term"] == lists["term"]))
        .where(F.array_contains("positions", (F.col("start") + F.col("at")).cast("int")))
        .groupBy(*row, "size").agg(F.size(F.collect_set("at")).alias("n")).where(F.col("n") == F.col("size") - anchors).drop("n")
    )
    return places.where(F.col("size") <= anchors).unionByName(checked)


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """``(doc_id, text_key, term, other, start, end)`` where the terms of ``pairs`` ``(term, other)`` stand at most
    ``within`` words apart: each position of ``term`` with the nearest one of ``other``."""
    left = index.join(pairs, "term").select("doc_id", "text_key", "term", "other", F.explode("positions").alias("start"))
    right = index.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), F.col("term").alias("__term"), "positions")
    near = left.join(right, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key"))
                     & (F.col("other") == F.col("__term")))
    gaps = F.transform("positions", lambda p: F.struct(F.abs(p - F.col("start")).alias("gap"), p.alias("end")))
    nearest = F.array_min(F.filter(gaps, lambda g: g["gap"] > 0))
    return near.withColumn("nearest", nearest).where(F.col("nearest.gap") <= within).select(
        "doc_id", "text_key", "term", "other", "start", F.col("nearest.end").alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated)`` per row of ``docs``.

    A word is hit if some occurrence of a window covers it; a row is contaminated if a twentieth of its words
    or more are hit. Null and empty texts have no words and are clean. Rows that repeat a doc_id with
    another text are judged by their own text; identical rows alike. No benchmark, no hits. Other columns
    are not read.
    """
    windows = written(item_windows(benchmark, window))
    index = positional_index(docs, windows.select(F.explode("terms").alias("term")).distinct(), text)
    matches = written(phrase_matches(index, windows))
    key = ["doc_id", "text_key"]
    hit = matches.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.expr("sequence(start, start + size - 1)"))))).cast("bigint").alias("n_hit"))
    items = (
        matches.select(*key, "window_id").distinct().join(windows.select("window_id", "item_id"), "window_id")
        .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    found = hit.join(items, (hit["doc_id"].eqNullSafe(items["doc_id"])) & (hit["text_key"] == items["text_key"])).select(
        hit["doc_id"].alias("__doc"), hit["text_key"].alias("__key"), "n_hit", "items")
    rows = index.where(F.col("term") == SIZE).select(*key, F.col("positions")[0].cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    judged = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left").select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"))
    return judged.select(
        *key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, columns as they are: see ``contamination``. Rows without words stay."""
    bad = written(contamination(docs, benchmark, window, text).where("contaminated").select("doc_id", "text_key").distinct())
    rows = docs.select(rows_of(docs), F.col("doc_id").alias("own_id"), text_key(text).alias("own_key"))
    hit, clean = parted(rows, key_filter(bad, "doc_id", "text_key"), "own_id", "own_key")
    missed = hit.join(bad, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left_anti")
    return clean.select("row.*").unionByName(missed.select("row.*"))
