"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import itertools
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespan.llm.texts import by_batch, text_key, whole
from cuespan.session import drop_written, written, written_paths

RUN = 3
LEAST_WORDS = 20
LONG = 12
NEAR = 5
TURNS = 4

#: A sentence: up to a word that ends with a mark, to the end of its line, or of the text.
_SENTENCE = re.compile(r"\S(?:[^\n]*?[.!?][\"')\]]*(?!\S)|[^\n]*)")
_WORD = re.compile(r"\S+")
_BLANK = re.compile(r"\s*")


class _Ranks(dict):
    """A word's rank among possible cuts of a long sentence, the least first, worked out once for each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = rank = -1 if word[-1] in ",;:" else zlib.crc32(word.encode())
        return rank


_RANKS = _Ranks()


def _cuts(words: list[str], near: int = NEAR) -> list[int]:
    """The last word of each part of a long sentence: the word of least rank in each run of ``near`` words, the last
    of equal ones, and the end."""
    ranks, found, at = [_RANKS[w] for w in words], [], -1
    for end in range(near - 1, len(words)):
        first = end - near + 1
        if at < first:
            least = min(ranks[first:end + 1])
            at = end
            while ranks[at] != least:
                at -= 1
        elif ranks[end] <= ranks[at]:
            at = end
        if not found or found[-1] != at:
            found.append(at)
    if not found or found[-1] != len(words) - 1:
        found.append(len(words) - 1)
    return found


def sentences(text: str, long: int = LONG) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` in code points. A sentence ends at a word with a full stop, exclamation or
    question mark, and at a line break. One of over ``long`` words is cut further, after the word of least rank in each
    run of ``NEAR`` words: commas come first, then the least checksum. So no part has more than ``NEAR`` words, and
    cuts depend on the ``NEAR`` - 1 words to either side only: copies of a passage are cut alike, but for its ends,
    wherever they stand."""
    found: list[tuple[int, int, list[str]]] = []
    for m in _SENTENCE.finditer(text):
        start, words = m.start(), m.group().split()
        if len(words) <= long:
            found.append((start, start + len(m.group().rstrip()), words))
            continue
        plain, part, at = " ".join(words) == m.group(), 0, start
        for last in _cuts(words):
            own = words[part:last + 1]
            if plain:
                begin, at = at, at + sum(map(len, own)) + len(own) - 1
            else:
                begin = at = text.index(own[0], at)
                for word in own:
                    at = text.index(word, at) + len(word)
            found.append((begin, at, own))
            part, at = last + 1, at + plain
    return found


def spans(units: list[tuple[int, int, list[str]]], run: int = RUN, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``(hash, first, last)`` for each sentence: the run of ``run`` sentences from it on, more where that makes
    fewer than ``least`` words. Runs that the text is too short for are left out."""
    found = []
    upto = [0, *itertools.accumulate(len(words) for _, _, words in units)]
    digests = [xxhash.xxh64_digest(" ".join(words)) for _, _, words in units]
    end, size = run, len(units)
    for first in range(size - run + 1):
        end = max(end, first + run)
        while end < size and upto[end] - upto[first] < least:
            end += 1
        if upto[end] - upto[first] < least:
            break
        value = xxhash.xxh64_intdigest(b"".join(digests[first:end]))
        found.append((value - (1 << 64) if value >= 1 << 63 else value, first, end - 1))
    return found


def span_table(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """``(span, doc_id, text_key, start, end)``: each span with its place in code points."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, rows = [], []
        for value in batch.column(2):
            units = sentences(value.as_py())
            found = spans(units, run, least)
            counts.append(len(found))
            rows += [(span, units[first][0], units[last][1]) for span, first, last in found]
        owner = pa.array(np.repeat(np.arange(len(counts)), counts))
        table = np.array(rows, np.int64).reshape(-1, 3)
        span, *places = (pa.array(np.ascontiguousarray(table[:, i])) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [span, batch.column(0).take(owner), batch.column(1).take(owner), *(p.cast(pa.int32()) for p in places)],
            ["span", "doc_id", "text_key", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", text_key(text).alias("text_key"), whole(text).alias("text")), make,
                    f"span bigint, doc_id {kind}, text_key bigint, start int, end int")


def repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, text: str = "text", turns: int = TURNS) -> DataFrame:
    """``(doc_id, text_key, ranges)``: for rows with a repeated span that is not its first, the ranges
    ``(start, end)`` of such spans. First is the least ``(doc_id, text_key, start)``, nulls before all.

    Places go through the large shuffle in ``turns``, some spans in each, as only one turn's files lie on disk at a time."""
    spark = docs.sparkSession
    kept = set(written_paths(spark))
    found = written(span_table(docs, run, least, text))
    place = F.struct("doc_id", "text_key", "start")
    # Counts alone go through one large shuffle; places only to tell those of spans that come again.
    many = written(found.groupBy("span").agg(F.count("*").alias("n")).where("n > 1").select("span"))
    used = [p for p in written_paths(spark) if p not in kept]
    again = reduce(DataFrame.unionAll, [
        written(found.where(turn == i).join(many.where(turn == i), "span", "left_semi"))
        for turn in [F.pmod("span", F.lit(turns))] for i in range(turns)])
    drop_written(spark, used)
    firsts = written(again.groupBy("span").agg(F.min(place).alias("least")).select(F.col("span").alias("__span"), "least"))
    # Rows that are repeated whole have the same places: they are one document.
    later = again.join(firsts, F.col("span") == F.col("__span")).where(~place.eqNullSafe(F.col("least")))
    return later.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges"))


def remove_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, text: str = "text") -> DataFrame:
    """``(doc_id, n_removed, removed, text)`` per row of ``docs``: the text without the sentences that a repeated span
    covers anywhere but at its first place, the ranges taken out as ``start:end`` (code points, end exclusive,
    comma-joined, none overlapping) and their number.

    A passage stays where it stands first, by doc_id and then by place; spans repeated within a document count
    as well. Blank space goes with the sentence before it. Null texts count as empty; texts shorter than a span
    stay whole; rows that repeat a doc_id and its text are one document and come out alike; no rows give no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    before = set(written_paths(spark))
    later = written(repeated_spans(docs, run, least, text)).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "ranges")
    drop_written(spark, [p for p in written_paths(spark)[:-1] if p not in before])
    joined = docs.select("doc_id", text_key(text).alias("text_key"), whole(text).alias("text")).join(
        later, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        cuts, texts, lists = [[]] * batch.num_rows, [], batch.column(2)
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(sizes))
        starts, ends = (lists.flatten().field(x).to_pylist() for x in ("start", "end"))
        for i in np.flatnonzero(sizes).tolist():
            value, merged = batch.column(1)[i].as_py(), []
            for start, end in zip(starts[upto[i]:upto[i + 1]], ends[upto[i]:upto[i + 1]]):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            left, at = [], 0
            for start, end in merged:
                left.append(value[at:start])
                at = _BLANK.match(value, end).end()
            texts.append("".join(left) + value[at:])
            cuts[i] = merged
        # Texts that nothing was taken out of stay as they are.
        left_over = pc.replace_with_mask(batch.column(1), pa.array(sizes > 0), pa.array(texts, batch.column(1).type))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(c) for c in cuts], pa.int64()),
             pa.array([",".join(f"{a}:{b}" for a, b in c) for c in cuts], pa.string()), left_over],
            ["doc_id", "n_removed", "removed", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(joined.select("doc_id", "text", "ranges"), make,
                    f"doc_id {kind}, n_removed bigint, removed string, text string")
