"""Packing of token pieces into sequences by a configuration linear program."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespan.llm.texts import by_batch, whole
from cuespan.session import written

LENGTH = 1024
END = 2
SALTS = 64
EPSILON = 0.1
ROUNDS = 300
OVER_PROPORTION = 1.1

_loaded: dict[tuple, object] = {}


def _encoder(tokenizer: str, ranks: str | None):
    """Texts to ids, loaded once per Python worker.

    ``ranks``, if given, is the same vocabulary for a faster library. It takes only texts of plain
    characters without a special token in them, for which both libraries give the same ids.
    """
    if (tokenizer, ranks) not in _loaded:
        import re

        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer)
        encode = lambda t: slow.encode(t, add_special_tokens=False).ids
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            special = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]|<\\|")
            _loaded[tokenizer, ranks] = lambda t: encode(t) if special.search(t) else fast.encode_ordinary(t)
        else:
            _loaded[tokenizer, ranks] = encode
    return _loaded[tokenizer, ranks]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and an end id, documents longer than
    ``length`` cut into pieces of just that length, what is over coming first."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoder(tokenizer, ranks)
        at, rows = [], []
        for i, value in enumerate(batch.column(1)):
            ids = np.array(encode(value.as_py()) + [END], "<u4")
            first = len(ids) % length or length
            for k, begin in enumerate([0, *range(first, len(ids), length)]):
                part = ids[begin:(begin + length if k else first)]
                at.append(i)
                rows.append((k, begin, len(part), zlib.crc32(part.tobytes())))
        columns = [pa.array(c) for c in zip(*rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), columns[0].cast(pa.int32()), *columns[1:]],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", whole(text).alias("text")), make,
                    f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _any_fill(prices: np.ndarray, sizes: np.ndarray, room: int) -> dict[int, int]:
    """The knapsack without limits: how many of each of ``sizes`` fill ``room`` at the highest price."""
    best, last, worth = np.zeros(room + 1), np.zeros(room + 1, np.int64), prices[sizes]
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for at in range(1, room + 1):
        best[at] = best[at - 1]
        if upto[at]:
            tried = best[at - sizes[:upto[at]]] + worth[:upto[at]]
            i = tried.argmax()
            if tried[i] > best[at]:
                best[at], last[at] = tried[i], sizes[i]
    found: Counter[int] = Counter()
    at = room
    while at > 0:
        if last[at]:
            found[int(last[at])] += 1
        at -= int(last[at]) or 1
    return dict(found)


def best_fill(prices: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
    """The knapsack with no more of a length than are left."""
    found = _any_fill(prices, np.flatnonzero(left > 0), room)
    if all(n <= left[s] for s, n in found.items()):
        return found
    best, items, taken = np.zeros(room + 1), [], []
    for size in np.flatnonzero(left > 0):
        copies, most = 1, int(min(left[size], room // size))
        while most > 0:  # powers of two reach every number of copies
            use = min(copies, most)
            weight = use * int(size)
            better = np.zeros(room + 1, bool)
            tried = best[:room + 1 - weight] + use * prices[size]
            better[weight:] = tried > best[weight:] + 1e-15
            best[weight:] = np.where(better[weight:], tried, best[weight:])
            items.append((int(size), use, weight))
            taken.append(better)
            most, copies = most - use, copies * 2
    found, at = Counter(), room
    for (size, use, weight), better in zip(reversed(items), reversed(taken)):
        if better[at]:
            found[size] += use
            at -= weight
    return dict(found)


def plan(histogram: dict[int, int], room: int = LENGTH, epsilon: float = EPSILON, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """``(sequences, {length: copies in each})``: a packing of all lengths of ``histogram``.

    The linear program: use of configurations, as little as possible in sum, covering each length's count.
    Multiplicative weights price the lengths, at first a little more than in proportion so that long ones are
    not left over: the knapsack finds the configuration worth most, it is used until one of its lengths is covered
    once more, and what it covers gets cheaper. Use is scaled to cover nothing more than is there, rounded down and
    taken; the rest is filled at the mean prices, one configuration at a time as often as it fits. Work depends
    on ``room``, not on the counts.
    """
    counts = np.zeros(room + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    sizes, demand = np.flatnonzero(counts), np.maximum(counts, 1).astype(float)
    if not len(sizes):
        return []
    prices, mean = (np.arange(room + 1) / room) ** OVER_PROPORTION, np.zeros(room + 1)
    use: Counter[tuple] = Counter()
    covered = np.zeros(room + 1)
    for _ in range(rounds):
        chosen = _any_fill(prices, sizes, room)
        mean += prices / sum(prices[s] * n for s, n in chosen.items())  # no configuration is worth more than 1
        step = min(demand[s] / n for s, n in chosen.items())
        use[tuple(sorted(chosen.items()))] += step
        for s, n in chosen.items():
            covered[s] += step * n / demand[s]
            prices[s] *= (1 - epsilon) ** (step * n / demand[s])
    left, runs = counts.copy(), []

    def take(chosen: dict[int, int], most: int) -> None:
        times = min(most, *(int(left[s] // n) for s, n in chosen.items()))
        if times > 0:
            runs.append((times, chosen))
            for s, n in chosen.items():
                left[s] -= times * n

    for chosen, amount in sorted(use.items(), key=lambda x: (-x[1], x[0])):
        take(dict(chosen), int(amount / covered.max()))
    while left.any():
        take(best_fill(mean, left, room), int(left.sum()))
    return runs


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, end: int = END,
           text: str = "text", salts: int = SALTS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece of ``docs``.

    Null and empty texts are one piece of the end id. Rows may repeat, and each has its pieces. No rows
    give no rows. Other columns are not read. The driver sees only the histogram of at most ``length``
    lengths; pieces of a length are numbered in ``salts`` parts, so that a common length is no single task.
    """
    cut = written(pieces(docs, tokenizer, ranks, length, text).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.spark_partition_id()), F.lit(salts))))
    small = cut.where(F.col("length") < length)
    each = small.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, length)
    sequences = sum(times for times, _ in runs)
    lookup: list[tuple[int, int, int, int, int]] = []
    base: Counter[int] = Counter()
    begun = 0
    for times, chosen in runs:
        offset = 0
        for size, n in sorted(chosen.items(), reverse=True):
            lookup.append((size, base[size], begun, n, offset))
            base[size] += times * n
            offset += size * n
        begun += times
    table = np.array(sorted(lookup), np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
                row = table[np.searchsorted(keys, size << 48 | rank, side="right") - 1]
                nth = rank - row[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * size)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # At most length x salts rows, whatever the input.
    before = each.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    ranked = small.withColumn("nth", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(
        F.broadcast(before.select("length", "salt", "before")), ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = ranked.select(*columns, (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    alone = cut.where(F.col("length") == length).select(
        *columns, (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return shared.unionByName(alone)
