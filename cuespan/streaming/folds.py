"""Folds over streams: the state of each track is kept between micro-batches.

Rows of a track wait, in its state, until the watermark has passed them; only then do they go, in order, through
the same fold that batch jobs use. So rows may come in any order within the delay. Each micro-batch gives out what
is settled, marked ``settled``, and beside it what the waiting rows and the open end would come to as things stand;
a track's later ``version`` replaces these. Rows older than the watermark are not used: Spark drops them and counts
them in its progress report, and what reaches the state all the same is counted in ``late``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuespan.folds import Fold
from cuespan.session import shared_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Waiting rows that are one value of the state. The first of them lie beside the fold.
_ROWS_KEPT = 500
_EPOCH, _MS = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(milliseconds=1)


def _in_ms(at: datetime) -> int:
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - _EPOCH) // _MS


class _FoldProcessor(StatefulProcessor):
    """Takes a row's ``given`` values, named by their places, as one value, ``_told``, and gives a row for each call that has output,
    with all of it as one value, ``_made``: what values and calls cost besides the fold is most of the work."""

    def __init__(
        self, fold: Fold, columns: Sequence[str], order: Sequence[str], names: Sequence[str], idle_ms: int | None, keys: Sequence[str],
        given: Sequence[str], floats: Sequence[str],
    ):
        self.fold, self.names, self.idle_ms, self.keys = fold, list(names), idle_ms, list(keys)
        self.columns, self.order = ([str(given.index(n)) for n in some] for some in (columns, order))
        self.floats = [str(given.index(n)) for n in floats]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        told = T.StructType([T.StructField("json", T.StringType())])
        self.state = handle.getValueState("fold", told)
        self.waiting = handle.getListState("waiting", told)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        water = timerValues.getCurrentWatermarkInMs()
        times, told, late = [], [], 0
        for *_, time, values in rows:
            at = _in_ms(time)
            if 0 < water and at <= water:
                late += 1
            else:
                times.append(at)
                told.append(values)
        come = []
        for at, row in zip(times, json.loads(f"[{','.join(told)}]")):
            for i in self.floats:
                row[i] = _number(row[i])
            come.append([at, [row[i] for i in self.order], [row[i] for i in self.columns]])
        yield from self._advance(key, water, come, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs(), [], 0)

    def _advance(self, key, water: int, come: list, late: int) -> Iterator[Row]:
        held = self.state.get()
        state, seen, version, all_late, shown, rows, more = json.loads(held[0]) if held else (self.fold.fresh(), 0, 0, 0, False, [], False)
        if more:
            rows += [row for some in self.waiting.get() for row in json.loads(some[0])]
        rows = sorted(rows + come, key=lambda r: r[1])
        seen = max([seen, *(r[0] for r in come)])
        settled, waiting = [], []
        for row in rows:
            if 0 < water and row[0] <= water:
                state, closed = self.fold.step(state, tuple(row[2]))
                settled += closed
            else:
                waiting.append(row)
        over = self.idle_ms is not None and not waiting and seen + self.idle_ms <= water
        if over:
            settled += self.fold.finish(state)
            open_ = []
        else:
            open_, ahead = [], json.loads(json.dumps(state))
            for row in waiting:
                ahead, closed = self.fold.step(ahead, tuple(row[2]))
                open_ += closed
            open_ += self.fold.finish(ahead)
        version, all_late = version + 1, all_late + late
        rest = waiting[_ROWS_KEPT:]
        if over:
            self.state.clear()
        else:
            self.state.update((json.dumps([state, seen, version, all_late, bool(open_), waiting[:_ROWS_KEPT], bool(rest)]),))
            if waiting:
                self.handle.registerTimer(min(r[0] for r in waiting))
            elif self.idle_ms is not None:
                self.handle.registerTimer(seen + self.idle_ms)
        if rest:
            self.waiting.put([(json.dumps(rest[i:i + _ROWS_KEPT]),) for i in range(0, len(rest), _ROWS_KEPT)])
        elif more:
            self.waiting.clear()
        out = [(True, *r) for r in settled] + [(False, *r) for r in open_]
        if not open_ and shown or late and not out:  # what was shown before no longer stands
            out.append((None, *[None] * len(self.names)))
        if out:
            names = ["settled", *self.names]
            made = json.dumps([dict(zip(names, r)) for r in out])
            yield Row(**dict(zip(self.keys, key)), version=version, late=all_late, _made=made)

    def close(self) -> None:
        pass


def _number(value):
    """What Spark's JSON keeps of floats, as a value; no number is null, but not in lists."""
    if isinstance(value, list):
        return [float(v) if isinstance(v, str) else v for v in value]
    return (None if value == "NaN" else float(value)) if isinstance(value, str) else value


def stream_fold(
    stream: DataFrame, fold: Fold, columns: Sequence[str], order: Sequence[str], schema: str,
    time: str = "ts", delay: str = "10 minutes", idle_ms: int | None = None, keys: Sequence[str] = ("track",),
) -> DataFrame:
    """Fold each track of a stream; ``order`` must follow ``time``. Rows may be ``delay`` behind the newest. ``keys`` name
    what is folded for itself: a track, or, say, a track and a box.

    With ``idle_ms``, a track without rows for so long is settled and forgotten; one that comes back starts anew.
    """
    body = T.StructType.fromDDL(schema)
    told = [T.StructField("version", T.LongType()), T.StructField("late", T.LongType()), T.StructField("_made", T.StringType())]
    out = T.StructType([*[stream.schema[k] for k in keys], *told])
    made = T.ArrayType(T.StructType([T.StructField("settled", T.BooleanType()), *body.fields]))
    given = list(dict.fromkeys([*columns, *order]))
    floats = [n for n in given if re.search("float|double", stream.schema[n].dataType.simpleString())]
    values = F.to_json(F.struct(*[F.col(n).alias(str(i)) for i, n in enumerate(given)]), {"ignoreNullFields": "false"})
    return (
        stream.select(*keys, F.col(time).alias("_time"), values.alias("_told")).withWatermark("_time", delay).groupBy(*keys).transformWithState(
            statefulProcessor=_FoldProcessor(fold, columns, order, body.names, idle_ms, keys, given, floats),
            outputStructType=out, outputMode="Append", timeMode="EventTime",
        ).select(*keys, "version", "late", F.inline(F.from_json("_made", made, {"mode": "FAILFAST"})))
    )


def latest(rows: DataFrame, keys: Sequence[str] = ("track",)) -> DataFrame:
    """What a streamed fold has come to: all that is settled, and the rest as of each track's last version."""
    last = rows.groupBy(*keys).agg(F.max("version").alias("_last"))
    kept = rows.join(last, list(keys)).filter("settled or (not settled and version = _last)")
    return kept.drop("version", "late", "settled", "_last")


@contextmanager
def _rocksdb(spark: SparkSession):
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_to_end(stream: DataFrame) -> DataFrame:
    """Process all there is now, writing to a table in the shared folder; give that table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/cuespan-stream-{uuid.uuid4().hex}"
    with _rocksdb(spark):
        running = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
            .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def stored_in_parts(df: DataFrame, by: str, parts: int) -> str:
    """Write ``df`` in ``parts`` files, one after the other, of consecutive ranges of ``by``; give the folder, for ``file_stream``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/cuespan-parts-{uuid.uuid4().hex}"
    low, high = df.agg(F.min(by), F.max(by)).first()
    part = F.least(F.floor((F.col(by) - low) * parts / (high - low + 1)), F.lit(parts - 1)) if low is not None else F.lit(0)
    for number in range(parts):
        df.filter(part == number).coalesce(1).write.mode("append").parquet(folder)
    return folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream of a parquet table: one file, or a folder of files. Files come by their age, which must be the order of time
    then: what comes behind the watermark is not used. ``files_per_batch=None`` takes all there are at once, in any order."""
    # A path without a pattern would have to be a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)
