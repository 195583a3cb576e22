"""Hooks for models: batches of text, batches of items, and clips, with retries and checks.

The model is a callable given by the user; calls run side by side, one per batch row, and
order is restored by (track, batch, pos).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuespan.folds import slices
from cuespan.functions import text as rules
from cuespan.session import drop_written, mounted, path_exists, shared_dir, shuffles_dropped, written, written_paths
from cuespan.sources.srt import blocks_to_cues

PAYLOAD_TAG = "TRANSLATE_TEXT"


class IntegrityError(RuntimeError):
    """A reply that cannot be used: empty, without payload, or with another number of blocks."""


def _milliseconds(stamp: str) -> int | None:
    parts = stamp.strip().replace(",", ".").split(":")
    try:
        return int((int(parts[0]) * 3600 + int(parts[1]) * 60 + float(parts[2])) * 1000) if len(parts) > 2 else None
    except ValueError:
        return None


def usable_blocks(payload: str) -> int:
    """How many blocks of a payload ``merge_replies`` can use: with a number, two stamps the later of which comes
    second, and some text beside plain tags."""
    usable = 0
    for block in re.split(r"\n\s*\n", payload.strip().replace("\r\n", "\n")):
        lines = block.strip().splitlines()
        if len(lines) < 2 or not re.fullmatch(r"\s*[+-]?\d+\s*", lines[0]) or "-->" not in lines[1]:
            continue
        start, end = (_milliseconds(s) for s in lines[1].split("-->")[:2])
        text = re.sub(r"</?[a-zA-Z]+>", "", "\n".join(lines[2:]))
        usable += start is not None and end is not None and start < end and bool(text.strip())
    return usable


def reply_problem(reply: str, blocks: int) -> None:
    """Raise IntegrityError unless the reply's payload holds that many usable subtitle blocks."""
    bare = re.sub(r"<think>.*?</think>", "", reply, flags=re.I | re.S)
    payload = re.search(rf"<{PAYLOAD_TAG}>(.*?)(?:</{PAYLOAD_TAG}>|\Z)", bare, re.S | re.I)
    if payload is None:
        raise IntegrityError(f"no <{PAYLOAD_TAG}> in the reply")
    usable = usable_blocks(payload.group(1))
    if usable != blocks:
        raise IntegrityError(f"{usable} blocks for {blocks}")


class _Kept:
    """A task's replies by ``message_key``, on disk after every ``rows`` of them, for the task that runs in its place should it be
    lost. Each attempt adds to a file of its own in the partition's folder, and knows what those before it have kept."""

    def __init__(self, folder: str, rows: int, schema: pa.Schema):
        own = f"{folder}/{TaskContext.get().partitionId()}"
        os.makedirs(own, exist_ok=True)
        self.known: dict[str, tuple] = {}
        for name in os.listdir(own):
            with open(f"{own}/{name}", "rb") as file:
                try:
                    for batch in pa.ipc.open_stream(file):
                        keys, *told = (c.to_pylist() for c in batch.columns)
                        self.known.update(zip(keys, zip(*told)))
                except (pa.ArrowInvalid, OSError):  # the lost task was writing here
                    pass
        self.path, self.rows, self.schema = f"{own}/{uuid.uuid4().hex}", rows, schema
        self.file = self.stream = None
        self.open: list[tuple] = []

    def add(self, key: str, told: tuple) -> None:
        self.open.append((key, *told))
        if len(self.open) >= self.rows:
            self.store()

    def store(self) -> None:
        if self.open:
            if self.file is None:
                self.file = open(self.path, "wb")
                self.stream = pa.ipc.new_stream(self.file, self.schema)
            self.stream.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*self.open), self.schema)], schema=self.schema))
            self.file.flush()
            self.open = []

    def close(self) -> None:
        self.store()
        if self.file is not None:
            self.file.close()


def call_batches(
    messages: DataFrame,
    model: Callable[[], Callable[[str], str]],
    check: Callable[[str, int], None] | None = None,
    attempts: int = 3,
    parallel: int | None = None,
    kept: str | None = None,
    kept_rows: int = 8,
) -> DataFrame:
    """Send each batch's ``message`` to a model: adds ``reply, status, attempts, error``.

    ``model`` makes the callable, once per task. ``check(reply, blocks)`` may raise
    IntegrityError, which is tried again up to ``attempts`` times; any other error ends the
    batch at once. ``parallel`` spreads the batches over that many tasks. The task of
    a lost executor runs again, and so sends its messages again; with ``kept``, a folder that executors share and can open
    as files, the last ``kept_rows`` at most, as replies are stored there by ``message_key`` meanwhile.

    Where messages bring a ``context``, it goes in place of ``{context_block}``, unless the callable has a
    ``preload(context)`` that says True: then it has been told, and the place stays empty. It is asked once for
    each context in a row.
    """
    tries = max(1, int(attempts))
    names = messages.columns
    at_message, at_blocks = names.index("message"), names.index("blocks")
    at_context = names.index("context") if "context" in names else None
    at_key = names.index("message_key") if kept else None

    def one(call, message: str, blocks: int):
        for n in range(1, tries + 1):
            try:
                reply = call(message)
                if not reply:
                    raise IntegrityError("empty reply")
                if check is not None:
                    check(reply, blocks)
                return reply, "ok", n, None
            except IntegrityError as e:
                problem = str(e)
            except Exception as e:  # noqa: BLE001 - any model error fails this batch only
                return None, "failed", n, str(e)
        return None, "failed", tries, problem

    told_fields = T.StructType.fromDDL("reply string, status string, attempts int, error string")
    schema = T.StructType([*messages.schema.fields, *told_fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = told = None
        loaded = False
        ledger = _Kept(kept, kept_rows, pa.schema([pa.field("message_key", pa.string()), *list(arrow)[len(names):]])) if kept else None
        for whole in batches:
            if call is None and whole.num_rows:
                call = model()
            # Messages and contexts are Python values for a slice at a time; all columns pass through as they are.
            texts = [whole.column(i) for i in (at_message, at_context) if i is not None]
            for batch in slices(whole, *texts):
                done = []
                contexts = batch.column(at_context) if at_context is not None else [None] * batch.num_rows
                keys = batch.column(at_key).to_pylist() if kept else [None] * batch.num_rows
                for message, blocks, context, key in zip(batch.column(at_message), batch.column(at_blocks), contexts, keys):
                    if kept and key in ledger.known:
                        done.append(ledger.known[key])
                        continue
                    message = message.as_py()
                    if at_context is not None:
                        context = context.as_py() or ""
                        if context != told:
                            told, loaded = context, hasattr(call, "preload") and bool(call.preload(context))
                        message = message.replace("{context_block}", "" if loaded else context)
                    done.append(one(call, message, blocks.as_py()))
                    if kept:
                        ledger.add(key, done[-1])
                made = [pa.array(list(c), f.type) for c, f in zip(zip(*done), list(arrow)[len(names):])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)
        if kept:
            ledger.close()

    spread = messages.repartition(parallel, "track", "batch") if parallel else messages
    # Batches of one track in a row share what was preloaded.
    spread = spread.sortWithinPartitions("track", "batch") if at_context is not None else spread
    return spread.mapInArrow(run, schema)


REPLY = ("reply", "status", "attempts", "error")


def call_once(
    messages: DataFrame,
    model: Callable[[], Callable[[str], str]],
    ledger: str,
    check: Callable[[str, int], None] | None = None,
    attempts: int = 3,
    rows_per_task: int = 8,
    rows_per_round: int = 10_000,
) -> DataFrame:
    """As ``call_batches``, but each message is sent once, however often this runs: replies are kept in ``ledger``, a
    folder that executors share, by a hash of the message.

    What the ledger has answered is taken from there; equal messages are one. The rest is sent in rounds of about
    ``rows_per_round``, which are added to the ledger one after the other, so a run that breaks off loses one round at
    most. Within a round, replies are stored beside the ledger until the round is, after every ``rows_per_task``; a task that
    is lost sends these again at most. Where tasks cannot open files of the shared folder themselves, each of them has no
    more than that many messages, and stores its replies as a table when it is done.
    Failed messages are in the ledger too, and are sent again by the next run.
    """
    spark = messages.sparkSession
    named = [c for c in ("message", "context", "blocks") if c in messages.columns]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in named]
    lengths = [F.char_length(p).cast("string") for p in parts]
    keyed = messages.withColumn("message_key", F.sha2(F.concat_ws("\n", *lengths, *parts), 256))
    todo, run = keyed.dropDuplicates(["message_key"]), 0
    if path_exists(spark, ledger):
        before = spark.read.parquet(ledger)
        run = before.agg(F.max("run")).first()[0] + 1
        todo = todo.join(before.filter("status = 'ok'").select("message_key").distinct(), "message_key", "left_anti")
    ours = len(written_paths(spark))
    todo = written(todo)
    count = todo.count()
    rounds = -(-count // rows_per_round)
    if rounds > 1:
        # A folder for each round, which then reads its own messages only.
        todo = written(todo.withColumn("_round", F.pmod(F.xxhash64("message_key"), F.lit(rounds))).repartition("_round"), by=["_round"])
        drop_written(spark, written_paths(spark)[ours:-1])
    for number in range(rounds):
        own = todo.filter(F.col("_round") == number).drop("_round") if rounds > 1 else todo
        tasks = max(1, -(-count // (rounds * rows_per_task)))
        before = len(written_paths(spark))
        beside = f"{shared_dir(spark)}/cuespan-{uuid.uuid4().hex}"
        # The ledger gets a round's replies in one file, as it is read whole by every run.
        if folder := mounted(spark, beside):
            # A few tasks for each core, as a task costs as much as hundreds of rows.
            tasks = min(tasks, 4 * spark.sparkContext.defaultParallelism)
            answered = call_batches(own, model, check, attempts, tasks, folder, rows_per_task).select("message_key", *REPLY).repartition(1)
        else:
            answered = written(call_batches(own, model, check, attempts, parallel=tasks).select("message_key", *REPLY)).coalesce(1)
        with shuffles_dropped(spark):
            answered.withColumn("run", F.lit(run)).write.mode("append").parquet(ledger)
        drop_written(spark, [*written_paths(spark)[before:], beside])
    drop_written(spark, written_paths(spark)[ours:])
    if not path_exists(spark, ledger):
        return call_batches(messages.filter("false"), model, check, attempts)
    # An answer stands before a failure, and a later one before an earlier.
    kept = spark.read.parquet(ledger).groupBy("message_key").agg(
        F.max_by(F.struct(*REPLY), F.struct(F.col("status") == "ok", "run")).alias("kept"))
    return keyed.join(kept, "message_key").select(*messages.columns, *[f"kept.{c}" for c in REPLY])


def merge_replies(batched: DataFrame, replies: DataFrame, payload: bool = True) -> DataFrame:
    """Put replied texts in place of the originals, by position within the batch.

    A reply holds subtitle blocks, as many as its batch has; if not, or if there is no
    usable reply, the whole batch keeps its texts. Adds ``status`` (ok, mismatch, failed).
    ``replies``: ``track, batch, reply``; with ``payload`` the blocks stand in a tag.
    """
    body = rules.tagged_payload("reply", PAYLOAD_TAG) if payload else F.col("reply")
    told = replies.select("track", "batch", body.alias("content"))
    parsed = blocks_to_cues(told, ["track", "batch"])
    # One reply answers one batch, so these groups are as small as batches are.
    answers = parsed.groupBy("track", "batch").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_answers"),
    )
    sizes = batched.groupBy("track", "batch").agg(F.count(F.lit(1)).alias("_size"))
    verdict = (
        sizes.join(told.select("track", "batch", F.col("content").isNotNull().alias("_told")), ["track", "batch"], "left")
        .join(answers, ["track", "batch"], "left")
        .withColumn(
            "status",
            F.when(~F.coalesce("_told", F.lit(False)), "failed")
            .when(F.coalesce(F.size("_answers"), F.lit(0)) == F.col("_size"), "ok")
            .otherwise("mismatch"),
        )
        .select("track", "batch", "status", F.when(F.col("status") == "ok", F.col("_answers")).alias("_answers"))
    )
    answer = F.get(F.col("_answers"), F.col("pos").cast("int"))["text"]
    joined = batched.join(verdict, ["track", "batch"])
    return joined.withColumn("text", F.coalesce(answer, F.col("text"))).select(*batched.columns, "status")


def recognise(
    items: DataFrame, item: str, model: Callable[[], Callable[[list], list[str]]], batch_size: int = 4
) -> DataFrame:
    """Add ``text`` from a batch recogniser. An item that is NULL gives ''; a batch that fails
    gives '' for all its items. The model is loaded once per task."""
    schema = T.StructType([*items.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in batches:
            if call is None and len(pdf):
                call = model()
            given, texts = list(pdf[item]), []
            for at in range(0, len(given), batch_size):
                part = given[at : at + batch_size]
                valid = [x for x in part if x is not None]
                try:
                    replies = iter(call(valid) if valid else [])
                    texts += ["" if x is None else (next(replies) or "") for x in part]
                except Exception:  # noqa: BLE001 - a failed batch yields no text
                    texts += [""] * len(part)
            yield pdf.assign(text=texts)

    return items.mapInPandas(run, schema)


def make_clips(
    queue: DataFrame, model: Callable[[], Callable[[str], int]], finished: DataFrame | None = None
) -> DataFrame:
    """Make a clip for every cue that has text and no finished clip: ``track, clip_no,
    clip_ms, ok``. ``queue`` and ``finished`` have ``track, clip_no``; running it again after
    a loss only makes what is missing."""
    todo = queue.filter(rules.strip("text") != "").select("track", "clip_no", "text")
    if finished is not None:
        todo = todo.join(finished.select("track", "clip_no"), ["track", "clip_no"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in batches:
            if call is None and len(pdf):
                call = model()
            lengths, fine = [], []
            for text in pdf["text"]:
                try:
                    lengths.append(int(call(text)))
                    fine.append(True)
                except Exception:  # noqa: BLE001 - counted as an error, others go on
                    lengths.append(None)
                    fine.append(False)
            yield pdf[["track", "clip_no"]].assign(clip_ms=pd.array(lengths, dtype="Int64"), ok=fine)

    kind = queue.schema["track"].dataType.simpleString()
    return todo.mapInPandas(run, f"track {kind}, clip_no bigint, clip_ms bigint, ok boolean")
