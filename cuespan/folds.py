"""Ordered folds: logic where each row depends on a small state left by the rows before.

Rows are shuffled and sorted by Spark and streamed through the fold batch by batch, so
memory holds one state, never a whole track. A track too long for one task is cut into
consecutive pieces that are folded side by side from a guessed (fresh) state; a piece
whose true incoming state turns out different is folded again, until no incoming state
changes. That ends after as many rounds as there are pieces at worst, and after two when
states forget their past within a piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuespan.sequence import pieces, too_long


class Fold:
    """One left-to-right pass. States must survive ``json.dumps``/``loads`` unchanged."""

    def fresh(self):
        """State before the first row of a track."""
        raise NotImplementedError

    def step(self, state, row: tuple):
        """Take one row; return the new state and a list of output tuples."""
        raise NotImplementedError

    def finish(self, state) -> list[tuple]:
        """Output still owed at the end of a track."""
        return []


_FLUSH_ROWS = 8192


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def column_values(column: pa.Array) -> list:
    """Python values; by way of numpy where that loses nothing, as it is much faster."""
    kind = column.type
    if pa.types.is_string(kind) or (
        column.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind))
    ):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def slices(batch: pa.RecordBatch, *texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with one row or about ``most_bytes`` of ``texts``: what becomes Python values at
    a time does not grow with the number of rows a batch has."""
    sizes = sum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype("int64") for text in texts)
    part = (sizes.cumsum() - sizes) // most_bytes
    starts = [0, *((part[1:] != part[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column_values(column) for column in batch.columns))


def gathered(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Consecutive rows of equal keys as one row, with an array ``name`` of structs of ``columns``, which must fit a batch.
    For tables whose keys come whole and in order in their partitions; nothing is shuffled."""
    keys, columns = list(keys), list(columns)
    inner = T.ArrayType(T.StructType([df.schema[c] for c in columns]))
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(name, inner)])
    arrow = to_arrow_schema(schema)

    def rows(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        bounds = pa.array(np.append(starts, batch.num_rows), pa.int32())
        values = pa.StructArray.from_arrays(batch.columns[len(keys):], columns)
        lists = pa.ListArray.from_arrays(bounds, values).cast(arrow.field(len(keys)).type)
        return pa.RecordBatch.from_arrays([*[c.take(bounds[:-1]) for c in batch.columns[: len(keys)]], lists], schema=arrow)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            begins = np.zeros(whole.num_rows, bool)
            begins[0] = True
            for column in whole.columns[: len(keys)]:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                begins[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(begins)
            if len(starts) > 1:
                yield rows(whole.slice(0, starts[-1]), starts[:-1])
            held = [whole.slice(starts[-1])]
        for last in held:
            yield rows(last, np.zeros(1, np.int64))

    return df.select(*keys, *columns).mapInArrow(run, schema)


def _fold_stream(fold: Fold, width: int, schema: pa.Schema, guided: bool):
    """Fold sorted rows: key columns first, then (if guided) piece, state, last; then the
    columns of the fold."""

    def run(batches):
        out: list[tuple] = []
        group, key, state, last = None, None, None, True
        for batch in batches:
            for row in _rows(batch):
                if guided:
                    here, rest = row[: width + 1], row[width + 3 :]
                else:
                    here, rest = row[:width], row[width:]
                if here != group:
                    if group is not None and last:
                        out.extend(key + r for r in fold.finish(state))
                    group, key, last = here, row[:width], True
                    given = row[width + 1] if guided else None
                    state = fold.fresh() if given is None else json.loads(given)
                    if guided:
                        last = row[width + 2]
                state, produced = fold.step(state, rest)
                if produced:
                    out.extend(key + r for r in produced)
            if len(out) >= _FLUSH_ROWS:
                yield _records(out, schema)
                out = []
        if group is not None and last:
            out.extend(key + r for r in fold.finish(state))
        yield _records(out, schema)

    return run


def _state_stream(fold: Fold, width: int, schema: pa.Schema):
    """As above, but give only the state each piece ends with."""

    def run(batches):
        out, group, state = [], None, None
        for batch in batches:
            for row in _rows(batch):
                here = row[: width + 1]
                if here != group:
                    if group is not None:
                        out.append((*group, json.dumps(state)))
                    group = here
                    given = row[width + 1]
                    state = fold.fresh() if given is None else json.loads(given)
                state, _ = fold.step(state, row[width + 3 :])
        if group is not None:
            out.append((*group, json.dumps(state)))
        yield _records(out, schema)

    return run


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with whole keys in their partitions, in order."""
    # A window asks for that, and, unlike repartition, costs nothing where rows come that way.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place > 0").drop("_place")


def fold_tracks(
    df: DataFrame,
    fold: Fold,
    columns: Sequence[str],
    order: Sequence[str],
    schema: str,
    keys: Sequence[str] = ("track",),
    hot: bool | None = None,
    arranged: bool = False,
) -> DataFrame:
    """Run ``fold`` over ``columns`` of each key along ``order``; output rows are the key
    columns followed by ``schema``. ``arranged`` says that keys come whole and in order in their
    partitions, as rows do that were exploded from one; they are not shuffled then."""
    keys, order = list(keys), list(order)
    if hot is None:
        hot = not arranged and too_long(df, keys)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + T.StructType.fromDDL(schema).fields)
    arrow_out = to_arrow_schema(out_schema)
    width = len(keys)
    extra = [c for c in order if c not in columns]
    if not hot:
        ready = df if arranged else in_order(df.select(*keys, *columns, *extra), keys, order)
        ready = ready.select(*keys, *columns)
        return ready.mapInArrow(_fold_stream(fold, width, arrow_out, False), out_schema)
    return _fold_pieces(df.select(*keys, *columns, *extra), fold, columns, order, keys, out_schema)


def _fold_pieces(df, fold, columns, order, keys, out_schema) -> DataFrame:
    spark, width = df.sparkSession, len(keys)
    cut = pieces(df, order, keys)
    key_fields = [df.schema[k] for k in keys]
    piece = T.StructField("_piece", T.IntegerType())
    guide_schema = T.StructType(
        [*key_fields, piece, T.StructField("_state", T.StringType()), T.StructField("_last", T.BooleanType())]
    )
    state_schema = T.StructType([*key_fields, piece, T.StructField("_state", T.StringType())])

    def guided(table: DataFrame, guide: list[tuple], how: str) -> DataFrame:
        # The guide has at most two rows per partition of the range shuffle.
        small = spark.createDataFrame(guide, guide_schema)
        return (
            table.join(F.broadcast(small), [*keys, "_piece"], how)
            .select(*keys, "_piece", "_state", F.coalesce("_last", F.lit(True)).alias("_last"), *columns,
                    *[c for c in order if c not in columns])
            .repartition(*keys, "_piece")
            .sortWithinPartitions(*keys, "_piece", *order)
            .select(*keys, "_piece", "_state", "_last", *columns)
        )

    # Keys that span pieces, and their pieces in order: at most two rows per partition.
    per_key = cut.select(*keys, "_piece").distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list("_piece")).alias("_pieces")
    )
    chains = [(tuple(r[k] for k in keys), r["_pieces"]) for r in per_key.filter("size(_pieces) > 1").collect()]

    incoming = {(key, p): None for key, run in chains for p in run}
    before = {(key, b): (key, a) for key, run in chains for a, b in zip(run, run[1:])}
    after = {a: b for b, a in before.items()}
    todo = set(after)
    arrow_state = to_arrow_schema(state_schema)
    while todo:
        guide = [(*key, p, incoming[(key, p)], False) for key, p in todo]
        ended = guided(cut, guide, "inner").mapInArrow(_state_stream(fold, width, arrow_state), state_schema)
        todo = set()
        for r in ended.collect():
            nxt = after[(tuple(r[:width]), r["_piece"])]
            if incoming[nxt] != r["_state"]:
                incoming[nxt] = r["_state"]
                if nxt in after:
                    todo.add(nxt)
    guide = [(*key, p, s, (key, p) not in after) for (key, p), s in incoming.items()]
    return guided(cut, guide, "left").mapInArrow(
        _fold_stream(fold, width, to_arrow_schema(out_schema), True), out_schema
    )
