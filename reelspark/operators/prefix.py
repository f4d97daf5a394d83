"""Folds over the ordered rows of a key, with one key's rows over many tasks: a two-level prefix scan.

Rows are dealt by ranges of key and order, so a long key is cut into blocks. Each block is summed up as a
map from the state before it to the state behind it, the maps of a key are applied one after the other,
and then every block runs again from its known state. The state behind a block must follow from the state
before it by a map that stays small; the fold's author gives that map.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.sources.shared import cut


class Fold(Protocol):
    """States and maps are texts, so that they travel as columns."""

    #: Columns that :meth:`run` returns, as DDL of bigint and string.
    ddl: str

    def start(self) -> str:
        """The state before a key's first row."""

    def summary(self, rows: Iterator[tuple]) -> str:
        """The map of a block's ordered rows."""

    def apply(self, map_: str, state: str) -> str:
        """The state behind a block."""

    def run(self, rows: Iterator[tuple], state: str) -> Iterator[tuple]:
        """Output rows of a block's ordered rows."""


_TYPES = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batches(rows: Iterator[tuple], ddl: str, size: int = 8192) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in ddl.split(", ")]
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], _TYPES[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield packed()
            held = []
    yield packed()


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first ``width`` values, each as an iterator that is read batch by batch."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    waiting = next(rows, None)
    while waiting is not None:
        head = waiting[:width]

        def own(head=head) -> Iterator[tuple]:
            nonlocal waiting
            while waiting is not None and waiting[:width] == head:
                row, waiting = waiting, next(rows, None)
                yield row[width:]

        group = own()
        yield head, group
        for _ in group:
            pass


def scan(df: DataFrame, order: list[str], fold: Fold, blocks: int | None = None) -> DataFrame:
    """Rows of ``fold.ddl`` for ``df``, whose first column is the key and whose columns the fold's rows are.

    ``order`` must not leave ties whose order matters. Blocks are as many as ``blocks`` or the session's
    shuffle partitions. A null key is a key; an empty table gives no rows. Tasks read their rows batch by
    batch; what meets in one task of a key is a map for each of its blocks.
    """
    key, kind = df.columns[0], df.schema[0].dataType.simpleString()
    dealt = df.repartitionByRange(blocks, key, *order) if blocks else df.repartitionByRange(key, *order)
    placed = cut(dealt.select("*", F.spark_partition_id().alias("_block")))
    names = [c for c in placed.columns if c not in (key, "_block")]

    def summaries(batches):
        return _batches(((*head, fold.summary(rows)) for head, rows in _groups(batches, 2)), f"{key} {kind}, _block int, _map string")

    def entries(batches):
        def found():
            for (own,), maps in _groups(batches, 1):
                state = fold.start()
                for block, map_ in maps:
                    yield own, block, state
                    state = fold.apply(map_, state)

        return _batches(found(), f"{key} {kind}, _block int, _state string")

    def outputs(batches):
        def found():
            for _, rows in _groups(batches, 2):
                head = next(rows)  # the entry: the only row with a state
                yield from fold.run((r[1:] for r in rows), head[0])

        return _batches(found(), fold.ddl)

    def in_blocks(rows: DataFrame, *first: str) -> DataFrame:
        return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", *first, *order)

    maps = in_blocks(placed.select(key, "_block", *names)).mapInArrow(summaries, f"{key} {kind}, _block int, _map string")
    states = maps.repartition(key).sortWithinPartitions(key, "_block").mapInArrow(entries, f"{key} {kind}, _block int, _state string")
    heads = states.select(key, "_block", "_state", *(F.lit(None).cast(placed.schema[n].dataType).alias(n) for n in names))
    body = placed.select(key, "_block", F.lit(None).cast("string").alias("_state"), *names)
    rows = heads.unionByName(body).repartition(key, "_block").sortWithinPartitions(key, "_block", F.col("_state").isNull(), *order)
    return rows.mapInArrow(outputs, fold.ddl)
