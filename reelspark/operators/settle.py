"""Folds whose state no small map sums up, with one key's rows over many tasks: run from guesses, and again where a guess was wrong.

Rows are dealt by ranges of key and order. A key that lies in one block runs once. The blocks of others all
run at once from the start state; the exit of a block is the next one's entry, and blocks whose entry was
another run again, until no entry changes. The result is that of the fold over the whole key: its first
block begins rightly, and each pass makes at least one more block right. Folds that forget, as a noise
floor or a detector that falls silent does, leave a block in the same state from any entry, so two passes do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.operators.prefix import _batches, _groups
from reelspark.sources.shared import cut


class Forgetful(Protocol):
    """States are texts, equal only where the states are."""

    #: Columns that :meth:`run` returns, as DDL of bigint and string.
    ddl: str

    def start(self) -> str:
        """The state before a key's first row."""

    def leave(self, rows: Iterator[tuple], state: str) -> str:
        """The state behind a block's ordered rows."""

    def run(self, rows: Iterator[tuple], state: str, last: bool) -> Iterator[tuple]:
        """Output rows of a block, which may be the key's last one."""


def settle(df: DataFrame, order: list[str], fold: Forgetful, blocks: int | None = None, stretch: int = 1 << 17) -> DataFrame:
    """Rows of the key (the first column of ``df``), ``_block``, and ``fold.ddl``.

    ``order`` begins with a number and must not leave ties whose order matters; ``stretch`` of that number
    stay in one block, so that only longer keys are cut. Blocks are as many as ``blocks`` or the session's
    shuffle partitions, small ones merged. A null key is a key; an empty table gives no rows.
    """
    key, kind = df.columns[0], df.schema[0].dataType.simpleString()
    at = F.expr(f"floor({order[0]} / {stretch})")
    dealt = df.repartitionByRange(blocks, key, at) if blocks else df.repartitionByRange(key, at)
    placed = cut(dealt.select("*", F.spark_partition_id().alias("_block")))
    names = [c for c in placed.columns if c not in (key, "_block")]
    own = Window.partitionBy(key).orderBy("_block")

    def same(a: str, b: str):
        return F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}")) & (F.col(f"{a}._block") == F.col(f"{b}._block"))

    def with_heads(entries: DataFrame, body: DataFrame) -> DataFrame:
        """Each block's rows behind one that has its entry alone."""
        heads = entries.select(key, "_block", "_state", "_last", *(F.lit(None).cast(placed.schema[n].dataType).alias(n) for n in names))
        rows = body.select(key, "_block", F.lit(None).cast("string").alias("_state"), F.lit(None).cast("boolean").alias("_last"), *names)
        return heads.unionByName(rows).repartition(key, "_block").sortWithinPartitions(key, "_block", F.col("_state").isNull(), *order)

    def leaves(batches):
        def found():
            for head, rows in _groups(batches, 2):
                entry = next(rows)
                yield (*head, fold.leave((r[2:] for r in rows), entry[0]))

        return _batches(found(), f"{key} {kind}, _block int, _exit string")

    def outputs(batches):
        def found():
            for head, rows in _groups(batches, 2):
                entry = next(rows)
                for out in fold.run((r[2:] for r in rows), entry[0], bool(entry[1])):
                    yield (*head, *out)

        return _batches(found(), f"{key} {kind}, _block int, {fold.ddl}")

    known = placed.select(key, "_block").distinct()
    entries = cut(known.select("*", F.lit(fold.start()).alias("_state"), F.lead("_block").over(own).isNull().alias("_last"), (F.count("*").over(Window.partitionBy(key)) > 1).alias("_many")))
    many = cut(entries.where("_many"))
    todo, exits = cut(many.where("not _last")), None
    while not todo.isEmpty():
        body = placed.alias("p").join(todo.alias("t"), same("p", "t"), "left_semi")
        found = cut(with_heads(todo, body).mapInArrow(leaves, f"{key} {kind}, _block int, _exit string"))
        exits = found if exits is None else cut(exits.alias("e").join(found.alias("f"), same("e", "f"), "left_anti").unionByName(found))
        before = F.lag("_exit").over(own)
        told = many.alias("m").join(exits.alias("e"), same("m", "e"), "left").select("m.*", "e._exit")
        after = told.withColumn("_new", F.coalesce(before, F.lit(fold.start())))
        told = cut(after)
        todo = cut(told.where("not _last and _new <> _state").drop("_state", "_exit").withColumnRenamed("_new", "_state"))
        many = cut(told.select(key, "_block", F.col("_new").alias("_state"), "_last", "_many"))
    final = entries.where("not _many").unionByName(many)
    return with_heads(final, placed).mapInArrow(outputs, f"{key} {kind}, _block int, {fold.ddl}")
