"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (bigint). Returns (v, label), label being the least vertex reachable.

    In a round each vertex hooks to the neighbour that comes first in the round's order if that comes
    before itself, takes its grandparent there, and the edges between the vertices that are left make
    the next round's graph. The order is by number in even rounds, in which a star settles, and by a
    hash in odd ones, which leave half of the vertices at most on average: rounds grow with the
    logarithm of a component's size, whatever its shape, and each is smaller than the one before.
    Vertices without an edge to another do not occur; edges with a null end count as none, repeated
    ones do no harm, an empty table gives an empty table. Nothing above a join needs a key's rows
    together, so adaptive execution can split a vertex with very many neighbours.
    """
    left = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    parents: list[DataFrame] = []
    while left.limit(1).count():
        place = (lambda c: F.col(c)) if len(parents) % 2 == 0 else (lambda c, seed=len(parents): F.xxhash64(c, F.lit(seed)))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(F.struct(place("v").alias("at"), "v")).alias("f"))
        hooks = cut(first.select(F.col("u").alias("v"), F.when(F.struct("f.at", "f.v") < F.struct(place("u").alias("at"), F.col("u").alias("v")), F.col("f.v")).otherwise(F.col("u")).alias("p")))
        above = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parents.append(cut(hooks.join(above, "p").select("v", F.col("pp").alias("p"))))
        of = lambda name, to: parents[-1].select(F.col("v").alias(name), F.col("p").alias(to))
        ends = left.join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b")
        left = cut(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not parents:
        return left.select("v", F.col("u").alias("label"))
    root = parents.pop()
    while parents:
        last = root.select(F.col("v").alias("p"), F.col("p").alias("r"))
        root = parents.pop().join(last, "p", "left").select("v", F.coalesce("r", "p").alias("p"))
    root = cut(root)
    least = root.groupBy("p").agg(F.min("v").alias("label"))
    return root.join(least, "p").select("v", "label")
