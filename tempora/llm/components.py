"""Connected components of a graph too large for a driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS = 60


def _to_least(edges: DataFrame, total: int) -> DataFrame:
    """Rows (a, b, m): m is the least of a and all its neighbours. A hub's row is salted, not its neighbours gathered."""
    least = edges.groupBy("a").agg(F.min("b").alias("_b"), F.count("*").alias("_n"))
    return shared.lookup(edges, least, ["a"], "_n", total, "inner", spread=("b",)).select("a", "b", F.least("a", "_b").alias("m"))


def _two(one: tuple, other: tuple) -> Column:
    """Two rows (a, b) for each."""
    return F.inline(F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in (one, other))))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (a, b), a > b, there are, and whether they are stars: each a has one edge and is no b."""
    up = F.col("up")
    ends = edges.select(_two((F.col("a"), F.lit(1)), (F.col("b"), F.lit(0)))).select(F.col("a").alias("node"), F.col("b").alias("up"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("ends"))
    n, others = nodes.agg(F.sum(up), F.count(F.when((up > 0) & (F.col("ends") > 1), 1))).first()
    return n or 0, not others


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node that each node of an edge (a, b) is connected with.

    Large-star and small-star by turns until only stars are left: in each, neighbours are re-linked to the least of a
    neighbourhood. The rounds grow with the logarithm of the nodes; each half is written, so a lost executor costs one,
    and the driver plans each half over two scans, however many rounds there are.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    now = shared.written(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        n, stars = _state(now)
        if stars:
            break
        large = shared.written(_to_least(now.select(_two((a, b), (b, a))), 2 * n).where("b > a").select(b.alias("a"), m.alias("b")), "edges")
        small = _to_least(large, n).select(_two((a, m), (b, m)))  # m is the least of the three
        now = shared.written(small.where("a <> b").distinct(), "edges")
    else:
        raise RuntimeError("the components don't come to rest")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
