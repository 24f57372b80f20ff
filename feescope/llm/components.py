"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a handful of shuffles over the edges and is written to the shared folder. Minima
are taken map-side and per salted piece, so a node with a third of all edges stays spread out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import attach_totals, few_files, stored


def _contract(batches):
    """Union-find inside a partition: its edges become stars, with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    if pairs:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["u", "v"]
        )


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest neighbour of u."""
    return attach_totals(edges, ["u"], [F.min("v").alias("m")], [F.min("m").alias("m")], ["v"])


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns) except the roots themselves.

    ``root`` is the smallest node of the component. Self-loops and repeated edges are allowed.
    """
    a, b = edges.columns
    local = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(_contract, "u long, v long")
    stars = stored(local.distinct(), "edges")
    seen = _print(stars)
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        least = _with_least(large)
        small = (
            least.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        stars = stored(few_files(small, seen[0]), "edges")
        before, seen = seen, _print(stars)
        if seen == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
