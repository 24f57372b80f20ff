"""Running totals over a whole table, without a single-task window.

A window without a partition sends every row to one task. Here the rows are
cut into stretches of the full ordering at fixed bounds, each a partition
of its own; a window runs inside each stretch, and a table with one line per
stretch supplies what lies before it. The ordering includes the tie-breakers, so
a value shared by a third of all rows is spread over many stretches too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import guarded_ratio, to_money, to_ratio

c = F.col

_BUCKET = "_bucket"


#: Rows of the sample that stand for a stretch, and rows a stretch is meant to have at least.
_SAMPLED = 16
_LEAST_ROWS = 20_000


def bucketed(
    df: DataFrame, order: Sequence[str], n_buckets: int | None = None
) -> tuple[DataFrame, int]:
    """Rows tagged with the number of their stretch of the ordering, and how many stretches there are.

    One job picks the bounds: a row by hash from each of ``_SAMPLED`` cells a stretch, so their number does not grow
    with the data. The tag then is an expression over the row and constant bounds. It is the same in every
    evaluation, also after an executor is lost, so nothing is written; and it rises with the ordering whichever
    bounds were picked. Without ``n_buckets`` there are as many stretches as shuffle partitions, fewer for few rows.
    """
    spark = df.sparkSession
    most = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [c(name).alias(f"c{i}") for i, name in enumerate(order)]
    # A NULL leaves the hash as it is, so its place is hashed as well.
    mixed = F.xxhash64(*order, *[c(name).isNull() for name in order])
    cells = (
        df.select(F.struct(*named).alias("row"), mixed.alias("h"))
        .groupBy(F.pmod("h", F.lit(most * _SAMPLED)).alias("cell"))
        .agg(F.min(F.struct("h", "row"))["row"].alias("row"), F.count(F.lit(1)).alias("n"))
    )
    found = cells.orderBy("row").select(F.to_json("row").alias("row"), "n").collect()
    n_rows = sum(r["n"] for r in found)
    n = n_buckets or max(1, min(most, n_rows // _LEAST_ROWS))
    bounds = list(dict.fromkeys(found[k * len(found) // n]["row"] for k in range(1, n) if found))
    return df.withColumn(_BUCKET, _bounds_below(bounds, F.struct(*named), df.select(*named))), n


def _bounds_below(bounds: list[str], row: Column, typed: DataFrame) -> Column:
    """How many of the ascending ``bounds`` (JSON) are below ``row``: among every g-th, then inside the g."""
    if not bounds:
        return F.lit(0)
    kind = typed.schema.simpleString()
    g = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[k : k + g] for k in range(0, len(bounds), g)]
    last = F.from_json(F.lit(f"[{','.join([x[-1] for x in groups])}]"), f"array<{kind}>")
    inner = F.from_json(F.lit(f"[{','.join(['[' + ','.join(x) + ']' for x in groups])}]"), f"array<array<{kind}>>")
    full = F.size(F.filter(last, lambda b: b < row))
    rest = F.size(F.filter(F.get(inner, full), lambda b: b < row))
    # After the last group there is none to look into.
    return F.when(full < len(groups), full * g + rest).otherwise(len(bounds))


def bucket_offsets(placed: DataFrame, value: str) -> DataFrame:
    """Per stretch: what comes before it, the grand totals, and peers that follow.

    The windows here see one row per stretch, whatever the size of the data.
    """
    ends = placed.groupBy(_BUCKET).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("t"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    # Sum of the peers of each stretch's smallest value, against the same few rows.
    lowest = (
        placed.join(F.broadcast(ends.select(_BUCKET, "lo")), _BUCKET)
        .filter(c(value) == c("lo"))
        .groupBy(_BUCKET)
        .agg(F.sum(value).alias("t_lo"))
    )
    stretch = ends.join(lowest, _BUCKET, "left")
    in_order = Window.orderBy(_BUCKET)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = (
        Window.partitionBy("lo").orderBy(_BUCKET).rowsBetween(0, Window.unboundedFollowing)
    )
    zero = F.lit(0)
    tailed = stretch.withColumn("t_lo_onward", F.sum("t_lo").over(onward))
    return tailed.select(
        _BUCKET,
        c("hi").alias("_hi"),
        F.coalesce(F.sum("n").over(before), zero).alias("_n_before"),
        F.coalesce(F.sum("t").over(before), zero).alias("_t_before"),
        F.sum("n").over(everywhere).alias("_n_all"),
        F.sum("t").over(everywhere).alias("_t_all"),
        # Peers of this stretch's largest value that only appear in later ones.
        F.when(
            F.lead("lo").over(in_order) == c("hi"), F.lead("t_lo_onward").over(in_order)
        )
        .otherwise(zero)
        .alias("_t_peers"),
    )


def running_totals(
    df: DataFrame, value: str, tie_breakers: Sequence[str], n_buckets: int | None = None
) -> DataFrame:
    """Add ``rn``, ``cum_value``, ``n_rows`` and ``sum_value`` over the ordering.

    ``rn`` numbers all rows by (value, tie-breakers), NULLs first. ``cum_value``
    includes all peers of a value (RANGE semantics). The tie-breakers should make
    rows unique: only rows equal in all of them cannot be split.
    """
    order = [value, *tie_breakers]
    placed, n = bucketed(df, order, n_buckets)
    offsets = bucket_offsets(placed, value)
    # By number, not by hash: every stretch is a task of its own.
    apart = placed.repartitionById(n, c(_BUCKET))
    rows = Window.partitionBy(_BUCKET).orderBy(*order)
    peers = Window.partitionBy(_BUCKET).orderBy(value)
    local = apart.withColumn("_rn", F.row_number().over(rows)).withColumn(
        "_run", F.sum(value).over(peers)
    )
    total = placed.agg(F.sum(value)).schema[0].dataType
    # One row per stretch, so the broadcast side is bounded.
    joined = local.join(F.broadcast(offsets), _BUCKET)
    before = c("_t_before") + F.when(c(value) == c("_hi"), c("_t_peers")).otherwise(F.lit(0))
    return joined.select(
        *df.columns,
        (c("_n_before") + c("_rn")).alias("rn"),
        (before + F.coalesce(c("_run"), F.lit(0))).cast(total).alias("cum_value"),
        c("_n_all").alias("n_rows"),
        c("_t_all").cast(total).alias("sum_value"),
    )


def lorenz(
    df: DataFrame, value: str, tie_breakers: Sequence[str], n_buckets: int | None = None
) -> DataFrame:
    """Add ``cum_share_providers`` and ``cum_share_drug``: the points of a Lorenz curve."""
    totals = running_totals(df, value, tie_breakers, n_buckets)
    return totals.select(
        *df.columns,
        to_ratio(c("rn").cast("double") / c("n_rows")).alias("cum_share_providers"),
        guarded_ratio(to_money(c("cum_value")), to_money(c("sum_value"))).alias("cum_share_drug"),
    )


def lorenz_curve(mart: DataFrame) -> DataFrame:
    """The curve's points in provider order."""
    return mart.select("cum_share_providers", "cum_share_drug").orderBy(
        "cum_share_providers", "cum_share_drug"
    )


def gini(mart: DataFrame, from_origin: bool = False) -> DataFrame:
    """Gini coefficient of a whole curve: one row, no sort.

    The N points lie 1/N apart on the provider axis, so the trapezoids add up to
    (sum(y) - (y_first + y_last) / 2) / N, and on a rising curve the first and
    last y are the minimum and maximum. By default the area starts at the first
    point; ``from_origin`` adds the sliver between (0, 0) and it.
    """
    curve = mart.dropna(subset=["cum_share_drug"])
    y = c("cum_share_drug")
    once = F.max(y) if from_origin else F.min(y) + F.max(y)
    doubled = F.lit(2) * F.sum(y) - once
    return curve.agg(
        to_ratio(F.lit(1) - F.when(F.count(y) > 0, doubled / F.count(y))).alias("gini"),
        F.count(y).alias("n_points"),
    )
