"""Sharding by sampled splitters, with DataFrame functions only.

A size-weighted sample of row keys gives quantile boundaries; rows are dealt to the ranges between
them, ranges that hold too much are subdivided by a sample of their own, and exact prefix sums over
the ranges place every row. A range holds too much if its bytes or its rows exceed twice the mean, so
null and empty texts, of one byte each, are subdivided as well. Rows are ordered by (hash of the text,
hash of doc_id, row number), so equal texts are neighbours and share a shard, unless a group weighs more
than ``group_share`` of a shard: such a group is cut like any other rows. A text whose copies spread over
several ranges has these ranges to itself, so their totals tell the weight and place of its group.

Only the sample (at most ``PER_RANGE * max_ranges`` keys), one line per range and one per shard reach
the driver. Defined results: null text has size 1 and the checksum of no bytes; repeated rows are
separate rows; null doc_ids are placed like others; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from feescope.llm.common import stored

_KEY = ["key", "salt", "row"]
_LEAST = -(1 << 63)
#: Sampled keys per range, ranges per shard at least, rows per range that more ranges are made for.
PER_RANGE = 16
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 16_384
_ROUNDS = 4


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64("doc_id").alias("salt"),
        F.monotonically_increasing_id().alias("row"),
    )


def _sample(rows: DataFrame, n: int, weight: Column) -> list[tuple]:
    """``n`` keys drawn without replacement with chances in proportion to ``weight``, sorted.

    Exponential arrival times at a rate of the row's weight; the first ``n`` rows are drawn. About
    ``2 * n`` rows arrive before the bound, so no task sends more than its share of those.
    """
    uniform = (F.pmod(F.xxhash64(*_KEY, F.lit(1)), F.lit(1 << 52)) + 1) / float(1 << 52)
    arrival = -F.log(uniform) / weight
    whole = rows.agg(F.sum(weight)).first()[0] or 1
    drawn = rows.filter(arrival < 2 * n / whole).orderBy(arrival, *_KEY).limit(n).select(*_KEY)
    return sorted(tuple(r) for r in drawn.collect())


def _quantiles(keys: list[tuple], n: int) -> set[tuple]:
    """Up to ``n - 1`` boundaries, before a text's first copy unless its copies fill half a range.

    Such a text is cut inside, and before and after its copies.
    """
    drawn, cuts = Counter(k[0] for k in keys), set()
    for i in range(1, n if keys else 1):
        key = keys[i * len(keys) // n]
        text = key[0]
        cuts.add((text, _LEAST, _LEAST))
        if drawn[text] > 1 and 2 * drawn[text] * n >= len(keys):
            cuts.add(key)
            if text < -_LEAST - 1:
                cuts.add((text + 1, _LEAST, _LEAST))
    return cuts


def _boundary_array(cuts: list[tuple]) -> Column:
    if not cuts:
        return F.expr("cast(array() as array<struct<key: bigint, salt: bigint, row: bigint>>)")
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_KEY, cut)]) for cut in cuts])


def _range_of(cuts: list[tuple]) -> Column:
    """Number of boundaries at or below the row, found in two steps of about sqrt(n) comparisons."""
    here = F.struct(*_KEY)
    width = max(1, int(len(cuts) ** 0.5))
    pages = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not pages:
        return F.lit(0)
    page = F.size(F.filter(_boundary_array([p[0] for p in pages]), lambda b: b <= here))
    own = F.element_at(F.array(*map(_boundary_array, pages)), F.greatest(page, F.lit(1)))
    return F.greatest(page - 1, F.lit(0)) * width + F.size(F.filter(own, lambda b: b <= here))


def _in_ranges(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    return rows.withColumn("range", _range_of(cuts))


def _totals(rows: DataFrame, cuts: list[tuple]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows of every range."""
    found = _in_ranges(rows, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {r["range"]: (r["bytes"], r["rows"]) for r in found.collect()}


def splitters(rows: DataFrame, n_ranges: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Boundaries of about ``n_ranges`` ranges, none over twice the mean in bytes or rows if it can be cut."""
    cuts = sorted(_quantiles(_sample(rows, PER_RANGE * n_ranges, F.col("size")), n_ranges))
    totals = _totals(rows, cuts)
    fair_bytes, fair_rows = (sum(t[i] for t in totals.values()) / n_ranges for i in (0, 1))
    for _ in range(_ROUNDS):
        over = {
            k: ceil(b / fair_bytes + n / fair_rows)
            for k, (b, n) in totals.items()
            if n > 1 and (b > 2 * fair_bytes or n > 2 * fair_rows)
        }
        if not over:
            break
        inside = _in_ranges(rows, cuts).filter(F.col("range").isin(list(over)))
        drawn: dict[int, list[tuple]] = {}
        for key in _sample(inside, PER_RANGE * sum(over.values()), F.col("size") / fair_bytes + 1 / fair_rows):
            drawn.setdefault(bisect_right(cuts, key), []).append(key)
        new = {cut for k, keys in drawn.items() for cut in _quantiles(keys, over[k])} - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
        totals = _totals(rows, cuts)
    return cuts, totals


def _spread_groups(cuts: list[tuple], totals: dict[int, tuple[int, int]]) -> tuple[Column, Column]:
    """Bytes of the group, and bytes before it, for the ranges that one text has to itself; null for others."""
    inner = {c[0] for c in cuts if c[1] != _LEAST}
    weight, start, upto = {}, {}, 0
    for i in range(len(cuts) + 1):
        text = cuts[i - 1][0] if i else None
        if text in inner:
            start.setdefault(text, upto)
            weight[text] = weight.get(text, 0) + totals.get(i, (0, 0))[0]
        upto += totals.get(i, (0, 0))[0]
    texts = [None, *(c[0] for c in cuts)]
    return tuple(F.array(*[F.lit(d.get(t)).cast("long") for t in texts]) for d in (weight, start))


def _bases(totals: dict[int, tuple[int, int]], n: int, which: int) -> Column:
    sums = accumulate((totals.get(i, (0, 0))[which] for i in range(n)), initial=0)
    return F.array(*[F.lit(s).cast("long") for s in list(sums)[:n]])


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, group_share: float = 0.01, max_ranges: int = MAX_RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; shard sizes are near equal in bytes."""
    rows = stored(_slim(docs), "sizes")
    n_rows = rows.count()
    n_ranges = min(max_ranges, max(RANGES_PER_SHARD * n_shards, -(-n_rows // ROWS_PER_RANGE)))
    cuts, totals = splitters(rows, n_ranges)
    whole = sum(b for b, _ in totals.values())
    at = F.col("range") + 1
    ordered = Window.partitionBy("range").orderBy(*_KEY)
    group = Window.partitionBy("range", "key")
    spread_weight, spread_start = _spread_groups(cuts, totals)
    placed = (
        _in_ranges(rows, cuts)
        .withColumn("seat", F.element_at(_bases(totals, len(cuts) + 1, 1), at) + F.row_number().over(ordered) - 1)
        .withColumn("upto", F.element_at(_bases(totals, len(cuts) + 1, 0), at) + F.sum("size").over(ordered) - F.col("size"))
        .withColumn("weight", F.coalesce(F.element_at(spread_weight, at), F.sum("size").over(group)))
        .withColumn("first", F.coalesce(F.element_at(spread_start, at), F.min("upto").over(group)))
        .withColumn(
            "middle",  # of the group, or of the row; doubled, so that it is a whole number
            F.when(F.col("weight") <= int(group_share * whole / n_shards), 2 * F.col("first") + F.col("weight"))
            .otherwise(2 * F.col("upto") + F.col("size")),
        )
        .withColumn("shard", F.expr(f"cast(middle * {n_shards} div {2 * max(1, whole)} as int)"))
    )
    kept = stored(placed.select("doc_id", "size", "text_crc32", "shard", "seat"), "placed")
    first = {r["shard"]: r["seat"] for r in kept.groupBy("shard").agg(F.min("seat").alias("seat")).collect()}
    starts = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(n_shards)])
    return kept.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("seat") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
