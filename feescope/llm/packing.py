"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents longer than a bin fill bins of their own; what is left over is packed best-fit, largest
first, in blocks of about ``BLOCK_ITEMS`` items dealt by hash. A bin holds at most one piece of a
duplicate cluster, and pieces of at most ``max_sources`` sources. Bins are kept by residual; a search
starts at the tightest residual and goes on to the next until a bin is compatible.

Bitmaps are Python integers: bins by residual, bins by cluster, and the sources of each bin.

Defined results: null text has no words and, like any text without words, gives one piece of size
zero; null source is a source; repeated rows are members of one cluster; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import stored
from feescope.llm.mixing import n_words

CAPACITY = 2048
BLOCK_ITEMS = 8192
_PIECES = "doc_id long, source string, cluster long, row long, piece int, offset long, size long, bin string, bin_size long"


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, max_sources: int) -> list[int]:
    """Bin number of each item; items come largest first, clusters and sources as small integers."""
    by_residual = [0] * (capacity + 1)  # bins with that residual
    residuals = 0  # which of them are not empty
    of_cluster: dict[int, int] = {}  # bins that hold it
    bin_sources: list[int] = []
    chosen = []
    for size, cluster, source in zip(sizes, clusters, sources):
        barred, own = of_cluster.get(cluster, 0), 1 << source
        found, ahead = -1, residuals >> size << size
        while ahead and found < 0:
            left = (ahead & -ahead).bit_length() - 1
            ahead &= ahead - 1
            bins = by_residual[left] & ~barred
            while bins:
                bin_ = (bins & -bins).bit_length() - 1
                if (bin_sources[bin_] | own).bit_count() <= max_sources:
                    found = bin_
                    break
                bins &= bins - 1
        if found < 0:
            found, left = len(bin_sources), capacity
            bin_sources.append(0)
        else:
            by_residual[left] &= ~(1 << found)
            if not by_residual[left]:
                residuals &= ~(1 << left)
        left -= size
        by_residual[left] |= 1 << found
        residuals |= 1 << left
        of_cluster[cluster] = barred | 1 << found
        bin_sources[found] |= own
        chosen.append(found)
    return chosen


def _packer(capacity: int, max_sources: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        codes = [pd.factorize(pdf[c], use_na_sentinel=False)[0].tolist() for c in ("cluster", "source")]
        local = best_fit(pdf["size"].tolist(), *codes, capacity, max_sources)
        pdf["bin"] = [f"{b}-{i}" for b, i in zip(pdf["block"], local)]
        pdf["bin_size"] = pdf.groupby("bin")["size"].transform("sum")
        return pdf[["doc_id", "source", "cluster", "row", "piece", "offset", "size", "bin", "bin_size"]]

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, max_sources: int = 4, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per piece: doc_id, source, cluster, row, piece, offset, size, bin, bin_size (all in words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.xxhash64(text).alias("cluster"),
            F.monotonically_increasing_id().alias("row"),
            n_words().alias("size"),
        ),
        "items",
    )
    n_full = F.floor(F.col("size") / capacity).cast("int")
    n_blocks = max(1, -(-rows.count() // block_items))
    full = (
        rows.filter(F.col("size") >= capacity)
        .withColumn("piece", F.explode(F.sequence(F.lit(1), n_full)))
        .select(
            "doc_id", "source", "cluster", "row", (F.col("piece") - 1).alias("piece"),
            ((F.col("piece") - 1) * F.lit(capacity)).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("size"),
            F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"), F.lit(capacity).cast("long").alias("bin_size"),
        )
    )
    rest = rows.filter((F.col("size") % capacity > 0) | (F.col("size") == 0)).select(
        "doc_id", "source", "cluster", "row", n_full.alias("piece"), (n_full * F.lit(capacity)).cast("long").alias("offset"),
        (F.col("size") % capacity).alias("size"), F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"),
    )
    packed = rest.groupBy("block").applyInPandas(_packer(capacity, max_sources), _PIECES)
    return full.unionByName(packed)
