"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents, in hashed order, form a stream of words that is read until the source's
quota is met, twice over if need be. The stream is cut into blocks; the exact block quotas of all
sources are split among the output shards by a binary tree whose nodes draw from a multivariate
hypergeometric law, and each shard takes its own run of the source's permuted blocks. Inside a shard,
documents are ordered by a hash.

Positions in the streams are two-level prefix sums: over hashed sub-ranges of about
``ROWS_PER_BUCKET`` rows, so a source with a third of all rows is many tasks' work. The driver sees
one row per source, like the list of weights itself.

Defined results: null text has size 0; null source is a source, the last; the last document of a
quota may be taken in part (its first words); rows equal in doc_id and text are interchangeable;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from feescope.llm.common import fresh, lookup, running_base, stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 16_384
#: Rows per sub-range at least; more in very large corpora, so that sub-ranges stay about a million.
ROWS_PER_BUCKET = 2_048
_BUCKETS = 1 << 20
_PLAN = "src string, source_size long, target double, quota long, n_blocks long, step long, shift long, upto array<long>, n_buckets int"


def n_words() -> Column:
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above ``most`` times its size."""
    caps = [most * s for s in sizes]
    out, open_ = [0.0] * len(caps), set(range(len(caps)))
    rest = share * sum(sizes)
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > caps[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = caps[i]
        rest -= sum(caps[i] for i in full)
        open_ -= full
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: columns sum to ``quotas``, rows are at most one apart."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    n_left = int(quotas.sum()) * left // n_shards
    drawn = rng.multivariate_hypergeometric(quotas, n_left, method="marginals")
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, n_shards - left, rng)])


def _plan(found: list, weights: Sequence[float], share: float, most: float, n_shards: int, seed: int) -> list[tuple]:
    """Sources in code-point order, null last, with targets, block permutation and shard bounds."""
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    quota = [min(int(most * s), round(g)) for s, g in zip(sizes, goal)]
    blocks = np.array([-(-q // BLOCK_WORDS) for q in quota], np.int64)
    per_bucket = max(ROWS_PER_BUCKET, sum(r["n_docs"] for r in found) // _BUCKETS)
    rng = np.random.default_rng(seed)
    counts = split_quotas(blocks, n_shards, rng) if len(blocks) else np.zeros((n_shards, 0), np.int64)
    upto = np.cumsum(counts, axis=0).T.tolist()
    rows = []
    for i, r in enumerate(found):
        n = max(1, int(blocks[i]))
        step = next(s for s in range(int(n * 0.618) + 1, 2 * n + 2) if np.gcd(s, n) == 1)
        buckets = max(1, -(-r["n_docs"] // per_bucket))
        rows.append((r["src"], sizes[i], goal[i], quota[i], n, step, int(rng.integers(n)), upto[i], buckets))
    return rows


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    n_shards: int = 16,
    seed: int = 7,
) -> DataFrame:
    """One row per document of ``docs``.

    doc_id, text_hash, source, size, source_size, target, taken, and ``places``: one entry per copy in the
    mix with its words, shard and order inside the shard.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("src"),
            n_words().alias("size"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "words",
    )
    found = rows.groupBy("source", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = spark.createDataFrame(_plan(found.collect(), weights, share, most, n_shards, seed), _PLAN)
    turn = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    keyed = (
        lookup(rows, ["src"], plan, ["doc_id", "text_hash"])
        .withColumn("turn", turn)
        .withColumn("bucket", F.expr("cast((turn / 18446744073709551616D + 0.5D) * n_buckets as int)"))
    )
    keyed = stored(keyed, "turns")
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    bases = running_base(sums, ["src"], ["bucket"], "bucket_size", "base").select("src", "bucket", "base")
    inside = Window.partitionBy("src", "bucket").orderBy("turn", "doc_id", "text_hash")
    placed = keyed.join(bases, ["src", "bucket"]).withColumn(
        "start", F.col("base") + F.sum("size").over(inside) - F.col("size")
    )

    def copy(epoch: int) -> Column:
        at = F.col("start") + epoch * F.col("source_size")
        words = F.least(F.greatest(F.col("quota") - at, F.lit(0)), F.col("size"))
        block = F.floor(at / BLOCK_WORDS)
        drawn = F.pmod(block * F.col("step") + F.col("shift"), F.col("n_blocks"))
        shard = F.size(F.filter("upto", lambda u: u <= drawn))
        return F.struct(
            F.lit(epoch).alias("epoch"),
            words.cast("long").alias("words"),
            shard.cast("int").alias("shard"),
            F.xxhash64(F.lit(seed + 1), F.lit(epoch), "doc_id", "text_hash").alias("order"),
        )

    copies = F.filter(F.array(*[copy(e) for e in range(int(np.ceil(most)))]), lambda c: c["words"] > 0)
    return placed.withColumn("places", copies).select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("places", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"),
        "places",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row per copy, all of them whole.

    The last document of a quota, which ``mix`` takes in part, comes whole if at least half of it is in the quota, and else
    not at all, so a source is off its target by half a document at most. Texts shuffle once, by document; the plan
    comes to them. Null texts have size 0 and are in no mix; a null source is a source, the last; a null doc_id is kept;
    an empty table gives an empty one. Other columns may have any name.
    """
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known, number, sha, n, places = fresh(columns, "_known", "_number", "_sha", "_n", "_places")
    keys = [known, number, sha]

    def keyed(rows: DataFrame, doc_id: Column, digest: Column) -> DataFrame:
        # Plain equal columns, so that the window below and the join need one and the same exchange.
        rows = rows.withColumns({known: doc_id.isNotNull(), number: F.coalesce(doc_id, F.lit(0)), sha: digest})
        return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(sha)))  # rows equal in both, if any

    whole = F.filter("places", lambda c: 2 * c["words"] >= F.col("size"))
    mixed = mix(docs, **options).select("doc_id", "text_hash", whole.alias(places))
    plan = (
        keyed(mixed, F.col("doc_id"), F.col("text_hash")).filter(F.size(places) > 0)
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(n, F.size(places)))).alias(places))
    )
    rows = keyed(docs, F.col("doc_id").cast("long"), F.xxhash64(text))
    copies = rows.join(plan, keys).withColumn(n, F.try_element_at(F.col(places), F.col(n)))
    times = F.coalesce(F.col(n), F.lit(0))
    return copies.select(*columns, F.explode(F.array_repeat(F.lit(0), times)).alias(places)).select(*columns)
