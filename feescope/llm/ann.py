"""Approximate nearest neighbours on shifted space-filling curves.

Distinct vectors are projected several times to a few dimensions and ordered along a shifted Hilbert
curve each; every order is range-partitioned and ranked exactly. A query looks at the vectors within
``window`` ranks of its own on every curve; the windows are merged and ranked by the exact inner product.

The window is measured, not guessed: at most ``TRIAL_QUERIES`` queries are searched by brute force over
all vectors, and the window is the smallest that finds ``target`` of their neighbours. On vectors without
structure it is therefore wide, and the search honest about it. Only projections and their ranges come
from a sample; every vector is indexed.

Queries reach a segment of ``SEGMENT`` ranks in blocks of about ``QUERY_BLOCK``, so the rows that meet in
one group do not grow with the table.

Equal vectors are one entry with their ``k + 1`` smallest vec_ids, the only ones that can be among the
``k`` nearest, so a vector that a third of all rows share is one entry, too.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows without vec_id; rows equal in vec_id and vector count
once; a query never finds rows with its own vec_id; ties go to the smaller vec_id; fewer candidates
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from feescope.llm.common import lookup, running_base, stored, thin

CURVES = 8
DIMENSIONS = 6
SEGMENT = 8192
QUERY_BLOCK = 4096
TRIAL_QUERIES = 200
SAMPLE = 4096
_BITS = 10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of every row of ``cells`` (n, dimensions; below 2**bits) along the Hilbert curve."""
    x = cells.astype(np.uint64).T.copy()
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:  # undo the curve's rotations, from the coarsest bit on
        low = q - np.uint64(1)
        for i, axis in enumerate(x):
            turned = (axis & q) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low).astype(np.uint64)
            x[0] ^= np.where(turned, low, swap)
            if i:
                axis ^= swap
        q >>= np.uint64(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    mend = np.zeros_like(x[0])
    q = top
    while q > 1:
        mend ^= np.where((x[-1] & q) != 0, q - np.uint64(1), 0).astype(np.uint64)
        q >>= np.uint64(1)
    x ^= mend
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for axis in x:
            key = (key << np.uint64(1)) | ((axis >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


class Curves:
    """Projections, ranges and shifts of all curves."""

    def __init__(self, sample: np.ndarray, width: int, n_curves: int, n_dims: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        n_dims = min(n_dims, width)
        self.axes = [np.linalg.qr(rng.normal(size=(width, n_dims)))[0] for _ in range(n_curves)]
        self.shifts = rng.random((n_curves, n_dims)) * 0.33
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else np.zeros((1, width))
        spans = [np.quantile(unit @ a, (0.001, 0.999), axis=0) for a in self.axes]
        self.low = [s[0] for s in spans]
        self.size = [np.maximum(s[1] - s[0], 1e-9) for s in spans]

    def keys(self, curve: int, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        place = (unit @ self.axes[curve] - self.low[curve]) / self.size[curve] * 0.66 + self.shifts[curve]
        cells = np.clip(place * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, _BITS)


def _vectors(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f4").reshape(-1, width).astype(np.float64)


def _usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that take part, and the vectors' length."""
    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("vector"))
    limit = float(np.finfo(np.float32).max)
    finite = F.forall("vector", lambda v: F.coalesce(F.abs(v) <= limit, F.lit(False)) & ~F.isnan(v))
    good = given.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    most = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == (most.n if most else 0)), most.n if most else 0


def _packed(batches):
    for batch in batches:
        lists = batch.column(0)
        values = np.ascontiguousarray(lists.flatten(), "<f4").reshape(batch.num_rows, -1)
        packed = pa.array([v.tobytes() for v in values], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], packed], ["ids", "entry", "vector"])


def entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with an entry number and their ``k + 1`` smallest vec_ids."""
    order = Window.partitionBy("hash", "vector").orderBy("vec_id")
    few = (
        rows.withColumn("hash", F.xxhash64("vector"))
        .withColumn("n", F.dense_rank().over(order))
        .filter(F.col("n") <= k + 1)  # also cut before the shuffle
        .groupBy("hash", "vector")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )
    return few.select("vector", "ids", F.monotonically_increasing_id().alias("entry"))


def ranks(index: DataFrame, curves: Curves, width: int) -> DataFrame:
    """(curve, rank, entry, vector) for every curve, from a range partitioning and exact offsets."""
    shared = index.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _vectors(batch.column(1).to_pylist(), width)
                for c in range(len(shared.value.axes)):
                    keys = pa.array(shared.value.keys(c, vectors))
                    curve = pa.array(np.full(len(vectors), c, np.int32))
                    yield pa.RecordBatch.from_arrays([curve, keys, *batch.columns], ["curve", "key", "entry", "vector"])

    def numbered(batches):
        part, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = pa.array(np.arange(upto, upto + batch.num_rows))
            upto += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), place, *batch.columns[2:]],
                ["curve", "part", "place", "entry", "vector"],
            )

    order = ["curve", "key", "entry"]
    dealt = index.select("entry", "vector").mapInArrow(keyed, "curve int, key long, entry long, vector binary")
    sorted_ = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(
        sorted_.mapInArrow(numbered, "curve int, part int, place long, entry long, vector binary"), "curves"
    )
    sizes = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    base = running_base(sizes, ["curve"], ["part"], "n", "base").select("curve", "part", "base", "least")
    return placed.join(F.broadcast(base), ["curve", "part"]).select(  # a row per curve and file
        "curve", (F.col("base") + F.col("place") - F.col("least")).alias("rank"), "entry", "vector"
    )


def _best(scores: np.ndarray, entry: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: largest score, then smallest vec_id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((least[at], -scores[at]))[:k]]


def _trial_window(index: DataFrame, ranked: DataFrame, queries: DataFrame, width: int, n_curves: int, k: int, target: float) -> int:
    """The smallest window that finds ``target`` of the brute-force neighbours of a few queries."""
    trial = thin(queries, queries.count(), TRIAL_QUERIES, "entry").orderBy(F.xxhash64("entry"), "entry").limit(TRIAL_QUERIES).collect()
    if not trial:
        return 0
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(([r.entry for r in trial], _vectors([r.vector for r in trial], width)))

    def brute(batches):
        own, vectors = shared.value
        best: list[list[tuple[float, int]]] = [[] for _ in own]
        for batch in batches:
            if not batch.num_rows:
                continue
            entry = np.asarray(batch.column(0))
            scores = vectors @ _vectors(batch.column(1).to_pylist(), width).T
            for i in range(len(own)):
                at = _best(scores[i], entry, entry, k)
                best[i] = sorted(best[i] + [(-s, e) for s, e in zip(scores[i, at].tolist(), entry[at].tolist())])[:k]
        rows = [(q, e, -s) for q, b in zip(own, best) for s, e in b]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            ["query", "entry", "score"],
        )

    found = index.select("entry", "vector").mapInArrow(brute, "query long, entry long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    true = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query", "entry").collect()
    wanted = sorted({r.entry for r in true} | {r.query for r in true})
    ids = spark.createDataFrame([(e,) for e in wanted], "entry long")
    at = np.zeros((n_curves, len(wanted)), np.int64)
    where = {e: i for i, e in enumerate(wanted)}
    for r in ranked.select("curve", "rank", "entry").join(F.broadcast(ids), "entry").collect():
        at[r.curve, where[r.entry]] = r["rank"]
    pairs = np.array([(where[r.query], where[r.entry]) for r in true if r.query != r.entry]).reshape(-1, 2)
    if not len(pairs):
        return 1
    gaps = np.abs(at[:, pairs[:, 0]] - at[:, pairs[:, 1]]).min(0)
    return int(np.quantile(gaps, target, method="higher")) + 1


def search(rows: DataFrame, every: int = 20, k: int = 20, target: float = 0.95, n_curves: int = CURVES, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``."""
    usable, width = _usable(rows)
    index = stored(
        entries(usable, k).select("vector", "ids", "entry").mapInArrow(_packed, "ids array<long>, entry long, vector binary"), "entries"
    )
    sample = thin(index, index.count(), SAMPLE, "vector").orderBy(F.xxhash64("vector"), "entry").limit(SAMPLE).select("vector").collect()
    curves = Curves(_vectors([r.vector for r in sample], width) if sample else np.zeros((0, max(1, width))), max(1, width), n_curves, DIMENSIONS, seed)
    asked = usable.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()

    def pack_queries(batches):
        for batch in batches:
            values = np.ascontiguousarray(batch.column(1).flatten(), "<f4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], ["query_id", "vector"])

    asked = asked.mapInArrow(pack_queries, "query_id long, vector binary")
    asked = stored(lookup(asked, ["vector"], index.select("vector", "entry"), ["query_id"]).select("query_id", "entry"), "queries")
    ranked = ranks(index, curves, width)
    searched = stored(ranked.join(asked.select("entry").distinct(), "entry", "left_semi"), "asked")
    window = _trial_window(index, ranked, searched.filter("curve = 0").select("entry", "vector"), width, n_curves, k, target)

    reach = F.sequence(F.greatest(F.col("rank") - window, F.lit(0)), F.col("rank") + window, F.lit(SEGMENT).cast("long"))
    parts = F.array_distinct(F.transform(F.array_append(reach, F.col("rank") + window), lambda r: F.floor(r / SEGMENT)))
    sent = searched.select("curve", F.explode(parts).alias("segment"), "rank", "entry", "vector")
    held = (
        ranked.join(index.select("entry", F.element_at("ids", 1).alias("least")), "entry")
        .select("curve", F.floor(F.col("rank") / SEGMENT).alias("segment"), "rank", "entry", "least", "vector")
    )

    # A segment that many windows reach meets their queries block by block.
    blocks = sent.groupBy("curve", "segment").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    own_block = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    sent = sent.join(blocks, ["curve", "segment"]).withColumn("block", own_block).drop("blocks")
    reached = blocks.select(*[F.col(c).alias(c) for c in ("curve", "segment")], F.sequence(F.lit(0), F.col("blocks") - 1).alias("each"))
    held = held.join(reached, ["curve", "segment"]).withColumn("block", F.explode("each")).drop("each")

    def look(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            own = own.sort_values("rank")
            rank, entry, least = (own[c].to_numpy() for c in ("rank", "entry", "least"))
            vectors = _vectors(own["vector"].tolist(), width)
            for at in range(0, len(queries), 128):
                part = queries.iloc[at : at + 128]
                scores = _vectors(part["vector"].tolist(), width) @ vectors.T
                for i, (q, r) in enumerate(zip(part["entry"], part["rank"])):
                    a, b = np.searchsorted(rank, [r - window, r + window + 1])
                    if a < b:
                        best = a + _best(scores[i, a:b], entry[a:b], least[a:b], k + 1)
                        out.append((q, entry[best].tolist(), least[best].tolist(), scores[i, best].tolist()))
        return pd.DataFrame(out, columns=["query", "entries", "least", "scores"])

    met = (
        held.groupBy("curve", "segment", "block")
        .cogroup(sent.groupBy("curve", "segment", "block"))
        .applyInPandas(look, "query long, entries array<long>, least array<long>, scores array<double>")
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        best = {}
        for es, ls, ss in zip(pdf["entries"], pdf["least"], pdf["scores"]):
            best.update(zip(es.tolist(), zip((-ss).tolist(), ls.tolist())))
        top = sorted(best, key=best.get)[: k + 1]
        return pd.DataFrame({"query": pdf["query"].iloc[0], "entry": top, "score": [-best[e][0] for e in top]})

    top = met.groupBy("query").applyInPandas(merge, "query long, entry long, score double")
    lists = (
        top.join(index.select("entry", "ids"), "entry")
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids"))).alias("found"))
    )
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["s"].alias("s"), i.alias("vec_id")))))
    first = lists.select(F.col("query").alias("entry"), F.slice(F.array_sort(flat), 1, k + 1).alias("found"))
    answered = lookup(asked, ["entry"], first, ["query_id"])
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(own).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
