"""Helpers shared by the operators: stored intermediates, salted joins, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Pieces that the rows of one key are dealt into before they meet its aggregate.
SALTS = 64


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Arrow batches of fewer rows keep the memory of a worker and its executor small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place all executors share (``spark.checkpoint.dir``).

    Only a plain local master, with driver and executors on one disk, may fall back to a
    temporary folder; the setting is then made for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="feescope-llm-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, n_rows: int, rows: int = 50_000) -> DataFrame:
    """``df`` in partitions of about ``rows`` of its ``n_rows`` at least, so that a small table is not a file for each shuffle partition."""
    return df.coalesce(1 + n_rows // rows)


def map_arrow(
    df: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over batches; ``make`` sees the whole partition as a stream."""
    return df.mapInArrow(make, schema)


def strings(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with as many leading underscores more as it takes to differ from ``columns``, whatever their case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def thin(rows: DataFrame, n_rows: int, wanted: int, *columns: str) -> DataFrame:
    """About ``3 * wanted`` of the rows, by hash of ``columns``; all, if there are no more.

    Before an ordered limit: every task sends its own best rows on, so without this what the driver
    gets would grow with the number of tasks.
    """
    if n_rows <= 3 * wanted:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*columns, F.lit(3)), F.lit(1 << 40)) < int(3 * wanted / n_rows * (1 << 40)))


def salt_of(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def lookup(rows: DataFrame, keys: list[str], values: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` left-joined to ``values`` (one row per ``keys``), however many rows share a key.

    The keys' distinct (key, salt) pairs fetch the value first, so that a key with a third of
    all rows meets at most ``SALTS`` copies of its value, each in a task of its own.
    """
    salted = rows.withColumn("_salt", salt_of(*spread))
    pairs = salted.select(*keys, "_salt").distinct().join(values, keys)
    return salted.join(pairs, [*keys, "_salt"], "left").drop("_salt")


def attach_totals(
    rows: DataFrame, keys: list[str], partial: list[Column], final: list[Column], spread: list[str]
) -> DataFrame:
    """Every row with its group's aggregates.

    ``partial`` aggregates rows by (keys, salt), ``final`` the partial rows by keys; the result
    goes back to the (keys, salt) pieces, so no group is ever read by one task.
    """
    salted = rows.withColumn("_salt", salt_of(*spread))
    pieces = salted.groupBy(*keys, "_salt").agg(*partial)
    totals = pieces.groupBy(*keys).agg(*final, F.collect_list("_salt").alias("_salts"))
    back = totals.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(back, [*keys, "_salt"]).drop("_salt")


def running_base(totals: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``totals`` with the sum of ``value`` over the rows before each, inside ``by``.

    For tables of one row per bucket; a global order (``by`` empty) therefore stays small.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))


_SEGMENT = 1 << 16


def field_bits(n_keys: int, max_bits: int) -> int:
    """A power of two of about 16 to 32 bits a key, at most ``max_bits``."""
    return min(max_bits, max(_SEGMENT, 1 << (16 * n_keys).bit_length()))


def _field_cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    keys = keys.view(np.uint64)
    turned = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (keys & mask).astype(np.int64), ((turned >> np.uint64(20)) & mask).astype(np.int64)


def in_field(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may be in the Bloom field; never False for one that is."""
    one, two = _field_cells(np.ascontiguousarray(keys, np.int64), len(field) * 8)
    return ((field[one >> 3] >> (one & 7)) & (field[two >> 3] >> (two & 7)) & 1).astype(bool)


def bloom_field(keys: DataFrame, bits: int) -> np.ndarray:
    """Bloom field of a column of well-mixed longs, built by segment in Spark; ``bits`` bits in all."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.unique(np.concatenate(_field_cells(np.ascontiguousarray(batch.column(0), np.int64), bits)))
            cuts = np.flatnonzero(np.diff(cells // _SEGMENT)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(cells)]
            parts = [(cells[a:b] % _SEGMENT).astype("<u2").tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((cells[starts] // _SEGMENT).astype(np.int32)), pa.array(parts, pa.binary())], ["segment", "cells"]
            )

    def merge(pdf):
        met = np.zeros(_SEGMENT, bool)
        for cells in pdf["cells"]:
            met[np.frombuffer(cells, "<u2")] = True
        return pdf.iloc[:1][["segment"]].assign(field=[np.packbits(met, bitorder="little").tobytes()])

    parts = keys.mapInArrow(spread, "segment int, cells binary")
    field = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("segment").applyInPandas(merge, "segment int, field binary").toLocalIterator():
        start = row.segment * (_SEGMENT // 8)
        field[start : start + _SEGMENT // 8] = np.frombuffer(row.field, np.uint8)
    return field
