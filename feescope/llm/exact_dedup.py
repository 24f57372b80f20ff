"""Exact deduplication by two-pass Bloom filtering.

Pass one counts, per cell of a hashed bit field, whether one or more rows fall into it. Pass two
probes every row: a row one of whose cells was met once is unique and passes straight through;
only rows that may be repeated are shuffled and compared by their full SHA-256.

Defined results: null text counts as empty; all texts that are empty after normalisation form one
group; of equal texts the one with most code points stays, then the smallest doc_id (null last);
rows equal in all of that and in doc_id are one row to ``keep_one`` and all ``kept`` in
``duplicate_groups``; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from feescope.llm.common import attach_totals, fresh, stored, strings

_BLANKS = b" \t\n\x0b\x0c\r"
_SEGMENT = 1 << 16
#: Cells per row, and the largest field in bits; the driver and each task hold that many bits.
CELLS_PER_ROW = 16
MAX_BITS = 1 << 30
_SLIM = "doc_id long, text_sha256 string, n_points long"


def _digests(texts: list[bytes]) -> list[str]:
    return [hashlib.sha256(t.translate(None, _BLANKS)).hexdigest() for t in texts]


def _slim(batches):
    for batch in batches:
        text = batch.column(1)
        points = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_digests(strings(text)), pa.string()), points],
            ["doc_id", "text_sha256", "n_points"],
        )


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the normalised text, code points of the original."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_slim, _SLIM)


def _cells(digests: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(d[:32] for d in digests)), "<u8").reshape(-1, 2)
    mask = np.uint64(bits - 1)
    return (raw[:, 0] & mask).astype(np.int64), (raw[:, 1] & mask).astype(np.int64)


def _field_size(n_rows: int, max_bits: int) -> int:
    wanted = max(_SEGMENT, CELLS_PER_ROW * n_rows)
    return min(max_bits, 1 << (wanted - 1).bit_length())


def repeated_cells(slim: DataFrame, n_rows: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """The bit field of cells met by two rows or more, merged segment by segment in Spark.

    Each task sends the cells it met (two bytes each) to their segment; a segment answers with
    its repeated cells only. The driver assembles at most ``max_bits`` bits.
    """
    bits = _field_size(n_rows, max_bits)

    def count(batches):
        seen = [np.concatenate(_cells(batch.column(0).to_pylist(), bits)) for batch in batches if batch.num_rows]
        if not seen:
            return
        cells, times = np.unique(np.concatenate(seen), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // _SEGMENT)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cells)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((cells[starts] // _SEGMENT).astype(np.int32)),
                pa.array([(cells[a:b] % _SEGMENT).astype("<u2").tobytes() for a, b in zip(starts, ends)], pa.binary()),
                pa.array([(times[a:b] > 1).astype(np.uint8).tobytes() for a, b in zip(starts, ends)], pa.binary()),
            ],
            ["segment", "cells", "more"],
        )

    def merge(pdf):
        met = np.zeros(_SEGMENT, np.int64)
        for cells, more in zip(pdf["cells"], pdf["more"]):
            met[np.frombuffer(cells, "<u2")] += 1 + np.frombuffer(more, np.uint8)
        field = np.packbits(met > 1, bitorder="little").tobytes()
        return pdf.iloc[:1][["segment"]].assign(field=[field if (met > 1).any() else b""])

    met = slim.select("text_sha256").mapInArrow(count, "segment int, cells binary, more binary")
    fields = met.groupBy("segment").applyInPandas(merge, "segment int, field binary")
    field = np.zeros(bits // 8, np.uint8)
    for row in fields.filter(F.length("field") > 0).toLocalIterator():
        start = row.segment * (_SEGMENT // 8)
        field[start : start + _SEGMENT // 8] = np.frombuffer(row.field, np.uint8)
    return field


def _maybe(field: np.ndarray, digests: list[str]) -> np.ndarray:
    if not digests:
        return np.zeros(0, bool)
    one, two = _cells(digests, len(field) * 8)
    return ((field[one >> 3] >> (one & 7)) & (field[two >> 3] >> (two & 7)) & 1).astype(bool)


def _flagged(slim: DataFrame, field: np.ndarray) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(field)

    def probe(batches):
        for batch in batches:
            flags = _maybe(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], [*batch.schema.names, "maybe"])

    return slim.mapInArrow(probe, f"{_SLIM}, maybe boolean")


def _rank():
    return F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))


def duplicate_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = stored(text_digests(docs), "digests")
    flagged = _flagged(slim, repeated_cells(slim, slim.count(), max_bits))
    straight = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    grouped = attach_totals(
        flagged.filter("maybe"),
        ["text_sha256"],
        [F.min(_rank()).alias("_best"), F.count(F.lit(1)).alias("_n")],
        [F.min("_best").alias("_best"), F.sum("_n").alias("group_size")],
        ["doc_id", "n_points"],
    )
    return straight.unionByName(
        grouped.select(
            "doc_id", F.col("_best.c").alias("keep_id"), "group_size", (_rank() == F.col("_best")).alias("kept"), "text_sha256"
        )
    )


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every group of equal texts; rows of unique texts never shuffle.

    Null counts as empty, so of all null, empty and blank texts one row stays; ties go to the smaller doc_id, null last; of
    rows equal in doc_id too any one stays; an empty table gives an empty one. Other columns may have any name.
    """
    columns = docs.columns
    slim = stored(text_digests(docs), "digests")
    shared = docs.sparkSession.sparkContext.broadcast(repeated_cells(slim, slim.count(), max_bits))
    at = columns.index("text")
    sha, points, maybe, keep = fresh(columns, "_sha", "_points", "_maybe", "_keep")

    def probe(batches):
        for batch in batches:
            text = batch.column(at)
            digests = _digests(strings(text))
            more = [
                pa.array(digests, pa.string()),
                pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()),
                pa.array(_maybe(shared.value, digests)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, sha, points, maybe])

    schema = StructType(docs.schema.fields[:]).add(sha, "string").add(points, "long").add(maybe, "boolean")
    rows = docs.select(*columns).mapInArrow(probe, schema)
    best = (
        _flagged(slim, shared.value)
        .filter("maybe")
        .groupBy(F.col("text_sha256").alias(sha))
        .agg(F.min(_rank()).alias("best"))
        .select(sha, (-F.col("best.a")).alias(points), F.col("best.c").alias(keep))
    )
    repeated = rows.filter(maybe).withColumn(keep, F.col("doc_id").cast("long"))
    # The key holds doc_id, so a large group meets one matching row and spreads over all tasks.
    found = repeated.join(
        best,
        (repeated[sha] == best[sha]) & (repeated[points] == best[points]) & repeated[keep].eqNullSafe(best[keep]),
        "left_semi",
    )
    one = found.dropDuplicates([sha])  # combined map-side: rows equal in doc_id too
    return rows.filter(~F.col(maybe)).select(*columns).unionByName(one.select(*columns))
