"""Repeated byte strings by a common-prefix interval tree over a sparse suffix array.

Every string of ``length`` bytes has one anchor, the smallest hashed gram inside it, so equal strings
have equal anchors at equal places. Neighbouring strings with one anchor form a stretch; stretches
whose anchor occurs once in the corpus cannot repeat and are dropped behind a Bloom field. For each
other anchor the suffixes that start at it are sorted; a stack scan of their common prefixes gives the
intervals of the tree, and inside each interval the sorted left contexts tell how far to the left, and
with how many different left extensions, its members agree: the maximal repeats with all occurrences.

Equal stretches are one suffix however often they occur. An anchor with more than ``WIDE`` different
stretches is not gathered in a task: the strings of its stretches are counted by hash in Spark.

Defined results: null text counts as empty; texts shorter than ``length`` keep all bytes; equal texts
of at least ``length`` bytes lose all bytes; repeated rows are separate rows; null doc_ids stay null;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import attach_totals, bloom_field, field_bits, in_field, lookup, stored, strings

LENGTH = 200
GRAM = 32
WIDE = 50_000
MAX_BITS = 1 << 30
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_RANDOM = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RANGES = "array<struct<s: int, e: int>>"


# --- anchors ------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) at every place."""
    h = _RANDOM[raw]
    size = 1
    while size < gram:
        right = h[size:]
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))
        size *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` places the leftmost smallest hash; fewer than 2**20 places."""
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least & _LOW).astype(np.int64)


def stretches(texts: list[bytes], length: int, gram: int):
    """Yield (text number, its bytes in a buffer, hash of anchor, start, end, anchor place, offset) arrays per buffer.

    ``start`` and ``end`` bound the bytes of a stretch in the buffer; start - offset is its place in the text.
    """
    pieces, held = [], 0

    def flush():
        buffer = b"".join(p for _, _, p in pieces)
        sizes = np.array([len(p) for _, _, p in pieces])
        ends = np.cumsum(sizes)
        hashes = gram_hashes(np.frombuffer(buffer, np.uint8), gram)
        chosen = anchors(hashes, length - gram + 1)
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(chosen)]
        valid = np.arange(len(chosen)) + length <= ends[piece]
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]]
        first = np.flatnonzero(new & valid)
        change = np.flatnonzero(np.r_[new[1:] | ~valid[1:], True] & valid)
        owner = np.array([i for i, _, _ in pieces])[piece[first]]
        offset = (ends - sizes - np.array([o for _, o, _ in pieces]))[piece[first]]
        return owner, buffer, hashes[chosen[first]].view(np.int64), first, change + length, chosen[first], offset

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _PIECE - length + 1):
            part = text[at : at + _PIECE]
            if len(part) < length:
                continue
            if held + len(part) > _PIECE:
                if pieces:
                    yield flush()
                pieces, held = [], 0
            pieces.append((i, at, part))
            held += len(part)
    if pieces:
        yield flush()


def _anchor_rows(length: int, gram: int):
    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for _, buffer, anchor, start, end, _, _ in stretches(strings(batch.column(0)), length, gram):
                own = [digest(buffer[a:b]) for a, b in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(np.array(own, np.uint64).view(np.int64))], ["anchor", "stretch"]
                )

    return run


def _text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _low(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)[:, 0].copy()


def _key_hashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_low(batch.column(0).to_pylist()))], ["h"])


def _candidate_rows(shared, length: int, gram: int):
    """Stretches whose anchor may occur again; their bytes where it may occur with other bytes."""

    def run(batches):
        repeated, varied = shared.value
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = strings(batch.column(0))
            for owner, buffer, anchor, start, end, place, offset in stretches(texts, length, gram):
                kept = np.flatnonzero(in_field(repeated, anchor))
                if not len(kept):
                    continue
                anchor, start, end, owner = anchor[kept], start[kept], end[kept], owner[kept]
                wanted = in_field(varied, anchor).tolist()
                spans = list(zip(start.tolist(), end.tolist()))
                bodies = [buffer[a:b] for a, b in spans]
                keys = {i: _text_key(texts[i]) for i in set(owner.tolist())}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor),
                        pa.array(np.array([digest(b) for b in bodies], np.uint64).view(np.int64)),
                        pa.array([keys[i] for i in owner.tolist()], pa.binary()),
                        pa.array(start - offset[kept]),
                        pa.array((place[kept] - start).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)),
                        pa.array([b if w else None for b, w in zip(bodies, wanted)], pa.binary()),
                    ],
                    ["anchor", "stretch", "key", "at", "place", "size", "body"],
                )

    return run


# --- interval tree ------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """Stack scan: (prefix length, first, last) of every interval of the common-prefix tree."""
    stack = [(0, 0)]  # prefix length, first suffix
    for i, value in enumerate([*lcp, 0], 1):
        first = i - 1
        while stack[-1][0] > value:
            height, first = stack.pop()
            yield height, first, i - 1
        if stack[-1][0] < value:
            stack.append((value, first))


def repeats(bodies: list[bytes], places: list[int], length: int) -> list[tuple[int, int, list[int], bool]]:
    """Repeats of at least ``length`` bytes around one anchor: (left, right, members, maximal).

    Members agree on ``left`` bytes before and ``right`` bytes from the anchor. ``maximal`` tells that their
    left extensions differ; what is not maximal is covered by a longer repeat of the same members.
    """
    right = [b[p:] for b, p in zip(bodies, places)]
    left = [b[:p][::-1] for b, p in zip(bodies, places)]
    order = sorted(range(len(bodies)), key=right.__getitem__)
    lcp = [common(right[i], right[j]) for i, j in zip(order, order[1:])]
    found = []
    for height, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        shared = [common(left[i], left[j]) for i, j in zip(members, members[1:])]
        nodes = list(intervals(shared))
        if min(shared) == 0:
            nodes.append((0, 0, len(shared)))
        for depth, a, b in nodes:
            if depth + height >= length:
                inside = members[a : b + 1]
                extensions = {left[i][depth : depth + 1] for i in inside}
                found.append((depth, height, inside, len(extensions) > 1 or b"" in extensions))
    return found


def repeated_ranges(bodies: list[bytes], places: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each stretch the byte ranges that repeat in another one."""
    ranges: list[set[tuple[int, int]]] = [set() for _ in bodies]
    for left, right, members, maximal in repeats(bodies, places, length):
        if maximal:
            for i in members:
                ranges[i].add((places[i] - left, places[i] + right))
    return [sorted(r) for r in ranges]


def _scan(length: int):
    """Stream stretches sorted by anchor; the last anchor waits for the next batch."""

    def one(rows):
        found = repeated_ranges([r[3] for r in rows], [r[2] for r in rows], length)
        return [(r[0], r[1], [{"s": s, "e": e} for s, e in x]) for r, x in zip(rows, found) if x]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        out += one(held)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out_rows(out), schema=_OUT)
        if len(held) > 1 and (out := one(held)):
            yield pa.RecordBatch.from_pylist(out_rows(out), schema=_OUT)

    return run


def out_rows(rows: list[tuple]) -> list[dict]:
    return [{"anchor": a, "stretch": s, "ranges": r} for a, s, r in rows]


_OUT = pa.schema([
    ("anchor", pa.int64()), ("stretch", pa.int64()), ("ranges", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
])


def _each_string(length: int):
    """(anchor, stretch, start, two hashes) of every string of a stretch, for anchors too common for one task."""

    def run(batches):
        for batch in batches:
            for anchor, stretch, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                n = len(body) - length + 1
                keys = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n, pa.int64()), pa.array([stretch] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(keys, pa.binary())],
                    ["anchor", "stretch", "s", "string"],
                )

    return run


def _marks(candidates: DataFrame, length: int, wide: int) -> DataFrame:
    """(anchor, stretch, ranges): the repeated byte ranges of every stretch that has some."""
    kinds = stored(
        candidates.groupBy("anchor", "stretch").agg(
            F.count(F.lit(1)).alias("times"), F.max("place").alias("place"), F.max("size").alias("size"), F.max("body").alias("body")
        ),
        "stretches",
        compression="zstd",
    )
    whole = kinds.filter("times > 1").select(
        "anchor", "stretch", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e"))).cast(_RANGES).alias("ranges")
    )
    varied = kinds.filter("body is not null").select("anchor", "stretch", "place", "body")
    many = varied.groupBy("anchor").count().filter(F.col("count") > wide).select("anchor")
    # Each of these anchors stands for more than ``wide`` rows, so the list is a tiny part of them.
    narrow = (
        varied.join(F.broadcast(many), "anchor", "left_anti")
        .repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_scan(length), f"anchor long, stretch long, ranges {_RANGES}")
    )
    each = varied.join(F.broadcast(many), "anchor", "left_semi").mapInArrow(
        _each_string(length), "anchor long, stretch long, s int, string binary"
    )
    common_ = (
        attach_totals(each, ["anchor", "string"], [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], ["stretch"])
        .filter("n > 1")
        .groupBy("anchor", "stretch")
        .agg(F.collect_list(F.struct("s", (F.col("s") + length).alias("e"))).cast(_RANGES).alias("ranges"))
    )
    return whole.unionByName(narrow).unionByName(common_)


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, spans): repeated byte ranges by text, keyed by a 128-bit hash of the text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    kinds = texts.mapInArrow(_anchor_rows(length, gram), "anchor long, stretch long").groupBy("anchor", "stretch").count()
    repeated = stored(
        kinds.groupBy("anchor").agg(F.sum("count").alias("times"), F.count(F.lit(1)).alias("kinds")).filter("times > 1"), "anchors"
    )
    varied = repeated.filter("kinds > 1").select("anchor")
    fields = (
        bloom_field(repeated.select("anchor"), field_bits(repeated.count(), max_bits)),
        bloom_field(varied, field_bits(varied.count(), max_bits)),
    )
    candidates = stored(
        texts.mapInArrow(
            _candidate_rows(spark.sparkContext.broadcast(fields), length, gram),
            "anchor long, stretch long, key binary, at long, place int, size int, body binary",
        ),
        "candidates",
        compression="zstd",
    )
    marks = stored(_marks(candidates, length, wide), "marks")
    seen = candidates.select("anchor", "stretch", "key", "at").distinct()  # equal texts once
    # Parts of one stretch's ranges from two of the three ways are separate rows of marks; join them all.
    both = marks.groupBy("anchor", "stretch").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    placed = lookup(seen, ["anchor", "stretch"], both, ["key", "at"]).filter("ranges is not null")
    gathered = placed.groupBy("key").agg(
        F.flatten(F.collect_list(F.expr("transform(ranges, r -> struct(at + r.s as s, at + r.e as e))"))).alias("spans")
    )
    return gathered.mapInArrow(_merge_spans, "key binary, spans array<struct<s: long, e: long>>")


def merge_ranges(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (owner, start, end) of ranges that overlap or touch, for all owners at once."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    shift = owner * (int(end.max()) + 2) if len(end) else owner  # keeps owners apart in one running maximum
    reach = np.maximum.accumulate(end + shift)
    first = np.flatnonzero(np.r_[True, (start + shift)[1:] > reach[:-1]]) if len(end) else np.zeros(0, np.int64)
    last = np.r_[first[1:] - 1, len(end) - 1] if len(end) else first
    return owner[first], start[first], (reach - shift)[last]


def _merge_spans(batches):
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        sizes = np.diff(np.asarray(lists.offsets))
        owner, start, end = merge_ranges(
            np.repeat(np.arange(len(sizes)), sizes), np.asarray(flat.field("s")), np.asarray(flat.field("e"))
        )
        upto = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(sizes)))].astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["s", "e"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], ["key", "spans"])


# --- removal ------------------------------------------------------------------


def without(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the bytes of merged, ordered ``spans``."""
    kept, end = [], 0
    for span in spans:
        kept.append(text[end : span["s"]])
        end = span["e"]
    kept.append(text[end:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    spark = docs.sparkSession
    spans = stored(repeat_spans(docs, length, gram, wide, max_bits), "spans")
    keys = spans.select("key").mapInArrow(_key_hashes, "h long")
    shared = spark.sparkContext.broadcast(bloom_field(keys, field_bits(spans.count(), max_bits)))
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def probe(batches):
        for batch in batches:
            keys = [_text_key(t) for t in strings(batch.column(1))]
            hit = in_field(shared.value, _low(keys))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary()), pa.array(hit)], ["doc_id", "text", "key", "hit"]
            )

    flagged = given.mapInArrow(probe, "doc_id long, text string, key binary, hit boolean")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches):
        for batch in batches:
            texts = strings(batch.column(1))
            spans_ = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            rows = []
            for text, own in zip(texts, spans_):
                kept = without(text, own) if own else text
                rows.append((len(text), len(text) - len(kept), len(own or ()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    straight = flagged.filter(~F.col("hit")).select("doc_id", "text").mapInArrow(digest, out)
    cut = lookup(flagged.filter("hit").drop("hit"), ["key"], spans, ["doc_id"])
    return straight.unionByName(cut.select("doc_id", "text", "spans").mapInArrow(digest, out))
