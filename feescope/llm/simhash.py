"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are dealt to upper nodes by shared masked bit patterns. Inside a node they
are sorted by Gray rank and grouped again; every group keeps the bits its members agree on, so a
query whose accumulated differences on those bits exceed the limit skips the whole group. A node
emits a spanning forest of its links, never all pairs. (The filter by similarity adds a second pass over pairs of
unlike components, see ``similar_components``.)

``exact_masks`` loses no pair: with 64 bits in ``blocks`` equal blocks and at most r differing
bits, some ``blocks - r`` blocks agree. With 8 blocks and r = 2 a node holds at most 2^16 distinct
fingerprints, whatever the data.

Defined results: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; repeated rows share a
fingerprint; the component of rows without any doc_id is null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from feescope.llm.common import attach_totals, bloom_field, few_files, field_bits, fresh, in_field, lookup, stored, strings
from feescope.llm.components import connected_components

_SEED = 42
_SLICE = 1 << 16
_FAN = 32


# --- fingerprints -------------------------------------------------------------


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every shingle of ``words`` words, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, _SEED)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], _SEED) for a, b in zip(starts.tolist(), ends)]


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are well-mixed functions of it."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, owner: np.ndarray, n_docs: int, lanes: int) -> np.ndarray:
    """(n_docs, lanes) fingerprints; ``owner`` is the document of each hash, ascending."""
    counts = np.zeros((n_docs, lanes, 64), np.int64)
    for at in range(0, len(hashes), _SLICE):
        own = owner[at : at + _SLICE]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for lane in range(lanes):
            bits = np.unpackbits(
                np.ascontiguousarray(_mixed(hashes[at : at + _SLICE], lane), "<u8").view(np.uint8).reshape(-1, 8),
                axis=1, bitorder="little",
            )
            counts[own[first], lane] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=n_docs)[:, None, None]
    return np.packbits(2 * counts > total, axis=2, bitorder="little").view("<u8").reshape(n_docs, lanes)


def _prints(hashes: list, lanes: int) -> list[bytes]:
    flat = np.concatenate([np.asarray(one, np.uint64) for one in hashes])
    owner = np.repeat(np.arange(len(hashes)), [len(one) for one in hashes])
    prints = majority(flat, owner, len(hashes), lanes).astype(">u8")
    return [prints[i].tobytes() for i in range(len(hashes))]


def _fingerprinted(words: int, lanes: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = _prints([shingle_hashes(t, words) for t in strings(part.column(1))], lanes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and ``bits``, 64 x ``lanes`` bits, most significant first."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(_fingerprinted(words, lanes), "doc_id long, bits binary")


# --- index --------------------------------------------------------------------


def exact_masks(max_bits: int = 2, blocks: int = 8) -> list[np.ndarray]:
    """One mask for each choice of ``blocks - max_bits`` blocks of the 64 bits."""
    width = 64 // blocks
    block = [((1 << width) - 1) << (width * i) for i in range(blocks)]
    return [np.array([sum(block[i] for i in kept)], np.uint64) for kept in combinations(range(blocks), blocks - max_bits)]


def random_masks(lanes: int, bits: int, n_masks: int, seed: int = _SEED) -> list[np.ndarray]:
    """``n_masks`` masks of ``bits`` random positions out of 64 x ``lanes``."""
    rng = np.random.default_rng(seed)
    masks = []
    for _ in range(n_masks):
        mask = np.zeros(64 * lanes, np.uint8)
        mask[rng.choice(64 * lanes, bits, replace=False)] = 1
        masks.append(np.packbits(mask, bitorder="little").view("<u8"))
    return masks


def _words(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)


def _keyed(masks: list[np.ndarray], first: int = 0):
    """A row of every mask; the masks are numbered from ``first``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column(1))
            for i, mask in enumerate(masks):
                key = np.zeros(len(words), np.uint64)
                for lane in range(words.shape[1]):
                    key = _mixed(key, 1) ^ (words[:, lane] & mask[lane])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(words), first + i, np.int32)), pa.array(key.view(np.int64)), *batch.columns],
                    ["mask", "key", *batch.schema.names],
                )

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of every word in the reflected Gray order."""
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Level:
    """Groups of ``_FAN`` consecutive items and the bit pattern each group's members share."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        starts = np.arange(0, len(low), _FAN)
        self.low = np.bitwise_and.reduceat(low, starts, axis=0)
        self.high = np.bitwise_or.reduceat(high, starts, axis=0)

    def near(self, query: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
        """Whether a member of ``group`` can be within ``limit`` bits of the query."""
        low, high = self.low[group], self.high[group]
        return np.bitwise_count((query ^ low) & ~(low ^ high)).sum(axis=-1, dtype=np.int32) <= limit


#: Pairs of a query and a row, or a group, that are looked at together.
_TOGETHER = 1 << 18


def near_pairs(words: np.ndarray, limit: int):
    """Yield arrays (i, j), i > j, of rows within ``limit`` bits; rows must be in Gray order."""
    leaves = _Level(words, words)
    tops = _Level(leaves.low, leaves.high)
    n, n_leaves = len(words), len(leaves.low)
    fan = np.arange(_FAN)
    chunk = max(1, min(256, _TOGETHER // max(1, n)))
    for at in range(0, n, chunk):
        queries = np.arange(at, min(n, at + chunk))
        upto = np.arange((queries[-1] // _FAN) // _FAN + 1)
        q, g = np.repeat(queries, len(upto)), np.tile(upto, len(queries))
        for level, size in ((tops, n_leaves), (leaves, n)):
            keep = level.near(words[q], g, limit)
            q, g = q[keep], g[keep]
            q, g = np.repeat(q, _FAN), (g[:, None] * _FAN + fan).ravel()
            inside = g < size
            q, g = q[inside], g[inside]
        keep = g < q
        q, g = q[keep], g[keep]
        keep = _distance(words[q], words[g]) <= limit
        yield q[keep], g[keep]


def spanning_links(words: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest of the graph of rows within ``limit`` bits."""
    n = len(words)
    if n == 2:
        return [(1, 0)] if _distance(words[0], words[1]) <= limit else []
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = np.lexsort([gray_rank(words[:, lane]) for lane in reversed(range(words.shape[1]))])
    links = []
    ordered = words[order]
    for left, right in near_pairs(ordered, limit):
        label = parent
        while (label[label] != label).any():
            label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
        nearest = np.argsort(_distance(ordered[left], ordered[right]), kind="stable")  # closest pairs first
        for i, j in zip(left[nearest].tolist(), right[nearest].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(order[i]), int(order[j])))
    return links


def _node_ends(mask: np.ndarray, key: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
    return list(zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()))


def _pairs_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _streamed(links):
    """Stream nodes in (mask, key) order to ``links``; the last, maybe unfinished node waits for the next batch."""

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [_words(c) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if not cut and held and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]):
                yield from links(*map(np.concatenate, zip(*held)))
                held = []
            if cut:
                held.append([x[:cut] for x in now])
                yield from links(*map(np.concatenate, zip(*held)))
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield from links(*map(np.concatenate, zip(*held)))

    return run


def _linked(limit: int):
    def links(mask, key, node, words):
        found_a, found_b = [], []
        for s, e in _node_ends(mask, key):
            for i, j in spanning_links(words[s:e], limit):
                found_a.append(node[s + i])
                found_b.append(node[s + j])
        yield _pairs_batch(found_a, found_b)

    return _streamed(links)


def near_links(nodes: DataFrame, masks: list[np.ndarray], limit: int) -> DataFrame:
    """Links (a, b) between ``nodes`` (node long, bits binary) within ``limit`` bits."""
    keyed = nodes.select("node", "bits").mapInArrow(_keyed(masks), "mask int, key long, node long, bits binary")
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_linked(limit), "a long, b long")


def _as_long(bits: str) -> Column:
    """A 64-bit pattern as a signed long."""
    high = F.conv(F.hex(F.substring(bits, 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(bits, 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def simhash_components(docs: DataFrame, words: int = 3, limit: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(
        prints.groupBy("bits").agg(F.min("doc_id").alias("first_doc")).withColumn("node", _as_long("bits")), "nodes"
    )
    links = near_links(nodes, exact_masks(limit), limit)
    roots = connected_components(links)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = attach_totals(
        placed, ["root"], [F.min("first_doc").alias("c")], [F.min("c").alias("component_id")], ["node"]
    ).select("bits", "component_id")
    found = lookup(prints, ["bits"], named, ["doc_id"])
    return found.select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), "component_id")


# --- filtering by similarity ---------------------------------------------------

#: Chance that a pair exactly at the similarity asked for is within the limit and meets in some node of the index.
RECALL = 0.98
_SLACK = 3.0


def _angle(similarity: float) -> float:
    """Share of bits in which texts of that Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _limit(similarity: float, lanes: int) -> int:
    """Bits in which texts of that similarity differ, plus ``_SLACK`` standard deviations."""
    n_bits, share = 64 * lanes, _angle(similarity)
    return int(n_bits * share + _SLACK * math.sqrt(n_bits * share * (1 - share)))


def chance_met(n_masks: int, bits: int, similarity: float, lanes: int) -> float:
    """Chance that a pair is within the limit and agrees on a mask: the mean over its number of differing bits."""
    n_bits, share = 64 * lanes, _angle(similarity)
    total = 0.0
    for d in range(_limit(similarity, lanes) + 1):
        met = math.comb(n_bits - d, bits) / math.comb(n_bits, bits)
        total += math.comb(n_bits, d) * share**d * (1 - share) ** (n_bits - d) * (1 - (1 - met) ** n_masks)
    return total


def similarity_masks(n_nodes: int, similarity: float, lanes: int) -> list[np.ndarray]:
    """Random masks: about n/4 different values each, enough of them for ``RECALL`` at ``similarity``."""
    bits = max(14, round(math.log2(max(2, n_nodes))) - 2)
    few, enough = 0, 1
    while chance_met(enough, bits, similarity, lanes) < RECALL:
        few, enough = enough, 2 * enough
    while enough - few > 1:
        middle = (few + enough) // 2
        few, enough = (few, middle) if chance_met(middle, bits, similarity, lanes) >= RECALL else (middle, enough)
    return random_masks(lanes, bits, enough)


def _row_key(doc_id: int | None, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text + b"\0" + str(doc_id).encode())


def _row_keys(ids: pa.Array, texts: list[bytes]) -> list[bytes]:
    return [_row_key(i, t) for i, t in zip(ids.to_pylist(), texts)]


def _low(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)[:, 0].copy()


def _key_hashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_low(batch.column(0).to_pylist()))], ["h"])


def _distinct_shingles(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _keyed_prints(words: int, lanes: int):
    """Digest and fingerprint of the distinct shingles: similarity is that of sets, however often each repeats."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = strings(part.column(1))
                keys = pa.array(_row_keys(part.column(0), texts), pa.binary())
                sets = [_distinct_shingles(t, words) for t in texts]
                digests = pa.array([xxhash.xxh3_128_digest(one.astype("<u8").tobytes()) for one in sets], pa.binary())
                bits = pa.array(_prints(sets, lanes), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), keys, digests, bits], ["doc_id", "key", "digest", "bits"]
                )

    return run


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [_distinct_shingles(t, words).view(np.int64) for t in strings(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    return run


#: Bits of a signature: each shingle sets one.
_SIGNATURE = 512


def _signatures(batches):
    """Size and signature of every set of shingles."""
    for batch in batches:
        sizes, signs = [], []
        for grams in batch.column(1):
            grams = np.asarray(grams.values).view(np.uint64)
            met = np.zeros(_SIGNATURE, np.uint8)
            met[(_mixed(grams, 5) % np.uint64(_SIGNATURE)).astype(np.int64)] = 1
            sizes.append(len(grams))
            signs.append(np.packbits(met).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["node", "size", "sign"]
        )


def may_be_similar(size_x, sign_x, size_y, sign_y, least: float) -> np.ndarray:
    """False only for pairs that are surely below ``least``: a bit set in one alone is a shingle the other lacks."""
    alone_x = np.bitwise_count(sign_x & ~sign_y).sum(axis=-1, dtype=np.int64)
    alone_y = np.bitwise_count(sign_y & ~sign_x).sum(axis=-1, dtype=np.int64)
    both = np.minimum(size_x - alone_x, size_y - alone_y)
    return both >= least * (size_x + size_y - both) - 1e-6


# --- candidates of a filter -----------------------------------------------------

#: Rows of a node that are compared without an index: those of one top group.
_SMALL = 32


def _gray_order(words: np.ndarray) -> np.ndarray:
    return np.lexsort([gray_rank(words[:, lane]) for lane in reversed(range(words.shape[1]))])


def _by_size(mask: np.ndarray, key: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[int, int]]]:
    """Rows of nodes of 2 to ``_SMALL`` rows with the number of rows behind each in its node, and spans of larger nodes."""
    edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
    size = ends - starts
    behind = np.repeat(ends, size) - np.arange(len(key)) - 1
    rows = np.flatnonzero(np.repeat((size > 1) & (size <= _SMALL), size))
    large = size > _SMALL
    return (rows, behind[rows]), list(zip(starts[large].tolist(), ends[large].tolist()))


def small_pairs(rows: np.ndarray, behind: np.ndarray):
    """Yield (i, j), i < j, of all pairs of rows of one node, by the distance of their places."""
    for step in range(1, _SMALL):
        stay = behind >= step
        rows, behind = rows[stay], behind[stay]
        if not len(rows):
            return
        yield rows, rows + step


class _Index:
    """Rows in Gray order under two levels of groups."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.leaves = _Level(words, words)
        self.tops = _Level(self.leaves.low, self.leaves.high)

    def near(self, queries: np.ndarray, limit: int):
        """Yield (q, row, distance) of rows within ``limit`` bits of a query."""
        n, n_leaves, n_tops = len(self.words), len(self.leaves.low), len(self.tops.low)
        fan = np.arange(_FAN)
        chunk = max(1, min(256, _TOGETHER // n))
        for at in range(0, len(queries), chunk):
            some = np.arange(at, min(len(queries), at + chunk))
            q, g = np.repeat(some, n_tops), np.tile(np.arange(n_tops), len(some))
            for level, size in ((self.tops, n_leaves), (self.leaves, n)):
                keep = level.near(queries[q], g, limit)
                q, g = q[keep], g[keep]
                q, g = np.repeat(q, _FAN), (g[:, None] * _FAN + fan).ravel()
                inside = g < size
                q, g = q[inside], g[inside]
            gap = _distance(queries[q], self.words[g])
            keep = gap <= limit
            yield q[keep], g[keep], gap[keep]


def unlike_pairs(words: np.ndarray, label: np.ndarray, limit: int):
    """Yield (i, j) of all pairs within ``limit`` bits of unlike label; a label most rows have is not compared with itself."""
    left = np.arange(len(words))
    while len(left) > 1:
        names, counts = np.unique(label[left], return_counts=True)
        if len(names) == 1:
            return
        own = label[left] == names[counts.argmax()]
        if 4 * counts.max() < len(left):
            order = left[_gray_order(words[left])]
            for i, j in near_pairs(words[order], limit):
                i, j = order[i], order[j]
                apart = label[i] != label[j]
                yield i[apart], j[apart]
            return
        held, left = left[own], left[~own]
        held = held[_gray_order(words[held])]
        for q, row, _ in _Index(words[held]).near(words[left], limit):
            yield left[q], held[row]


def star_links(words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j), about one a row, in which every row occurs that has another within ``limit`` bits.

    The row next to the majority of all bits is the first pivot; rows within the limit of a pivot are linked to it, or
    to the row before them in Gray order where that one has the same pivot and is nearer; the first row left in Gray
    order is the next pivot. A group of near copies has few pivots, so its work is in proportion to its size.
    """
    order = _gray_order(words)
    ordered = words[order]
    index = _Index(ordered)
    bits = np.unpackbits(np.ascontiguousarray(ordered, "<u8").view(np.uint8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits), bitorder="little").view("<u8")
    pivot = int(_distance(ordered, middle).argmin())
    free = np.ones(len(ordered), bool)
    first, found = 0, []
    while True:
        (_, row, gap), = index.near(ordered[pivot][None], limit)
        other = row != pivot
        row, gap = row[other], gap[other]
        free[pivot] = False
        new = free[row]
        if new.any():
            row, gap = row[new], gap[new]
            before = np.r_[row[0], row[:-1]]
            nearer = _distance(ordered[row], ordered[before]) < gap
            nearer[0] = False
            found.append((row, np.where(nearer, before, pivot)))
            free[row] = False
        elif len(row):
            found.append((np.array([pivot]), row[gap.argmin()][None]))
        while first < len(free) and not free[first]:
            first += 1
        if first == len(free):
            break
        pivot = first
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate([a for a, _ in found])], order[np.concatenate([b for _, b in found])]


def _nearest_links(i: np.ndarray, j: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest partner among the pairs (i, j)."""
    row, other, gap = np.r_[i, j], np.r_[j, i], np.r_[gap, gap]
    by = np.lexsort((other, gap, row))
    row, other = row[by], other[by]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    return row[first], other[first]


def _loosely_linked(limit: int):
    def links(mask, key, node, words):
        small, large = _by_size(mask, key)
        found = [(np.zeros(0, np.int64),) * 3]
        for i, j in small_pairs(*small):
            gap = _distance(words[i], words[j])
            near = gap <= limit
            found.append((i[near], j[near], gap[near]))
        pairs = [_nearest_links(*map(np.concatenate, zip(*found)))]
        for s, e in large:
            i, j = star_links(words[s:e], limit)
            pairs.append((s + i, s + j))
        i, j = map(np.concatenate, zip(*pairs))
        a, b = node[i], node[j]
        yield _pairs_batch(np.maximum(a, b), np.minimum(a, b))

    return _streamed(links)


def loose_links(nodes: DataFrame, masks: list[np.ndarray], limit: int) -> DataFrame:
    """Links (a, b), repeats included, about one a row of each mask; every node with a candidate occurs in one.

    They need not span a group: what they leave apart, ``open_links`` compares.
    """
    keyed = nodes.select("node", "bits").mapInArrow(_keyed(masks), "mask int, key long, node long, bits binary")
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_loosely_linked(limit), "a long, b long")


def _open(masks: list[np.ndarray], limit: int, least: float):
    """All pairs within ``limit`` of unlike ``label`` that may be similar, each in the first mask it meets in."""

    def links(mask, key, node, words, label, size, sign):
        def candidates():
            small, large = _by_size(mask, key)
            found = [(np.zeros(0, np.int64),) * 2]
            for i, j in small_pairs(*small):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                near = _distance(words[i], words[j]) <= limit
                found.append((i[near], j[near]))
            yield map(np.concatenate, zip(*found))
            for s, e in large:
                for i, j in unlike_pairs(words[s:e], label[s:e], limit):
                    yield s + i, s + j

        for i, j in candidates():
            maybe = may_be_similar(size[i], sign[i], size[j], sign[j], least)
            i, j = i[maybe], j[maybe]
            for n, earlier in enumerate(masks[: mask[i].max(initial=0)]):
                if not len(i):
                    break
                new = (mask[i] <= n) | ((words[i] ^ words[j]) & earlier).any(axis=1)
                i, j = i[new], j[new]
            if len(i):
                yield _pairs_batch(node[i], node[j])

    return _streamed(links)


def open_links(nodes: DataFrame, masks: list[np.ndarray], limit: int, least: float, first: int = 0, last: int | None = None) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, bits, label, size, sign) that no known link joins, see ``_open``.

    Those whose first mask is one of ``masks[first:last]``.
    """
    given = nodes.select("node", "bits", "label", "size", "sign")
    keyed = given.mapInArrow(_keyed(masks[first:last], first), "mask int, key long, node long, bits binary, label long, size long, sign binary")
    dealt = keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_open(masks, limit, least), "a long, b long")


def _similar(least: float):
    def run(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.asarray(v.values) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def shingles_of(docs: DataFrame, nodes: DataFrame, links: DataFrame, words: int) -> DataFrame:
    """(node, grams): the set of shingles of every node in ``links`` (a, b)."""
    met = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(nodes.join(met, "node").select("node", F.col("first.key").alias("key")), "met")
    n_met = wanted.count()
    shared = docs.sparkSession.sparkContext.broadcast(
        bloom_field(wanted.select("key").mapInArrow(_key_hashes, "h long"), field_bits(n_met, 1 << 30))
    )

    def probe(batches):
        for batch in batches:
            keys = _row_keys(batch.column(0), strings(batch.column(1)))
            if keys:
                part = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(1)], ["key", "text"])
                yield part.filter(pa.array(in_field(shared.value, _low(keys))))

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = given.mapInArrow(probe, "key binary, text string").dropDuplicates(["key"])
    met_texts = few_files(wanted.join(texts, "key").select("node", "text"), n_met, 2000)
    return stored(met_texts.mapInArrow(_shingle_sets(words), "node long, grams array<long>"), "grams")


def similar_links(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """``links`` (a, b) whose sets in ``grams`` are of Jaccard ``similarity`` or more, exactly."""
    first = lookup(links, ["a"], grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), ["b"])
    both = lookup(first, ["b"], grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), ["a"])
    return both.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long")


#: Masks whose rows are shuffled at a time: what lies on disk at once does not grow with the number of masks.
_MASKS = 32


def _by_masks(n_masks: int, name: str, found: Callable[[int, int], DataFrame]) -> DataFrame:
    """Rows of ``found(first, last)`` over ranges of masks of like length, each stored before the next is begun."""
    cuts = np.linspace(0, n_masks, math.ceil(n_masks / _MASKS) + 1).astype(int).tolist()
    return reduce(DataFrame.unionByName, [stored(found(a, b), name) for a, b in zip(cuts, cuts[1:])])


def similar_components(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, lanes: int) -> DataFrame:
    """(node, root) of the components of checked links, without the roots themselves.

    The first pass checks about one link a row of each mask, to the nearest candidate or a pivot. It joins most of a
    group with few links, but a link that fails the check may have taken the place of one that holds. The second pass
    therefore takes every candidate between components of checked links, so that no unchecked link stands for another.
    """
    n_nodes, limit = nodes.count(), _limit(similarity, lanes)
    masks = similarity_masks(n_nodes, similarity, lanes)
    some = _by_masks(len(masks), "links", lambda a, b: few_files(loose_links(nodes, masks[a:b], limit).distinct(), n_nodes))
    loose = stored(few_files(some.distinct(), n_nodes), "links")
    grams = shingles_of(docs, nodes, loose, words)
    checked = connected_components(similar_links(loose, grams, similarity))
    signed = grams.mapInArrow(_signatures, "node long, size long, sign binary")  # a node without candidates is in no link
    labelled = (
        signed.join(nodes.select("node", "bits"), "node").join(checked, "node", "left")
        .withColumn("label", F.coalesce("root", "node"))
    )
    labelled = stored(labelled.select("node", "bits", "label", "size", "sign"), "labelled")
    rest = _by_masks(len(masks), "open", lambda a, b: open_links(labelled, masks, limit, similarity, a, b))
    more = stored(similar_links(rest, grams, similarity), "more")
    if more.isEmpty():
        return checked
    return connected_components(checked.toDF("a", "b").unionByName(more))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each group of near-duplicates.

    Candidates differ in at most the share of bits expected at ``similarity`` plus ``_SLACK`` standard
    deviations; every link taken is checked on the texts. Documents of one set of shingles are one node.
    The others of a group go, all other rows stay as they are and are not shuffled. Rows equal in doc_id and
    text are one row. Null counts as empty; texts without words are one node and so one document; a null doc_id is the last choice;
    an empty table gives an empty one. Other columns may have any name.
    """
    columns = docs.columns
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = stored(given.mapInArrow(_keyed_prints(words, lanes), "doc_id long, key binary, digest binary, bits binary"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = stored(
        prints.groupBy("digest", "bits")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.xxhash64("digest")),
        "nodes",
    )
    roots = similar_components(given, nodes, words, similarity, lanes)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ruled = attach_totals(
        placed,
        ["root"],
        [F.min("first").alias("f"), F.sum("n").alias("n_rows")],
        [F.min("f").alias("best"), F.sum("n_rows").alias("n_rows")],
        ["node"],
    ).filter("n_rows > 1")
    grouped = stored(
        lookup(prints, ["digest"], ruled.select("digest", F.col("best.key").alias("best")), ["key"])
        .filter("best is not null")
        .select("key", (F.col("key") == F.col("best")).alias("stays"))
        .distinct(),
        "groups",
    )
    shared = docs.sparkSession.sparkContext.broadcast(
        bloom_field(grouped.select("key").mapInArrow(_key_hashes, "h long"), field_bits(grouped.count(), 1 << 30))
    )
    at_id, at_text = columns.index("doc_id"), columns.index("text")
    key, hit, stays = fresh(columns, "_key", "_hit", "_stays")

    def probe(batches):
        for batch in batches:
            keys = _row_keys(batch.column(at_id), strings(batch.column(at_text)))
            hits = in_field(shared.value, _low(keys)) if keys else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary()), pa.array(hits)], [*batch.schema.names, key, hit]
            )

    rows = docs.mapInArrow(probe, StructType(docs.schema.fields[:]).add(key, "binary").add(hit, "boolean"))
    found = rows.filter(hit).join(grouped.select(F.col("key").alias(key), F.col("stays").alias(stays)), key, "left")
    alone = found.filter(F.col(stays).isNull()).select(*columns)
    kept = found.filter(stays).dropDuplicates([key]).select(*columns)
    return rows.filter(~F.col(hit)).select(*columns).unionByName(alone).unionByName(kept)
