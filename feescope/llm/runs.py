"""Periodic runs of words: a suffix automaton whose link tree is walked by link-cut access.

The words of a stretch are appended one by one. Appending word i recolours the path from its prefix's state to
the root of the automaton's link tree with i, the last end at which the states' strings have occurred. The path falls into
segments of one former colour c, whose strings are ``shorter + 1`` to ``longer`` words long: if ``i - c`` lies in that
range, the text has a square of primitive root ``i - c`` ending at i. Preferred paths are splay trees, so all
accesses of a stretch of n words take O(n log n) steps. A square is extended to its run once.

Only stretches in which every window of five words comes again, no farther away than a quarter of the stretch, go through
the automaton. That loses nothing: a run of period q has at least max(6, 4q) words, so each of its windows comes again q
words before or after, inside the run. Every document is one row's work: nothing shuffles.

Defined results: null text has no words; rows equal in doc_id and text get equal rows; a null doc_id is never altered
before the search (its checksum is undefined); an empty table gives no rows; other columns are not read. Memory grows
with the longest document, at about 1 KB a word of its stretches that repeat and 150 B of other words.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feescope.llm.common import strings

#: A run has so many words, and so many times its period, at least.
MIN_WORDS = 6
MIN_REPEATS = 4
_WINDOW = 5
_CHUNK = 2 << 20
_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, collapsed_sha256 string"
)


# --- automaton ------------------------------------------------------------------


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, longest, prefix): states from 1, the root; ``prefix`` has the state of every prefix."""
    follow: list[dict[int, int]] = [{}, {}]
    link, longest, prefix = [0, 0], [0, 0], []
    last = 1
    for word in words:
        new = len(link)
        longest.append(longest[last] + 1)
        link.append(1)
        follow.append({})
        prefix.append(new)
        p = last
        while p and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p:
            q = follow[p][word]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                longest.append(longest[p] + 1)
                link.append(link[q])
                follow.append(dict(follow[q]))
                while p and follow[p].get(word) == q:
                    follow[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return link, longest, prefix


def squares(words: list[int]):
    """Yield (end, period) of a primitively rooted square for every segment that shows one, ``end`` ascending."""
    up, longest, prefix = suffix_automaton(words)  # up: parent in a splay tree, or the path's parent state
    n = len(up)
    left, right, colour = [0] * n, [0] * n, [-1] * n  # the colour of a preferred path is kept at its splay root
    for i, x in enumerate(prefix):
        below = 0
        while x:
            # Splay x to the root of its preferred path.
            p = up[x]
            if left[p] == x or right[p] == x:
                top = p
                while left[up[top]] == top or right[up[top]] == top:
                    top = up[top]
                colour[x] = colour[top]
                while left[p] == x or right[p] == x:
                    g = up[p]
                    if left[g] == p or right[g] == p:
                        turn = p if (left[g] == p) == (left[p] == x) else x
                        turns = (turn, x)
                    else:
                        turns = (x,)
                    for y in turns:
                        p = up[y]
                        g = up[p]
                        if left[p] == y:
                            b = left[p] = right[y]
                            right[y] = p
                        else:
                            b = right[p] = left[y]
                            left[y] = p
                        up[b] = p
                        up[p] = y
                        up[y] = g
                        if left[g] == p:
                            left[g] = y
                        elif right[g] == p:
                            right[g] = y
                    p = up[x]
                up[0] = 0
            c, longer = colour[x], longest[x]
            colour[right[x]] = c  # what lay below x keeps its colour
            right[x] = below
            below, x = x, up[x]
            if c >= 0 and longest[x] < i - c <= longer:
                yield i, i - c
        colour[below] = i


def _first(differs: np.ndarray, size: int) -> int:
    found = np.flatnonzero(differs)
    return int(found[0]) if len(found) else size


def _extent(words: np.ndarray, end: int, period: int) -> tuple[int, int]:
    """[start, stop) of the run of ``period`` around the square that ends at ``end``."""
    stop, step = end + 1, 32
    while stop < len(words):
        size = min(step, len(words) - stop)
        same = _first(words[stop : stop + size] != words[stop - period : stop + size - period], size)
        stop += same
        if same < size:
            break
        step *= 2
    start, step = end - 2 * period + 1, 32
    while start > 0:
        size = min(step, start)
        same = _first((words[start - size : start] != words[start - size + period : start + period])[::-1], size)
        start -= same
        if same < size:
            break
        step *= 2
    return start, stop


def stretch_runs(words: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in ``words`` (numbers, equal for equal words)."""
    found, known = [], {}
    for end, period in squares(words.tolist()):
        if known.get(period, -1) >= end:
            continue
        start, stop = _extent(words, end, period)
        known[period] = stop - 1
        if stop - start >= max(min_words, min_repeats * period):
            found.append((start, stop - start, period))
    return found


# --- stretches that can hold a run -------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """[a, b) of the stretches inside one ``owner`` that can hold a run; equal windows get equal hashes, whatever else does."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return []
    at = np.flatnonzero(owner[:n] == owner[_WINDOW - 1 :])
    gram = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        gram = _mixed(gram + words[k : k + n].astype(np.uint64) + np.uint64(1))
    gram = gram[at]
    part, limit = owner[at].astype(np.uint64), np.iinfo(np.int64).max
    while True:
        key = _mixed(gram + _mixed(part + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        gap = np.where(key[order][1:] == key[order][:-1], np.diff(at[order]), np.iinfo(np.int64).max)
        none = np.iinfo(np.int64).max
        nearest = np.empty(len(at), np.int64)
        nearest[order] = np.minimum(np.r_[none, gap], np.r_[gap, none])
        kept = (nearest <= limit) & (nearest < none)
        shrunk = not kept.all()
        at, gram, own = at[kept], gram[kept], owner[at[kept]]
        if not len(at):
            return []
        first = np.r_[True, (np.diff(at) != 1) | (own[1:] != own[:-1])]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.r_[heads, len(at)]) + _WINDOW - 1
        piece = np.cumsum(first) - 1
        if not shrunk:
            return [(int(a), int(a + size)) for a, size in zip(at[heads], sizes)]
        part, limit = piece.astype(np.uint64), (sizes // MIN_REPEATS)[piece]


# --- documents --------------------------------------------------------------------


def periodic_map(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that the contract makes periodic; None where it does not."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return place


def _documents(ids: list, texts: list[bytes], altered: bool, min_words: int, min_repeats: int):
    """(words, runs, kept words) of every text."""
    table: dict[bytes, int] = {}
    number = count()
    lists, numbers = [], []
    for doc_id, text in zip(ids, texts):
        words = text.split()
        coded = np.fromiter(map(table.setdefault, words, number), np.int64, len(words))
        place = periodic_map(doc_id, len(words)) if altered else None
        if place is not None:
            coded = coded[place]
            words = [words[k] for k in place.tolist()]
        lists.append(words)
        numbers.append(coded)
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lists)), [len(w) for w in lists])
    begins = np.r_[0, np.cumsum([len(w) for w in lists])].tolist()
    runs: list[list] = [[] for _ in lists]
    for a, b in stretches(flat, owner):
        doc = int(owner[a])
        base = a - begins[doc]
        runs[doc] += [(base + s, size, q) for s, size, q in stretch_runs(flat[a:b], min_words, min_repeats)]
    for words, found in zip(lists, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, size, q in found:
                drop[s + q] += 1
                drop[s + size] -= 1
            kept = [words[k] for k in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
        else:
            kept = words
        yield len(words), found, b" ".join(kept)


def _chunks(batch: pa.RecordBatch):
    """(ids, texts) of about ``_CHUNK`` bytes together."""
    ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
        ids.append(doc_id)
        texts.append(text)
        held += len(text)
        if held >= _CHUNK:
            yield ids, texts
            ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def find_runs(
    docs: DataFrame, altered: bool = False, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, with_text: bool = True
) -> DataFrame:
    """One row per document: doc_id, n_words, ``runs`` by start and period, the text without the repeats of its runs and its sha256.

    A run is a stretch of smallest period q and at least ``max(min_words, min_repeats * q)`` words that no neighbouring
    word extends; at least 6 and 4, because the search for stretches relies on it. ``altered`` first makes one document in
    ten periodic, by ``periodic_map``. ``collapsed`` is null unless ``with_text``.
    """
    if min_words < MIN_WORDS or min_repeats < MIN_REPEATS:
        raise ValueError(f"runs of at least {MIN_WORDS} words and {MIN_REPEATS} periods are found")

    def run(batches):
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for ids, texts in _chunks(batch):
                found = list(_documents(ids, texts, altered, min_words, min_repeats))
                flat = [r for _, runs, _ in found for r in runs]
                columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                offsets = np.r_[0, np.cumsum([len(runs) for _, runs, _ in found])].astype(np.int32)
                kept = [text for _, _, text in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(item))),
                        pa.array(kept if with_text else [None] * len(kept), pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(text).hexdigest() for text in kept]),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed", "collapsed_sha256"],
                )

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(run, _SCHEMA)


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of the altered documents as counts, the run of greatest exponent and checksums."""
    found = find_runs(docs, altered=True, with_text=False)
    # a.length / a.period > b.length / b.period, without division; equal ones stay in order of start and period
    best = F.reduce(
        F.slice("runs", 2, 1 << 30),
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(
            b["length"].cast("decimal(19,0)") * a["period"] > a["length"].cast("decimal(19,0)") * b["period"], b
        ).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
        "n_words",
    )
