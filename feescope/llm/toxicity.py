"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. Words that look disguised (symbols for
letters, letters spaced out, letters repeated) become character lattices: every symbol may be one of
the letters it stands for or nothing, every run of a letter may be one or two of it. Viterbi
decoding picks the reading that the language model and the channel find likeliest, and a logistic
model over words and word beginnings scores the restored text.

The classifier is fitted on at most ``max_rows`` labelled rows, drawn by hash from the training
folds (``crc32`` of the doc_id as text, modulo 5, not 0); counts and scores use all documents.

Defined results: null text counts as empty and is scored like it; rows without doc_id are never
held out; repeated rows get equal scores; without training rows of both kinds every score is
near 0, or near 1 if all their labels are toxic; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from feescope.llm.common import stored, strings, thin

MAX_ROWS = 12_000
N_FEATURES = 512
_BUCKETS = 1 << 22
_PREFIXES = (4, 5, 6, 7, 8)
_LONGEST = 14
_CHUNK = 2 << 20

#: What a symbol may stand for; "*" and "#" may hide any letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_HIDES = "*#"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LOG_SAME, _LOG_LEET, _LOG_HIDDEN, _LOG_RUN = 0.0, -0.7, -1.5, -0.3
#: Dropping a symbol as noise: one of them, and a run of them.
_LOG_DROP, _LOG_DROP_RUN = -8.0, -2.0

_SYMBOLS = re.escape("".join(LEET) + _HIDES)
_SPACED = re.compile(r"(?<![^\s])[a-z0-9@$!|](?:([ ._\-*])[a-z0-9@$!|])(?:\1[a-z0-9@$!|])+(?![^\s.,;:?!])")
#: What makes a token a disguised word. There is no run of any character in front, so one pass over a text finds all.
_MARKED = re.compile(rf"[a-z][{_SYMBOLS}]++[a-z]|[{_SYMBOLS}][a-z]{{2}}|([a-z])\1\1|[a-z]{{2}}[{_SYMBOLS}]")
_END = re.compile(r"\s")
#: A longer token is no single word: hiding symbols in it stand for nothing, and its reading is not kept.
_LONG_TOKEN = 200

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Classes of the language model: 0 between words, 1-26 letters, 27 any other character.
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_N = 28


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with a break before each, and the start of each."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return _LOWER[raw], np.cumsum(lengths + 1) - lengths


def _chunks(column: pa.Array):
    """Lists of texts of about ``_CHUNK`` bytes together, with their position in the column."""
    texts, held, at = [], 0, 0
    for i, text in enumerate(strings(column)):
        texts.append(text)
        held += len(text)
        if held >= _CHUNK:
            yield at, texts
            texts, held, at = [], 0, i + 1
    if texts:
        yield at, texts


# --- language model -----------------------------------------------------------


def _trigrams(batches):
    total = np.zeros(_N**3, np.int64)
    for batch in batches:
        for _, texts in _chunks(batch.column(0)):
            code = _CLASS[_joined(texts)[0]]
            total += np.bincount((code[:-2] * _N + code[1:-1]) * _N + code[2:], minlength=_N**3)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of the third class given two, counted over all texts; a fixed-size table."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_trigrams, "gram int, n long")
    table = np.zeros(_N**3)
    for row in counts.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        table[row.gram] = row.n
    table = table.reshape(_N, _N, _N)
    lower = table.sum(0) + 0.5
    backed = lower / lower.sum(1, keepdims=True)
    return np.log((table + 5 * backed[None]) / (table.sum(2, keepdims=True) + 5))


# --- channel ------------------------------------------------------------------


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for and the channel's log probability.

    In tokens of over ``_LONG_TOKEN`` characters (addresses, data, scripts without spaces) a hiding symbol is only noise, so
    that the lattice stays narrow and decoding takes time in proportion to the token.
    """
    arcs = []
    hides = _HIDES if len(word) <= _LONG_TOKEN else ""
    for match in re.finditer(r"(.)\1*", word, re.S):
        run, char = match[0], match[1]
        if char in LEET or char in hides:
            meant = LEET.get(char, _LETTERS)
            cost = _LOG_LEET if char in LEET else _LOG_HIDDEN - math.log(len(_LETTERS))
            options = [(c * n, cost * n) for c in meant for n in range(1, min(2, len(run)) + 1)]
            options.append(("", _LOG_DROP if len(run) == 1 else _LOG_DROP_RUN))
            if char.isdigit():
                options.append((run, _LOG_DROP))
        elif char.isalpha():
            options = [(char * n, _LOG_SAME if n == len(run) else _LOG_RUN) for n in range(1, min(2, len(run)) + 1)]
        else:
            options = [("", _LOG_SAME)]  # separators inside a word
        arcs.append(options)
    return arcs


def _code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest reading of ``word``: Viterbi over (last two classes)."""
    best = {(0, 0): (0.0, None, "")}
    for options in lattice(word):
        after: dict = {}
        for (a, b), node in best.items():
            for out, cost in options:
                x, y, score = a, b, node[0] + cost
                for char in out:
                    c = _code(char)
                    score += model[x, y, c]
                    x, y = y, c
                if (x, y) not in after or score > after[x, y][0]:
                    after[x, y] = (score, node, out)
        best = after
    (a, b), node = max(best.items(), key=lambda x: x[1][0] + model[x[0][0], x[0][1], 0])
    parts = []
    while node is not None:
        parts.append(node[2])
        node = node[1]
    return "".join(reversed(parts))


@dataclass
class Restorer:
    """Texts with disguised words replaced by their decoded form; readings are cached."""

    model: np.ndarray
    cache: dict[str, str] = field(default_factory=dict)

    def _read(self, word: str) -> str:
        if len(word) > _LONG_TOKEN:
            return decode(word, self.model)
        if word not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = decode(word, self.model)
        return self.cache[word]

    def _word(self, word: str) -> str:
        first, last = 0, len(word)
        while first < last and not word[first].isalnum():
            first += 1
        while last > first and not word[last - 1].isalnum():
            last -= 1
        head, core, tail = word[:first], word[first:last], word[last:]
        if sum(c.isalpha() for c in core) < 2:
            return word
        if len(set(tail)) == 1 and len(tail) <= 2 and tail[0] in LEET:
            core, tail = core + tail, ""
        if len(head) == 1 and head in LEET:
            head, core = "", head + core
        return f"{head} {self._read(core)} {tail}"

    def _spaced(self, match: re.Match) -> str:
        return self._read(match[0].replace(match[1], ""))

    def restore(self, text: bytes) -> bytes:
        lower = text.decode("utf-8", "replace").lower()
        return self._disguised(_SPACED.sub(self._spaced, lower)).encode()

    def _disguised(self, text: str) -> str:
        """Every token that holds a mark is read; each character is looked at once."""
        parts, done, at = [], 0, 0
        while mark := _MARKED.search(text, at):
            start = mark.start()
            while start > done and not text[start - 1].isspace():
                start -= 1
            space = _END.search(text, mark.end())
            at = space.start() if space else len(text)
            parts += [text[done:start], self._word(text[start:at])]
            done = at
        return "".join(parts) + text[done:]

    def restored(self, texts: list[bytes]) -> list[bytes]:
        """Only texts with a trace of disguise are decoded; one pass over all bytes finds them."""
        raw, starts = _joined([_one_byte(t) for t in texts])
        letter = (raw >= 97) & (raw <= 122)
        symbol = _IS_SYMBOL[raw]
        mark = np.zeros(len(raw), bool)
        mark[1:-1] |= symbol[1:-1] & letter[:-2] & (letter | symbol)[2:]
        mark[:-2] |= symbol[:-2] & letter[1:-1] & letter[2:]
        mark[2:-1] |= symbol[2:-1] & letter[1:-2] & letter[:-3]
        mark[2:] |= letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
        apart = _IS_APART[raw]
        single = letter | symbol
        if len(raw) > 5:
            mark[:-4] |= single[:-4] & apart[1:-3] & single[2:-2] & (raw[3:-1] == raw[1:-3]) & single[4:]
        hit = np.add.reduceat(mark, starts - 1) > 0 if len(texts) else []
        return [self.restore(t) if h else t for t, h in zip(texts, hit)]


_WIDE = [c.encode() for c in [*LEET, *_HIDES] if ord(c) >= 128]


def _one_byte(text: bytes) -> bytes:
    """``text`` with a symbol of one byte for each longer one."""
    for symbol in _WIDE:
        text = text.replace(symbol, b"$")
    return text


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in [*LEET, *_HIDES] if ord(c) < 128]] = True
_IS_APART = np.zeros(256, bool)
_IS_APART[[ord(c) for c in " ._-*"]] = True


# --- features -----------------------------------------------------------------


def _mix(hashes: np.ndarray, kind: int) -> np.ndarray:
    x = (hashes + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(42)).astype(np.int64)


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature) of every word and word beginning, and words per document."""
    raw, starts = _joined(texts)
    inside = _IS_WORD[raw]
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    owner = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(owner, minlength=len(texts))
    length = last - first
    hashes = np.zeros(len(first), np.uint64)
    docs, features = [], []
    alive = np.arange(len(first))
    for j in range(_LONGEST):
        alive = alive[length[alive] > j]
        hashes[alive] = hashes[alive] * np.uint64(0x100000001B3) + raw[first[alive] + j] + np.uint64(1)
        if j + 1 in _PREFIXES:
            docs.append(owner[alive])
            features.append(_mix(hashes[alive], j + 1))
    docs.append(owner)
    features.append(_mix(hashes + np.minimum(length, 31).astype(np.uint64), 99))
    return np.concatenate(docs), np.concatenate(features), n_words


@dataclass
class Model:
    """The language model, the chosen features and a logistic model over their counts and rates."""

    grams: np.ndarray
    slots: np.ndarray  # hashed feature -> column, or -1
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        return _matrix(texts, self.slots)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (self.matrix(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _matrix(texts: list[bytes], slots: np.ndarray) -> np.ndarray:
    width = int(slots.max()) + 1 if len(slots) else 0
    docs, features, n_words = word_features(texts)
    column = slots[features]
    kept = column >= 0
    counts = np.bincount(docs[kept] * width + column[kept], minlength=len(texts) * width).reshape(len(texts), width)
    rates = counts / (1 + n_words[:, None] / 100)
    return np.hstack([np.log1p(counts), np.log1p(rates)])


def _feature_counts(grams: np.ndarray):
    def run(batches):
        restorer = Restorer(grams)
        for batch in batches:
            toxic = np.asarray(batch.column(0))
            for at, texts in _chunks(batch.column(1)):
                docs, features, _ = word_features(restorer.restored(texts))
                pairs = np.unique(docs * _BUCKETS + features)
                is_toxic = toxic[at + pairs // _BUCKETS] == 1
                met, place = np.unique(pairs % _BUCKETS, return_inverse=True)
                pos = np.bincount(place, is_toxic, len(met)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met.astype(np.int32)), pa.array(pos), pa.array(np.bincount(place, minlength=len(met)) - pos)],
                    ["feature", "pos", "neg"],
                )

    return run


def _rows_of(grams: np.ndarray, slots: np.ndarray):
    """The few counts of a text that are not 0, with their columns: what the driver gets is small."""

    def run(batches):
        restorer, width = Restorer(grams), int(slots.max()) + 1
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                docs, features, n_words = word_features(restorer.restored(texts))
                column = slots[features]
                kept = column >= 0
                cells, counts = np.unique(docs[kept] * width + column[kept], return_counts=True)
                cuts = np.searchsorted(cells, np.arange(len(texts) + 1) * width).tolist()
                columns = (cells % width).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(n_words.astype(np.int64)),
                        pa.array([columns[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["toxic", "n_words", "columns", "counts"],
                )

    return run


def _dense(rows: list, width: int) -> np.ndarray:
    """The matrix of ``_matrix``, with a last column of ones for the bias."""
    x = np.zeros((len(rows), 2 * width + 1), np.float32)
    x[:, -1] = 1
    for i, row in enumerate(rows):
        at = np.frombuffer(row.columns, "<u2").astype(np.int64)
        counts = np.frombuffer(row.counts, "<u4").astype(np.float64)
        x[i, at] = np.log1p(counts)
        x[i, width + at] = np.log1p(counts / (1 + row.n_words / 100))
    return x


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 400):
    """Logistic regression with ridge, by accelerated gradient steps on columns standardised in place; the last is the bias."""
    z = x
    mean = z[:, :-1].mean(0)
    z[:, :-1] -= mean
    scale = np.empty_like(mean)
    for k in range(len(mean)):  # column by column: no second matrix
        scale[k] = max(np.sqrt(np.mean(z[:, k].astype(np.float64) ** 2)), 0.05)
    z[:, :-1] /= scale
    top = np.ones(z.shape[1], np.float32)
    for _ in range(30):  # largest eigenvalue of the Gram matrix
        top = z.T @ (z @ (top / np.linalg.norm(top)))
    step = 4 * len(z) / (1.1 * np.linalg.norm(top) + 4 * ridge)
    w = ahead = np.zeros(z.shape[1], np.float32)
    penalty = np.full(z.shape[1], ridge / len(z), np.float32)
    penalty[-1] = 0
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - step * (z.T @ (p - y) / len(z) + penalty * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return mean, scale, w[:-1], float(w[-1])


def held_out() -> Column:
    """Whether the row is of the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, n_features: int = N_FEATURES) -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold."""
    grams = language_model(docs)
    known = thin(labels, labels.count(), 4 * max_rows, "doc_id")
    chosen = (
        known.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # At most max_rows rows are broadcast; one text for each of them is kept.
    found = given.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(found.select("toxic", "text"), "labelled")
    counts = sample.mapInArrow(_feature_counts(grams), "feature int, pos long, neg long")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    slots = np.full(_BUCKETS, -1, np.int16)
    if not n_pos or not n_neg:
        return Model(grams, slots, np.zeros(0), np.ones(0), np.zeros(0), 30.0 if n_pos else -30.0)
    gap = F.col("pos") / n_pos - F.col("neg") / n_neg
    both = (F.col("pos") + F.col("neg") + 1) / (n_pos + n_neg + 2)
    best = (
        counts.groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter("pos + neg >= 3")
        .orderBy((F.abs(gap) / F.sqrt(both * (F.lit(1.0001) - both))).desc(), "feature")
        .limit(n_features)
        .collect()
    )
    for i, row in enumerate(sorted(r.feature for r in best)):
        slots[row] = i
    rows = sample.mapInArrow(_rows_of(grams, slots), "toxic int, n_words long, columns binary, counts binary").collect()
    y = np.array([r.toxic for r in rows], np.float32)
    return Model(grams, slots, *_fit(_dense(rows, len(best)), y))


# --- scoring ------------------------------------------------------------------


def _scorer(model, at: int):
    held: dict[str, Restorer] = {}

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        restorer = held.setdefault("restorer", Restorer(model.value.grams))
        found = [model.value.scores(restorer.restored(texts)) for _, texts in _chunks(batch.column(at))]
        return np.concatenate(found) if found else np.zeros(0)

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scores = _scorer(docs.sparkSession.sparkContext.broadcast(model), 1)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch))], ["doc_id", "score"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = given.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in one pass without a shuffle.

    Null counts as empty and both are scored like any text; an empty table gives an empty one; columns may have any name.
    """
    scores = _scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) < threshold))

    return docs.mapInArrow(run, docs.schema)
