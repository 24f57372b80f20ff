"""Token ids in Parquet: list columns, dictionary-encoded, with small pages and page indexes.

Documents are range-partitioned and sorted by doc_id, encoded where they lie and written with
their place in the file's token stream, so that reading one document or only the metadata touches
few pages. The first token of every document follows from one total per file.

Encoding goes through the different words of some texts and a bounded cache of words: the byte-level pre-tokeniser always cuts between
a character and the single white space after it, and between a letter or digit and punctuation other
than an apostrophe, so the ids of a text are the ids of such pieces in turn. What the cache lacks is
encoded by the library, many words at a time; texts with runs of white space, or with the string of a special
token (which the library gives that token's id), go to it whole. The cache is an Arrow array of words beside arrays of
their ids: Arrow looks all words of a batch up at once, and no word is a Python object once it is known. When it is full,
the half used least goes.

Defined results: null text counts as empty and has the end id only; null doc_ids come first; rows
equal in doc_id are ordered by a hash of their text; an empty table gives an empty file set.
"""

from __future__ import annotations

import array
import gc
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from feescope.llm.common import running_base, scratch

END_ID = 0
_CACHE_WORDS = 400_000
#: Bytes of text that are encoded together: the more, the fewer different words each time.
_TOGETHER = 4 << 20
_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
#: Row groups and pages small enough to read single documents; the writer adds page indexes by itself.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "compression": "snappy",
}
#: Two white-space characters in a row: such texts go to the library as they are.
_RUN = re.compile(r"\s\s")
_BLANK = re.compile(r"\s")
#: Characters that never join the letter or digit before them, and those letters and digits.
_TAILS = ".,;:!?#$%&*|)"
_LETTERS = pa.array([chr(c) for c in range(0x250) if chr(c).isalnum()])


def _ranges(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[begin : begin + size]`` of every range in turn."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Ids:
    """Ids of many pieces, one piece after another."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes = flat, sizes
        self.begins = np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, at: np.ndarray) -> _Ids:
        return _Ids(_ranges(self.flat, self.begins[at], self.sizes[at]), self.sizes[at])

    def plus(self, other: _Ids) -> _Ids:
        return _Ids(np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))


def _no_ids() -> _Ids:
    return _Ids(np.zeros(0, np.int32), np.zeros(0, np.int64))


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str, cache_words: int = _CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        self._space = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start with a space
        self._line = np.zeros(len(self._space), bool)
        for token, i in vocabulary.items():
            self._space[i] = token.startswith("Ġ")
            self._line[i] = token.startswith("Ċ")
        self._cache_words = cache_words
        self._cache, self._ids, self._uses = pa.array([], pa.string()), _no_ids(), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> _Ids:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = array.array("i")
        for ids in found:
            flat.extend(ids)
        return _Ids(np.frombuffer(flat, np.int32), np.fromiter(map(len, found), np.int64, len(found)))

    def _each(self, words: list[str]) -> _Ids:
        return self._library([w if w[:1] == "\n" else " " + w for w in words])

    def _together(self, words: list[str], text: str, opens: np.ndarray) -> _Ids:
        """Ids of ``words`` by one ``text`` of all of them; each starts at an id that ``opens``."""
        ids = self._library([text]).flat
        starts = np.flatnonzero(opens[ids])
        return _Ids(ids, np.diff(starts, append=len(ids))) if len(starts) == len(words) else self._each(words)

    def _learned(self, words: list[str]) -> _Ids:
        """Ids of each word with its space, or with the line break it begins with."""
        spaced = [i for i, w in enumerate(words) if w and w[0] != "\n"]
        lines = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == "\n"]
        other = [i for i, w in enumerate(words) if w in ("", "\n")]
        if len(" ".join([words[i] for i in spaced]).split()) != len(spaced):
            other += [i for i in spaced if _BLANK.search(words[i])]
            spaced = [i for i in spaced if not _BLANK.search(words[i])]
        if len("".join([words[i] for i in lines]).split()) != len(lines):
            other += [i for i in lines if _BLANK.search(words[i], 1)]
            lines = [i for i in lines if not _BLANK.search(words[i], 1)]
        found = _no_ids()
        if spaced:
            own = [words[i] for i in spaced]
            found = found.plus(self._together(own, " " + " ".join(own), self._space))
        if lines:
            own = [words[i] for i in lines]
            found = found.plus(self._together(own, "".join(own), self._line))
        if other:
            found = found.plus(self._each([words[i] for i in other]))
        return found.take(np.argsort(np.array([*spaced, *lines, *other], np.int64)))

    def encode(self, texts: list[str]) -> list[bytes]:
        # The collector would walk all these lists again and again, and nothing made here is cyclic.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _whole(self, text: str) -> bool:
        return _RUN.search(text) is not None or any([s in text for s in self._special])

    def _known(self, words: pa.Array) -> _Ids:
        """Ids of words, each with its space or line break, by the cache."""
        both = pa.chunked_array([self._cache, words]).dictionary_encode()
        coded = both.chunk(both.num_chunks - 1)  # the cache's words are the first of the dictionary
        at = np.asarray(coded.indices).astype(np.int64)
        n = len(self._cache)
        if len(coded.dictionary) > n:
            self._ids = self._ids.plus(self._learned(coded.dictionary.slice(n).to_pylist()))
            self._uses = np.r_[self._uses, np.zeros(len(coded.dictionary) - n, np.int64)]
            self._cache = coded.dictionary
        self._uses += np.bincount(at, minlength=len(self._uses))
        found = self._ids.take(at)
        if len(self._cache) > self._cache_words:
            stay = np.sort(np.argsort(-self._uses, kind="stable")[: self._cache_words // 2])
            self._cache, self._ids, self._uses = self._cache.take(pa.array(stay)), self._ids.take(stay), self._uses[stay] // 2
        return found

    def _words(self, words: pa.Array) -> _Ids:
        """Ids of different words: those of the word without its tail, then those of the tail."""
        stems = pc.utf8_rtrim(words, characters=_TAILS)
        cut = pc.and_(
            pc.less(pc.binary_length(stems), pc.binary_length(words)),
            pc.is_in(pc.utf8_slice_codeunits(stems, -1), value_set=_LETTERS),
        )
        stem_ids = self._known(pc.if_else(cut, stems, words))
        at = np.flatnonzero(np.asarray(cut))
        if not len(at):
            return stem_ids
        tails = pa.array([w[len(s) :] for w, s in zip(words.filter(cut).to_pylist(), stems.filter(cut).to_pylist())], pa.string())
        coded = tails.dictionary_encode()
        pieces = stem_ids.plus(self._library(coded.dictionary.to_pylist()))
        order = np.insert(np.arange(len(words)), at + 1, len(words) + np.asarray(coded.indices))
        sizes = stem_ids.sizes.copy()
        sizes[at] += pieces.sizes[len(words) :][np.asarray(coded.indices)]
        return _Ids(pieces.take(order).flat, sizes)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        whole = [self._whole(t) for t in texts]
        # Without runs of white space, a break before every space and line feed is one of the pre-tokeniser's.
        parts = pc.split_pattern(pa.array(["" if w else t.replace("\n", " \n") for t, w in zip(texts, whole)], pa.string()), " ")
        offsets = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.values.dictionary_encode()
        at = np.asarray(coded.indices).astype(np.int64)
        # The first word of a text has no space before it; a text that is not cut is its own first word.
        firsts = parts.values.take(parts.offsets[:-1]).to_pylist()
        firsts = self._library([t if w else f for t, w, f in zip(texts, whole, firsts)])
        at[offsets[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        ids = self._words(coded.dictionary).plus(firsts).take(at)
        cuts = np.r_[0, np.cumsum(ids.sizes)][offsets].tolist()
        return [ids.flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


_ENCODERS: dict[str, Encoder] = {}  # one per Python worker, kept between tasks


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit; threads of a worker only wait
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _gathered(batches):
    """Columns doc_id and text of some rows of a partition, of ``_TOGETHER`` bytes or one batch of 1000 rows more."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            piece = batch.slice(at, 1000)
            held.append(piece)
            size += piece.column(1).nbytes
            if size >= _TOGETHER:
                yield pa.Table.from_batches(held).columns
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).columns


def _encoded(path: str, end_id: int):
    end = array.array("i", [end_id]).tobytes()

    def run(batches):
        encoder, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for doc_ids, texts in _gathered(batches):
            ids = [x + end for x in encoder.encode([t or "" for t in texts.to_pylist()])]
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = np.cumsum(counts)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.combine_chunks(),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + ends - counts),
                    pa.array(counts),
                    tokens,
                ],
                ["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, with ``end_id`` after each document, in doc_id order."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_encoded(tokenizer_path, end_id), _SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents with ``start``, the ids of all documents before; select or filter to read less."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    sizes = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    bases = running_base(sizes, [], ["part"], "n", "base").select("part", "base")
    # One row per file: far below any broadcast limit, and the ids themselves never shuffle.
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens"
    )


def _checked(batches):
    for batch in batches:
        tokens = batch.column(3)
        values = memoryview(np.ascontiguousarray(tokens.values, "<u4")).cast("B")
        cuts = (np.asarray(tokens.offsets).astype(np.int64) * 4).tolist()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write, read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(spark, path).mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
