"""Phrases whose words stand together more often than their parts would: collocations of each language.

All phrases of 1 to ``max_words`` words are exploded into rows and counted for each language; a candidate's first and last parts are
joined to their counts, the score is exact in decimals, candidates that a one-word extension explains go by an anti join, and a window ranks
what is left.

A phrase that stands below ``least`` times in all is no candidate, no part of one and no extension of one, as parts are at least as frequent as
the whole. Rows for most of those are never made: a first pass over all texts adds up a table of counters, each for all phrases whose
hash leads to it, so a counter below ``least`` proves that its phrases are rarer. The table has one size for any input; where it fills up,
more phrases are exploded, with the same result.

* A null text is empty, a null lang is ``und``; repeated rows count as often as they are there. Texts of any length are read in stretches.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of the stretches that are worked on at once, and hashes that are held before they are counted.
STRETCH, HELD = 1 << 19, 1 << 20
#: Counters (a byte each) as a power of two, and how many are added up at once.
BITS, BLOCK = 26, 1 << 16

_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _ODD
    return (h ^ (h >> _HALF)) * _ODD


class Words:
    """Words of one stretch: ``flat`` has them in lower case, a space after each; ``start`` and ``end`` are their places in it, ``piece`` numbers
    what no phrase may cross, ``mark`` is a hash of each."""

    def __init__(self, data: bytes):
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[raw]
        word = kind == 0
        edge = np.diff(word, prepend=False, append=False)
        at = np.flatnonzero(edge)
        start, end = at[::2], at[1::2]
        self.n = len(start)
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[start]
        first_blank = np.zeros(len(raw), bool)
        first_blank[end[end < len(raw)]] = True
        flat = np.where(word, raw, np.uint8(32))[word | first_blank]
        lengths = end - start
        self.start = np.zeros(self.n, np.int64)
        self.start[1:] = np.cumsum(lengths[:-1] + 1)
        self.end = self.start + lengths
        self.flat = flat
        inside = np.arange(len(flat)) - np.repeat(self.start, np.diff(np.append(self.start, len(flat))))
        values = _mixed((flat.astype(np.uint64) + np.uint64(1)) * _ODD + inside.astype(np.uint64))
        values[self.end[self.end < len(flat)]] = 0
        self.mark = np.add.reduceat(values, self.start) if self.n else np.zeros(0, np.uint64)

    def phrases(self, seed: np.uint64, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word of each phrase, hash of each) for 1 to ``max_words`` words."""
        mark = _mixed(self.mark + seed)
        at = np.arange(self.n)
        yield 1, at, mark
        for m in range(2, max_words + 1):
            at = at[: np.searchsorted(at, self.n - m + 1)]
            within = self.piece[at] == self.piece[at + m - 1]
            at, mark = at[within], mark[: len(within)][within]
            mark = _mixed(mark * np.uint64(3) + self.mark[at + m - 1])
            yield m, at, mark

    def text(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words that begin at the words ``at``."""
        start, end = self.start[at], self.end[at + words - 1]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        took = self.flat[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, end - start)]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(took))


def stretches(texts: Iterator[bytes], max_words: int) -> Iterator[tuple[bytes, int]]:
    """Texts, apart from each other by a break, in stretches of about STRETCH bytes; with each the number of words at its beginning that are repeated for
    the sake of phrases with later words.

    Cut after a break, else after a word, whose last ``max_words`` - 1 words are repeated; a word is never cut.
    """
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= STRETCH:
            yield from _cut(b"\n".join(held), max_words)
            held, size = [], 0
    if held:
        yield from _cut(b"\n".join(held), max_words)


def _cut(data: bytes, max_words: int) -> Iterator[tuple[bytes, int]]:
    at = repeated = 0
    size = STRETCH
    while len(data) - at > size:
        part = data[at : at + size]
        after = max(part.rfind(bytes([c])) for c in np.flatnonzero(_KIND == _BREAK)) + 1
        if after:
            yield part[:after], repeated
            at, repeated, size = at + after, 0, STRETCH
            continue
        edges = np.flatnonzero(np.diff(_KIND[np.frombuffer(part, np.uint8)] == 0, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        if len(ends) < 2 * max_words:
            size *= 2
            continue
        after, repeat = int(ends[-1]), max_words - 1
        yield part[:after], repeated
        at, repeated, size = at + (int(starts[len(ends) - repeat]) if repeat else after), repeat, STRETCH
    yield data[at:], repeated


def _texts_by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[bytes]]]:
    langs = pc.fill_null(batch.column(0), "und")
    for lang in pc.unique(langs).to_pylist():
        column = batch.column(1).filter(pc.equal(langs, lang))

        def some(column=column):
            for at in range(0, len(column), 64):
                for x in column.slice(at, 64).cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist():
                    yield x or b""

        yield lang, some()


def _cells(batch: pa.RecordBatch, max_words: int, bits: int) -> Iterator[tuple[str, Words, int, np.ndarray, np.ndarray]]:
    """(lang, words of a stretch, length of the phrases, their first words, their hashes) of all phrases of a batch, each once."""
    for lang, texts in _texts_by_lang(batch):
        seed = np.uint64(xxhash.xxh64_intdigest(lang))
        for data, repeated in stretches(texts, max_words):
            words = Words(data)
            for m, at, mark in words.phrases(seed, max_words):
                new = np.searchsorted(at, repeated - m + 1)
                yield lang, words, m, at[new:], (mark[new:] >> np.uint64(64 - bits)).astype(np.uint32)


def pack(block: np.ndarray) -> bytes:
    """A block of counters: which are at least 1, as bits where they are many, and a list of the others (place, and what is missing)."""
    above = 1 if np.count_nonzero(block) * 3 > len(block) // 8 else 0
    at = np.flatnonzero(block > above)
    if not above and not len(at):
        return b""
    bits = np.packbits(block > 0).tobytes() if above else b""
    return bytes([above]) + bits + at.astype(np.uint16).tobytes() + (block[at] - np.uint8(above)).tobytes()


def add_packed(total: np.ndarray, packed: bytes) -> None:
    """Adds a packed block to a total, which stops at 255."""
    data = np.frombuffer(packed, np.uint8, offset=1)
    if packed[0]:
        total += np.unpackbits(data[: len(total) // 8])
        data = data[len(total) // 8 :]
    n = len(data) // 3
    total[np.frombuffer(data[: 2 * n].tobytes(), np.uint16)] += data[2 * n :]
    np.minimum(total, 255, out=total)


def counters(docs: DataFrame, max_words: int, bits: int, least: int) -> np.ndarray:
    """A bit for each hash of ``bits`` bits: whether phrases that lead to it stand ``least`` (255 at most) times or more.

    Each task counts by itself, in bytes; blocks of the tables are added up in the executors, and 2 ** bits bits are collected.
    """
    size, most = min(BLOCK, 1 << bits), min(least, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, held = np.zeros(1 << bits, np.uint8), [], 0

        def add():
            cells, n = np.unique(np.concatenate(seen), return_counts=True)
            table[cells] = np.minimum(table[cells] + np.minimum(n, 255).astype(np.uint16), 255)

        for batch in batches:
            for *_, cells in _cells(batch, max_words, bits):
                seen.append(cells)
                held += len(cells)
                if held > HELD:
                    add()
                    seen, held = [], 0
        if held:
            add()
        for at in range(0, 1 << bits, size):
            if packed := pack(table[at : at + size]):
                yield pa.RecordBatch.from_pydict({"block": pa.array([at // size], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def bits_of():
            return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "counts": pa.array([np.packbits(total >= most).tobytes()], pa.binary())})

        for batch in batches:
            for block, counts in zip(batch.column(0), batch.column(1)):
                if block.as_py() != at:
                    if at is not None:
                        yield bits_of()
                    at, total = block.as_py(), np.zeros(size, np.uint16)
                add_packed(total, counts.as_py())
        if at is not None:
            yield bits_of()

    schema = "block int, counts binary"
    parts = docs.select("lang", "text").mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(added, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for block, packed in parts.collect():
        out[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(packed, np.uint8)
    return out


def exploded(docs: DataFrame, max_words: int, frequent: np.ndarray) -> DataFrame:
    """Rows (lang, words, phrase, n): one for each place of a phrase that may be frequent, n = 1; with words 0 how many words a stretch has."""
    bits = (len(frequent) * 8).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows_of(lang: str, m: int, phrases: pa.Array, n: int) -> pa.RecordBatch:
        k = len(phrases)
        same = [pa.repeat(pa.scalar(x, t), k) for x, t in ((lang, pa.string()), (m, pa.int32()), (n, pa.int64()))]
        return pa.RecordBatch.from_arrays([same[0], same[1], phrases.cast(pa.string()), same[2]], names=["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lang, words, m, at, cells in _cells(batch, max_words, bits):
                if m == 1 and len(at):
                    yield rows_of(lang, 0, pa.array([""]), len(at))
                at = at[(table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1]
                if len(at):
                    yield rows_of(lang, m, words.text(at, m), 1)

    return docs.select("lang", "text").mapInArrow(run, "lang string, words int, phrase string, n long")


def frequent_phrases(docs: DataFrame, max_words: int = 4, least: int = 30) -> DataFrame:
    """(lang, words, phrase, n) of all phrases that stand ``least`` times or more in a language, and with words 0 the number of its words."""
    rows = exploded(docs, max_words, counters(docs, max_words, BITS, least))
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def cuts(words: int, phrase: Column) -> Column:
    """Structs (k, head, tail) of each cut of a phrase."""
    parts = F.split(phrase, " ")
    part = lambda first, n: F.array_join(F.slice(parts, first, n), " ")
    return F.transform(F.sequence(F.lit(1), words - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("head"), part(k + 1, words - k).alias("tail")))


def score(a: str, l: str, r: str) -> Column:
    """floor(2000000 a / (l + r)), exact."""
    decimal = lambda c: F.col(c).cast("decimal(20,0)")
    return F.call_function("div", decimal(a) * F.lit(2000000).cast("decimal(7,0)"), decimal(l) + decimal(r)).cast("long")


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language, after all that an extension of at least ``covered`` percent explains are gone.

    An extension by more words implies one by a single word, which is at least as frequent.
    """
    counts = materialize(frequent_phrases(docs, max_words, least), "phrases")
    phrases = counts.filter("words > 0")
    candidates = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))

    tried = candidates.select("lang", "phrase", "a", F.explode(cuts(F.col("words"), F.col("phrase"))).alias("cut"))
    of = lambda name, n: phrases.select(F.col("lang").alias(f"__{n}_lang"), F.col("phrase").alias(f"__{n}_phrase"), F.col("n").alias(n))
    for side, n in (("head", "l"), ("tail", "r")):
        tried = tried.join(of(side, n), (F.col("lang") == F.col(f"__{n}_lang")) & (F.col(f"cut.{side}") == F.col(f"__{n}_phrase"))).drop(f"__{n}_lang", f"__{n}_phrase")
    scored = tried.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut.k", "l", "r")).alias("low"))

    parts = F.split("phrase", " ")
    shorter = F.array(*[F.array_join(F.slice(parts, F.lit(first), F.col("words") - 1), " ") for first in (1, 2)])
    longer = candidates.filter("words > 2").select(F.col("lang").alias("__lang"), F.explode(shorter).alias("__phrase"), F.col("a").alias("__a"))
    longest = longer.groupBy("__lang", "__phrase").agg(F.max("__a").alias("__a"))
    decimal = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    explained = (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")) & (decimal("__a", 100) >= decimal("a", covered))
    left = scored.join(longest, explained, "left_anti").select("lang", "phrase", "a", "low.*")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = left.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select(F.col("lang").alias("__lang"), F.col("n").alias("n"))
    out = ranked.join(totals, F.col("lang") == F.col("__lang"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
