"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations


import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import discard, keep_rows, materialize, text_map, utf8

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Searches a sequence of words for many patterns of one length ``m``.

    The alphabet is words and a block is two adjacent words (one where m is 1). ``shift`` says how far the
    window may move when its last block is seen; at shift 0 the suffix hash picks a bucket whose
    patterns are tested by their first word, then compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list], m: int):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.b, m + 1):
                block = pattern[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.buckets.setdefault(pattern[m - self.b :], []).append((pattern, tuple(owners)))

    def search(self, words: list[bytes]):
        """(start, owners) of every occurrence, by start."""
        m, default = self.m, self.default
        shift, buckets, n = self.shift.get, self.buckets, len(words)
        i = m - 1
        if self.b == 1:
            for i, w in enumerate(words):
                if (w,) in buckets:
                    for _, owners in buckets[(w,)]:
                        yield i, owners
            return
        while i < n:
            block = (words[i - 1], words[i])
            step = shift(block, default)
            if step:
                i += step
                continue
            start = i - m + 1
            first = words[start]
            for pattern, owners in buckets[block]:
                if pattern[0] == first and tuple(words[start : i + 1]) == pattern:
                    yield start, owners
            i += 1


def compile_items(items: list[tuple], window: int) -> list[WuManber]:
    """One searcher for each pattern length that occurs: ``window``, and those of shorter items."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item_id, text in items:
        words = words_of((text or "").encode())
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[k : k + m]), [])
            if item_id not in owners:
                owners.append(item_id)
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def _hits(words: list[bytes], searchers: list[WuManber], found: set) -> list[tuple[int, int]]:
    """Disjoint [start, end) word intervals inside any occurrence; adds the items to ``found``."""
    spans = []
    for s in searchers:
        for start, owners in s.search(words):
            spans.append((start, start + s.m))
            found.update(owners)
    return merge(spans)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


#: Greatest number of characters of the benchmark that is searched for at once: some 200 MB of tables in a worker process.
BLOCK_CHARS = 2_000_000


def _blocks(benchmark: DataFrame, max_chars: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``max_chars`` characters each, one block where it fits. A block is collected when its turn comes."""
    total = benchmark.agg(F.sum(F.length("text"))).head()[0] or 0
    n = total // max_chars + 1
    if n == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.filter(part == k) for k in range(n)]


def _each(docs: DataFrame, benchmark: DataFrame, block_chars: int, search: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """``search`` for block after block. Where there are several, what one block leaves is written before the next, so
    one broadcast and one searcher a worker are alive at a time; the last block's result is lazy."""
    blocks, held = _blocks(benchmark, block_chars), None
    for k, block in enumerate(blocks):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
        docs = search(docs, shared)
        if k < len(blocks) - 1:
            docs = materialize(docs, "block")
            shared.destroy()
            if held is not None:
                discard(held)
            held = docs
    return docs


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_words, hits (array of word intervals, end exclusive),
    item_ids (array of the items with an occurring window, sorted; ids that are no integers as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. The patterns are broadcast; their size is measured first, and a benchmark of more than
    ``block_chars`` characters is searched in blocks, one pass of the texts for each, written before the next, with equal results.

    Null and empty texts have no words and no hits. Items with null or empty text match nothing; a null
    item_id is dropped from item_ids, yet its words count as hit. Repeated items count once, by id.
    Repeated rows of ``docs`` each give a row. Columns of ``docs`` besides doc_id and text are not read.
    """
    whole = isinstance(benchmark.schema["item_id"].dataType, IntegralType)
    kind, id_type = ("bigint", pa.int64()) if whole else ("string", pa.string())
    out = docs.select("doc_id", "text").withColumns(
        {"n_words": F.lit(0).cast("long"), "hits": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
         "item_ids": F.expr(f"cast(array() as array<{kind}>)")}
    )

    def search(rows: DataFrame, shared: Broadcast) -> DataFrame:
        name = uuid.uuid4().hex

        def make():
            searchers = _compiled(name, shared, window)

            def run(batch: pa.RecordBatch):
                n_words, hits, ids = [], [], []
                for text, before, had in zip(utf8(batch["text"]), batch["hits"].to_pylist(), batch["item_ids"].to_pylist()):
                    words, found = words_of(text), set(had)
                    spans = _hits(words, searchers, found)
                    if before:
                        spans = merge(spans + [(h["start"], h["end"]) for h in before])
                    found.discard(None)
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in spans])
                    ids.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["text"], pa.array(n_words, pa.int64()),
                     pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(ids, pa.list_(id_type))],
                    names=["doc_id", "text", "n_words", "hits", "item_ids"],
                )

            return run

        return text_map(
            rows, rows.columns,
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, "
            f"hits array<struct<start:bigint,end:bigint>>, item_ids array<{kind}>", make,
        )

    return _each(out, benchmark.select(F.col("item_id").cast(kind), "text"), block_chars, search)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns: each text is judged where it lies.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty table stays empty, and so does nothing go where the
    benchmark has no words. No column name is taken.
    """
    return _each(docs, benchmark.select("item_id", "text"), block_chars, lambda rows, shared: keep_rows(rows, _judge(shared, window)))


def _judge(shared, window: int):
    name = uuid.uuid4().hex

    def make():
        searchers = _compiled(name, shared, window)
        return lambda batch: [not any(next(s.search(w), None) for s in searchers) for w in map(words_of, utf8(batch["text"]))]

    return make


_compiled_for: dict[str, list[WuManber]] = {}


def _compiled(name: str, shared, window: int) -> list[WuManber]:
    """The searchers of a broadcast benchmark, compiled once in a worker process."""
    if name not in _compiled_for:
        _compiled_for.clear()
        _compiled_for[name] = compile_items(shared.value, window)
    return _compiled_for[name]


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``decontaminate``'s result."""
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


__all__ = ["WuManber", "compile_items", "decontaminate", "digest", "words_of"]
