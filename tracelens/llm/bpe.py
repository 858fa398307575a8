"""BPE encoding and decoding with a byte-level vocabulary file of the ``tokenizers`` library.

A short word's parts stand in one contiguous array, part i between boundaries i and i + 1, beside the ranks of adjacent
pairs. The ranks are scanned for the lowest, the boundary inside that pair is deleted, and the neighbouring ranks are
refreshed, until no pair merges. New words of equal length are rows of one matrix and take each of these steps together:
a row loses one boundary in each step, so the rows that still merge always have equal lengths. Longer words use a heap over
linked parts, whose result is the same.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map

#: How the pre-tokenizer splits text (fixed values of the byte-level vocabulary): {L} letters, {N} numbers, {S} white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: White space of the pre-tokenizer (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NO_RANK = (1 << 31) - 1  #: of a pair that doesn't merge


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters and numbers of the library's tables (Unicode 16) beyond those of Unicode 15.1 (fixed values).
LATER = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 "
         "113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


@cache
def classes() -> dict[str, str]:
    """Character classes of ``PATTERN`` as ranges: letters and numbers of ``unicodedata`` (15.1 in Python 3.13) and ``LATER``. Those of the
    ``regex`` module are newer than the library's."""
    kinds = np.array([category(chr(c))[0] for c in range(0x110000)])
    out = {"S": SPACE}
    for name, later in LATER.items():
        own = kinds == name
        for a, b in (r.split("-") for r in later.split()):
            own[int(a, 16) : int(b, 16) + 1] = True
        at = np.flatnonzero(own)
        ends = np.flatnonzero(np.diff(at) > 1)
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, ends + 1]].tolist(), at[np.r_[ends, len(at) - 1]].tolist()))
    return out


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the file: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def greatest_id(path: str) -> int:
    """The greatest id of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])


class PairTable:
    """Ranks of pairs of ids in an open-addressed table, looked up for whole arrays of pairs."""

    BITS = 18

    def __init__(self, ranks: dict[tuple[int, int], int]):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, NO_RANK, np.int32)
        for (a, b), rank in ranks.items():
            key = a << 32 | b
            slot = int(self._slots(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (1 << self.BITS) - 1
            self.keys[slot], self.values[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], NO_RANK)
        open_ = np.nonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        slots = slots[open_]
        while len(slots):
            slots = (slots + 1) & (1 << self.BITS) - 1
            own, want = self.keys[slots], keys[open_]
            hit = own == want
            out[tuple(x[hit] for x in open_)] = self.values[slots[hit]]
            more = ~hit & (own >= 0)
            open_, slots = tuple(x[more] for x in open_), slots[more]
        return out


class Bpe:
    """Encoder and decoder of one vocabulary file.

    ``short``: greatest number of bytes of a word in the matrices. ``cached``, ``cached_chars``: most pieces of text that a table keeps with
    their ids between groups of texts, and most characters of them.
    """

    def __init__(self, path: str, short: int = 48, cached: int = 1 << 18, cached_chars: int = 4 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        self.ranks, made = {}, []  # rank of a pair of ids, id that the merge of a rank makes
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.ranks[ids[left], ids[right]] = rank
            made.append(ids[left + right])
        self.made, self.pairs = np.array(made, np.int32), PairTable(self.ranks)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.short, self.cached, self.cached_chars = short, cached, cached_chars
        self.split = re.compile(PATTERN.format(**classes())).findall
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.joins = re.compile(f"[{SPACE}] ").search
        self.later: dict[str, bytes] = {}  # ids of a piece behind a space
        self.whole: dict[str, bytes] = {}  # ids of a piece as it is
        self.held = {"": 0, " ": 0}  # characters in ``whole`` and ``later``

    # --- words ------------------------------------------------------------------------------------

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words of one length."""
        parts = self.bytes[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self.pairs.ranks(parts[:, :-1], parts[:, 1:])
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        while len(row):
            width = parts.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(row), np.int64)
            low = ranks[np.arange(len(row)), at] if width > 1 else np.full(len(row), NO_RANK)
            ended = low == NO_RANK
            if ended.any():
                data = parts[ended].astype("<u4").tobytes()
                for k, i in enumerate(row[ended].tolist()):
                    out[i] = data[4 * width * k : 4 * width * (k + 1)]
                going = ~ended
                row, parts, ranks, at, low = row[going], parts[going], ranks[going], at[going], low[going]
                if not len(row):
                    break
            every = np.arange(len(row))
            parts[every, at] = self.made[low]
            parts = parts[np.arange(width) != at[:, None] + 1].reshape(len(row), width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(row), width - 2)
            for i in (at, at - 1):
                ok = np.flatnonzero((i >= 0) & (i < width - 2))
                ranks[ok, i[ok]] = self.pairs.ranks(parts[ok, i[ok]], parts[ok, i[ok] + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        rank, made, n = self.ranks.get, self.made, len(word)
        part = self.bytes[list(word)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] >= 0 else n
            if j >= n or rank((part[i], part[j])) != r:
                continue
            part[i], part[j] = int(made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in part if p >= 0]

    def learn(self, known: dict[str, bytes], pieces: set[str], lead: str) -> None:
        """Add the ids of ``lead`` + piece to ``known``, for pieces that it lacks. A table that would grow beyond its bounds is emptied first."""
        new = list(pieces.difference(known))
        if len(known) + len(new) > self.cached or self.held[lead] + sum(map(len, new)) > self.cached_chars:
            known.clear()
            self.held[lead], new = 0, list(pieces)
        self.held[lead] += sum(map(len, new))
        plain = [p for p in new if p.isalpha()]  # letters alone are one word
        known.update(zip(plain, self.merge([(lead + p).encode() for p in plain])))
        mixed = [p for p in new if not p.isalpha()]
        words = [self.split(lead + p) for p in mixed]
        once = list({w for own in words for w in own})
        ids = dict(zip(once, self.merge([w.encode() for w in once])))
        known.update((p, b"".join(map(ids.__getitem__, own))) for p, own in zip(mixed, words))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        out: list[bytes] = [b""] * len(words)
        cuts = np.flatnonzero(np.r_[True, np.diff(sizes) > 0]) if len(words) else []
        for a, b in zip(cuts, [*cuts[1:], len(words)]):
            same = order[a:b].tolist()
            if sizes[a] <= self.short:
                for i, ids in zip(same, self.merge_short([words[i] for i in same])):
                    out[i] = ids
            else:
                for i in same:
                    out[i] = np.array(self.merge_long(words[i]), "<u4").tobytes()
        return out

    # --- texts ------------------------------------------------------------------------------------

    def _cut(self, text: str, special: bool) -> list:
        """What a text is made of: ids of special tokens, and lists of pieces with the table of their ids.

        No pre-token holds a space after a character that is no white space, so text can be cut there.
        """
        out: list = []
        for part in self.specials.split(text) if special and self.specials and self.specials.search(text) else [text]:
            if special and part in self.special:
                out.append(int(self.special[part]).to_bytes(4, "little"))
            elif part and self.joins(part):
                out.append((self.whole, self.chunks(part)))
            elif part:
                head, *rest = part.split(" ")
                out += [(self.whole, [head] if head else []), (self.later, rest)]
        return out

    def encode_batch(self, texts: list[str], special: bool = True, chars: int = 2_000_000) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers. ``special``: read special tokens' strings as those tokens.

        Texts are worked off in groups of about ``chars`` characters, which bounds memory.
        """
        out: list[bytes] = []
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= chars or i == len(texts) - 1:
                cut = [self._cut(x, special) for x in texts[at : i + 1]]
                for known, lead in ((self.whole, ""), (self.later, " ")):
                    pieces: set[str] = set()
                    for parts in cut:
                        for p in parts:
                            if p[0] is known:
                                pieces.update(p[1])
                    self.learn(known, pieces, lead)
                for parts in cut:
                    out.append(b"".join(p if isinstance(p, bytes) else b"".join(map(p[0].__getitem__, p[1])) for p in parts))
                at, size = i + 1, 0
        return out

    def encode(self, text: str, special: bool = True) -> bytes:
        return self.encode_batch([text], special)[0]

    def decode(self, ids: bytes) -> str:
        """Text of ids; unknown ids give nothing, bytes that are no UTF-8 give U+FFFD."""
        known, n = self.tokens, len(self.tokens)
        values = np.frombuffer(ids, "<u4")
        return b"".join(map(known.__getitem__, values[values < n].tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encoded(text, path: str | None = None):
    """Column of ids (binary: little-endian unsigned 32-bit integers) of a text column; null and empty give no ids."""
    path = path or default_path()

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array(bpe.encode_batch([x or "" for x in column.to_pylist()]), pa.binary())

    return encode(text)


def decoded(ids, path: str | None = None):
    """Column of texts of a column of ids as ``encoded`` gives them; null gives ''."""
    path = path or default_path()

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.decode(x or b"") for x in column.to_pylist()], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (binary), decoded (string).

    Null and empty texts give no ids and ''. Special tokens' strings in a text are read as those tokens, as the library does.
    Repeated rows each give a row; only doc_id and text are read.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def run(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1000):  # one map for both ways: chained functions of columns would encode twice
                part = batch.slice(at, 1000)
                ids = bpe.encode_batch([x or "" for x in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(ids, pa.binary()), pa.array(list(map(bpe.decode, ids)), pa.string())], names=["doc_id", "ids", "decoded"]
                )

        return run

    return text_map(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string", make)


def digest(found: DataFrame, *more: str) -> DataFrame:
    """The contract's columns from ``encode_documents``' result, and those named in ``more``."""
    return found.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
