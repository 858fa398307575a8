"""Language identification of mixed-language text.

Script ranges narrow the languages that a word can be in, per-word scores come from character trigrams, and
Viterbi decoding with a penalty for each switch labels spans of words.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_map

#: First code point of a range and its script ('' is common to all).
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x0250, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "canadian"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"),
    (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "yi"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xAC00, "hangul"), (0xD7B0, "hangul"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, ""), (0x20000, "han"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
BUCKETS = 1 << 14
GROUP_CHARS = 1_000_000  #: code points that are split into words in one go
SCORES = 4_000_000  #: letters times languages that are scored in one go
MOST_LANGS = 512  #: greatest number of languages of a model, whose size is 64 KB a language
APART = -1000.0  #: score of a word in a language that is not written in its script


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, its lower case where that is one code point, its script."""
    chars = [chr(c) for c in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        if len(low := chars[c].lower()) == 1:
            lower[c] = ord(low)
    starts = [a for a, _ in SCRIPT_RANGES]
    kinds = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.uint8)
    script = kinds[np.searchsorted(starts, np.arange(len(chars)), side="right") - 1]
    return letter, lower, script


class Words:
    """Words (runs of letters) of several texts: trigram bucket of each letter, first letter and text of each word."""

    def __init__(self, texts: list[str]):
        letter_of, lower_of, script_of = tables()
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "replace") + b"\0\0\0\0", np.uint32)
        self.letters = letter_of[points]
        low = np.where(self.letters, lower_of[points], 0).astype(np.uint64)
        before, after = np.r_[np.uint64(0), low[:-1]], np.r_[low[1:], np.uint64(0)]
        mixed = (before * np.uint64(0x9E3779B1) + low * np.uint64(0x85EBCA77C2B2) + after * np.uint64(0xC2B2AE3D27D4)) & np.uint64((1 << 48) - 1)
        mixed = ((mixed ^ (mixed >> np.uint64(21))) * np.uint64(0x2545F4914F6D)) >> np.uint64(20)
        at = np.flatnonzero(self.letters)
        self.bucket = (mixed[at] % np.uint64(BUCKETS)).astype(np.int64)
        self.script = script_of[points[at]]
        self.first = np.flatnonzero(np.r_[True, np.diff(at) > 1]) if len(at) else np.zeros(0, np.int64)  # index among letters
        self.start = at[self.first]
        self.size = np.diff(np.r_[self.first, len(at)])
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, side="right")
        self.offset = np.r_[0, ends[:-1]]


def groups(texts: list[str], most: int = GROUP_CHARS):
    """(first, last) of runs of texts of about ``most`` code points; a text of more is a run by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > most and at < i:
            yield at, i
            at, size = i, 0
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def chunks(text: str, most: int):
    """(first, last) of stretches of a text of about ``most`` code points that cut no word; a longer word is a stretch by itself."""
    letter, at = tables()[0], 0
    while len(text) - at > most:
        end = at + most
        while end > at and letter[ord(text[end - 1])]:
            end -= 1
        if end == at:
            end = at + most
            while end < len(text) and letter[ord(text[end])]:
                end += 1
        yield at, end
        at = end
    yield at, len(text)


def train(docs: DataFrame, max_docs_per_lang: int = 20_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages sorted, log-probabilities [language, bucket], scripts [language, script]).

    Counts are summed where the rows lie, then over tasks. Of a language with more than ``max_docs_per_lang``
    documents, about so many are taken, chosen by a hash of doc_id: the bound of the fit. Only the sums reach the driver, one row of
    BUCKETS + len(SCRIPTS) numbers a language. Languages are counted first: beyond MOST_LANGS of them, as of a column
    that holds no languages, the model and what it scores would outgrow memory, and the fit fails. Null languages and texts teach nothing.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = materialize(known.groupBy("lang").count(), "langs")
    langs = sorted(r["lang"] for r in counts.select("lang").limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"column lang holds more than {MOST_LANGS} languages")
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(SCRIPTS)), bool)
    part = 1_000_003
    limits = counts.select("lang", F.least(F.lit(part), F.floor(F.lit(float(part * max_docs_per_lang)) / F.col("count")) + 1).alias("limit"))
    sample = known.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < F.col("limit"))

    width = BUCKETS + len(SCRIPTS)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                own = total.setdefault(lang, np.zeros(width, np.int64))
                for a, b in chunks(text, GROUP_CHARS):
                    w = Words([text[a:b]])
                    own[:BUCKETS] += np.bincount(w.bucket, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(w.script, minlength=len(SCRIPTS))
        for lang, own in total.items():
            yield sums_row(lang, own)

    def sums_row(lang, own):
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([own.tobytes()], pa.binary())], names=["lang", "sums"])

    def added(batches):
        lang, own = None, None
        for batch in batches:
            for name, sums in zip(batch["lang"].to_pylist(), batch["sums"]):
                if name != lang:
                    if own is not None:
                        yield sums_row(lang, own)
                    lang, own = name, np.zeros(width, np.int64)
                own += np.frombuffer(sums.as_buffer(), np.int64)
        if own is not None:
            yield sums_row(lang, own)

    kind = "lang string, sums binary"
    parts = sample.select("lang", "text").mapInArrow(run, kind).repartition("lang").sortWithinPartitions("lang").mapInArrow(added, kind)
    full = np.zeros((len(langs), width))
    for lang, sums in parts.collect():
        full[langs.index(lang)] = np.frombuffer(sums, np.int64)
    grams, scripts = full[:, :BUCKETS] + 0.5, full[:, BUCKETS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    return langs, logs, scripts >= np.maximum(1, 0.001 * scripts.sum(axis=1, keepdims=True))


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word under ``switch`` for each change of label; ties go to the smaller label.

    One label throughout is best if no stretch of words gains more than ``switch`` by another label: each stretch that
    leaves it costs a switch at least. That is tested first, by greatest rise of the running gain.
    """
    whole = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [whole]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain]), axis=0)[:-1]
    if (gain - low).max() < switch:
        return np.full(len(scores), whole)
    best, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(best)
        at = best.index(top)
        came = [k if b >= top - switch else at for k, b in enumerate(best)]
        best = [max(b, top - switch) + s for b, s in zip(best, row)]
        back.append(came)
    label = best.index(max(best))
    out = [label]
    for came in reversed(back):
        label = came[label]
        out.append(label)
    return np.array(out[::-1])


def word_scores(w: Words, logs: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """Score of each word in each language: the sum of its trigrams' log-probabilities; a language that is not written in the word's script scores
    below all that are. Worked off in runs of words of about SCORES letters times languages, which bounds memory."""
    out = np.empty((len(w.first), len(logs)))
    ends = np.r_[w.first[1:], len(w.bucket)]
    step, lo = max(1, SCORES // len(logs)), 0
    table = logs.T
    while lo < len(w.first):
        hi = max(lo + 1, int(np.searchsorted(ends, w.first[lo] + step, side="right")))
        a, b = w.first[lo], ends[hi - 1]
        out[lo:hi] = np.add.reduceat(table[w.bucket[a:b]], w.first[lo:hi] - a, axis=0, dtype=np.float64)
        lo = hi
    fits = scripts.T[w.script[w.first]]
    fits |= ~fits.any(axis=1, keepdims=True)
    return np.where(fits, out, out.max(axis=1, keepdims=True) + APART)


def step(best: np.ndarray | None, row: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, int]:
    """One word of Viterbi: the new best scores, which labels stay what they were, and the label that the others come from."""
    if best is None:
        return row, np.ones(len(row), bool), 0
    at = int(best.argmax())
    floor = best[at] - switch
    return np.maximum(best, floor) + row, best >= floor, at


def label_long(text: str, model, switch: float, most: int):
    """What ``label_texts`` gives of one text, worked off in stretches: forwards, keeping the best scores before each stretch, then backwards, each stretch
    once more from those. Memory is that of a stretch, and a row of scores for each."""
    langs, logs, scripts = model
    cuts, before, best = list(chunks(text, most)), [], None
    for a, b in cuts:
        before.append(best)
        w = Words([text[a:b]])
        for row in word_scores(w, logs, scripts) if len(w.first) else ():
            best = step(best, row, switch)[0]
    if best is None:
        return "und", 0.0, []
    label, letters, spans = int(best.argmax()), np.zeros(len(langs), np.int64), []
    for (a, b), best in zip(reversed(cuts), reversed(before)):
        w = Words([text[a:b]])
        if not len(w.first):
            continue
        stays, froms = np.empty((len(w.first), len(langs)), bool), np.empty(len(w.first), np.int64)
        for i, row in enumerate(word_scores(w, logs, scripts)):
            best, stays[i], froms[i] = step(best, row, switch)
        for i in range(len(w.first) - 1, -1, -1):
            letters[label] += w.size[i]
            start = a + int(w.start[i])
            if spans and spans[-1][2] == label:
                spans[-1] = (start, spans[-1][1], label)
            else:
                spans.append((start, start + int(w.size[i]), label))
            label = label if stays[i, label] else int(froms[i])
    best = int(letters.argmax())
    return langs[best], float(letters[best] / letters.sum()), [(x, y, langs[k]) for x, y, k in reversed(spans)]


def label_texts(texts: list[str], model, switch: float):
    """(language or 'und', share of letters, spans (start, end, language)) of each text."""
    langs, logs, scripts = model
    out = [("und", 0.0, [])] * len(texts)
    if not langs:
        return out
    most = max(1, min(GROUP_CHARS, SCORES // len(langs)))
    for a, b in groups(texts, most):
        if b - a == 1 and len(texts[a]) > most:
            out[a] = label_long(texts[a], model, switch, most)
            continue
        w = Words(texts[a:b])
        if not len(w.first):
            continue
        scores = word_scores(w, logs, scripts)
        cuts = np.searchsorted(w.text, np.arange(b - a + 1))
        for i in range(b - a):
            lo, hi = cuts[i], cuts[i + 1]
            if lo == hi:
                continue
            labels = viterbi(scores[lo:hi], switch)
            size, start = w.size[lo:hi], w.start[lo:hi] - w.offset[i]
            letters = np.bincount(labels, size, len(langs))
            best = int(letters.argmax())
            first = np.flatnonzero(np.r_[True, np.diff(labels) != 0])
            last = np.r_[first[1:], len(labels)] - 1
            spans = [(int(start[f]), int(start[e] + size[e]), langs[labels[f]]) for f, e in zip(first, last)]
            out[a + i] = (langs[best], float(letters[best] / size.sum()), spans)
    return out


def identify(docs: DataFrame, model, switch: float = 12.0) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (share of letters in that language), spans (array of start, end, lang; code points).

    'und' with score 0 and no spans where text is null or has no letter, or nothing was learned. Ties go to the language that sorts
    first. Repeated rows each give a row; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(batch: pa.RecordBatch):
            found = label_texts([t or "" for t in batch["text"].to_pylist()], shared.value, switch)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], span)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

        return run

    return text_map(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>", make)


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def learn_and_identify(docs: DataFrame, **options) -> DataFrame:
    """The contract: learns from documents that are not held out, labels all. A null doc_id is not held out.

    Beside the contract's columns: n_spans, and spans as start:end:language (code points), by place, comma-joined. Repeated rows each give a row.
    """
    model = train(docs.filter(f"not {HELD_OUT}"), **options)
    found = identify(docs, model)
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"),
                        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["lang"])), ",").alias("spans"))
