"""License scans: fuzzy search for short notices.

Each notice of length L may be matched with up to k = L // 8 character edits. Cut into k + 1 pieces, any such
match holds one piece unchanged (pigeonhole); an automaton over all pieces finds the candidate places in one pass.
The pieces are the leaves of a binary tree whose node over m pieces may have m - 1 edits: a match of a node within its
bound has a child within its own (pigeonhole again), so a candidate is verified upwards by the ``regex`` library's
bounded-error matching and given up at the first node that fails. Before the root, whose bound is the largest, the least number of edits
is counted (``least_edits``): a hopeless place ends there, and any other is matched under its own bound. The root gives edits and spans.

What names the license and its version must stand in the match without an edit: "released under the bsd license" is three edits from
the notice of another license, but no match of it.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map, utf8
from .decontam import words_of

#: Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

NODE_EDITS = 3  #: greatest bound of an inner node that is matched on the way to the root

#: Notices for the fuzzy search, as lower-case words joined by single spaces, and their labels. Words in braces name the license or its version
#: and must match as they are, in this order; ``#`` among them stands for any number.
NOTICES = {
    "released under the {mit} license": "mit",
    "released under the {bsd} license": "bsd",
    "released under the {isc} license": "isc",
    "released under the {zlib} license": "zlib",
    "released under the {gpl} license": "gpl",
    "granted free of charge to any {person obtaining} a copy": "mit",
    "granted free of charge to any {person or organization} obtaining a copy": "bsl-1",
    "for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the {apache} license {version 1} 1": "apache-1",
    "licensed under the {apache} license {version 2} 0": "apache-2",
    "licensed under {cc by #} 0": "cc-by",
    "licensed under {cc by sa} 4 0": "cc-by-sa",
    "licensed under {cc by nc} 4 0": "cc-by-nc",
    "licensed under {cc by nd} 4 0": "cc-by-nd",
    "licensed under {cc by nc sa} 4 0": "cc-by-nc-sa",
    "licensed under {cc by nc nd} 4 0": "cc-by-nc-nd",
    "creative commons {attribution #} 0 international": "cc-by",
    "creative commons attribution {sharealike}": "cc-by-sa",
    "creative commons attribution {noderivatives}": "cc-by-nd",
    "creative commons attribution {noncommercial}": "cc-by-nc",
    "creative commons attribution {noncommercial sharealike}": "cc-by-nc-sa",
    "creative commons attribution {noncommercial noderivatives}": "cc-by-nc-nd",
    "licensed under the {gnu} general public license {version 1}": "gpl-1",
    "licensed under the {gnu} general public license {version 2}": "gpl-2",
    "licensed under the {gnu} general public license {version 3}": "gpl-3",
    "gnu {lesser} general public license": "lgpl",
    "gnu {library} general public license": "lgpl",
    "gnu {affero} general public license": "agpl",
    "{mozilla} public license {version 1} 1": "mpl-1",
    "{mozilla} public license {version 2} 0": "mpl-2",
    "{eclipse} public license {version 1} 0": "epl-1",
    "{eclipse} public license {version 2} 0": "epl-2",
    "free and unencumbered software released into the public domain": "unlicense",
    "no part of this publication may be reproduced": "proprietary",
}


def plain_notice(notice: str) -> str:
    """The words of a notice; a number that may be any is 4."""
    return notice.replace("{", "").replace("}", "").replace("#", "4")


def identity(notice: str) -> re.Pattern | None:
    """Pattern of what must match as it is, in a stretch of whole words between spaces; None of a notice without such words."""
    parts = [re.escape(x).replace(r"\#", "[0-9]+") for x in re.findall(r"\{([^}]*)\}", notice)]
    return re.compile(".*?".join(f"(?<= ){x}(?= )" for x in parts)) if parts else None


def least_edits(masks: dict[str, int], size: int, text: str) -> int:
    """Least edits between a pattern of ``size`` characters and any stretch of ``text``; ``masks``: places of each character in the pattern, as bits.

    Columns of the distance table as bit vectors of differences (Myers, Hyyrö).
    """
    every, top = (1 << size) - 1, 1 << size - 1
    up, down, score = every, 0, size
    best = size
    for c in text:
        same = masks.get(c, 0)
        vertical = same | down
        across = ((same & up) + up ^ up) | same
        more, less = down | every & ~(across | up), up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | every & ~(vertical | more), more & vertical
    return best


class NoticeScanner:
    """Finds phrases exactly and notices with up to ``len // edits_per`` edits in normalised text."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str], edits_per: int = 8):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices, self.within, self.masks, self.names = [], [], [], []
        self.paths: list[list[tuple]] = []  # of each piece, by number: (offset, length, bound, pattern) of the nodes above it
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for n, (marked, label) in enumerate(notices.items()):
            notice = plain_notice(marked)
            self.names.append(identity(marked))
            k = len(notice) // edits_per
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            self.notices.append((len(notice), label, k))

            def climb(lo: int, hi: int, above: list, n=n, notice=notice, cuts=cuts):
                part = notice[cuts[lo] : cuts[hi]]
                if hi - lo == 1:
                    pieces.setdefault(part, []).append((n, cuts[lo], len(self.paths)))
                    self.paths.append(above or [(0, len(part), 0, regex.compile(regex.escape(part)))])
                    return
                here = (cuts[lo], len(part), hi - lo - 1, regex.compile(f"(?:{regex.escape(part)}){{e<={hi - lo - 1}}}"))
                above = [here, *above] if hi - lo - 1 <= NODE_EDITS else above
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi)):
                    climb(a, b, above)

            climb(0, k + 1, [])
            self.within.append([regex.compile(f"(?:{regex.escape(notice)}){{e<={e}}}") for e in range(k + 1)])
            self.masks.append({c: sum(1 << i for i, x in enumerate(notice) if x == c) for c in set(notice)})
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """(word index, label) of every place where a phrase's words stand consecutively."""
        out = []
        for phrase, label in self.phrases:
            at, counted, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                out.append((word, label))
                at = joined.find(phrase, at + 1)
        return sorted(out)

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of matches; of those that overlap the most similar, then the longest."""
        zones: set[tuple[int, int, int]] = set()
        for end, (length, uses) in self.seeds.iter(joined):
            for n, offset, piece in uses:
                start = end - length + 1 - offset  # of the notice, but for the edits before the piece
                m = None
                for at, size, bound, pattern in self.paths[piece]:
                    m = pattern.search(joined, max(0, start + at - bound), start + at + size + bound)
                    if not m:
                        break
                if m:
                    zones.add((n, max(0, start - self.notices[n][2]), start))
        out, done = [], (-1, 0)
        for n, a, start in sorted(zones):
            size, label, k = self.notices[n]
            a, b = max(a, done[1]) if done[0] == n else a, start + size + k
            while b - a >= size - k and (e := least_edits(self.masks[n], size, joined[a:b])) <= k and (m := self.within[n][e].search(joined, a, b)):
                if self.named(n, joined, m.start(), m.end()):
                    done = (n, m.end())
                    out.append((m.start(), m.end(), label, e, 1 - e / size))
                    break
                a = m.start() + 1  # another match may begin later
        return strongest(out)

    def named(self, n: int, joined: str, start: int, end: int) -> bool:
        """Whether a match, widened to whole words, holds what names its license."""
        if self.names[n] is None:
            return True
        start = start if joined[start] == " " else joined.rfind(" ", 0, start)
        end = end if joined[end - 1] == " " else joined.find(" ", end) + 1
        return bool(self.names[n].search(joined, start, end))


def strongest(matches: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Matches without overlaps, by start: the most similar first, then the longest, then the earliest; one stays if it overlaps none that stays before it."""
    kept: list[tuple] = []
    for m in sorted(set(matches), key=lambda m: (-m[4], m[0] - m[1], m)):
        i = bisect.bisect(kept, m)
        if (i == 0 or kept[i - 1][1] <= m[0]) and (i == len(kept) or m[1] <= kept[i][0]):
            kept.insert(i, m)
    return kept


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, edits_per: int = 8
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, base (array of word index and label of every exact phrase place),
    matches (array of label, first word, number of words, edits, similarity of every fuzzy match, by place).

    Words are those of the base rule over the whole text, A-Z lower-cased; null and empty texts have none and match
    nothing. Base places that overlap are all kept; of fuzzy matches that overlap the most similar, then the longest stays. Repeated rows each give a row; only doc_id and text are read.
    """

    def make():
        scanner = NoticeScanner(phrases, notices, edits_per)

        def run(batch: pa.RecordBatch):
            n_words, base, matches = [], [], []
            for text in utf8(batch["text"]):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                n_words.append(len(words))
                base.append([{"word": w, "label": x} for w, x in scanner.base(joined)])
                plain = joined.decode()
                found = scanner.fuzzy(plain)
                own = []
                if found:
                    spaces = [i for i, c in enumerate(plain) if c == " "]
                    for a, b, label, edits, like in found:
                        first = max(0, bisect.bisect_right(spaces, a) - 1)
                        last = bisect.bisect_left(spaces, b) - 1
                        own.append({"label": label, "word": first, "n_words": max(1, last - first + 1), "edits": edits, "similarity": like})
                matches.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()),
                 pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                 pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()),
                                                       ("edits", pa.int64()), ("similarity", pa.float64())])))],
                names=["doc_id", "n_words", "base", "matches"],
            )

        return run

    return text_map(
        docs, ["doc_id", "text"],
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, base array<struct<word:bigint,label:string>>, "
        "matches array<struct<label:string,word:bigint,n_words:bigint,edits:bigint,similarity:double>>", make,
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan_licenses``' result; n_matches of the fuzzy search, and spans: label:first word:number of words:edits of each,
    by place, comma-joined."""
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    some = F.size("base") > 0
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.when(some, F.array_min("base.word")).alias("first_word"),
        F.when(some, F.array_max("base.word")).alias("last_word"),
        labels("base.label").alias("base_labels"),
        labels("base.label", "matches.label").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce(F.array_max("matches.similarity"), F.lit(0.0))).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["label"], m["word"], m["n_words"], m["edits"])), ",").alias("spans"),
    )
