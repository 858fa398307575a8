"""Collocations, shared lines and prefix tries against plain Python, with nulls, repeats, ties and texts that are cut in many stretches."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tracelens.llm import collocations, line_dedup, prefix_trie


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- collocations ---------------------------------------------------------------------------------


def counted(rows, max_words):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def plain_collocations(rows, least, max_words=4, covered=80, top=2000):
    f, n = counted(rows, max_words)
    out = []
    for lang, counts in f.items():
        longer = defaultdict(int)
        for p, a in counts.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a) if a >= least else longer[p[i : i + m]]
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (longer[p] and 100 * longer[p] >= covered * a):
                score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["New", "york", "the", "of", "x", "été", "日本", "a\x00b", "Éa"]
    gaps = [" ", "  ", "\t", " ", " ", ", ", ". ", "\n", "\x0b"]
    text = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(150)]
    return rows + [("en", None), ("en", ""), (None, "., \t"), ("de", "the new york " * 700), rows[0], rows[0]]


@pytest.mark.parametrize("stretch", [1 << 20, 40])
def test_collocations(spark, prose, monkeypatch, stretch):
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(prose)], "doc_id long, lang string, text string, n int, phrase int").repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs).collect()]
    assert sorted(got) == plain_collocations(prose, 30)
    few = [tuple(r) for r in collocations.collocations(docs, max_words=3, least=2, covered=50, top=7).collect()]
    assert sorted(few) == plain_collocations(prose, 2, 3, 50, 7)


def test_stretches_repeat_words():
    """Phrases of a text without breaks, cut every few bytes, are each there once."""
    text = " ".join(f"w{i % 7}" for i in range(300)) + " " + "z" * 500 + " end of it"
    for size in (8, 33, 200):
        old, collocations.STRETCH = collocations.STRETCH, size
        try:
            seen = Counter()
            for data, repeated in collocations.stretches(iter([text.encode(), b"", b"a b"]), 4):
                words = collocations.Words(data)
                for m, at, _ in words.phrases(collocations.np.uint64(1), 4):
                    seen.update(words.text(at[collocations.np.searchsorted(at, repeated - m + 1) :], m).to_pylist())
        finally:
            collocations.STRETCH = old
        assert seen == Counter({" ".join(p): a for p, a in counted([("x", text), ("x", "a b")], 4)[0]["x"].items()})


def test_counters_prove_rareness(spark, prose):
    """However few counters there are, no frequent phrase is missed, and with enough of them rare ones are not exploded."""
    docs = spark.createDataFrame(prose, "lang string, text string").repartition(3)
    f, _ = counted(prose, 4)
    want = {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 30}
    rows = []
    for bits in (4, 16):
        made = collocations.exploded(docs, 4, collocations.counters(docs, 4, bits, 30)).filter("words > 0")
        found = {(r.lang, r.phrase): r.n for r in made.groupBy("lang", "phrase").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
        rows.append(len(found))
        assert want.items() <= found.items()
    assert rows[1] < rows[0] == sum(len(c) for c in f.values())


def test_packed_counters():
    """Blocks of all densities come back as they were, and totals stop at 255."""
    np, rng = collocations.np, collocations.np.random.default_rng(1)
    for share in (0, 0.001, 0.03, 0.05, 0.5, 1):
        block = np.where(rng.random(1 << 12) < share, rng.choice([1, 1, 1, 2, 200, 255], 1 << 12), 0).astype(np.uint8)
        packed, total = collocations.pack(block), np.zeros(1 << 12, np.uint16)
        assert bool(packed) == bool(block.any())
        for _ in range(2 if packed else 0):
            collocations.add_packed(total, packed)
        assert (total == np.minimum(2 * block.astype(int), 255)).all()


def test_exact_scores_of_large_counts(spark):
    """Products beyond 64 bits and quotients a hair below a whole number."""
    a, l = 9_007_199_254_740_993, 18_014_398_509_481_987_000 // 2
    df = spark.createDataFrame([(a, l, l + 1)], "a long, l long, r long")
    assert df.select(collocations.score("a", "l", "r")).head()[0] == 2000000 * a // (2 * l + 1)


# --- lines ----------------------------------------------------------------------------------------


def plain_lines(rows, least_chars=20, least_docs=3):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(d)
    last = {k: max((d for d in h if d is not None), default=None) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in last and last[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(3)
    pool = [f"A line that is long enough {i}" for i in range(9)] + ["short", "", " \t", "é" * 20, "Ünder twenty co", "x" * 19, "x" * 20]
    dress = lambda s: rng.choice(["", " ", "\t\r", "\x0b"]) + rng.choice([s, s.upper() if s.isascii() else s]) + rng.choice(["", "\x0c ", "\r"])
    text = lambda n: "\n".join(dress(rng.choice(pool)) for _ in range(n))
    rows = [(i, text(rng.randint(0, 8))) for i in range(60)] + [(100, text(700)), (101, None), (102, ""), (None, text(5)), (None, text(6)), (3, text(4)), (4, text(90))]
    rows += [(200 + i, "the one line of a third of all\nown line of mine number %d" % i) for i in range(40)] + [(200, "the one line of a third of all\nown line of mine number 0")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, at int").repartition(4)
    maps = line_dedup.keep_bitmaps(docs)
    out = line_dedup.deduplicated(docs, maps)
    assert sorted((tuple(r) for r in line_dedup.digest(out).collect()), key=str) == plain_lines(rows)
    assert set(docs.columns) < set(out.columns)
    few = line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs, 5, 2))
    assert sorted((tuple(r) for r in line_dedup.digest(few).collect()), key=str) == plain_lines(rows, 5, 2)


def test_bitmaps_are_compressed(spark):
    """A document of 100,000 lines that loses two has two words, and both bits are where the lines are."""
    line = "this line stands in three documents"
    lines = [f"{i}" for i in range(100_000)]
    lines[5] = lines[99_999] = line
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, line), (3, line)], "doc_id long, text string")
    maps = {r.doc: r for r in line_dedup.keep_bitmaps(docs).collect()}
    assert [tuple(w) for w in maps[1].words] == [(0, 1 << 5), (99_999 // 64, 1 << 99_999 % 64)] and maps[1].n_dropped == 2 and set(maps) == {1, 2}


def test_no_python_in_lines(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.digest(line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs)))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan) and "rangepartitioning" in plan.lower()


# --- conversations --------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for c, k, role, text in rows:
        if c is not None:
            turns[c].append((k is not None, k or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    base = lambda c: c - (c % 100 if c >= 0 else -(-c % 100))
    whole = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(base(c), [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids(p), sum(kids(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    conversations = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string").repartition(4)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations).collect()), key=str)


def test_trie(spark):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 12), 100, *range(101, 110), 205, 206, 300, -3, -100, -103]:
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hé", "b", None, "日本語"])) for k in range(rng.choice([0, 1, 2, 3, 6, 9]))]
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_copies_and_long_chains(spark):
    """Many equal conversations, one of 40 turns that others leave at many depths, and chains that hang on chains."""
    rows = [(c, k, "user", "same") for c in range(1000, 1030) for k in range(7)]
    rows += [(3, k, "user", f"t{k}") for k in range(40)]
    for i, c in enumerate(range(5, 40, 3)):
        rows += [(c, k, "user", f"t{k}" if k < 3 * i + 1 else f"u{c - c % 2}" if k < 3 * i + 4 else f"v{c}") for k in range(3 * i + 8)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_member_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    ends = spark.createDataFrame([(1, 2, c) for c in range(50)] + [(1, 3, 7), (2, 2, 9)], "owner long, depth int, conv_id long").repartition(5)
    got = {(r.owner, r.depth): r.ends_sha256 for r in prefix_trie.member_digests(ends).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): sha(range(50)), (1, 3): sha([7]), (2, 2): sha([9])}


def test_repeated_member_ids_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(empty).collect() == []
