"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tracelens.llm import simhash as S


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["the", "of", "Über", "trace", "line", "ERROR", "fix", "ok", "naïve", "run"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(60, 120))) for _ in range(40)]
    texts = list(base)
    for b in base[:20]:
        for _ in range(4):
            w = b.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append("\t".join(w[:3]) + "\n" + " ".join(w[3:]))
    texts += [None, "", " \n", "one two", "one two", "ONE two three four"] + base[:5]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(None, base[0]), (None, "lonely null id text"), (7, texts[1])]


def test_position_sets_cover_every_four():
    for size, n in ((3, 20), (4, 70)):
        sets = S.position_sets(size)
        assert len(sets) == n
        assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def test_fingerprint():
    assert S.simhash(b"") == 0
    for t in ("a", "A b\x0bc d e", "é É x y z", "w " * 70000):
        assert S.simhash(t.encode()) & (1 << 64) - 1 == brute_print(t)


@pytest.mark.parametrize("options", [{}, {"size": 4}, {"long_list": 3, "block": 2}])
def test_near_duplicates(spark, rows, options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, fp string").repartition(5)
    got = S.digest(S.near_duplicates(docs, **options)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows if d is not None and d != 7], "doc_id long, text string, component_id int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([r for r in rows if r[0] is not None and r[0] != 7])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in want if d == c)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest_of_dense_list():
    rng = np.random.default_rng(1)
    members = np.unique(np.int64(5) ^ (np.int64(1) << rng.integers(0, 12, (3000, 2))).sum(axis=1))
    joined = S.forest(members)
    assert len(joined) == len(members) - 1


def test_components_of_paths_and_stars(spark):
    from tracelens.llm.common import connected_components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(7000, 7000), (None, 3)]
    random.Random(2).shuffle(edges)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long").filter("u is not null")).collect()))
    assert got == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(400)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_count_filter_decides_what_is_verified(monkeypatch):
    """In a list of equal bytes at three positions few pairs share a fourth byte; only those are verified, links are those of all pairs, and no link is outside the filter."""
    rng = np.random.default_rng(2)
    members = rng.integers(0, 1 << 64, 400, np.uint64) & ~np.uint64(0xFFFFFF) | np.uint64(0x123456)
    near = members[:150] ^ (np.uint64(1) << rng.integers(24, 64, 150).astype(np.uint64))
    members = np.unique(np.r_[members, near, near[:50] ^ np.uint64(1 << 30)])
    retained = sum(len(S.candidates(x, members[i + 1 :])) for i, x in enumerate(members))
    pairs = len(members) * (len(members) - 1) // 2
    links = {(i, i + 1 + int(j)) for i, x in enumerate(members) for j in np.flatnonzero(S._linked(x, members[i + 1 :]))}
    want = {(i, j) for i, j in combinations(range(len(members)), 2) if (int(members[i]) ^ int(members[j])).bit_count() <= 4}
    assert links == want and len(want) < retained < pairs / 20
    monkeypatch.setattr(S, "SHARED", 3)  # without the filter every pair of the list is a candidate
    assert sum(len(S.candidates(x, members[i + 1 :])) for i, x in enumerate(members)) == pairs
