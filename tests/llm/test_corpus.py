"""The other corpus operators against brute force, libraries, or round trips; null, empty and repeated rows throughout."""

import hashlib
import json
import random
import re

import numpy as np
import pytest

from tracelens.llm import bpe, decontam, langid, license_scan, quality, sharding, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def frame(spark, texts, more=()):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "null id", "x", 5), (0, texts[0], "x", 5)]
    return spark.createDataFrame(rows + list(more), "doc_id long, text string, n_words string, hits int").repartition(4)


EMPTY = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    bits = ["the", "License", "under the MIT license", "Apache-License, Version 2", "cc by-nc", "naïve", "Ünder", "\n", "x1", "日本語", "!!", "  ", "\t"]
    return [" ".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(120)] + ["", None, "mit " * 30000]


def test_license_base(spark, texts):
    phrases = {tuple(k.split()): v for k, v in license_scan.PHRASES.items()}
    got = {r.doc_id: r for r in license_scan.digest(license_scan.scan_licenses(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        at = sorted((k, v) for p, v in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({v for _, v in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def edit_distance(a, b):
    """Least edits between ``a`` and any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_license_fuzzy():
    """Edits of all three sorts outside the names: found with the right label, within the bound, at no more edits than were made or are needed."""
    scan = license_scan.NoticeScanner(license_scan.PHRASES, license_scan.NOTICES)
    rng = random.Random(2)
    for marked, label in license_scan.NOTICES.items():
        notice = license_scan.plain_notice(marked)
        assert [m[2:4] for m in scan.fuzzy(f" before {notice} after ")] == [(label, 0)], marked
        names = [m.span() for m in re.finditer(r"\{[^}]*\}", marked)]
        # places of the marked notice that belong to no name, nor to the spaces around one
        free = [i for i, c in enumerate(marked) if not any(a - 1 <= i <= b for a, b in names)]
        for _ in range(12):
            chars, k = list(marked.replace("#", "3")), rng.randint(1, len(notice) // 8)
            for i in rng.sample(free, min(k, len(free))):
                sort = rng.randrange(3)
                chars[i] = "" if sort == 0 else rng.choice("qzxj") if sort == 1 else chars[i] + rng.choice("qzxj")
            text = "".join(chars).replace("{", "").replace("}", "")
            found = scan.fuzzy(f" words here {text} and there ")
            need = edit_distance(notice, text)
            if need > len(notice) // 8:
                continue
            assert [m[2] for m in found] == [label], (text, found)
            assert all(m[3] <= max(need, 0) + 0 and m[4] == 1 - m[3] / len(notice) for m in found), (text, found, need)


@pytest.mark.parametrize("text, label", [
    ("released under the bsd license", "bsd"), ("released under the isc license", "isc"), ("released under the gpl license", "gpl"), ("released under the abc license", None),
    ("licensed under cc by sa 4 0", "cc-by-sa"), ("licensed under cc by nd 4 0", "cc-by-nd"), ("licensed under cc by 4 0", "cc-by"), ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"), ("licensed under cc by xx 4 0", None),
    ("licensed under the apache license version 1 1", "apache-1"), ("licensed under the apache license version 3 0", None), ("mozilla public license version 1 1", "mpl-1"), ("eclipse public license version 1 0", "epl-1"),
    ("licensed under the gnu general public license version 1", "gpl-1"), ("licensed under the gnu general public license version 4", None),
    ("released under the bsd license released undr the mit license", "bsd,mit"), ("gnu general public license", None), ("creative commons attribution 3 0 international", "cc-by"),
])
def test_license_names(text, label):
    scan = license_scan.NoticeScanner(license_scan.PHRASES, license_scan.NOTICES)
    assert ",".join(sorted({m[2] for m in scan.fuzzy(f" some {text} here ")})) == (label or "")


def test_license_spans(spark):
    docs = spark.createDataFrame([(1, "A b c: Released undr the MIT license; and licensed under CC-BY-SA 4.0!")], "doc_id long, text string")
    r = license_scan.digest(license_scan.scan_licenses(docs)).head()
    assert (r.spans, r.labels, r.base_labels, r.n_matches) == ("mit:3:5:1,cc-by-sa:9:7:0", "cc-by-sa,mit", "", 2)


def windows(text, m):
    w = WORD.findall(lower(text))
    k = min(m, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


@pytest.mark.parametrize("block", [32_000_000, 40])
def test_decontamination(spark, block):
    rng = random.Random(4)
    vocab = ["a", "b", "Ça", "d"]
    items = [(i, " ".join(rng.choices(vocab, k=k))) for i, k in enumerate([12, 3, 1, 10, 25, 9, 2])] + [(50, None), (51, "!"), (None, "b b b a"), (3, "d d")]
    docs = [" ".join(rng.choices([*vocab, "zz", "q-q"], k=rng.randint(0, 60))) for _ in range(150)] + ["", None, items[4][1].upper() + "!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = frame(spark, docs)
    got = {r.doc_id: r for r in decontam.digest(decontam.decontaminate(table, bench, block_chars=block)).collect()}
    kept = {r.doc_id for r in decontam.clean(table, bench, block_chars=block).collect()}
    for i, t in enumerate(docs):
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for item, text in items:
            for p in windows(text, 10):
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        ids.add(item)
        ids.discard(None)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (i in kept) == (not hit)


def test_quality_base(spark, texts):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    more = texts[:20] + ["a b c a b c a b c", "same\nsame\n\n \nsame\n same", "# * $ é% &|<> A!"]
    got = {r.doc_id: r for r in quality.digest(quality.assess(frame(spark, more), labels, stratum="n_words")).collect()}
    for i, t in enumerate(more):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        rep = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed)
        assert r.kept == (not failed)  # so few labels set no cutoff


def test_quality_thresholds(spark):
    assert quality.tail(10, 10, 0.1) == 1 and abs(quality.tail(20, 0, 0.1) - 0.9**20) < 1e-12
    assert quality.choose([3, 2, 1], [0, 0, 50], 1000, 0.02, 0.01) == 2.0 and quality.choose([3], [0], 10, 0.02, 0.01) is None
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} own{i}" + (" ! !" if i % 2 else ""), "en") for i in range(4000)] + [(10_000 + i, text.replace(" ", "!!! "), "en") for i in range(50)] + [(20_000, text.replace(" ", "!!! "), None)]
    docs = spark.createDataFrame(rows, EMPTY)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4000)] + [(10_000, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.digest(quality.assess(docs, labels))
    bad = {r.doc_id for r in got.filter("not kept").collect()}
    assert bad == set(range(10_000, 10_050))
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == {r[0] for r in rows} - bad
    assert quality.assess(docs.limit(0), labels).collect() == []


def test_bpe(spark, texts):
    from tokenizers import Tokenizer

    coder, ref = bpe.Bpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "Don", "'t", "'re", "1", "　", "é", "<|endoftext|>", "!", "<|", "\r", "\x1c", "\x85", "ab" * 80, "\x0b", "😀", "word"]
    made = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)] + [t or "" for t in texts] + ["zq" * 5000, "é" * 3000]
    ids = coder.encode_batch(made, chars=5000)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in ref.encode_batch(made, add_special_tokens=False)]
    assert [coder.decode(x) for x in ids] == made
    odd = [[0, 5, 50256, 128, 200, 220], [], [60000, 1]]
    assert [coder.decode(np.array(x, "<u4").tobytes()) for x in odd] == [ref.decode(x, skip_special_tokens=False) for x in odd]
    assert not PairCheck(coder)
    got = {r.doc_id: r for r in bpe.digest(bpe.encode_documents(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = ref.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_splits_every_code_point():
    from tokenizers import Tokenizer

    coder, ref = bpe.Bpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{x}1{x}!{x}'ll  {x} " for x in points[at : at + 20_000])
        assert coder.split(text) == [text[a:b] for _, (a, b) in ref.pre_tokenizer.pre_tokenize_str(text)]
    made = [f"x{c} {c}'ll" for c in "\U00019077\U0001e6c0\U00018d80\U000323b0\u1c89\u0558"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(made)] == [e.ids for e in ref.encode_batch(made, add_special_tokens=False)]


def test_bpe_tables_are_bounded():
    coder = bpe.Bpe(bpe.default_path(), cached=200, cached_chars=3000)
    rng = random.Random(8)
    for _ in range(20):
        words = ["".join(rng.choices("abcdef12", k=rng.randint(1, 400))) for _ in range(30)]
        text = "!" + " ".join(words)
        assert coder.decode(coder.encode(text)) == text
        for lead, known in (("", coder.whole), (" ", coder.later)):
            assert coder.held[lead] == sum(map(len, known)) and (len(known) <= 30 or len(known) <= 200 and coder.held[lead] <= 3000)


def PairCheck(coder):
    """Pairs whose rank the table doesn't give."""
    pairs = np.array(list(coder.ranks), np.int64)
    got = coder.pairs.ranks(pairs[:, 0], pairs[:, 1])
    other = coder.pairs.ranks(pairs[:, 1] + 7, pairs[:, 0])
    wrong = [p for p, g in zip(coder.ranks, got.tolist()) if coder.ranks[p] != g]
    return wrong + [p for p, g in zip((pairs[:, ::-1] + [7, 0]).tolist(), other.tolist()) if coder.ranks.get(tuple(p), bpe.NO_RANK) != g]


def test_token_counts(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_path())
    ref.encode_special_tokens = True
    some = texts + ["an <|endoftext|> inside"]
    for block in (64, 1 << 20):
        got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(frame(spark, some), block_bytes=block).collect()}
        assert got == {None: 2} | {i: len(ref.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(some)}
    assert token_counts.document_counts(spark.createDataFrame([], EMPTY)).collect() == []
    rng = np.random.default_rng(0)
    paths, want = [], []
    for k, n in enumerate((0, 1, 500, 4096)):
        ids = rng.choice([1, 2, token_counts.END], n, p=[0.5, 0.45, 0.05]).astype("<u2")
        ids.tofile(tmp_path / f"{k}.bin")
        paths.append(f"file://{tmp_path}/{k}.bin")
        start = 0
        for o, e in enumerate(np.flatnonzero(ids == token_counts.END).tolist()):
            want.append((paths[-1], o, start, e - start, True))
            start = e + 1
        if start < n:
            want.append((paths[-1], int((ids == token_counts.END).sum()), start, n - start, False))
    for span in (1, 3, 1024):
        found = token_counts.count_tokens(token_counts.token_files(spark, paths), block_bytes=30, span=span)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    wide = {r.doc_id: r.n_tokens for r in token_counts.document_counts(frame(spark, some[:30]), width=4, block_bytes=128).collect()}
    assert wide == {None: 2} | {i: got[i] for i in range(30)}


def test_token_files_refuse_ids_that_do_not_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="don't fit 2 bytes"):
        token_counts.write_token_files(docs, f"file://{tmp_path}/t", end=70_000)


def test_language_id(spark):
    rng = random.Random(9)
    vocab = {"en": ["the", "shore", "winter", "thing", "with"], "fr": ["être", "leçon", "où", "veau", "quelle"], "ru": ["это", "слово", "мир", "язык", "где"]}
    say = lambda lang, n: " ".join(rng.choices(vocab[lang], k=n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(["en", "fr", "ru"] * 60)]
    mixed = [(1000, f"{say('en', 30)}. {say('fr', 20)} -- {say('ru', 10)}", None), (1001, None, "en"), (1002, "123 !", "fr"), (1003, "", None), (None, say("fr", 9), None)]
    docs = spark.createDataFrame(rows + mixed + rows[:1], EMPTY)
    got = langid.learn_and_identify(docs).collect()
    assert len(got) == len(rows) + len(mixed) + 1
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows) and by_id[None].lang_pred == "fr" and not by_id[None].held_out
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1001, 1002, 1003))
    assert by_id[1000].lang_pred == "en" and by_id[1000].n_spans == 3
    import zlib
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    spans = langid.identify(docs, langid.train(docs)).filter("doc_id = 1000").head().spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"]
    assert {r.lang_pred for r in langid.learn_and_identify(docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.learn_and_identify(docs.limit(0)).collect() == []


def plain_model(rows):
    """Log-probabilities of trigram buckets and scripts of each language, counted letter by letter."""
    import collections
    import math

    grams, scripts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for word in plain_words(text):
            for g, s, _ in word:
                grams[lang][g] += 1
                scripts[lang][s] += 1
    total = {k: sum(v.values()) + 0.5 * langid.BUCKETS for k, v in grams.items()}
    score = lambda k, g: math.log((grams[k][g] + 0.5) / total[k])
    own = {k: {s for s, n in v.items() if n >= max(1, 0.001 * sum(v.values()))} for k, v in scripts.items()}
    return sorted(grams), score, own


def plain_words(text):
    """Words as lists of (bucket, script, place) of their letters."""
    out, low = [], []
    for c in text:
        low.append(0 if not c.isalpha() else ord(c.lower()) if len(c.lower()) == 1 else ord(c))
    low = [0, *low, 0]
    for i, c in enumerate(text):
        if c.isalpha():
            x = (low[i] * 0x9E3779B1 + low[i + 1] * 0x85EBCA77C2B2 + low[i + 2] * 0xC2B2AE3D27D4) & (1 << 48) - 1
            x = ((x ^ x >> 21) * 0x2545F4914F6D & (1 << 64) - 1) >> 20
            script = [s for a, s in langid.SCRIPT_RANGES if a <= ord(c)][-1]
            if not i or not text[i - 1].isalpha():
                out.append([])
            out[-1].append((x % langid.BUCKETS, script, i))
    return out


def plain_label(text, model, switch):
    """Language, share and spans of a text by Viterbi over all words, step by step."""
    langs, score, own = model
    words, best = plain_words(text), []
    if not words:
        return "und", 0.0, []
    for w in words:
        sums = [sum(score(k, g) for g, _, _ in w) for k in langs]
        fits = [w[0][1] in own[k] for k in langs]
        top = max(sums)
        row = [s if f or not any(fits) else top + langid.APART for s, f in zip(sums, fits)]
        if not best:
            best.append([(s, None) for s in row])
            continue
        last = [s for s, _ in best[-1]]
        at = last.index(max(last))
        best.append([(max(last[k], last[at] - switch) + s, k if last[k] >= last[at] - switch else at) for k, s in enumerate(row)])
    label = max(range(len(langs)), key=lambda k: best[-1][k][0])
    path = [label]
    for row in reversed(best[1:]):
        label = row[label][1]
        path.append(label)
    path.reverse()
    letters = [sum(len(w) for w, p in zip(words, path) if p == k) for k in range(len(langs))]
    spans = []
    for w, p in zip(words, path):
        if spans and spans[-1][2] == langs[p]:
            spans[-1][1] = w[-1][2] + 1
        else:
            spans.append([w[0][2], w[-1][2] + 1, langs[p]])
    top = letters.index(max(letters))
    return langs[top], letters[top] / sum(letters), [tuple(s) for s in spans]


def test_language_predictions_against_plain_steps(spark, monkeypatch):
    rng = random.Random(12)
    vocab = {"en": ["the", "shore", "winter", "Thing", "with", "a"], "fr": ["être", "leçon", "où", "veau", "a"], "ru": ["это", "слово", "мир"], "el": ["και", "ΛΌΓΟΣ", "θάλασσα"]}
    say = lambda lang, n: rng.choice([" ", ", ", " - "]).join(rng.choices(vocab[lang], k=n))
    rows = [(i, say(lang, rng.randint(3, 30)), lang) for i, lang in enumerate(["en", "fr", "ru", "el"] * 25)]
    rows += [(500 + i, "; ".join(say(rng.choice(list(vocab)), rng.randint(1, 9)) for _ in range(rng.randint(0, 5))) + rng.choice(["", " 漢字", " İ", " 42"]), None) for i in range(60)]
    docs = spark.createDataFrame(rows, EMPTY).repartition(3)
    model = langid.train(docs)
    plain = plain_model([(t, lang) for _, t, lang in rows if lang])
    assert model[0] == plain[0]
    for limit in (langid.SCORES, 40):
        monkeypatch.setattr(langid, "SCORES", limit)
        for (i, text, _), (lang, share, spans) in zip(rows, langid.label_texts([t for _, t, _ in rows], model, 12.0)):
            assert (lang, spans) == plain_label(text, plain, 12.0)[::2] and abs(share - plain_label(text, plain, 12.0)[1]) < 1e-9, (i, text)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9), r.spans) for r in langid.learn_and_identify(docs).collect()}
    import zlib

    taught = plain_model([(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2])
    for i, text, _ in rows:
        lang, share, spans = plain_label(text, taught, 12.0)
        assert got[i] == (lang, round(share, 9), ",".join(f"{a}:{b}:{x}" for a, b, x in spans))


def test_language_column_without_languages_is_refused(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'a text' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="more than 512 languages"):
        langid.train(docs)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.normal(size=(rng.integers(1, 7), 3)) * 2
        score = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(score, product(range(3), repeat=len(s))))
        assert abs(score(langid.viterbi(s, 1.5).tolist()) - best) < 1e-9


@pytest.mark.parametrize("parts", [1, 6])
def test_sharding_query(spark, tmp_path, parts):
    """All columns of the query: each row once, its text's digest, shards that hold as many rows as they say, and fewer shards than were appended."""
    import collections

    rng = random.Random(parts)
    rows = [(rng.choice([None, i, i // 3]), rng.choice([None, "", f"text {i} " * rng.randint(1, 50)]), "s", i) for i in range(400)]
    rows += rows[:40]
    spark.createDataFrame(rows, "doc_id long, text string, shard string, shard_rows int").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.shard_documents(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["doc_id", "shard", "shard_rows", "text_sha256"]
    count = collections.Counter
    assert count((r.doc_id, r.text_sha256) for r in got) == count((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in rows)
    held = count(r.shard for r in got)
    assert all(held[r.shard] == r.shard_rows for r in got) and len(held) < sharding.ARRIVALS * parts


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=60_000, least_bytes=2_000, fan_in=3)
    assert store.read() is None and store.manifest() == (0, [])
    want = []
    for k in range(5):
        rows = [(k * 100 + i if i else None, f"text {i} " * (i % 7) if i % 9 else None, "x") for i in range(40)] * 2
        want += rows
        store.append(spark.createDataFrame(rows, "doc_id long, text string, _x string").repartition(3))
    before, live = store.manifest()
    assert before == 5 and len(live) == 15 and sum(s["rows"] for s in live) == len(want)
    version = store.compact()
    after = store.manifest()[1]
    assert version > before and len(after) < 5 and all(s["bytes"] <= 60_000 for s in after)
    same = lambda df: sorted(map(tuple, df.drop("_shard").collect()), key=repr) == sorted(want, key=repr)
    assert same(store.read()) and same(store.read(before))
    assert store.compact() == version
    with pytest.raises(sharding.Conflict):
        store.commit(version - 1, [])
    again = sharding.ShardStore(spark, f"file://{tmp_path}/t")
    assert again.manifest() == store.manifest() and same(again.read())
    # another writer's arrival that is not committed yet is young, and stays
    spark.range(3).write.parquet(f"file://{tmp_path}/t/data/arrival-open")
    assert store.vacuum() == 0 and same(store.read(before))
    store._add(f"file://{tmp_path}/t/data/arrival-open")
    assert store.manifest()[0] == version + 1
    store.commit(version + 1, store.segments(version)[1])
    n_open = len(list((tmp_path / "t/data/arrival-open").glob("part-*.parquet")))
    assert store.vacuum(0) == 15 + n_open and same(store.read())
    assert not [s for s in store.runs(after)]
    # an append writes lines for its own shards alone, whatever the table holds
    held = set(store.segments()[1])
    store.append(spark.range(0).selectExpr("id as doc_id", "'x' as text", "'x' as _x"))
    assert set(store.segments()[1]) == held
    store.append(spark.createDataFrame(want[:3], "doc_id long, text string, _x string").coalesce(1))
    (new,) = set(store.segments()[1]) - held
    assert held < set(store.segments()[1]) and sum(x["rows"] for x in store.shards_of(new)) == 3
    assert json.dumps(sharding.pack([{"path": str(i), "bytes": 40, "seq": i} for i in range(5)], 100)).count("path") == 4


def test_language_memory_does_not_grow_with_the_text():
    """128 languages: a text of one megabyte takes as much as one of a quarter, beside the text and what it says, and so do many texts; 0.93 MB took 181 MB before."""
    import tracemalloc

    rng = np.random.default_rng(5)
    langs = [f"l{i:03d}" for i in range(128)]
    model = langs, np.log(rng.dirichlet(np.ones(langid.BUCKETS), 128)).astype(np.float32), np.ones((128, len(langid.SCRIPTS)), bool)
    word = lambda k: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 60)) for _ in range(k))
    langid.tables()
    peaks = []
    for texts in ([word(4000)], [word(16_000)], [word(1000) for _ in range(16)]):
        tracemalloc.start()
        langid.label_texts(texts, model, 12.0)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert max(peaks) < 60, peaks


def test_decontamination_with_names_as_ids(spark):
    """item_ids that are no numbers, sorted as strings."""
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([("b-10", words), ("b-9", words), ("Z", " ".join(words.split()[:10])), (None, words)], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.digest(decontam.decontaminate(docs, bench)).collect()}
    assert (got[1].n_items, got[1].items_sha256, got[1].n_hit) == (3, hashlib.sha256(b"Z,b-10,b-9").hexdigest(), 30) and not got[2].contaminated
    numbers = decontam.decontaminate(docs, spark.createDataFrame([(10, words), (9, words)], "item_id int, text string"))
    assert numbers.filter("doc_id = 1").head().item_ids == [9, 10]
    assert decontam.digest(numbers).filter("doc_id = 1").head().items_sha256 == hashlib.sha256(b"10,9").hexdigest()


def test_license_chains_of_overlaps():
    """A loses to B and B to C, which A does not touch: A and C stay. In general what stays is what a plain walk from the strongest on keeps."""
    a, b, c = (0, 10, "a", 3, 0.8), (8, 20, "b", 2, 0.9), (18, 30, "c", 0, 1.0)
    assert license_scan.strongest([a, b, c]) == [a, c] and license_scan.strongest([b, a]) == [b] and license_scan.strongest([]) == []
    rng = random.Random(3)
    for _ in range(200):
        found = [(s := rng.randint(0, 60), s + rng.randint(1, 15), rng.choice("xyz"), 0, rng.choice([0.8, 0.9, 1.0])) for _ in range(rng.randint(0, 12))]
        plain = []
        for m in sorted(found, key=lambda m: (-m[4], m[0] - m[1], m)):
            if all(m[1] <= k[0] or k[1] <= m[0] for k in plain):
                plain.append(m)
        assert license_scan.strongest(found) == sorted(plain)
