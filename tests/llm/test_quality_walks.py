"""Cutoffs of strata with few labels, and of rules that some good documents break."""

from pyspark.sql import functions as F

from tracelens.llm import quality

WORDS = " ".join(f"word{i}" for i in range(80))
JUNK = {"symbols": WORDS + " " + "#$%&" * 150, "upper": WORDS.upper(), "lines": (WORDS[:40] + "\n") * 3 + "\n".join("same line" for _ in range(3)) + "\n" + "\n".join(WORDS.split())}
DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def test_strata_of_few_labels(spark):
    good = {"en": 2076, "de": 507, "fr": 505, "es": 270, "it": 200}
    own = [(lang, i) for lang, n in good.items() for i in range(n)]
    rows = [(i, f"{WORDS} {lang}{n}", lang) for i, (lang, n) in enumerate(own)]
    junk = [(100_000 + i, text, lang) for i, (lang, text) in enumerate((g, t) for g in good for t in JUNK.values())]
    docs = spark.createDataFrame(rows + junk, DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)
    got = quality.assess(docs, labels).select("doc_id", "stratum", "base_failed", "kept").collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if not r.kept} == {i for i, _, lang in junk if lang != "it"}  # five strata: 263 good labels at least
    assert {r.doc_id for r in quality.keep(docs, labels).collect()} == {r.doc_id for r in got if r.kept}


def test_lenient_cutoffs_where_strict_ones_fail(spark):
    rows = [(i, f"{WORDS} own{i}" + (" " + "#" * 40 if i % 10 == 0 else ""), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows + [(9000, JUNK["symbols"], "en")], DOCS)
    got = {r.doc_id for r in quality.keep(docs, spark.createDataFrame([(r[0], 1, 0) for r in rows], LABELS)).select("doc_id").collect()}
    assert got == set(range(4000))


def test_walks():
    steps = quality.joint_steps(quality.RULES)
    assert len(steps) == len(set(steps)) == sum(len(c) for _, c in quality.RULES.values()) and {s[0] for s in steps[-8:]} == {"few_words"}
    firsts = lambda n, **more: {name: {None: n} for name in (*quality.RULES, quality.JOINT)} | more
    strictest = {name: float(c[-1]) for name, (_, c) in quality.RULES.items()}
    assert quality.cutoffs_of(firsts(251), quality.RULES, 0.02, 0.05 / 4) == {} and quality.cutoffs_of(firsts(252), quality.RULES, 0.02, 0.05 / 4) == strictest
    # one rule rejects all good documents at once: the joint walk ends there, the others go on by themselves
    bad = firsts(4000, word_length={0: 4000}) | {quality.JOINT: {steps.index(("word_length", 0)): 4000}}
    assert quality.cutoffs_of(bad, quality.RULES, 0.02, 0.05) == {k: v for k, v in strictest.items() if k != "word_length"}


def plain_cutoffs(rows, rules, risk, level):
    """Cutoffs of one stratum from the values of its good documents, by plain counting and exact sums."""
    from math import comb

    n = len(rows)
    p_value = lambda k, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    ok = lambda k, p, part: k <= p * n and (1 if k >= n else p_value(k, p)) <= part
    above = lambda row, found: any(row[r] > c for r, c in found.items())
    joint, each = {}, {}
    order = sorted(((r, i) for r, (_, cuts) in rules.items() for i in range(len(cuts))), key=lambda s: (s[0] in quality.LAST, (s[1] + 1) / len(rules[s[0]][1])))
    for r, i in order:
        tighter = joint | {r: float(rules[r][1][i])}
        if not ok(sum(above(x, tighter) for x in rows), risk, level / 2):
            break
        joint = tighter
    for r, (_, cuts) in rules.items():
        for c in cuts:
            if not ok(sum(x[r] > c for x in rows), risk / len(rules), level / 2 / len(rules)):
                break
            each[r] = float(c)
    steps = lambda found: sum((rules[r][1].index(c) + 1) / len(rules[r][1]) for r, c in found.items())
    return max(joint, each, key=steps)


def test_kept_against_plain_steps(spark):
    import random

    from tests.llm.test_corpus import re

    rng = random.Random(6)
    rules = {"bangs_per_word": ("n_bangs / greatest(n_words, 1)", [0.5, 0.2, 0.1, 0.05]), "upper_share": ("n_upper / greatest(word_chars, 1)", [0.5, 0.3, 0.1]), "few_words": ("-n_words", [-30, -55, -65])}

    def text():
        n = rng.randint(40, 90)
        return " ".join(f"w{rng.randrange(10**6)}" + "!" * (rng.random() < share) for share in [rng.choice([0, 0, 0, 0.05, 0.4])] for _ in range(n)).replace("w", rng.choice("wwwwW"))

    rows = [(i, text(), rng.choice(["en", "en", "de", None])) for i in range(900)] + [(5000, None, "en"), (5001, "", "de"), (None, text(), "en"), (3, text(), "en")]
    given = [(i, int(rng.random() < 0.8), 0) for i in range(0, 900, 2)] + [(4, 0, 0), (None, 1, 0), (6, None, 0)]
    marks = {}
    for i, q, _ in given:
        marks.setdefault(i, []).append(q)
    good = {i for i, q in marks.items() if i is not None and min((x for x in q if x is not None), default=0) == 1}

    def facts(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {"bangs_per_word": (t or "").count("!") / max(len(w), 1), "upper_share": sum("A" <= c <= "Z" for c in t or "") / max(sum(map(len, w)), 1), "few_words": -len(w)}

    strata = {lang or "" for i, _, lang in rows if i in good}
    own = dict((i, (t, lang)) for i, t, lang in rows if i not in (None, 3))  # all texts differ; of the two of document 3 one counts
    three = min((t for i, t, lang in rows if i == 3), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).head()[0])
    assert [lang for i, _, lang in rows if i == 3 and lang == "en"]
    counted = [(i, t, lang) for i, (t, lang) in own.items()] + ([(3, three, "en")] if {lang for i, _, lang in rows if i == 3} == {"en"} else [r for r in rows if r[0] == 3])
    cuts = {s: plain_cutoffs([facts(t) for i, t, lang in counted if i in good and (lang or "") == s], rules, 0.1, 0.3 / len(strata)) for s in strata}
    assert any(cuts.values())
    want = sorted((str(i), t) for i, t, lang in rows if len((t or "").split()) >= 50 and not any(facts(t)[r] > c for r, c in cuts.get(lang or "", {}).items()))
    assert len(want) < sum(len((t or "").split()) >= 50 for _, t, _ in rows)  # the cutoffs reject some that the base rules keep
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(given, LABELS)
    options = {"rules": rules, "risk": 0.1, "level": 0.3}
    assert sorted((str(r.doc_id), r.text) for r in quality.keep(docs, labels, **options).collect()) == want
    judged = quality.assess(docs, labels, **options).filter("kept").select("doc_id", "q.n_words").collect()
    assert sorted(str(r.doc_id) for r in judged) == [i for i, _ in want]


def test_false_rejections_stay_within_the_risk():
    """Simulated holdouts: the cutoffs' true share of rejected good documents is above the risk in at most ``level`` of them."""
    import numpy as np

    rng = np.random.default_rng(4)
    rules = {"a": ("n_words", [3, 2, 1]), "b": ("n_bangs", [3, 2, 1]), "few_words": ("-n_words", [3, 2])}
    steps = quality.joint_steps(rules)
    risk, level, n, trials, wrong, acted = 0.05, 0.1, 400, 400, 0, 0
    for _ in range(trials):
        tails = {r: np.sort(rng.uniform(0, 0.08, len(c))) for r, (_, c) in rules.items()}  # true share beyond each cutoff
        at = {r: np.searchsorted(t, rng.random(n)) for r, t in tails.items()}  # the first cutoff that a document lies above; all of them: none
        firsts = {r: {} for r in (*rules, quality.JOINT)}
        for i in range(n):
            joint = []
            for r in rules:
                k = int(at[r][i]) if at[r][i] < len(tails[r]) else None
                firsts[r][k] = firsts[r].get(k, 0) + 1
                joint += [] if k is None else [steps.index((r, k))]
            j = min(joint, default=None)
            firsts[quality.JOINT][j] = firsts[quality.JOINT].get(j, 0) + 1
        found = quality.cutoffs_of(firsts, rules, risk, level)
        kept = 1.0
        for r, c in found.items():
            kept *= 1 - tails[r][rules[r][1].index(int(c))]
        wrong, acted = wrong + (1 - kept > risk), acted + bool(found)
    assert acted > trials / 4 and wrong <= level * trials


def cutoffs(spark, rows, labels, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    measured = docs.select("doc_id", quality.stratum_of("lang").alias("stratum"), F.xxhash64("text").alias("version"), quality.features("text").alias("q"))
    return {r.stratum: r.cutoffs for r in quality.calibrate(measured, spark.createDataFrame(labels, LABELS), **options).collect()}


def test_repeated_rows_and_copies_are_one_trial(spark):
    """One document, however often it is repeated and under whatever ids, sets no cutoff; repeating rows of many leaves theirs as they are."""
    one = [(1, WORDS, "en")]
    assert cutoffs(spark, one * 400, [(1, 1, 0)]) == {}
    assert cutoffs(spark, [(i, WORDS, "en") for i in range(400)], [(i, 1, 0) for i in range(400)]) == {}
    rows = [(i, f"{WORDS} own{i}" + (" " + "#" * 40 if i % 60 == 0 else ""), "en") for i in range(300)]
    labels = [(i, 1, 0) for i in range(1000)]
    once = cutoffs(spark, rows, labels)
    assert once["en"]
    copies = [(500 + i, rows[i % 40][1], "en") for i in range(400)]
    assert cutoffs(spark, rows * 3 + copies, labels) == once


def test_false_rejections_with_copies(spark):
    """Holdouts with many copies of few texts: as one trial each they keep the risk, which they would not if every row counted."""
    import numpy as np

    rng = np.random.default_rng(9)
    rules, risk, level, wrong = {"a": ("n_words", [1])}, 0.05, 0.1, {True: 0, False: 0}
    for _ in range(300):
        share = rng.uniform(0.051, 0.08)
        texts = rng.random(60) < share  # whether a text is rejected; each stands many times
        counts = rng.geometric(0.2, 60)
        for as_rows in wrong:
            n, k = (int(counts.sum()), int(counts[texts].sum())) if as_rows else (60, int(texts.sum()))
            found = quality.cutoffs_of({r: {0: k, None: n - k} for r in ("a", quality.JOINT)}, rules, risk, level)
            wrong[as_rows] += bool(found)
    assert wrong[False] <= level * 300 < wrong[True]
