"""The pipeline's stages against plain Python on the smallest tables."""

import os

import pytest

import corpus_pipeline as C
from tracelens.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_pipeline(spark):
    import hashlib

    from tokenizers import Tokenizer

    from tests.llm.test_corpus import WORD, lower, windows
    from tests.llm.test_pii import base
    from tests.llm.test_simhash import brute
    from tracelens.llm import bpe

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("source", "component_id").selectExpr("*", "1 as row")
    bench = [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in windows(r.text, 10)]
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        before, docs = {r.doc_id: r for r in docs.collect()}, materialize(stage(spark, docs, DATA), f"s{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        after = kept[name]
        if k == 1:
            assert sorted(after) == sorted(d for d, _, c in brute([(i, r.text) for i, r in before.items()]) if d == c)
        if k == 2:
            def hit(t):
                w = WORD.findall(lower(t))
                return any(tuple(w[i : i + len(p)]) == p for p in bench for i in range(len(w) - len(p) + 1))
            assert sorted(after) == sorted(i for i, r in before.items() if not hit(r.text))
        if k == 3:
            assert set(after) == set(before)
            for i, r in before.items():
                assert all(r.text[a:e] not in after[i].text for a, _, e, _ in base(r.text)) and (base(r.text) or len(after[i].text) <= len(r.text))
                assert after[i].n_chars == len(after[i].text)
        if k == 4:
            ref = Tokenizer.from_file(bpe.default_path())
            assert {i: r.n_tokens for i, r in after.items()} == {i: len(ref.encode(r.text, add_special_tokens=False).ids) for i, r in before.items()}
            assert all(r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i, r in after.items())
        elif k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "component_id", "n_chars", "row"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_run(spark):
    got = C.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 0


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, and columns named as the operators name theirs, through each stage."""
    clean = " ".join(f"word{i} says{i * 7} things{i * 3}" for i in range(40))
    texts = [clean, clean, None, "", clean + " mail a@b.co now", "short", " ".join(f"long{i}" for i in range(60_000)), "the same " * 100, clean.replace("word3", "other")]
    rows = [(i, t, "en" if i % 2 else None, None, len(t or ""), "s", "q", 1, "p", ["h"], 2.5) for i, t in enumerate(texts)]
    rows += [rows[0], (None, clean + " apart from all of the others in here", None, "x", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, stratum string, q string, component_id int, pii_spans string, hits array<string>, kept double").repartition(3)
    spark.createDataFrame([(0, 1, 0), (None, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "long5 long6 long7 long8 long9 long10 long11 long12 long13 long14 long15"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    stages, at = dict(C.STAGES), str(tmp_path)
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), at).collect() == []
        if name != "token ids":
            assert stage(spark, docs, at).schema.names == docs.schema.names
    kept = stages["quality rules"](spark, docs, at)
    assert ids(kept) == [0, 0, 1, 4, 6, 8, None] and {r.pii_spans for r in kept.collect()} == {"p", None}
    one = stages["near duplicates"](spark, kept, at)
    assert 1 not in ids(one) and set(ids(one)) >= {0, 6, None}
    assert ids(stages["decontamination"](spark, kept, at)) == [0, 0, 1, 4, 8, None]
    redacted = {r.doc_id: r for r in stages["personal data"](spark, docs, at).collect()}
    assert redacted[4].text.endswith("mail [EMAIL] now") and redacted[2].text is None and redacted[2].n_chars is None and redacted[4].pii_spans == "p"
    tokens = {r.doc_id: r.n_tokens for r in stages["token ids"](spark, docs, at).collect()}
    assert tokens[2] == tokens[3] == 0 and tokens[6] > 60_000
