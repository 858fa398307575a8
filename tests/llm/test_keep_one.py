"""One row of each group of near duplicates, whatever their ids."""

from tracelens.llm import simhash


def test_repeated_rows_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{i * k}" for i in range(60))
    rows = [(1, text(3), "a"), (1, text(3), "b"), (2, text(3), "c"), (None, text(3), "d"), (None, text(5), "e"), (None, text(5), "f"), (7, text(7), "g"), (7, text(11), "h"), (9, text(11), "i"), (None, text(13), "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.mark for r in kept.collect())
    assert len(got) == 5 and got[0] in "ab" and got[1] in "ef" and got[2:] == ["g", "h", "j"]
