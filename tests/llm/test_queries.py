"""Every registered corpus query on empty tables and on rows with nulls, repeats, long texts and extra columns."""

import pytest

from tracelens.llm import queries

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, n_words string, ids int, spans double, shard int",
    "pages": "page_id long, url string, html string, digest int, record_type string",
    "labels": "doc_id long, quality int, toxic int, kept string",
    "benchmark": "item_id long, text string, n_words int",
    "conversations": "conv_id long, turn long, role string, text string, depth int, owner long",
}
LONG = "palabra " * 3000 + "z" * 30_000 + " 4465758382889437 " * 200
ROWS = {
    "documents": [(1, "under the MIT license", "en", "a", 21, "x", 1, 1.0, 1)] * 2 + [(2, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, None, 1, 1.0, 1), (4, LONG, "es", "a", 1, "x", 1, 1.0, 1), (None, "no id", "en", "a", 5, "x", 1, 1.0, 1)],
    "pages": [(1, None, "a" * 2000, 1, "x"), (2, "u", "a" * 2000, 1, "x"), (2, "u", "a" * 2000, 1, "x"), (3, "u", None, None, None), (None, "u", "b", 1, "x")],
    "labels": [(1, 1, 0, "x"), (None, None, None, None)],
    "conversations": [(0, 0, "user", "a", 1, 1)] * 2 + [(1, None, None, None, None, None), (2, 1, "user", LONG, 1, 1), (None, 1, "user", "a", 1, 1)],
    "benchmark": [(None, "no id", 1), (7, None, 1), (8, LONG, 1)],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "odd"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(ROWS[name] if kind == "odd" else [], schema).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty(spark, folders, name):
    assert queries.queries()[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_rows(spark, folders, name):
    table = "pages" if name.startswith("op8_") else "documents"
    got = queries.queries()[name](spark, folders["odd"]).collect()
    if name.startswith(("op11_", "op13_")):  # phrases and nodes, not documents
        assert len(got) == {"op11": 2, "op13": 3}[name[:4]]
        return
    key = "page_id" if table == "pages" else "doc_id"
    assert sorted((r[key] for r in got), key=str) == sorted((r[0] for r in ROWS[table]), key=str)


def test_folder_is_cleared(spark, folders):
    from tracelens.llm.common import clear, hadoop_fs, own_folder

    queries.queries()["op6_quality_rules"](spark, folders["odd"]).collect()
    fs, path = hadoop_fs(spark, own_folder(spark))
    assert fs.exists(path)
    clear(spark)
    assert not fs.exists(path)
