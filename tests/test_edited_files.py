"""Lines of whole files against their edits: few edits in place, many in a join."""

import random

import pytest

from tests.test_scan import map_line, some_edits
from tracelens.operators import scan
from tracelens.plans import catalogue

KIND = "file long, n_lines long, edits array<struct<insert:boolean,start:long,end:long,new:long,old:long>>"


def is_new(n, edits):
    shift = 0
    for _, s, _, new, old in edits:
        if new and s + shift <= n < s + shift + new:
            return True
        shift += new - old
    return False


@pytest.mark.parametrize("most", [scan.FEW_EDITS, 3 * scan.FEW_EDITS])
def test_lines_of_files(spark, most):
    rng = random.Random(9)
    files = [(f, rng.randint(1, 90), some_edits(rng, 80, n)) for f, n in enumerate([0, 1, 2, 5, most - 1, most, most])]
    files += [(10, 0, some_edits(rng, 9, 2)), (11, 4, None), (12, 3, [])]
    df = spark.createDataFrame(files, KIND).repartition(3)
    lines = [(f, n, e or []) for f, last, e in files for n in range(1, last + 1)]
    mapped, new = scan.mapped_files(df, "file", "n"), scan.new_in_files(df, "file", "n")
    assert mapped.columns == ["file", "n", "mapped"] and new.columns == ["file", "n", "is_new"]
    assert sorted((tuple(r) for r in mapped.collect()), key=str) == sorted(((f, n, map_line(n, e)) for f, n, e in lines), key=str)
    assert sorted(tuple(r) for r in new.collect()) == [(f, n, is_new(n, e)) for f, n, e in lines]


@pytest.mark.parametrize("name", ["j07_line_shift", "j08_new_lines"])
def test_few_edits_move_no_lines(spark, tmp_path, name):
    """The texts are read before, once; what is left neither reads them nor sends a line elsewhere. Files with one id have lines and edits of their own."""
    texts = [(1, "a\nb\nc\nd"), (2, ""), (3, None), (1, "x\n" * 9)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.queries()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1] and not [x for x in ("Exchange", "Join", "Window") if x in plan]
    value = (lambda n: None if n in (3, 8, 9) else n + (n > 3) + (n >= 6)) if name == "j07_line_shift" else (lambda n: n in (3, 4, 7))
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(((1, n, value(n)) for last in (4, 9) for n in range(1, last + 1)), key=str)
