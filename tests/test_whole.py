"""Queries over whole tables: small fixtures on which a part of the rows or of a list gives another result."""

import math
from functools import reduce

import pytest

from tracelens.functions import costs
from tracelens.functions.text import CODE_END, CODE_START
from tracelens.operators import stats
from tracelens.plans import catalogue


@pytest.fixture
def run(spark, tmp_path):
    def result(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        return [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]

    return result


EVENTS = "event_id long, user_id long"


def test_spans_of_all_events(run):
    ids = [*range(40), *range(90, 130), 1005, 1006, 2009]
    own = [(i, i % 3) for i in ids]
    spans = [(i, f, i % 83, i % 83 + i % 19) for i, f in own]
    inner = {(i, f, i % 97, min(((e - s, o) for o, g, s, e in spans if g == f and s <= i % 97 <= e), default=(0, None))[1]) for i, f in own}
    got = run("j04_enclosing_function", events=(own, EVENTS))
    assert len(got) == len(own) and set(got) == inner
    pairs = sorted((a[0], b[0]) for a in spans for b in spans if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2])
    assert sorted(run("j05_overlapping_spans", events=(own, EVENTS))) == pairs


def test_costs_of_all_events(run):
    own = [(i, i % 11) for i in range(200)] + [(200 + i, 50) for i in (0, 8, 16, 24, 38)] + [(400, 51)]
    wanted = {u: reduce(costs.add, (costs.CLASSES[i % 8] for i, v in sorted(own) if v == u), costs.ONE) for _, u in own}
    assert wanted[50] == costs.EXP  # the fifth event decides
    assert dict(run("a15_cost_sum", events=(own, EVENTS))) == wanted


def test_roles_of_all_turns(run):
    turns = [(1, t, r) for t, r in enumerate(["user", "user", "assistant", "user", "tool"])] + [(2, 0, "system"), (2, 7, "user"), (2, 3, "assistant"), (2, 9, "system")] + [(3, 0, "b"), (3, 0, "a"), (4, 5, None), (4, 6, "user")]
    got = dict(run("a19_distinct_in_order", conversations=(turns, "conv_id long, turn int, role string")))
    assert got == {1: ["user", "assistant", "tool"], 2: ["system", "assistant", "user"], 3: ["a", "b"], 4: [None, "user"]}


def test_lines_of_whole_texts(run):
    texts = ["", None, "one", "a\nb\n", "\r\n".join(f"l{i}" for i in range(12)), "\n".join(f"l{i}" for i in range(406)) + "\n", "\n\n\n"]
    docs = (list(enumerate(texts)), "doc_id long, text string")
    lines = [(i, n + 1) for i, t in enumerate(texts) for n in range(len((t or "").splitlines()))]
    to = lambda n: None if n in (3, 8, 9) else n + (n > 3) + (n >= 6) - 2 * (n > 9)
    assert sorted(run("j07_line_shift", documents=docs), key=lambda r: r[:2]) == [(i, n, to(n)) for i, n in lines]
    assert sorted(run("j08_new_lines", documents=docs)) == [(i, n, n in (3, 4, 7)) for i, n in lines]


def edit_step(doc_id, text):
    """The first step of an edit prompt within 400 tokens and its tokens."""
    own = (text or "").splitlines()
    total, fault = len(own), doc_id % max(len(own), 1) + 1
    told = ["E1 at line 1", f"W2 at line {fault}"][: doc_id % 3]
    first, last = (max(1, fault - 15), min(total, fault + 15)) if total > 30 else (1, total)
    for name, a, b, shown in (("full source", 1, total, told), ("around the fault", first, last, told), ("without findings", first, last, [])):
        body = "\n".join(f"{n}: {own[n - 1]}" for n in range(a, b + 1))
        prompt = f"### Source\n{CODE_START}\n{body}\n{CODE_END}" + ("\n\n### Findings\n" + "\n".join(shown) if shown else "")
        tokens = max(1, math.ceil(len(prompt) / 3.5 * 1.15))
        if tokens <= 400:
            return name, tokens
    return None, None


def test_edit_steps_of_whole_texts(run):
    rows = [(i, "\n".join(["x" * (i % 40)] * (i // 3 % 60))) for i in range(600)] + [(600, ""), (601, None), (602, "y" * 1300), (603, "\n".join(["z" * 90] * 29))]
    rows += [(1000 + i, "v" * (1085 + i // 3)) for i in range(150)]
    got = {r[0]: r[1:] for r in run("d19_edit_context", documents=(rows, "doc_id long, text string"))}
    assert got == {i: edit_step(i, t) for i, t in rows}
    assert {name for name, _ in got.values()} == {"full source", "around the fault", "without findings", None}


def test_trees_of_any_depth(spark):
    chain = lambda n: [(i, i - 1 if i else None, 1, n) for i in range(n)]
    nodes = "id long, parent long, v long, run long"
    for n in (1, 2, 128, 129, 300, 1000):
        assert [tuple(r) for r in stats.tree_sums(spark.createDataFrame(chain(n), nodes), "v").collect()] == [(0, n, n)]
    many = chain(40) + chain(1) + chain(7) + [(90, 89, 5, 7), (91, 90, 5, 7)]
    assert sorted(tuple(r) for r in stats.tree_sums(spark.createDataFrame(many, nodes), "v", "run").collect()) == [(1, 0, 1, 1), (7, 0, 7, 7), (7, 89, 10, 2), (40, 0, 40, 40)]
    with pytest.raises(ValueError, match="cycle"):
        stats.tree_sums(spark.createDataFrame([(1, 2, 1, 0), (2, 3, 1, 0), (3, 1, 1, 0), (4, None, 1, 0)], nodes), "v")
    assert stats.tree_sums(spark.createDataFrame([], nodes), "v").collect() == []
