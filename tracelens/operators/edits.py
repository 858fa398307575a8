"""Line edits: ``edits`` is an array of (operation, start_line, end_line, expected_text, replacement_text).

operation is 'replace', 'insert' or 'delete'; lines count from 1 and ranges are inclusive; an insertion before line k has start_line k and end_line k - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import basename, bind, line_count, lines, text_or_empty

EDIT = "struct<operation:string,start_line:bigint,end_line:bigint,expected_text:string,replacement_text:string>"
MOST_EDITS, MOST_LINES = 8, 80


def is_insert(e: Column) -> Column:
    return e["operation"] == "insert"


def new_lines(e: Column) -> Column:
    return line_count(e["replacement_text"])


def old_lines(e: Column) -> Column:
    return F.when(is_insert(e), 0).otherwise(e["end_line"] - e["start_line"] + 1).cast("long")


def in_order(edits: Column) -> Column:
    """Edits by start, then end."""
    keyed = F.transform(edits, lambda e: F.struct(e["start_line"].alias("a"), e["end_line"].alias("b"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def measured(edits: Column) -> Column:
    """Edits by start, then end, as (insert, start, end, new, old): counts of lines instead of texts, for use against many lines."""
    return F.transform(in_order(edits), lambda e: F.struct(is_insert(e).alias("insert"), e["start_line"].alias("start"), e["end_line"].alias("end"), new_lines(e).alias("new"), old_lines(e).alias("old")))


def map_line(line: Column, edits: Column) -> Column:
    """Where a line stands after ``measured`` edits; null below 1 or where an edit replaces or deletes it."""
    gone = F.exists(edits, lambda e: ~e["insert"] & line.between(e["start"], e["end"]))
    before = F.filter(edits, lambda e: F.when(e["insert"], line >= e["start"]).otherwise(line > e["end"]))
    shift = F.aggregate(before, F.lit(0).cast("long"), lambda a, e: a + e["new"] - e["old"])
    return F.when((line >= 1) & ~gone, line + shift)


def is_new_line(line: Column, edits: Column) -> Column:
    """Whether a line of the edited text lies in text that one of the ``measured`` edits put there."""
    def step(a: Column, e: Column) -> Column:
        first = e["start"] + a["shift"]
        hit = (e["new"] > 0) & line.between(first, first + e["new"] - 1)
        return F.struct((a["shift"] + e["new"] - e["old"]).cast("long").alias("shift"), (a["hit"] | hit).alias("hit"))

    found = F.aggregate(edits, F.struct(F.lit(0).cast("long").alias("shift"), F.lit(False).alias("hit")), step, lambda a: a["hit"])
    return (line >= 1) & found


def changed_lines(edits: Column) -> Column:
    """Sum over the edits of the longer of expected and new text, in lines."""
    return F.aggregate(edits, F.lit(0).cast("long"), lambda a, e: a + F.greatest(line_count(e["expected_text"]), new_lines(e)))


def matches(own: Column, edits: Column) -> Column:
    """Whether every edit's expected lines are the text's lines in its range, and insertions expect none."""
    def fits(e: Column) -> Column:
        there = F.slice(own, F.greatest(e["start_line"], F.lit(1)).cast("int"), F.greatest(old_lines(e), F.lit(0)).cast("int"))
        return F.when(is_insert(e), text_or_empty(e["expected_text"]) == "").otherwise((F.size(there) == old_lines(e)) & (lines(e["expected_text"]) == there))

    return F.forall(edits, fits)


def apply_edits(text: Column, edits: Column) -> Column:
    """Lines of the text after the edits; null if an expected text doesn't match.

    One pass in order: what lies between two edits is copied, then the new lines follow; ranges refer to the text as it was.
    """

    def edited(own: Column) -> Column:
        def step(a: Column, e: Column) -> Column:
            keep = F.slice(own, a["at"].cast("int"), F.greatest(e["start_line"] - a["at"], F.lit(0)).cast("int"))
            new = F.when(e["operation"] == "delete", F.array().cast("array<string>")).otherwise(lines(e["replacement_text"]))
            return F.struct((e["end_line"] + 1).cast("long").alias("at"), F.concat(a["out"], keep, new).alias("out"))

        begin = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
        rest = lambda a: F.slice(own, a["at"].cast("int"), F.greatest(F.size(own) - a["at"] + 1, F.lit(0)).cast("int"))
        return F.when(matches(own, edits), F.aggregate(in_order(edits), begin, step, lambda a: F.concat(a["out"], rest(a))))

    return bind(lines(text), edited)


def keeps_final_newline(edits: Column, n_lines: Column, had: Column) -> Column:
    """Whether the edited text ends with a line end: as before, unless the last line is edited and had none; then as the last edit's new text ends."""
    touches = (n_lines == 0) | F.exists(edits, lambda e: (e["end_line"] == n_lines) | (e["start_line"] == n_lines + 1))
    last = F.element_at(in_order(edits), -1)["replacement_text"]
    return F.when(~touches | had, had).otherwise(last.endswith("\n") | last.endswith("\r"))


def edit_errors(e: Column) -> Column:
    """Array of what is wrong with an edit by itself."""
    empty = lambda f: text_or_empty(e[f]) == ""
    return F.array_compact(F.array(
        F.when(e["start_line"] < 1, "start below 1"), F.when(e["end_line"] < 0, "end below 0"),
        F.when(~is_insert(e) & (e["start_line"] > e["end_line"]), "reversed range"),
        F.when(is_insert(e) & (e["start_line"] != e["end_line"] + 1), "insertion range"),
        F.when(is_insert(e) & ~empty("expected_text"), "insertion expects text"),
        F.when((e["operation"] == "delete") & ~empty("replacement_text"), "deletion has new text"),
        F.when(~e["operation"].isin("replace", "insert", "delete"), "unknown operation"),
    ))


def overlaps(edits: Column) -> Column:
    """Indexes (from 1) of edits that start at or before the previous one's start or end, in the order given."""
    n = F.size(edits)
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    bad = lambda i: (F.get(edits, i)["start_line"] <= F.get(edits, i - 1)["start_line"]) | (F.get(edits, i)["start_line"] <= F.get(edits, i - 1)["end_line"])
    return F.filter(pairs, bad)


def proposal_errors(target: Column, edits: Column) -> Column:
    """Array of what is wrong with a proposal: its target's path, its edits, their order and their size."""
    each = F.flatten(F.transform(edits, edit_errors))
    return F.concat(each, F.array_compact(F.array(
        F.when(unsafe_path(target), "unsafe path"), F.when(F.size(edits) == 0, "no edits"), F.when(F.size(edits) > MOST_EDITS, "too many edits"),
        F.when(changed_lines(edits) > MOST_LINES, "too many lines"), F.when(F.size(overlaps(edits)) > 0, "out of order"),
    )))


def unsafe_path(path: Column) -> Column:
    """Whether a path climbs, mixes separators or holds shell characters."""
    return path.contains("..") | (path.contains("/") & path.contains("\\")) | path.rlike(r"[&|;><`$]")


def names_target(proposed: Column, target: Column) -> Column:
    """Whether a proposed path means the target: equal to it or to its name, or ending with it. Climbing and mixed separators never do."""
    plain = F.regexp_replace(F.replace(proposed, F.lit("\\"), F.lit("/")), "/+$", "")
    own = F.replace(target, F.lit("\\"), F.lit("/"))
    climbs = proposed.contains("..") | (proposed.contains("/") & proposed.contains("\\"))
    longer = (basename(plain) == basename(own)) & (~plain.contains("/") | plain.endswith(own))
    return ~climbs & ((plain == own) | (plain == basename(own)) | longer)
