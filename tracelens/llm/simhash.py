"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most four bits share at least four of their eight positional bytes, since
each differing bit spoils one byte. Posting lists of one (position, byte) would hold a 256th of all fingerprints, and
tallying their pairs would grow with the square of the input. A list is therefore keyed by the bytes at three
positions, or four for very many fingerprints; the position sets cover every set of four positions, so each pair with
four shared bytes meets in a list. Within a list, pairs are tallied by shared positional bytes, those below the guaranteed four
are dropped, and only the rest are verified by Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, utf8

BITS = 4  #: greatest number of differing bits of a link
SHARED = 8 - BITS  #: guaranteed number of shared positional bytes
SHINGLE, SEED = 4, 42


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` (3 or 4) of the 8 positions such that every 4 positions contain one of them.

    For 3: split the positions into thirds in a ring; take triples inside a third, and pairs of a
    third with one of the next (the covering has 20 triples).
    """
    if size == 4:
        return list(combinations(range(8), 4))
    third = [0, 0, 0, 1, 1, 1, 2, 2]

    def fits(t):
        kinds = sorted(third[i] for i in t)
        return len(set(kinds)) == 1 or len(set(kinds)) == 2 and (({*kinds} - {kinds[1]}).pop() - kinds[1]) % 3 == 1

    return [t for t in combinations(range(8), 3) if fits(t)]


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def simhash(text: bytes) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64; 0 without words."""
    import xxhash

    parts = shingles(text)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 16):
        h = np.array([digest(x, SEED) for x in parts[at : at + (1 << 16)]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.int64)[0])


def fingerprint(text: str) -> Column:
    """Column of fingerprints of a text column."""

    @F.arrow_udf("bigint")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([simhash(x) for x in utf8(column)], pa.int64())

    return run(text)


def candidates(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Count filter: which of ``others`` share at least SHARED positional bytes with x. Members of a list share the bytes of its key, one less than that."""
    tally = np.count_nonzero((others ^ x).view(np.uint8).reshape(-1, 8) == 0, axis=1)
    return np.flatnonzero(tally >= SHARED)


def _linked(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` link to x: the candidates, verified by their differing bits."""
    out, at = np.zeros(len(others), bool), candidates(x, others)
    out[at] = np.bitwise_count(others[at] ^ x) <= BITS
    return out


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each group of one list's distinct fingerprints to its first member.

    A member joins the group when some member of it links to it, so no link between groups is lost, while at
    most one link for each member leaves the list. The rest shrinks as groups grow, which makes groups of near copies cheap.
    """
    out, rest = [], members.view(np.uint64)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = _linked(frontier.pop(), rest)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out += [(root, f) for f in found]
                frontier += list(found)
    return [tuple(x) for x in np.array(out, np.uint64).reshape(-1, 2).view(np.int64).tolist()]


def _lists(long_list: int):
    """Batches sorted by key -> rows (u, v, key): links with a null key; members of lists longer than ``long_list`` as (fp, fp, key)."""

    def run(batches):
        held_key, held = None, []

        def flush(key, members):
            n = sum(map(len, members))
            if n < 2:
                return [], [], []
            if n > long_list:
                m = np.concatenate(members)
                return m.tolist(), m.tolist(), [key] * n
            links = forest(np.unique(np.concatenate(members)))
            return [a for a, _ in links], [b for _, b in links], [None] * len(links)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["u", "v", "key"])

        for batch in batches:
            keys, fps = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            rows: tuple = ([], [], [])

            def add(new, rows=rows):
                for own, more in zip(rows, new):
                    own += more

            if held_key is not None and keys[0] != held_key:
                add(flush(held_key, held))
                held = []
            if len(starts) == 1:
                held_key, held = keys[0], held + [fps]
            else:
                add(flush(keys[0], held + [fps[: ends[0]]]))
                several = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                for i in several:
                    add(flush(keys[starts[i]], [fps[starts[i] : ends[i]]]))
                held_key, held = keys[-1], [fps[starts[-1] :]]
            if sum(map(len, held)) > long_list:  # such a list leaves in parts, so it never gathers here
                m = np.concatenate(held)
                add((m.tolist(), m.tolist(), [held_key] * len(m)))
                held = []
            yield batch_of(rows)
        if held:
            yield batch_of(flush(held_key, held))

    return run


def links(prints: DataFrame, size: int = 3, long_list: int = 8192, block: int = 4096) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp`` of ``prints``, enough to join all that are connected.

    A list longer than ``long_list`` is dealt out in blocks of about ``block`` members; each pair of blocks is a list of its own.
    """
    byte = lambda i: F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255))

    def key(n: int, positions):
        out = F.lit(n).cast("long")
        for i in positions:
            out = out * 256 + byte(i)
        return out

    postings = prints.select("fp", F.explode(F.array(*[key(n, p) for n, p in enumerate(position_sets(size))])).alias("key"))
    run = _lists(long_list)
    found = materialize(postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint, key bigint"), "postings")
    out = found.filter("key is null").select("u", "v")
    deferred = found.filter("key is not null").select(F.col("u").alias("fp"), "key")
    if deferred.head(1):
        # a list leaves in parts; what is left of it by then may be short, so all of its members are taken anew
        whole = postings.join(deferred.select("key").distinct(), "key", "left_semi")
        n = whole.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        pairs = whole.join(n, "key").select(
            "fp", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.struct(F.least(b, mine).alias("i"), F.greatest(b, mine).alias("j")))).alias("p")
        )
        again = pairs.select("fp", F.xxhash64("key", "p.i", "p.j").alias("key")).repartition("key").sortWithinPartitions("key")
        out = out.union(again.mapInArrow(_lists(1 << 62), "u bigint, v bigint, key bigint").select("u", "v"))
    return out


def near_duplicates(docs: DataFrame, many: int = 1 << 25, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (bigint), component_id (smallest doc_id reachable over links of at most four bits).

    Copies meet in one fingerprint before any pair is formed. Null and empty texts have fingerprint zero and link like
    any other. A null doc_id takes part in linking and never is the smallest; a component of null ids alone has a null component_id.
    Rows that share a doc_id each give a row; where their texts differ, they belong to their own texts' components. Only doc_id and text are read.
    """
    prints = materialize(docs.select("doc_id", fingerprint("text").alias("fp")), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    options.setdefault("size", 4 if distinct.count() > many else 3)
    label = connected_components(links(distinct, **options))
    linked = materialize(distinct.join(label, distinct["fp"] == label["node"]).select("fp", "rep", "label"), "linked")
    lowest = materialize(linked.groupBy("label").agg(F.min("rep").alias("component_id")), "lowest")
    # of two written tables, the join may split a hot label; fingerprints without links keep their own smallest id
    named = linked.join(lowest, "label").select(F.col("fp").alias("__fp"), "component_id")
    own = distinct.join(named, distinct["fp"] == named["__fp"], "left")
    by_print = materialize(own.select("fp", F.when(F.col("__fp").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id")), "classes")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id, null ids last; of rows that share it any one.

    Only where ids are null or repeated, the rows are written once with a tag that tells them apart.
    """
    columns = docs.columns
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").head(1):
        docs = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = near_duplicates(docs.select(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("__row").alias("row")).alias("doc_id"), "text"))
        key, kept = "__row", found.filter("doc_id.row = component_id.row").select(F.col("doc_id.row").alias("__row"))
    else:
        key, kept = "doc_id", near_duplicates(docs).filter("doc_id = component_id").select("doc_id")
    # the keys are hashed, so that the texts are shuffled but neither sorted nor spilled
    return docs.join(kept.hint("shuffle_hash"), key, "left_semi").select(*[F.col(f"`{c}`") for c in columns])
