"""The trie of conversations' prefixes: which turns conversations share from their start on.

Each depth of a conversation has a digest of the turns up to it. The owner of a prefix is its smallest conversation, so what a
conversation owns begins at one depth and goes on to its end: the depth is found by binary search, a batched join against the digests'
minima for all conversations at once in each round. What is owned is a chain; chains hang on nodes of other chains, and sums over
subtrees come from the chains, those without open children first. Each round is written to the shared folder.

* Turns come in order of turn (null first), turns of one number by role, then text. Null roles and texts are empty.
* Rows without a conv_id are of no conversation. Without conversations there is no node, not even a root.
* A conversation of any length is ordered and summed in ranges (``running``), never in one task.
* Prefixes are told apart by 128 bits, exclusive-or of a hash of each turn and its place.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from .common import discard, materialize

#: Ids that one piece of a member list holds at most.
PIECE = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, text)."""
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = running(turns, ["conv_id"], ["turn", "role", "text"], sums={"place": F.lit(1)}, cut_by=["turn"])
    return placed.select("conv_id", F.col("place").cast("int").alias("place"), "role", "text")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text): the first h turns of conversation c - c % 100, then the own turns of c after its first h, h = crc32(c) % 6.

    A row with depth 0 and no text stands for each conversation itself.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", h.alias("h"), base.alias("base"), "n")
    heads = turns.filter("place <= 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "place", "role", "text")
    borrowed = sizes.filter("h > 0").join(heads, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "role", "text")
    of_base = sizes.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    start = sizes.join(of_base, "base", "left").select(F.col("conv_id").alias("own"), "h", (F.least("h", F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.join(start, F.col("conv_id") == F.col("own")).filter("place > h").select("conv_id", (F.col("place") + F.col("shift")).alias("depth"), "role", "text")
    here = sizes.select("conv_id", F.lit(0).alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    whole = borrowed.union(own).union(here)
    return whole.select("conv_id", F.col("depth").cast("int").alias("depth"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, chars) of turns (conv_id, depth, role, text), depth 0 included: the digest of all turns up to each and the turn's code points."""
    marks = [F.xxhash64(F.lit(seed), "depth", F.length("role"), "role", "text").alias(f"m{seed}") for seed in (1, 2)]
    marked = turns.select("conv_id", "depth", *marks, F.char_length("text").cast("long").alias("chars"))
    return running(marked, ["conv_id"], ["depth"], xors={"p1": F.col("m1"), "p2": F.col("m2")}).select("conv_id", "depth", "p1", "p2", "chars")


def minima(prefix: DataFrame) -> DataFrame:
    """(depth, p1, p2, owner, n_convs) of each prefix."""
    return prefix.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"))


def owners_at(rows: DataFrame, depth: Column, prefix: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with a conv_id, and the owner and n_convs of their prefix at a depth that they have."""
    marks = prefix.select(F.col("conv_id").alias("__c"), F.col("depth").alias("__d"), "p1", "p2")
    found = rows.join(marks, (F.col("conv_id") == F.col("__c")) & (depth == F.col("__d")))
    known = least.select(F.col("depth").alias("__e"), F.col("p1").alias("__p1"), F.col("p2").alias("__p2"), "owner", "n_convs")
    same = (F.col("__d") == F.col("__e")) & (F.col("p1") == F.col("__p1")) & (F.col("p2") == F.col("__p2"))
    return found.join(known, same).drop("__c", "__d", "__e", "p1", "p2", "__p1", "__p2")


def first_owned(prefix: DataFrame, least: DataFrame) -> DataFrame:
    """(conv_id, first, n): the first depth that each conversation owns, n + 1 if it owns none of its n turns' prefixes."""
    at = prefix.groupBy("conv_id").agg(F.max("depth").alias("n")).select("conv_id", "n", F.lit(0).alias("low"), (F.col("n") + 1).alias("high"))
    at = materialize(at, "search")
    while True:
        open_ = at.filter("low < high").withColumn("mid", F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
        if open_.isEmpty():
            return at.select("conv_id", F.col("low").alias("first"), "n")
        probed = owners_at(open_, F.col("mid"), prefix, least)
        owned = F.col("owner") == F.col("conv_id")
        moved = probed.select("conv_id", "n", F.when(owned, F.col("low")).otherwise(F.col("mid") + 1).alias("low"), F.when(owned, F.col("mid")).otherwise(F.col("high")).alias("high"))
        nxt = materialize(moved.union(at.filter("low >= high")), "search")
        discard(at)
        at = nxt


def member_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of rows (owner, depth, conv_id): SHA-256 of the ids in order, comma-joined.

    Ids are sorted by range, so that the many of one node are spread; runs of them become text, and only text, in order, meets in the task that
    hashes a node, as SHA-256 has no other way. No list is held whole.
    """
    runs = ends.repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({"owner": [node[0]], "depth": [node[1]], "first": [ids[0]], "piece": [",".join(map(str, ids))]}, schema=PIECES)

        for batch in batches:
            for o, d, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (o, d) != node or len(ids) == PIECE:
                    if ids:
                        yield piece()
                    node, ids = (o, d), []
                ids.append(c)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = h = None

        def result():
            return pa.RecordBatch.from_pydict({"owner": [node[0]], "depth": [node[1]], "ends_sha256": [h.hexdigest()]}, schema=DIGESTS)

        for batch in batches:
            for at in range(batch.num_rows):
                o, d, _, text = (batch.column(k)[at].as_py() for k in range(4))
                if (o, d) == node:
                    h.update(b",")
                else:
                    if node:
                        yield result()
                    node, h = (o, d), hashlib.sha256()
                h.update(text.encode())
        if node:
            yield result()

    text = runs.mapInArrow(pieces, "owner long, depth int, first long, piece string")
    return text.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashed, "owner long, depth int, ends_sha256 string")


PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int32()), ("first", pa.int64()), ("piece", pa.string())])
DIGESTS = pa.schema([("owner", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())])


def chain_totals(chains: DataFrame) -> DataFrame:
    """(top, leaves, saved) of each chain with all that hangs on it, from chains (top, host, leaves, saved): ``host`` is the chain that a chain hangs on, null at the root.

    Bottom-up: a round closes the chains without open children and adds them to what they hang on. Chains hang at ever greater
    depths, so there are no more rounds than turns in the longest conversation; each closes all leaves of the tree of chains, and rows that are closed are in no later round.
    """
    pending = chains.filter("host is not null").groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("pending"))
    open_ = chains.join(pending, F.col("top") == F.col("__host"), "left").select("top", "host", "leaves", "saved", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"))
    open_, closed = materialize(open_, "chains"), []
    while not open_.isEmpty():
        ready = materialize(open_.filter("pending = 0").drop("pending"), "closed")
        closed.append(ready)
        given = ready.filter("host is not null").groupBy(F.col("host").alias("__host")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"), F.count(F.lit(1)).alias("__n"))
        rest = open_.filter("pending > 0").join(given, F.col("top") == F.col("__host"), "left")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        nxt = materialize(rest.select("top", "host", more("leaves", "__l"), more("saved", "__s"), (F.col("pending") - F.coalesce("__n", F.lit(0))).alias("pending")), "chains")
        discard(open_)
        open_ = nxt
    out = open_.select("top", "leaves", "saved")
    for part in closed:
        out = out.union(part.select("top", "leaves", "saved"))
    return out


def trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of turns (conv_id, depth, role, text), depth 0 for each conversation itself; see ``prefix_trie`` for the columns."""
    prefix = materialize(prefixes(turns), "prefixes")
    least = materialize(minima(prefix), "minima")
    first = materialize(first_owned(prefix, least), "owned")

    # What a chain hangs on is the owner of the prefix one turn shorter.
    tops = first.filter("first <= n").select("conv_id", "first", "n")
    hung = owners_at(tops.filter("first > 0"), F.col("first") - 1, prefix, least).select("conv_id", "first", "n", F.col("owner").alias("host"))
    hung = materialize(hung.union(tops.filter("first = 0").withColumn("host", F.lit(None).cast("long"))), "hung")

    spans = hung.select(F.col("conv_id").alias("__top"), "first", "n", "host")
    own = prefix.join(spans, F.col("conv_id") == F.col("__top")).filter("depth >= first")
    sizes = least.select(F.col("owner").alias("__o"), F.col("depth").alias("__d"), "n_convs")
    own = own.join(sizes, (F.col("conv_id") == F.col("__o")) & (F.col("depth") == F.col("__d")))
    children = hung.filter("host is not null").groupBy(F.col("host").alias("__host"), (F.col("first") - 1).alias("__at")).agg(F.count(F.lit(1)).alias("attached"))
    own = own.join(children, (F.col("conv_id") == F.col("__host")) & (F.col("depth") == F.col("__at")), "left")
    n_children = F.coalesce("attached", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("host"))
    nodes = own.select("conv_id", "depth", parent.alias("parent_conv_id"), "host", "n_convs", n_children.alias("n_children"), (n_children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = materialize(nodes, "nodes")

    chains = nodes.groupBy(F.col("conv_id").alias("top")).agg(F.min("host").alias("host"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    totals = chain_totals(chains)
    joined = hung.filter("host is not null").join(totals, F.col("conv_id") == F.col("top"))
    given = joined.groupBy(F.col("host").alias("__host"), (F.col("first") - 1).alias("__at")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
    hosted = nodes.join(given, (F.col("conv_id") == F.col("__host")) & (F.col("depth") == F.col("__at")), "left").withColumn("__up", -F.col("depth"))
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    out = running(hosted, ["conv_id"], ["__up"], sums={"n_leaves": total("leaf", "__l"), "saved_tokens": total("saved", "__s")})

    ended = owners_at(first.select("conv_id", "n"), F.col("n"), prefix, least).select("owner", F.col("n").alias("depth"), "conv_id")
    marks = member_digests(ended).select(F.col("owner").alias("__e"), F.col("depth").alias("__at_end"), "ends_sha256")
    out = out.join(marks, (F.col("conv_id") == F.col("__e")) & (F.col("depth") == F.col("__at_end")), "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of the first d rebuilt turns of a conversation, from the root (d = 0) on.

    conv_id is the smallest member, parent_conv_id that of the parent, n_convs the members, n_children the children; n_leaves and saved_tokens are
    summed over the subtree (childless nodes; other members times the code points of the last text); ends_sha256 is of the members that end here.
    """
    return trie(rebuilt(materialize(ordered_turns(conversations), "turns")))
