"""Lines that many documents share: keep bitmaps of each document, all in DataFrame functions.

Hashes of the lines' keys are partitioned by range with a secondary sort by document and position, so first occurrences come in one
stream over a partition. A key that a third of all documents hold is dealt to slots, each a range of its own; only the slots' counts
and largest documents meet.

* A null or empty text is one empty line. Null doc_ids are one document, smaller than any other. Rows of one doc_id are one document,
  whatever their texts; each gets a bitmap of its own.
* Keys are told apart by 128 bits of hash. Keys shorter than ``least_chars`` code points never go.
* Other columns of the input, whatever their names, are not read by ``keep_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped at both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
#: Lines of one word of a bitmap.
BITS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, slot, doc, version, at) of each line whose key is long enough; version tells texts of one doc_id apart, at counts lines from 0."""
    slots = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    bare = rows.select("doc", "version", "at", F.btrim("line", F.lit(BLANK)).alias("bare")).filter(F.char_length("bare") >= least_chars)
    keys = bare.select("doc", "version", "at", F.translate("bare", UPPER, LOWER).alias("key"))
    slot = F.pmod(F.xxhash64("doc"), F.lit(slots)).cast("int")
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), slot.alias("slot"), "doc", "version", "at")


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc, version, n_dropped, words) of each document that loses a line: a key in ``least_docs`` documents or more stays in the largest doc_id alone.

    ``words`` is the bitmap in compressed form: (word, dropped) of each 64 lines, in order, some of which go; bit i of ``dropped`` stands for line
    64 * word + i. Words that keep all their lines are left out, as are documents that lose nothing.
    """
    lines = keyed_lines(docs, least_chars).repartitionByRange("h1", "h2", "slot")
    ahead = Window.partitionBy("h1", "h2", "slot").orderBy(F.col("doc").desc_nulls_last(), "version", "at")
    first = (F.row_number().over(ahead) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(ahead))
    firsts = lines.withColumn("first", first).filter("first")
    shared = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= least_docs)
    # As expressions, so that the join has exchanges of its own on both sides, which adaptive execution can split at a hot key.
    keys = shared.select(F.expr("h1 ^ 0L").alias("k1"), F.expr("h2 ^ 0L").alias("k2"), "last")
    dropped = lines.join(keys, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).filter(~F.col("doc").eqNullSafe(F.col("last")))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % BITS)).alias("dropped")
    words = dropped.groupBy("doc", "version", F.floor(F.col("at") / BITS).cast("int").alias("word")).agg(bits)
    return words.groupBy("doc", "version").agg(F.sum(F.bit_count("dropped")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "dropped"))).alias("words"))


def dense(words: Column) -> Column:
    """All words of a bitmap up to the last that drops a line."""
    def upto(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(words, i - 1)["word"]).otherwise(F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before - 1), F.array(x["dropped"]))

    return F.flatten(F.transform(words, upto))


def deduplicated(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, the lines that the bitmaps keep, joined by \\n.

    Other columns stay; columns of these names, or that begin with __line_, are taken.
    """
    maps = bitmaps.select(F.col("doc").alias("__line_doc"), F.col("version").alias("__line_version"), F.col("n_dropped").alias("__line_dropped"), dense(F.col("words")).alias("__line_bits"))
    same = F.col("doc_id").eqNullSafe(F.col("__line_doc")) & (F.xxhash64("text") == F.col("__line_version"))
    rows = docs.join(maps, same, "left")
    bit = lambda i: F.coalesce(F.call_function("shiftrightunsigned", F.get("__line_bits", F.floor(i / BITS).cast("int")), i % BITS).bitwiseAND(F.lit(1)), F.lit(0).cast("long"))
    left = F.array_join(F.filter(lines_of(F.col("text")), lambda _, i: bit(i) == 0), "\n")
    out = rows.withColumns({
        "n_lines": (F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.coalesce("__line_dropped", F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("__line_bits").isNull(), F.coalesce("text", F.lit(""))).otherwise(left),
    })
    return out.drop(*maps.columns)


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
