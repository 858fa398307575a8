"""Reads of a pipe: chunks of any size, in stretches that are dealt out."""

from pyspark.sql import functions as F

from tracelens.operators import windows


def test_reads_of_all_chunks(spark):
    rows = [(i, n) for i, n in enumerate([None, 0, 1, 2, 6, 7, 8, 20, 21, 22, 63, 64, 500])]
    got = sorted(tuple(r) for r in windows.drained(spark.createDataFrame(rows, "id long, size long"), "size", 7, 3).select("id", "read", "n_bytes").collect())
    assert got == [(i, k, min(7, n - 7 * k)) for i, n in rows if n for k in range(-(-n // 7))]


def test_a_large_chunk_is_no_list_and_no_task(spark):
    """More reads than an array holds, and one chunk among small ones that many tasks share."""
    huge = spark.createDataFrame([(1, 4096 * (2**31 + 1))], "id long, size long")
    assert [r.n_bytes for r in windows.drained(huge, "size").limit(3).collect()] == [4096] * 3
    chunks = spark.createDataFrame([(1, 4096 * 400_000 - 1), (2, 5), (3, 9)], "id long, size long").coalesce(1)
    found = windows.drained(chunks, "size").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).collect()
    assert sum(r.n for r in found) == 400_002 and sum(r.b for r in found) == 4096 * 400_000 + 13
    assert max(r.n for r in found) < 100_000


def shuffled(spark):
    """Rows written by all shuffles of the session so far."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_is_shuffled_grows_with_the_chunks(spark):
    """Large chunks throughout are dealt out whole; one among small ones still is not."""
    for sizes in ([100 + i % 50 for i in range(3000)], [5] * 2000 + [90_000]):
        chunks = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").coalesce(2)
        before = shuffled(spark)
        found = windows.drained(chunks, "size", 1, 2).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.sum(F.col("read") + 1).alias("r")).collect()
        assert sum(r.n for r in found) == sum(r.b for r in found) == sum(sizes) and sum(r.r for r in found) == sum(n * (n + 1) // 2 for n in sizes)
        assert shuffled(spark) - before < len(sizes) + 16 * 32 + 100
        assert max(r.n for r in found) < sum(sizes) / 8
