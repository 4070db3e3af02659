"""A larger shuffle makes more tasks, not larger ones."""

from pyspark.sql import functions as F

from spanledger import configure
from spanledger.session import TASK_BYTES


def test_tasks_of_a_shuffle_are_bounded(spark):
    # Hashes do not compress: some 64 MB are shuffled, more than a task's share for each of the four cores.
    rows = configure(spark).range(4_000_000).select(F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit(1)).alias("value"))
    sizes = rows.repartition("key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("key"), F.max("value")).collect()
    assert sum(r["count"] for r in sizes) == 4_000_000
    # 16 bytes a row; one of the smallest partitions may come on top.
    assert max(r["count"] for r in sizes) * 16 <= TASK_BYTES * 1.2


def test_smaller_bounds_of_the_session_hold(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        for given, held in (("1m", "1m"), ("64MB", f"{TASK_BYTES}b"), ("1g", f"{TASK_BYTES}b")):
            spark.conf.set(name, given)
            configure(spark)
            assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)
