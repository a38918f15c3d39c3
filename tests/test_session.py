from pyspark.sql import functions as F

from affectlake.session import spread


def test_rows_in_few_splits_are_spread(spark, tmp_path):
    """One row group is read by one task, whatever the number of splits."""
    path = str(tmp_path / "one")
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        out = spread(table, "id")
        counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 20_000 and max(counts) < 10_000
        assert spread(out.limit(0), "id").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_even_splits_stay(spark, tmp_path):
    path = str(tmp_path / "even")
    spark.range(0, 8_000, 1, 8).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        table = spark.read.parquet(path)
        assert spread(table, "id") is table
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
