from pyspark.sql import functions as F

from palimpsest.session import durable, spread


def test_only_few_partitions_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 2 * cores
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
    shuffled = many.groupBy((F.col("id") % 3).alias("k")).count()
    assert spread(shuffled) is shuffled
    assert spread(one).count() == 100


def test_durable_rows_are_the_rows(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = durable(df)
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
