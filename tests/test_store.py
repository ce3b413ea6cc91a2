import pytest
from pyspark.sql import functions as F

from murmur.session import scratch_path
from murmur.sources.store import load_table, open_evidence, save_evidence, save_table


def test_replacing_a_table(spark):
    path = scratch_path(spark, "store-test")
    with pytest.raises(ValueError):
        load_table(spark, path)
    save_table(spark.range(3), path)
    before = load_table(spark, path)
    save_table(before.select((F.col("id") + 10).alias("id")), path)          # read, change, write back
    assert sorted(r.id for r in load_table(spark, path).collect()) == [10, 11, 12]
    assert before.count() == 3                                               # a reader of the version before
    with pytest.raises(Exception):
        save_table(load_table(spark, path).withColumn("id", F.raise_error(F.lit("no")).cast("long")), path)
    assert sorted(r.id for r in load_table(spark, path).collect()) == [10, 11, 12]
    save_table(spark.range(1), path)
    assert load_table(spark, path).count() == 1


def test_one_insight_reads_its_folder(spark):
    path = scratch_path(spark, "evidence-test")
    rows = spark.range(5000).select((F.col("id") % 40).cast("int").alias("cluster"), F.col("id").alias("pos"),
                                    F.lit("t").alias("text"))
    save_evidence(rows, path, buckets=16)
    one = open_evidence(spark, path, 7)
    assert sorted(r.pos for r in one.collect()) == [i for i in range(5000) if i % 40 == 7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    files = one.select(F.input_file_name().alias("f")).distinct().count()
    assert files < open_evidence(spark, path).select(F.input_file_name().alias("f")).distinct().count() / 4
    assert open_evidence(spark, path).count() == 5000 and open_evidence(spark, path, 99).count() == 0
