"""Tables in few pieces are dealt to all cores; others are not shuffled."""

from pyspark.sql import functions as F

from marlstone.sources import pieces


def held(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def shuffled(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.lit("x")).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/one")
    table = spark.read.parquet(f"{tmp_path}/one")
    dealt = pieces.spread(table)
    assert held(table) == 1 and held(dealt) == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, table.collect()))
    plan = dealt.where("id = 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan  # the filter and the columns reach the scan


def test_many_pieces_and_none_stay_as_they_are(spark, tmp_path):
    spark.range(1000).repartition(9).write.parquet(f"{tmp_path}/many")
    many = spark.read.parquet(f"{tmp_path}/many")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file each
    try:
        assert held(many) == 9 and not shuffled(pieces.spread(many))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    empty = many.where("id < 0")
    assert not shuffled(pieces.spread(empty)) and pieces.spread(empty).count() == 0
