from gleaner.llm.common import bounded_sample, materialize, scratch
from pyspark.sql import functions as F


def there(spark, df):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._gleaner_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_scratch_discards_what_is_not_kept(spark):
    with scratch():
        with scratch():
            a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b", keep=True)
            assert there(spark, a)
        assert not there(spark, a) and b.count() == 4
    assert not there(spark, b)
    c = materialize(spark.range(5), "c", keep=True)
    assert c.count() == 5


def test_sample_keeps_to_its_bounds(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    size = lambda df: df.agg(F.sum(F.length("text")), F.count("*")).first()
    every = size(rows)
    assert size(bounded_sample(rows, "doc_id", F.lit(1.0), 1 << 20)) == every
    total, n = size(bounded_sample(rows, "doc_id", F.lit(1.0), 20_000))
    assert 15_000 < total <= 20_000 and n < 1100
    assert size(bounded_sample(rows, "doc_id", F.lit(0.1), 1 << 20))[1] < 600
