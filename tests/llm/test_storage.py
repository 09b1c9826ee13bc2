import glob

from factlane.llm import storage as S


def test_tables_in_the_shared_folder(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    plain, bucketed = S.stored(df, "plain"), S.stored_buckets(df, "bucketed", "k", 2)
    assert plain.count() == bucketed.count() == 10 and plain.dtypes == df.dtypes
    assert S.stored(df.limit(0), "empty").count() == 0
    base = S.shared_dir(spark)
    assert base.startswith("file:///") and glob.glob(base[7:] + "/factlane/plain-*")
    assert "Exchange" not in bucketed.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    S.clean(spark)
    assert not glob.glob(base[7:] + "/factlane/plain-*")


class Unset:
    """A session whose setting is absent or bare."""

    def __init__(self, spark, value=None):
        self.spark, self.value = spark, value
        self.conf = self

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else self.spark.conf.get(key, default)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_setting_is_absent_or_bare(spark):
    assert S.shared_dir(Unset(spark, "/tmp/bare")) == "file:///tmp/bare"
    own = S.shared_dir(Unset(spark))
    assert own.startswith("file:///") and S.shared_dir(Unset(spark)) == own
