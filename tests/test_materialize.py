import time

from pyspark.sql import functions as F

from passagework import session


def test_what_is_written_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}
    had = held()
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    made = session.materialize(df.join(spark.range(100).select(F.col("id").alias("k")).hint("merge"), "k"), "sums")
    for _ in range(40):
        if not (held() - had):
            break
        time.sleep(0.25)
    assert not held() - had
    assert spark.conf.get(session.SHUFFLES_END, None) is None
    # A frame that was written may be written again.
    assert made.count() == 100 == session.materialize(df, "again").count() == df.count()
