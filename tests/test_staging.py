import time

from pyspark.sql import functions as F

from tidemark.sources import staging


def descriptions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_plans_of_writes_are_kept_short(spark):
    before = {key: spark.conf.get(key, None) for key in staging.WRITING}
    rows = spark.range(1000).select("id", *((F.col("id") * k).alias(f"a_rather_long_name_of_a_column_{k}") for k in range(40)))
    joined = rows
    for k in range(4):
        joined = joined.join(rows.groupBy((F.col("id") + k).alias("id")).agg(F.max(f"a_rather_long_name_of_a_column_{k}").alias(f"m{k}")), "id")
    known = len(descriptions(spark))
    assert staged_ids(spark, joined) == list(range(3, 1000))
    new = descriptions(spark)[known:]
    assert max(len(x) for x in new if "parquet" in x.lower()) < 5000
    assert {key: spark.conf.get(key, None) for key in staging.WRITING} == before


def staged_ids(spark, df):
    back = staging.staged(df, "wide")
    assert back.columns == df.columns
    return sorted(r.id for r in back.select("id").collect())


def test_driver_lets_garbage_go(spark):
    jvm = spark.sparkContext._jvm
    now = jvm.java.lang.Runtime.getRuntime()
    held = [jvm.java.nio.ByteBuffer.allocate(64 << 20) for _ in range(4)]
    full = now.totalMemory() - now.freeMemory()
    del held
    for _ in range(20):  # the driver hears of dropped proxies a little later
        staging.release(spark, share=0)
        if full - (now.totalMemory() - now.freeMemory()) > 200 << 20:
            return
        time.sleep(0.5)
    raise AssertionError("the driver's heap is as full as before")
