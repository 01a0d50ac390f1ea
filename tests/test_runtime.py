from pyspark.sql import functions as F

from weftline.plans import runtime


def test_hot_keys_and_salted_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "id long, k string")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = runtime.hot_keys(sizes, "k", "n")
    assert hot == ["hot"]
    right = sizes.filter("k <> 'k0'").select("k", F.length("k").alias("v"))
    plain = sorted(map(tuple, left.join(right, "k").select("id", "v").collect()))
    assert sorted(map(tuple, runtime.salted_join(left, right, "k", F.col("id"), hot).select("id", "v").collect())) == plain
    assert runtime.salted_join(left, right, "k", F.col("id"), hot, "left").count() == 300
    assert runtime.hot_keys(sizes.limit(0), "k", "n") == []


def test_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert sorted(map(tuple, runtime.cut(df).collect())) == [(i, 2 * i) for i in range(10)]
    assert "LogicalRDD" in runtime.cut(df)._jdf.queryExecution().logical().toString()


def test_a_cluster_needs_a_shared_folder():
    assert all(runtime.is_local(m) for m in ("local", "local[8]", "local[*]", "local[4,2]"))
    assert not any(runtime.is_local(m) for m in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn", None))
