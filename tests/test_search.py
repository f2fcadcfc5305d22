"""A term that many records share."""

from pyspark.sql import functions as F

from worklode.plans import index as I


def test_search_sends_the_requests_to_the_terms(spark):
    """A join by term put all records of a term into one task, and gave hits of other projects to be dropped later."""
    t = spark.range(1000).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("project_key"), F.when(F.col("id") >= 0, "hot").otherwise("cold").alias("term"), F.lit(1).alias("tf"), F.lit(9).alias("doc_len"))
    asked = spark.createDataFrame([("r", "p1", "hot"), ("s", "p2", "hot"), ("s", "p2", "cold")], "request_id string, project_key string, term string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = I.search(asked, t, 1000, 9.0)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
        got = hits.groupBy("request_id", "project_key").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    every = I.search(asked.drop("project_key"), t, 1000, 9.0)
    assert sorted(map(tuple, got)) == [("r", "p1", 250), ("s", "p2", 250)] and every.count() == 2000
    assert {r.bm25 for r in hits.collect()} == {r.bm25 for r in every.collect()}, "documents of all projects count"
