"""Benchmark cases: loading, scoring of what was extracted and packed, rollup, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "array<string>"
REQUEST = f"struct<question:string,goal:string,project:string,workspace_root:string,paths:{_LIST},session_id:string,limit_tokens:int>"
ASK = f"struct<name:string,request:{REQUEST},must_include_types:{_LIST},must_include_substrings:{_LIST},must_not_include_substrings:{_LIST},must_warn:string,must_not_warn:boolean,must_be_empty:boolean,first_must_not_contain:string>"
WRITE = f"struct<min_extracted:int,must_extract_types:{_LIST},must_extract_substrings:{_LIST},must_not_extract_substrings:{_LIST}>"
CASES = f"id string, project string, now string, sessions array<struct<harness:string,session_id:string,file:string,source:string>>, seed array<struct<type:string,text:string,paths:{_LIST},created_at:string,harness:string>>, write {WRITE}, asks array<{ASK}>"


def load_cases(spark: SparkSession, root: str) -> DataFrame:
    """One row for each case file."""
    return spark.read.schema(CASES).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)


def _list(c) -> Column:
    return F.coalesce(c, F.array().cast(_LIST))


def _notes(items: Column, bad, label: str) -> Column:
    return F.transform(F.filter(_list(items), bad), lambda s: F.concat(F.lit(f"{label} "), s))


def write_scores(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, errors, write_ok): a case's expectations against (case_id, type, text) claims."""
    got = claims.groupBy(F.col("case_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types"), F.array_join(F.collect_list("text"), "\n").alias("blob"))
    j = cases.select("id", "write").join(got, "id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "types": _list(F.col("types")), "blob": F.coalesce("blob", F.lit(""))})
    few = F.when(F.coalesce(F.col("write.min_extracted"), F.lit(0)) > F.col("n"), F.array(F.format_string("extracted %d want >= %d", "n", "write.min_extracted"))).otherwise(F.array().cast(_LIST))
    errors = F.concat(
        few,
        _notes(F.col("write.must_extract_types"), lambda s: ~F.array_contains("types", s), "missing extracted type"),
        _notes(F.col("write.must_extract_substrings"), lambda s: ~F.contains(F.col("blob"), s), "extract missing"),
        _notes(F.col("write.must_not_extract_substrings"), lambda s: F.contains(F.col("blob"), s), "extract leaked"),
    )
    return j.select("id", errors.alias("errors")).withColumn("write_ok", F.size("errors") == 0)


def ask_scores(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, name, needles, hit, errors, recall) of each ask against (case_id, name, rank, type, text, warning) hits."""
    got = hits.groupBy(F.col("case_id").alias("id"), "name").agg(F.sort_array(F.collect_list(F.struct("rank", "type", "text"))).alias("ctx"), F.collect_set("warning").alias("warnings"))
    asks = cases.select("id", F.explode("asks").alias("a")).select("id", F.col("a.name").alias("name"), "a")
    j = asks.join(got, ["id", "name"], "left").withColumn("warnings", _list(F.col("warnings"))).withColumn("texts", _list(F.transform("ctx", lambda h: h["text"]))).withColumn("types", _list(F.transform("ctx", lambda h: h["type"])))
    blob = F.array_join("texts", "\n")
    missing = F.concat(_notes(F.col("a.must_include_substrings"), lambda s: ~F.contains(blob, s), "missing"), _notes(F.col("a.must_include_types"), lambda s: ~F.array_contains("types", s), "missing type"))
    empty_wanted, warn = F.coalesce(F.col("a.must_be_empty"), F.lit(False)), F.coalesce(F.col("a.must_warn"), F.lit(""))
    is_empty = (F.size("texts") == 0) & (F.size("warnings") == 0)
    warned = F.exists("warnings", lambda w: F.contains(F.lower(w), warn))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast(_LIST))
    first = F.coalesce(F.get("texts", F.lit(0)), F.lit(""))
    bad_first = (F.coalesce(F.col("a.first_must_not_contain"), F.lit("")) != "") & F.contains(first, F.col("a.first_must_not_contain"))
    counted = F.concat(missing, one(empty_wanted & ~is_empty, F.lit("want empty packet")), one((warn != "") & ~warned, F.concat(F.lit("missing warning "), warn)))
    others = F.concat(_notes(F.col("a.must_not_include_substrings"), lambda s: F.contains(blob, s), "unexpected"), one(bad_first, F.concat(F.lit("first hit contains "), F.col("a.first_must_not_contain"))), one(F.coalesce(F.col("a.must_not_warn"), F.lit(False)) & (F.size("warnings") > 0), F.lit("unexpected warnings")))
    needles = F.size(_list(F.col("a.must_include_substrings"))) + F.size(_list(F.col("a.must_include_types"))) + empty_wanted.cast("int") + (warn != "").cast("int")
    j = j.withColumns({"needles": needles, "_lost": F.size(counted), "errors": F.concat(counted, others)})
    recall = F.when(F.col("needles") > 0, (F.col("needles") - F.col("_lost")) / F.col("needles")).otherwise((F.size("errors") == 0).cast("double"))
    return j.select("id", "name", "needles", (F.col("needles") - F.col("_lost")).alias("hit"), "errors", recall.alias("recall"))


def rollup(cases: DataFrame, writes: DataFrame, asks: DataFrame) -> DataFrame:
    """(id, write_ok, asks, ask_pass, recall, notes) of each case."""
    per = asks.groupBy("id").agg(F.count(F.lit(1)).alias("asks"), F.count_if(F.size("errors") == 0).alias("ask_pass"), F.avg("recall").alias("recall"), F.sort_array(F.collect_list(F.when(F.size("errors") > 0, F.concat(F.col("name"), F.lit(": "), F.array_join("errors", ", "))))).alias("n"))
    j = cases.select("id").join(writes, "id", "left").join(per, "id", "left")
    return j.select("id", F.coalesce("write_ok", F.lit(True)).alias("write_ok"), F.coalesce("asks", F.lit(0)).alias("asks"), F.coalesce("ask_pass", F.lit(0)).alias("ask_pass"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.array_join(F.concat(_list(F.col("errors")), _list(F.col("n"))), "; ").alias("notes"))


def report(rolled: DataFrame) -> DataFrame:
    """A line of text for each case, and the mean."""
    ok = F.when(F.col("write_ok"), "ok").otherwise("FAIL")
    lines = rolled.select(F.col("id").alias("key"), F.format_string("%-32s %-6s %3d/%-3d %6.2f  %s", "id", ok, "ask_pass", "asks", "recall", "notes").alias("line"))
    passed = F.count_if(F.col("write_ok") & (F.col("ask_pass") == F.col("asks")))
    total = rolled.agg(F.format_string("%d/%d cases pass, mean recall %.2f", passed, F.count(F.lit(1)), F.avg("recall")).alias("line"))
    return lines.unionByName(total.select(F.lit("~").alias("key"), "line")).orderBy("key").select("line")
