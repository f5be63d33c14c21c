"""The star schema as facts. Phrases are named table:key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.facts import P, R, hashed_space
from ..sources.space import Space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(kind: str, key: str | Column) -> P:
    return P(F.concat(F.lit(f"{kind}:"), F.col(key) if isinstance(key, str) else key))


def nation_in_region(spark: SparkSession, d: str):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey), R("_ in _", F.col("n_name"), F.col("r_name"))


def customer_in_nation(spark: SparkSession, d: str):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name"), R("_ in _", named("customer", "c_custkey"), F.col("n_name"))


def supplier_in_nation(spark: SparkSession, d: str):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name"), R("_ in _", named("supplier", "s_suppkey"), F.col("n_name"))


def order_placed_by(spark: SparkSession, d: str):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey"), R("_ placed by _", named("order", "o_orderkey"), named("customer", "o_custkey"))


def order_contains(spark: SparkSession, d: str):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return rows, R("_ contains _ from _", named("order", "l_orderkey"), named("part", "l_partkey"), named("supplier", "l_suppkey"))


def placed_on(spark: SparkSession, d: str):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows, R("_ on _", R("_ placed by _", named("order", "o_orderkey"), named("customer", "o_custkey")), F.col("day"))


def supplies(spark: SparkSession, d: str):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return rows, R("_ supplies _", named("supplier", "l_suppkey"), named("part", "l_partkey"))


def precedes(spark: SparkSession, d: str):
    turn = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    rows = turn.withColumn("next", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL")
    at = lambda c: named("conv", F.concat("conv_id", F.lit("/"), c))
    return rows, R("_ precedes _", at("turn"), at("next"))


def did(spark: SparkSession, d: str):
    return table(spark, d, "events").select("user_id", "event_type").distinct(), R("_ did _", named("user", "user_id"), F.col("event_type"))


def declared(spark: SparkSession, *templates: str):
    """``(template) is transitive`` for each of the templates."""
    from ..sources.facts import T

    one = spark.range(1)
    return [(one, R("_ is _", T(t), F.lit("transitive"))) for t in templates]


def places(spark: SparkSession, d: str) -> Space:
    return hashed_space(nation_in_region(spark, d), customer_in_nation(spark, d), supplier_in_nation(spark, d))
