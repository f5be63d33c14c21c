"""The streaming load, and the driver's entry points."""

from pyspark.sql import functions as F

import __spark_entry__ as driver
from hyperweave.plans.star import declared
from hyperweave.sources.facts import R, load
from hyperweave.sources.log import SpaceLog
from hyperweave.sources.space import empty_space
from hyperweave.streaming.ingest import append_facts, ingest_stream, start_log



def under():
    return R("_ under _", F.col("a"), F.col("b"))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a string, b string")


def test_stream_reports_cycles(spark, tmp_path):
    base = empty_space(spark)
    for df, pattern in declared(spark, "_ under _"):
        base, _ = load(base, df, pattern)
    folder, source = f"file://{tmp_path}/space", f"{tmp_path}/in"
    start_log(base, folder)
    seen = []

    def run(rows):
        pairs(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("a string, b string").parquet(source)
        query = ingest_stream(stream, under(), folder, f"{tmp_path}/checkpoint", lambda cycles, epoch: seen.append(cycles.count()))
        query.awaitTermination(240)
        assert query.exception() is None
        return SpaceLog(spark, folder).space()

    facts = lambda s: s.expr.where("kind = 'rel' AND arity = 2").count()
    assert facts(run([("x", "y"), ("x", "y")])) == 2
    assert facts(run([("y", "x"), ("x", "y")])) == 3
    assert seen == [0, 1]


def test_log_writes_only_what_is_new(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    log = start_log(empty_space(spark), folder)
    append_facts(log, spark.range(3000).select(F.concat(F.lit("p"), "id").alias("a"), F.lit("top").alias("b")), under(), "first")
    before = {x["path"]: x["n"] for x in log.live()}
    rows = append_facts(log, pairs(spark, [("p7", "top"), ("new", "p7"), ("new", "p7")]), under(), "second")
    assert {(r["kind"], r["phrase"]) for r in rows.collect()} == {("phrase", "new"), ("rel", None)}
    after = {x["path"]: x["n"] for x in log.live()}
    assert before.items() <= after.items() and sorted(after.values())[0] == 2
    assert append_facts(log, pairs(spark, [("other", "x")]), under(), "second") is None  # delivered again
    append_facts(log, pairs(spark, [("p7", "top")]), under(), "third")
    assert len(log.live()) == len(after)  # nothing new, no segment
    space = log.space()
    whole = sorted(map(tuple, space.expr.select("addr", "key").collect()))
    assert len({k for _, k in whole}) == len(whole) == 10 + 3 + 3000 * 2 + 2 and [a for a, _ in whole] == list(range(len(whole)))
    log.compact(fan=2)
    assert len(log.live()) < len(after) and sorted(map(tuple, log.space().expr.select("addr", "key").collect())) == whole
    assert not log.append(empty_space(spark).expr, "start")


def test_entry(spark):
    assert driver.entry(spark).count() == 5
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries)
    if driver.llm:
        assert sum(name[:2] == "op" and name[2:3].isdigit() for name in queries) == 13 and "pipeline" in queries
