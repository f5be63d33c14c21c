"""Helpers on DataFrames: cutting lineage in the shared folder, dense numbering, and loops to a fixed point."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new temporary folder (for tests on one machine)."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, which every executor can read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def measured_broadcasts(spark: SparkSession) -> None:
    """From now on joins of the session broadcast a side by its size as measured in a shuffle or by a hint, not by an estimate.

    Estimates go by the size of compressed files and take neither merged nor exploded rows into account: tables of a million phrases
    were broadcast as if they had 10 MB, several at a time. The threshold itself stays what it was.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(limit) != "-1":
        if not spark.conf.get(measured, None):
            spark.conf.set(measured, spark.conf.get(limit))
        spark.conf.set(limit, "-1")


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, but as files with a size of their own: a checkpoint keeps its plan's estimate, which is a product at each join.

    In a loop that joins a table with itself the estimate is squared in each round, so that its digits double and planning takes all the time.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A settled table of a few numeric columns, counted, as a side of a join: broadcast up to BROADCAST_ROWS, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def kept_at(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` with a key of ``wanted``, a settled table of distinct keys alone.

    Few keys are sent to the scans below unions and merges. Many meet all of ``df`` at once: a semi join would go below these as well,
    moving the keys once for each table and rows that are not merged yet.
    """
    few = wanted.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(wanted), key, "left_semi") if few else df.join(wanted, key)


#: From so many pointers on, some nodes are made stops, so that most pointers have a short way; one node in STOPS.
MANY_POINTERS, STOPS = 200_000, 16


def followed(links: DataFrame, compose: Callable[[Callable, Callable], dict], level: int = 0) -> tuple[DataFrame, DataFrame]:
    """links (node, up, ...): each pointer moved on to the first ``up`` that is no node, by doubling: rounds go with the logarithm of the way.

    compose(mine, next) gives the other columns of a pointer that goes on with another one; both are functions from column
    name to Column. Returns the links that have ended, and those that never do, as they lead into a circle.
    Many pointers first go to the next stop alone, where most have come after a few rounds; the stops, which are far fewer, are
    followed by themselves in the same way, and each pointer goes on once with that of its stop. level: how often this was done; stops
    among the stops are chosen by another hash, as by the same one all of them would be stops again.
    """
    links = settled(links)
    if links.count() < MANY_POINTERS:
        return _pointed(links, compose)
    is_stop = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(STOPS)) == 0
    near, circling = _pointed(links.where(~is_stop), compose)
    stops, led = _goes_on(links.where(is_stop), near, circling.select("node"), compose)
    far, round_ = followed(stops, compose, level + 1)
    ended, along = _goes_on(near, far, round_.select("node").union(led.select("node")), compose)
    return far.union(ended), circling.union(led).union(round_).union(along)


def _goes_on(links: DataFrame, on: DataFrame, lost: DataFrame, compose) -> tuple[DataFrame, DataFrame]:
    """Each link moved on once by the links ``on``; and those that lead to a node of ``lost``."""
    on = on.select(*(F.col(c).alias(f"_{c}") for c in on.columns)).withColumn("_lost", F.lit(False))
    nowhere = lost.select(F.col("node").alias("_node"), F.lit(True).alias("_lost"))
    on = on.unionByName(nowhere, allowMissingColumns=True)
    both = settled(links.join(on, links["up"] == on["_node"], "left"))
    goes = F.col("_node").isNotNull()
    new = compose(lambda c: F.col(c), lambda c: F.col(f"_{c}"))
    moved = [F.when(goes, F.col("_up") if c == "up" else new[c]).otherwise(F.col(c)).alias(c) for c in links.columns if c != "node"]
    return both.where("_lost IS NULL OR NOT _lost").select("node", *moved), both.where("_lost").select(*links.columns)


#: Steps that a round makes where all pointers are few, so that it moves nothing but a broadcast.
HOPS = 3


def _pointed(links: DataFrame, compose) -> tuple[DataFrame, DataFrame]:
    """``followed`` by doubling alone. A round joins the pointers that are still on their way with all of them, or, once these are few, with
    those that they lead to. Few pointers made of numbers alone go to every task, and on by HOPS in a round.
    """
    columns = links.columns
    few = all(t in ("bigint", "int") for _, t in links.dtypes) and links.count() < MANY_POINTERS
    ended, at, waiting = links.where(F.lit(False)), links, None
    while True:
        on = ended.union(at).select(*(F.col(c).alias(f"_{c}") for c in columns))
        if few:
            on = F.broadcast(on)
        elif waiting is not None and waiting <= BROADCAST_ROWS:
            on = on.join(F.broadcast(at.select(F.col("up").alias("_node"))), "_node", "left_semi")
        moved = at
        for _ in range(HOPS if few else 1):
            goes = F.col("_node").isNotNull()
            new = compose(lambda c: F.col(c), lambda c: F.col(f"_{c}"))
            steps = [F.col("node") if c == "node" else F.when(goes, F.col("_up") if c == "up" else new[c]).otherwise(F.col(c)).alias(c) for c in columns]
            moved = moved.join(on, F.col("up") == F.col("_node"), "left").select(*steps, goes.alias("_open"))
        told = stored(moved)
        ended, at = ended.union(told.where("NOT _open").drop("_open")), told.where("_open").drop("_open")
        count = at.count()
        if count == 0 or count == waiting:  # a round in which nobody came to an end: all that is left goes in circles
            return ended, at
        waiting = count


def dense_ids(df: DataFrame, order: list[str], out: str, start) -> DataFrame:
    """``df`` with ``out`` = start, start + 1, ... in the given order, without bringing the rows to one task.

    Ranges of the order are numbered on their own, and shifted by the sizes of the ranges before them.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # a row for each range
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    numbered = ranged.join(F.broadcast(shifts), "_part").withColumn(out, local + F.col("_shift") - 1 + F.lit(start))
    return numbered.drop("_part", "_shift")


def grown(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None = None) -> DataFrame:
    """The rows of ``seed`` and all that ``step`` adds to the newest ones, until nothing new comes: semi-naive evaluation.

    Each round is one distributed join against the frontier; rows seen before are dropped by an anti join on ``keys``,
    so cycles end. most: rounds at the most.
    """
    seen = frontier = settled(seed.dropDuplicates(keys))
    rounds = 0
    while (most is None or rounds < most) and not frontier.isEmpty():
        frontier = settled(step(frontier).dropDuplicates(keys).join(seen, keys, "left_anti").select(*seen.columns))
        seen = seen.union(frontier)
        rounds += 1
        if rounds % 10 == 0:
            seen = settled(seen)
    return seen
