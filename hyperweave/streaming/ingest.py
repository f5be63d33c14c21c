"""Facts from a stream: each micro-batch is appended to a log, and the cycles that it closes along transitive templates are reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.search import IT, eval_, find, phrase, rel
from ..operators.transitive import recheck_cycles
from ..sources.facts import load, load_rows
from ..sources.log import SpaceLog
from ..sources.space import Space


def new_cycles(space: Space, new: DataFrame) -> DataFrame:
    """(tplt, start, path): the cycles through the left members of these relationships (rows of expr) of transitive templates.

    A cycle that was not there before goes through a new relationship, so only what these lead to and what leads to them is walked.
    """
    declared = find(space, eval_(rel("_ is _", IT, phrase("transitive")))).withColumnRenamed("addr", "tplt")
    fresh = new.where("kind = 'rel' AND arity = 2").join(declared, "tplt", "left_semi")
    return recheck_cycles(space, fresh.select("tplt", F.get("members", F.lit(0)).alias("addr")).distinct())


def load_reporting_cycles(space: Space, df: DataFrame, pattern, order: Column | None = None) -> tuple[Space, DataFrame, DataFrame]:
    """As facts.load, and (tplt, start, path) of the cycles through the left members of the new transitive relationships."""
    new, report = load(space, df, pattern, order)
    return new, report, new_cycles(new, new.expr.join(report.where("is_new").select("addr"), "addr", "left_semi"))


def append_facts(log: SpaceLog, df: DataFrame, pattern, batch: str, order: Column | None = None) -> DataFrame | None:
    """The rows that these statements add to the log, written as one segment; None if the batch was there already.

    Of what is in the log, keys and addresses are read, to find what the statements share with it; nothing of it is written again.
    """
    if log.has(batch):
        return None
    rows, _ = load_rows(log.space().expr, df, pattern, order, log.next_addr())
    log.append(rows, batch)
    return rows


def ingest_stream(stream: DataFrame, pattern, folder: str, checkpoint: str, on_cycles: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None, name: str | None = None):
    """Starts a streaming query that appends each micro-batch to the log under ``folder``. Returns the StreamingQuery.

    A batch is known by the stream's name (by default its checkpoint folder) and its number: one that is delivered again is passed over.
    Facts that are there already, from whatever stream, are not added twice, because identity is by structure. Streams into one
    folder must run one after the other, as each numbers its rows on from the last. on_cycles gets the cycles that a batch closes.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        log = SpaceLog(df.sparkSession, folder)
        rows = append_facts(log, df, pattern, f"{name or checkpoint}#{epoch}")
        if rows is not None and on_cycles is not None:
            on_cycles(new_cycles(log.space(), rows), epoch)
        log.compact()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_log(space: Space, folder: str) -> SpaceLog:
    """Writes the space that a stream goes on from. Done once: a log that has begun stays as it is."""
    log = SpaceLog(space.spark, folder)
    log.append(space.expr, "start")
    return log
