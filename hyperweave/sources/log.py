"""A space kept in a folder as an append-only log: segments of rows, and a manifest that names them.

Adding facts writes one segment with the new rows alone and then one line of the manifest; a segment that no line names does not
count, so a load that breaks off leaves nothing behind, and a batch that is already named changes nothing. Segments of like
size are merged into one of the next level once there are FAN of them, so each row is rewritten a number of times that grows with
the logarithm of the log.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .space import EXPR, Space

#: Segments of one level that are merged into one of the next.
FAN = 8

_LINE = "batch string, path string, level int, n long, top long, replaces array<string>"


class SpaceLog:
    """The log in one folder. Lines of the manifest are few (a handful for each batch that is not merged yet) and are read by the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def lines(self) -> list[Row]:
        found = self.spark.createDataFrame([], _LINE)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        if path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            found = self.spark.read.schema(_LINE).json(f"{self.folder}/manifest")
        return found.collect()

    def live(self) -> list[Row]:
        """The segments that make up the space."""
        lines = self.lines()
        gone = {p for x in lines for p in x["replaces"] or []}
        return [x for x in lines if x["path"] and x["path"] not in gone]

    def has(self, batch: str) -> bool:
        return any(x["batch"] == batch for x in self.lines())

    def space(self, strict: bool = False) -> Space:
        paths = sorted(x["path"] for x in self.live())
        expr = self.spark.read.schema(EXPR).parquet(*paths) if paths else self.spark.createDataFrame([], EXPR)
        return Space(expr, strict=strict)

    def next_addr(self) -> int:
        """The first free address; known from the manifest, without a look at the rows."""
        return max((x["top"] for x in self.lines() if x["top"] is not None), default=-1) + 1

    def _written(self, rows: DataFrame) -> str:
        path = f"{self.folder}/segments/{uuid.uuid4().hex}"
        rows.select(*(c.split()[0] for c in EXPR.split(", "))).sort("key").write.parquet(path)  # near keys lie in few row groups
        return path

    def _told(self, *line) -> None:
        self.spark.createDataFrame([line], _LINE).coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Adds rows of the expr schema under the name of their batch; False, and nothing is done, if that is there already."""
        if self.has(batch):
            return False
        size = rows.agg(F.count("*").alias("n"), F.max("addr").alias("top")).first()
        self._told(batch, self._written(rows) if size["n"] else None, 0, size["n"], size["top"], [])
        return True

    def compact(self, fan: int = FAN) -> None:
        """Merges segments while any level has ``fan`` of them. Old segments stay on disk for readers that began before."""
        while True:
            levels: dict[int, list[Row]] = {}
            for x in self.live():
                levels.setdefault(x["level"], []).append(x)
            full = next((k for k in sorted(levels) if len(levels[k]) >= fan), None)
            if full is None:
                return
            old = levels[full]
            rows = self.spark.read.schema(EXPR).parquet(*(x["path"] for x in old))
            self._told(None, self._written(rows), full + 1, sum(x["n"] for x in old), reduce(max, (x["top"] for x in old)), [x["path"] for x in old])
