"""How filters act together: a Gray-code walk over all sets of filters.

Documents fall into cells by the set of filters that they fail (a mask); a part has at most 2^k of them, whatever its
number of documents. The walk visits the 2^k sets of active filters so that each differs from the one before by one
filter. Every cell keeps a counter of its failures among the active ones; when a counter leaves or reaches zero, the cell's
documents leave or rejoin the running survivors. The survivors of each set are stored, and whatever is asked of an order
of filters is a difference between two stored states.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Most filters: 2^16 states of a part are held at once.
MOST_FILTERS = 16
#: Rows without an id are dealt to so many places of the join with the labels.
SALT = 64


def states(masks: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every set of active filters: (2^k, measures). masks: of each cell; sizes: (cells, measures)."""
    out = np.zeros((1 << k, sizes.shape[1]), np.int64)
    active, failures, alive = 0, np.zeros(len(masks), np.int64), sizes.sum(0)
    out[0] = alive
    touched = [np.flatnonzero(masks >> f & 1) for f in range(k)]
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1  # the filter that the Gray code toggles
        cells, on = touched[f], not active >> f & 1
        active ^= 1 << f
        if on:
            alive = alive - sizes[cells[failures[cells] == 0]].sum(0)
            failures[cells] += 1
        else:
            failures[cells] -= 1
            alive = alive + sizes[cells[failures[cells] == 0]].sum(0)
        out[active] = alive
    return out


def over_all_orders(kept: np.ndarray, k: int) -> list[int]:
    """What each filter removes, summed over all k! orders. kept: survivors of every set (one measure)."""
    sets = np.arange(1 << k)
    size = np.array([bin(s).count("1") for s in sets])
    weight = np.array([factorial(i) * factorial(k - 1 - i) if i < k else 0 for i in range(k + 1)], object)[size]
    out = []
    for f in range(k):
        without = sets[(sets >> f & 1) == 0]
        out.append(int(((kept[without] - kept[without | 1 << f]).astype(object) * weight[without]).sum()))
    return out


def report(part: str, names: str, masks: np.ndarray, sizes: np.ndarray, orders: Iterable[str]) -> pd.DataFrame:
    """Rows of one part. sizes: documents, good ones and toxic ones of each cell."""
    k = len(names)
    at = states(masks, sizes, k)
    every = (1 << k) - 1
    fails = at[0, 0] - at[[1 << f for f in range(k)], 0]
    unique = at[[every ^ 1 << f for f in range(k)], 0] - at[every, 0]
    shapley = over_all_orders(at[:, 0], k)
    rows = []
    for order in orders:
        active = 0
        for step, name in enumerate(order, 1):
            f = names.index(name)
            before, active = active, active | 1 << f
            gone = at[before] - at[active]
            rows.append((part, order, step, at[active, 0], gone[0], fails[f] - gone[0], unique[f], gone[1], gone[2], shapley[f]))
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(cells: DataFrame, names: str, orders: Iterable[str] | None = None) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    cells (part, mask, n, good, toxic): documents by the filters that they fail; bit i of the mask is names[i]; one letter a
    filter. Rows of one part and mask are added up, so a group has at most 2^k rows. Null parts are the part "". orders: all
    by default; each may leave filters out. An empty table has no rows.
    """
    if len(names) > MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"between 1 and {MOST_FILTERS} different letters, one for each filter")
    asked = ["".join(p) for p in permutations(names)] if orders is None else list(orders)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return report(key[0], names, rows["mask"].to_numpy(np.int64), rows[["n", "good", "toxic"]].to_numpy(np.int64), asked)

    added = cells.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return added.groupBy("part").applyInPandas(walk, _REPORT)


def text_failures() -> dict[str, Column]:
    """The failure conditions on a whole text ``body`` and its ``words``, by letter: few words, few distinct words, capitals, symbols."""
    words = F.col("words")
    capitals = F.length("body") - F.length(F.regexp_replace("body", "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length("body"),
        "D": F.col("body").rlike("[#$%&*|]"),
    }


def _bits(failures: Iterable[Column]) -> Column:
    out = F.lit(0)
    for i, fails in enumerate(failures):
        out = out + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("int")


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of documents (doc_id, text, source) for the filters ABCDE.

    E fails where a smaller doc_id has the identical text, in any part; rows of one doc_id do not fail by each other, and a row
    without doc_id neither fails E nor makes others fail. Null texts are empty ones, null sources the part "". A document is
    good or toxic if any of its label rows says so. Texts are read once and leave the scan as SHA-256 digests; copies are
    added up by text and part before they meet, so that a text of very many copies is a few rows.
    """
    body = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    words = F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), "")
    told = body.withColumn("words", words).select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("same"), _bits(text_failures().values()).alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("same"), F.lit(SALT))).otherwise(F.lit(0))
    marked = told.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").fillna(0, ["good", "toxic"])
    rows = marked.groupBy("doc_id", "salt", "same", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    # Of the rows of one text in a part: how many there are, and those of the least doc_id. Null ids are kept apart.
    alike = rows.groupBy("same", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = alike.groupBy("same").agg(F.min("least.doc_id").alias("first"))
    held = alike.join(first, "same")
    passing = F.when(F.col("nameless"), F.col("n")).when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.lit(0).alias("bit"), passing.alias("n")), F.struct(F.lit(16).alias("bit"), (F.col("n") - passing).alias("n")))
    cells = held.select("part", "mask", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    mask = F.col("mask") + F.col("x.bit")
    return cells.groupBy("part", mask.alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(document_cells(docs, read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "ABCDE")


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
body AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
         + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS INT) + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS INT) AS mask
  FROM body LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, f, bit, CAST((SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE instr(filter_order, x.f) < step) AS INT) AS before
  FROM orders, range(1, 6) t(step), letters WHERE f = substr(filter_order, CAST(step AS INT), 1)),
rows_ AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM rows_
"""
}
