"""The algebra of binary relations: distinct pairs (a, b)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def union(*relations: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, relations).distinct()


def intersection(r: DataFrame, s: DataFrame) -> DataFrame:
    return r.intersect(s)


def intersections(*sets: DataFrame) -> DataFrame:
    """What is in all of the sets, as rows of equal columns; at least one set."""
    return reduce(DataFrame.intersect, sets).distinct()


def union_by_key(*maps: DataFrame, key: str = "key", items: str = "items") -> DataFrame:
    """Maps from a key to a set (an array): (key, item), the union of the sets of each key. Null and empty sets add nothing."""
    return reduce(DataFrame.union, (m.select(F.col(key).alias("key"), F.explode(items).alias("item")) for m in maps)).distinct()


def insert(r: DataFrame, pairs: DataFrame) -> DataFrame:
    return union(r, pairs.select("a", "b"))


def delete(r: DataFrame, pairs: DataFrame) -> DataFrame:
    return r.join(pairs, ["a", "b"], "left_anti")


def lookup_dom(r: DataFrame, a) -> DataFrame:
    return r.where(F.col("a") == F.lit(a)).select("b")


def lookup_ran(r: DataFrame, b) -> DataFrame:
    return r.where(F.col("b") == F.lit(b)).select("a")


def member(r: DataFrame, probe: DataFrame) -> DataFrame:
    """Probe rows that are in the relation by the columns they have of a and b."""
    return probe.join(r, [c for c in ("a", "b") if c in probe.columns], "left_semi")


def not_member(r: DataFrame, probe: DataFrame) -> DataFrame:
    return probe.join(r, [c for c in ("a", "b") if c in probe.columns], "left_anti")


def dom(r: DataFrame) -> DataFrame:
    return r.select("a").distinct()


def ran(r: DataFrame) -> DataFrame:
    return r.select("b").distinct()


def converse(r: DataFrame) -> DataFrame:
    return r.select(F.col("b").alias("a"), F.col("a").alias("b"))


def size(r: DataFrame) -> DataFrame:
    return r.agg(F.count("*").alias("size"))


def to_list(r: DataFrame) -> DataFrame:
    return r.orderBy("a", "b")


def dom_related(sa: DataFrame, sb: DataFrame, r: DataFrame) -> DataFrame:
    """Those of sa (a) related to something in sb (b)."""
    return dom(restrict_ran(restrict_dom(sa, r), sb))


def ran_related(sa: DataFrame, sb: DataFrame, r: DataFrame) -> DataFrame:
    """Those of sb (b) that something in sa (a) is related to."""
    return ran(restrict_ran(restrict_dom(sa, r), sb))


def restrict_dom(sa: DataFrame, r: DataFrame) -> DataFrame:
    return r.join(sa, "a", "left_semi")


def restrict_ran(r: DataFrame, sb: DataFrame) -> DataFrame:
    return r.join(sb, "b", "left_semi").select("a", "b")


def map_dom(f: Callable[[Column], Column], r: DataFrame) -> DataFrame:
    """Pairs that fall together become one; none is lost otherwise."""
    return r.select(f(F.col("a")).alias("a"), "b").distinct()


def map_ran(f: Callable[[Column], Column], r: DataFrame) -> DataFrame:
    return r.select("a", f(F.col("b")).alias("b")).distinct()


def where(f: Callable[[Column, Column], Column], r: DataFrame) -> DataFrame:
    return r.where(f(F.col("a"), F.col("b")))


def compact(sets: DataFrame, column: str = "items") -> DataFrame:
    """The union of a column of sets."""
    return sets.select(F.explode(column).alias("item")).distinct()
