"""Integrity reports; all are empty for a valid space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.space import Space


def absent_children(space: Space) -> DataFrame:
    """(addr, absent): expressions that refer to addresses which don't exist, with those addresses.

    Each address is looked up once, however many hold it, as all relationships of a template do.
    """
    lost = space.pos.select("child").distinct().join(space.expr.select(F.col("addr").alias("child")), "child", "left_anti")
    return space.pos.join(lost, "child").groupBy(F.col("host").alias("addr")).agg(F.sort_array(F.collect_set("child")).alias("absent"))


def misfit_rels(space: Space) -> DataFrame:
    """(addr): relationships whose template is absent, no template, or of another arity."""
    t = space.expr.where("kind = 'tplt'").select(F.col("addr").alias("tplt"), F.col("arity").alias("n"))
    rels = space.expr.where("kind = 'rel'").select("addr", "tplt", F.size("members").alias("size"))
    return rels.join(F.broadcast(t), "tplt", "left").where("n IS NULL OR n <> size").select("addr")


def null_templates(space: Space) -> DataFrame:
    """(addr): templates with neither caps nor separators."""
    return space.expr.where("kind = 'tplt' AND coalesce(size(seps), 0) <= 0 AND cap_left IS NULL AND cap_right IS NULL").select("addr")


def duplicate_content(space: Space) -> DataFrame:
    """(key, addrs): content that is there more than once."""
    return space.expr.where("key IS NOT NULL").groupBy("key").agg(F.sort_array(F.collect_set("addr")).alias("addrs")).where(F.size("addrs") > 1)


def colliding_addresses(space: Space) -> DataFrame:
    """(addr, n): addresses of more than one content, as hashed addresses might have."""
    return space.expr.groupBy("addr").agg(F.count_distinct("key").alias("n")).where("n > 1")


def problems(space: Space) -> DataFrame:
    """(problem, addr): all reports but that of null templates, which whole-space validity does not ask for."""
    named = lambda n, d: d.select(F.lit(n).alias("problem"), "addr")
    return named("absent child", absent_children(space)).union(named("template does not fit", misfit_rels(space)))
