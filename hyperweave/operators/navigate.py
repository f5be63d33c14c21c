"""Lookups as joins: children, hosts, paths, whole trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import settled, small_side
from ..sources.facts import P, R, read_off
from ..sources.space import Space


def variety(space: Space, addrs: DataFrame) -> DataFrame:
    """Kind and arity."""
    return addrs.select("addr").join(space.expr.select("addr", "kind", "arity"), "addr")


def rows(space: Space, addrs: DataFrame) -> DataFrame:
    """The rows themselves."""
    return space.expr.join(addrs.select("addr"), "addr", "left_semi")


def children(space: Space, addrs: DataFrame) -> DataFrame:
    """(addr, role, ix, child) of every child."""
    return addrs.select("addr").join(space.pos.withColumnRenamed("host", "addr"), "addr").select("addr", "role", "ix", "child")


def hosts(space: Space, addrs: DataFrame) -> DataFrame:
    """(addr, role, ix, host) of everything that holds the address."""
    return addrs.select("addr").join(space.pos.withColumnRenamed("child", "addr"), "addr").select("addr", "role", "ix", "host")


def member_hosts(space: Space, addrs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Hosts that have one of ``addrs`` as a member; ``extra`` columns ride along."""
    members = space.role("member").select("host", F.col("child").alias("addr"))
    if not extra:
        return members.join(addrs, "addr", "left_semi").select(F.col("host").alias("addr")).distinct()
    return members.join(addrs, "addr").select(F.col("host").alias("addr"), *extra).distinct()


def sub_exprs(space: Space, addrs: DataFrame, paths, strict: bool = False) -> DataFrame:
    """What lies at each path in each address: (host, addr) and the other columns of ``addrs``. Hosts without the path are left out (strict: an error)."""
    from .search import role_of

    extra = [c for c in addrs.columns if c != "addr"]
    out = None
    for path in paths:
        at = addrs.select(F.col("addr").alias("host"), "addr", *extra)
        for step in path:
            name, ix = role_of(step)
            p = space.role(name).where(F.col("ix") == ix).select(F.col("host").alias("addr"), F.col("child").alias("_next"))
            at = at.join(p, "addr").select("host", F.col("_next").alias("addr"), *extra)
        if strict and not addrs.join(at.select(F.col("host").alias("addr")), "addr", "left_anti").isEmpty():
            raise LookupError(f"path {path} is missing in some expression")
        out = at if out is None else out.union(at)
    return out.distinct()


def unnest(space: Space, addrs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The whole tree of each address: (root, path, addr, kind, phrase); a path is a list of steps such as member:2 or tplt:0.

    One round for each level, down to the leaves, or to max_depth. An expression that holds itself, which valid data has not, raises
    RecursionError.
    """
    at = settled(addrs.select(F.col("addr").alias("root"), F.array().cast("array<string>").alias("path"), "addr", F.array().cast("array<long>").alias("above")).distinct())
    inside = space.pos.withColumnRenamed("host", "addr").select("addr", "role", "ix", "child", "host_kind")
    of_tplts = F.broadcast(inside.where("host_kind = 'tplt'"))
    is_tplt = F.coalesce(F.try_element_at("path", F.lit(-1)).startswith("tplt:"), F.lit(False))  # very many at one address
    out = at
    step = F.concat("role", F.lit(":"), F.format_string("%05d", "ix"))
    depth = 0
    while max_depth is None or depth < max_depth:
        below = at.join(of_tplts, "addr").unionByName(at.where(~is_tplt).join(inside.where("host_kind <> 'tplt'"), "addr"))
        at = settled(below.select("root", F.array_append("path", step).alias("path"), F.col("child").alias("addr"), F.array_append("above", F.col("addr")).alias("above")))
        met = at.agg(F.count("*").alias("n"), F.count_if(F.array_contains("above", F.col("addr"))).alias("again")).first()
        if met["again"]:
            raise RecursionError("an expression holds itself")
        if not met["n"]:
            break
        out = out.union(at)
        depth += 1
        if depth % 8 == 0:
            out = settled(out)
    return out.join(space.expr.select("addr", "kind", "phrase"), "addr", "left").select("root", "path", "addr", "kind", "phrase")


def with_depth(space: Space) -> DataFrame:
    """(addr, depth) of all expressions: phrases and templates 0, relationships one more than their deepest member.

    One round for each level, however many there are. Relationships that hold themselves, or an absent member, at any
    distance have no depth and no row.
    """
    members = space.role("member").select("host", F.col("child").alias("addr"))
    out = frontier = space.expr.where("kind <> 'rel'").select("addr", F.lit(0).alias("depth"))
    waiting = space.expr.where("kind = 'rel'").select(F.col("addr").alias("host"), F.col("arity").alias("missing"), F.lit(0).alias("depth"))
    while True:
        reached = members.join(frontier, "addr").groupBy("host").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
        left = F.col("missing") - F.coalesce("n", F.lit(0))
        told = settled(waiting.join(reached, "host", "left").select("host", left.alias("missing"), F.greatest("depth", "d").alias("depth")))
        frontier = told.where("missing = 0").select(F.col("host").alias("addr"), (F.col("depth") + 1).alias("depth"))
        if frontier.isEmpty():
            return out
        out, waiting = out.union(frontier), told.where("missing > 0")


def _leaf_texts(pattern) -> Column | None:
    """The phrases of a pattern as an array, left to right; None if a template is among its members."""
    if isinstance(pattern, P):
        return F.array(pattern.column())
    found = [_leaf_texts(m) for m in pattern.members] if isinstance(pattern, R) else [None]
    return None if any(x is None for x in found) else F.concat(*found)


def flatten_phrases(space: Space, addrs: DataFrame) -> DataFrame:
    """(root, phrases): leaf phrases left to right, without separators. Trees with a template among their members are left out.

    In a space made from tables the phrases are read off the rows that state them, with no walk down.
    """
    if space.wholes is not None:
        return read_off(space, settled(addrs.select("addr").distinct()), _leaf_texts, "phrases").withColumnRenamed("addr", "root")
    below = unnest(space, addrs).where(F.forall("path", lambda s: s.startswith("member:")))
    bad = below.where("kind = 'tplt'").select("root")
    return below.where("kind = 'phrase'").join(bad, "root", "left_anti").groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "phrase"))), lambda x: x["phrase"]).alias("phrases"))


def host_rows(space: Space, addrs: DataFrame) -> DataFrame:
    """(addr, group, ix, tplt, host): relationships that hold the address, with their role and template; templates that hold it are one group."""
    h = addrs.select("addr").join(space.pos.withColumnRenamed("child", "addr"), "addr")
    in_tplt = F.col("host_kind") == "tplt"
    return h.select("addr", F.when(in_tplt, "in_template").otherwise(F.col("role")).alias("group"), F.when(in_tplt, 0).otherwise(F.col("ix")).alias("ix"), F.when(~in_tplt, F.col("tplt")).alias("tplt"), "host").distinct()


def host_groups(space: Space, addrs: DataFrame) -> DataFrame:
    """(addr, group, ix, tplt, hosts): host_rows with a list for each group; for groups of moderate size."""
    return host_rows(space, addrs).groupBy("addr", "group", "ix", "tplt").agg(F.sort_array(F.collect_set("host")).alias("hosts"))


def members_and_template(space: Space, addrs: DataFrame) -> DataFrame:
    return children(space, addrs).where("role IN ('tplt', 'member')")


def using_template(space: Space, addrs: DataFrame, tplts: DataFrame) -> DataFrame:
    """Which addresses stand in any role of a relationship of these templates; a template stands in its own."""
    t = F.broadcast(tplts.select(F.col("addr").alias("tplt")).distinct())
    mine = settled(addrs)
    inside = space.pos.where("host_kind = 'rel'").join(t, "tplt", "left_semi").select(F.col("child").alias("addr"))
    return mine.join(inside.join(small_side(mine.select("addr").distinct()), "addr", "left_semi").distinct(), "addr", "left_semi")


def max_addr(space: Space) -> DataFrame:
    return space.expr.agg(F.max("addr").alias("max_addr"), (F.max("addr") + 1).alias("next_addr"))


def graph_children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")


def graph_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")


def inverted(edges: DataFrame) -> DataFrame:
    """child -> its parents, as a sorted list; for children of moderately many parents."""
    return edges.groupBy("child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))


def composed(ab: DataFrame, bc: DataFrame) -> DataFrame:
    """(a, b) and (b, c) -> (a, c)."""
    return ab.join(bc, "b").select("a", "c")
