"""Topological order along binary templates, and the default templates to sort by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import followed, kept_at, settled, small_side
from ..sources.space import Space

from .search import IT, eval_, find, rel, template, templates
from .transitive import edges


class CycleError(ValueError):
    """The relationships to sort by go in a circle."""


def _pairs(space: Space, tplts: DataFrame, earlier: str) -> DataFrame:
    """(before, after): which member comes first follows from ``earlier``."""
    if earlier not in ("left", "right"):
        raise ValueError("earlier is left or right")
    a, b = ("src", "dst") if earlier == "left" else ("dst", "src")
    return edges(space, tplts).select(F.col(a).alias("before"), F.col(b).alias("after")).distinct()


def levels(pairs: DataFrame) -> DataFrame:
    """(addr, level) of all nodes of (before, after): 0 for those that nothing precedes, else one more than the last before it.

    Each round peels all tops, and all nodes with a single predecessor left: those hang on the first node up the chain that has
    none or several, which pointer doubling finds. What is known of a hanging node's level is a function of that one's:
    the greater of a constant and its level plus a number. Chains and trees of any depth take a number of rounds that grows with the
    logarithm of their size. A circle raises CycleError.
    """
    edges = settled(pairs.select("before", "after", F.lit(1).cast("long").alias("w")).distinct())
    nodes = edges.select(F.col("before").alias("addr"), F.lit(0).cast("long").alias("least"))
    known, hanging = nodes.where(F.lit(False)).select("addr", F.col("least").alias("level")), []
    while not edges.isEmpty():
        # One exchange: what is known of each node, how many precede it, and which one if there is one.
        both = nodes.select("addr", "least", F.lit(None).cast("long").alias("up"), F.lit(None).cast("long").alias("w"))
        both = both.unionByName(edges.select(F.col("after").alias("addr"), F.lit(0).cast("long").alias("least"), F.col("before").alias("up"), "w"))
        degree = settled(both.groupBy("addr").agg(F.max("least").alias("least"), F.count("up").alias("n"), F.max("up").alias("up"), F.max("w").alias("w")))
        single = degree.where("n = 1").select(F.col("addr").alias("node"), "up", "least", "w")
        tops = degree.where("n = 0").select("addr", F.col("least").alias("level"))
        hung, circling = followed(single, lambda mine, on: {"least": F.greatest(mine("least"), on("least") + mine("w")), "w": mine("w") + on("w")})
        if not circling.isEmpty() or (hung.isEmpty() and tops.isEmpty()):
            raise CycleError("the template has a cycle")
        known = known.union(tops)
        hanging.append(hung)
        several = degree.where("n > 1").select(F.col("addr").alias("after"), "least")
        if several.isEmpty():
            nodes = nodes.where(F.lit(False))
            break
        via = hung.select(F.col("node").alias("before"), "up", F.col("least").alias("_least"), F.col("w").alias("more"))
        moved = edges.join(several.select("after"), "after", "left_semi").join(via, "before", "left")
        moved = moved.select("after", F.coalesce("up", "before").alias("before"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("_least") + F.col("w")).alias("bound"))
        moved = settled(moved.join(tops.withColumnRenamed("addr", "before"), "before", "left"))
        bound = moved.groupBy("after").agg(F.max(F.greatest("bound", F.col("level") + F.col("w"))).alias("bound"))
        nodes = settled(several.join(bound, "after").select(F.col("after").alias("addr"), F.greatest("least", "bound").alias("least")))
        edges = settled(moved.where("level IS NULL").groupBy("before", "after").agg(F.max("w").alias("w")))
    known = settled(known.union(nodes.select("addr", F.col("least").alias("level"))).dropDuplicates(["addr"]))
    for hung in reversed(hanging):
        # Very many may hang on a few, which then go to them: they would all meet in one task.
        ups = settled(hung.select(F.col("up").alias("addr")).distinct())
        on = small_side(settled(kept_at(known, ups, "addr").select(F.col("addr").alias("up"), "level")))
        known = settled(known.union(hung.join(on, "up").select(F.col("node").alias("addr"), F.greatest("least", F.col("level") + F.col("w")).alias("level"))))
    return known.select("addr", F.col("level").cast("int").alias("level"))


def has_cycle(space: Space, tplts: DataFrame) -> bool:
    try:
        levels(_pairs(space, tplts, "left"))
    except CycleError:
        return True
    return False


def topo_sort(space: Space, tplts: DataFrame, addrs: DataFrame, earlier: str = "left") -> DataFrame:
    """(addr, level, is_isolated) of the addresses in an order that every relationship of the templates agrees with.

    All relationships of the templates count, also through addresses that are not asked for. Isolated ones come last.
    """
    known = levels(_pairs(space, tplts, earlier))
    out = addrs.select("addr").distinct().join(known, "addr", "left").withColumn("is_isolated", F.col("level").isNull())
    return out.orderBy("is_isolated", "level", "addr")


def preorder(space: Space, tplts: DataFrame, addrs: DataFrame, earlier: str = "left") -> DataFrame:
    """(addr, path) for forests: each node after its parent and before its parent's next child, by address. One round for each level;
    a node that comes up below itself raises CycleError, and so do nodes that no root leads to.
    """
    pairs = settled(_pairs(space, tplts, earlier))
    roots = pairs.select(F.col("before").alias("addr")).distinct().join(pairs.select(F.col("after").alias("addr")), "addr", "left_anti")
    at = out = settled(roots.select("addr", F.array("addr").alias("path")))
    rounds = 0
    while True:
        below = at.join(pairs, at["addr"] == pairs["before"]).select(F.col("after").alias("addr"), F.col("path").alias("above"))
        met = settled(below.select("addr", F.array_append("above", F.col("addr")).alias("path"), F.array_contains("above", F.col("addr")).alias("again")))
        if not met.where("again").isEmpty():
            raise CycleError("the template has a cycle")
        at = met.drop("again")
        if at.isEmpty():
            break
        out, rounds = out.union(at), rounds + 1
        if rounds % 8 == 0:
            out = settled(out)
    if not pairs.select(F.col("after").alias("addr")).join(out, "addr", "left_anti").isEmpty():
        raise CycleError("the template has a cycle")
    return out.join(addrs.select("addr"), "addr", "left_semi").orderBy("path")


def tops(space: Space, tplts: DataFrame, addrs: DataFrame, earlier: str = "left") -> DataFrame:
    """Addresses that nothing precedes."""
    return addrs.select("addr").join(_pairs(space, tplts, earlier).select(F.col("after").alias("addr")), "addr", "left_anti")


def just_under(space: Space, tplts: DataFrame, addrs: DataFrame, earlier: str = "left") -> DataFrame:
    """(addr, under): direct successors."""
    return addrs.select("addr").join(_pairs(space, tplts, earlier).withColumnRenamed("before", "addr"), "addr").select("addr", F.col("after").alias("under"))


def related(space: Space, tplts: DataFrame, addrs: DataFrame) -> DataFrame:
    """(addr, is_related): whether the address is a member of a relationship of the templates."""
    e = edges(space, tplts)
    ends = e.select(F.col("src").alias("addr")).union(e.select("dst")).distinct().withColumn("is_related", F.lit(True))
    return addrs.select("addr").join(ends, "addr", "left").fillna(False, ["is_related"])


def rels_using(space: Space, tplts: DataFrame) -> DataFrame:
    return space.expr.where("kind = 'rel'").join(F.broadcast(tplts.select(F.col("addr").alias("tplt"))), "tplt", "left_semi").select("addr", "tplt", "members")


def members_of_rels(space: Space, tplts: DataFrame) -> DataFrame:
    return rels_using(space, tplts).select(F.explode("members").alias("addr")).distinct()


def restrict(space: Space, tplts: DataFrame, addrs: DataFrame) -> Space:
    """The part of the space that matters when these addresses are sorted along these templates."""
    keep = rels_using(space, tplts).select("addr").union(members_of_rels(space, tplts)).union(tplts.select("addr")).union(addrs.select("addr"))
    return Space(space.expr.join(keep.distinct(), "addr", "left_semi"), strict=space.strict)


def orientation(space: Space, tplts: DataFrame) -> DataFrame:
    """(addr, earlier): 'right' where ``sort by t right first`` is stated, else 'left'."""
    stated = find(space, eval_(rel("sort by _ right first", IT))).withColumn("earlier", F.lit("right"))
    return tplts.select("addr").join(stated, "addr", "left").fillna("left", ["earlier"])


def sort_priority(space: Space) -> DataFrame:
    """(addr, level, is_isolated) of the templates to sort by: named in ``sort by _``, or on a side of ``sort by _ before _``, in that order."""
    named = eval_(rel("sort by _", IT)) | eval_(rel("sort by _ before _", IT, IT))
    found = find(space, named & templates())
    return topo_sort(space, find(space, template("sort by _ before _")), found)


def first_applicable(space: Space, addrs: DataFrame) -> DataFrame:
    """The first template of the priority that any of the addresses takes part in: at most one row."""
    ranked = sort_priority(space)
    inside = space.pos.where("host_kind = 'rel'").join(addrs.select(F.col("addr").alias("child")), "child", "left_semi").select(F.col("tplt").alias("addr"))
    return ranked.join(inside, "addr", "left_semi").orderBy("is_isolated", "level", "addr").limit(1)


def order_like(df: DataFrame, ranks: DataFrame, key: str, rank: str, original: str) -> DataFrame:
    """``df`` in the order of ``ranks`` (key, rank); rows not in it come last in their old order."""
    return df.join(ranks.select(key, rank), key, "left").orderBy(F.col(rank).asc_nulls_last(), original)


def find_sorted(space: Space, term, tplts: DataFrame, earlier: str = "left") -> DataFrame:
    """A search, then its sort."""
    return topo_sort(space, tplts, find(space, term), earlier)


