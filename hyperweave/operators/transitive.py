"""Reach, closure, paths and cycles along binary templates: loops over frontiers or doubled pairs, one distributed join a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import followed, grown, settled
from ..sources.space import Space


def edges(space: Space, tplts: DataFrame) -> DataFrame:
    """(src, dst, rel, tplt) of the binary relationships of these templates. Other arities add no edges (strict: an error).

    Templates are few and each has very many relationships, so they go to these, not both to one task for each template.
    """
    rels = space.expr.where("kind = 'rel'").join(F.broadcast(tplts.select(F.col("addr").alias("tplt"))), "tplt", "left_semi")
    if space.strict and not rels.where("arity <> 2").isEmpty():
        raise ValueError("a template is not binary")
    return rels.where("arity = 2").select(F.get("members", F.lit(0)).alias("src"), F.get("members", F.lit(1)).alias("dst"), F.col("addr").alias("rel"), "tplt")


def _steps(space: Space, tplts: DataFrame, direction: str) -> DataFrame:
    """(at, to), in the direction of the walk."""
    if direction not in ("left", "right"):
        raise ValueError("direction is left or right")
    a, b = ("src", "dst") if direction == "right" else ("dst", "src")
    return edges(space, tplts).select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()


def neighbors(space: Space, tplts: DataFrame, addrs: DataFrame, direction: str) -> DataFrame:
    """(addr, neighbor): one step along the templates."""
    return addrs.select("addr").join(_steps(space, tplts, direction).withColumnRenamed("at", "addr"), "addr").select("addr", F.col("to").alias("neighbor"))


def reach(space: Space, tplts: DataFrame, starts: DataFrame, direction: str = "right") -> DataFrame:
    """Everything the starts lead to, they themselves included; ends on cyclic data."""
    steps = settled(_steps(space, tplts, direction))
    return grown(starts.select("addr"), lambda f: f.join(steps, f["addr"] == steps["at"]).select(F.col("to").alias("addr")), ["addr"])


#: Pairs are doubled if the graph that is left has at most so many nodes for each one that the walks begin at.
ROOM = 4


def _past(links: DataFrame, fixed: DataFrame) -> DataFrame:
    """links (at, to) without the nodes that have one link in, unless they are fixed: what they lead to hangs on the first node above that stays.

    A circle of such nodes alone, without a fixed one, cannot be entered and goes.
    """
    single = links.groupBy("to").agg(F.count("*").alias("n"), F.first("at").alias("up")).where("n = 1").select(F.col("to").alias("node"), "up")
    single = settled(single.join(fixed.select(F.col("addr").alias("node")), "node", "left_anti"))
    if single.isEmpty():
        return links
    above, _ = followed(single, lambda mine, on: {})
    kept = links.join(single.select(F.col("node").alias("to")), "to", "left_anti")
    direct = kept.join(single.select(F.col("node").alias("at")), "at", "left_anti").select("at", "to")
    return settled(direct.union(kept.join(above.withColumnRenamed("node", "at"), "at").select(F.col("up").alias("at"), "to")).distinct())


def _kernel(steps: DataFrame, fixed: DataFrame) -> DataFrame:
    """(at, to): a smaller graph in which the same fixed nodes lead to each other."""
    turned = lambda links: links.select(F.col("to").alias("at"), F.col("at").alias("to"))
    links = turned(_past(turned(_past(steps, fixed)), fixed))
    goes_on = links.select(F.col("at").alias("to")).union(fixed.select(F.col("addr").alias("to"))).distinct()
    return settled(links.join(goes_on, "to", "left_semi").select("at", "to"))


def _doubled(links: DataFrame) -> DataFrame:
    """(at, to) of all nodes that lead to others. Round k goes on from the pairs exactly 2^k apart, so rounds go with the logarithm of the way.

    A pair further apart has a first leg of that length on its shortest way, so none is missed and few are met twice.
    """
    known = settled(links.select("at", "to", F.lit(1).cast("long").alias("far")))
    reach_, legs = 1, known
    while not legs.isEmpty():
        on = known.select(F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        longer = legs.join(on, legs["to"] == on["_at"]).groupBy("at", F.col("_to").alias("to")).agg((F.min("_far") + F.lit(reach_)).alias("far"))
        new = settled(longer.join(known, ["at", "to"], "left_anti"))
        reach_ *= 2
        known, legs = known.union(new), new.where(F.col("far") == reach_)
    return known.select("at", "to")


def reach_pairs(space: Space, tplts: DataFrame, starts: DataFrame, ends: DataFrame, direction: str = "right") -> DataFrame:
    """(left, right) for each left member among ``starts`` that leads to a right member among ``ends``, or is it.

    direction: from which side the walk goes; the pairs are the same. Nodes that are neither and have one way in or one way out are
    passed over first. If few but the asked nodes are left (ROOM), the pairs are doubled; else walks go on step by step from the asked side alone,
    as doubling would make pairs of nodes that nobody asked for. The pairs are the same either way.
    """
    starts, ends = settled(starts.select("addr").distinct()), settled(ends.select("addr").distinct())
    first, last = (starts, ends) if direction == "right" else (ends, starts)
    links = _kernel(settled(_steps(space, tplts, direction)), starts.union(ends).distinct())
    # Made by a generator: a checkpoint keeps constraints of plain columns under attributes that a later union may not know.
    seed = first.select(F.inline_outer(F.array(F.struct(F.col("addr").alias("start"), "addr"))))
    nodes = links.select("at").union(links.select("to")).distinct().count()
    if nodes <= ROOM * first.count():
        found = _doubled(links).join(first.withColumnRenamed("addr", "at"), "at", "left_semi").select(F.col("at").alias("start"), F.col("to").alias("addr"))
        found = found.union(seed)
    else:
        found = grown(seed, lambda f: _onward(links, f), ["start", "addr"])
    hit = found.join(last, "addr", "left_semi")
    a, b = ("start", "addr") if direction == "right" else ("addr", "start")
    return hit.select(F.col(a).alias("left"), F.col(b).alias("right")).distinct()


def closure(space: Space, tplts: DataFrame, addrs: DataFrame, direction: str = "right") -> DataFrame:
    """The transitive and reflexive closure within a set."""
    return reach_pairs(space, tplts, addrs, addrs, direction)


def _contracted(links: DataFrame, fixed: DataFrame) -> DataFrame:
    """links (at, to, inner) without the nodes that have one link in and one out, unless they are fixed: these go into ``inner``.

    Pointer doubling finds where a chain begins. A circle of such nodes alone, without a fixed one, goes.
    """
    into = links.groupBy("to").agg(F.count("*").alias("n"), F.first("at").alias("up"), F.first("inner").alias("pre")).where("n = 1").withColumnRenamed("to", "node")
    out = links.groupBy("at").agg(F.count("*").alias("n")).where("n = 1").select(F.col("at").alias("node"))
    chain = settled(into.join(out, "node", "left_semi").join(fixed.select(F.col("addr").alias("node")), "node", "left_anti").select("node", "up", F.col("node").alias("first"), F.lit(1).cast("long").alias("far"), "pre"))
    if chain.isEmpty():
        return links
    ended, _ = followed(chain, lambda mine, on: {"first": on("first"), "far": mine("far") + on("far"), "pre": mine("pre")})
    row = F.sort_array(F.collect_list(F.struct("far", F.concat("pre", F.array("node")).alias("x"))))
    runs = ended.groupBy("up", "first").agg(row.alias("row"), F.max_by("node", "far").alias("last"))
    nodes = chain.select("node")
    whole = runs.join(links, runs["last"] == links["at"]).select(F.col("up").alias("at"), "to", F.concat(F.flatten("row.x"), "inner").alias("inner"))
    direct = links.join(nodes.withColumnRenamed("node", "at"), "at", "left_anti").join(nodes.withColumnRenamed("node", "to"), "to", "left_anti")
    return settled(direct.select("at", "to", "inner").union(whole))


def _bare(steps: DataFrame) -> DataFrame:
    return settled(steps.select("at", "to", F.slice(F.array("at"), 1, 0).alias("inner")))


def _onward(links: DataFrame, f: DataFrame, a: str = "at", b: str = "to") -> DataFrame:
    """One step from a frontier (addr and labels)."""
    return f.join(links.select(F.col(a).alias("addr"), F.col(b).alias("_to")), "addr").select(*(F.col("_to").alias("addr") if c == "addr" else c for c in f.columns))


def _path_graph(steps: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(at, to, inner) of the links that are on some way from a start to a goal; ways end at their first goal."""
    fixed = settled(starts.union(goals).distinct())
    ends_only = settled(goals.join(starts, "addr", "left_anti"))
    links = _contracted(_bare(steps.join(ends_only.withColumnRenamed("addr", "at"), "at", "left_anti")), fixed)
    reached = grown(starts, lambda f: _onward(links, f), ["addr"])
    links = settled(links.join(reached.withColumnRenamed("addr", "at"), "at", "left_semi"))
    leading = grown(goals, lambda f: _onward(links, f, "to", "at"), ["addr"])
    links = settled(links.join(leading.withColumnRenamed("addr", "to"), "to", "left_semi").select("at", "to", "inner"))
    return _contracted(links, fixed)


def _unfolded(links: DataFrame, starts: DataFrame, hits, max_len: int | None) -> DataFrame:
    """(start, path): walks over contracted links, until none goes on. hits(rows): those that have come to their goal, and the others."""
    at = settled(starts.select(F.col("addr").alias("start"), F.array("addr").alias("path"), "addr").distinct())
    done = at.where(F.lit(False)).select("start", "path")
    rounds = 0
    while not at.isEmpty():
        far = at.withColumnRenamed("addr", "at").join(links, "at").select("start", F.concat("path", "inner").alias("path"), F.col("to").alias("addr"))
        far = settled(far if max_len is None else far.where(F.size("path") <= max_len))
        hit, rest = hits(far)
        done = done.union(hit.select("start", F.array_append("path", F.col("addr")).alias("path")))
        at = settled(rest.where(~F.array_contains("path", F.col("addr"))).select("start", F.array_append("path", F.col("addr")).alias("path"), "addr"))
        rounds += 1
        if rounds % 8 == 0:
            done = settled(done)
    return done


def path_graph(space: Space, tplts: DataFrame, starts: DataFrame, ends: DataFrame, direction: str = "right") -> DataFrame:
    """(at, to, inner): the graph of all walks from a start to an end, however many there are.

    Only nodes that a start leads to and that lead to an end are in it; chains of nodes that no way leaves or joins are one link, with
    the nodes in ``inner``, in order. Walks end at the first end they meet.
    """
    return _path_graph(settled(_steps(space, tplts, direction)), settled(starts.select("addr").distinct()), settled(ends.select("addr").distinct()))


def paths(space: Space, tplts: DataFrame, starts: DataFrame, ends: DataFrame, direction: str = "right", max_len: int | None = None) -> DataFrame:
    """(start, path): all walks from a start to an end, each ending at the first end it meets; the start itself is no hit.

    A walk that comes to a node it has been at, other than an end, is given up, so cycles end. The walks are unfolded from
    ``path_graph``, which has no dead ends, in one round for each of its links. max_len: list only walks of at most so many steps.
    """
    first, last = settled(starts.select("addr").distinct()), settled(ends.select("addr").distinct())
    links = _path_graph(settled(_steps(space, tplts, direction)), first, last)
    return _unfolded(links, first, lambda far: (far.join(last, "addr", "left_semi"), far.join(last, "addr", "left_anti")), max_len)


def _cycles(steps: DataFrame, starts: DataFrame, max_len: int | None) -> DataFrame:
    """(start, path): only nodes of a start's own strong component are walked: what it leads to and what leads to it."""
    links = _path_graph(steps, starts, starts)
    seed = starts.select(F.col("addr").alias("start"), "addr")
    forth = grown(seed, lambda f: _onward(links, f), ["start", "addr"])
    back = grown(seed, lambda f: _onward(links, f, "to", "at"), ["start", "addr"])
    component = settled(forth.join(back, ["start", "addr"], "left_semi"))

    def hits(far: DataFrame) -> tuple[DataFrame, DataFrame]:
        inside = far.join(component, ["start", "addr"], "left_semi")
        return inside.where("addr = start"), inside.where("addr <> start")

    return _unfolded(links, starts, hits, max_len)


def cycles(space: Space, tplts: DataFrame, addrs: DataFrame, direction: str = "right", max_len: int | None = None) -> DataFrame:
    """(start, path): the cycles through each address, in walking order, first equal to last. max_len: those of at most so many steps."""
    return _cycles(settled(_steps(space, tplts, direction)), settled(addrs.select("addr").distinct()), max_len)


def recheck_cycles(space: Space, kernels: DataFrame, direction: str = "right", max_len: int | None = None) -> DataFrame:
    """(tplt, start, path) for kernels (tplt, addr): the cycles of each kernel along its own template, all in one loop."""
    a, b = ("src", "dst") if direction == "right" else ("dst", "src")
    of = kernels.select(F.col("tplt").alias("addr")).distinct()
    node = lambda c: F.struct("tplt", F.col(c).alias("addr"))  # noqa: E731  a node is an address under a template
    steps = settled(edges(space, of).select(node(a).alias("at"), node(b).alias("to")).distinct())
    found = _cycles(steps, settled(kernels.select(node("addr").alias("addr")).distinct()), max_len)
    return found.select("start.tplt", "start.addr", "path.addr").toDF("tplt", "start", "path")
