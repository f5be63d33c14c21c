"""Bulk edits. Each returns a new space; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import settled, small_side
from ..sources.space import EXPR, Space, positions, rekeyed
from . import check, transitive
from .search import find, frame, roles

_COLUMNS = [c.split()[0] for c in EXPR.split(", ")]


def _local(space: Space, expr: DataFrame, touched: DataFrame) -> tuple[Space, DataFrame]:
    """The space of the edited rows, and the addresses whose keys were made anew: the touched ones and what holds them."""
    new, above = rekeyed(settled(expr.select(*_COLUMNS)), touched)
    return Space(new, strict=space.strict), above


def insert_rows(space: Space, rows: DataFrame) -> Space:
    """Flat rows (the expr schema, key ignored) at their own addresses. Taken addresses, absent children and ill-fitting templates are errors."""
    rows = rows.select(*_COLUMNS)
    if not rows.join(space.expr.select("addr"), "addr", "left_semi").isEmpty():
        raise ValueError("an address is taken")
    mine = settled(rows.select("addr"))
    out, _ = _local(space, space.expr.unionByName(rows.withColumn("key", F.lit(None).cast("string"))), mine)
    for report in (check.absent_children(out), check.misfit_rels(out), check.null_templates(out)):
        if not report.join(mine, "addr", "left_semi").isEmpty():
            raise ValueError("a row is not valid")
    return out


def chain_pairs(df: DataFrame, addr: str, order: str | Column, group: list[str] = (), earlier: str = "left") -> DataFrame:
    """(left, right) of neighbours in each group's order.

    Without a group the rows are dealt to ranges of the order; the last row of a range is joined to the first one of the next, so that no
    task has them all. Equal places in the order stand by address.
    """
    if group:
        w = W.partitionBy(*group).orderBy(order, addr)
        pairs = df.withColumn("_next", F.lead(addr).over(w)).where("_next IS NOT NULL")
    else:
        keyed = df.select(F.col(addr), (F.col(order) if isinstance(order, str) else order).alias("_order"))
        ranged = settled(keyed.repartitionByRange("_order", addr).withColumn("_part", F.spark_partition_id()))
        inside = W.partitionBy("_part").orderBy("_order", addr)
        near = ranged.withColumn("_next", F.lead(addr).over(inside))
        ends = ranged.groupBy("_part").agg(F.min(F.struct("_order", addr)).alias("_first"))  # a row for each range
        after = ends.select(F.lag("_part").over(W.orderBy("_part")).alias("_part"), F.col(f"_first.{addr}").alias("_start"))
        near = near.join(F.broadcast(after), "_part", "left").withColumn("_next", F.coalesce("_next", "_start"))
        pairs = near.where("_next IS NOT NULL")
    a, b = (addr, "_next") if earlier == "left" else ("_next", addr)
    return pairs.select(F.col(a).alias("left"), F.col(b).alias("right"))


def relate(space: Space, tplt: DataFrame, pairs: DataFrame) -> Space:
    """Adds relationships (left, right) of one binary template, given by address; those already there are left alone."""
    from ..functions.frames import dense_ids

    e = transitive.edges(space, tplt)
    new = pairs.select("left", "right").distinct().join(e.select(F.col("src").alias("left"), F.col("dst").alias("right")), ["left", "right"], "left_anti")
    t = tplt.select(F.col("addr").alias("tplt")).limit(1)
    start = space.expr.agg(F.max("addr")).first()[0] + 1
    rows = dense_ids(new, ["left", "right"], "addr", start).crossJoin(F.broadcast(t))  # one template
    null = lambda n, k: F.lit(None).cast(k).alias(n)
    made = rows.select("addr", F.lit("rel").alias("kind"), F.lit(2).alias("arity"), null("phrase", "string"), "tplt", F.array("left", "right").alias("members"), null("cap_left", "long"), null("seps", "array<long>"), null("cap_right", "long"), null("key", "string"))
    made = settled(made)
    return _local(space, space.expr.unionByName(made), made.select("addr"))[0]


def insert_chain(space: Space, tplt: DataFrame, df: DataFrame, addr: str, order: str | Column, group: list[str] = (), earlier: str = "left") -> Space:
    """Relates each row to the next in its group's order."""
    return relate(space, tplt, chain_pairs(df, addr, order, group, earlier))


def delete_unused(space: Space, addrs: DataFrame, cascade: bool = False) -> tuple[Space, DataFrame]:
    """The space without those of ``addrs`` that nothing holds, and the others (addr), which stay.

    Judged on the state before; cascade: repeated, so that a host and its member may go together.
    """
    left = settled(addrs.select("addr").join(space.expr.select("addr"), "addr", "left_semi").distinct())
    expr = space.expr
    while True:
        used = Space(expr).pos.select(F.col("child").alias("addr"))
        go = settled(left.join(used, "addr", "left_anti"))
        if go.isEmpty():
            break
        expr = settled(expr.join(go, "addr", "left_anti").select(*_COLUMNS))
        left = settled(left.join(go, "addr", "left_anti"))
        if not cascade:
            break
    return Space(expr, strict=space.strict), left


def _swapped(expr: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mapping (old, new): every child that is old becomes new. Only rows that hold one are made anew; their addresses (addr) come second."""
    mapping = settled(mapping.select("old", "new"))
    hit = positions(expr).select(F.col("host").alias("addr"), F.col("child").alias("old")).join(small_side(mapping.select("old")), "old", "left_semi")
    hosts = settled(hit.select("addr").distinct())
    few = small_side(hosts)
    mine = settled(expr.join(few, "addr", "left_semi"))
    out = mine
    for c in ("tplt", "cap_left", "cap_right"):
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("_new"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    for c in ("members", "seps"):
        long = mine.where(F.size(c) > 0).select("addr", F.posexplode(c).alias("i", "old")).join(mapping, "old", "left")
        lists = long.groupBy("addr").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("new", "old").alias("c")))), lambda x: x["c"]).alias("_list"))
        out = out.join(lists, "addr", "left").withColumn(c, F.coalesce("_list", c)).drop("_list")
    return expr.join(few, "addr", "left_anti").select(*_COLUMNS).union(out.select(*_COLUMNS)), hosts


def dedupe(space: Space, among: DataFrame | None = None) -> Space:
    """Rows of equal content become one, at the least address. among (addr): where the copies can be.

    Keys are of nested content, so one pass finds the copies at all depths, and putting one in the place of another changes no key.
    """
    keyed = space.expr.where("key IS NOT NULL").select("key", "addr")
    if among is not None:
        keyed = keyed.join(settled(keyed.join(among, "addr", "left_semi").select("key").distinct()), "key", "left_semi")
    least = keyed.groupBy("key").agg(F.min("addr").alias("new"), F.count("*").alias("n")).where("n > 1")
    mapping = settled(keyed.join(least, "key").where("addr <> new").select(F.col("addr").alias("old"), "new"))
    return space if mapping.isEmpty() else _merged(space, mapping)


def _merged(space: Space, mapping: DataFrame) -> Space:
    """Without the old rows of (old, new), which have the content of the new ones, and with those in their places."""
    kept = space.expr.join(small_side(mapping.select(F.col("old").alias("addr"))), "addr", "left_anti")
    return Space(settled(_swapped(kept, mapping)[0]), strict=space.strict)


def substitute(space: Space, mapping: DataFrame) -> Space:
    """(old, new): one address in place of another wherever it is a child; rows that become equal are merged."""
    return dedupe(*_local(space, *_swapped(space.expr, mapping)))


def replace_in_role(space: Space, changes: DataFrame) -> Space:
    """(host, role, ix, new): another occupant for single roles. A template put into a relationship must have its arity."""
    rel = changes.join(space.expr.where("kind = 'rel'").select(F.col("addr").alias("host"), F.col("arity").alias("n")), "host")
    new = space.expr.where("kind = 'tplt'").select(F.col("addr").alias("new"), "arity")
    if not rel.join(new, "new").where("n <> arity").isEmpty():
        raise ValueError("a template's arity does not fit")
    one = settled(changes.groupBy(F.col("host").alias("addr")).agg(F.collect_list(F.struct("role", "ix", "new")).alias("c")))
    hosts = small_side(one.select("addr"))
    out = space.expr.join(hosts, "addr", "left_semi").join(one, "addr")

    def occupant(role: str, old: Column, ix=0):
        hit = F.filter("c", lambda x: (x["role"] == role) & (x["ix"] == ix))
        return F.coalesce(F.get(hit, F.lit(0))["new"], old)

    for c in ("tplt", "cap_left", "cap_right"):
        out = out.withColumn(c, occupant(c, F.col(c)))
    out = out.withColumn("members", F.transform("members", lambda x, i: occupant("member", x, i + 1)))
    out = out.withColumn("seps", F.transform("seps", lambda x, i: occupant("sep", x, i + 1)))
    rest = space.expr.join(hosts, "addr", "left_anti")
    return _local(space, rest.select(*_COLUMNS).union(out.select(*_COLUMNS)), one.select("addr"))[0]


def replace(space: Space, contents: DataFrame) -> Space:
    """Rows of the expr schema whose addresses exist: hosts keep the address and see the new content; what the old content
    held stays. Content that exists elsewhere is merged into this address.
    """
    at = settled(contents.select("addr"))
    rest = space.expr.join(small_side(at), "addr", "left_anti")
    out, above = _local(space, rest.select(*_COLUMNS).unionByName(contents.select(*_COLUMNS)), at)
    new = settled(out.expr.where("key IS NOT NULL").join(small_side(at), "addr", "left_semi").select(F.col("addr").alias("new"), "key"))
    same = out.expr.select("addr", "key").join(new, "key").where("addr <> new")
    mapping = settled(same.groupBy(F.col("addr").alias("old")).agg(F.min("new").alias("new")))
    return dedupe(out if mapping.isEmpty() else _merged(out, mapping), above)


def readdress(space: Space, mapping: DataFrame) -> Space:
    """(old, new): moves expressions to other addresses; who is displaced goes to the addresses after the greatest."""
    from ..functions.frames import dense_ids

    start = space.expr.agg(F.max("addr")).first()[0] + 1
    moved = mapping.select("old", "new")
    out = space.expr.select("addr").join(moved.select(F.col("new").alias("addr")), "addr", "left_semi").join(moved.select(F.col("old").alias("addr")), "addr", "left_anti")
    displaced = dense_ids(out, ["addr"], "new", start).select(F.col("addr").alias("old"), "new")
    every = settled(moved.union(displaced))
    expr = _swapped(space.expr, every)[0].join(every.select(F.col("old").alias("addr"), F.col("new").alias("_a")), "addr", "left").withColumn("addr", F.coalesce("_a", "addr")).drop("_a")
    return Space(settled(expr.select(*_COLUMNS)), strict=space.strict)


def separate(space: Space, tplt: DataFrame, a: DataFrame, b: DataFrame) -> tuple[Space, DataFrame]:
    """Without the relationships of the template between a and b, in either direction; those that something holds stay and are reported."""
    found = find(space, roles({"t": frame(tplt), 1: frame(a), 2: frame(b)}) | roles({"t": frame(tplt), 1: frame(b), 2: frame(a)}))
    return delete_unused(space, found)


def separate_within(space: Space, tplt: DataFrame, addrs: DataFrame) -> tuple[Space, DataFrame]:
    return separate(space, tplt, addrs, addrs)


def append_to_order(space: Space, tplt: DataFrame, ordered: DataFrame, extra: DataFrame, earlier: str = "left") -> Space:
    """ordered, extra (addr, ix): chains the extra rows after the last of the ordered ones."""
    last = ordered.select("addr", F.lit(0).alias("_part"), "ix").orderBy(F.desc("ix")).limit(1)
    rows = last.union(extra.select("addr", F.lit(1).alias("_part"), "ix"))
    return insert_chain(space, tplt, rows, "addr", F.struct("_part", "ix"), earlier=earlier)


def remove_from_order(space: Space, tplt: DataFrame, keep: DataFrame, drop: DataFrame, max_len: int | None = None) -> tuple[Space, DataFrame]:
    """Cuts ``drop`` loose from ``keep`` and from itself. If longer walks still connect the two, the space stays as it was; the
    walks (start, path) are given in either case.
    """
    new, _ = separate(space, tplt, keep, drop)
    new, _ = separate_within(new, tplt, drop)
    walks = settled(transitive.paths(new, tplt, keep, drop, "right", max_len).union(transitive.paths(new, tplt, keep, drop, "left", max_len)))
    return (new if walks.isEmpty() else space), walks
