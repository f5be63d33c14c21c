"""Expressions as text, built level by level from the leaves up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.facts import P, T, read_off
from ..sources.space import Space, positions, template_parts
from .frames import settled, small_side


def hashes(depth: Column, text: Column) -> Column:
    """``text`` after ``depth`` number signs."""
    return F.concat(F.repeat(F.lit("#"), depth), text)


def parenthesised(text: Column) -> Column:
    return F.concat(F.lit("("), text, F.lit(")"))


def interleaved(a: Column, b: Column) -> Column:
    """Two arrays taken by turns, as long as both last, then the rest of the longer."""
    n = F.least(F.size(a), F.size(b))
    turns = F.flatten(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y)))
    rest = F.when(F.size(a) > n, F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))).otherwise(F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0))))
    return F.concat(turns, rest)


def replaced(items: Column, ix: int, value: Column) -> Column:
    """An array with another value at place ``ix`` (from 1)."""
    return F.transform(items, lambda x, i: F.when(i + 1 == ix, value).otherwise(x))


def split_around(items: Column, holds: Callable[[Column], Column]) -> Column:
    """An array as (before, during, after) around its one run of elements for which ``holds``; null if there are several runs."""
    marks = F.transform(items, lambda x: F.coalesce(holds(x), F.lit(False)))
    n = F.size(items)
    first = F.coalesce(F.nullif(F.array_position(marks, True), F.lit(0)), n + 1).cast("int")
    length = F.size(F.filter(marks, lambda m: m))
    during = F.slice(items, first, length)
    whole = F.struct(F.slice(items, F.lit(1), first - 1).alias("before"), during.alias("during"), F.slice(items, first + length, F.greatest(n - first - length + 1, F.lit(0))).alias("after"))
    return F.when(F.forall(F.slice(marks, first, length), lambda m: m), whole)


def substituted(text: Column, pattern: str, replacement: str) -> Column:
    """``text`` with every match of the regular expression replaced; as it is where nothing matches."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_replace(text, pattern, replacement)).otherwise(text)


def written(pattern, max_depth: int | None = None) -> tuple[Column, int, bool]:
    """(text, naked depth, whether it goes in parentheses within others) of a pattern whose phrases are columns, as ``render`` writes it."""
    if isinstance(pattern, P):
        return pattern.column(), 0, False
    if isinstance(pattern, T):
        left, seps, right = template_parts(pattern.text)
        words = [left, "_", *(x for s in seps for x in (s, "_")), right]
        return F.lit(" ".join(w for w in words if w is not None).strip(" ")), 0, max_depth is not None
    members = [written(m, max_depth) for m in pattern.members]
    depth = 1 + max(0 if wrap else naked for _, naked, wrap in members)
    texts = [parenthesised(t) if wrap else t for t, _, wrap in members]
    left, seps, right = (x if isinstance(x, list) else [x] for x in template_parts(pattern.template))
    sep = lambda s: None if s is None else F.lit("#" * depth + (f"({s})" if max_depth is not None and " " in s else s))
    turns = [x for pair in zip(texts, map(sep, [*seps, None]), strict=True) for x in pair]
    found = [x for x in (*map(sep, left), *turns, *map(sep, right)) if x is not None]
    spaced = [x for part in found for x in (F.lit(" "), part)][1:]
    return F.concat(*spaced), depth, max_depth is not None and depth >= max_depth


def render(space: Space, addrs: DataFrame, max_depth: int | None = None, as_addr: DataFrame | None = None) -> DataFrame:
    """(addr, text). Separators carry one # for each level of nesting; max_depth: relationships at least so deep go in
    parentheses, where the count starts anew. Addresses in as_addr are shown as @n. Expressions with absent parts get no row.
    In a space made from tables, texts without as_addr are written from the rows that state them.
    """
    if space.wholes is not None and as_addr is None:
        return read_off(space, settled(addrs.select("addr").distinct()), lambda pattern: written(pattern, max_depth)[0], "text")
    # What the texts need, top down: the rows of each level, and from these the addresses of the next.
    given = space.expr.select("addr", "kind", "phrase", "tplt", "members", "cap_left", "seps", "cap_right")
    need = frontier = settled(addrs.select("addr").distinct())
    rows, pos = given.where(F.lit(False)), None
    while not frontier.isEmpty():
        new = settled(given.join(small_side(frontier), "addr", "left_semi"))
        rows, inside = rows.union(new), positions(new)
        pos = inside if pos is None else pos.union(inside)
        frontier = settled(inside.select(F.col("child").alias("addr")).distinct().join(need, "addr", "left_anti"))
        need = need.union(frontier)
    if pos is None:
        return rows.select("addr", F.col("phrase").alias("text"))
    short = as_addr.select("addr", F.lit(True).alias("short")) if as_addr is not None else None

    def shown(df: DataFrame) -> DataFrame:
        """text, and the form that it takes within others."""
        if short is not None:
            df = df.join(short, "addr", "left").withColumn("text", F.when(F.col("short"), F.concat(F.lit("@"), "addr")).otherwise(F.col("text"))).drop("short")
        return settled(df.withColumn("inner", F.when(F.col("wrap"), parenthesised(F.col("text"))).otherwise(F.col("text"))))

    known = shown(rows.where("kind = 'phrase'").select("addr", F.col("phrase").alias("text"), F.lit(0).alias("naked"), F.lit(False).alias("wrap")))
    all_pos, pos = pos, pos.where("NOT (host_kind = 'rel' AND role = 'tplt')")
    counts = pos.groupBy("host").agg(F.count("*").alias("need"))
    caps = rows.where("kind = 'tplt'").select(F.col("addr").alias("tplt"), F.col("cap_left").isNotNull().alias("has_left"), F.col("cap_right").isNotNull().alias("has_right"), "cap_left", "seps", "cap_right")
    parts_of_tplt = all_pos.where("host_kind = 'tplt'").select(F.col("host").alias("tplt"), "role", "ix", F.col("child").alias("addr"))
    while True:
        child = known.select(F.col("addr").alias("child"), "inner", "naked", "wrap")
        got = pos.join(child, "child").join(known.select(F.col("addr").alias("host")), "host", "left_anti")
        one = F.struct("role", "ix", F.col("inner").alias("s"))
        level = F.max(F.when(F.col("role") == "member", F.when(F.col("wrap"), 0).otherwise(F.col("naked")))).alias("below")
        ready = got.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("parts"), level, F.first("host_kind").alias("kind")).join(counts, "host").where(F.size("parts") == F.col("need"))
        of = lambda role: F.transform(F.filter("parts", lambda p: p["role"] == role), lambda p: p["s"])
        blank = lambda a: F.filter(a, lambda s: s.isNotNull())
        tplt_text = F.array_join(F.concat(of("cap_left"), F.array(F.lit("_")), F.flatten(F.transform(of("sep"), lambda s: F.array(s, F.lit("_")))), of("cap_right")), " ")
        tplts = ready.where("kind = 'tplt'").select(F.col("host").alias("addr"), F.trim(tplt_text).alias("text"), F.lit(0).alias("naked"), F.lit(max_depth is not None).alias("wrap"))
        rels = ready.where("kind = 'rel'").join(rows.select(F.col("addr").alias("host"), "tplt"), "host")
        words = parts_of_tplt.join(known.select("addr", "inner"), "addr").groupBy("tplt").agg(F.sort_array(F.collect_list(one)).alias("tparts"))
        rels = rels.join(F.broadcast(words), "tplt").join(F.broadcast(caps), "tplt")  # templates are few
        depth = F.col("below") + 1
        sep = lambda s: hashes(depth, F.when(F.lit(max_depth is not None) & s.contains(" "), parenthesised(s)).otherwise(s))
        tof = lambda role: F.transform(F.filter("tparts", lambda p: p["role"] == role), lambda p: sep(p["s"]))
        text = F.array_join(blank(F.concat(tof("cap_left"), interleaved(of("member"), tof("sep")), tof("cap_right"))), " ")
        wrap = (depth >= max_depth) if max_depth is not None else F.lit(False)
        made = rels.select(F.col("host").alias("addr"), text.alias("text"), depth.alias("naked"), wrap.alias("wrap"))
        new = shown(tplts.union(made))
        if new.isEmpty():
            break
        known = settled(known.union(new))
    bare = rows.where("kind = 'tplt' AND size(seps) = 0 AND cap_left IS NULL AND cap_right IS NULL").select("addr", F.lit("_").alias("text"))
    return known.select("addr", "text").union(bare).join(addrs.select("addr").distinct(), "addr", "left_semi")
