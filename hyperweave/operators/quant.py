"""Quantified queries that keep, for each answer, the variable bindings behind it.

A query is evaluated for all bindings at once. Results have ``elt``, one column ``<v>`` for each variable that a leaf used (null: not
used), and, inside quantifiers, ``env_<v>`` for those bound variables that they depend on. Leaving a quantifier drops its env
column; its binding column stays for for_some and goes for for_all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import settled, small_side, stored
from . import search


class Query:
    pass


@dataclass(frozen=True)
class Ref:
    """A variable, as an argument of a leaf."""

    name: str


@dataclass(frozen=True)
class Find(Query):
    make: Callable  # (space, env) -> DataFrame of elt and the columns of the used variables
    uses: tuple = ()


@dataclass(frozen=True)
class Test(Query):
    compare: Callable  # (bound, elt) -> Column
    bound: object


@dataclass(frozen=True)
class VTest(Query):
    keep: Callable  # (env, results) -> the rows of env that pass
    uses: tuple
    links: Callable | None = None  # results -> pairs of values of the used variables that can pass


@dataclass(frozen=True)
class And(Query):
    parts: tuple


@dataclass(frozen=True)
class Or(Query):
    parts: tuple


@dataclass(frozen=True)
class ForSome(Query):
    name: str
    source: str
    query: Query


@dataclass(frozen=True)
class ForAll(Query):
    name: str
    source: str
    condition: Query | None
    query: Query


def find(term: search.Term) -> Query:
    """A search whose variables are bound by quantifiers."""
    names = tuple(sorted(search.variables(term)))

    def make(space, env):
        return search.find(space, term, env if names else None).withColumnRenamed("addr", "elt")

    return Find(make, names)


def find_values(values) -> Query:
    """Fixed elements: a list, or a DataFrame with the column elt."""
    if isinstance(values, DataFrame):
        return Find(lambda space, env: values.select("elt").distinct())
    kind_of = "elt long" if not values or isinstance(values[0], int) else "elt string"
    return Find(lambda space, env: getattr(space, "spark", getattr(space, "sparkSession", None)).createDataFrame([(v,) for v in dict.fromkeys(values)], kind_of))


def find_with(make: Callable) -> Query:
    """A function of the space alone: make(space) -> DataFrame with the column elt."""
    return Find(lambda space, env: make(space).select("elt").distinct())


def find_from(links: Callable, start) -> Query:
    """What a start leads to: links(space) -> DataFrame (src, dst); the start is a value or a Ref."""
    if isinstance(start, Ref):
        return Find(lambda space, env: env.select(start.name).distinct().join(links(space), F.col(start.name) == F.col("src")).select(F.col("dst").alias("elt"), start.name).distinct(), (start.name,))
    return Find(lambda space, env: links(space).where(F.col("src") == F.lit(start)).select(F.col("dst").alias("elt")).distinct())


def test(compare: Callable[[Column, Column], Column], bound) -> Query:
    """Keeps elements for which compare(bound, elt) holds; ``bound`` is a value or a Ref."""
    return Test(compare, bound)


def vtest(compare: Callable[[Column, Column], Column], a, b) -> Query:
    """Compares two variables or values."""
    col = lambda x: F.col(x.name) if isinstance(x, Ref) else F.lit(x)
    return VTest(lambda env, results: env.where(compare(col(a), col(b))), tuple(x.name for x in (a, b) if isinstance(x, Ref)))


def led_to(inner: str, input_name: str, outer: str, output_name: str) -> Query:
    """Whether the value of variable ``inner`` is among those that, as ``input_name``, led to the value of ``outer`` in the result ``output_name``."""

    def links(results):
        known = results[output_name]
        if input_name not in known.columns:
            raise ValueError(f"{output_name} was not found by use of {input_name}")
        return known.select(F.col(input_name).alias(inner), F.col("elt").alias(outer)).distinct()

    return VTest(lambda env, results: env.join(links(results), [inner, outer], "left_semi"), (inner, outer), links)


def and_(*parts: Query) -> Query:
    if not any(kind(p) == "find" for p in parts) and any(kind(p) == "test" for p in parts) and not all(kind(p) == "test" for p in parts):
        raise ValueError("a conjunction needs a find, or tests alone, or variable tests alone")
    return And(parts)


def or_(*parts: Query) -> Query:
    if len({kind(p) for p in parts}) != 1:
        raise ValueError("all branches of or_ must be of one kind")
    return Or(parts)


def for_some(name: str, source: str, query: Query) -> Query:
    return ForSome(name, source, query)


def for_all(name: str, source: str, query: Query, condition: Query | None = None) -> Query:
    if condition is not None and kind(condition) != "vtest":
        raise ValueError("a condition tests variables")
    return ForAll(name, source, condition, query)


def kind(q: Query) -> str:
    """find, test or vtest."""
    if isinstance(q, Find | Test | VTest):
        return type(q).__name__.lower()
    if isinstance(q, ForSome | ForAll):
        return kind(q.query)
    kinds = [kind(p) for p in q.parts]
    return "find" if "find" in kinds else "test" if "test" in kinds else "vtest"


def check(steps: list[tuple[str, Query]]) -> None:
    """Sources come before their use; only introduced variables are used; none is introduced within its own scope."""
    known: set[str] = set()

    def walk(q: Query, scope: set[str]) -> None:
        used = q.uses if isinstance(q, Find | VTest) else (q.bound.name,) if isinstance(q, Test) and isinstance(q.bound, Ref) else ()
        if missing := set(used) - scope:
            raise ValueError(f"variables are not bound: {sorted(missing)}")
        if isinstance(q, And | Or):
            for p in q.parts:
                walk(p, scope)
        if isinstance(q, ForSome | ForAll):
            if q.source not in known:
                raise ValueError(f"source {q.source} is not an earlier step")
            if q.name in scope:
                raise ValueError(f"variable {q.name} is bound already")
            if isinstance(q, ForAll) and q.condition is not None:
                walk(q.condition, scope | {q.name})
            walk(q.query, scope | {q.name})

    for name, q in steps:
        if kind(q) != "find":
            raise ValueError(f"step {name} finds nothing: it only tests")
        walk(q, set())
        known.add(name)


def _bindings(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "elt" and not c.startswith("env_")]


def _envs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("env_")]


def _aligned(frames: list[DataFrame]) -> list[DataFrame]:
    """All with the same binding columns, null where a frame has none."""
    types = {c: t for f in frames for c, t in f.dtypes}
    names = sorted({c for f in frames for c in _bindings(f)})
    return [f.select(*_envs(f), "elt", *(F.col(n) if n in f.columns else F.lit(None).cast(types[n]).alias(n) for n in names)) for f in frames]


def reconcile(frames: list[DataFrame]) -> DataFrame:
    """For each element (and env) in all frames: the unions of bindings, one from each, that agree wherever both are bound.

    Frames whose bindings of an element are the same set count once. Rows that bind every variable that both sides have meet by the
    values of those variables, too, so that only rows with an unbound one are paired with all of an element's others.
    """
    if not frames:
        raise ValueError("nothing to reconcile")
    known = [set(_bindings(f)) for f in frames]
    out, *rest = _aligned([f.distinct() if len(frames) == 1 else stored(f.distinct()) for f in frames])  # each is read several times
    names, keys = _bindings(out), [*_envs(out), "elt"]
    for i, f in enumerate(rest, 1):
        if not names:
            out = out.join(f, keys, "left_semi")
            continue
        same = _same(out, f.select(*out.columns), keys, names)
        r = f.select(*keys, *(F.col(n).alias(f"_{n}") for n in names))
        r = r if same is None else r.join(same, keys, "left_anti")
        both = sorted(set.union(*known[:i]) & known[i])
        merged = lambda d: d.select(*keys, *(F.coalesce(n, f"_{n}").alias(n) for n in names))
        if not both:
            mixed = merged(out.join(r, keys))
        else:
            bound = lambda prefix: reduce(lambda a, b: a & b, (F.col(f"{prefix}{n}").isNotNull() for n in both))
            agree = reduce(lambda a, b: a & b, (F.col(n).isNull() | F.col(f"_{n}").isNull() | (F.col(n) == F.col(f"_{n}")) for n in both))
            full, r_full = out.where(bound("")), r.where(bound("_"))
            byvalue = full.join(r_full.select(*keys, *(F.col(f"_{n}").alias(n) for n in both), *(f"_{n}" for n in names if n not in both)), [*keys, *both])
            parts = []
            # Where no row has an unbound one, the others are not moved to meet it.
            if not out.where(~bound("")).isEmpty():
                parts.append(out.where(~bound("")).join(r, keys).where(agree))
            if not r.where(~bound("_")).isEmpty():
                parts.append(full.join(r.where(~bound("_")), keys).where(agree))
            # The columns that rows met by stay as they are, so that equal rows are in one place already.
            met = byvalue.select(*keys, *(F.col(n) if n in both else F.coalesce(n, f"_{n}").alias(n) for n in names))
            mixed = reduce(DataFrame.union, map(merged, parts), met)
        out = (mixed if same is None else mixed.union(out.join(same, keys, "left_semi").select(*keys, *names))).distinct()
        out = stored(out) if f is not rest[-1] else out
    return out


def _same(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> DataFrame | None:
    """The elements for which both hold the same set of bindings, some with an unbound variable; None if there are none.

    Sets whose bindings are all bound need no such care: they meet by value and stay as they are.
    """
    loose = reduce(lambda x, y: x | y, (F.col(n).isNull() for n in names))
    if a.where(loose).isEmpty() or b.where(loose).isEmpty():
        return None
    maybe = a.where(loose).select(*keys).distinct().join(b.where(loose), keys, "left_semi")
    a, b = (x.join(maybe, keys, "left_semi") for x in (a, b))
    odd = a.subtract(b).union(b.subtract(a)).select(*keys)  # a row of one is missing in the other
    same = settled(maybe.join(odd, keys, "left_anti"))
    return None if same.isEmpty() else same


class Env:
    """The bindings around a query: every combination of the rows of its factors, which are never paired unless a test compares them.

    factors: DataFrames over disjoint sets of variables; guards: DataFrames without which (if empty) there is no binding at all.
    """

    def __init__(self, factors: tuple = (), guards: tuple = ()):
        self.factors, self.guards = factors, guards

    def extended(self, name: str, values: DataFrame) -> Env:
        """values: distinct ``elt``."""
        return Env((*self.factors, values.select(F.col("elt").alias(name))), self.guards)

    def touching(self, names) -> list[DataFrame]:
        return [f for f in self.factors if set(f.columns) & set(names)]

    def of(self, names, links: DataFrame | None = None) -> DataFrame:
        """The bindings of these variables, with those that theirs are tied to. links: pairs of values that are to be bound together."""
        out, *rest = self.touching(names)
        if links is not None:
            out = out.join(links, [c for c in links.columns if c in out.columns])
        for f in rest:
            shared = [c for c in f.columns if c in out.columns]
            out = out.join(f, shared) if shared else out.crossJoin(f)  # compared by a test: an equality makes this a hash join
        return out

    def replaced(self, rows: DataFrame) -> Env:
        """Factors that share a variable with ``rows`` give way to it."""
        old = self.touching(rows.columns)
        return Env((*(f for f in self.factors if not any(f is o for o in old)), rows), self.guards)

    def without(self, name: str) -> Env:
        """One variable less: what is left of its factor's rows, or a guard that there are any."""
        (own,) = self.touching([name])
        others = tuple(f for f in self.factors if f is not own)
        if own.columns == [name]:
            return Env(others, (*self.guards, own))
        return Env((*others, own.drop(name).distinct()), self.guards)

    def kept(self, rows: DataFrame) -> DataFrame:
        """``rows``, unless a guard is empty."""
        for g in self.guards:
            rows = rows.where(g.limit(1).exists())
        return rows


class Runner:
    def __init__(self, space, results: dict[str, DataFrame], spark):
        self.space, self.results, self.spark, self.ranges = space, results, spark, {}

    def _range(self, source: str) -> DataFrame:
        """The distinct elements of an earlier step, settled as they are read several times; few are sent to the facts, not the facts to them."""
        if source not in self.ranges:
            self.ranges[source] = small_side(settled(self.results[source].select("elt").distinct()))
        return self.ranges[source]

    def _attached(self, rows: DataFrame, env: Env, names) -> DataFrame:
        """``rows`` with env columns for these variables and those that theirs are tied to; rows that bind some of them meet their own values."""
        for f in env.touching(names):
            named = f.select(*(F.col(c).alias(f"env_{c}") for c in f.columns))
            shared = [c for c in named.columns if c in rows.columns]
            rows = rows.join(named, shared) if shared else rows.crossJoin(named)  # what a query does not use holds for every value
        return rows

    def _restricted(self, rows: DataFrame, env: Env, before: Env) -> DataFrame:
        """``rows`` that agree with what tests have taken from ``before``."""
        changed = [f for f in env.factors if not any(f is g for g in before.factors)]
        for f in changed:
            rows = self._attached(rows, env, f.columns)
        return Env(guards=tuple(g for g in env.guards if not any(g is h for h in before.guards))).kept(rows)

    def found(self, q: Query, env: Env) -> DataFrame:
        """elt, the bindings, and env columns of the variables that the findings depend on: whatever else is bound, they are the same."""
        if isinstance(q, Find):
            if not q.uses:
                return env.kept(q.make(self.space, env))
            bound = env.of(q.uses)
            out = q.make(self.space, bound)
            if len(q.uses) > 1:
                out = out.join(bound.select(*q.uses).distinct(), list(q.uses), "left_semi")
            return env.kept(out.select("*", *(F.col(u).alias(f"env_{u}") for u in q.uses)))
        if isinstance(q, And):
            plain = [p for p in q.parts if isinstance(p, VTest) and p.uses and p.links is None]
            inner = reduce(lambda e, p: self.passing(p, e), (p for p in q.parts if kind(p) == "vtest" and p not in plain), env)
            out = reconcile(self._alike([self.found(p, inner) for p in q.parts if kind(p) == "find"]))
            for p in plain:
                columns = [f"env_{u}" for u in p.uses]
                if set(columns) <= set(out.columns):  # what was found together is compared; the ranges are not paired
                    met = out.select(*(F.col(f"env_{u}").alias(u) for u in p.uses)).distinct()
                    out = out.join(p.keep(met, self.results).select(*(F.col(u).alias(f"env_{u}") for u in p.uses)), columns, "left_semi")
                else:
                    inner = self.passing(p, inner)
            for p in q.parts:
                if kind(p) == "test":
                    out = self.tested(p, out, inner)
            return self._restricted(out, inner, env)
        if isinstance(q, Or):
            parts = [self.found(p, env) for p in q.parts]
            names = sorted({c[4:] for p in parts for c in _envs(p)})
            parts = _aligned([self._attached(p, env, [n for n in names if f"env_{n}" not in p.columns]) for p in parts])
            return reduce(DataFrame.unionByName, parts).distinct()
        inner = env.extended(q.name, self._range(q.source))
        column = f"env_{q.name}"
        if isinstance(q, ForSome):
            got = self.found(q.query, inner)
            if column not in got.columns:
                got = Env(guards=(inner.factors[-1],)).kept(got)
            return got.drop(column).distinct()
        first = inner
        if q.condition is not None:
            inner = self.passing(q.condition, inner)
        got = self._restricted(self.found(q.query, inner), inner, first)
        if column not in got.columns:
            got = self._attached(got, inner, [q.name])
        return self._divided(got.drop(q.name) if q.name in _bindings(got) else got, inner, q.name)

    def _alike(self, frames: list[DataFrame]) -> list[DataFrame]:
        """Findings of a conjunction with the same env columns: each meets the values with which the others found its elements."""
        out = []
        for i, f in enumerate(frames):
            for j, g in enumerate(frames):
                new = [c for c in _envs(g) if c not in f.columns]
                if i != j and new:
                    shared = [c for c in _envs(g) if c in f.columns]
                    f = f.join(g.select("elt", *shared, *new).distinct(), ["elt", *shared])
            out.append(f)
        order = _envs(out[0])
        return [f.select("elt", *order, *_bindings(f)) for f in out]

    def _divided(self, got: DataFrame, env: Env, name: str) -> DataFrame:
        """Elements found for every value of the variable, with the unions of their bindings that agree across all values.

        Division by counts: an element stays if it was found for as many values as there are.
        """
        column = f"env_{name}"
        (own,) = env.touching([name])
        tied = [f"env_{c}" for c in own.columns if c != name]
        total = own.select(*(F.col(c).alias(f"env_{c}") for c in own.columns))
        if tied:
            total = total.groupBy(*tied).agg(F.count_distinct(column).alias("_all"))
        else:
            total = total.agg(F.count_distinct(column).alias("_all"))
        got = settled(got.distinct())
        outer = [c for c in _envs(got) if c != column]
        bound = _bindings(got)

        def whole(d: DataFrame) -> DataFrame:
            return d.join(total, tied).where("_n = _all") if tied else d.where(F.col("_n") == total.scalar())

        if not bound:
            n = got.groupBy(*outer, "elt").agg(F.count_distinct(column).alias("_n"))
            return whole(n).select(*outer, "elt")
        some_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in bound))
        per = whole(got.groupBy(*outer, "elt").agg(F.count_distinct(column).alias("_n"), F.max(some_null).alias("_loose"))).select(*outer, "elt", "_loose")
        left = got.join(per, [*outer, "elt"])
        # Bindings without an unbound variable agree if they are equal: those found for every value stay.
        plain = whole(left.where("NOT _loose").groupBy(*outer, "elt", *bound).agg(F.count_distinct(column).alias("_n"))).select(*outer, "elt", *bound)
        b = F.struct(*bound)
        sets = left.where("_loose").groupBy(*outer, "elt", column).agg(F.sort_array(F.collect_set(b)).alias("_s"))
        per = sets.groupBy(*outer, "elt").agg(F.collect_set("_s").alias("_sets"))

        def merged(x, y):
            agree = reduce(lambda p, q: p & q, (x[c].isNull() | y[c].isNull() | (x[c] == y[c]) for c in bound))
            return F.when(agree, F.struct(*(F.coalesce(x[c], y[c]).alias(c) for c in bound)))

        fold = F.reduce(
            F.slice("_sets", F.lit(2), F.greatest(F.size("_sets") - 1, F.lit(0))),
            F.element_at("_sets", 1),
            lambda acc, s: F.array_distinct(F.flatten(F.transform(acc, lambda x: F.filter(F.transform(s, lambda y: merged(x, y)), lambda z: z.isNotNull())))),
        )
        folded = per.select(*outer, "elt", F.explode(fold).alias("_b")).select(*outer, "elt", *(F.col(f"_b.{c}").alias(c) for c in bound)).distinct()
        return plain.union(folded)

    def tested(self, q: Query, rows: DataFrame, env: Env) -> DataFrame:
        """Found rows that pass a testlike query, with the variables that it used as bindings."""
        if isinstance(q, Test):
            if not isinstance(q.bound, Ref):
                return rows.where(q.compare(F.lit(q.bound), F.col("elt")))
            name, column = q.bound.name, f"env_{q.bound.name}"
            rows = rows if column in rows.columns else self._attached(rows, env, [name])
            return rows.where(q.compare(F.col(column), F.col("elt"))).withColumn(name, F.col(column))
        if isinstance(q, And):
            inner = env
            for p in q.parts:
                if kind(p) == "test":
                    rows = self.tested(p, rows, inner)
                else:
                    inner = self.passing(p, inner)
            return self._restricted(rows, inner, env)
        if isinstance(q, Or):
            parts = [self.tested(p, rows, env) for p in q.parts]
            names = sorted({c[4:] for p in parts for c in _envs(p)})
            return reduce(DataFrame.unionByName, _aligned([self._attached(p, env, [n for n in names if f"env_{n}" not in p.columns]) for p in parts])).distinct()
        column = f"env_{q.name}"
        first = env.extended(q.name, self._range(q.source))
        if isinstance(q, ForSome):
            got = self.tested(q.query, rows, first)
            return (got if column in got.columns else self._attached(got, first, [q.name])).drop(column).distinct()
        inner = first if q.condition is None else self.passing(q.condition, first)
        wide = Env(guards=tuple(inner.guards[len(first.guards) :])).kept(self._attached(rows, inner, [q.name]))
        before = [c for c in wide.columns if c != column]
        need = wide.groupBy(*before).agg(F.count_distinct(column).alias("_all"))
        after = self.tested(q.query, wide, inner)
        after = after.drop(q.name) if q.name in _bindings(after) else after
        rest = [c for c in after.columns if c != column]
        have = after.groupBy(*rest).agg(F.count_distinct(column).alias("_n"))
        same = reduce(lambda a, b: a & b, (have[c].eqNullSafe(need[c]) for c in before if c in rest))
        return have.join(need, same).where("_n = _all").select(*(have[c] for c in rest))

    def passing(self, q: Query, env: Env) -> Env:
        """The bindings that a variable test lets pass. for_all over nothing passes."""
        if isinstance(q, VTest):
            if not q.uses:
                return Env(env.factors, (*env.guards, q.keep(self.space_row(), self.results)))
            links = q.links(self.results) if q.links else None
            return env.replaced(q.keep(env.of(q.uses, links), self.results))
        if isinstance(q, And):
            return reduce(lambda e, p: self.passing(p, e), q.parts, env)
        if isinstance(q, Or):
            parts = [self.passing(p, env) for p in q.parts]
            names = sorted({c for p in parts for f in p.factors if not any(f is g for g in env.factors) for c in f.columns})
            if not names:
                return env if any(len(p.guards) == len(env.guards) for p in parts) else parts[0]
            columns = [c for f in env.touching(names) for c in f.columns]
            return env.replaced(reduce(DataFrame.union, [p.kept(p.of(columns)).select(*columns) for p in parts]).distinct())
        wide = env.extended(q.name, self._range(q.source))
        if isinstance(q, ForSome):
            return self.passing(q.query, wide).without(q.name)
        if q.condition is not None:
            wide = self.passing(q.condition, wide)
        good = self.passing(q.query, wide)
        changed = {c for f in good.factors if not any(f is g for g in wide.factors) for c in f.columns}
        columns = [c for f in wide.touching({q.name, *changed}) for c in f.columns]
        columns = [c for f in wide.touching(columns) for c in f.columns]
        failing = wide.kept(wide.of(columns)).join(good.kept(good.of(columns)).select(*columns), columns, "left_anti")
        outer = [c for c in columns if c != q.name]
        if not outer:
            return Env(env.factors, (*env.guards, self.space_row().where(~failing.limit(1).exists())))
        return env.replaced(env.of(outer).join(failing.select(*outer).distinct(), outer, "left_anti"))

    def space_row(self) -> DataFrame:
        """One row without a variable."""
        return self.spark.createDataFrame([(1,)], "_one int")


def run_program(space, steps: list[tuple[str, Query]], spark=None) -> dict[str, DataFrame]:
    """Runs named steps in order; each can draw on the ones before. Each result has ``elt`` and the variables behind it.

    A quantifier's range is the distinct elements of an earlier step. Ranges are not paired with each other: a search meets the range
    of the variables that it uses in a join by their values.
    """
    check(steps)
    spark = spark or space.spark
    results: dict[str, DataFrame] = {}
    for name, q in steps:
        results[name] = Runner(space, results, spark).found(q, Env()).distinct()
    return results


def bindings_to_results(bindings: DataFrame, name: str) -> DataFrame:
    """Bindings (one column for each variable) as results keyed on one variable."""
    return bindings.where(F.col(name).isNotNull()).withColumnRenamed(name, "elt").distinct()


def consistent_bindings(results: dict[str, DataFrame], given: dict[str, DataFrame]) -> DataFrame:
    """The bindings, across several results, that led to the elements given for each: results[name] restricted to given[name] (elt), reconciled."""
    frames = [results[n].join(g.select("elt"), "elt", "left_semi").withColumn("_", F.lit(0)).drop("elt").withColumnRenamed("_", "elt").distinct() for n, g in given.items()]
    return reconcile(frames).drop("elt")
