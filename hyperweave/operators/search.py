"""Searches: terms that stand for sets of addresses, compiled to DataFrames.

A compiled term has the column ``addr`` and one column for each variable that the term uses; rows are distinct where sets
are asked for. Terms without variables combine by semi and anti joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.space import Space, phrase_key, rel_key, template_key, template_parts
from . import navigate, transitive


class Term:
    """A search. ``a & b``, ``a | b`` and ``a - b`` are intersection, union and difference."""

    def __and__(self, other: Term) -> Term:
        return all_of(self, other)

    def __or__(self, other: Term) -> Term:
        return any_of(self, other)

    def __sub__(self, other: Term) -> Term:
        return Diff(self, other)

    def bind(self, **terms: Term) -> Term:
        """The term with searches in place of variables."""
        return _bound(self, terms)


@dataclass(frozen=True)
class ByKey(Term):
    """One expression by its content. kind: if it is known; text: if it is a phrase."""

    key: str
    text: str | None = None
    kind: str | None = None


@dataclass(frozen=True)
class Addrs(Term):
    ranges: tuple


@dataclass(frozen=True)
class Rows(Term):
    """Addresses that are in a DataFrame already (column ``addr``)."""

    df: DataFrame


@dataclass(frozen=True)
class Any(Term):
    """A position left open."""


@dataclass(frozen=True)
class It(Term):
    """A position to be returned, optionally from among the matches of a term."""

    term: Term | None = None


@dataclass(frozen=True)
class Roles(Term):
    """Hosts that have in each role something found by that role's term. Roles: member number, 't', ('sep', n), 'cap_left', 'cap_right'."""

    roles: tuple


@dataclass(frozen=True)
class MemberOf(Term):
    term: Term
    levels: int = 1


@dataclass(frozen=True)
class Eval(Term):
    term: Term
    paths: tuple


@dataclass(frozen=True)
class All(Term):
    terms: tuple


@dataclass(frozen=True)
class Either(Term):
    terms: tuple


@dataclass(frozen=True)
class Diff(Term):
    term: Term
    less: Term


@dataclass(frozen=True)
class Var(Term):
    name: str


@dataclass(frozen=True)
class Templates(Term):
    pass


@dataclass(frozen=True)
class Reach(Term):
    templates: Term
    starts: Term
    direction: str


@dataclass(frozen=True)
class Trans(Term):
    templates: Term
    starts: Term
    ends: Term
    direction: str
    give: tuple


ANY, IT = Any(), It()


def phrase(text: str) -> Term:
    return ByKey(phrase_key(text), text, "phrase")


def template(text: str) -> Term:
    """By its text, such as ``_ is _``."""
    return ByKey(template_key(text), kind="tplt")


def addr(*parts) -> Term:
    """Addresses and inclusive ranges: addr(1, (3, 5), 8)."""
    return Addrs(tuple(p if isinstance(p, tuple) else (p, p) for p in parts))


def frame(df: DataFrame) -> Term:
    return Rows(df.select("addr"))


def roles(of: dict) -> Term:
    """Roles left to ANY are no restriction."""
    return Roles(tuple((k, v) for k, v in of.items() if not isinstance(v, Any)))


def rel(text: str, *members: Term) -> Term:
    """Relationships of the template ``text`` with these members, left to right; ANY, IT and it(...) are allowed."""
    left, seps, right = template_parts(text)
    if len(members) != len(seps) + 1:
        raise ValueError(f"{text!r} takes {len(seps) + 1} members, not {len(members)}")
    return roles({"t": template(text), **dict(enumerate(members, 1))})


def it(term: Term) -> Term:
    return It(term)


def all_of(*terms: Term) -> Term:
    if not terms:
        raise ValueError("an intersection of no sets is undefined")
    flat = tuple(x for t in terms for x in (t.terms if isinstance(t, All) else (t,)))
    return flat[0] if len(flat) == 1 else All(flat)


def any_of(*terms: Term) -> Term:
    flat = tuple(x for t in terms for x in (t.terms if isinstance(t, Either) else (t,)))
    return flat[0] if len(flat) == 1 else Either(flat)


def member_of(term: Term) -> Term:
    return MemberOf(term)


def involves(term: Term, levels: int) -> Term:
    """Hosts within this many levels of membership."""
    if levels < 1:
        raise ValueError("levels must be at least 1")
    return MemberOf(term, levels)


def var(name: str) -> Term:
    if _is_member(name) or name in ("addr", "host"):
        raise ValueError(f"{name} is no name for a variable")
    return Var(name)


def templates() -> Term:
    return Templates()


def _its(term: Term) -> tuple[Term, list[tuple]]:
    """The term without its it-marks, and the paths to them. Other operators than role maps end the walk."""
    if isinstance(term, It):
        return (term.term or ANY), [()]
    if isinstance(term, MemberOf):
        raise ValueError("member_of and involves cannot stand inside eval")
    if not isinstance(term, Roles):
        return term, []
    kept, paths = [], []
    for role, child in term.roles:
        inner, below = _its(child)
        paths += [(role, *p) for p in below]
        kept.append((role, inner))
    return roles(dict(kept)), paths


def eval_(term: Term, *paths) -> Term:
    """Sub-expressions of the matches: at the it-marks of ``term``, or at the paths given (tuples of roles, outermost first)."""
    if isinstance(term, Eval) and not paths:
        return term
    inner, found = _its(term)
    paths = tuple(map(tuple, paths)) or tuple(found)
    if not paths:
        raise ValueError("eval needs an it-mark or a path")
    return Eval(inner, paths)


def reach(term: Term) -> Term:
    """reach(rel("_ lte _", starts, ANY)) goes rightward from the starts, rel("_ lte _", ANY, starts) leftward; starts are included."""
    of = dict(term.roles) if isinstance(term, Roles) else {}
    sides = sorted(k for k in of if k in (1, 2))
    if "t" not in of or len(sides) != 1:
        raise ValueError("reach takes a binary pattern with one open member")
    return Reach(of["t"], of[sides[0]], "right" if sides == [1] else "left")


def trans(direction: str, term: Term) -> Term:
    """trans("right", rel("_ lt _", it(a), it(b))): which of a lead to some of b, and which of b are led to, as marked.

    The direction changes how the search goes, not what it finds.
    """
    of = dict(term.roles) if isinstance(term, Roles) else {}
    give = tuple(side for side, k in (("left", 1), ("right", 2)) if isinstance(of.get(k), It))
    bare = {k: (v.term if isinstance(v, It) else v) for k, v in of.items()}
    if "t" not in of or not give or any(bare.get(k) is None for k in (1, 2)):
        raise ValueError("trans takes a binary pattern with two searches, at least one of them marked by it()")
    return Trans(of["t"], bare[1], bare[2], direction, give)


def variables(term: Term) -> set[str]:
    """Free variables."""
    if isinstance(term, Var):
        return {term.name}
    out: set[str] = set()
    for value in vars(term).values():
        for x in value if isinstance(value, tuple) else (value,):
            x = x[1] if isinstance(x, tuple) and len(x) == 2 else x
            if isinstance(x, Term):
                out |= variables(x)
    return out


def _bound(term: Term, terms: dict[str, Term]) -> Term:
    if isinstance(term, Var):
        return terms.get(term.name, term)
    changed = {}
    for name, value in vars(term).items():
        if isinstance(value, Term):
            changed[name] = _bound(value, terms)
        elif name == "terms":
            changed[name] = tuple(_bound(x, terms) for x in value)
        elif name == "roles":
            changed[name] = tuple((r, _bound(x, terms)) for r, x in value)
    return replace(term, **changed) if changed else term


def _vars(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "addr"]


def _widened(df: DataFrame, names: list[str], env: DataFrame | None) -> DataFrame:
    """``df`` with columns for all the variables: what it doesn't restrict takes every value of the environment."""
    missing = [n for n in names if n not in df.columns]
    if not missing:
        return df
    shared = _vars(df)
    rest = env.select(*shared, *missing).distinct()
    return df.join(rest, shared) if shared else df.crossJoin(rest)


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    va, vb = _vars(a), _vars(b)
    if set(vb) <= set(va):
        return a.join(b, ["addr", *vb], "left_semi")
    if set(va) <= set(vb):
        return b.join(a, ["addr", *va], "left_semi")
    return a.join(b, ["addr", *(v for v in va if v in vb)]).distinct()


def _is_member(column: str) -> bool:
    """m1, m2, ...: a variable of such a name would be taken for one, so ``var`` refuses it."""
    return column[:1] == "m" and column[1:].isdigit()


ROLE_NAMES = {"t": ("tplt", 0), "cap_left": ("cap_left", 0), "cap_right": ("cap_right", 0)}


def role_of(role) -> tuple[str, int]:
    """A role as in ``pos``: name and number."""
    if isinstance(role, int):
        if role < 1:
            raise ValueError("members count from 1")
        return "member", role
    if isinstance(role, tuple):
        return role[0], role[1]
    return ROLE_NAMES[role]


class Compiler:
    def __init__(self, space: Space, env: DataFrame | None = None):
        self.space, self.env = space, env

    def __call__(self, term: Term) -> DataFrame:
        out = getattr(self, f"_{type(term).__name__}")(term)
        if self.space.strict and isinstance(term, ByKey | Addrs) and out.isEmpty():
            raise LookupError(f"{term} finds nothing")
        return out

    def _ByKey(self, t: ByKey) -> DataFrame:
        """Kind and text are conditions that reach the scan of tables; the key alone would have to be made of all rows."""
        rows = self.space.expr if t.kind is None else self.space.expr.where(F.col("kind") == t.kind)
        rows = rows if t.text is None else rows.where(F.col("phrase") == t.text)
        return rows.where(F.col("key") == t.key).select("addr")

    def _Addrs(self, t: Addrs) -> DataFrame:
        condition = F.lit(False)
        for low, high in t.ranges:
            condition |= F.col("addr").between(low, high)
        return self.space.expr.where(condition).select("addr")

    def _Rows(self, t: Rows) -> DataFrame:
        return t.df

    def _Any(self, t: Any) -> DataFrame:
        raise ValueError("ANY alone would find everything")

    def _It(self, t: It) -> DataFrame:
        if t.term is None:
            raise ValueError("IT stands inside eval_ or trans only")
        return self(t.term)

    def _Templates(self, t: Templates) -> DataFrame:
        return self.space.expr.where("kind = 'tplt'").select("addr")

    def _Var(self, t: Var) -> DataFrame:
        if self.env is None or t.name not in self.env.columns:
            raise ValueError(f"variable {t.name} is not bound")
        return self.env.select(F.col(t.name).alias("addr"), t.name).distinct()

    def _stated(self, t: Term) -> DataFrame | None:
        """The relationships (host, m1, m2, ..., variables) that a role map finds, straight from the tables that state them.

        For maps of members under one named template, in spaces made from tables: a table that states the template is scanned once,
        with the map's constants as filters, and nothing is merged or looked up in the whole space. Else None.
        """
        of = dict(t.roles) if isinstance(t, Roles) else {}
        tplt = of.pop("t", None)
        if self.space.rels is None or self.space.strict or not isinstance(tplt, ByKey) or not all(isinstance(r, int) for r in of):
            return None
        rows = self.space.rels(tplt.key, {r: (c.key, c.text) for r, c in of.items() if isinstance(c, ByKey)})
        if rows is None or any(f"m{r}" not in rows.columns for r in of):
            return None
        for role, child in of.items():
            if not isinstance(child, ByKey):
                found = self(child).withColumnRenamed("addr", f"m{role}")
                names = [v for v in found.columns if v != f"m{role}"]
                rows = rows.join(found, [f"m{role}", *(v for v in names if v in rows.columns)], "inner" if names else "left_semi")
        return rows

    def _unstated(self, t: Term) -> bool:
        """Whether the space was made from tables none of which states the named template of a role map, so that nothing is found."""
        tplt = dict(t.roles).get("t") if isinstance(t, Roles) else None
        return self.space.rels is not None and not self.space.strict and isinstance(tplt, ByKey) and not variables(t) and self.space.rels(tplt.key, {}) is None

    def _Roles(self, t: Roles) -> DataFrame:
        """The template restricts member rows through their own ``tplt`` column, so its popular rows are never joined."""
        if self._unstated(t):
            return self.space.expr.where(F.lit(False)).select("addr")
        stated = self._stated(t)
        if stated is not None:
            return stated.select(F.col("host").alias("addr"), *(c for c in stated.columns if c != "host" and not _is_member(c))).distinct()
        of = dict(t.roles)
        tplt = self(of.pop("t")) if "t" in of else None
        out = None
        for role, child in of.items():
            name, ix = role_of(role)
            rows = self.space.role(name).where(F.col("ix") == ix)
            if tplt is not None and name == "member":
                known = F.broadcast(tplt.withColumnRenamed("addr", "tplt"))
                rows = rows.join(known, "tplt") if _vars(tplt) else rows.join(known, "tplt", "left_semi")
            rows = rows.select(F.col("host").alias("_host"), F.col("child").alias("addr"), *(_vars(tplt) if tplt is not None and name == "member" else ()))
            found = self(child)
            shared = [v for v in _vars(found) if v in rows.columns]
            hit = rows.join(found, ["addr", *shared]) if _vars(found) else rows.join(found, "addr", "left_semi")
            hosts = hit.select(F.col("_host").alias("addr"), *(c for c in hit.columns if c not in ("addr", "_host"))).distinct()
            out = hosts if out is None else _meet(out, hosts)
        if tplt is not None and (out is None or not any(role_of(r)[0] == "member" for r in of)):
            rels = self.space.expr.where("kind = 'rel'").select("addr", "tplt")
            known = F.broadcast(tplt.withColumnRenamed("addr", "tplt"))
            mine = rels.join(known, "tplt") if _vars(tplt) else rels.join(known, "tplt", "left_semi")
            mine = mine.drop("tplt").distinct()
            out = mine if out is None else _meet(out, mine)
        return self.space.expr.where(F.lit(False)).select("addr") if out is None else out

    def _MemberOf(self, t: MemberOf) -> DataFrame:
        found = self(t.term)
        extra = _vars(found)
        out = navigate.member_hosts(self.space, found, extra)
        frontier = seen = out
        for _ in range(t.levels - 1):
            frontier = navigate.member_hosts(self.space, frontier, extra).join(seen, ["addr", *extra], "left_anti")
            seen = seen.union(frontier.select(*seen.columns))
        return seen.distinct()

    def _Eval(self, t: Eval) -> DataFrame:
        if self._unstated(t.term):
            return self.space.expr.where(F.lit(False)).select("addr")
        stated = self._stated(t.term) if all(len(p) == 1 and isinstance(p[0], int) for p in t.paths) else None
        if stated is not None and all(f"m{p[0]}" in stated.columns for p in t.paths):
            names = [c for c in stated.columns if c != "host" and not _is_member(c)]
            members = F.explode(F.array(*(F.col(f"m{p[0]}") for p in t.paths))) if len(t.paths) > 1 else F.col(f"m{t.paths[0][0]}")
            return stated.select(members.alias("addr"), *names).distinct()
        hosts = self(t.term)
        return navigate.sub_exprs(self.space, hosts, t.paths, strict=self.space.strict).drop("host").distinct()

    def _All(self, t: All) -> DataFrame:
        out, *rest = map(self, t.terms)
        for x in rest:
            out = _meet(out, x)
        return out.distinct()

    def _Either(self, t: Either) -> DataFrame:
        parts = [self(x) for x in t.terms]
        if not parts:
            return self.space.expr.where(F.lit(False)).select("addr")
        names = sorted({v for p in parts for v in _vars(p)})
        out, *rest = (_widened(p, names, self.env).select("addr", *names) for p in parts)
        for p in rest:
            out = out.union(p)
        return out.distinct()

    def _Diff(self, t: Diff) -> DataFrame:
        a, b = self(t.term), self(t.less)
        a = _widened(a, _vars(b), self.env)
        return a.join(b, ["addr", *_vars(b)], "left_anti").distinct()

    def _plain(self, term: Term) -> DataFrame:
        out = self(term)
        if _vars(out):
            raise ValueError("variables cannot stand inside reach or trans; bind them first")
        return out

    def _Reach(self, t: Reach) -> DataFrame:
        return transitive.reach(self.space, self._plain(t.templates), self._plain(t.starts), t.direction)

    def _Trans(self, t: Trans) -> DataFrame:
        pairs = transitive.reach_pairs(self.space, self._plain(t.templates), self._plain(t.starts), self._plain(t.ends), t.direction)
        out = None
        for side in t.give:
            part = pairs.select(F.col(side).alias("addr"))
            out = part if out is None else out.union(part)
        return out.distinct()


def find(space: Space, term: Term, env: DataFrame | None = None) -> DataFrame:
    """Addresses found, with the columns of the variables that the term uses."""
    return Compiler(space, env)(term).distinct()


def first(space: Space, term: Term) -> DataFrame:
    """The least address found."""
    return find(space, term).orderBy("addr").limit(1)


def find_text(space: Space, term: Term) -> DataFrame:
    """Addresses found, with their texts."""
    from ..functions.render import render

    return render(space, find(space, term))


def matches(space: Space, addrs: DataFrame, term: Term) -> DataFrame:
    """Which of ``addrs`` the search finds."""
    return addrs.join(find(space, term), "addr", "left_semi")


def transitive_rels(space: Space) -> DataFrame:
    """Relationships whose template is declared transitive."""
    declared = eval_(rel("_ is _", IT, phrase("transitive")))
    return space.expr.where("kind = 'rel'").join(F.broadcast(find(space, declared & templates()).withColumnRenamed("addr", "tplt")), "tplt", "left_semi").select("addr")


def match_counts(space: Space, addrs: DataFrame, searches: dict[str, Term], name: str = "it") -> DataFrame:
    """For each address the number of matches of each search, with the variable ``name`` bound to the address."""
    env = addrs.select(F.col("addr").alias(name)).distinct()
    out = addrs.select("addr").distinct()
    for column, term in searches.items():
        found = find(space, term, env)
        if name not in found.columns:
            found = env.crossJoin(found)
        n = found.groupBy(F.col(name).alias("addr")).agg(F.count_distinct(found["addr"]).alias(column))
        out = out.join(n, "addr", "left")
    return out.fillna(0, list(searches))


def resolve(space: Space, *keys: str) -> DataFrame:
    """Addresses of expressions given by content key (phrase_key, template_key, rel_key)."""
    return space.expr.where(F.col("key").isin(*keys)).select("key", "addr")


def expression_key(pattern) -> str:
    """The key of a nested literal: a phrase string, or (template text, member, ...)."""
    return phrase_key(pattern) if isinstance(pattern, str) else rel_key(template_key(pattern[0]), [expression_key(m) for m in pattern[1:]])
