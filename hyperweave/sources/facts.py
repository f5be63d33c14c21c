"""Bulk load of facts: each row of a table becomes a statement, nested as deep as its pattern is.

A pattern is built from P (a phrase from a column or a literal) and R (a relationship: a template's text and a pattern for each
``_``). Patterns are static, so the digest of every sub-expression is one column expression; statements are merged by digest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dense_ids, kept_at, measured_broadcasts, settled
from .space import EXPR, Space, phrase_key, rel_key, template_key, template_parts, tplt_key


@dataclass(frozen=True)
class P:
    """A phrase: a Column, or a literal string."""

    text: Column | str

    def column(self) -> Column:
        return F.lit(self.text) if isinstance(self.text, str) else self.text.cast("string")

    def key(self):
        return phrase_key(self.text) if isinstance(self.text, str) else phrase_key(self.column())


@dataclass(frozen=True)
class T:
    """A template, as a member."""

    text: str

    def key(self):
        return template_key(self.text)


class R:
    """A relationship."""

    def __init__(self, template: str, *members):
        left, seps, right = template_parts(template)
        self.template = template
        self.members = tuple(P(m) if isinstance(m, str | Column) else m for m in members)
        if len(self.members) != len(seps) + 1:
            raise ValueError(f"{template!r} takes {len(seps) + 1} members, not {len(self.members)}")

    def key(self):
        return rel_key(template_key(self.template), [m.key() for m in self.members])


def _postorder(pattern) -> list[tuple]:
    """(kind, key, details) of each sub-expression: template first, then members left to right, then the relationship."""
    if isinstance(pattern, P):
        return [("phrase", pattern.key(), pattern)]
    if isinstance(pattern, T):
        left, seps, right = template_parts(pattern.text)
        parts = [x for x in (left, *seps, right) if x is not None]
        return [*(("phrase", phrase_key(x), P(x)) for x in parts), ("tplt", pattern.key(), (left, seps, right))]
    out = _postorder(T(pattern.template))
    for m in pattern.members:
        out += _postorder(m)
    return [*out, ("rel", pattern.key(), pattern)]


#: Keys of one load that may be broadcast to the scan of what is there: some 20 MB.
LOOKUP_KEYS = 200_000

_NODE = ["key", "kind", "arity", "phrase", "tplt_key", "member_keys", "left_key", "sep_keys", "right_key"]


_NODE_TYPE = "struct<key:string,kind:string,arity:int,phrase:string,tplt_key:string,member_keys:array<string>,left_key:string,sep_keys:array<string>,right_key:string,step:int>"


def _node(step: int, kind: str, key, x) -> Column:
    """One sub-expression as a struct of _NODE_TYPE."""
    lit = lambda k: F.lit(k) if isinstance(k, str | None) else k
    arity, phrase, tplt, members, left, seps, right = 0, None, None, None, None, None, None
    if kind == "phrase":
        phrase = x.column()
    elif kind == "tplt":
        cap = lambda c: None if c is None else phrase_key(c)
        arity, left, right = len(x[1]) + 1, cap(x[0]), cap(x[2])
        seps = F.array(*(F.lit(phrase_key(s)) for s in x[1]))
    else:
        arity, tplt, members = len(x.members), template_key(x.template), F.array(*(lit(m.key()) for m in x.members))
    return F.struct(*(lit(v) if not isinstance(v, int) else F.lit(v) for v in (key, kind, arity, phrase, tplt, members, left, seps, right, step))).cast(_NODE_TYPE)


def nodes(df: DataFrame, pattern, order: Column | None = None) -> DataFrame:
    """Every sub-expression of every statement, not yet merged, with ``stmt`` and ``step``, its place in the order of insertion.

    One scan of the table yields all nodes of its rows. Constant ones come from its first row alone, unless an order is given.
    """
    base = df.withColumn("_stmt", order.cast("long") if order is not None else F.monotonically_increasing_id())
    steps = [(isinstance(key, str), _node(step, kind, key, x)) for step, (kind, key, x) in enumerate(_postorder(pattern))]

    def exploded(rows: DataFrame, found: list[Column]) -> DataFrame:
        return rows.select("_stmt", F.explode(F.array(*found)).alias("_n")).where("_n.key IS NOT NULL").select(*(F.col(f"_n.{c}").alias(c) for c in _NODE), F.col("_stmt").alias("stmt"), F.col("_n.step").alias("step"))

    if order is not None:
        return exploded(base, [n for _, n in steps])
    constant, varying = [n for c, n in steps if c], [n for c, n in steps if not c]
    parts = [exploded(rows, found) for rows, found in ((base, varying), (base.limit(1), constant)) if found]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _merged(parts: DataFrame) -> DataFrame:
    rest = [c for c in _NODE if c != "key"]
    return parts.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("stmt", "step")).alias("n"), F.min(F.struct("stmt", "step")).alias("o")).select("key", *(F.col(f"n.{c}") for c in rest), "o.stmt", "o.step")


def hash_address(key, moved: dict[str, int] | None = None, bits: int = 64):
    """An address that follows from the content alone. moved: the addresses of those keys whose hash another key has."""
    hashed = F.shiftright(F.xxhash64(key), 64 - bits) if bits < 64 else F.xxhash64(key)
    if not moved:
        return hashed
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in moved.items() for x in pair)), key), hashed)


#: Keys that may be moved out of the way of others: among 10^11 expressions some hundreds are expected.
MOST_MOVED = 10_000


def moved_keys(keys: DataFrame, bits: int = 64) -> dict[str, int]:
    """For distinct keys (key): those that share their hash with a lesser key, each with an address that no key hashes to."""
    hashed = keys.select("key", hash_address(F.col("key"), bits=bits).alias("addr"))
    least = hashed.groupBy("addr").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = [r["key"] for r in hashed.join(least, "addr").where("key <> first").select("key").limit(MOST_MOVED + 1).collect()]
    if len(late) > MOST_MOVED:
        raise ValueError("too many keys share their hashes; load() numbers expressions densely")
    if not late:
        return {}
    spark, moved, trial = keys.sparkSession, {}, 0
    while left := sorted(set(late) - moved.keys()):
        tried = spark.createDataFrame([(k, trial) for k in left], "key string, trial int").select("key", F.xxhash64("key", "trial").alias("addr"))
        free = tried.join(hashed.select("addr"), "addr", "left_anti").collect()
        for r in sorted(free):
            if r["addr"] not in moved.values():
                moved[r["key"]] = r["addr"]
        trial += 1
    return moved


def _relationships(pattern):
    """The R nodes of a pattern."""
    if isinstance(pattern, R):
        yield pattern
        for m in pattern.members:
            yield from _relationships(m)


def stated_rels(statements, key: str, constants: dict[int, tuple[str, str | None]], address=hash_address) -> DataFrame | None:
    """(host, m1, m2, ...): addresses of the relationships of one template and of their members; rows may repeat.

    Only tables whose statements hold the template are read. constants: member number -> (key, text if it is a phrase) that it must be;
    a phrase is compared in the table's own column, so that the condition reaches the scan. None if no table states the template.
    """
    out = None
    for df, pattern in statements:
        for r in _relationships(pattern):
            if template_key(r.template) != key:
                continue
            rows, possible = df, True
            for i, m in enumerate(r.members, 1):
                wanted, own = constants.get(i), m.key()
                if isinstance(own, str):
                    possible &= wanted is None or wanted[0] == own
                elif wanted is None:
                    rows = rows.where(m.column().isNotNull() if isinstance(m, P) else own.isNotNull())
                elif isinstance(m, P) and wanted[1] is not None:
                    rows = rows.where(m.column() == F.lit(wanted[1]))
                else:
                    rows = rows.where(own == F.lit(wanted[0]))
            at = lambda k: address(F.lit(k) if isinstance(k, str) else k)
            found = rows.where(F.lit(possible)).select(at(r.key()).alias("host"), *(at(m.key()).alias(f"m{i}") for i, m in enumerate(r.members, 1)))
            out = found if out is None else out.unionByName(found)
    return out


def hashed_space(*statements: tuple[DataFrame, object]) -> Space:
    """A space of (df, pattern) statements whose addresses are 64-bit hashes of the content: wholly lazy, one merge by content,
    no numbering. For loads of up to a few billion expressions; ``collision_free_space`` and ``load`` are for more.
    """
    return _addressed(statements, hash_address)


def collision_free_space(*statements: tuple[DataFrame, object], bits: int = 64) -> Space:
    """As hashed_space, but different contents never share an address: keys whose hashes meet are found first (one exchange of the
    merged keys, which are settled for it), and all but the least of them move. bits: of the hash.
    """
    moved = moved_keys(settled(_addressed(statements, hash_address).expr.select("key")), bits)
    return _addressed(statements, lambda key: hash_address(key, moved, bits))


def _leaves(pattern) -> list[P]:
    """The phrases of a pattern, left to right; those of templates are constant and left out."""
    if isinstance(pattern, R):
        return [p for m in pattern.members for p in _leaves(m)]
    return [pattern] if isinstance(pattern, P) else []


def _templates(pattern):
    """The templates of a pattern, those of its relationships among them."""
    if isinstance(pattern, R):
        yield T(pattern.template)
        for m in pattern.members:
            yield from _templates(m)
    elif isinstance(pattern, T):
        yield pattern


def _shape(pattern):
    """What a pattern states beside its phrases: expressions are the same if their shapes and the texts of their phrases are."""
    if isinstance(pattern, R):
        return template_key(pattern.template), tuple(_shape(m) for m in pattern.members)
    return template_key(pattern.text) if isinstance(pattern, T) else None


def _refilled(pattern, texts):
    """The pattern with other phrases: the next ones of the iterator."""
    if isinstance(pattern, R):
        return R(pattern.template, *[_refilled(m, texts) for m in pattern.members])
    return P(next(texts)) if isinstance(pattern, P) else pattern


def _union(parts: list[DataFrame]) -> DataFrame:
    out, *rest = parts
    for part in rest:
        out = out.union(part)
    return out


def _addressed(statements, address) -> Space:
    """One branch of rows for each kind and shape, merged by the texts of its phrases; keys and addresses are made after that.

    So an exchange carries the texts alone, and a search for a kind or a phrase leaves the other branches out or filters them at the scan.
    """
    measured_broadcasts(statements[0][0].sparkSession)
    at = lambda k: address(F.lit(k) if isinstance(k, str) else k)
    phrases, tplts, rels = [], [], {}
    for df, pattern in statements:
        found = _postorder(pattern)
        varying = [x.column() for kind, key, x in found if kind == "phrase" and not isinstance(key, str)]
        constant = sorted({x.text for kind, key, x in found if kind == "phrase" and isinstance(key, str)})
        one = df.limit(1)  # expressions without a column are stated if the table has a row
        for rows, texts in ((df, varying), (one, [F.lit(x) for x in constant])):
            if texts:
                phrases.append(rows.select(F.explode(F.array(*texts)).alias("phrase")).where("phrase IS NOT NULL"))
        for key, (left, seps, right) in {key: x for kind, key, x in found if kind == "tplt"}.items():
            cap = lambda c: F.lit(None).cast("long") if c is None else at(phrase_key(c))
            parts = F.array(*(at(phrase_key(x)) for x in seps)).cast("array<long>")
            tplts.append(one.select(F.lit(key).alias("key"), F.lit(len(seps) + 1).alias("arity"), cap(left).alias("cap_left"), parts.alias("seps"), cap(right).alias("cap_right")))
        for kind, key, x in found:
            if kind == "rel":
                texts = [p.column() for p in _leaves(x)]
                rows = (one if isinstance(key, str) else df).select(*(t.alias(f"x{i}") for i, t in enumerate(texts)), F.lit(1).alias("_x"))
                rows = rows.where(" AND ".join(["_x = 1", *(f"x{i} IS NOT NULL" for i in range(len(texts)))]))
                rels.setdefault(_shape(x), (x, []))[1].append(rows)

    def shaped(rows: DataFrame, kind: str, key, **columns) -> DataFrame:
        """All columns of an expr; key may be one already."""
        rows = rows if key is None else rows.withColumn("key", F.lit(key) if isinstance(key, str) else key)
        given = {"addr": at(F.col("key")), "kind": F.lit(kind), "key": F.col("key")} | columns
        return rows.select(*(given.get(c, F.lit(None).cast(t)).alias(c) for c, t in (x.split() for x in EXPR.split(", "))))

    out, wholes, kept = [], [], {c: F.col(c) for c in ("arity", "cap_left", "seps", "cap_right")}
    if phrases:
        out.append(shaped(_union(phrases).distinct(), "phrase", phrase_key(F.col("phrase")), arity=F.lit(0), phrase=F.col("phrase")))
    if tplts:
        out.append(shaped(_union(tplts).dropDuplicates(["key"]), "tplt", None, **kept))
    for pattern, parts in rels.values():
        merged = _union(parts).distinct()
        r = _refilled(pattern, (F.col(f"x{i}") for i in range(len(_leaves(pattern)))))
        members = F.array(*(at(m.key()) for m in r.members))
        wholes.append((r, _union(parts).withColumn("addr", at(r.key()))))
        out.append(shaped(merged, "rel", r.key(), arity=F.lit(len(r.members)), tplt=at(template_key(r.template)), members=members))
    return Space(_union(out), rels=lambda key, constants: stated_rels(statements, key, constants, address), wholes=wholes)


def read_off(space: Space, wanted: DataFrame, made: Callable, out: str) -> DataFrame:
    """(addr, out) of those expressions at ``wanted``, settled distinct addresses, whose value follows from their own phrases alone.

    For spaces made from tables: the row that states a relationship has all its phrases, however deep it nests, so nothing is joined but
    the addresses, once; few of them go to the scans. made(pattern) is the value of a pattern whose phrases are columns, or None.
    """
    of = lambda rows, value: [] if value is None else [rows.select("addr", value.alias(out))]
    parts = of(space.expr.where("kind = 'phrase'"), made(P(F.col("phrase"))))
    patterns = [pattern for pattern, _ in space.wholes]
    tplts = {template_key(t.text): t for pattern in patterns for t in _templates(pattern)}
    for key, t in tplts.items():
        parts += of(space.expr.where((F.col("kind") == "tplt") & (F.col("key") == key)), made(t))
    for pattern, rows in space.wholes:
        parts += of(rows, made(pattern))
    return kept_at(_union(parts), wanted, "addr").groupBy("addr").agg(F.first(out).alias(out))


def load_rows(expr: DataFrame, df: DataFrame, pattern, order: Column | None = None, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that the statements add to ``expr``, and (stmt, addr, is_new) of every statement. See ``load``.

    Of ``expr`` only key and addr are read, and only the rows of the statements' own keys leave the scan. start: the first
    free address, if it is known.
    """
    parts = settled(nodes(df, pattern, order))
    merged = settled(_merged(parts))
    keys = merged.select("key")
    keys = F.broadcast(keys) if keys.count() <= LOOKUP_KEYS else keys
    old = settled(expr.where("key IS NOT NULL").select("key", "addr").join(keys, "key", "left_semi").groupBy("key").agg(F.max("addr").alias("addr")))
    new = merged.join(old, "key", "left_anti")
    if start is None:
        start = (expr.agg(F.max("addr")).first()[0] if not expr.isEmpty() else -1) + 1
    numbered = settled(dense_ids(new, ["stmt", "step"], "addr", start))
    index = old.union(numbered.select("key", "addr"))

    def resolved(rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.join(index.select(F.col("key").alias(column), F.col("addr").alias(out)), column, "left").drop(column)

    def listed(column: str, out: str) -> DataFrame:
        long = numbered.select("addr", F.posexplode(column).alias("i", "k")).join(index.select(F.col("key").alias("k"), F.col("addr").alias("c")), "k")
        return long.groupBy("addr").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias(out))

    rows = numbered
    for a, b in (("tplt_key", "tplt"), ("left_key", "cap_left"), ("right_key", "cap_right")):
        rows = resolved(rows, a, b)
    rows = rows.join(listed("member_keys", "members"), "addr", "left").join(listed("sep_keys", "seps"), "addr", "left")
    rows = rows.withColumn("seps", F.when(F.col("kind") == "tplt", F.coalesce("seps", F.array().cast("array<long>"))))
    roots = parts.where(F.col("step") == len(_postorder(pattern)) - 1).select("stmt", "key")
    report = roots.join(index, "key").select("stmt", "addr", (F.col("addr") >= start).alias("is_new"))
    return settled(rows.select(*(c.split()[0] for c in EXPR.split(", ")))), report


def load(space: Space, df: DataFrame, pattern, order: Column | None = None) -> tuple[Space, DataFrame]:
    """Inserts the statements: the new space, and (stmt, addr, is_new) of every statement.

    What is there already keeps its address; the rest is numbered on from the greatest one, in the order of statements and
    within them templates first, then members, then the relationship. ``order``: a whole number for each row.
    Statements with a null in them are left out.
    """
    rows, report = load_rows(space.expr, df, pattern, order)
    return Space(settled(space.expr.unionByName(rows)), strict=space.strict), report


__all__ = ["P", "R", "T", "collision_free_space", "hashed_space", "load", "load_rows", "nodes", "hash_address", "read_off", "tplt_key"]
