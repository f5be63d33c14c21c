"""The space: facts that can be members of other facts, in two DataFrames.

expr holds one row for each expression, pos one for each child of an expression with its role there. Identity is by
structure: ``key`` is a digest of the nested content, so that a nested expression is found by one equality.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import grown, settled, small_side

EXPR = "addr long, kind string, arity int, phrase string, tplt long, members array<long>, cap_left long, seps array<long>, cap_right long, key string"
POS = ["host", "host_kind", "role", "ix", "child", "tplt"]

#: The rows of a new space.
SEED = [
    (0, "phrase", ""), (1, "phrase", "transitive"), (2, "phrase", "is"), (3, "tplt", (None, [2], None)),
    (4, "phrase", "sort by"), (5, "phrase", "before"), (6, "tplt", (4, [], None)), (7, "tplt", (4, [5], None)),
    (8, "phrase", "right first"), (9, "tplt", (4, [], 8)),
]


def phrase_key(text):
    """Of a Column or a Python string."""
    if isinstance(text, str):
        return hashlib.sha256(f"p:{text}".encode()).hexdigest()
    return F.sha2(F.concat(F.lit("p:"), text), 256)


def tplt_key(left, seps, right):
    """left, right: a key or None; seps: a list of keys. All Columns or all Python strings."""
    if all(isinstance(x, str) for x in [*seps, *(c for c in (left, right) if c is not None)]):
        return hashlib.sha256(f"t:{left or '-'}|{','.join(seps)}|{right or '-'}".encode()).hexdigest()
    col = lambda x: F.lit("-") if x is None else F.lit(x) if isinstance(x, str) else x
    return F.sha2(F.concat(F.lit("t:"), col(left), F.lit("|"), F.concat_ws(",", *map(col, seps)), F.lit("|"), col(right)), 256)


def rel_key(tplt, members):
    if isinstance(tplt, str) and all(isinstance(m, str) for m in members):
        return hashlib.sha256(f"r:{tplt}|{','.join(members)}".encode()).hexdigest()
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    listed = [x for m in members for x in (F.lit(","), col(m))][1:]
    return F.sha2(F.concat(F.lit("r:"), col(tplt), F.lit("|"), *listed), 256)  # null if a member is null


def template_parts(text: str) -> tuple[str | None, list[str], str | None]:
    """``maybe _ is _`` -> ("maybe", ["is"], None). Every ``_`` stands for a member."""
    parts = [p.strip() for p in text.split("_")]
    if len(parts) < 2:
        raise ValueError(f"a template needs at least one _: {text!r}")
    return parts[0] or None, parts[1:-1], parts[-1] or None


def template_key(text: str) -> str:
    left, seps, right = template_parts(text)
    return tplt_key(left and phrase_key(left), [*map(phrase_key, seps)], right and phrase_key(right))


#: Where the children in each role are: kind of the host, column, and whether it is a list.
ROLES = {"member": ("rel", "members", True), "tplt": ("rel", "tplt", False), "sep": ("tplt", "seps", True), "cap_left": ("tplt", "cap_left", False), "cap_right": ("tplt", "cap_right", False)}


def role_rows(expr: DataFrame, role: str) -> DataFrame:
    """The rows of positions for one role."""
    kind, column, many = ROLES[role]
    rows = expr.where((F.col("kind") == kind) & F.col(column).isNotNull())
    if many:
        rows = rows.select("addr", "kind", F.posexplode(column).alias("i", "child"), F.col("tplt").alias("t"))
        return rows.select(F.col("addr").alias("host"), F.col("kind").alias("host_kind"), F.lit(role).alias("role"), (F.col("i") + 1).alias("ix"), "child", F.col("t").alias("tplt"))
    return rows.select(F.col("addr").alias("host"), F.col("kind").alias("host_kind"), F.lit(role).alias("role"), F.lit(0).alias("ix"), F.col(column).alias("child"), "tplt")


def positions(expr: DataFrame) -> DataFrame:
    """One row for each child: host, host_kind, role, ix (0 where roles aren't numbered, else from 1), child, template of the host."""
    out, *rest = (role_rows(expr, role) for role in ROLES)
    for part in rest:
        out = out.unionByName(part)
    return out


_COLUMNS = [c.split()[0] for c in EXPR.split(", ")]


def _bottom_up(pos: DataFrame, known: DataFrame) -> DataFrame:
    """(addr, key) of ``known`` and of the hosts of ``pos`` whose children all get one: one round for each level of nesting.

    A round joins the children that got their keys in the last one; a host waits with the keys that it has until none is missing.
    """
    part = F.struct("role", "ix", "key")
    waiting = pos.groupBy("host").agg(F.first("host_kind").alias("kind"), F.count("*").cast("int").alias("missing"))
    waiting = waiting.withColumn("parts", F.array().cast("array<struct<role:string,ix:int,key:string>>"))
    frontier, rounds = known, 0

    def keys(role: str):
        return F.transform(F.filter("parts", lambda p: p["role"] == role), lambda p: p["key"])

    one = lambda role: F.coalesce(F.get(keys(role), F.lit(0)), F.lit("-"))
    rel = F.sha2(F.concat(F.lit("r:"), one("tplt"), F.lit("|"), F.array_join(keys("member"), ",")), 256)
    tplt = F.sha2(F.concat(F.lit("t:"), one("cap_left"), F.lit("|"), F.array_join(keys("sep"), ","), F.lit("|"), one("cap_right")), 256)
    while True:
        got = pos.join(frontier.select(F.col("addr").alias("child"), "key"), "child").groupBy("host").agg(F.collect_list(part).alias("new"))
        parts = F.sort_array(F.concat("parts", F.coalesce("new", F.array())))
        told = waiting.join(got, "host", "left").select("host", "kind", (F.col("missing") - F.coalesce(F.size("new"), F.lit(0))).alias("missing"), parts.alias("parts"))
        told = settled(told)
        frontier = told.where("missing = 0").select(F.col("host").alias("addr"), F.when(F.col("kind") == "rel", rel).otherwise(tplt).alias("key"))
        if frontier.isEmpty():
            return known
        known, waiting, rounds = known.union(frontier), told.where("missing > 0"), rounds + 1
        if rounds % 8 == 0:
            known = settled(known)


def _leaf_keys(expr: DataFrame) -> DataFrame:
    """(addr, key) of phrases, and of templates with neither caps nor separators: they have no children."""
    bare = F.col("kind").eqNullSafe("tplt") & (F.size("seps") == 0) & F.col("cap_left").isNull() & F.col("cap_right").isNull()
    return expr.where((F.col("kind") == "phrase") | bare).select("addr", F.when(F.col("kind") == "phrase", phrase_key(F.col("phrase"))).otherwise(F.lit(tplt_key(None, [], None))).alias("key"))


def with_keys(expr: DataFrame) -> DataFrame:
    """``expr`` with keys from its nested content, bottom up.

    Rows that refer to themselves in a circle or to absent rows keep a null key.
    """
    known = _bottom_up(settled(positions(expr)), settled(_leaf_keys(expr)))
    return expr.drop("key").join(known.dropDuplicates(["addr"]), "addr", "left").select(*_COLUMNS)


def hosts_above(expr: DataFrame, addrs: DataFrame) -> DataFrame:
    """(addr) of the rows themselves and of all that holds them at any depth, by joins of a frontier with the positions."""
    links = positions(expr).select("host", "child")
    return grown(addrs.select("addr"), lambda f: links.join(small_side(f.withColumnRenamed("addr", "child")), "child").select(F.col("host").alias("addr")), ["addr"])


def rekeyed(expr: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``expr`` with new keys where content may have changed, and the addresses (addr) whose keys were made anew.

    touched (addr): rows that are new or whose children changed. Only these and what holds them are hashed, from the keys that
    their other children have already; all other rows stay as they are.
    """
    above = settled(hosts_above(expr, touched))
    mine = small_side(above)
    own = settled(expr.join(mine, "addr", "left_semi"))
    pos = settled(positions(own))
    others = pos.select(F.col("child").alias("addr")).distinct().join(above, "addr", "left_anti")
    given = expr.where("key IS NOT NULL").select("addr", "key").join(small_side(settled(others)), "addr", "left_semi")
    known = settled(_leaf_keys(own).union(given))
    made = _bottom_up(pos, known).join(above, "addr", "left_semi").dropDuplicates(["addr"])
    new = own.drop("key").join(made, "addr", "left").select(*_COLUMNS)
    return settled(expr.join(mine, "addr", "left_anti").select(*_COLUMNS).union(new)), above


class Space:
    """expr: one row for each expression; pos: one for each child in each role, made from expr unless given.

    rels: where the space was made from tables, a function (template key, constants) -> the relationships of that template, straight from
    the tables that state them; see facts.stated_rels. wholes: then also a list of (pattern, rows), one for each shape of relationship, with
    the texts of its phrases in each row; see facts.read_off.
    """

    def __init__(self, expr: DataFrame, pos: DataFrame | None = None, strict: bool = False, rels=None, wholes=None):
        self.expr, self.strict, self.rels, self.wholes = expr, strict, rels, wholes
        self._pos = pos

    @property
    def pos(self) -> DataFrame:
        return positions(self.expr) if self._pos is None else self._pos

    def role(self, name: str) -> DataFrame:
        """The rows of pos for one role; the plan has only what that role needs."""
        return role_rows(self.expr, name) if self._pos is None else self._pos.where(F.col("role") == name)

    @property
    def spark(self) -> SparkSession:
        return self.expr.sparkSession

    def find(self, h) -> DataFrame:
        """Addresses that a search finds."""
        from ..operators.search import find

        return find(self, h)

    def cached(self) -> Space:
        """expr settled in the shared folder, for use in many searches; pos is read from it, as its rows would take more room."""
        return Space(settled(self.expr), strict=self.strict)

    def phrases(self, addrs: DataFrame, column: str = "addr", out: str = "text") -> DataFrame:
        """``addrs`` with the text of the phrase at ``column``; rows whose address is no phrase go."""
        p = self.expr.where("kind = 'phrase'").select(F.col("addr").alias(column), F.col("phrase").alias(out))
        return addrs.join(p, column)


def rows_to_expr(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (addr, 'phrase', text), (addr, 'tplt', (left, [seps], right)) or (addr, 'rel', ([members], tplt)); keys are null."""
    out = []
    for addr, kind, body in rows:
        if kind == "phrase":
            out.append((addr, kind, 0, body, None, None, None, None, None, None))
        elif kind == "tplt":
            left, seps, right = body
            out.append((addr, kind, len(seps) + 1, None, None, None, left, seps, right, None))
        else:
            members, tplt = body
            out.append((addr, kind, len(members), None, tplt, members, None, None, None, None))
    return spark.createDataFrame(out, EXPR)


def space_from_expr(expr: DataFrame, keys: bool = True) -> Space:
    """A space from rows of the expr schema; keys=False where no search by content is needed."""
    return Space(with_keys(expr) if keys else expr)


def empty_space(spark: SparkSession) -> Space:
    """The ten seed rows."""
    return space_from_expr(rows_to_expr(spark, SEED))


def content_index(space: Space) -> DataFrame:
    """key -> addr; of rows of equal content the greatest address."""
    return space.expr.where("key IS NOT NULL").groupBy("key").agg(F.max("addr").alias("addr"))


def read_space(spark: SparkSession, path: str) -> Space:
    return Space(spark.read.parquet(path))


def write_space(space: Space, path: str) -> None:
    """Replaces what is at ``path``."""
    space.expr.write.mode("overwrite").parquet(path)


#: Names of control characters in quoted strings, by their numbers.
CONTROL = ["NUL", "SOH", "STX", "ETX", "EOT", "ENQ", "ACK", "BEL", "BS", "HT", "LF", "VT", "FF", "CR", "SO", "SI", "DLE", "DC1", "DC2", "DC3", "DC4", "NAK", "SYN", "ETB", "CAN", "EM", "SUB", "ESC", "FS", "GS", "RS", "US", "SP"]
#: Escapes of one letter.
LETTERS = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "'": 39, "\\": 92}


def unquoted(text: Column) -> Column:
    """The inside of a quoted string with its escapes resolved: letters, decimal, octal (o) and hexadecimal (x) numbers, control names,
    ``^A`` and the empty ``&``."""
    named = {name: i for i, name in enumerate(CONTROL)} | {"DEL": 127} | LETTERS | {f"^{chr(64 + i)}": i for i in range(32)}
    names = "|".join(sorted(CONTROL, key=len, reverse=True))
    token = rf"\\(?:[0-9]+|x[0-9a-fA-F]+|o[0-7]+|{names}|DEL|\^[@-_]|.)|[^\\]+"
    known = F.create_map(*(F.lit(x) for pair in named.items() for x in pair))

    def resolved(t: Column) -> Column:
        body = F.substring(t, 2, 12)
        number = F.when(body.rlike("^[0-9]"), F.conv(body, 10, 10)).when(body.rlike("^x[0-9a-fA-F]"), F.conv(F.substring(body, 2, 12), 16, 10)).when(body.rlike("^o[0-7]"), F.conv(F.substring(body, 2, 12), 8, 10))
        code = F.coalesce(number.cast("long"), F.try_element_at(known, body).cast("long"))
        whole = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~t.startswith("\\"), t).when(body == "&", "").otherwise(F.coalesce(whole, body))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)" + token), F.lit(0)), resolved), "")


def read_rslt(spark: SparkSession, folder: str) -> Space:
    """A folder of ``<addr>.rslt`` text files, top level only; other files are ignored."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.rslt").text(folder)
    body = F.trim("value")
    number = lambda c: F.nullif(c, F.lit("")).cast("long")
    ints = lambda c: F.transform(F.filter(F.split(F.regexp_replace(c, r"[()\s]", ""), ","), lambda x: x != ""), lambda x: x.cast("long"))
    tplt = r"^t (Nothing|\(?Just \(?-?\d+\)*) \[([^\]]*)\] (Nothing|\(?Just \(?-?\d+\)*)"
    cap = lambda i: number(F.regexp_extract(F.regexp_extract(body, tplt, i), r"(-?\d+)", 1))
    rel = r"^r \[([^\]]*)\] \(?(-?\d+)"
    quoted = F.regexp_extract(body, r'(?s)^p "(.*)"', 1)
    text = unquoted(quoted)
    kind = F.when(body.startswith("p "), "phrase").when(body.startswith("t "), "tplt").otherwise("rel")
    rows = files.select(F.regexp_extract("_metadata.file_name", r"(-?\d+)\.rslt$", 1).cast("long").alias("addr"), kind.alias("kind"), text.alias("phrase"), cap(1).alias("cap_left"), ints(F.regexp_extract(body, tplt, 2)).alias("seps"), cap(3).alias("cap_right"), ints(F.regexp_extract(body, rel, 1)).alias("members"), number(F.regexp_extract(body, rel, 2)).alias("tplt"))
    is_ = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    arity = F.when(F.col("kind") == "phrase", 0).when(F.col("kind") == "tplt", F.size("seps") + 1).otherwise(F.size("members"))
    out = rows.select("addr", "kind", arity.alias("arity"), is_("phrase", "phrase").alias("phrase"), is_("rel", "tplt").alias("tplt"), is_("rel", "members").alias("members"), is_("tplt", "cap_left").alias("cap_left"), is_("tplt", "seps").alias("seps"), is_("tplt", "cap_right").alias("cap_right"), F.lit(None).cast("string").alias("key"))
    return space_from_expr(out)


def dump(space: Space) -> DataFrame:
    """All rows in address order."""
    return space.expr.drop("key").orderBy("addr")


def graph_from_adjacency(df: DataFrame, parent: str = "parent", children: str = "children") -> tuple[DataFrame, DataFrame]:
    """(edges (parent, child), nodes (node)); a parent without children is a node only."""
    edges = df.select(F.col(parent).alias("parent"), F.explode_outer(children).alias("child"))
    nodes = edges.select(F.col("parent").alias("node")).union(edges.where("child IS NOT NULL").select("child")).distinct()
    return edges.where("child IS NOT NULL").distinct(), nodes
