"""Queries over facts made from the star schema, with the SQL that they must agree with. Results are texts, never addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render as text
from ..operators import check, edit, navigate, order, quant, relation, search, transitive
from ..operators.quant import Ref
from ..operators.search import ANY, IT, eval_, find, it, phrase, rel, template
from ..sources import facts, space
from ..sources.facts import R, hashed_space
from . import star

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Parts of the SQL that several oracles share.
_IN = """in_(a, b) AS (
  SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'customer:' || c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'supplier:' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_PRECEDES = """p(a, b) AS (
  SELECT 'conv:' || conv_id || '/' || turn, 'conv:' || conv_id || '/' || nxt FROM (
    SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE nxt IS NOT NULL)"""
_SUPPLIES = "s(a, b) AS (SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _texts(s: space.Space, df: DataFrame, **columns: str) -> DataFrame:
    """Phrase texts in place of addresses: out=column."""
    for out, column in columns.items():
        df = s.phrases(df, column, out)
    return df.select(*columns, *(c for c in df.columns if c not in columns and c not in columns.values()))


def _t(s: space.Space, name: str) -> DataFrame:
    return find(s, template(name))


def _one(s: space.Space, name: str) -> DataFrame:
    return find(s, phrase(name))


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def search_eval(spark: SparkSession, d: str) -> DataFrame:
    s = hashed_space(star.nation_in_region(spark, d))
    return _texts(s, find(s, eval_(rel("_ in _", IT, phrase("ASIA")))), name="addr")


@query(f"WITH {_IN} SELECT count(*) AS n FROM in_")
def search_wildcards(spark, d):
    s = star.places(spark, d)
    return find(s, rel("_ in _", ANY, ANY)).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'part:' || l_partkey AS part FROM lineitem WHERE l_suppkey = 7")
def search_three_roles(spark, d):
    s = hashed_space(star.order_contains(spark, d))
    return _texts(s, find(s, eval_(rel("_ contains _ from _", ANY, IT, phrase("supplier:7")))), part="addr")


@query("SELECT DISTINCT 'customer:' || o_custkey AS who, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def search_nested_eval(spark, d):
    """Sub-expressions two levels deep, with the day beside them."""
    s = hashed_space(star.placed_on(spark, d))
    hosts = find(s, rel("_ on _", rel("_ placed by _", ANY, ANY), ANY))
    who = navigate.sub_exprs(s, hosts, [(1, 2)]).select("host", F.col("addr").alias("who"))
    day = navigate.sub_exprs(s, hosts, [(2,)]).select("host", F.col("addr").alias("day"))
    both = _texts(s, who.join(day, "host").select("who", "day"), who_text="who", day_text="day")
    return both.select(F.col("who_text").alias("who"), F.col("day_text").alias("day")).distinct()


@query("SELECT DISTINCT 'order:' || o_orderkey AS placed FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def search_inner_search(spark, d):
    """A role filled by what another search returns."""
    s = hashed_space(star.customer_in_nation(spark, d), star.order_placed_by(spark, d))
    mine = eval_(rel("_ in _", IT, phrase("NATION_3")))
    return _texts(s, find(s, eval_(rel("_ placed by _", IT, mine))), placed="addr")


@query("SELECT 'customer:' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1' AND c_custkey BETWEEN 1 AND 1000")
def search_restricted_it(spark, d):
    s = star.places(spark, d)
    few = s.expr.where("kind = 'phrase' AND phrase LIKE 'customer:%' AND try_cast(substr(phrase, 10) AS long) BETWEEN 1 AND 1000")
    return _texts(s, find(s, eval_(rel("_ in _", it(search.frame(few)), phrase("NATION_1")))), name="addr")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE b = 'part:1' INTERSECT SELECT a FROM s WHERE b = 'part:2'")
def search_and(spark, d):
    s = hashed_space(star.supplies(spark, d))
    return _texts(s, find(s, eval_(rel("_ supplies _", IT, phrase("part:1"))) & eval_(rel("_ supplies _", IT, phrase("part:2")))), name="addr")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE b = 'part:1' UNION SELECT a FROM s WHERE b = 'part:2'")
def search_or(spark, d):
    s = hashed_space(star.supplies(spark, d))
    return _texts(s, find(s, eval_(rel("_ supplies _", IT, phrase("part:1"))) | eval_(rel("_ supplies _", IT, phrase("part:2")))), name="addr")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE b = 'part:1' EXCEPT SELECT a FROM s WHERE b = 'part:2'")
def search_diff(spark, d):
    s = hashed_space(star.supplies(spark, d))
    return _texts(s, find(s, eval_(rel("_ supplies _", IT, phrase("part:1"))) - eval_(rel("_ supplies _", IT, phrase("part:2")))), name="addr")


@query(f"WITH {_IN} SELECT a || ' #in ' || b AS fact FROM in_ WHERE a = 'NATION_2' OR b = 'NATION_2'")
def search_member_of(spark, d):
    s = star.places(spark, d).cached()
    return search.find_text(s, search.member_of(phrase("NATION_2"))).select(F.col("text").alias("fact"))


@query("""SELECT 'order:' || o_orderkey || ' #placed by customer:5' AS fact FROM orders WHERE o_custkey = 5
UNION SELECT 'order:' || o_orderkey || ' #placed by customer:5 ##on ' || strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_custkey = 5""")
def search_involves(spark, d):
    s = hashed_space(star.placed_on(spark, d))
    return search.find_text(s, search.involves(phrase("customer:5"), 2)).select(F.col("text").alias("fact"))


@query("SELECT * FROM (VALUES ('_ in _'), ('_ supplies _')) AS t(name)")
def search_templates(spark, d):
    s = hashed_space(star.nation_in_region(spark, d), star.supplies(spark, d))
    return text.render(s, find(s, search.templates())).select(F.col("text").alias("name"))


@query(f"WITH {_SUPPLIES} SELECT DISTINCT a AS name FROM s WHERE b IN (SELECT b FROM s WHERE a = 'supplier:1') AND a IN ('supplier:2', 'supplier:3', 'supplier:4')")
def search_matches(spark, d):
    s = hashed_space(star.supplies(spark, d))
    probe = s.expr.where(F.col("phrase").isin("supplier:2", "supplier:3", "supplier:4")).select("addr")
    same = eval_(rel("_ supplies _", IT, eval_(rel("_ supplies _", phrase("supplier:1"), IT))))
    return _texts(s, search.matches(s, probe, same), name="addr")


@query(f"WITH {_IN} SELECT count(*) AS n FROM in_")
def search_transitive_rels(spark, d):
    s = hashed_space(star.nation_in_region(spark, d), star.customer_in_nation(spark, d), star.supplier_in_nation(spark, d), star.order_placed_by(spark, d), *star.declared(spark, "_ in _"))
    return search.transitive_rels(s).agg(F.count("*").alias("n"))


@query(f"WITH {_IN} SELECT r_name AS name, count(a) AS here FROM region LEFT JOIN in_ ON b = r_name GROUP BY 1 UNION SELECT n_name, count(a) FROM nation LEFT JOIN in_ ON b = n_name GROUP BY 1")
def aggregate_match_counts(spark, d):
    """For each place the number of facts that put something in it: a correlated search, run once for all places."""
    s = star.places(spark, d)
    where = s.expr.where("phrase LIKE 'NATION%' OR (kind = 'phrase' AND phrase NOT LIKE '%:%' AND phrase <> 'in')").select("addr")
    return _texts(s, search.match_counts(s, where, {"here": rel("_ in _", ANY, search.var("it"))}), name="addr")


@query(f"WITH {_IN} SELECT CAST(count(DISTINCT a) AS BIGINT) AS n_left, count(DISTINCT b) AS n_right, count(*) AS n FROM in_")
def source_positions(spark, d):
    s = star.places(spark, d)
    m = s.pos.where("role = 'member'")
    count = lambda i: F.count_distinct(F.when(F.col("ix") == i, F.col("child")))
    return m.agg(count(1).alias("n_left"), count(2).alias("n_right"), F.count_distinct("host").alias("n"))


@query(f"""WITH {_IN} SELECT 'phrase' AS kind, 0 AS arity, (SELECT count(*) FROM (SELECT a FROM in_ UNION SELECT b FROM in_ UNION SELECT 'in')) AS n
UNION ALL SELECT 'tplt', 2, 1 UNION ALL SELECT 'rel', 2, (SELECT count(*) FROM in_)""")
def source_kinds(spark, d):
    s = star.places(spark, d)
    return navigate.variety(s, s.expr).groupBy("kind", "arity").agg(F.count("*").alias("n"))


@query("SELECT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b, 'supplier:' || l_suppkey AS c FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def navigate_children(spark, d):
    s = hashed_space(star.order_contains(spark, d))
    c = navigate.children(s, find(s, rel("_ contains _ from _", ANY, ANY, ANY))).where("role = 'member'")
    wide = c.groupBy("addr").agg(*(F.max(F.when(F.col("ix") == i, F.col("child"))).alias(f"x{i}") for i in (1, 2, 3))).drop("addr")
    return _texts(s, wide, a="x1", b="x2", c="x3")


@query(f"WITH {_IN} SELECT 1 AS ix, count(*) AS n FROM in_ WHERE a LIKE 'NATION%' UNION ALL SELECT 2, count(*) FROM in_ WHERE b LIKE 'NATION%'")
def navigate_hosts(spark, d):
    s = star.places(spark, d)
    nations = s.expr.where("phrase LIKE 'NATION%'").select("addr")
    return navigate.hosts(s, nations).where("role = 'member'").groupBy("ix").agg(F.count("*").alias("n"))


@query(f"""WITH {_IN} SELECT b AS name, list_sort(list(DISTINCT a))[1] AS first, CAST(count(DISTINCT a) AS INTEGER) AS n FROM in_ WHERE b LIKE 'NATION%' GROUP BY 1""")
def navigate_host_groups(spark, d):
    """Facts that hold a nation as second member, grouped by role and template."""
    s = star.places(spark, d)
    nations = s.expr.where("phrase LIKE 'NATION%'").select("addr")
    g = navigate.host_rows(s, nations).where("group = 'member' AND ix = 2").select("addr", "host")
    left = s.pos.where("role = 'member' AND ix = 1").select("host", "child")
    named = _texts(s, g.join(left, "host").select("addr", "child"), name="addr", who="child")
    return named.groupBy("name").agg(F.min("who").alias("first"), F.count_distinct("who").cast("int").alias("n"))


@query("SELECT 'order:' || o_orderkey AS a, 'customer:' || o_custkey AS b, strftime(o_orderdate, '%Y-%m-%d') AS c FROM orders")
def navigate_flatten(spark, d):
    s = hashed_space(star.placed_on(spark, d))
    flat = navigate.flatten_phrases(s, find(s, rel("_ on _", ANY, ANY)))
    return flat.select(*(F.element_at("phrases", i).alias(c) for i, c in enumerate("abc", 1)))


@query("SELECT 0 AS depth, (SELECT count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders) + 4 AS n UNION ALL SELECT 1, count(*) FROM orders UNION ALL SELECT 2, count(*) FROM orders")
def navigate_depth(spark, d):
    s = hashed_space(star.placed_on(spark, d))
    return navigate.with_depth(s).groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT 'member:00001' AS step, count(*) AS n FROM orders UNION ALL SELECT 'member:00002', count(*) FROM orders")
def navigate_unnest(spark, d):
    s = hashed_space(star.order_placed_by(spark, d))
    tree = navigate.unnest(s, find(s, rel("_ placed by _", ANY, ANY)))
    return tree.where("kind = 'phrase' AND size(path) = 1").groupBy(F.element_at("path", 1).alias("step")).agg(F.count("*").alias("n"))


@query(f"WITH {_PRECEDES} SELECT a AS name, b AS next FROM p WHERE a LIKE 'conv:1%'")
def navigate_neighbors(spark, d):
    s = hashed_space(star.precedes(spark, d))
    mine = s.expr.where("phrase LIKE 'conv:1%'").select("addr")
    return _texts(s, transitive.neighbors(s, _t(s, "_ precedes _"), mine, "right"), name="addr", next="neighbor")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE a IN ('supplier:1', 'supplier:2', 'supplier:999999') GROUP BY a")
def navigate_using_template(spark, d):
    s = hashed_space(star.supplies(spark, d))
    probe = s.expr.where(F.col("phrase").isin("supplier:1", "supplier:2", "supplier:999999")).select("addr")
    return _texts(s, navigate.using_template(s, probe, _t(s, "_ supplies _")), name="addr")


@query("SELECT r_regionkey AS child_key, list_sort(list(n_nationkey))[1] AS first, CAST(count(*) AS INTEGER) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def graph_inverted(spark, d):
    n = star.table(spark, d, "nation").select(F.col("n_nationkey").alias("parent"), F.array("n_regionkey").alias("children"))
    edges, _ = space.graph_from_adjacency(n)
    return edges.groupBy(F.col("child").alias("child_key")).agg(F.min("parent").alias("first"), F.count("*").cast("int").alias("n"))


@query("SELECT DISTINCT o_custkey AS parent, o_orderkey AS child FROM orders")
def graph_children(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.array("o_orderkey").alias("children"))
    edges, nodes = space.graph_from_adjacency(o)
    return navigate.graph_children(edges, nodes)


@query(f"WITH RECURSIVE {_IN}, r(x) AS (SELECT 'ASIA' UNION SELECT a FROM in_ JOIN r ON b = x) SELECT x AS name FROM r")
def transitive_reach(spark, d):
    s = star.places(spark, d).cached()
    return _texts(s, find(s, search.reach(rel("_ in _", ANY, phrase("ASIA")))), name="addr")


@query(f"WITH RECURSIVE {_IN}, r(s, x) AS (SELECT a, b FROM in_ UNION SELECT s, b FROM in_ JOIN r ON a = x) SELECT s AS name, x AS place FROM r WHERE s LIKE 'supplier:%' AND x IN (SELECT r_name FROM region)")
def transitive_pairs(spark, d):
    s = star.places(spark, d).cached()
    suppliers = s.expr.where("phrase LIKE 'supplier:%'").select("addr")
    regions = find(s, eval_(rel("_ in _", search.frame(s.expr.where("phrase LIKE 'NATION%'")), IT)))
    return _texts(s, transitive.reach_pairs(s, _t(s, "_ in _"), suppliers, regions, "left"), name="left", place="right")


@query(f"WITH RECURSIVE {_IN}, r(x) AS (SELECT 'ASIA' UNION SELECT a FROM in_ JOIN r ON b = x) SELECT x AS name FROM r WHERE x LIKE 'supplier:%'")
def transitive_trans(spark, d):
    s = star.places(spark, d).cached()
    suppliers = search.frame(s.expr.where("phrase LIKE 'supplier:%'"))
    return _texts(s, find(s, search.trans("right", rel("_ in _", it(suppliers), phrase("ASIA")))), name="addr")


@query(f"WITH RECURSIVE {_PRECEDES}, n(x) AS (SELECT a FROM p UNION SELECT b FROM p), r(s, x) AS (SELECT x, x FROM n UNION SELECT s, b FROM p JOIN r ON a = x) SELECT s AS name, x AS later FROM r")
def transitive_closure(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    turns = find(s, eval_(rel("_ precedes _", IT, IT)))
    return _texts(s, transitive.closure(s, _t(s, "_ precedes _"), turns), name="left", later="right")


@query(f"WITH RECURSIVE {_PRECEDES}, r(s, x, n) AS (SELECT a, b, 2 FROM p WHERE a LIKE '%/0' UNION ALL SELECT s, b, n + 1 FROM p JOIN r ON a = x) SELECT s AS name, n AS length FROM r WHERE x LIKE '%/3'")
def transitive_paths(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    ends = lambda x: s.expr.where(f"phrase LIKE 'conv:%/{x}'").select("addr")
    found = transitive.paths(s, _t(s, "_ precedes _"), ends(0), ends(3))
    return _texts(s, found.select("start", F.size("path").alias("length")), name="start")


@query("SELECT 'user:' || user_id AS name, CAST(3 + user_id % 2 AS INTEGER) AS length FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def transitive_cycles(spark, d):
    """Each user follows itself by way of one stand-in, or of two where its number is odd, so every one lies on a circle."""
    users = star.table(spark, d, "events").select("user_id").distinct()
    user, first, second = (star.named(kind, "user_id") for kind in ("user", "double", "triple"))
    even, odd = users.where("user_id % 2 = 0"), users.where("user_id % 2 = 1")
    follows = lambda x, y: R("_ follows _", x, y)
    s = hashed_space((users, follows(user, first)), (even, follows(first, user)), (odd, follows(first, second)), (odd, follows(second, user))).cached()
    found = transitive.cycles(s, _t(s, "_ follows _"), s.expr.where("phrase LIKE 'user:%'").select("addr"))
    return _texts(s, found.select("start", F.size("path").alias("length")), name="start")


@query("SELECT false AS precedes_cycle")
def transitive_has_cycle(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    return spark.createDataFrame([(order.has_cycle(s, _t(s, "_ precedes _")),)], "precedes_cycle boolean")


@query(f"WITH RECURSIVE {_PRECEDES}, r(x, n) AS (SELECT a, 0 FROM p WHERE a NOT IN (SELECT b FROM p) UNION ALL SELECT b, n + 1 FROM p JOIN r ON a = x) SELECT x AS name, CAST(max(n) AS INTEGER) AS level, false AS is_isolated FROM r GROUP BY 1")
def order_topological(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    turns = find(s, eval_(rel("_ precedes _", IT, IT)))
    return _texts(s, order.topo_sort(s, _t(s, "_ precedes _"), turns), name="addr")


@query(f"WITH {_PRECEDES} SELECT a AS name FROM p EXCEPT SELECT b FROM p")
def order_tops(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    return _texts(s, order.tops(s, _t(s, "_ precedes _"), find(s, eval_(rel("_ precedes _", IT, IT)))), name="addr")


@query(f"WITH {_PRECEDES} SELECT b AS name, a AS under FROM p")
def order_just_under(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    turns = find(s, eval_(rel("_ precedes _", IT, IT)))
    return _texts(s, order.just_under(s, _t(s, "_ precedes _"), turns, "right").withColumnRenamed("under", "next"), name="addr", under="next")


@query("SELECT 'customer:' || c_custkey AS name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_related FROM customer")
def order_related(spark, d):
    s = hashed_space(star.customer_in_nation(spark, d), star.order_placed_by(spark, d))
    mine = s.expr.where("phrase LIKE 'customer:%'").join(find(s, eval_(rel("_ in _", IT, ANY))), "addr", "left_semi").select("addr")
    return _texts(s, order.related(s, _t(s, "_ placed by _"), mine), name="addr")


@query("SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def quant_or(spark, d):
    s = hashed_space(star.nation_in_region(spark, d))
    q = quant.or_(quant.find(eval_(rel("_ in _", IT, phrase("ASIA")))), quant.find(eval_(rel("_ in _", IT, phrase("EUROPE")))))
    return _texts(s, quant.run_program(s, [("x", q)])["x"], name="elt")


@query(f"WITH {_SUPPLIES} SELECT DISTINCT y.a AS name, y.b AS by_part FROM s AS x JOIN s AS y ON x.b = y.b WHERE x.a = 'supplier:1' AND y.a <> 'supplier:1'")
def quant_for_some(spark, d):
    """Suppliers that share some part with supplier:1, each with the parts behind it."""
    s = hashed_space(star.supplies(spark, d))
    parts = quant.find(eval_(rel("_ supplies _", phrase("supplier:1"), IT)))
    others = quant.for_some("part", "parts", quant.find(eval_(rel("_ supplies _", IT, search.var("part")))))
    mine = quant.run_program(s, [("parts", parts), ("who", others)])["who"]
    return _texts(s, mine, name="elt", by_part="part").where("name <> 'supplier:1'")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE b IN ('part:1', 'part:2') GROUP BY a HAVING count(DISTINCT b) = 2")
def quant_for_all(spark, d):
    """Suppliers of every part of {1, 2}."""
    s = hashed_space(star.supplies(spark, d))
    parts = quant.find(phrase("part:1") | phrase("part:2"))
    every = quant.for_all("p", "parts", quant.find(eval_(rel("_ supplies _", IT, search.var("p")))))
    return _texts(s, quant.run_program(s, [("parts", parts), ("who", every)])["who"], name="elt")


@query(f"WITH {_SUPPLIES} SELECT DISTINCT x.a AS name, x.b AS p, y.b AS q FROM s AS x JOIN s AS y ON x.a = y.a AND x.b < y.b WHERE x.b IN ('part:1', 'part:2', 'part:3') AND y.b IN ('part:1', 'part:2', 'part:3')")
def quant_and_vtest(spark, d):
    """Suppliers of two of three parts, with the two: finds reconciled, variables compared."""
    s = hashed_space(star.supplies(spark, d))
    parts = quant.find(phrase("part:1") | phrase("part:2") | phrase("part:3"))
    one = lambda v: quant.find(eval_(rel("_ supplies _", IT, search.var(v))))
    both = quant.for_some("p", "parts", quant.for_some("q", "parts", quant.and_(quant.vtest(lambda a, b: a != b, Ref("p"), Ref("q")), one("p"), one("q"))))
    out = quant.run_program(s, [("parts", parts), ("who", both)])["who"]
    named = _texts(s, out, name="elt", p_text="p", q_text="q").where("p_text < q_text")
    return named.select("name", F.col("p_text").alias("p"), F.col("q_text").alias("q"))


@query(f"WITH {_SUPPLIES} SELECT b AS name FROM s WHERE a = 'supplier:1' AND b <> 'part:1'")
def quant_test(spark, d):
    s = hashed_space(star.supplies(spark, d))
    one = quant.find(phrase("part:1"))
    rest = quant.for_some("not", "one", quant.and_(quant.find(eval_(rel("_ supplies _", phrase("supplier:1"), IT))), quant.test(lambda bound, elt: bound != elt, Ref("not"))))
    # Without part:1 in the table there is nothing to differ from.
    return _texts(s, quant.run_program(s, [("one", one), ("x", rest)])["x"].select("elt"), name="elt")


@query("SELECT DISTINCT 'user:' || user_id AS name FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def quant_led_to(spark, d):
    """Provenance: which users led to the event type that comes first."""
    s = hashed_space(star.did(spark, d))
    users = quant.find(eval_(rel("_ did _", IT, ANY)))
    acts = quant.for_some("u", "users", quant.find(eval_(rel("_ did _", search.var("u"), IT))))
    out = quant.run_program(s, [("users", users), ("acts", acts)])["acts"]
    named = _texts(s, out, act="elt", name="u")
    least = named.agg(F.min("act").alias("act"))
    return named.join(F.broadcast(least), "act").select("name").distinct()  # one row


@query("""SELECT (SELECT count(*) FROM (SELECT n_name FROM nation UNION SELECT r_name FROM region)) + (SELECT count(*) FROM nation) + 12 AS n_rows,
(SELECT count(*) FROM nation) AS n_facts, (SELECT count(*) FROM nation) AS n_new""")
def edit_load(spark, d):
    """Dense numbering on top of the seed rows: in, _ in _, the places, the facts."""
    rows, pattern = star.nation_in_region(spark, d)
    s, report = facts.load(space.empty_space(spark), rows, pattern, F.col("n_nationkey"))
    top = navigate.max_addr(s).select(F.col("next_addr").alias("n_rows"))
    return top.crossJoin(report.agg(F.count("*").alias("n_facts"), F.count_if("is_new").alias("n_new")))  # one row each


@query("SELECT (SELECT count(*) FROM nation) AS n_facts, CAST(0 AS BIGINT) AS n_new")
def edit_load_twice(spark, d):
    rows, pattern = star.nation_in_region(spark, d)
    s, _ = facts.load(space.empty_space(spark), rows, pattern, F.col("n_nationkey"))
    _, report = facts.load(s, rows, pattern, F.col("n_nationkey"))
    return report.agg(F.count("*").alias("n_facts"), F.count_if("is_new").alias("n_new"))


@query("SELECT a, lead(a) OVER (PARTITION BY r ORDER BY k) AS b FROM (SELECT n_name AS a, n_regionkey AS r, n_nationkey AS k FROM nation) QUALIFY b IS NOT NULL")
def edit_insert_chain(spark, d):
    """Nations chained by key within each region."""
    n = star.table(spark, d, "nation")
    s, _ = facts.load(space.empty_space(spark), n, R("_ then _", F.col("n_name"), F.lit("end")), F.col("n_nationkey"))
    rows = s.expr.where("kind = 'phrase'").join(n, F.col("phrase") == F.col("n_name")).select("addr", "n_regionkey", "n_nationkey")
    s = edit.insert_chain(s, _t(s, "_ then _"), rows, "addr", "n_nationkey", ["n_regionkey"])
    pairs = transitive.edges(s, _t(s, "_ then _"))
    return _texts(s, pairs.select("src", "dst"), a="src", b="dst").where("b <> 'end'")


@query("SELECT n_name AS name, r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def edit_delete(spark, d):
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    s, _ = edit.delete_unused(s, find(s, rel("_ in _", ANY, phrase("ASIA"))))
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT n_name AS name, CASE r_name WHEN 'ASIA' THEN 'EUROPE' ELSE r_name END AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_substitute(spark, d):
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    mapping = _one(s, "ASIA").select(F.col("addr").alias("old")).crossJoin(_one(s, "EUROPE").select(F.col("addr").alias("new")))
    s = edit.substitute(s, mapping)
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT n_name AS name, CASE n_name WHEN 'NATION_0' THEN 'ASIA' ELSE r_name END AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_replace_in_role(spark, d):
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    host = find(s, rel("_ in _", phrase("NATION_0"), ANY)).select(F.col("addr").alias("host"), F.lit("member").alias("role"), F.lit(2).alias("ix"))
    s = edit.replace_in_role(s, host.crossJoin(_one(s, "ASIA").select(F.col("addr").alias("new"))))
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT n_name AS name, r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' OR n_nationkey % 2 = 1")
def edit_separate(spark, d):
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    even = s.expr.where("phrase LIKE 'NATION%' AND try_cast(substr(phrase, 8) AS long) % 2 = 0").select("addr")
    s, _ = edit.separate(s, _t(s, "_ in _"), _one(s, "ASIA"), even)
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT CAST(0 AS BIGINT) AS n_absent, CAST(0 AS BIGINT) AS n_misfit, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_twice")
def check_reports(spark, d):
    """All integrity reports over the facts of orders, which are whole."""
    s = hashed_space(star.placed_on(spark, d), star.customer_in_nation(spark, d))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(check.absent_children(s), "n_absent")
    for df, name in ((check.misfit_rels(s), "n_misfit"), (check.null_templates(s), "n_null"), (check.duplicate_content(s), "n_twice")):
        out = out.crossJoin(n(df, name))  # one row each
    return out


@query("SELECT count(*) AS n_rels FROM orders")
def check_finds_absent(spark, d):
    """Facts whose customers were removed from the space are all reported."""
    s = hashed_space(star.order_placed_by(spark, d))
    broken = space.Space(s.expr.where("phrase IS NULL OR phrase NOT LIKE 'customer:%'"))
    return check.absent_children(broken).agg(F.count("*").alias("n_rels"))


@query("SELECT 'order:' || o_orderkey || ' #placed by customer:' || o_custkey || ' ##on ' || strftime(o_orderdate, '%Y-%m-%d') AS fact FROM orders")
def render_text(spark, d):
    s = hashed_space(star.placed_on(spark, d))
    return text.render(s, find(s, rel("_ on _", ANY, ANY))).select(F.col("text").alias("fact"))


@query("SELECT '(order:' || o_orderkey || ' #(placed by) customer:' || o_custkey || ') #on ' || strftime(o_orderdate, '%Y-%m-%d') AS fact FROM orders")
def render_parentheses(spark, d):
    s = hashed_space(star.placed_on(spark, d))
    return text.render(s, find(s, rel("_ on _", ANY, ANY)), max_depth=1).select(F.col("text").alias("fact"))


def _pairs(spark, d):
    return relation.relation(star.table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def _flagged(spark, d, flag):
    return relation.relation(star.table(spark, d, "lineitem").where(F.col("l_returnflag") == flag), "l_suppkey", "l_partkey")


_PAIRS = "r AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"
_FLAGGED = "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = '{}'"


@query(f"{_FLAGGED.format('R')} UNION {_FLAGGED.format('A')}")
def relation_union(spark, d):
    """Who supplied what that was returned, or accepted."""
    return relation.union(_flagged(spark, d, "R"), _flagged(spark, d, "A"))


@query(f"{_FLAGGED.format('R')} INTERSECT {_FLAGGED.format('A')}")
def relation_intersection(spark, d):
    return relation.intersection(_flagged(spark, d, "R"), _flagged(spark, d, "A"))


@query(f"WITH {_PAIRS} SELECT a, b FROM r EXCEPT {_FLAGGED.format('R')}")
def relation_delete(spark, d):
    return relation.delete(_pairs(spark, d), _flagged(spark, d, "R"))


@query(f"WITH {_PAIRS} SELECT a, b FROM r UNION SELECT 0, 0")
def relation_insert(spark, d):
    return relation.insert(_pairs(spark, d), spark.createDataFrame([(0, 0)], "a long, b long"))


@query(f"WITH {_PAIRS} SELECT b FROM r WHERE a = 3")
def relation_lookup(spark, d):
    return relation.lookup_dom(_pairs(spark, d), 3)


@query(f"WITH {_PAIRS} SELECT DISTINCT b FROM r")
def relation_ran(spark, d):
    return relation.ran(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT DISTINCT a FROM r")
def relation_dom(spark, d):
    return relation.dom(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT b AS a, a AS b FROM r")
def relation_converse(spark, d):
    return relation.converse(_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT count(*) AS size FROM r")
def relation_size(spark, d):
    return relation.size(_pairs(spark, d))


def _some(spark, d):
    """Suppliers in debt, and small parts: sets to restrict relations to."""
    debtors = star.table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("a"))
    small = star.table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("b"))
    return debtors, small


_SOME = "a IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) AND b IN (SELECT p_partkey FROM part WHERE p_size <= 5)"


@query(f"WITH {_PAIRS} SELECT DISTINCT a FROM r WHERE {_SOME}")
def relation_dom_related(spark, d):
    return relation.dom_related(*_some(spark, d), _pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT a, b FROM r WHERE {_SOME}")
def relation_restrict(spark, d):
    debtors, small = _some(spark, d)
    return relation.restrict_ran(relation.restrict_dom(debtors, _pairs(spark, d)), small)


@query(f"WITH {_PAIRS} SELECT DISTINCT a % 10 AS a, b FROM r WHERE a < b")
def relation_map(spark, d):
    return relation.map_dom(lambda a: a % 10, relation.where(lambda a, b: a < b, _pairs(spark, d)))


@query("SELECT l_partkey AS item FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def relation_compact(spark, d):
    return relation.compact(star.table(spark, d, "lineitem").select(F.array("l_partkey", "l_suppkey").alias("items")))


@query("SELECT DISTINCT o_custkey AS a, l_partkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def relation_compose(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    lines = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_partkey").alias("c"))
    return navigate.composed(o, lines).distinct()
