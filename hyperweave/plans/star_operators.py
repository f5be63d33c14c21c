"""More queries over the star schema: one for each operator that the headline queries leave out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import render as text
from ..functions.frames import shared_dir
from ..operators import check, edit, navigate, order, quant, relation, search, transitive
from ..operators.quant import Ref
from ..operators.search import ANY, IT, eval_, find, phrase, rel
from ..sources import facts, space
from ..sources.facts import R, T, hashed_space
from ..sources.log import SpaceLog
from ..streaming.ingest import ingest_stream
from . import star
from .star_queries import _IN, _PAIRS, _PRECEDES, _SOME, _SUPPLIES, _one, _pairs, _some, _t, _texts, query


@query("SELECT n_name AS name FROM nation WHERE n_name IN ('NATION_1', 'NATION_4')")
def search_phrases(spark, d):
    s = hashed_space(star.nation_in_region(spark, d))
    return _texts(s, find(s, phrase("NATION_1") | phrase("NATION_4") | phrase("NATION_NONE")), name="addr")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey BETWEEN 3 AND 7")
def search_addresses(spark, d):
    """Addresses and ranges, over a dense load whose nation phrases are known to be every other address."""
    n = star.table(spark, d, "nation")
    s, _ = facts.load(space.empty_space(spark), n, R("nation _", F.col("n_name")), F.col("n_nationkey"))
    first = s.expr.where("phrase = 'NATION_0'").first()["addr"]
    return _texts(s, find(s, search.addr((first + 6, first + 14))), name="addr")


@query(f"WITH {_SUPPLIES} SELECT a AS name FROM s WHERE b = 'part:3'")
def search_bind(spark, d):
    """A search put in place of a variable."""
    s = hashed_space(star.supplies(spark, d))
    return _texts(s, find(s, eval_(rel("_ supplies _", IT, search.var("what"))).bind(what=phrase("part:3"))), name="addr")


@query("SELECT '_ in _' AS name")
def search_template_text(spark, d):
    s = hashed_space(star.nation_in_region(spark, d), star.supplies(spark, d))
    return text.render(s, _t(s, "_ in _")).select(F.col("text").alias("name"))


@query(f"WITH {_SUPPLIES} SELECT b AS name, list_sort(list(a))[1] AS who FROM s WHERE b IN ('part:1', 'part:2') GROUP BY b")
def search_variables(spark, d):
    """A search with a variable, for all its bindings at once."""
    s = hashed_space(star.supplies(spark, d))
    env = find(s, phrase("part:1") | phrase("part:2")).withColumnRenamed("addr", "p")
    found = find(s, eval_(rel("_ supplies _", IT, search.var("p"))), env)
    return _texts(s, found, name="p", who="addr").groupBy("name").agg(F.min("who").alias("who"))


@query(f"WITH {_IN} SELECT count(*) AS n FROM (SELECT a FROM in_ UNION SELECT b FROM in_ UNION ALL SELECT a || '>' || b FROM in_ UNION ALL SELECT 'in' UNION ALL SELECT '_ in _')")
def source_content_index(spark, d):
    return space.content_index(star.places(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem")
def source_relation(spark, d):
    r = _pairs(spark, d)
    return relation.size(relation.dom(r)).withColumnRenamed("size", "n_suppliers").crossJoin(relation.size(relation.ran(r)).withColumnRenamed("size", "n_parts"))  # one row each


@query("SELECT n_nationkey AS node FROM nation UNION SELECT n_regionkey FROM nation")
def graph_nodes(spark, d):
    n = star.table(spark, d, "nation").select(F.col("n_nationkey").alias("parent"), F.array("n_regionkey").alias("children"))
    return space.graph_from_adjacency(n)[1]


@query("SELECT r_name AS place, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name IN ('NATION_3', 'NATION_9')")
def navigate_resolve(spark, d):
    """Nested expressions to addresses by one equality of digests, and back to their rows."""
    s = hashed_space(star.nation_in_region(spark, d))
    wanted = star.nation_in_region(spark, d)[0].where("n_name IN ('NATION_3', 'NATION_9')")
    keys = wanted.select(R("_ in _", F.col("n_name"), F.col("r_name")).key().alias("key"))
    found = navigate.rows(s, s.expr.join(keys, "key", "left_semi").select("addr"))
    return _texts(s, found.select(F.get("members", F.lit(0)).alias("x"), F.get("members", F.lit(1)).alias("y")), place="y", name="x")


@query("SELECT 'tplt' AS role, count(*) AS n FROM orders UNION ALL SELECT 'member', 2 * count(*) FROM orders")
def navigate_members_and_template(spark, d):
    s = hashed_space(star.order_placed_by(spark, d))
    return navigate.members_and_template(s, find(s, rel("_ placed by _", ANY, ANY))).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS parent, o_orderkey AS child FROM orders")
def graph_parents(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.array("o_orderkey").alias("children"))
    edges, nodes = space.graph_from_adjacency(o)
    return navigate.graph_parents(edges, nodes)


@query(f"WITH {_PRECEDES} SELECT count(*) AS n FROM p")
def transitive_edges(spark, d):
    s = hashed_space(star.precedes(spark, d))
    return transitive.edges(s, _t(s, "_ precedes _")).agg(F.count("*").alias("n"))


@query("SELECT 'user:' || user_id AS name FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def transitive_recheck(spark, d):
    """Cycles of many kernels along their own templates, in one loop: only the circle of 'follows' is one."""
    users = star.table(spark, d, "events").select("user_id").distinct()
    u, v = star.named("user", "user_id"), star.named("double", "user_id")
    s = hashed_space((users, R("_ follows _", u, v)), (users, R("_ follows _", v, u)), (users, R("_ likes _", u, v))).cached()
    named = s.expr.where("phrase LIKE 'user:%'").select("addr")
    kernels = s.pos.where("host_kind = 'rel' AND role = 'member'").select("tplt", F.col("child").alias("addr")).join(named, "addr", "left_semi").distinct()
    return _texts(s, transitive.recheck_cycles(s, kernels).select("start"), name="start")


@query("SELECT 'order:' || o_orderkey AS a, 'customer:' || o_custkey AS b FROM orders")
def order_rels_using(spark, d):
    s = hashed_space(star.order_placed_by(spark, d), star.customer_in_nation(spark, d))
    rels = order.rels_using(s, _t(s, "_ placed by _")).select(F.get("members", F.lit(0)).alias("x"), F.get("members", F.lit(1)).alias("y"))
    return _texts(s, rels, a="x", b="y")


@query("SELECT count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(*) + 1 AS n FROM orders")
def order_restrict(spark, d):
    """The part of the space that a sort by one template needs: its facts, their members and itself."""
    s = hashed_space(star.order_placed_by(spark, d), star.customer_in_nation(spark, d)).cached()
    t = _t(s, "_ placed by _")
    return order.restrict(s, t, find(s, eval_(rel("_ placed by _", IT, ANY)))).expr.agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_PRECEDES}, r(x, n) AS (SELECT a, 0 FROM p WHERE a NOT IN (SELECT b FROM p) UNION ALL SELECT b, n + 1 FROM p JOIN r ON a = x) SELECT x AS name, CAST(max(n) AS INTEGER) AS level, false AS is_isolated FROM r WHERE x IN (SELECT a FROM p WHERE a LIKE 'conv:2%') GROUP BY 1")
def order_find_sorted(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    mine = eval_(rel("_ precedes _", search.it(search.frame(s.expr.where("phrase LIKE 'conv:2%'"))), ANY))
    return _texts(s, order.find_sorted(s, mine, _t(s, "_ precedes _")), name="addr")


@query("SELECT * FROM (VALUES ('_ in _', 'right'), ('_ supplies _', 'left')) AS t(name, earlier)")
def order_orientation(spark, d):
    one = spark.range(1)
    s = hashed_space(star.nation_in_region(spark, d), star.supplies(spark, d), (one, R("sort by _ right first", T("_ in _"))))
    t = find(s, search.template("_ in _") | search.template("_ supplies _"))
    return text.render(s, order.orientation(s, t)).join(order.orientation(s, t), "addr").select(F.col("text").alias("name"), "earlier")


@query("SELECT * FROM (VALUES ('_ in _', 0), ('_ placed by _', 1), ('_ supplies _', 2)) AS t(name, level)")
def order_priority(spark, d):
    one = spark.range(1)
    chain = [(one, R("sort by _ before _", T(a), T(b))) for a, b in (("_ in _", "_ placed by _"), ("_ placed by _", "_ supplies _"))]
    s = hashed_space(star.nation_in_region(spark, d), star.supplies(spark, d), star.order_placed_by(spark, d), *chain)
    ranked = order.sort_priority(s)
    return text.render(s, ranked).join(ranked, "addr").select(F.col("text").alias("name"), "level")


@query("SELECT '_ placed by _' AS name")
def order_first_applicable(spark, d):
    """Of the templates to sort by, the first one that an order takes part in."""
    one = spark.range(1)
    s = hashed_space(star.nation_in_region(spark, d), star.order_placed_by(spark, d), (one, R("sort by _ before _", T("_ in _"), T("_ placed by _")))).cached()
    return text.render(s, order.first_applicable(s, _one(s, "order:1"))).select(F.col("text").alias("name"))


@query("SELECT n_name AS name, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 2 = 1 THEN -n_nationkey END NULLS LAST, n_nationkey) AS place FROM nation")
def order_like(spark, d):
    """Odd nations by falling key, then the rest in their old order."""
    n = star.table(spark, d, "nation").select("n_name", "n_nationkey")
    ranks = n.where("n_nationkey % 2 = 1").select("n_name", (-F.col("n_nationkey")).alias("rank"))
    out = order.order_like(n, ranks, "n_name", "rank", "n_nationkey")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.col("rank").asc_nulls_last(), "n_nationkey"))  # 25 nations
    return out.select(F.col("n_name").alias("name"), place.cast("long").alias("place"))


@query("SELECT o_custkey AS elt FROM orders WHERE o_orderkey IN (1, 2, 3) AND o_custkey IS NOT NULL GROUP BY 1")
def quant_graph(spark, d):
    """Quantifiers over a plain graph: the parents of some of three orders."""
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    steps = [("orders", quant.find_values([1, 2, 3])), ("who", quant.for_some("o", "orders", quant.find_from(lambda g: g, Ref("o"))))]
    return quant.run_program(o, steps, spark)["who"].select("elt").distinct()


@query("SELECT DISTINCT o_custkey AS elt, o_orderkey AS o FROM orders")
def quant_bindings(spark, d):
    """Bindings turned into results keyed on one variable."""
    b = star.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    return quant.bindings_to_results(b, "c")


@query("SELECT l_orderkey AS elt, l_partkey AS p, l_suppkey AS s FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)")
def quant_reconcile(spark, d):
    """Bindings of parts and suppliers of orders that agree with the lines: three results reconciled."""
    line = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elt"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    return quant.reconcile([line, line.select("elt", "p").distinct(), line.select("elt", "s").distinct()])


@query(f"WITH {_SUPPLIES} SELECT count(DISTINCT b) AS n FROM s WHERE a = 'supplier:1'")
def quant_consistent(spark, d):
    s = star.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("elt"), F.col("l_partkey").alias("p")).distinct()
    out = quant.consistent_bindings({"who": s}, {"who": spark.createDataFrame([(1,)], "elt long")})
    return out.agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ATLANTIS', 'ASIA'")
def edit_insert_rows(spark, d):
    rows, pattern = star.nation_in_region(spark, d)
    s, _ = facts.load(space.empty_space(spark), rows, pattern, F.col("n_nationkey"))
    top = navigate.max_addr(s).first()["next_addr"]
    t, asia = _t(s, "_ in _").first()["addr"], _one(s, "ASIA").first()["addr"]
    s = edit.insert_rows(s, space.rows_to_expr(spark, [(top, "phrase", "ATLANTIS"), (top + 1, "rel", ([top, asia], t))]))
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT n_name AS name, CASE r_name WHEN 'ASIA' THEN 'OLD WORLD' ELSE r_name END AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_replace(spark, d):
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    at = _one(s, "ASIA").first()["addr"]
    s = edit.replace(s, space.rows_to_expr(spark, [(at, "phrase", "OLD WORLD")]))
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query("SELECT n_name AS name, r_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def edit_readdress(spark, d):
    """Two expressions change places; what the facts say stays."""
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    a, b = _one(s, "ASIA").first()["addr"], _one(s, "NATION_1").first()["addr"]
    s = edit.readdress(s, spark.createDataFrame([(a, b), (b, a)], "old long, new long"))
    return _texts(s, transitive.edges(s, _t(s, "_ in _")).select("src", "dst"), name="src", place="dst")


@query(f"WITH {_PRECEDES} SELECT a AS name, b AS next FROM p WHERE NOT (a LIKE 'conv:1%' AND b LIKE 'conv:1%')")
def edit_separate_within(spark, d):
    s = hashed_space(star.precedes(spark, d)).cached()
    mine = s.expr.where("phrase LIKE 'conv:1%'").select("addr")
    s, _ = edit.separate_within(s, _t(s, "_ precedes _"), mine)
    return _texts(s, transitive.edges(s, _t(s, "_ precedes _")).select("src", "dst"), name="src", next="dst")


@query("SELECT n_name AS a, lead(n_name) OVER (ORDER BY n_nationkey) AS b FROM nation QUALIFY b IS NOT NULL")
def edit_append_to_order(spark, d):
    """Ten nations in a row, then the others after the last."""
    n = star.table(spark, d, "nation")
    s, _ = facts.load(space.empty_space(spark), n, R("_ then _", F.col("n_name"), F.lit("end")), F.col("n_nationkey"))
    ix = s.expr.where("kind = 'phrase'").join(n, F.col("phrase") == F.col("n_name")).select("addr", F.col("n_nationkey").alias("ix"))
    s = edit.insert_chain(s, _t(s, "_ then _"), ix.where("ix < 10"), "addr", "ix")
    s = edit.append_to_order(s, _t(s, "_ then _"), ix.where("ix < 10"), ix.where("ix >= 10"))
    return _texts(s, transitive.edges(s, _t(s, "_ then _")).select("src", "dst"), a="src", b="dst").where("b <> 'end'")


@query(f"WITH {_PRECEDES} SELECT a AS name, b AS next FROM p WHERE NOT (b LIKE 'conv:%/3' OR a LIKE 'conv:%/3')")
def edit_remove_from_order(spark, d):
    """All fourth turns cut loose from the rest; nothing else connects to them."""
    s = hashed_space(star.precedes(spark, d)).cached()
    fourth = s.expr.where("phrase LIKE 'conv:%/3'").select("addr")
    rest = s.expr.where("phrase LIKE 'conv:%' AND phrase NOT LIKE '%/3'").select("addr")
    s, _ = edit.remove_from_order(s, _t(s, "_ precedes _"), rest, fourth)
    return _texts(s, transitive.edges(s, _t(s, "_ precedes _")).select("src", "dst"), name="src", next="dst")


@query("SELECT '###' || n_name AS marked, '(' || n_name || ')' AS wrapped, n_name || ' x ' || n_regionkey AS mixed, 'NATION' AS plain FROM nation")
def render_functions(spark, d):
    """Scalar text functions: number signs, parentheses, two lists by turns, a place replaced, digits removed."""
    name = F.col("n_name")
    mixed = text.interleaved(F.array(name, F.col("n_regionkey").cast("string")), F.array(F.lit("x")))
    plain = F.regexp_replace(F.element_at(text.replaced(F.array(F.lit("?"), F.lit("!")), 1, name), 1), "_[0-9]+", "")
    return star.table(spark, d, "nation").select(text.hashes(F.lit(3), name).alias("marked"), text.parenthesised(name).alias("wrapped"), F.array_join(mixed, " ").alias("mixed"), plain.alias("plain"))


@query(f"WITH {_PAIRS} SELECT a, b FROM r INTERSECT SELECT l_suppkey, l_orderkey FROM lineitem")
def relation_member(spark, d):
    """Pairs of supplier and order whose numbers are those of a supplier and a part of its."""
    return relation.member(_pairs(spark, d), relation.relation(star.table(spark, d, "lineitem"), "l_suppkey", "l_orderkey"))


@query(f"WITH {_PAIRS} SELECT l_suppkey AS a, l_orderkey AS b FROM lineitem EXCEPT SELECT a, b FROM r")
def relation_not_member(spark, d):
    return relation.not_member(_pairs(spark, d), relation.relation(star.table(spark, d, "lineitem"), "l_suppkey", "l_orderkey"))


@query(f"WITH {_PAIRS} SELECT a FROM r WHERE b = 3")
def relation_lookup_ran(spark, d):
    return relation.lookup_ran(_pairs(spark, d), 3)


@query(f"WITH {_PAIRS} SELECT DISTINCT b FROM r WHERE {_SOME}")
def relation_ran_related(spark, d):
    return relation.ran_related(*_some(spark, d), _pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT DISTINCT a, b % 7 AS b FROM r")
def relation_map_ran(spark, d):
    return relation.map_ran(lambda b: b % 7, _pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT a, b FROM r")
def relation_to_list(spark, d):
    return relation.to_list(_pairs(spark, d))


@query("SELECT DISTINCT l_partkey AS b FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 3")
def relation_intersections(spark, d):
    lines = star.table(spark, d, "lineitem")
    return relation.intersections(*(lines.where(f"l_linenumber = {k}").select(F.col("l_partkey").alias("b")) for k in (1, 2, 3)))


@query("SELECT o_custkey AS key, count(*) AS n FROM (SELECT o_custkey, o_orderdate AS item FROM orders UNION SELECT o_custkey, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_custkey")
def relation_union_by_key(spark, d):
    """The days of each customer: those of orders and those of their lines."""
    orders, lines = star.table(spark, d, "orders"), star.table(spark, d, "lineitem")
    ordered = orders.select(F.col("o_custkey").alias("key"), F.array("o_orderdate").alias("items"))
    shipped = orders.join(lines, F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("key"), F.array("l_shipdate").alias("items"))
    return relation.union_by_key(ordered, shipped).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'supplier:' || l_suppkey AS name, 'part:' || l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'")
def check_finds_misfits(spark, d):
    """Facts of returned lines, broken on purpose: a member too many for their template, or no template at all where parts are odd."""
    lines = star.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    pattern = lambda name: R(name, star.named("supplier", "l_suppkey"), star.named("part", "l_partkey"))
    s = hashed_space((lines.where("l_returnflag = 'R'"), pattern("_ had _ returned")), (lines, pattern("_ supplies _")))
    wrong = find(s, rel("_ had _ returned", ANY, ANY)).withColumn("_wrong", F.lit(True))
    odd = F.col("addr") % 2 != 0
    members = F.when(F.col("_wrong") & ~odd, F.concat("members", F.slice("members", 1, 1))).otherwise(F.col("members"))
    tplt = F.when(F.col("_wrong") & odd, F.get("members", F.lit(0))).otherwise(F.col("tplt"))
    broken = space.Space(s.expr.join(wrong, "addr", "left").withColumn("tplt", tplt).withColumn("members", members).drop("_wrong"))
    bad = navigate.rows(broken, check.misfit_rels(broken)).select(F.get("members", F.lit(0)).alias("x"), F.get("members", F.lit(1)).alias("y"))
    return _texts(s, bad, name="x", part="y").distinct()


@query("SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'phrase' AS kind, 'order:' || o_orderkey AS x FROM orders UNION SELECT 'phrase', 'customer:' || o_custkey FROM orders UNION SELECT 'rel', o_orderkey || '/' || o_custkey FROM orders UNION SELECT 'phrase', 'placed by' UNION SELECT 'tplt', '_ placed by _') GROUP BY kind")
def source_written(spark, d):
    """A space written to the shared folder, read again and dumped in address order."""
    path = f"{shared_dir(spark)}/space-{uuid.uuid4().hex}"
    space.write_space(hashed_space(star.order_placed_by(spark, d)), path)
    return space.dump(space.read_space(spark, path)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'order:' || o_orderkey AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")
def quant_find_with(spark, d):
    """Functions of the space as leaves: the customers in a nation by one, the orders that each leads to by another."""
    s = hashed_space(star.customer_in_nation(spark, d), star.order_placed_by(spark, d))
    mine = lambda g: find(g, eval_(rel("_ in _", IT, phrase("NATION_3")))).withColumnRenamed("addr", "elt")
    orders = lambda g: transitive.edges(g, _t(g, "_ placed by _")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = [("mine", quant.find_with(mine)), ("placed", quant.for_some("who", "mine", quant.find_from(orders, Ref("who"))))]
    return _texts(s, quant.run_program(s, steps)["placed"].select("elt").distinct(), name="elt")


@query("SELECT 'part:' || l_partkey AS part FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY 1")
def search_collapsed(spark, d):
    """Sets of one, sets of sets: the terms that stand for them are the same as what they hold."""
    s = hashed_space(star.supplier_in_nation(spark, d), star.supplies(spark, d))
    there = search.all_of(search.any_of(search.all_of(eval_(rel("_ in _", IT, phrase("NATION_7"))))))
    return _texts(s, find(s, search.any_of(search.any_of(eval_(rel("_ supplies _", there, IT))))), part="addr")


@query("SELECT c_custkey, regexp_replace(c_name, '#', ' no. ') AS name FROM customer")
def render_substituted(spark, d):
    return star.table(spark, d, "customer").select("c_custkey", text.substituted(F.col("c_name"), "#", " no. ").alias("name"))


@query("""SELECT c_custkey, regexp_extract(c_name, '^[^0-9]*') AS before, regexp_extract(c_name, '[0-9]+') AS during, regexp_extract(c_name, '^[^0-9]*[0-9]*(.*)$', 1) AS after
FROM customer WHERE NOT regexp_matches(c_name, '[0-9][^0-9]+[0-9]')""")
def render_split_around(spark, d):
    """The characters of a name around its one run of digits."""
    parts = text.split_around(F.split("c_name", ""), lambda x: x.rlike("^[0-9]$"))
    out = star.table(spark, d, "customer").select("c_custkey", parts.alias("p")).where("p IS NOT NULL")
    return out.select("c_custkey", *(F.array_join(f"p.{c}", "").alias(c) for c in ("before", "during", "after")))


@query("SELECT DISTINCT 'user:' || user_id AS name, event_type AS act FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def stream_ingest(spark, d):
    """Events as a stream of facts into a log; a second stream brings them all again, which changes nothing."""
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(star.table(spark, d, "events").schema).parquet(f"{d}/events[.]parquet")  # a pattern, as a stream's path is else a folder
    for name in ("first", "again"):
        ingest_stream(stream, R("_ did _", star.named("user", "user_id"), F.col("event_type")), folder, f"{folder}/checkpoint-{name}", name=name).awaitTermination()
    s = SpaceLog(spark, folder).space()
    return _texts(s, transitive.edges(s, _t(s, "_ did _")).select("src", "dst"), name="src", act="dst")


@query("SELECT count(*) > 0 AS ring, false AS line FROM conversations")
def transitive_finds_cycle(spark, d):
    """Conversations whose last turn precedes their first go in a circle; without that they do not."""
    rows, pattern = star.precedes(spark, d)
    turn = star.table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    at = lambda c: star.named("conv", F.concat("conv_id", F.lit("/"), c))
    s = hashed_space((rows, pattern), (turn, R("_ comes round to _", at("last"), at("first")))).cached()
    both = _t(s, "_ precedes _").union(_t(s, "_ comes round to _"))
    return spark.createDataFrame([(order.has_cycle(s, both), order.has_cycle(s, _t(s, "_ precedes _")))], "ring boolean, line boolean")


@query("SELECT 'order:' || o_orderkey AS name, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS level FROM orders")
def order_deep_chain(spark, d):
    """All orders in one chain: as many levels as orders."""
    keys = star.table(spark, d, "orders").select("o_orderkey")
    pairs = edit.chain_pairs(keys, "o_orderkey", "o_orderkey")
    s = hashed_space((pairs, R("_ then _", star.named("order", "left"), star.named("order", "right")))).cached()
    return _texts(s, order.topo_sort(s, _t(s, "_ then _"), s.expr.where("phrase LIKE 'order:%'").select("addr")), name="addr").drop("is_isolated")


@query("""WITH p AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT (SELECT count(*) FROM p WHERE nxt IS NOT NULL) AS n_facts, (SELECT count(*) FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.nxt = y.turn WHERE x.turn = 0 AND y.nxt = 2) AS n_walks""")
def edit_refuses_removal(spark, d):
    """First turns still lead to third ones by way of the second, so nothing is cut."""
    s = hashed_space(star.precedes(spark, d)).cached()
    turn = lambda i: s.expr.where(f"phrase LIKE 'conv:%/{i}'").select("addr")
    left, walks = edit.remove_from_order(s, _t(s, "_ precedes _"), turn(0), turn(2))
    n = transitive.edges(left, _t(left, "_ precedes _")).agg(F.count("*").alias("n_facts"))
    return n.crossJoin(walks.agg(F.count("*").alias("n_walks")))  # one row each


@query("""WITH p AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT 'conv:' || x.conv_id || '/0' AS name, 'conv:' || x.conv_id || '/3' AS last, CAST(2 AS INTEGER) AS n_inner
FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.nxt = y.turn JOIN p z ON y.conv_id = z.conv_id AND y.nxt = z.turn WHERE x.turn = 0 AND z.nxt = 3""")
def transitive_path_graph(spark, d):
    """The walks from first to fourth turns: one link each, with what lies between inside it."""
    s = hashed_space(star.precedes(spark, d)).cached()
    turn = lambda i: s.expr.where(f"phrase LIKE 'conv:%/{i}'").select("addr")
    links = transitive.path_graph(s, _t(s, "_ precedes _"), turn(0), turn(3))
    return _texts(s, links.select("at", "to", F.size("inner").alias("n_inner")), name="at", last="to")


@query("SELECT l_partkey AS part, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def graph_inverted_lists(spark, d):
    """From the parts of each supplier, as lists, to the suppliers of each part."""
    lists = star.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("parent")).agg(F.collect_set("l_partkey").alias("children"))
    edges, _ = space.graph_from_adjacency(lists)
    return navigate.inverted(edges).select(F.col("child").alias("part"), F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("SELECT r_name AS place, CAST(count(*) AS INTEGER) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def navigate_host_lists(spark, d):
    """The facts about each region, as one list for its role and template."""
    s = hashed_space(star.nation_in_region(spark, d)).cached()
    regions = find(s, eval_(rel("_ in _", ANY, IT)))
    return _texts(s, navigate.host_groups(s, regions).where("group = 'member' AND ix = 2").select("addr", F.size("hosts").alias("n")), place="addr")
