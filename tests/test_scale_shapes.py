"""Shapes that a round for each step, or a row for each way, would not get through."""

from functools import reduce
from operator import or_

import pytest
from pyspark.sql import functions as F

from hyperweave.functions import frames, render
from hyperweave.operators import edit, navigate, order, search, transitive
from hyperweave.operators.search import ANY, IT, eval_, find, phrase, rel
from hyperweave.sources.facts import R, T, collision_free_space, hashed_space, load
from hyperweave.sources.space import empty_space, positions


def leads(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    s = hashed_space((df, R("_ to _", F.col("a"), F.col("b")))).cached()
    return s, find(s, search.template("_ to _"))


def texts(s, df, *columns):
    for c in columns:
        df = s.phrases(df, c, f"{c}_text")
    return sorted(tuple(r) for r in df.select(*(f"{c}_text" for c in columns)).collect())


def brute_levels(pairs):
    nodes = {x for p in pairs for x in p}
    level, left = {}, set(pairs)
    while len(level) < len(nodes):
        free = {n for n in nodes - level.keys() if not any(b == n and a not in level for a, b in left)}
        assert free
        level |= {n: 1 + max((level[a] for a, b in pairs if b == n), default=-1) for n in free}
    return level


def test_levels_of_mixed_shapes(spark):
    pairs = [(i, i + 1) for i in range(25)] + [(100 + i, i + 1) for i in range(0, 25, 7)] + [(200, 100), (200, 107), (10, 300), (300, 301), (301, 15), (5, 400), (400, 401)]
    got = order.levels(spark.createDataFrame(pairs, "before long, after long"))
    assert {r["addr"]: r["level"] for r in got.collect()} == brute_levels(pairs)
    for ring in ([(0, 1), (1, 2), (2, 1)], [(1, 2), (2, 1), (1, 3), (2, 3), (3, 1)]):
        with pytest.raises(order.CycleError):
            order.levels(spark.createDataFrame(ring, "before long, after long"))


def test_very_many_ways(spark):
    """Thirty diamonds in a row: 2^30 walks, 120 links."""
    pairs = [x for i in range(30) for x in ((f"d{i}", f"u{i}"), (f"d{i}", f"l{i}"), (f"u{i}", f"d{i + 1}"), (f"l{i}", f"d{i + 1}"))] + [("d3", "dead"), ("dead", "end"), ("before", "d0")]
    s, t = leads(spark, pairs)
    links = transitive.path_graph(s, t, find(s, phrase("d0")), find(s, phrase("d30"))).collect()
    assert len(links) == 60 and all(len(x["inner"]) == 1 for x in links)
    few = transitive.paths(s, t, find(s, phrase("d0")), find(s, phrase("d2")))
    assert few.count() == 4 and {len(r["path"]) for r in few.collect()} == {5}
    assert transitive.paths(s, t, find(s, phrase("d0")), find(s, phrase("d2")), max_len=3).isEmpty()


def test_long_circle_beside_a_long_line(spark):
    pairs = [(f"c{i}", f"c{(i + 1) % 200}") for i in range(200)] + [(f"l{i}", f"l{i + 1}") for i in range(5000)] + [("c5", "l0"), ("l7", "x"), ("l9", "x")]
    s, t = leads(spark, pairs)
    (found,) = transitive.cycles(s, t, find(s, phrase("c0") | phrase("l3"))).collect()
    assert len(found["path"]) == 201 and found["path"][0] == found["path"][-1] == found["start"] and len(set(found["path"])) == 200


def test_stated_rels_agree_with_the_merged_space(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 3), (None, "c", 4), ("a", None, 5), ("b", "a", 1)], "x string, y string, n long")
    nested = R("_ since _", R("_ likes _", F.col("x"), F.col("y")), F.col("n"))
    lazy = hashed_space((rows, nested), (rows.select("x"), R("_ likes _", F.col("x"), "tea")), (rows, R("always _", F.col("y"))))
    whole = lazy.cached()
    assert whole.rels is None
    terms = [
        rel("_ likes _", ANY, ANY), rel("_ likes _", phrase("a"), ANY), rel("_ likes _", ANY, phrase("tea")), rel("_ likes _", phrase("nobody"), ANY),
        eval_(rel("_ likes _", phrase("a"), IT)), eval_(rel("_ likes _", IT, phrase("c") | phrase("tea"))), eval_(rel("_ likes _", IT, IT)), eval_(rel("_ since _", IT, phrase("1"))),
        rel("_ since _", rel("_ likes _", phrase("b"), ANY), ANY), eval_(rel("_ since _", rel("_ likes _", IT, ANY), ANY)), rel("always _", phrase("c")), rel("no such _", ANY), rel("_ likes _", search.template("_ likes _"), ANY),
    ]
    for term in terms:
        assert sorted(map(tuple, find(lazy, term).collect())) == sorted(map(tuple, find(whole, term).collect())), term
    env = find(whole, phrase("a") | phrase("b")).withColumnRenamed("addr", "v")
    found = [find(s, eval_(rel("_ likes _", search.var("v"), IT)), env).select("v", "addr") for s in (lazy, whole)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) != []


def _told(spark):
    """A space as its tables state it: nested and repeated facts, templates as members, caps, empty separators, constants and nulls."""
    rows = spark.createDataFrame([("a", "b c", 1), ("b c", "a", 2), ("a", "b c", 1), (None, "a", 4), ("a", None, 5), ("", "a", 1)], "x string, y string, n long")
    likes = R("_ really likes _", F.col("x"), F.col("y"))
    deep = R("that _ since _ is _", R("_ since _", likes, F.col("n")), F.col("n"), R("_ of _ so", "fact", likes))
    return hashed_space((rows, deep), (rows.select("x"), R("_ _", F.col("x"), "tea")), (rows, R("always _", F.col("y"))), (rows, R("_ is _", T("that _ since _ is _"), F.col("y"))), (rows, R("_ is _", R("_ is _", T("_ _"), "odd"), F.col("x"))))


def test_texts_written_from_tables_agree_with_those_of_the_merged_space(spark, monkeypatch):
    lazy = _told(spark)
    whole = lazy.cached()
    assert whole.wholes is None
    everything = whole.expr.select("addr")
    monkeypatch.setattr(render, "positions", None)
    for depth in (None, 1, 2, 3):
        got = sorted(map(tuple, render.render(lazy, everything.union(everything), depth).collect()))  # no row for a child is made
        with monkeypatch.context() as m:
            m.setattr(render, "positions", positions)
            assert got == sorted(map(tuple, render.render(whole, everything, depth).collect())), depth
        assert len(got) == everything.count()
    few = find(lazy, rel("_ _", ANY, ANY))
    assert sorted(r["text"] for r in render.render(lazy, few).collect()) == [" # tea", "a # tea", "b c # tea"]


def test_many_texts_move_once(spark, monkeypatch):
    """However deep facts are nested, their texts go through one exchange, to the addresses that were asked for."""
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 0)
    lazy = _told(spark)
    facts = find(lazy, rel("that _ since _ is _", ANY, ANY, ANY))
    found = render.render(lazy, facts)
    assert sorted(r["text"] for r in found.collect()) == sorted(
        f"###that {x} #really likes {y} ##since {n} ###since {n} ###is fact ##of {x} #really likes {y} ##so" for x, y, n in (("a", "b c", 1), ("b c", "a", 2), ("", "a", 1))
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("Join Inner") == 1


def test_phrases_read_off_tables_agree_with_those_of_the_merged_space(spark, monkeypatch):
    lazy = _told(spark)
    whole = lazy.cached()
    everything = whole.expr.select("addr")
    want = sorted(map(tuple, navigate.flatten_phrases(whole, everything).collect()))
    monkeypatch.setattr(navigate, "unnest", None)  # nothing is walked
    got = sorted(map(tuple, navigate.flatten_phrases(lazy, everything.union(everything)).select("root", "phrases").collect()))
    assert got == want and {len(p) for _, p in got} == {1, 2, 3, 7}


def test_edits_hash_only_what_they_touch(spark):
    """Other rows keep the key that they have, even one that a look at their content would change."""
    df = spark.range(50).select(F.concat(F.lit("p"), "id").alias("a"), F.lit("top").alias("b"))
    s, _ = load(empty_space(spark), df, R("_ under _", F.col("a"), F.col("b")), F.monotonically_increasing_id())
    mark = s.expr.withColumn("key", F.when(F.col("phrase") == "p7", F.lit("left alone")).otherwise(F.col("key")))
    marked = type(s)(mark)
    one = lambda text: marked.expr.where(F.col("phrase") == text).select("addr")
    new = edit.substitute(marked, one("p3").select(F.col("addr").alias("old")).crossJoin(one("p4").select(F.col("addr").alias("new"))))
    keys = {r["phrase"]: r["key"] for r in new.expr.where("phrase IS NOT NULL").collect()}
    assert keys["p7"] == "left alone"
    assert new.expr.where("kind = 'rel'").count() == 49  # p3's fact has become p4's


def test_chain_over_ranges(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "addr long, ix long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = edit.chain_pairs(rows, "addr", "ix")
    order_ = [a for a, _ in sorted(((i, (i * 37) % 101) for i in range(101)), key=lambda r: r[1])]
    assert {tuple(r) for r in got.collect()} == set(zip(order_, order_[1:], strict=False))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert edit.chain_pairs(rows.limit(0), "addr", "ix").count() == edit.chain_pairs(rows.limit(1), "addr", "ix").count() == 0


def test_contents_never_share_an_address(spark):
    """With hashes of nine bits many of 150 contents meet."""
    rows = spark.range(60).select(F.concat(F.lit("p"), "id").alias("a"), F.concat(F.lit("q"), F.col("id") % 7).alias("b"))
    stated = (rows, R("_ to _", F.col("a"), F.col("b")))
    s = collision_free_space(stated, bits=9)
    got = s.expr.select("addr", "key").collect()
    plain = hashed_space(stated)
    assert len({r["addr"] for r in got}) == len(got) == plain.expr.count() and max(abs(r["addr"]) for r in got) > 2**20
    assert texts(s, transitive.edges(s, find(s, search.template("_ to _"))).select("src", "dst"), "src", "dst") == sorted((f"p{i}", f"q{i % 7}") for i in range(60))
    assert texts(s, find(s, eval_(rel("_ to _", IT, phrase("q3")))), "addr") == sorted((f"p{i}",) for i in range(60) if i % 7 == 3)
    assert texts(s.cached(), find(s.cached(), eval_(rel("_ to _", IT, phrase("q3")))), "addr") == sorted((f"p{i}",) for i in range(60) if i % 7 == 3)


def test_deep_trees(spark):
    from hyperweave.operators import navigate
    from hyperweave.sources.space import Space, rows_to_expr

    chain = [(0, "phrase", "a"), (1, "phrase", "is"), (2, "tplt", (None, [1], None)), *((i, "rel", ([i - 1 if i > 3 else 0, 0], 2)) for i in range(3, 15))]
    s = Space(rows_to_expr(spark, chain))
    top = spark.createDataFrame([(14,)], "addr long")
    deep = navigate.unnest(s, top)
    assert deep.agg(F.max(F.size("path"))).first()[0] == 13 and navigate.unnest(s, top, 2).agg(F.max(F.size("path"))).first()[0] == 2
    with pytest.raises(RecursionError):
        navigate.unnest(Space(rows_to_expr(spark, [*chain[:3], (3, "rel", ([3, 0], 2))])), spark.createDataFrame([(3,)], "addr long"))


def brute_pairs(pairs, starts, ends):
    out = set()
    for s in starts:
        seen, todo = {s}, [s]
        while todo:
            at = todo.pop()
            new = {b for a, b in pairs if a == at} - seen
            seen |= new
            todo += new
        out |= {(s, e) for e in seen & set(ends)}
    return out


def test_pairs_by_doubling_and_by_walks(spark, monkeypatch):
    """Trees, circles, joins, self-loops and dead ends; both ways of going on, both directions."""
    pairs = [(f"a{i}", f"a{i + 1}") for i in range(12)] + [("a3", "b0"), ("b0", "b1"), ("b1", "a7"), ("b1", "dead"), ("dead", "deader"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("a9", "r1"), ("r2", "z"), ("o0", "o1"), ("o1", "o0"), ("o1", "a2"), ("a5", "a5"), ("in", "a0"), ("t", "a4"), ("t", "r0")]
    s, t = leads(spark, pairs)
    nodes = {x for p in pairs for x in p}
    some = lambda names: find(s, reduce(or_, map(phrase, sorted(names))))
    cases = [(nodes, nodes), ({"a0", "o0", "t"}, {"z", "a12", "r1", "o0"}), ({"r0", "a5", "z"}, {"r0", "a5", "deader"}), ({"in"}, {"z"}), ({"deader"}, {"in"})]
    for room in (0, 1_000):
        monkeypatch.setattr(transitive, "ROOM", room)
        for (starts, ends), direction in zip(cases, ("right", "left", "right", "left", "right"), strict=True):
            got = transitive.reach_pairs(s, t, some(starts), some(ends), direction)
            assert texts(s, got, "left", "right") == sorted(brute_pairs(pairs, starts, ends)), (room, starts, direction)
    assert transitive.reach_pairs(s, t, some({"in"}).limit(0), some({"z"})).isEmpty()


def test_closure_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = transitive.settled
    monkeypatch.setattr(transitive, "settled", lambda df: rounds.append(1) or keep(df))
    s, t = leads(spark, [(f"n{i}", f"n{i + 1}") for i in range(1024)])
    links = transitive.edges(s, t)
    everything = links.select(F.col("src").alias("addr")).union(links.select("dst"))
    assert transitive.closure(s, t, everything).count() == 1025 * 1026 // 2
    assert len(rounds) <= 22
    rounds.clear()
    assert transitive.reach_pairs(s, t, find(s, phrase("n0")), find(s, phrase("n1024"))).count() == 1  # a chain of nodes that nobody asked for is one link
    assert len(rounds) <= 10
