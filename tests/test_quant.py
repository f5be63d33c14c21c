"""Quantified programs and the algebra of bindings, on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from hyperweave.operators import quant
from hyperweave.operators.quant import Ref, and_, find_from, find_values, for_all, for_some, led_to, reconcile, run_program, vtest
from hyperweave.operators.quant import test as elt_test


def graph(spark, edges):
    return spark.createDataFrame([(p, c) for p, cs in edges.items() for c in cs], "parent long, child long")


def children(start):
    return find_from(lambda g: g.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start)


def parents(start):
    return find_from(lambda g: g.select(F.col("child").alias("src"), F.col("parent").alias("dst")), start)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select("elt", *columns).collect()), key=str)


def test_some_with_test(spark):
    g = graph(spark, {0: [1, 2], 3: [2, 3, 4], 10: [11, 23]})
    q = for_some("a", "a", and_(children(Ref("a")), elt_test(lambda bound, elt: bound != elt, Ref("a")), elt_test(lambda bound, elt: bound != elt, 2)))
    out = run_program(g, [("a", parents(2)), ("b", q)], spark)
    assert got(out["a"]) == [(0,), (3,)]
    assert got(out["b"], "a") == [(1, 0), (4, 3)]


def test_two_variables_compared(spark):
    g = graph(spark, {0: [1, 2, 3], 1: [11, 12], 2: [12, 13]})
    both = and_(vtest(lambda a, b: a < b, Ref("a"), Ref("a2")), children(Ref("a")), children(Ref("a2")))
    out = run_program(g, [("a", children(0)), ("b", for_some("a", "a", for_some("a2", "a", both)))], spark)
    assert got(out["b"], "a", "a2") == [(12, 1, 2)]


def test_all_with_condition(spark):
    g = graph(spark, {15: [20, 30, 40], 25: [30, 40, 50]})
    q = for_all("a0", "a", children(Ref("a0")), vtest(lambda a, b: a > b, Ref("a0"), 10))
    out = run_program(g, [("a", find_values([5, 15, 25])), ("b", q)], spark)
    assert got(out["b"]) == [(30,), (40,)] and out["b"].columns == ["elt"]


def test_all_without_condition(spark):
    g = graph(spark, {1: [11, 12], 2: [12, 22]})
    out = run_program(g, [("a", find_values([1, 2])), ("b", for_all("a1", "a", children(Ref("a1"))))], spark)
    assert got(out["b"]) == [(12,)]


def test_all_over_nothing(spark):
    """A find over no values finds nothing; a variable test over none passes."""
    g = graph(spark, {1: [11]})
    none = for_all("x", "a", children(Ref("x")), vtest(lambda a, b: a > b, Ref("x"), 10))
    passes = for_all("y", "a", vtest(lambda a, b: a == b, Ref("y"), Ref("x")), vtest(lambda a, b: a > b, Ref("y"), 10))
    out = run_program(g, [("a", find_values([1, 2])), ("none", none), ("all", for_some("x", "a", and_(passes, children(Ref("x")))))], spark)
    assert got(out["none"]) == []
    assert got(out["all"], "x") == [(11, 1)]


def test_all_keeps_bindings_that_agree(spark):
    """For every y there is an x in the same range whose children hold the element; x must be the same for all y."""
    g = graph(spark, {1: [5], 2: [5, 6], 10: [5], 20: [5, 6]})
    inner = for_some("x", "xs", and_(children(Ref("x")), children(Ref("y"))))
    out = run_program(g, [("xs", find_values([1, 2])), ("ys", find_values([10, 20])), ("r", for_all("y", "ys", inner))], spark)
    assert got(out["r"], "x") == [(5, 1), (5, 2)]


def test_disjoint_children(spark):
    """Under 10, with children disjoint from those of 3: 4 has none, so it passes."""
    g = graph(spark, {1: [4, 40], 2: [2, 20], 3: [2, 3, 30]})
    steps = [("a", find_values([1, 2, 3, 4])), ("three", children(3)), ("c", for_some("a1", "a", children(Ref("a1"))))]
    met = for_some("e", "c", for_some("t", "three", and_(vtest(lambda a, b: a == b, Ref("e"), Ref("t")), led_to("a1", "a1", "e", "c"))))
    small = find_from(lambda space: space.sparkSession.range(1, 5).select(F.col("id").alias("src"), F.col("id").alias("dst")), Ref("a1"))
    out = run_program(g, [*steps, ("hit", for_some("a1", "a", and_(met, small)))], spark)
    assert got(out["a"].join(out["hit"], "elt", "left_anti")) == [(1,), (4,)]


def test_checks(spark):
    find = find_values([1])
    for bad in ([("x", for_some("a", "none", find))], [("x", children(Ref("a")))], [("a", find), ("x", for_some("v", "a", for_some("v", "a", find)))], [("x", vtest(lambda a, b: a < b, 1, 2))]):
        with pytest.raises(ValueError):
            quant.check(bad)
    with pytest.raises(ValueError):
        quant.or_(find, vtest(lambda a, b: a < b, 1, 2))


NULL = None


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ("elt", *names)))


def test_reconcile(spark):
    one, two = frame(spark, [(0, 1), (0, 2)], "x"), frame(spark, [(0, 1), (0, 3)], "x")
    assert got(reconcile([one, two]), "x") == [(0, 1)]
    three = [frame(spark, [(0, 1)], "x"), frame(spark, [(0, 1, 2)], "x", "y"), frame(spark, [(0, 1, 3)], "x", "z")]
    assert got(reconcile(three), "x", "y", "z") == [(0, 1, 2, 3)]
    assert got(reconcile([*three, frame(spark, [], "x")]), "x", "y", "z") == []
    a, b = frame(spark, [(0, 1, NULL), (0, NULL, 2)], "x", "z"), frame(spark, [(0, 1, 2, NULL), (0, 1, NULL, 2)], "x", "y", "z")
    assert got(reconcile([a, b]), "x", "y", "z") == sorted([(0, 1, 2, NULL), (0, 1, NULL, 2), (0, 1, 2, 2)], key=str)


def test_reconcile_by_element(spark):
    a = frame(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 1), (3, NULL, NULL)], "a", "b")
    b = frame(spark, [(1, 1, 2, NULL), (1, 2, 2, NULL), (2, 1, NULL, 3)], "a", "b", "c")
    assert got(reconcile([a, b]), "a", "b", "c") == [(1, 2, 2, NULL), (2, 1, 1, 3)]
    same = frame(spark, [(1, 1), (1, NULL)], "a")
    assert got(reconcile([same, same.select("*")]), "a") == sorted([(1, 1), (1, NULL)], key=str)


def test_bindings_as_results(spark):
    b = spark.createDataFrame([(1, 2), (None, 3), (1, 4)], "x long, y long")
    assert got(quant.bindings_to_results(b, "x"), "y") == [(1, 2), (1, 4)]
    results = {"p": frame(spark, [(7, 1), (8, 2)], "x"), "q": frame(spark, [(9, 1), (9, 2)], "x")}
    given = {"p": frame(spark, [(7,)]), "q": frame(spark, [(9,)])}
    assert [tuple(r) for r in quant.consistent_bindings(results, given).collect()] == [(1,)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reconcile_moves_bound_rows_once(spark):
    """Without an unbound variable, rows meet by value alone: no search for equal sets, no join of an element's rows with all others."""
    line = frame(spark, [(1, 1, 2), (1, 2, 2), (2, 1, 1)], "p", "s")
    out = reconcile([line, line.select("elt", "p"), line.select("elt", "s")])
    assert got(out, "p", "s") == got(line, "p", "s")
    assert "LeftAnti" not in _plan(out) and "Union" not in _plan(out) and _plan(out).count("Join ") == 1
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # of the join; none for the distinct rows


def test_reconcile_as_by_hand(spark):
    import random

    rnd = random.Random(5)
    for _ in range(3):
        rows = [[(rnd.randrange(4), *(rnd.choice([None, 1, 2]) if rnd.random() < 0.7 else 1 for _ in range(3))) for _ in range(9)] for _ in range(2)]
        rows.append(rows[1] if rnd.random() < 0.5 else rows[0][:6])
        rows[2] = [r for r in rows[2] if r[0] != 3]
        want = {e: {r[1:] for r in rows[0] if r[0] == e} for e in range(4)}
        for f in rows[1:]:
            for e, have in want.items():
                new = {r[1:] for r in f if r[0] == e}
                if have != new:
                    want[e] = {tuple(x if x is not None else y for x, y in zip(a, b)) for a in have for b in new if all(None in (x, y) or x == y for x, y in zip(a, b))}
        frames = [spark.createDataFrame(f, "elt long, x long, y long, z long") for f in rows]
        assert got(reconcile(frames), "x", "y", "z") == sorted(((e, *b) for e, have in want.items() for b in have), key=str)


def test_few_values_are_sent_to_the_facts(spark):
    """A quantifier's range is computed once, and the facts are not moved to meet it."""
    from hyperweave.operators import search
    from hyperweave.sources.facts import R, hashed_space

    rows = spark.range(40).select(F.concat(F.lit("a:"), F.col("id") % 8).alias("a"), F.concat(F.lit("b:"), F.col("id") % 5).alias("b"))
    s = hashed_space((rows, R("_ of _", F.col("a"), F.col("b"))))
    parts = quant.find(search.phrase("b:1") | search.phrase("b:2"))
    of = lambda v: quant.find(search.eval_(search.rel("_ of _", search.IT, search.var(v))))
    both = for_some("p", "parts", for_some("q", "parts", and_(vtest(lambda a, b: a != b, Ref("p"), Ref("q")), of("p"), of("q"))))
    out = run_program(s, [("parts", parts), ("some", for_some("p", "parts", of("p"))), ("all", for_all("p", "parts", of("p"))), ("both", both)], spark)
    assert [out[x].select("elt").distinct().count() for x in ("some", "all", "both")] == [8, 8, 8]
    plan = out["some"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "phrase" not in plan
