"""The merge of statements by content, and joins that broadcast by measured sizes alone."""

import pytest
from pyspark.sql import functions as F

from hyperweave.operators import check, navigate, order
from hyperweave.operators.search import ANY, IT, eval_, find, phrase, rel, template
from hyperweave.sources.facts import R, T, hashed_space


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _space(spark, n=4):
    rows = spark.range(n).select(F.concat(F.lit("a:"), "id").alias("a"), F.concat(F.lit("b:"), F.col("id") % 2).alias("b"))
    return hashed_space((rows, R("_ of _", F.col("a"), F.col("b"))))


def test_no_table_is_broadcast_by_an_estimate(spark):
    s = _space(spark)
    c = navigate.children(s, find(s, rel("_ of _", ANY, ANY))).where("role = 'member'")
    assert "BroadcastHashJoin" not in _plan(s.phrases(c, "child"))


def test_phrases_alone_are_merged_where_only_phrases_are_asked_for(spark):
    s = _space(spark)
    assert "sha2" not in _plan(s.expr.where("kind = 'phrase'").select("phrase"))
    assert _plan(s.expr.where("kind = 'rel'").select("members")).count("Exchange hashpartitioning") == 1


def test_equal_content_is_merged_across_statements_constants_and_templates(spark):
    df = spark.createDataFrame([("x", "tea"), ("x", "tea"), ("y", None)], "a string, b string")
    likes = lambda a, b: R("_ likes _", a, b)
    s = hashed_space(
        (df, likes(F.col("a"), F.col("b"))), (df, likes(F.col("a"), "tea")), (df, likes("x", "tea")), (df.where("a = 'none'"), R("_ never _", "q", "r")),
        (df, R("_ said _", F.col("a"), likes(F.col("a"), F.col("b")))), (df, R("_  likes  _", F.col("a"), "likes")), (df, R("_ is _", T("_ likes _"), "binary")),
    )
    assert s.expr.count() == s.expr.select("key").distinct().count()
    assert sorted(r[0] for r in s.expr.where("kind = 'phrase'").select("phrase").collect()) == ["binary", "is", "likes", "said", "tea", "x", "y"]
    assert s.expr.where("kind = 'tplt'").count() == 3
    assert find(s, rel("_ likes _", ANY, phrase("tea"))).count() == 2
    assert find(s, rel("_ likes _", ANY, ANY)).count() == 4
    assert find(s, rel("_ said _", ANY, rel("_ likes _", phrase("x"), phrase("tea")))).count() == 1
    assert find(s, rel("_ is _", template("_ likes _"), ANY)).count() == 1
    assert check.problems(s).isEmpty()


def test_search_for_a_template_that_no_table_states_reads_nothing(spark):
    s = _space(spark)
    found = find(s, eval_(rel("sort by _ right first", IT)))
    assert found.isEmpty() and "sha2" not in _plan(found)


def test_absent_children_look_up_each_address_once(spark):
    s = _space(spark, 200)
    plan = _plan(check.absent_children(s))
    assert plan.count("LeftAnti") == 1 and check.absent_children(s).isEmpty()
    from hyperweave.sources.space import Space

    broken = Space(s.expr.where("coalesce(phrase, '') <> 'b:1'"))
    assert check.absent_children(broken).count() == 100


def test_templates_go_to_their_relationships(spark):
    s = _space(spark)
    t = find(s, template("_ of _"))
    for df in (order.rels_using(s, t), check.misfit_rels(s)):
        assert "Broadcast" in _plan(df) and "SortMergeJoin" not in _plan(df)


def test_many_pointers_go_by_stops(spark, monkeypatch):
    """A line, trees and circles, with and without stops among them, as by doubling alone; and few rounds over all pointers."""
    from hyperweave.functions import frames

    line = [(i, i - 1) for i in range(1, 400)] + [(1000 + i, i * 7) for i in range(50)]
    rings = [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(3000, 3001), (3001, 3000), (3002, 3000), (3003, 3002)] + [(4000 + i, 2000 + i) for i in range(20)]
    links = spark.createDataFrame(line + rings, "node long, up long").withColumn("w", F.lit(1).cast("long"))
    compose = lambda mine, on: {"w": mine("w") + on("w")}
    plain = [sorted(map(tuple, x.collect())) for x in frames._pointed(links, compose)]
    monkeypatch.setattr(frames, "MANY_POINTERS", 100)
    seen, pointed = [], frames._pointed
    monkeypatch.setattr(frames, "_pointed", lambda rows, f: seen.append(rows.count()) or pointed(rows, f))
    ended, circling = frames.followed(links, compose)
    assert sorted(map(tuple, ended.collect())) == plain[0]
    assert sorted(r["node"] for r in circling.collect()) == [r[0] for r in plain[1]]
    assert len(seen) == 2 and seen[1] < 100


def test_stops_of_stops_are_fewer(spark, monkeypatch):
    """So many pointers that their stops are many, too: each level follows a part of what the one before it left."""
    from hyperweave.functions import frames

    links = spark.range(1, 1200).select(F.col("id").alias("node"), (F.col("id") - 1).alias("up"), F.lit(1).cast("long").alias("w"))
    monkeypatch.setattr(frames, "MANY_POINTERS", 20)
    monkeypatch.setattr(frames, "STOPS", 4)
    seen, followed = [], frames.followed

    def counted(rows, *more):
        seen.append(rows.count())
        assert len(seen) < 9 and (len(seen) == 1 or seen[-1] < seen[-2])
        return followed(rows, *more)

    monkeypatch.setattr(frames, "followed", counted)
    ended, circling = counted(links, lambda mine, on: {"w": mine("w") + on("w")})
    assert sorted(map(tuple, ended.collect())) == [(i, 0, i) for i in range(1, 1200)] and circling.isEmpty() and len(seen) > 3


def test_few_pointers_take_several_steps_a_round(spark, monkeypatch):
    from hyperweave.functions import frames

    links = spark.range(1, 1200).select(F.col("id").alias("node"), (F.col("id") - 1).alias("up"), F.lit(1).cast("long").alias("w"))
    rounds, stored = [], frames.stored
    monkeypatch.setattr(frames, "stored", lambda df: rounds.append(1) or stored(df))
    ended, circling = frames.followed(links, lambda mine, on: {"w": mine("w") + on("w")})
    assert sorted(map(tuple, ended.collect())) == [(i, 0, i) for i in range(1, 1200)] and circling.isEmpty() and len(rounds) <= 7


def test_texts_of_templates_settle_no_facts(spark, monkeypatch):
    """What search_templates settles on the way to two texts is as small as they are, however many facts there are."""
    import __spark_entry__ as driver
    from hyperweave.functions import frames, render
    from hyperweave.sources import space

    sizes, settled = [], frames.settled

    def counted(df):
        out = settled(df)
        sizes.append(out.count())
        return out

    for module in (render, space):
        monkeypatch.setattr(module, "settled", counted)
    found = driver.queries()["search_templates"](spark, "/root/testdata/sf0.001")
    assert sorted(r["name"] for r in found.collect()) == ["_ in _", "_ supplies _"] and sizes and max(sizes) <= 20


@pytest.mark.parametrize("name", ["quant_for_some", "quant_test", "search_and", "search_bind", "search_collapsed"])
def test_phrases_of_facts_are_merged_in_hash_tables_by_their_texts(spark, name):
    """Whole expressions, merged by key, were sorted for it, and the memory of a task grew with them."""
    import __spark_entry__ as driver

    plan = _plan(driver.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "SortAggregate" not in plan and "hashpartitioning(key" not in plan and "hashpartitioning(phrase" in plan
