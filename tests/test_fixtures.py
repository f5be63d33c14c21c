"""Small literal spaces with known answers."""

import pytest
from pyspark.sql import functions as F

from hyperweave.functions import render as text
from hyperweave.functions.render import render
from hyperweave.operators import check, edit, navigate, order, relation, search, transitive
from hyperweave.operators.search import ANY, IT, addr, eval_, find, frame, involves, it, phrase, rel, roles, template
from hyperweave.sources import facts
from hyperweave.sources.facts import R
from hyperweave.sources.space import SEED, Space, empty_space, graph_from_adjacency, read_rslt, read_space, rows_to_expr, space_from_expr, write_space

P, T, REL = "phrase", "tplt", "rel"
F1 = [(0, P, ""), (1, P, "dog"), (2, P, "oxygen"), (3, P, "needs"), (4, T, (None, [3], None)), (5, REL, ([1, 2], 4)), (6, REL, ([5, 2], 4))]
F3 = [*F1[:4], (4, T, (None, [3], 1)), *F1[5:]]
F4 = [*((i, P, str(i)) for i in range(4)), (4, T, (None, [], None)), (5, T, (None, [0], None)), (6, REL, ([1], 4)), (7, REL, ([1, 2], 5)), (8, REL, ([6, 7], 5)), (9, REL, ([2, 3], 5)), (10, REL, ([7, 8], 5))]
F5 = [
    (0, P, ""), (1, REL, ([2, 3], 8)), (2, P, "fish"), (3, P, "water"), (4, P, "need"), (5, P, "like"), (6, P, "jumping"), (7, T, (None, [4], None)), (8, T, (None, [5], None)),
    (9, REL, ([2, 3], 7)), (10, REL, ([2, 6], 8)), (11, P, "horses"), (12, REL, ([11, 6], 8)), (13, P, "exercise"), (14, P, "is"), (15, T, (None, [14], None)), (16, REL, ([6, 13], 15)),
    (17, P, "dolphins"), (18, REL, ([17, 2], 7)), (19, REL, ([17, 3], 8)),
]


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: space_from_expr(rows_to_expr(spark, rows)).cached()


def got(df):
    return sorted(r[0] for r in df.collect())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def statements(spark, lines, template_text="_ a _"):
    """A space with the seed rows and one binary fact for each pair."""
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(lines)], "i long, a string, b string")
    s, _ = facts.load(empty_space(spark), df, R(template_text, F.col("a"), F.col("b")), F.col("i"))
    return s


def at(spark, s, *names):
    return s.expr.where(F.col("phrase").isin(*map(str, names))).select("addr")


def names(s, df, column="addr"):
    return sorted(r["x"] for r in s.phrases(df, column, "x").collect())


def test_positions_and_hosts(make, spark):
    s = make(F3)
    assert rows(s.pos.select("host", "role", "ix", "child")) == [(4, "cap_right", 0, 1), (4, "sep", 1, 3), (5, "member", 1, 1), (5, "member", 2, 2), (5, "tplt", 0, 4), (6, "member", 1, 5), (6, "member", 2, 2), (6, "tplt", 0, 4)]
    one = spark.createDataFrame([(1,)], "addr long")
    assert rows(navigate.hosts(s, one).select("role", "ix", "host")) == [("cap_right", 0, 4), ("member", 1, 5)]
    assert rows(navigate.variety(make(F1), spark.createDataFrame([(3,), (4,), (5,)], "addr long"))) == [(3, "phrase", 0), (4, "tplt", 2), (5, "rel", 2)]


def test_search_by_role(make, spark):
    s = make(F4)
    assert got(find(s, roles({1: addr(2)}))) == [9]
    assert got(find(s, roles({1: addr(10)}))) == []
    assert got(find(s, eval_(roles({1: addr(2)}), (1,)))) == [2]
    assert got(find(s, roles({2: eval_(roles({1: addr(2)}), (1,))}))) == [7]
    assert got(find(s, addr(1, (3, 5)))) == [1, 3, 4, 5]
    groups = navigate.host_groups(s, spark.createDataFrame([(2,)], "addr long"))
    assert rows(groups.select("group", "ix", "tplt", "hosts")) == [("member", 1, 5, [9]), ("member", 2, 5, [7])]


def test_search_by_text(make, spark):
    s = make(F5)
    like = template("_ like _")
    assert got(find(s, roles({"t": like}))) == [1, 10, 12, 19]
    assert got(find(s, rel("_ like _", phrase("fish"), ANY))) == [1, 10]
    assert got(find(s, eval_(rel("_ like _", IT, eval_(rel("_ is _", IT, phrase("exercise"))))))) == [2, 11]
    assert got(find(s, eval_(rel("_ need _", IT, ANY)) & eval_(rel("_ need _", ANY, IT)))) == [2]
    assert got(find(s, eval_(rel("_ like _", it(addr(2, 17)), ANY)))) == [2, 17]
    assert got(find(s, involves(phrase("exercise"), 1))) == [16]
    assert got(find(make(F1), involves(phrase("dog"), 2))) == [5, 6]
    env = spark.createDataFrame([(2,), (17,)], "who long")
    assert rows(find(s, rel("_ need _", search.var("who"), ANY), env).select("addr", "who")) == [(9, 2), (18, 17)]
    assert rows(search.match_counts(s, spark.createDataFrame([(2,), (3,), (0,)], "addr long"), {"n": search.member_of(search.var("it"))})) == [(0, 0), (2, 4), (3, 3)]


def test_errors(make):
    s = make(F1)
    with pytest.raises(ValueError):
        find(s, ANY)
    with pytest.raises(ValueError):
        find(s, search.var("x"))
    with pytest.raises(ValueError):
        search.all_of()
    with pytest.raises(ValueError):
        involves(phrase("dog"), 0)
    with pytest.raises(ValueError):
        rel("_ needs _", phrase("dog"))
    assert got(find(s, phrase("cat"))) == []
    with pytest.raises(LookupError):
        find(Space(s.expr, s.pos, strict=True), phrase("cat"))


def test_paths_into_sub_expressions(make):
    s = make([*F1, (7, REL, ([5, 5], 4))])
    assert got(find(s, eval_(addr(7), (2, 1), (1,)))) == [1, 5]
    depth = dict(rows(navigate.with_depth(s)))
    assert (depth[1], depth[4], depth[5], depth[6]) == (0, 0, 1, 2)


def test_depth_of_deep_chains(make):
    s = make([(0, P, "a"), (1, P, "is"), (2, T, (None, [1], None)), (3, REL, ([0, 0], 2)), *((i, REL, ([i - 1, 0], 2)) for i in range(4, 73)), (100, REL, ([100, 0], 2))])
    depth = dict(rows(navigate.with_depth(s)))
    assert depth[72] == 70 and max(depth.values()) == 70 and 100 not in depth


def test_quoted_text(spark, tmp_path):
    quoted = {"caf\\233": "caf\u00e9", "\\1076\\1072": "\u0434\u0430", "\\1234\\&5": "\u04d25", "a\\\"b\\\\c\\nd": 'a"b\\c\nd', "\\SO\\&H\\SOH": "\x0eH\x01", "\\x41\\o102\\DEL": "AB\x7f", "\\128512": "\U0001f600", "": "", "\\\\n": "\\n"}
    for i, body in enumerate(quoted):
        (tmp_path / f"{i}.rslt").write_text(f'p "{body}"\n')
    got = {r["addr"]: r["phrase"] for r in read_rslt(spark, str(tmp_path)).expr.collect()}
    assert [got[i] for i in range(len(quoted))] == list(quoted.values())


def test_sets_and_lists(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "b long")
    assert got(relation.intersections(one(1, 2, 3), one(2, 3, 3), one(3, 4))) == [3] and got(relation.intersections(one(1, 1))) == [1]
    maps = [spark.createDataFrame(x, "key long, items array<long>") for x in ([(1, [1, 2]), (2, [])], [(1, [2, 3]), (3, None), (2, [5])])]
    assert rows(relation.union_by_key(*maps)) == [(1, 1), (1, 2), (1, 3), (2, 5)]
    lists = spark.createDataFrame([(0, [1, 5, 6, 2]), (1, [1, 2]), (2, [5, 1, 6]), (3, []), (4, [7, 8]), (5, None)], "k long, x array<long>")
    split = {r["k"]: r["s"] and tuple(r["s"]) for r in lists.select("k", text.split_around(F.col("x"), lambda v: v >= 5).alias("s")).collect()}
    assert split == {0: ([1], [5, 6], [2]), 1: ([1, 2], [], []), 2: None, 3: ([], [], []), 4: ([], [7, 8], []), 5: None}
    words = spark.createDataFrame([("a1b2",), ("none",), (None,)], "x string").select(text.substituted(F.col("x"), "[0-9]", "-")).collect()
    assert [r[0] for r in words] == ["a-b-", "none", None]


def test_integrity(make):
    bad = make([*F1, (1001, REL, ([1, 2], 5)), (1002, REL, ([1, 2], -1000))])
    assert got(check.misfit_rels(bad)) == [1001, 1002]
    assert rows(check.absent_children(bad)) == [(1002, [-1000])]
    assert got(check.null_templates(make(F4))) == [4]
    assert check.problems(make(F4)).isEmpty()


def test_rendering(make, spark):
    s = make(F3)
    text = lambda s, a, **k: render(s, spark.createDataFrame([(a,)], "addr long"), **k).first()["text"]
    assert text(s, 5, max_depth=3, as_addr=spark.createDataFrame([(1,)], "addr long")) == "@1 #needs oxygen #@1"
    assert text(s, 5, max_depth=3) == "dog #needs oxygen #dog"
    assert text(s, 4) == "_ needs _ dog"
    nested = [(0, P, "trees"), (1, P, "Earth"), (2, P, "CO2"), (3, P, "in"), (4, P, "eat"), (5, T, (None, [3], None)), (6, T, (None, [4], None)), (7, REL, ([0, 1], 5)), (8, REL, ([7, 2], 6))]
    s = make(nested)
    assert text(s, 8, max_depth=2) == text(s, 8) == "trees #in Earth ##eat CO2"
    assert text(s, 8, max_depth=1) == "(trees #in Earth) #eat CO2"


def test_load_numbers_and_merges(spark):
    one = spark.createDataFrame([(0, "x", "y"), (1, "x", "y"), (2, "y", "is")], "i long, a string, b string")
    s, report = facts.load(empty_space(spark), one, R("bar _ _ foo", F.col("a"), F.col("b")), F.col("i"))
    # bar 10, foo 11, the template 12 (its separator "" is there already), x 13, y 14, the fact 15; then the fact (y, is).
    assert rows(report) == [(0, 15, True), (1, 15, True), (2, 16, True)]
    assert s.expr.where("addr = 12").first()["seps"] == [0]
    assert s.expr.where("addr = 16").first()["members"] == [14, 2]
    again, report = facts.load(s, one, R("bar _ _ foo", F.col("a"), F.col("b")), F.col("i"))
    assert not any(r["is_new"] for r in report.collect()) and again.expr.count() == s.expr.count() == len(SEED) + 7
    assert check.problems(s).isEmpty() and check.duplicate_content(s).isEmpty()


def test_edits(make, spark):
    s = make(F1)
    frame_of = lambda rows, schema: spark.createDataFrame(rows, schema)
    same, left = edit.delete_unused(s, frame_of([(5,)], "addr long"))
    assert got(left) == [5] and same.expr.count() == 7
    both, left = edit.delete_unused(s, frame_of([(5,), (6,)], "addr long"), cascade=True)
    assert left.isEmpty() and got(both.expr) == [0, 1, 2, 3, 4]
    new = edit.replace_in_role(s, frame_of([(5, "member", 2, 1)], "host long, role string, ix int, new long"))
    assert new.expr.where("addr = 5").first()["members"] == [1, 1]
    foo = edit.replace(s, rows_to_expr(spark, [(1, P, "foo")]))
    assert names(foo, foo.expr.where("addr = 1")) == ["foo"] and foo.expr.where("addr = 5").first()["members"] == [1, 2]
    moved = edit.readdress(s, frame_of([(1, 2)], "old long, new long"))
    assert moved.expr.where("addr = 2").first()["phrase"] == "dog" and moved.expr.where("addr = 7").first()["phrase"] == "oxygen"
    assert moved.expr.where("addr = 5").first()["members"] == [2, 7]
    merged = edit.substitute(s, frame_of([(2, 1)], "old long, new long"))
    assert merged.expr.where("addr = 5").first()["members"] == [1, 1]
    with pytest.raises(ValueError):
        edit.insert_rows(s, rows_to_expr(spark, [(5, P, "taken")]))
    assert edit.insert_rows(s, rows_to_expr(spark, [(9, P, "new")])).expr.count() == 8


def test_separate(spark):
    s = statements(spark, [(1, 10), (2, 10), (1, 11), (10, 2)])
    s, left = edit.separate(s, find(s, template("_ a _")), at(spark, s, 1, 2), at(spark, s, 10, 11))
    assert left.isEmpty() and find(s, rel("_ a _", ANY, ANY)).isEmpty()


def test_chains(spark):
    s = statements(spark, [("p", "q")], "_ x _")
    df = s.expr.where(F.col("phrase").isin("transitive", "is", "before")).select("addr")
    for earlier, want in (("left", [("before", "nothing")]), ("right", None)):
        t = find(s, template("_ x _"))
        new = edit.insert_chain(s, t, df, "addr", "addr", earlier=earlier)
        e = transitive.edges(new, t).select("src", "dst")
        assert [(a, b) if earlier == "left" else (b, a) for a, b in rows(e.where("src < 10 AND dst < 10"))] and e.count() == 3
        assert want is None or set(rows(e)) >= {(1, 2), (2, 5)}


def test_order_edits(spark):
    s = statements(spark, [(1, 2), (2, 3), (8, 9)])
    t = find(s, template("_ a _"))
    ix = lambda *n: s.expr.where(F.col("phrase").isin(*map(str, n))).select("addr", F.col("phrase").cast("int").alias("ix"))
    longer = edit.append_to_order(s, t, ix(1, 2, 3), ix(8, 9))
    assert rows(transitive.edges(longer, t).select("src", "dst").join(s.expr.select(F.col("addr").alias("src"), "phrase"), "src").where("phrase = '3'").join(s.expr.select(F.col("addr").alias("dst"), F.col("phrase").alias("to")), "dst").select("to")) == [("8",)]
    cut, walks = edit.remove_from_order(s, t, at(spark, s, 1, 2), at(spark, s, 3))
    assert walks.isEmpty() and got(transitive.edges(cut, t).select("rel")) != got(transitive.edges(s, t).select("rel"))
    kept, walks = edit.remove_from_order(s, t, at(spark, s, 1), at(spark, s, 3))
    assert walks.count() == 1 and kept is s


def test_transitive(spark):
    line = statements(spark, [(0, 1), (1, 2), (2, 3)])
    t = find(line, template("_ a _"))
    assert names(line, find(line, search.reach(rel("_ a _", phrase("1"), ANY)))) == ["1", "2", "3"]
    assert names(line, find(line, search.reach(rel("_ a _", ANY, phrase("1"))))) == ["0", "1"]
    assert transitive.closure(line, t, at(spark, line, 0, 1, 2, 3)).count() == 10
    assert not order.has_cycle(line, t)
    fork = statements(spark, [("a", "b"), ("b", "b1"), ("b", "b2"), ("x", "b2"), ("x", "b3"), ("a", "c"), ("d", "e")])
    tf = find(fork, template("_ a _"))
    for way in ("left", "right"):
        pairs = transitive.reach_pairs(fork, tf, at(spark, fork, "a", "x"), at(spark, fork, "b", "b2"), way)
        assert sorted(zip(*(map(str, [r[c] for r in fork.phrases(fork.phrases(pairs, "left", "l"), "right", "r").orderBy("l", "r").collect()]) for c in ("l", "r")), strict=True)) == [("a", "b"), ("a", "b2"), ("x", "b2")]
        both = [frame(at(spark, fork, *n)) for n in (("a", "x"), ("b",))]
        assert names(fork, find(fork, search.trans(way, rel("_ a _", it(both[0]), both[1])))) == ["a"]


def test_cycles(spark):
    ring = statements(spark, [(-1, 0), (0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5)])
    t = find(ring, template("_ a _"))
    word = {r["addr"]: r["phrase"] for r in ring.expr.where("kind = 'phrase'").collect()}
    paths = lambda start, way: [[word[x] for x in r["path"]] for r in transitive.cycles(ring, t, at(spark, ring, start), way).collect()]
    assert paths(1, "right") == [["1", "2", "3", "1"]]
    assert paths(1, "left") == [["1", "3", "2", "1"]]
    assert paths(4, "right") == paths(0, "left") == []
    assert order.has_cycle(ring, t)
    with pytest.raises(order.CycleError):
        order.topo_sort(ring, t, at(spark, ring, 1, 2))
    assert len(names(ring, find(ring, search.reach(rel("_ a _", phrase("1"), ANY))))) == 5
    kernels = t.select(F.col("addr").alias("tplt")).crossJoin(at(spark, ring, 1, 4))
    assert transitive.recheck_cycles(ring, kernels).count() == 1


def test_paths_between(spark):
    s = statements(spark, [(1, 10), (10, 11), (1, 20), (20, 21)], "_ b _")
    t = find(s, template("_ b _"))
    word = {r["addr"]: r["phrase"] for r in s.expr.where("kind = 'phrase'").collect()}
    found = transitive.paths(s, t, at(spark, s, 1), at(spark, s, 10, 11, 21))
    assert sorted([word[x] for x in r["path"]] for r in found.collect()) == [["1", "10"], ["1", "20", "21"]]


def test_sorting(spark):
    s = statements(spark, [(0, 1), (1, 2), (2, 3)])
    t = find(s, template("_ a _"))
    seq = lambda df: [r["phrase"] for r in df.join(s.expr.select("addr", "phrase"), "addr").orderBy("is_isolated", "level", "addr").collect()]
    some = at(spark, s, 0, 1, 3, "before")
    assert seq(order.topo_sort(s, t, some)) == ["0", "1", "3", "before"]
    assert seq(order.topo_sort(s, t, some, "right")) == ["3", "1", "0", "before"]
    assert names(s, order.tops(s, t, at(spark, s, 0, 1, 2, 3))) == ["0"]
    assert names(s, order.tops(s, t, at(spark, s, 0, 1, 2, 3), "right")) == ["3"]
    tree = statements(spark, [("0", "00"), ("0", "01"), ("01", "010"), ("01", "011"), ("00", "000"), ("00", "001")])
    pre = order.preorder(tree, find(tree, template("_ a _")), tree.expr.where("kind = 'phrase'").select("addr"))
    assert [r["phrase"] for r in pre.join(tree.expr.select("addr", "phrase"), "addr").orderBy("path").collect()] == ["0", "00", "000", "001", "01", "010", "011"]


def test_default_order(spark):
    from hyperweave.sources.facts import T as Tp

    one = spark.createDataFrame([(0,)], "i long")
    s = empty_space(spark)
    for a, b in (("_ a _", "_ b _"), ("_ b _", "_ c _")):
        s, _ = facts.load(s, one, R("sort by _ before _", Tp(a), Tp(b)), F.col("i"))
    s, _ = facts.load(s, one, R("sort by _", Tp("_ lone _")), F.col("i"))
    s, _ = facts.load(s, one, R("sort by _ right first", Tp("_ b _")), F.col("i"))
    s, _ = facts.load(s, one, R("_ b _", "x", "y"), F.col("i"))
    texts = {r["addr"]: r["text"] for r in render(s, s.expr.where("kind = 'tplt'").select("addr")).collect()}
    ranked = [texts[r["addr"]] for r in order.sort_priority(s).collect()]
    assert ranked == ["_ a _", "_ b _", "_ c _", "_ lone _"]
    assert [texts[r["addr"]] for r in order.first_applicable(s, at(spark, s, "x")).collect()] == ["_ b _"]
    assert order.first_applicable(s, at(spark, s, "transitive")).isEmpty()
    found = find(s, template("_ a _") | template("_ b _"))
    assert sorted((texts[r["addr"]], r["earlier"]) for r in order.orientation(s, found).collect()) == [("_ a _", "left"), ("_ b _", "right")]


def test_files(spark, tmp_path):
    for name, body in {"0": 'p ""', "1": 'p "dog"', "2": 'p "oxygen"', "3": 'p "needs"', "4": "t Nothing [3] (Just 1))", "5": "r [1,2] 4)", "6": "r [5,2] 4)"}.items():
        (tmp_path / f"{name}.rslt").write_text(body + "\n")
    (tmp_path / "note.txt").write_text("ignored")
    s = read_rslt(spark, str(tmp_path))
    want = space_from_expr(rows_to_expr(spark, F3))
    assert rows(s.expr.select("addr", "kind", "phrase", "tplt", "members", "cap_left", "seps", "cap_right", "key").fillna("")) == rows(want.expr.select("addr", "kind", "phrase", "tplt", "members", "cap_left", "seps", "cap_right", "key").fillna(""))
    write_space(s, str(tmp_path / "out"))
    assert read_space(spark, str(tmp_path / "out")).expr.count() == 7


def test_graph(spark):
    edges, nodes = graph_from_adjacency(spark.createDataFrame([(1, [11, 12]), (2, [12]), (3, [])], "parent long, children array<long>"))
    assert rows(navigate.inverted(edges)) == [(11, [1]), (12, [1, 2])]
    assert got(nodes) == [1, 2, 3, 11, 12]
