"""Reply trees, spelling variants and the filter audit against brute force, on small tables that hold the awkward cases."""

import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperweave.llm import chat_format, filter_audit, spelling

MESSAGE = "tree long, node long, parent long, role string, text string, score double, rank string, leaf string"


def tree_rows(seed=2):
    rng, rows = random.Random(seed), []
    marks = ["", None, "\\", "</turn>", "<\\/turn>", "####", "#" * 9, "### Assistant: x", "a\n</turn>\n### User: b", "漢字\\", "x " * 9000, "\\### Assistant: </turn> ok"]
    roles = ["system", "user", "assistant", "tool: a", "Assistant", "", None, "</turn>", "a:", "###\\"]
    for tree in range(6):
        for node in range(25):
            rows.append((tree, node, rng.randrange(node) if node else None, rng.choice(roles), rng.choice(marks), rng.choice([0.0, 1.0, 2.0, None])))
    rows += [(7, n, n - 1 if n else None, "assistant" if n % 2 else "user", f"turn {n}", 1.0) for n in range(70)]  # a chain
    rows += [(8, 1, 2, "user", "circle", 1.0), (8, 2, 1, "user", "circle", 1.0), (8, 3, 2, "user", "hangs on a circle", 1.0)]
    rows += [(9, 5, 4, "user", "its parent is absent", None), (9, 6, 5, "assistant", "reply", 3.0), (9, None, 5, "user", "no id", 1.0)]
    rows += [(None, 1, None, "user", "no tree", 1.0), (None, 2, 1, "assistant", "reply", 1.0)]
    return [(*r, "r", "l") for r in rows + rows[:3]]


def brute_branches(rows, best, by):
    """(tree, leaf, rank) -> messages from the root down."""
    trees = {}
    for t, n, p, role, text, score, *_ in rows:
        if n is not None:
            trees.setdefault(t, {})[n] = (p, role or "", text or "", score or 0.0)
    out = {}
    for t, nodes in trees.items():
        found = []
        parents = {m[0] for m in nodes.values()}
        for leaf in nodes.keys() - parents:
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at in path:
                continue
            total = sum(nodes[x][3] for x in path)
            found.append((-(total if by == "total" else total / len(path)), leaf, [nodes[x][1:3] for x in path[::-1]]))
        for rank, (_, leaf, path) in enumerate(sorted(found), 1):
            if best is None or rank <= best:
                out[t, leaf, rank if best else None] = path
    return out


@pytest.mark.parametrize(("best", "by"), [(1, "total"), (3, "mean"), (None, "total")])
def test_reply_trees(spark, best, by):
    rows = tree_rows()
    chats = chat_format.conversations(spark.createDataFrame(rows, MESSAGE).repartition(3), best, by)
    texts = {(r["tree"], r["leaf"]): r for r in chats.collect()}
    wanted = brute_branches(rows, best, by)
    assert {(r["tree"], r["leaf"], r["rank"]) for r in texts.values()} == set(wanted)
    back = {(r["tree"], r["leaf"]): r for r in chat_format.read_back(chats).collect()}
    for (tree, leaf, _), path in wanted.items():
        assert [tuple(t) for t in back[tree, leaf]["turns"]] == path
        assert back[tree, leaf]["loss"] == "".join(text for role, text in path if role == "assistant")
        assert back[tree, leaf]["n_chars"] == len(texts[tree, leaf]["text"]) and texts[tree, leaf]["n_turns"] == len(path)
        assert texts[tree, leaf]["text"].count("</turn>") == len(path)  # no text holds the mark


def test_reply_trees_empty(spark):
    assert chat_format.read_back(chat_format.conversations(spark.createDataFrame([], MESSAGE))).count() == 0


def test_turns_without_order(spark):
    rows = [(1, 2, "user", "c"), (1, None, "system", None), (1, 1, "user", "b"), (1, 1, "assistant", "a"), (None, 1, None, "x")]
    chats = chat_format.conversations(chat_format.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["tree"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_back(chats).collect()}
    assert got == {1: [("system", ""), ("assistant", "a"), ("user", "b"), ("user", "c")], None: [("", "x")]}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count):
    near = {w: [x for x in count if x != w and one_edit(w, x)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, n, len(near[w]), form[w], count[form[w]] if form[w] is not None else None, root(w)) for w, n in count.items()}


def vocabulary(seed=4):
    rng = random.Random(seed)
    count = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 9)))
        for n in (4000, 700, 90, 11, 2, 2):
            count.setdefault(word, n)
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[:i] + "b" + word[i + 1 :]])
    count |= {"": 7, "a" * 40_000: 3, "a" * 39_999 + "b": 30, "a" * 39_999: 3}
    return count


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 20)
    count = vocabulary()
    rows = [(w, n, "kept") for w, n in count.items() if w != "aaaaa"] + [(None, 9, "k"), ("aaaaa", 4, "k"), ("aaaaa", None, "k")]
    count["aaaaa"] = 4
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long, form string").repartition(3))
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute_variants(count)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_sampled_cells(spark, monkeypatch):
    """A sample far smaller than the table, and words whose letters are all alike, change nothing."""
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 50)
    monkeypatch.setattr(spelling, "CELL_WORDS", 8)
    monkeypatch.setattr(spelling, "CELL_SAMPLE", 2)
    anagrams = {"".join(p): 10 + i for i, p in enumerate(permutations("abcdef"))} | {"abcde" + c: 900 for c in "xyz"} | {"".join(p): 1 for p in permutations("abcde")}
    got = spelling.variants(spark.createDataFrame([*anagrams.items()], "word string, n long"))
    assert {tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute_variants(anagrams)


def test_slips(spark):
    rows = [(i, "Étude NAÏVE Übung " + "wörter " * (i % 3)) for i in range(300)] + [(None, "plain Text"), (5, None), (6, "")]
    got = sorted(r["word"] for r in spelling.with_slips(spelling.runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = []
    for i, text in rows:
        for w in (text or "").split():
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            wanted.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w)
    assert got == sorted(wanted) and len({w for w in wanted}) > 4


def test_trees_agree_with_a_scan():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (500, spelling.CLASSES)).astype(np.int16) * (rng.random(spelling.CLASSES) < 0.3)
    queries = points[:50] + rng.integers(-1, 2, (50, spelling.CLASSES)) * (rng.random((50, spelling.CLASSES)) < 0.05)
    for tight in (True, False):
        tree = spelling.KdTree(points, 10, tight)
        assert sorted(np.concatenate([o for o in tree.own if o is not None]).tolist()) == list(range(500))
        found = {(q, p) for k, rows in tree.within(queries, 1, 1) for q in rows.tolist() for p in tree.own[k].tolist()}
        for q in range(50):
            d = points - queries[q]
            assert {(q, p) for p in np.flatnonzero((np.maximum(d, 0).sum(1) <= 1) & (np.maximum(-d, 0).sum(1) <= 1)).tolist()} <= found


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = t.encode().split()
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)) + "D" * any(c in t for c in "#$%&*|")
        fails += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_all[f] += len(gone)
                fails = sum(f in r[1] for r in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_all[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(6)
    long = " ".join(f"w{i}" for i in range(220))
    kinds = [long, long + " X" * 300, "short", "SHORT", "a | b", long + " $", "x " * 250, "", None, "UP " * 300, "\x0b\x1c   " * 70, long.upper() + "#"]
    docs = [(rng.randrange(60), rng.choice(kinds), rng.choice(["web", "books", "", None])) for _ in range(150)] + [(None, long, "web"), (None, long, "web"), (None, "short", None)]
    docs += docs[:4]
    labels = [(rng.randrange(70), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(60)] + [(None, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n long, mask string").repartition(3)
    cells = filter_audit.document_cells(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(cells, "ABCDE")
    assert {tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()} == brute_audit(docs, labels)
    assert got.count() == 600 * 3
    assert filter_audit.audit(filter_audit.document_cells(table.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "ABCDE").count() == 0


def test_audit_of_chosen_orders(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 3, 1, 0, 0), ("p", 2, 4, 0, 2), (None, 1, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {tuple(r) for r in filter_audit.audit(cells, "XY", ["YX", "X"]).where("part = 'p'").collect()}
    assert got == {("p", "YX", 1, 5, 7, 0, 4, 1, 3, 11), ("p", "YX", 2, 5, 0, 3, 0, 0, 0, 3), ("p", "X", 1, 9, 3, 0, 0, 1, 1, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "XX")


def test_walk_agrees_with_a_count():
    rng = np.random.default_rng(2)
    masks, sizes = np.arange(64), rng.integers(0, 9, (64, 2))
    at = filter_audit.states(masks, sizes, 6)
    for active in range(64):
        assert (at[active] == sizes[(masks & active) == 0].sum(0)).all()
