"""Each operator against a brute-force version on small tables that hold the awkward cases."""

import base64
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from hyperweave.llm import byte_bpe, components, decontaminate, license_scan, quality_gam, rlz_dedup, simhash, suffix_dedup, token_shards, topk_search, url_filter
from hyperweave.llm.anchors import gram_hashes, spans

SCHEMA = "doc_id long, text string, score double, kept string, tag string, verdict string"


def texts(words, seed=1):
    """Copies, near copies, shared passages, repeats within a text, nulls, empty and very long texts, a repeated row."""
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(120)
    near = base.split()
    near[50] = "changed"
    out = [make(80), base, base, " ".join(near), make(30) + "\n" + passage + "\t" + make(20), passage, make(10) + " " + passage, None, "", "   \n", "one", make(34), make(35), make(40) + " " + make(5) * 3]
    loop = make(7)
    out += [" ".join([loop] * 12), "a" * 5000, "ab" * 300, make(6000), "é ü 漢字 " * 40, "x\u00a0y  z\r\n\x0b" * 30, base.upper()]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, words):
    rows = [(i, t, 1.0, "k", "t", "v") for i, t in texts(words)]
    rows += [rows[0], (None, "no id here " * 20, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_spans_agree_between_equal_windows():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5, 70_000).astype(np.uint64)
    a[40_000:40_500] = a[100:600]
    starts, ends, places, hashes = spans(a, 50, 12)
    assert starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(a) - 49
    assert ((places >= ends - 1) & (places <= starts + 38)).all()
    at = lambda i: (places[np.searchsorted(starts, i, "right") - 1] - i, hashes[np.searchsorted(starts, i, "right") - 1])
    for i in range(100, 551):
        assert at(i) == at(i + 39_900)
    assert gram_hashes(a, 12)[100] == gram_hashes(a, 12)[40_000]
    assert all(len(x) == 0 for x in spans(a[:49], 50, 12))


def brute_rlz(rows, window=35):
    seen: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] = seen.get(tuple(w[k : k + window]), 0) + 1
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def brute_later(rows, window=35):
    """Words covered by windows that also start earlier; rows in order of id."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if tuple(w[k : k + window]) in seen:
                gone.update(range(k, k + window))
            seen.add(tuple(w[k : k + window]))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize(("block", "share"), [(20_000, 0.9), (0, 0.9), (3, 0.0)])
def test_rlz(docs, empty, monkeypatch, block, share):
    """Also with blocks so small that windows meet by hash, and with all anchors taken as frequent."""
    monkeypatch.setattr(rlz_dedup, "BLOCK_PHRASES", block)
    monkeypatch.setattr(rlz_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(rlz_dedup, "HOT_TEXTS", 30 if share else 1)
    got = sorted((tuple(r) for r in rlz_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == brute_rlz([(r["doc_id"], r["text"]) for r in docs.collect()])
    one = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = sorted(tuple(r) for r in rlz_dedup.dedup(one, keep_first=True).select("doc_id", "kept").collect())
    assert kept == brute_later(sorted(tuple(r) for r in one.collect()))
    assert rlz_dedup.dedup(empty).count() == 0


def test_rlz_keeps_clashing_columns(docs):
    names = ("id", "ranges", "range_start", "doc", "tag", "start", "n", "row", "first", "a.b")
    df = docs.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    rows = rlz_dedup.dedup(df).collect()
    assert len(rows) == docs.count() and all(r[c] == k for r in rows for k, c in enumerate(names))


def test_rlz_tells_rows_without_id_apart(spark, words):
    """Two texts without ids whose 32-bit hashes are equal: the one that shares nothing loses nothing."""
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, n = make(40), 400_000
    tails = spark.createDataFrame([(make(30), make(30))], "a string, b string")
    ids = spark.range(n)
    left = ids.crossJoin(tails).select(F.concat_ws(" ", F.lit(shared), F.col("id").cast("string"), "a").alias("x"))
    right = ids.crossJoin(tails).select(F.concat_ws(" ", "b", F.col("id").cast("string"), "a").alias("y"))
    met = left.withColumn("h", F.hash("x")).join(right.withColumn("h", F.hash("y")), "h").select("x", "y").first()
    df = spark.createDataFrame([(None, met["x"]), (None, met["y"]), (1, shared), (2, None), (2**63 - 1, "x " * 20)], "doc_id long, text string")
    got = {r["kept"]: r["n_removed"] for r in rlz_dedup.dedup(df).collect()}
    assert got[met["y"]] == 0 and got[met["x"][len(shared) + 1 :]] == 40


def test_rlz_factors(spark, words):
    """Factors are the longest copies, from the source's own place, and end where text and source part."""
    rng = random.Random(9)
    make = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    source, x, y = make(300), make(70), make(80)
    texts = {0: source, 1: [*x, *source[20:140], *y, *source[150:190], *source[200:290]], 2: [*source[100:134], *make(5)], 3: [*source[60:95], *make(40)]}
    df = spark.createDataFrame([(i, 0, " ".join(w)) for i, w in texts.items()], "doc long, tag long, text string")
    windows = {}
    for i, w in texts.items():
        for k in range(len(w) - 34):
            windows.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    got = rlz_dedup.factors(df).collect()
    told = {(r["doc"], r["start"] + k) for r in got for k in range(r["n"])}
    assert told == {p for places in windows.values() if len(places) > 1 for p in places}
    for r in got:
        a, b = texts[r["doc"]][r["start"] : r["start"] + r["n"] + 34], texts[r["src_doc"]][r["src_start"] : r["src_start"] + r["n"] + 34]
        assert a == b and len(a) == r["n"] + 34 and (r["doc"], r["start"]) != (r["src_doc"], r["src_start"])
    later = [(r["start"], r["n"] + 34, r["src_start"]) for r in got if r["doc"] == 1 and not r["first"]]
    joined = []
    for s, n, src in sorted(later):
        if joined and joined[-1][0] - joined[-1][2] == s - src and s <= joined[-1][0] + joined[-1][1] - 34:
            joined[-1] = (joined[-1][0], max(joined[-1][1], s + n - joined[-1][0]), joined[-1][2])
        else:
            joined.append((s, n, src))
    assert joined == [(70, 120, 20), (270, 40, 150), (310, 90, 200)]
    assert {r["doc"] for r in got} == {0, 1, 3}


def brute_suffix(rows, window):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if b[k : k + window] in seen:
                gone[k : k + window] = True
            seen.add(b[k : k + window])
        out.append((i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize(("group", "parts"), [(2048, 1), (2, 7)])
def test_suffixes(docs, empty, spark, monkeypatch, group, parts):
    """Also with groups so small, and so many parts, that windows are exchanged by hash."""
    monkeypatch.setattr(suffix_dedup, "GROUP_RECORDS", group)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 20_000 * group)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        one = docs.dropDuplicates(["doc_id"])
        got = sorted((r["doc_id"] if r["doc_id"] is not None else 10**6, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(one).collect())
        rows = sorted((r["doc_id"] if r["doc_id"] is not None else 10**6, r["text"]) for r in one.collect())
        assert got == brute_suffix(rows, 100)
        assert suffix_dedup.dedup(empty).count() == 0
        assert suffix_dedup.dedup(docs).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)


def test_merge_is_a_sort():
    rng = random.Random(5)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(40)}) for _ in range(9)]
    coded = [suffix_dedup.decode_run([suffix_dedup.encode_run(r, [0] * len(r), [0] * len(r), [*range(len(r))], suffix_dedup.shared_prefixes(r))]) for r in runs]
    out = [*suffix_dedup.merge(coded)]
    assert [x[0] for x in out] == sorted(x for r in runs for x in r)
    for (a, *_), (b, shared, *_) in zip(out, out[1:], strict=False):
        assert shared == len(a) if a == b else b[:shared] == a[:shared] and (shared == len(a) or a[shared] != b[shared])


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 5)]) for i in range(600)]
    v += [(600, v[3][1]), (601, v[3][1]), (602, None), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] * 6), (606, [0.0] * 6), (607, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3)
    q = topk_search.quantise(df, "embedding", "v")
    top = lambda: [tuple(r) for r in topk_search.top_k(q, q.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).orderBy("query_id", "rank").collect()]
    got = top()
    ok = {i: [int(np.floor(1024 * y)) for y in x] for i, x in v if i is not None and x and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for i in sorted(k for k in ok if k % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ok[i], c, strict=True)), j) for j, c in ok.items() if j != i and len(c) == len(ok[i])))[:10]
        want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == want
    monkeypatch.setattr(topk_search, "QUERY_BLOCK_ROWS", 2)
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", 32)
    assert top() == want
    none = q.where("vec_id < 0")
    assert topk_search.top_k(none, none.withColumnRenamed("vec_id", "query_id")).count() == 0
    big = np.array([[2**40, 1]])
    with pytest.raises(OverflowError):
        topk_search._products(big, big * 2**22)


def test_quality_scores_are_sums_over_tables(spark, docs):
    """Each score again by plain loops: the bin of a value is the number of edges that it reaches."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["clear", "words", "here", "###", "BUY", "now!!", "1234"]) for _ in range(rng.randint(1, 200)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x.count("BUY") * 8 < len(x.split()))) for i, x in rows], "doc_id long, quality int")
    model = quality_gam.fit(df, labels)
    assert any(t.any() for t in model.tables) and model.pairs
    place = lambda edges, v: sum(1 for e in edges if e <= v)

    def plain(text):
        x = quality_gam.features((text or "").encode())
        z = float(model.intercept)
        for edges, table, v in zip(model.edges, model.tables, x, strict=True):
            z += float(table[place(edges, v)])
        for i, j, a, b, grid in model.pairs:
            z += float(grid[place(a, x[i])][place(b, x[j])])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    for frame in (df, docs.select("doc_id", "text")):
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], plain(r["text"])) for r in frame.collect())
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in quality_gam.score(frame, model).collect())
        assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_very_long_urls(spark):
    """A rule at the start of a path of a million characters, and hosts of very many labels, by both ways."""
    long = "x/" * 500_000
    urls = [f"https://a.example.org/keep/{long}?q", f"https://a.example.org/{long}", "http://" + "sub." * 300 + "bad.net/" + long, "http://" + "sub." * 300 + "good.net/", "http://" + "h" * 300_000 + "/", None]
    rules = [("block", "example.org/"), ("allow", "example.org/keep/"), ("block", "bad.net/x/x/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["example.org/keep/", "example.org/", "bad.net/x/x/", None, None, None]
    for out in (url_filter.judge(df, rules), url_filter.judge_joined(df, spark.createDataFrame(rules, "verdict string, rule string"))):
        rows = sorted(out.select("page_id", "rule", "verdict").collect())
        assert [r["rule"] for r in rows] == want and [r["verdict"] for r in rows] == ["allow", "block", "block", "allow", "allow", "allow"]


def test_quality(spark, words):
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [make(rng.randint(20, 90)).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in make(rng.randint(20, 60)).split()) for _ in range(40)] + [" | ".join(make(40).split()) for _ in range(40)]
    rows = [*((i, t, 1) for i, t in enumerate(good)), *((1000 + i, t, 0) for i, t in enumerate(bad))]
    df = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(5000, None, 1.0), (5001, "", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    model = quality_gam.fit(df, labels.where("doc_id % 3 <> 1 OR doc_id IS NULL"))
    out = {r["doc_id"]: r["score"] for r in quality_gam.score(df, model).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= s <= 1 for s in out.values()) and out[5000] == out[5001]
    held = [(i, y) for i, _, y in rows if i % 3 == 1]
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    again = quality_gam.fit(df.repartition(5), labels.where("doc_id % 3 <> 1").repartition(2))
    assert np.allclose(again.score(np.ones((3, len(quality_gam.FEATURES)))), model.score(np.ones((3, len(quality_gam.FEATURES)))))
    many = df.where("doc_id < 2000").union(df.where("doc_id = 3")).union(df.where("doc_id = 3"))
    twice = quality_gam.fit(many, labels.where("doc_id % 3 <> 1").union(labels.where("doc_id = 3")))
    assert np.allclose(twice.score(np.ones((3, len(quality_gam.FEATURES)))), model.score(np.ones((3, len(quality_gam.FEATURES)))))
    blank = quality_gam.fit(df, labels.where("false"))
    assert blank.score(np.zeros((1, len(quality_gam.FEATURES))))[0] == 0.5
    assert quality_gam.score(df.where("false"), model).count() == 0


def test_pairs_matter():
    """Two features that tell nothing alone."""
    x = np.random.default_rng(1).uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert np.mean((quality_gam.fit_arrays(x, y).score(x) > 0.5) == (y > 0)) > 0.95


def brute_matches(docs, items):
    """(doc_id, item_id, n_windows) by comparing every window of a document with every window of an item, token by token."""
    canon, out = decontaminate.Canon(), set()
    word, name, size = decontaminate.WORD, decontaminate.NAME, decontaminate.WINDOW

    def read(text):
        words, kinds, opens, common, _ = canon(text.encode())
        return [(w.strip(decontaminate._EDGE) or w).decode().lower() for w in words], kinds.tolist(), opens.tolist(), common.tolist()

    for d, text in docs:
        w, kinds, opens, common = read(text or "")
        readings = [[name if o and not c else k for k, o, c in zip(kinds, opens, common, strict=True)], kinds, [name if o else k for k, o in zip(kinds, opens, strict=True)]]
        for m, item in items:
            v, vk, vo, vc = read(item or "")
            n = min(size, len(v))
            best = 0
            for shift in range(-len(v), len(w)) if n else ():
                for ks in readings:
                    own, other, place = set(), set(), set()
                    for j in range(len(v) - n + 1):
                        i = j + shift
                        if i < 0 or i + n > len(w):
                            continue
                        # The item's reading is that of the text where its word is an opener.
                        as_read = [k if o and k in (word, name) else x for k, x, o in zip(ks[i : i + n], vk[j : j + n], vo[j : j + n], strict=True)]
                        if as_read != ks[i : i + n] or any(k == word and x != y for k, x, y in zip(as_read, w[i : i + n], v[j : j + n], strict=True)):
                            continue
                        plain = as_read.count(word)
                        rare = sum((k == word or n < 4 and k == name) and not c for k, c in zip(as_read, vc[j : j + n], strict=True))
                        if n < 4 and len(w) != n and rare < 2:
                            continue
                        slots = [(k, x, y) for k, x, y in zip(as_read, w[i : i + n], v[j : j + n], strict=True) if k != word]
                        if all(x == y for _, x, y in slots):
                            own.add(i)
                        if n >= 4 and (2 * plain >= n and plain >= 4 or plain >= 3 and rare >= 2):
                            other.add(i)
                            place |= set(slots)
                    torn = len({(k, x) for k, x, _ in place}) < len(place) or len({(k, y) for k, _, y in place}) < len(place)
                    best = max(best, len(own if torn else own | other))
            if best:
                out.add((d, m, best))
    return out


def test_decontamination(spark, words, monkeypatch):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "If Karan has 12 apples and gives 5 kg of them to Velon then how many apples does Karan have left after that day"
    other = item.replace("Karan", "Loranel").replace("12", "31").replace("5 kg", "9 lb").replace("Velon", "Sudor")
    torn = other.replace("does Loranel", "does Temil").replace("5 kg", "7 kg")
    plain = make(30)
    short = "Karan has 12 apples and gives away 5 of them each day"
    items = [(0, item), (1, plain), (2, None), (3, ""), (4, make(9)), (5, plain), (None, make(20)), (6, " ".join(map(str, range(20)))), (7, "How many moons does Mars have"), (8, short), (9, "Lovel")]
    nine = items[4][1]
    rows = [(0, make(20) + " " + item + " " + make(9)), (1, make(40) + ". " + other), (2, torn), (3, make(400)), (4, plain.upper()), (5, None), (6, ""), (7, make(3) + " " + nine + " " + make(3)), (8, " ".join(plain.split()[:13])), (9, " ".join(plain.split()[:12])), (10, " ".join(map(str, range(50, 90)))), (None, item), (0, make(20) + " " + item)]
    rows += [(11, "How many moons does Mars have"), (12, make(9) + "\nso " + short.replace("Karan", "Velon").replace("12", "31").replace("5", "9")), (13, short.replace("Karan", "Velon").replace("12", "31")), (14, "1 2 " + items[7][1] + " 3"), (15, "lovel"), (16, "a lovel"), (17, make(9000) + " " + item + " " + make(9000))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(0, 0), (1, 0), (4, 1), (4, 5), (7, 4), (8, 1), (8, 5), (11, 7), (12, 8), (13, 8), (14, 6), (15, 9), (17, 0)}
    kept = decontaminate.clean(df, bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, (2, 3, 5, 6, 9, 10, 16, None))) and {(r["h"], r["id"]) for r in kept} == {(1, 2)}
    assert decontaminate.matches(df.where("false"), bench).count() == decontaminate.matches(df, bench.where("false")).count() == 0
    monkeypatch.setattr(decontaminate, "MAX_FILTER", 0)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 12)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()} == got


def test_decontamination_of_short_and_slot_heavy_items(spark, words):
    rng = random.Random(31)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(0, "Anna sold 14 pens to Boris"), (1, "Compute 12 + 35 * 41 - 17 / 5"), (2, "Name three colours"), (3, "What is it"), (4, "Anna met Boris and Anna paid 3 and 4")]
    docs = [
        make(9) + " Maria sold 99 pens to Felix " + make(9), make(9) + " Maria sold 99 pens for Felix " + make(9), make(5) + ". Compute 8 + 3 * 77 - 20 / 9 " + make(5), make(5) + ". Compute 8 - 3 * 77 - 20 / 9 " + make(5),
        make(4) + " compute 8 3 77 20 9 " + make(4), make(9) + " Name three colours " + make(9), make(9) + " what is it " + make(9), "What is it?", make(3) + " Maria met Felix and Maria paid 5 and 6 " + make(3), make(3) + " Maria met Felix and Felix paid 5 and 6 " + make(3),
        "1 - 2 * 3 / 4 + 5 " * 50, "+ - * /", "- 5 + " + make(3),
    ]
    docs = list(enumerate(docs))
    got = {(r["doc_id"], r["item_id"], r["n_windows"]) for r in decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x[:2] for x in got} == {(0, 0), (2, 1), (5, 2), (7, 3), (8, 4)} and got == brute_matches(docs, items)


def test_decontamination_by_brute_force(spark, words):
    """Random templates whose slots are filled anew, rightly or not, in texts that open sentences with names, common words and others."""
    rng = random.Random(23)
    names = [w.capitalize() for w in words[:12]]

    def sentence():
        out = [rng.choice(["How", "If", "Then", rng.choice(names), rng.choice(words).capitalize()])]
        for _ in range(rng.randint(3, 9)):
            out.append(rng.choice([rng.choice(words[:30]), rng.choice(words[:30]), rng.choice(names), str(rng.randint(1, 9)), "5 kg"]))
        return " ".join(out) + rng.choice([".", "?", ","])

    items = [(i, " ".join(sentence() for _ in range(rng.randint(1, 4)))) for i in range(25)]
    docs = []
    for d in range(120):
        text = rng.choice(items)[1]
        change = {n: rng.choice(names) for n in names} if d % 3 else dict(zip(names, rng.sample(names, len(names)), strict=True))
        body = " ".join(change.get(w.strip(".?,"), w.strip(".?,")) + w[len(w.rstrip(".?,")) :] for w in text.split())
        if d % 4 == 0:
            body = rng.choice(["so ", "So ", "thus. "]) + body[0].lower() * (d % 8 == 0) + body[d % 8 == 0 :]
        docs.append((d, rng.choice(["", sentence() + " "]) + body + rng.choice(["", " " + sentence()])))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, m) for d, m, _ in brute_matches(docs, items)} and len(got) > 40


def test_licences(spark, monkeypatch):
    t = license_scan.default_templates(spark)
    mit = dict(license_scan.FULL_TEXTS[::-1])["MIT"]
    rows = [
        (0, "words\nReleased under the MIT License.\nmore words here"), (1, "licensed UNDER the apache license version 2.0"), (2, None), (3, ""), (4, "MIT"), (5, "This is not a licence at all, just a long line of text that says nothing"),
        (6, "Some words come first.\nThis work is licensed under\nthe GNU General Public License, version 3.\nAnd more words"), (7, "x " * 9000), (0, "words\nReleased under the MIT License.\nmore words here"),
        (8, "Long line before it. Released under the MIT License. And after it."), (9, "a b c\n" + mit.replace(", ", ",\n") + "\nd e f"), (10, "This work is distributed under the GNU General Public License, version 2."),
        (11, "Released under the License."), (None, "Licensed under CC BY 4.0.\n" * 3), (0, "Released under the BSD 2-Clause License."), (12, "Released under the MIT License. " * 400),
    ]
    df = spark.createDataFrame([(i, x, "l") for i, x in rows], "doc_id long, text string, license string")
    got = sorted((tuple(r) for r in license_scan.scan(df, t).collect()), key=str)
    many = [x for x in got if x[0] == 12]
    assert len(many) == 400 and {x[1] for x in many} == {"MIT"}
    got = [x for x in got if x[0] != 12]
    lines = len(mit.replace(", ", ",\n").split("\n"))
    want = [(0, "BSD-2-Clause", 0, 0), (0, "MIT", 1, 1), (1, "Apache-2.0", 0, 0), (6, "GPL-3.0", 1, 2), (8, "MIT", 0, 0), (9, "MIT", 1, lines), (10, "GPL-2.0", 0, 0), *((None, "CC-BY-4.0", i, i) for i in range(3))]
    assert [x[:4] for x in got] == sorted(want, key=str)
    assert {x[0]: x[5] for x in got} == {i: 1.0 for i in (0, 1, 6, 8, 9, None)} | {10: 18 / 22}
    tied = spark.createDataFrame([("b", "one two three four five"), ("a", "one two three four six"), ("c", "one two three four five"), (None, "one two"), ("d", None), ("e", "word")], "license string, text string")
    four = spark.createDataFrame([(1, "one two three four"), (2, "one two three"), (3, "one one two three four five five")], "doc_id long, text string")
    assert sorted(tuple(r)[:2] for r in license_scan.scan(four, tied).collect()) == [(1, "a"), (3, "b")]
    assert license_scan.scan(df.where("false"), t).count() == license_scan.scan(df, t.where("false")).count() == 0
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 2)
    assert sorted((tuple(r) for r in license_scan.scan(df.where("doc_id < 12 OR doc_id IS NULL"), t).collect()), key=str) == got


def test_urls(spark):
    rows = [
        "https://www.Example.NET/en/1?x#y", "http://example.net/english", "http://net/", "http://a.net", "http://notexample.net/en/", "ftp://x.example.com/de/", "http://example.com/de", "http://ORG/fr/", "nothing", None, "", "://", "http:///p",
        "http://a.b?c://d/e", "x\n://deep.example.com/de/\n", "http://example.net./en/",
    ]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(rows)] + [(0, rows[0], "r"), (None, "http://q.net/", "r")], "page_id long, url string, rule string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect()}

    def want(i, url):
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return i, host, path, rule, verdict

    assert got == {want(r["page_id"], r["url"]) for r in df.collect()}
    assert df.count() == len(url_filter.judge(df, url_filter.RULES).collect())
    joined = url_filter.judge_joined(df, spark.createDataFrame(url_filter.RULES, "verdict string, rule string"))
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in joined.collect()} == got
    assert url_filter.judge(df.where("false"), url_filter.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    url_filter.write_digest_array([("block", "a.com/"), ("allow", "b.com/")], str(tmp_path / "x"))
    assert url_filter.DigestArray(str(tmp_path / "x")).probe([b"b.com/", b"c.com/", b"a.com/"]) == [b"ab.com/", None, b"ba.com/"]


@pytest.fixture(scope="module")
def library():
    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, empty, library):
    vocabulary = byte_bpe.default_vocabulary()
    extra = docs.sparkSession.createDataFrame([(900, "a   b \n \n  c'll don't 12345 <|endoftext|> \t x"), (901, "   lead"), (902, "trail   "), (903, "\u3000a \u2028 b\x1c c"), (904, "lalala" * 4000), (905, "Aa" + "\n" * 50 + " z")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    out = byte_bpe.decode(byte_bpe.encode(df, *vocabulary), *vocabulary).collect()
    assert len(out) == df.count()
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or ""), r["doc_id"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.digests(empty, *vocabulary).count() == 0
    coder = byte_bpe.RankQueueBpe(byte_bpe.load_ranks(vocabulary[0]), vocabulary[1], cache=10)
    assert [coder.encode(t) for t in ("one two three", "two three one") * 20]
    with pytest.raises(ValueError):
        coder.decode(np.array([10**6], "<u4").tobytes())


def test_bpe_of_any_code_points(library):
    """Letters that the newest versions of Unicode added are what the library takes them for."""
    vocabulary = byte_bpe.default_vocabulary()
    coder, rng = byte_bpe.RankQueueBpe(byte_bpe.load_ranks(vocabulary[0]), vocabulary[1]), random.Random(8)
    odd = sorted(byte_bpe.stand_ins(vocabulary[1]))
    any_one = lambda: chr(rng.choice((rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(128), rng.randrange(0x3000), 32, *rng.choices(odd, k=2))))
    assert odd
    for _ in range(30_000):
        text = "".join(any_one() for _ in range(rng.randint(1, 25)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text), [hex(ord(c)) for c in text]


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = token_shards.permute(np.arange(n), n, 3)
        assert sorted(p.tolist()) == list(range(n))
    assert (token_shards.permute(np.arange(1000), 1000, 3) != token_shards.permute(np.arange(1000), 1000, 4)).any()


def test_shards(docs, empty, library, tmp_path):
    vocabulary = byte_bpe.default_vocabulary()
    out = f"file://{tmp_path}/s"
    places = token_shards.materialise(docs, out, *vocabulary, key=9, sequence=64, shard_rows=16).toPandas()
    seqs = dict(token_shards.read_slots(out))
    assert sorted(seqs) == list(range(int(places["slot"].max()) + 1)) and all(len(x) == 64 for x in seqs.values())
    wanted = sorted([*library.encode_ordinary(r["text"] or ""), 50256] for r in docs.collect())
    stream = np.concatenate([seqs[s] for s in places.drop_duplicates("sequence").sort_values("sequence")["slot"]])[: int(places["n_tokens"].sum())]
    parts = np.split(stream, np.flatnonzero(stream == 50256) + 1)
    assert len(parts.pop()) == 0 and sorted(p.tolist() for p in parts) == wanted
    assert [s for s, _ in token_shards.read_slots(out, 30, 5)] == [30, 31, 32, 33, 34]
    assert token_shards.materialise(empty, f"file://{tmp_path}/e", *vocabulary).count() == 0
    assert [*token_shards.read_slots(f"file://{tmp_path}/e")] == []


def brute_classes(fps, radius):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("most", [1024, 4])
def test_simhash_classes(spark, monkeypatch, most):
    """Also with blocks so small that they are split again and again."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", most)
    monkeypatch.setattr(simhash.blocks, "__defaults__", (most,))
    rng = random.Random(11)
    fps = {}
    for c in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps[len(fps)] = x
    fps[len(fps)] = fps[0]
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in fps.items()] + [(None, simhash._signed(fps[1])), (9999, None)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df).collect()}
    want = brute_classes(fps, 2)
    assert got == want | {None: want[1], 9999: None}


def test_fingerprints(docs, empty):
    got = simhash.with_fingerprint(docs.select("doc_id", "text"))
    for r in got.join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).collect():
        w = (r["text"] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r["fp"] & (1 << 64) - 1 == want
    assert simhash.classes(simhash.with_fingerprint(empty.select("doc_id", "text"))).count() == 0


def test_near_groups(docs, empty, spark, words):
    rng = random.Random(8)
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(25):
        x = list(base)
        for k in rng.sample(range(200), i % 6):
            x[k] = f"new{i}"
        rows.append((100 + i, " ".join(x)))
    df = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).union(spark.createDataFrame(rows, "doc_id long, text string"))
    shingles = {r["doc_id"]: set(simhash.shingle_hashes((r["text"] or "").encode(), 5).tolist()) for r in df.collect() if r["doc_id"] is not None}
    ids = sorted(shingles)
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = shingles[i], shingles[j]
            if not a and not b or len(a & b) >= 0.8 * len(a | b) > 0:
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(df).collect()}
    assert {i: g for i, g in got.items() if i is not None} == {i: top(i) for i in ids}
    assert simhash.near_groups(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.near_distinct(df.union(df.where("doc_id = 3"))).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({top(i) for i in ids}) and kept.count(None) == 1


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    assert got == {x: top(x) for x in list(parent) if top(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_digests_of_queries(docs):
    """The contract's digests are those of the operators' outputs."""
    out = rlz_dedup.dedup(docs.select("doc_id", "text")).withColumn("d", F.sha2("kept", 256)).toPandas()
    assert (out["d"] == [hashlib.sha256(k.encode()).hexdigest() for k in out["kept"]]).all()
    assert isinstance(out, pd.DataFrame)


def changed(rng, text, places, word):
    """``text`` with new words at this many places that share no shingle."""
    out = list(text)
    for k in rng.sample(range(5, len(text) - 5, 10), places):
        out[k] = f"{word}x{k}"
    return out


def near_misses(spark, words, most):
    """Rows that are not joined to their family: each has 25 texts at 0.9 to its base, below 0.82 to each other, and 8 at 0.82 to the base alone."""
    rng = random.Random(12)
    texts = {}
    for f in range(12):
        base = [rng.choice(words) for _ in range(500)]
        family = [base, *(changed(rng, base, 5, f"v{f}y{i}") for i in range(25)), *(changed(rng, base, 10, f"w{f}y{i}") for i in range(8))]
        texts |= {100 * f + i: " ".join(x) for i, x in enumerate(family)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "BLOCK_ROWS", most)
        got = simhash.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    return sum(r["group_id"] != r["doc_id"] // 100 * 100 for r in got)


def test_near_groups_of_large_blocks(spark, words):
    """Blocks that are too large lose no link that smaller ones would keep."""
    assert near_misses(spark, words, 6) <= near_misses(spark, words, 1024)


def test_near_groups_verify_all_in_doubt(spark, words):
    """A pair in doubt that fails its check does not stand for one that holds: of 396 rows few are lost to chance."""
    assert near_misses(spark, words, 1024) <= 4


def test_near_groups_of_far_fingerprints(spark, words):
    """Pairs at 0.8 whose fingerprints are 1.5 to 3 deviations farther than expected are found, and the stated loss counts all causes."""
    share = simhash.expected_distance(0.8)
    beyond = lambda x: simhash.WIDE * share + x * np.sqrt(simhash.WIDE * share * (1 - share))
    rng = random.Random(14)
    rows, n = [], 0
    while n < 15:
        x = [rng.choice(words) for _ in range(94)]
        y = [*x[10:], *(f"{w}z" for w in rng.sample(words, 10))]
        a, b = (simhash.shingle_hashes(" ".join(t).encode(), 5) for t in (x, y))
        assert len(set(a.tolist()) & set(b.tolist())) == 80 and len(set(a.tolist()) | set(b.tolist())) == 100
        if beyond(1.5) < np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum() <= beyond(3):
            rows += [(10 * n, " ".join(x)), (10 * n + 1, " ".join(y))]
            n += 1
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["group_id"] != r["doc_id"] // 10 * 10 for r in got) <= 3
    assert simhash.chance_of_loss(share, int(beyond(1.5)), 15, 45) > 0.09 and simhash.chance_of_loss(share, int(beyond(3)), 15, 62) <= simhash.MISS


@pytest.mark.parametrize("most", [1024, 64])
def test_near_groups_within_boilerplate(spark, words, monkeypatch, most):
    """Texts that share boilerplate (similarity 0.71) hide no pair at 0.84, and are not joined themselves."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", most)
    rng = random.Random(5)
    make = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    boilerplate = make(330)
    rows = {i: boilerplate + make(66) for i in range(250)}
    for k in range(60):
        x = boilerplate + make(66)
        y = list(x)
        for p in range(340, 375, 5):
            y[p] = rng.choice(words) + "zz"
        rows |= {5000 + 2 * k: x, 5001 + 2 * k: y}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(df).collect()}
    assert sum(got[5000 + 2 * k] == got[5001 + 2 * k] for k in range(60)) >= 57
    assert all(got[i] == i for i in range(250))


def test_near_duplicates_keep_clashing_columns(docs):
    names = ("id", "tag", "_tag", "_id", "none", "node", "node_fp", "row", "key", "of", "a.b")
    df = docs.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for out in (simhash.near_groups(df), simhash.near_distinct(df), simhash.classes(simhash.with_fingerprint(df.drop("a.b"), out="fp2"), fp="fp2")):
        assert {tuple(r[c] for c in names if c in out.columns) for r in out.collect()} == {tuple(k for k, c in enumerate(names) if c in out.columns)}
