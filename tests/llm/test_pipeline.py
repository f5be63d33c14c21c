"""The pipeline's stages on a small corpus with planted cases."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from hyperweave.llm import quality_gam, simhash
from tests.llm.test_operators import brute_later

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    rng = random.Random(21)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [make(rng.randint(60, 120)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in make(50).split()) for _ in range(30)]
    passage, item = make(60), make(40)
    near = clean[0].split()
    near[30] = "other"
    docs = dict(enumerate(clean))
    docs |= {100 + i: t for i, t in enumerate(junk)}
    docs |= {200: clean[0], 201: " ".join(near), 202: clean[1], 300: make(50) + " " + passage + " " + make(50), 301: make(40) + " " + passage + " " + make(70), 400: make(50) + " " + item + " " + make(40)}
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in docs if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages(spark, corpus):
    path, docs = corpus
    frames = {}
    df = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = f"{path}/{stage.__name__}"
        stage(spark, df, path).write.parquet(out)
        df = spark.read.parquet(out)
        frames[stage.__name__] = df
        assert df.columns == COLUMNS or name == pipeline.STAGES[-1][0]
    ids = lambda n: {r["doc_id"] for r in frames[n].select("doc_id").collect()}
    text = lambda n: {r["doc_id"]: r["text"] for r in frames[n].collect()}

    assert ids("quality") == {i for i in docs if not 100 <= i < 200}
    assert ids("near_dedup") == ids("quality") - {200, 201, 202}
    before = text("near_dedup")
    want = {i: kept if kept != " ".join(before[i].split()) else before[i] for i, kept in brute_later(sorted(before.items()))}
    assert text("substring_dedup") == {i: t for i, t in want.items() if t}
    assert len(want[300].split()) == 160 and len(want[301].split()) == 110
    assert {r["doc_id"]: r["n_chars"] for r in frames["substring_dedup"].collect()} == {i: len(t) for i, t in text("substring_dedup").items()}
    assert ids("decontamination") == ids("substring_dedup") - {400}
    assert {r["doc_id"]: r["decoded"] for r in frames["encode"].collect()} == text("decontamination")
    assert sorted(r["doc_id"] for r in pipeline.run(spark, path).collect()) == sorted(ids("encode"))


def test_stages_of_empty_input(spark, corpus):
    path, _ = corpus
    none = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_wide_fingerprints_tell_similarity():
    """Distances are near the expected ones, on which the number of tables rests."""
    rng = np.random.default_rng(4)
    for similarity in (0.8, 0.9):
        far = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            y = x.copy()
            y[: int(1000 * (1 - similarity) / (1 + similarity))] = rng.integers(0, 1 << 63, int(1000 * (1 - similarity) / (1 + similarity))).astype(np.uint64)
            far.append(int(np.bitwise_count(simhash.wide_fingerprint(x) ^ simhash.wide_fingerprint(y)).sum()))
        assert abs(np.mean(far) / simhash.WIDE - simhash.expected_distance(similarity)) < 0.02


def test_features_are_whole():
    assert len(quality_gam.features(b"")) == len(quality_gam.FEATURES)
    assert quality_gam.features(b"a " * 10**5 + b"!") != quality_gam.features(b"a " * 10**5)
