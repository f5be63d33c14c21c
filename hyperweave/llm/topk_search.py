"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets of bounded size. The bucket of the longest vectors gives each query a first
threshold, the k-th best score there. For every other bucket this turns into a local cosine threshold: threshold over
(length of the query times greatest length in the bucket). Above one, the bucket is skipped. If it is high, coordinate
pruning keeps the vectors whose value in the query's strongest coordinates lies where such a cosine is possible; if it
is low, length pruning keeps the vectors that are long enough. What remains is verified by its exact product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stored

BUCKET_ROWS = 4096
QUERY_BLOCK_ROWS = 1024
#: Into so many bands of the length that they ask of a candidate queries are sorted, at the most, before they are dealt into blocks.
BANDS = 64
#: From this local cosine threshold on, coordinate pruning takes the place of length pruning.
COORDINATE_FROM = 0.35
FOCUS = 4
SLACK = 1e-9
EXACT = float(1 << 53)


def quantise(df: DataFrame, vector: str, out: str, scale: int = 1024) -> DataFrame:
    """``df`` with ``out`` = floor(scale * x) for each component x; rows whose vector is null or holds a null or non-finite component go."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(x.isNotNull() & whole).withColumn(out, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), dim) if len(column) else np.empty((0, dim), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where every sum is below 2^53, else in Python's integers (and outside a long: an error)."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < EXACT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=1))


def _survivors(q: np.ndarray, q_len: float, m: np.ndarray, lens: np.ndarray, unit: np.ndarray, least: float) -> np.ndarray | slice:
    """Rows of a bucket (longest first) that may reach the score ``least`` with q; a slice where they are the longest ones."""
    if not len(m) or least <= 0 or q_len == 0:
        return slice(len(m))
    local = least / (q_len * lens[0]) if lens[0] else np.inf
    if local > 1 + SLACK:
        return slice(0)
    if local < COORDINATE_FROM:
        return slice(int(np.searchsorted(-lens, -(least / q_len) * (1 - SLACK), side="right")))
    q_unit = q / q_len
    t = min(local, 1.0)
    keep = np.ones(len(m), bool)
    for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
        spread = np.sqrt((1 - t * t) * max(0.0, 1 - q_unit[f] ** 2))
        low = -1.0 if q_unit[f] <= -t else q_unit[f] * t - spread
        high = 1.0 if q_unit[f] >= t else q_unit[f] * t + spread
        keep &= (unit[:, f] >= low - 1e-7) & (unit[:, f] <= high + 1e-7)
    return np.flatnonzero(keep)


def _search(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one bucket for each query of one block. queries: query_id, q, least (null: no threshold yet)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(bucket):
        dim = len(bucket["c"].iloc[0])
        m, qs = _matrix(bucket["c"], dim), _matrix(queries["q"], dim)
        ids = bucket["vec_id"].to_numpy(np.int64)
        lens = _lengths(m)
        order = np.lexsort((ids, -lens))
        m, ids, lens = m[order], ids[order], lens[order]
        unit = m / np.where(lens > 0, lens, 1)[:, None]
        as_float, most = m.astype(float), float(np.abs(m.astype(float)).max()) * dim
        for i, (qid, least) in enumerate(zip(queries["query_id"].to_numpy(np.int64), queries["least"].to_numpy(float), strict=True)):
            q = qs[i].astype(float)
            rows = _survivors(q, float(_lengths(q[None])[0]), m, lens, unit, -np.inf if np.isnan(least) else least)
            if most * float(np.abs(q).max()) < EXACT:
                score = np.rint(as_float[rows] @ q).astype(np.int64)
            else:
                score = _products(qs[i : i + 1], m[rows])[0]
            other = ids[rows] != qid
            near, score = ids[rows][other], score[other]
            if len(score) > k:  # ties with the k-th best stay
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                near, score = near[high], score[high]
            best = np.lexsort((near, -score))[:k]
            out.append((np.full(len(best), qid), near[best], score[best]))
    cat = lambda j: np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64)
    return pd.DataFrame({"query_id": cat(0), "vec_id": cat(1), "score": cat(2)})


def _blocked(qs: DataFrame, bands: int) -> DataFrame:
    """``qs`` (dim, least, q_norm) with ``reach``, the length below which no candidate can reach the threshold, and ``block``:
    queries of like reach together, in blocks of about QUERY_BLOCK_ROWS."""
    qs = qs.withColumn("reach", F.when(F.col("least") > 0, F.col("least") / F.col("q_norm")).otherwise(0.0))
    if bands > 1:
        cuts = qs.groupBy("dim").agg(F.percentile_approx("reach", [i / bands for i in range(1, bands)]).alias("cuts"))
        above = F.aggregate("cuts", F.lit(0), lambda n, cut: n + (cut <= F.col("reach")).cast("int"))
        qs = qs.join(F.broadcast(cuts), "dim").withColumn("band", above).drop("cuts")
    else:
        qs = qs.withColumn("band", F.lit(0))
    parts = qs.groupBy("dim", "band").agg(F.ceil(F.count("*") / QUERY_BLOCK_ROWS).alias("q_parts"))  # BANDS rows for each dimension
    deal = F.pmod(F.xxhash64("query_id"), F.col("q_parts"))
    return qs.join(F.broadcast(parts), ["dim", "band"]).withColumn("block", F.col("band").cast("long") * (1 << 40) + deal).drop("band", "q_parts")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "v") -> DataFrame:
    """The k vectors of greatest inner product for each query, as query_id, rank, vec_id, score.

    vectors: (vec_id, ``vector``: array of long); queries: (query_id, ``vector``). A vector with the query's own id is no
    candidate; ties go to the smaller vec_id. Vectors of another dimension than the query's are not compared with it.
    Repeated rows of vectors each count; of a repeated query_id the least vector is searched. Rows with a null id or
    vector take no part. No bound on either table: buckets hold about BUCKET_ROWS vectors, and are dealt by hash
    within a length class, so that many vectors of one length spread; queries come in blocks of QUERY_BLOCK_ROWS, and a
    vector goes to those blocks alone that hold a query for which it is long enough.
    """
    c = vectors.select("vec_id", F.col(vector).alias("c")).where("vec_id IS NOT NULL AND c IS NOT NULL AND size(c) > 0")
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    c = stored(c.withColumns({"dim": F.size("c"), "norm": norm}), "topk-vectors")
    q = queries.where(F.col("query_id").isNotNull() & F.col(vector).isNotNull()).groupBy("query_id").agg(F.min(vector).alias("q"))
    q = q.where("size(q) > 0").withColumn("dim", F.size("q"))

    # Length classes: by powers of 2^(1/4), whose number does not depend on the rows; each is dealt into buckets by hash.
    c = c.withColumn("class", F.when(F.col("norm") > 0, F.floor(4 * F.log2("norm"))).otherwise(F.lit(-10_000)).cast("long"))
    sizes = c.groupBy("dim", "class").agg(F.count("*").alias("rows"), F.max("norm").alias("longest"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("rows") / BUCKET_ROWS))
    c = c.join(F.broadcast(sizes.drop("rows")), ["dim", "class"])  # bounded: a few hundred length classes for each dimension
    c = c.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    n_q = q.count()
    bands = max(1, min(BANDS, n_q // QUERY_BLOCK_ROWS))
    q = q.withColumn("q_norm", F.sqrt(F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))))

    keys = ["dim", "class", "part", "block"]
    schema = "query_id long, vec_id long, score long"

    def searched(cands: DataFrame, qs: DataFrame, classes: DataFrame) -> DataFrame:
        """Queries meet the buckets of these classes (dim, class, longest, parts), but for those whose longest vector is too short for them."""
        met = qs.join(F.broadcast(classes), "dim")
        met = met.where(F.col("least").isNull() | (F.col("least") <= 0) | (F.col("least") <= F.col("q_norm") * F.col("longest") * (1 + SLACK)))
        met = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        left = met.select(*(F.col(x).alias(f"q_{x}") for x in keys), "query_id", "q", "least")
        blocks = qs.groupBy("dim", "block").agg(F.min("reach").alias("reach"))  # a row for each block of queries
        right = cands.join(F.broadcast(blocks), "dim").where(F.col("norm") >= F.col("reach") * (1 - SLACK)).select(*keys, "vec_id", "c")
        pairs = left.groupBy(*(f"q_{x}" for x in keys)).cogroup(right.groupBy(*keys))
        return pairs.applyInPandas(lambda a, b: _search(a, b, k), schema)

    # First one bucket of the longest class that fills one gives thresholds.
    top = W.partitionBy("dim").orderBy(F.desc(F.least("rows", F.lit(BUCKET_ROWS))), F.desc("class"))
    first = sizes.withColumn("place", F.row_number().over(top)).where("place = 1").select("dim", "class", "longest", F.lit(1).cast("long").alias("parts"))
    none = F.lit(None).cast("double").alias("least")
    of_first = c.join(F.broadcast(first.select("dim", "class", F.lit(0).cast("long").alias("part"))), ["dim", "class", "part"], "left_semi")
    start = searched(of_first, _blocked(q.select("*", none), 1), first)
    least = start.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    least = least.select("query_id", F.when(F.size("s") >= k, F.element_at("s", F.least(F.size("s"), F.lit(k)))).cast("double").alias("least"))
    told = stored(q.join(least, "query_id", "left"), "topk-queries")
    found = searched(c, _blocked(told, bands), sizes.drop("rows"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantise(read(spark, sf_dir, "embeddings"), "embedding", "v").select("vec_id", "v")
    return top_k(v, v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


QUERIES = {"op2_topk_search": op2_topk_search}
ORACLE_SQL = {
    "op2_topk_search": """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
