"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, each on what the others leave over; they add up to one
lookup table for each feature. The pairs of features that explain most of what is left then get tables of two
dimensions in the same way. A score is an intercept plus one table entry for each feature and pair, looked up by the
vectorised bin numbers of a batch of documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, read, texts

#: Most labelled rows that the fit gathers (a stated bound of the fit, not of the scoring).
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.1, 3

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "spaces", "breaks", "stops", "bangs", "bars", "symbols", "beyond_ascii",
    "word_bytes", "longest_word", "distinct_words", "top_word", "repeated_lines", "line_words", "shouted", "marked",
)
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?", b"!", b"|", b"#$%&*@^~=+<>\\/_[]{}()\"`'-"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 10


def features(text: bytes) -> list[float]:
    """The features of one whole text; an empty one has defined values, too."""
    n = max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=11) / n
    words = text.split()
    w = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = [*map(len, words)] or [0]
    return [
        float(np.log1p(len(text))), kinds[1] + kinds[2] + kinds[10], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], kinds[10],
        sum(sizes) / w, float(max(sizes)), len(count) / w, max(count.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)),
        sum(c for x, c in count.items() if len(x) > 1 and x.isupper()) / w, sum(c for x, c in count.items() if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:") / w,
    ]


@dataclass
class Gam:
    """edges: bin edges of each feature; tables: log-odds of each bin; pairs: (i, j, coarse edges of i, of j, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, a, b, t in self.pairs:
            z += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: the step of each bin. g, h: sums of gradient and curvature by bin."""
    gain = lambda a, b: a * a / (b + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            left, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = gain(left, left_h) + gain(all_g - left, all_h - left_h) - gain(all_g, all_h)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (gains[k], p, a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts both features once: its gain and its steps."""
    gc, hc = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)
    gain = lambda a, b: a * a / (b + 1.0)
    cut_g, cut_h = gc[1:n, 1:m], hc[1:n, 1:m]
    row_g, row_h, col_g, col_h = gc[1:n, m:], hc[1:n, m:], gc[n:, 1:m], hc[n:, 1:m]
    quarters = [(cut_g, cut_h), (row_g - cut_g, row_h - cut_h), (col_g - cut_g, col_h - cut_h), (gc[n, m] - row_g - col_g + cut_g, hc[n, m] - row_h - col_h + cut_h)]
    gains = sum(gain(a, b) for a, b in quarters) - gain(gc[n, m], hc[n, m])
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = np.empty_like(g)
    values = [a[i, j] / (b[i, j] + 1.0) for a, b in quarters]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), step


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting on the rows given. Without both classes the model is the smoothed share of ones."""
    ones = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(ones / (1 - ones)))
    n_features = x.shape[1]
    if len(set(y.tolist())) < 2:
        return Gam(start, [np.empty(0)] * n_features, [np.zeros(1)] * n_features, [])
    edges = [_edges(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])), LEAVES)
            tables[f] += step
            z += step[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(n_features)]
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(low[i] * shape(i, j)[1] + low[j], v, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))

    g, h = slopes()
    ranked = sorted(((-_pair_tree(sums(i, j, g), sums(i, j, h))[0], i, j) for i in range(n_features) for j in range(i)))[:PAIRS]
    grids = {(i, j): np.zeros(shape(i, j)) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), grid in grids.items():
            g, h = slopes()
            step = RATE * _pair_tree(sums(i, j, g), sums(i, j, h))[1]
            grid += step
            z += step[low[i], low[j]]
    return Gam(start, edges, tables, [(i, j, coarse[i], coarse[j], t) for (i, j), t in grids.items()])


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``features`` (array of double). Null texts count as empty."""
    kept = [f for f in df.schema.fields if f.name not in (text, "features")]

    def body(batches):
        for batch in batches:
            rows = [features(t) for t in texts(batch.column(text))]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], names=[*(f.name for f in kept), "features"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "features array<double>"
    return by_batch(df, schema, body)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Gam:
    """The model for (doc_id, text) and (doc_id, ``label`` 0 or 1), from about ``most`` labelled rows at the most.

    The sample is by hash of doc_id, so it does not depend on how rows are dealt. Null ids and labels other than 0 and
    1 are left out; a document labelled both ways counts once for each. Of rows that repeat an id the least text counts, so
    that no id brings more than two rows. No labels at all give a model that scores 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("label_value")).distinct()
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label_value").agg(F.min("text").alias("text"))
    rows = with_features(found).select("features", "label_value").toPandas()
    rows = rows.assign(key=rows["features"].map(tuple)).sort_values(["key", "label_value"])  # the order of arrival doesn't matter
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_arrays(x, rows["label_value"].to_numpy(float))


def score(df: DataFrame, model: Gam, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``score`` in 0 to 1, from the whole text alone; a column of that name is replaced.

    The text column is dropped unless keep_text. Null and empty texts get the score of an empty text.
    """
    kept = [f for f in df.schema.fields if f.name != "score" and (keep_text or f.name != text)]

    def body(batches):
        for batch in batches:
            x = np.array([features(t) for t in texts(batch.column(text))], float).reshape(batch.num_rows, len(FEATURES))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], names=[*(f.name for f in kept), "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "score double"
    return by_batch(df, schema, body)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs.withColumn("held_out", held_out()), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_quality_gam": op3_quality_gam}
ORACLE_SQL: dict[str, str] = {}
