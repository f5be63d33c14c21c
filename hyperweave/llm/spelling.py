"""Groups of spelling variants, by k-d trees over letter counts.

A word becomes a vector of how often it has each letter. One replaced letter takes one from a coordinate and adds one to
another, one inserted letter adds one to a coordinate: an edit moves the vector by an L1 distance of two at most. For each
pair of lengths that an edit can join, range searches in k-d trees prune the boxes that lie farther away; what is left has
its letters compared in order.

The trees have two levels. An upper tree for each length, made from a bounded sample of the words, deals them into cells;
it goes to every task. A word is sent to the cells whose boxes it can reach, and each cell is searched with a tree of its
own. The sample affects balance alone: upper boxes cover all vectors, and a cell takes whatever falls into it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, read, stored

#: Letters are folded into so many classes by their code points, which can only make vectors nearer.
CLASSES = 32
#: Words that a cell is meant to hold, points of a leaf of its tree, most words in the sample, and the least sampled words of a cell.
CELL_WORDS, LEAF_POINTS, SAMPLE_WORDS, CELL_SAMPLE = 1024, 32, 200_000, 16
#: Most elements of one block of comparisons.
BLOCK = 4_000_000
#: A form stands for a word if it occurs so many times as often.
TIMES = 5

MEMBER, AT_HOME, AWAY, SHORTER = range(4)


def codes(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Rows of CLASSES counts."""
    n = len(letters)
    places = (np.arange(n)[:, None] * CLASSES + letters % CLASSES).ravel()
    return np.minimum(np.bincount(places.astype(np.int64), minlength=n * CLASSES), 32_000).reshape(n, CLASSES).astype(np.int16)


class KdTree:
    """A k-d tree over count vectors. tight: boxes are those of the points; else they divide all space."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.axis, self.kids, self.lo, self.hi, self.own = [], [], [], [], []
        todo = [(np.arange(len(points)), np.full(CLASSES, -1, np.int16), np.full(CLASSES, 32_001, np.int16), None)]
        while todo:
            at, lo, hi, link = todo.pop()
            k, here = len(self.axis), points[at]
            if link is not None:
                self.kids[link[0]][link[1]] = k
            if tight and len(at):
                lo, hi = here.min(0), here.max(0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([0, 0])
            axis, cut = self._cut(here) if len(at) > leaf else (-1, 0)
            self.axis.append(axis)
            self.own.append(at if axis < 0 else None)
            if axis >= 0:
                low = here[:, axis] <= cut
                low_hi, high_lo = hi.copy(), lo.copy()
                low_hi[axis], high_lo[axis] = cut, cut + 1
                todo += [(at[low], lo, low_hi, (k, 0)), (at[~low], high_lo, hi, (k, 1))]

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int]:
        """The most even cut (axis, greatest count below it); axis -1 if all points are alike."""
        middle, best = np.floor(np.median(points, axis=0)), (0, -1, 0)
        for cut in (middle, middle - 1):
            low = (points <= cut).sum(0)
            even = np.minimum(low, len(points) - low)
            axis = int(even.argmax())
            if even[axis] > best[0]:
                best = (int(even[axis]), axis, int(cut[axis]))
        return best[1], best[2]

    def within(self, x: np.ndarray, more: int, less: int):
        """(leaf, rows of x) for the leaves whose box a row reaches by adding ``less`` letters and taking ``more`` away."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, at = todo.pop()
            here = x[at]
            fits = (np.maximum(here - self.hi[k], 0).sum(1) <= more) & (np.maximum(self.lo[k] - here, 0).sum(1) <= less)
            at = at[fits]
            if not len(at):
                continue
            if self.axis[k] < 0:
                yield k, at
            else:
                todo += [(self.kids[k][0], at), (self.kids[k][1], at)]


def one_replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and of y differ in exactly one letter: (len(x), len(y))."""
    return (x[:, None, :] != y[None, :, :]).sum(2) == 1


def one_inserted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of y are a row of x with one more letter."""
    head = np.logical_and.accumulate(x[:, None, :] == y[None, :, :-1], axis=2).sum(2)
    tail = np.logical_and.accumulate((x[:, None, :] == y[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return head + tail >= x.shape[1]


def _by_length(words: list[str]):
    """(length, places) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    found, starts = np.unique(sizes[order], return_index=True)
    for length, places in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield length, places


def _upper_trees(vocabulary: DataFrame) -> dict[int, tuple[KdTree, np.ndarray, np.ndarray]]:
    """length -> (tree, first cell of each leaf, cells of each leaf). A leaf that cannot be cut any more has several cells."""
    sizes = {r["size"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE_WORDS / max(1, sum(sizes.values())))
    drawn = vocabulary if share == 1 else vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = [r["word"] for r in drawn.select("word").toLocalIterator()]
    leaf = max(CELL_SAMPLE, int(CELL_WORDS * share)) if share < 1 else CELL_WORDS
    groups = {length: [sample[i] for i in places] for length, places in _by_length(sample)} if sample else {}
    out, cells = {}, 0
    for length in sorted(sizes):
        words = groups.get(length, [])
        tree = KdTree(letter_counts(codes(words, length)), leaf, tight=False)
        several = np.array([0 if own is None else max(1, round(len(own) / share / (2 * CELL_WORDS))) for own in tree.own])
        first = cells + np.cumsum(several) - several
        cells += int(several.sum())
        out[length] = (tree, first, several)
    return out


_SENT = "cell long, kind int, word string, n long"
_PAIR = "a string, a_n long, b string, b_n long"


def _sent(trees, words: list[str], counts: np.ndarray):
    """(cell, kind, place) arrays: each word in its own cell, and in all that it may have neighbours in."""
    for length, places in _by_length(words):
        x = letter_counts(codes([words[i] for i in places], length))
        tree, first, several = trees[length]
        home = np.zeros(len(x), np.int64)
        for k, at in tree.within(x, 0, 0):
            home[at] = k
        block = np.fromiter((hash_of(words[i]) for i in places), np.int64, len(places)) % several[home]
        yield first[home] + block, np.full(len(x), MEMBER), places
        for k, at in tree.within(x, 1, 1):
            at = at[home[at] <= k]  # of two words in different cells the one of the lesser cell asks
            for b in range(int(several[k])):
                yield np.full(len(at), first[k] + b), np.where(home[at] == k, AT_HOME, AWAY), places[at]
        if length + 1 in trees:
            tree, first, several = trees[length + 1]
            for k, at in tree.within(x, 0, 1):
                for b in range(int(several[k])):
                    yield np.full(len(at), first[k] + b), np.full(len(at), SHORTER), places[at]


def hash_of(word: str) -> int:
    """Alike in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode()) >> 1


class Cell:
    """The words of one cell, all of one length, and their tree."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts, self.length = words, counts, len(words[0]) if words else -1
        if words:
            self.letters = codes(words, self.length)
            self.tree = KdTree(letter_counts(self.letters), LEAF_POINTS, tight=True)

    def near(self, words: list[str], kinds: np.ndarray):
        """(place in words, own place) of the pairs one edit apart."""
        for length, at in _by_length(words):
            x = codes([words[i] for i in at], length)
            same = length == self.length
            test = one_replaced if same else one_inserted
            for k, rows in self.tree.within(letter_counts(x), int(same), 1):
                own = self.tree.own[k]
                step = max(1, BLOCK // (len(own) * max(1, length)))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    q, m = np.nonzero(test(x[some], self.letters[own]))
                    for a, b in zip(at[some[q]].tolist(), own[m].tolist(), strict=True):
                        if kinds[a] != AT_HOME or words[a] < self.words[b]:
                            yield a, b


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of different words that one inserted, deleted or replaced code point makes equal, once.

    vocabulary (word, n): words must be distinct and not null; an empty word is near to words of one letter. A cell holds a
    bounded part of the words: where many have the same letters, they are dealt to several cells, and searches go to all of those.
    """
    spark = vocabulary.sparkSession
    trees = spark.sparkContext.broadcast(_upper_trees(vocabulary))

    def deal(batches):
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), np.asarray(batch.column("n"), np.int64)
            if not words:
                continue
            for cell, kind, places in _sent(trees.value, words, counts):
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(kind.astype(np.int32)), batch.column("word").take(pa.array(places)).cast(pa.string()), pa.array(counts[places])], names=["cell", "kind", "word", "n"])

    def search(batches):
        at, words, counts, cell = None, [], [], None
        for batch in batches:
            keys, kinds = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            texts, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            cuts = np.flatnonzero(np.diff(keys) | (np.diff(kinds == MEMBER) & 1)) + 1 if len(keys) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != at:
                    at, words, counts, cell = keys[lo], [], [], None
                if kinds[lo] == MEMBER:
                    words, counts = words + texts[lo:hi], counts + n[lo:hi]
                    continue
                if not words:
                    continue
                cell = cell or Cell(words, counts)
                found = list(cell.near(texts[lo:hi], kinds[lo:hi]))
                for i in range(0, len(found), 100_000):
                    part = found[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([texts[lo + a] for a, _ in part], pa.string()), pa.array([n[lo + a] for a, _ in part], pa.int64()), pa.array([words[b] for _, b in part], pa.string()), pa.array([counts[b] for _, b in part], pa.int64())],
                        names=["a", "a_n", "b", "b_n"],
                    )

    dealt = by_batch(vocabulary.select("word", F.col("n").cast("long").alias("n")), _SENT, deal)
    return by_batch(dealt.repartition("cell").sortWithinPartitions("cell", "kind"), _PAIR, search)


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n).

    form: the word one edit away with the largest n (ties: the least in code-point order), if that is TIMES n or more, else null;
    root: where the forms lead to in the end, the word itself if it has none; n_near: all words one edit away.
    Null words are left out, the counts of repeated rows are added, a null count is zero.
    """
    vocabulary = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "spelling-words")
    pairs = near_pairs(vocabulary)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    one = pairs.select(F.explode(ways).alias("x")).select("x.*")
    best = one.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= TIMES * F.col("n")
    out = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"))
    out = stored(out, "spelling-forms")
    return out.join(roots(out), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form) whose form is not null. Each round doubles the steps; counts grow along forms, so there are no circles."""
    at = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def runs(docs: DataFrame, kept: Column | None = None) -> DataFrame:
    """(doc_id, run) of every maximal run of Latin letters of the whole texts, with A-Z lower-cased; a null text has none."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")).alias("run"))


def with_slips(words: DataFrame, one_in: int = 199) -> DataFrame:
    """(doc_id, run) -> (word): one run in ``one_in`` loses a letter, the same one in every run. A null doc_id counts as an empty one."""
    hashed = words.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))).alias("h"))
    cut = F.expr("concat(substring(run, 1, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2, length(run)))")
    return hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = with_slips(runs(read(spark, sf_dir, "documents").select("doc_id", "text")))
    words = seen.where("length(word) >= 6").groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12_spelling}
ORACLE_SQL = {
    "op12_spelling": r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT i, c FROM bits WHERE k = 8),
found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT row_number() OVER () AS id, doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL)),
crc(id, place, c) AS (
  SELECT id, 0, 4294967295 FROM counted
  UNION ALL
  SELECT crc.id, place + 1, xor(crc.c >> 8, steps.c)
  FROM crc JOIN counted USING (id) JOIN steps ON steps.i = xor(crc.c & 255, CAST('0x' || substr(bytes, 2 * place + 1, 2) AS BIGINT))
  WHERE 2 * place < length(bytes)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM crc JOIN counted USING (id) WHERE 2 * place = length(bytes)),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, (list(other ORDER BY n DESC, encode(other)))[1] AS other, max(n) AS most FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
led(word, up) AS (SELECT word, word FROM forms UNION ALL SELECT led.word, form FROM led JOIN forms ON up = forms.word WHERE form IS NOT NULL)
SELECT f.word, form, up AS root, n, n_near, form_n FROM forms f JOIN led USING (word) WHERE up IN (SELECT word FROM forms WHERE form IS NULL)
"""
}
