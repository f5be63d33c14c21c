"""Removal of repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus.

The reference is the corpus itself. It is cut at content-defined anchors into overlapping phrases (see anchors: a phrase is
the words of all windows with one anchor), and the phrases of one anchor make up a reference block. A window can match
in the block of its anchor only, so each text meets just the blocks that it has anchors of, all of them in one exchange.

* A phrase that its block holds a second time, by hash of all its words, is a factor as a whole.
* Any other phrase whose block holds different phrases goes there with its words. It is parsed greedily: the first window
  that the block's index of windows knows elsewhere opens a factor, which grows word by word as long as its source agrees;
  the window that crosses the factor's end is then looked up in turn, so that nothing is lost at a factor's boundary.
* Blocks that are very large (an anchor in very many different phrases) are not held in one task: their windows meet by
  hash, one by one. The most frequent anchors are known from a sample and spared the exchange by anchor.

Factors that continue each other in text and source are joined. One of as many words as a window, or more, is a duplicate span.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import covered, spans
from .common import WordHashes, by_batch, packed, read, stored

WINDOW, GRAM = 35, 14
#: Phrases that a map task holds before it sends them.
HELD = 400_000
#: Phrases with their words that a task holds of one reference block; larger blocks are looked up window by window.
BLOCK_PHRASES = 20_000
#: A sample of about so many texts tells the most frequent anchors: those in at least this share and number of its texts.
SAMPLE_TEXTS, HOT_SHARE, HOT_TEXTS = 20_000, 0.005, 50
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0x94D049BB133111EB)
_STEP = 1 << 15


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: int):
        with np.errstate(over="ignore"):
            up = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(_STEP + 4096, np.uint64(b)))))
            self.up, self.down = up(base), up(pow(base, -1, 1 << 64))


_POWERS = tuple(map(_Powers, _BASES))


def range_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of items[start:end] for each range, of at most 4096 items. Ranges must be sorted by start."""
    out = np.empty(len(starts), np.uint64)
    p = _POWERS[which]
    with np.errstate(over="ignore"):
        for at in range(0, len(items), _STEP):
            i, j = np.searchsorted(starts, (at, at + _STEP))
            if i == j:
                continue
            part = items[at : at + _STEP + 4096]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(part * p.up[: len(part)], dtype=np.uint64)))
            a, b = starts[i:j] - at, ends[i:j] - at
            h = (sums[b] - sums[a]) * p.down[a] + (b - a).astype(np.uint64)
            h = (h ^ (h >> np.uint64(30))) * _MIX
            out[i:j] = h ^ (h >> np.uint64(31))
    return out


#: kind 0: a factor of n windows from ``start`` on, and its source; first: no such words start earlier. kind 1: a phrase for
#: its reference block, kind 2: for the index of windows; weight 2 stands for a phrase that occurs elsewhere, too.
_ROWS = "kind byte, deal long, anchor long, phrase long, doc long, tag long, start int, n int, weight int, first boolean, src_doc long, src_tag long, src_start int"
_TYPES = {"byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_PLACE = ("doc", "tag", "start")


def _rows(kind: int, size: int, /, **columns) -> pa.RecordBatch:
    """``size`` rows of _ROWS; columns not given are null."""
    arrays = {}
    for name, t in (c.split() for c in _ROWS.split(", ")):
        v = np.full(size, kind, np.int8) if name == "kind" else columns.get(name)
        arrays[name] = pa.nulls(size, _TYPES[t]) if v is None else pa.array(v, _TYPES[t])
    return pa.RecordBatch.from_pydict(arrays)


def _factors(doc, tag, start, n, first, src_doc, src_tag, src_start) -> pa.RecordBatch:
    """Factors as rows of kind 0; those that continue each other in text and source are joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, n, first, src_doc, src_tag, src_start = (x[order] for x in (doc, tag, start, n, first, src_doc, src_tag, src_start))
    on = np.zeros(len(doc), bool)
    if len(doc):
        on[1:] = (start[1:] == start[:-1] + n[:-1]) & (src_start[1:] == src_start[:-1] + n[:-1])
        for x in (doc, tag, first, src_doc, src_tag):
            on[1:] &= x[1:] == x[:-1]
    at = np.flatnonzero(~on)
    total = np.add.reduceat(n, at) if len(at) else n
    return _rows(0, len(at), deal=doc[at] * 31 + start[at], doc=doc[at], tag=tag[at], start=start[at], n=total, first=first[at], src_doc=src_doc[at], src_tag=src_tag[at], src_start=src_start[at])


def _copies(new: np.ndarray, x: dict[str, np.ndarray], whole: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Factors of sorted phrases of which runs (``new`` marks their first) are equal, where the run is ``whole``."""
    at = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    pick = np.flatnonzero((size[run] > 1) & (True if whole is None else whole[run]))
    if not len(pick):
        return None
    first = new[pick]
    source = np.where(first, at[run[pick]] + 1, at[run[pick]])
    return _factors(*(x[c][pick] for c in (*_PLACE, "n")), first, *(x[c][source] for c in _PLACE))


def frequent_anchors(df: DataFrame, window: int, gram: int) -> np.ndarray:
    """Sorted anchors that a sample of (doc, tag, text) shows to be frequent; at most some 1 / HOT_SHARE for each phrase of a text."""
    n = max(1, df.count())
    sampled = df.where(F.shiftrightunsigned(F.xxhash64("doc", "tag"), 32) < F.lit(int(min(1.0, SAMPLE_TEXTS / n) * (1 << 32))))

    def body(batches):
        words = WordHashes()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = np.unique(spans(words.of((text or b"").split())[0], window, gram)[3])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["anchor"])

    least = max(HOT_TEXTS, int(HOT_SHARE * min(n, SAMPLE_TEXTS)))
    found = by_batch(sampled.select("text"), "anchor long", body).groupBy("anchor").count().where(F.col("count") >= least)
    return np.sort(np.array([r["anchor"] for r in found.collect()], np.int64))


def parse(df: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc, tag, text) -> rows of _ROWS: factors of whole phrases, and the phrases that need a reference block or the index of windows."""
    hot = frequent_anchors(df, window, gram)

    def cut(batches):
        words = WordHashes()
        held: list[tuple] = []
        size = 0

        def flush():
            """Phrases that a task sees twice are copies at once; the first of them, of weight 2, stands for them from here on."""
            nonlocal held, size
            x = {c: np.concatenate([h[i] for h in held]) for i, c in enumerate(("anchor", "phrase", *_PLACE, "n"))}
            order = np.lexsort((x["start"], x["tag"], x["doc"], x["phrase"], x["anchor"]))
            x = {c: v[order] for c, v in x.items()}
            a, p = x["anchor"], x["phrase"]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))
            if (copies := _copies(new, x)) is not None:
                yield copies
            at = np.flatnonzero(new)
            weight = np.minimum(2, np.diff(np.append(at, len(new))))
            x = {c: v[at] for c, v in x.items()}
            # A frequent anchor is dealt by its phrases.
            often = np.isin(x["anchor"], hot)
            yield _rows(1, len(at), deal=np.where(often, x["phrase"], x["anchor"]), weight=weight, first=often, **x)
            held, size = [], 0

        for batch in batches:
            for d, t, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = (text or b"").split()
                if len(found) < window:
                    continue
                lo, hi = words.of(found)
                starts, ends, _, anchors = spans(lo, window, gram)
                phrases = range_hashes(hi, starts, ends - 1 + window, 0)
                k = len(starts)
                held.append((anchors.view(np.int64), phrases.view(np.int64), np.full(k, d, np.int64), np.full(k, t, np.int64), starts.astype(np.int32), (ends - starts).astype(np.int32)))
                size += k
            if size > HELD:
                yield from flush()
        if held:
            yield from flush()

    def match(batches):
        """Rows sorted by anchor, phrase and place. Equal phrases are copies; the first goes on if a run beside it has its anchor."""
        held: pd.DataFrame | None = None
        before = None  # anchor of the run before the held rows

        def judged(rows: pd.DataFrame, last: bool):
            nonlocal held, before
            a, p = rows["anchor"].to_numpy(np.int64), rows["phrase"].to_numpy(np.int64)
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1])))
            at = np.flatnonzero(new)
            heads = a[at]
            beside = np.zeros(len(at), bool)
            beside[1:] |= heads[1:] == heads[:-1]
            beside[:-1] |= heads[1:] == heads[:-1]
            beside[0] |= before is not None and heads[0] == before
            weight = np.minimum(2, np.add.reduceat(rows["weight"].to_numpy(np.int64), at))
            done = len(at) if last else len(at) - 1
            x = {c: rows[c].to_numpy(np.int64) for c in (*_PLACE, "n")}
            # A weight of 2 says that a copy is told of already: the first of this run may be another one's, too.
            if (copies := _copies(new, x, np.arange(len(at)) < done)) is not None:
                yield copies
            often = rows["first"].to_numpy(bool)[at]
            for kind, pick in ((1, beside & ~often), (2, often)):
                look = np.flatnonzero(pick[:done])
                if len(look):
                    yield _rows(kind, len(look), anchor=heads[look], weight=weight[look], **{c: v[at[look]] for c, v in x.items()})
            if done:
                before = int(heads[done - 1])
            held = None if last else rows.iloc[at[-1] :]

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            passed = batch.filter(pa.array(kinds == 0))
            if passed.num_rows:
                yield passed
            rest = batch.filter(pa.array(kinds == 1))
            if rest.num_rows:
                rest = rest.select(["anchor", "phrase", *_PLACE, "n", "weight", "first"]).to_pandas()
                yield from judged(rest if held is None else pd.concat([held, rest], ignore_index=True), last=False)
        if held is not None and len(held):
            yield from judged(held, last=True)

    sent = by_batch(df.select("doc", "tag", "text"), _ROWS, cut)
    dealt = sent.repartition("deal").sortWithinPartitions("kind", "anchor", "phrase", *_PLACE)
    return by_batch(dealt, _ROWS, match)


_WORDS = "anchor long, doc long, tag long, start int, n int, weight int, words binary, w1 long, w2 long"


def _with_words(df: DataFrame, window: int) -> DataFrame:
    """(doc, tag, text, phrases: array of (kind, anchor, start, n, weight)) -> rows of _WORDS: phrases of kind 1 with the hashes of their
    words, those of kind 2 as one row for each window, with its hashes."""

    def body(batches):
        hashes = WordHashes()
        for batch in batches:
            whole: list[tuple] = []
            single: list[tuple] = []
            for d, t, text, phrases in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("phrases").to_pylist(), strict=True):
                lo, _ = hashes.of((text or b"").split())
                for p in phrases:
                    if p["kind"] == 1:
                        whole.append((p["anchor"], d, t, p["start"], p["n"], p["weight"], lo[p["start"] : p["start"] + p["n"] - 1 + window].tobytes()))
                    else:
                        single.append((d, t, p["start"], p["n"], p["weight"], lo[p["start"] : p["start"] + p["n"] - 1 + window]))
            if whole:
                yield _worded(*zip(*whole, strict=True))
            if single:
                yield _windowed(*zip(*single, strict=True), window)

    return by_batch(df, _WORDS, body)


def _worded(anchor, doc, tag, start, n, weight, words=None, w1=None, w2=None) -> pa.RecordBatch:
    columns = {"anchor": anchor, "doc": doc, "tag": tag, "start": start, "n": n, "weight": weight, "words": words, "w1": w1, "w2": w2}
    types = {name: pa.binary() if t == "binary" else _TYPES[t] for name, t in (c.split() for c in _WORDS.split(", "))}
    return pa.RecordBatch.from_pydict({c: pa.nulls(len(doc), types[c]) if v is None else pa.array(v, types[c]) for c, v in columns.items()})


def _windowed(doc, tag, start, n, weight, words: tuple[np.ndarray, ...], window: int) -> pa.RecordBatch:
    """Phrases as one row for each of their windows, of two hashes."""
    n = np.array(n, np.int64)
    rec, t, place = _windows_of(n, window)
    joined = np.concatenate(words)
    each = lambda x: np.array(x, np.int64)[rec]
    w1, w2 = (range_hashes(joined, place, place + window, k).view(np.int64) for k in (0, 1))
    return _worded(None, each(doc), each(tag), each(start) + t, np.ones(len(rec), np.int64), each(weight), w1=w1, w2=w2)


def _windows_of(n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of phrases of n windows, with their words one after another: for each window its phrase, its number there, its first word."""
    rec = np.repeat(np.arange(len(n)), n)
    t = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    offsets = np.cumsum(n + window - 1) - (n + window - 1)
    return rec, t, offsets[rec] + t


def greedy(rows: pd.DataFrame, window: int) -> pa.RecordBatch | None:
    """Factors of phrases (anchor, doc, tag, start, n, weight, words) in the order of anchor and place, each parsed against its anchor's block."""
    n = rows["n"].to_numpy(np.int64)
    rec, t, place = _windows_of(n, window)
    block = np.cumsum(rows["anchor"].diff().ne(0).to_numpy())[rec]
    h = range_hashes(np.frombuffer(b"".join(rows["words"]), np.uint64), place, place + window, 0)
    order = np.lexsort((h, block))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (block[order][1:] != block[order][:-1])))
    at = np.flatnonzero(new)
    ids = np.empty(len(h), np.int64)
    ids[order] = np.cumsum(new) - 1
    size = np.diff(np.append(at, len(h)))
    opens = order[at]  # windows come in the order of their places
    second = order[np.minimum(at + 1, len(h) - 1)]
    first = opens[ids] == np.arange(len(h))
    source = np.where(first, second[ids], opens[ids])
    # The first place of a phrase that is copied whole is told of already.
    need = (size[ids] > 1) & ~(first & (rows["weight"].to_numpy(np.int64)[rec] > 1))
    if not need.any():
        return None
    ends = np.cumsum(n)
    found = []
    for q in np.flatnonzero(need & ~np.concatenate(([False], (need[1:] & need[:-1]) & (rec[1:] == rec[:-1])))).tolist():
        stop = int(ends[rec[q]])
        while q < stop and need[q]:
            s = int(source[q])
            m = min(stop - q, int(ends[rec[s]]) - s)
            other = (ids[q : q + m] != ids[s : s + m]) | ~need[q : q + m] | (first[q : q + m] != first[q])
            length = int(other.argmax()) if other.any() else m
            found.append((q, s, length))
            q += length
    q, s, length = (np.array(x, np.int64) for x in zip(*found, strict=True))
    doc, tag, start = (rows[c].to_numpy(np.int64) for c in _PLACE)
    return _factors(doc[rec[q]], tag[rec[q]], start[rec[q]] + t[q], length, first[q], doc[rec[s]], tag[rec[s]], start[rec[s]] + t[s])


def _in_blocks(phrases: DataFrame, window: int) -> DataFrame:
    """Rows of _WORDS with words -> factors (rows of _ROWS), and the phrases of blocks that are too large as windows (kind 2, hashes in anchor and phrase)."""

    def body(batches):
        held: pd.DataFrame | None = None
        large = None

        def singly(rows: pd.DataFrame):
            w = _windowed(*(rows[c] for c in (*_PLACE, "n", "weight")), tuple(np.frombuffer(b, np.uint64) for b in rows["words"]), window)
            yield _rows(2, w.num_rows, anchor=w.column("w1"), phrase=w.column("w2"), **{c: w.column(c) for c in (*_PLACE, "n", "weight")})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = rows["anchor"].iloc[-1]
            over = (rows["anchor"] == large).to_numpy() if large is not None else np.zeros(len(rows), bool)
            done = (rows["anchor"] != last).to_numpy() & ~over
            if done.any() and (out := greedy(rows[done].reset_index(drop=True), window)) is not None:
                yield out
            held = rows[~done & ~over].reset_index(drop=True)
            if over.any():
                yield from singly(rows[over])
            if len(held) > BLOCK_PHRASES:
                large = last
                yield from singly(held)
                held = None
        if held is not None and len(held) and (out := greedy(held, window)) is not None:
            yield out

    return by_batch(phrases.repartition("anchor").sortWithinPartitions("anchor", *_PLACE), _ROWS, body)


def factors(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tag, text) -> doc, tag, start, n, first, src_doc, src_tag, src_start: factors of n + window - 1 words from word ``start`` on.

    All windows that start anywhere else are in one of the factors. Where ``first`` is false they also start earlier in the
    order of (doc, tag, start); of such windows there is always a factor that says so.
    """
    if not 1 <= gram < window or window > 2000:
        raise ValueError("a gram must be shorter than a window of at most 2000 words")
    parsed = stored(parse(df, window, gram), "phrases", compression="zstd")
    open_ones = parsed.where("kind > 0").groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "anchor", "start", "n", "weight")).alias("phrases"))
    worded = stored(_with_words(df.select("doc", "tag", "text").join(open_ones, ["doc", "tag"]), window), "worded", compression="zstd")
    blocks = stored(_in_blocks(worded.where("words IS NOT NULL"), window), "blocks", compression="zstd")
    windows = worded.where("words IS NULL").select("w1", "w2", *_PLACE, "weight").union(blocks.where("kind = 2").select("anchor", "phrase", *_PLACE, "weight"))
    place = F.struct(*_PLACE)
    known = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("total"), F.min(place).alias("least"), F.max(place).alias("most")).where("total > 1")
    first = (place == F.col("least")).alias("first")
    source = F.when(first, F.col("most")).otherwise(F.col("least"))
    single = windows.join(known, ["w1", "w2"]).where((F.col("weight") == 1) | ~first)
    single = single.select(*_PLACE, F.lit(1).alias("n"), first, source["doc"].alias("src_doc"), source["tag"].alias("src_tag"), source["start"].alias("src_start"))
    columns = [*_PLACE, "n", "first", "src_doc", "src_tag", "src_start"]
    return parsed.where("kind = 0").select(*columns).union(blocks.where("kind = 0").select(*columns)).union(single)


def identified(docs: DataFrame) -> DataFrame:
    """doc, tag, text and ``row`` (all columns but the text): doc and tag tell rows apart, except those with equal id and text."""
    ids = F.col("doc_id").cast("long")
    odd = docs.where("doc_id IS NULL").limit(1).select(F.lit(1)).union(docs.groupBy("doc_id").count().where("count > 1").limit(1).select(F.lit(1)))
    if odd.isEmpty():
        return docs.select(packed(docs, "text"), ids.alias("doc"), F.lit(0).cast("long").alias("tag"), "text")
    # 128 bits for rows without an id.
    return docs.select(packed(docs, "text"), F.coalesce(ids, F.xxhash64(F.lit("no id"), "text")).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(doc_id, text) and any other columns -> the same rows with n_words, n_removed, kept (string) in place of text.

    A word goes if it lies in a run of ``window`` words that also starts anywhere else, in this document or another; all
    of the copies go, or with ``keep_first`` all but the first by doc_id and place (rows without an id by a hash). Words
    are maximal runs of bytes other than white space in ASCII; the kept ones are joined by one space. Null texts count as
    empty. Rows that repeat a doc_id count as documents of their own, equal ones included. Texts may be of any length.
    Columns named n_words, n_removed or kept are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    keyed = identified(docs)
    found = factors(keyed, window, gram)
    found = found.where("NOT first") if keep_first else found
    ranges = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = keyed.join(ranges, ["doc", "tag"], "left").select("row", "text", F.col("ranges.start").alias("start"), F.col("ranges.n").alias("n"))

    def body(batches):
        for batch in batches:
            counts, texts = [], []
            for text, s, n in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("start").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words = (text or b"").split()
                if s:
                    starts = np.array(s, np.int64)
                    gone = covered(starts, starts + np.array(n, np.int64) - 1 + window, len(words))
                    counts.append((len(words), int(gone.sum())))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    counts.append((len(words), 0))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    schema = StructType([joined.schema["row"], *StructType.fromDDL("n_words long, n_removed long, kept string").fields])
    return by_batch(joined, schema, body).select("row.*", "n_words", "n_removed", "kept")


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_rlz_dedup": op1_rlz_dedup}
ORACLE_SQL = {
    "op1_rlz_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT n, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
windows AS (SELECT n, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT n, i + k AS p FROM (SELECT n, i FROM windows SEMI JOIN twice USING (h)), (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT n, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT n, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS c FROM words ANTI JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (n)
"""
}
