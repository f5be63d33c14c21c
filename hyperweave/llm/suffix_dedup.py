"""Removal of repeated byte strings by a distributed merge sort of suffixes that is aware of common prefixes.

Equal windows hold the same content-defined anchor at the same place (see anchors), so only the suffixes that start at
anchors are sorted. A record is such a suffix, as far as the windows of its span reach, followed by what the windows
hold to the left of the anchor.

* A map task sorts its records into runs, keeps one of equal records and front-codes the rest: the length of the prefix
  shared with the record before, and the tail. Runs are cut at sampled splitters and exchanged in compressed blobs.
* Each part merges its runs by a loser tree which holds, for every run, the prefix length shared with the last winner:
  records that differ there are ordered without a look at their bytes, others are compared from that length on.
* Records that come out equal have equal windows throughout: all but the first in document order go. Neighbours that
  share the anchor but differ elsewhere may still share windows; how far to the right is known from the common prefix.
  These windows are compared one by one. Where a group of them is large, or may go on in another part, its windows are
  exchanged by a 128-bit hash instead.
"""

from __future__ import annotations

import struct
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import covered, spans
from .common import by_batch, read, stored

WINDOW, GRAM = 100, 20
#: Bytes of records that a map task holds before it writes a run.
RUN_BYTES = 40 << 20
#: Bytes of records that a part should have; the number of parts follows from the input.
PART_BYTES = 64 << 20
CHUNK, LEVEL = 2048, 3
#: A group of more differing records that share an anchor is exchanged by window hash.
GROUP_RECORDS = 2048
#: Sampled records for each part, by which the parts are cut.
SAMPLES = 64
NULL_ID = (1 << 63) - 1
_META = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("lcp", "u1"), ("tail", "u1")])
_ROWS = "kind byte, deal int, part int, run long, seq int, doc long, tag long, at long, stop long, h1 long, h2 long, blob binary"


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    """n rows of _ROWS; columns not given are null."""
    types = {"kind": pa.int8(), "deal": pa.int32(), "part": pa.int32(), "run": pa.int64(), "seq": pa.int32(), "blob": pa.binary()}
    arrays = {}
    for name in (c.split()[0] for c in _ROWS.split(", ")):
        t = types.get(name, pa.int64())
        v = kind if name == "kind" else columns.get(name)
        arrays[name] = pa.array(np.full(n, v), t) if np.isscalar(v) else pa.nulls(n, t) if v is None else pa.array(v, t)
    return pa.RecordBatch.from_pydict(arrays)


def records(text: bytes, window: int, gram: int) -> list[tuple[bytes, int]]:
    """(record, start of its first window) for each span: suffix from the anchor, then the left part, then the length of that."""
    if len(text) < window:
        return []
    starts, ends, places, _ = spans(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), window, gram)
    return [(text[p : e - 1 + window] + text[s:p] + bytes([p - s]), s) for s, e, p in zip(starts.tolist(), ends.tolist(), places.tolist(), strict=True)]


def shared_prefixes(sorted_records: list[bytes]) -> np.ndarray:
    """Of each record, the length of the prefix that it shares with the one before (0 for the first)."""
    out = np.zeros(len(sorted_records), np.int64)
    for at in range(0, len(sorted_records), CHUNK):
        some = sorted_records[max(0, at - 1) : at + CHUNK]
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        width = int(lengths.max())
        m = np.array(some, f"S{width}").view(np.uint8).reshape(len(some), width)
        differ = m[1:] != m[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[at + (at == 0) : at + len(some) - (at > 0)] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def encode_run(recs: list[bytes], doc: list[int], tag: list[int], at: list[int], lcp: np.ndarray) -> bytes:
    """A front-coded run: chunks of CHUNK records, each compressed on its own, the first record of each whole."""
    out = []
    for i in range(0, len(recs), CHUNK):
        j = min(i + CHUNK, len(recs))
        meta = np.empty(j - i, _META)
        shared = lcp[i:j].copy()
        shared[0] = 0
        meta["doc"], meta["tag"], meta["at"], meta["lcp"] = doc[i:j], tag[i:j], at[i:j], shared
        tails = [r[c:] for r, c in zip(recs[i:j], shared.tolist(), strict=True)]
        meta["tail"] = [*map(len, tails)]
        packed = zstandard.compress(meta.tobytes() + b"".join(tails), LEVEL)
        out.append(struct.pack("<IIB", len(packed), j - i, int(lcp[i]) if i else 0) + packed)
    return b"".join(out)


def decode_run(blobs: list[bytes]):
    """Yields (record, prefix shared with the record before, doc, tag, at), chunk by chunk."""
    last = b""
    for blob in blobs:
        pos = 0
        while pos < len(blob):
            size, n, lcp = struct.unpack_from("<IIB", blob, pos)
            data = zstandard.decompress(blob[pos + 9 : pos + 9 + size])
            pos += 9 + size
            meta = np.frombuffer(data, _META, n)
            shared, ends = meta["lcp"].tolist(), (n * _META.itemsize + np.cumsum(meta["tail"], dtype=np.int64)).tolist()
            start, first = n * _META.itemsize, True
            for c, e, d, t, a in zip(shared, ends, meta["doc"].tolist(), meta["tag"].tolist(), meta["at"].tolist(), strict=True):
                last = last[:c] + data[start:e] if c else data[start:e]
                yield last, (lcp if first else c), d, t, a
                start, first = e, False


def merge(runs: list):
    """Merges sorted runs of decode_run by a loser tree: yields (record, prefix shared with the last one yielded, doc, tag, at)."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    cur = [h[0] if h else None for h in heads]
    shared = [0 if h else -1 for h in heads]  # with the last winner; -1: the run has ended
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared length becomes the one with the winner."""
        ha, hb = shared[a], shared[b]
        if ha > hb:
            return a, b
        if hb > ha:
            return b, a
        if ha < 0:
            return a, b
        x, y = cur[a], cur[b]
        c, least = ha, min(len(x), len(y))
        while c < least and x[c] == y[c]:
            c += 1
        if c < len(y) and (c == len(x) or x[c] < y[c]):
            shared[b] = c
            return a, b
        if c == len(x) and c == len(y) and a < b:
            shared[b] = c
            return a, b
        shared[a] = c
        return b, a

    winners = [0] * k + list(range(k))
    for n in range(k - 1, 0, -1):
        winners[n], loser[n] = play(winners[2 * n], winners[2 * n + 1])
    w = winners[1] if k > 1 else 0
    while shared[w] >= 0:
        h = heads[w]
        yield h[0], shared[w], h[2], h[3], h[4]
        heads[w] = h = next(runs[w], None)
        if h is None:
            shared[w], cur[w] = -1, None
        else:
            cur[w], shared[w] = h[0], h[1]
        n = (w + k) >> 1
        while n:
            o = loser[n]
            so, sw = shared[o], shared[w]
            if so > sw:
                loser[n], w = w, o
            elif so == sw and so >= 0:
                w, loser[n] = play(w, o)
            n >>= 1


def _near(group: list, window: int):
    """Windows of a group's records that a differing record may share: yields (index, window, its start in the document).

    group: (record, length shared with the next or previous record, doc, tag, at). A window with o bytes left of the
    anchor needs window - o shared to the right.
    """
    for i, (rec, most, _, _, at) in enumerate(group):
        left = rec[-1]
        body = rec[-1 - left : -1] + rec[: -1 - left]
        most = min(most, len(rec) - 1 - left)
        for j in range(min(len(body) - window, left - window + most) + 1):
            yield i, body[j : j + window], at + j


def joined(ranges: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """(doc, tag, at, stop) in any order as the fewest sorted ranges that cover the same bytes."""
    out: list[list[int]] = []
    for d, t, a, b in sorted(ranges):
        if out and out[-1][0] == d and out[-1][1] == t and a <= out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([d, t, a, b])
    return out


def even_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of ``parts`` a key that repartition(parts, key) sends to a partition of its own."""
    slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("slot")
    keys = np.arange(parts, dtype=np.int32)
    for r in spark.range(16 * parts).select(slot, F.col("id").cast("int").alias("key")).groupBy("slot").agg(F.min("key").alias("key")).collect():
        keys[r["slot"]] = r["key"]
    return keys


def repeated(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tag, at, stop): byte ranges to remove from (doc, tag, text); see dedup."""
    spark = df.sparkSession
    if window - gram < 1 or window > 120:
        raise ValueError("windows of gram + 1 to 120 bytes fit the record format")
    size = df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # A span has (window - gram + 2) / 2 windows on average; its record, those and the rest of the last window.
    n_records = max(1, 2 * size // (window - gram + 2))
    raw = size + n_records * (window - 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), raw // PART_BYTES + 1)
    share = min(1.0, SAMPLES * parts / n_records)
    of_texts = min(1.0, 8 * share)
    among = int(min(1.0, share / of_texts) * (1 << 32))
    sampled = df.where(F.shiftrightunsigned(F.xxhash64("doc", "tag"), 32) < F.lit(int(of_texts * (1 << 32))))

    def sample(batches):
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                keep = {r for r, _ in records(t or b"", window, gram) if xxhash.xxh64_intdigest(r) >> 32 < among}
                yield pa.RecordBatch.from_pydict({"rec": pa.array(sorted(keep), pa.binary())})

    # Some SAMPLES records a part, for balance alone: no result depends on the splitters.
    known = sorted(bytes(r[0]) for r in by_batch(sampled.select("text"), "rec binary", sample).distinct().orderBy(F.xxhash64("rec")).limit(4 * SAMPLES * parts).collect())
    splitters = sorted({known[len(known) * i // parts] for i in range(1, parts)}) if known else []
    deal = even_keys(spark, parts)

    def map_side(batches):
        held: list[tuple[bytes, int, int, int]] = []
        size = run = 0
        task = TaskContext.get().partitionId() << 24

        def flush():
            nonlocal held, size, run
            held.sort()
            keep: list[int] = []
            gone: list[tuple[int, int, int, int]] = []
            last = None
            for i, (rec, d, t, a) in enumerate(held):
                if rec == last:
                    gone.append((d, t, a, a + len(rec) - 1))
                else:
                    keep.append(i)
                    last = rec
            if gone:
                d, t, a, b = zip(*joined(gone), strict=True)
                yield _rows(0, len(d), deal=deal[(np.array(d) * 1000003 + np.array(a)) % parts], doc=d, tag=t, at=a, stop=b)
            recs = [held[i][0] for i in keep]
            lcp = shared_prefixes(recs)
            cuts = [0, *(bisect_left(recs, s) for s in splitters), len(recs)]
            for part, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if i < j:
                    some = [held[x] for x in keep[i:j]]
                    blob = encode_run(recs[i:j], [x[1] for x in some], [x[2] for x in some], [x[3] for x in some], lcp[i:j])
                    yield _rows(1, 1, deal=deal[part], part=part, run=task + run, seq=0, blob=[blob])
            held, size, run = [], 0, run + 1

        for batch in batches:
            for d, t, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for rec, at in records(text or b"", window, gram):
                    held.append((rec, d, t, at))
                    size += len(rec) + 120
                if size > RUN_BYTES:
                    yield from flush()
        yield from flush()

    def reduce_side(batches):
        def ranges(gone):
            d, t, a, b = zip(*joined(gone), strict=True)
            return _rows(0, len(d), doc=d, tag=t, at=a, stop=b)

        def merged(part: int, blobs: dict[int, list[bytes]]):
            low = splitters[part - 1][:gram] if part and part <= len(splitters) else None
            high = splitters[part][:gram] if part < len(splitters) else None
            gone: list[tuple[int, int, int, int]] = []
            hot: list[tuple[int, int, int, int, int]] = []
            group: list[list] = []
            large = False

            def close(last: bool):
                """The group ends (last) or is too large to hold."""
                nonlocal group, large
                rec = group[0][0][:gram] if group else b""
                if large or not last or rec in (low, high):
                    for i, w, p in _near(group, window):
                        h = xxhash.xxh3_128_intdigest(w)
                        hot.append(((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), group[i][2], group[i][3], p))
                elif len(group) > 1:
                    best: dict[bytes, tuple[int, int, int]] = {}
                    for i, w, p in _near(group, window):
                        here = (group[i][2], group[i][3], p)
                        if (other := best.setdefault(w, here)) != here:
                            if here < other:
                                best[w] = here
                            d, t, p = max(here, other)
                            gone.append((d, t, p, p + window))
                large = not last
                group = []

            for rec, c, d, t, a in merge([decode_run(b) for b in blobs.values()]):
                if group and c == len(rec) == len(group[-1][0]):  # equal: the first occurrence stays
                    g = group[-1]
                    if (d, t, a) < (g[2], g[3], g[4]):
                        d, g[2], t, g[3], a, g[4] = g[2], d, g[3], t, g[4], a
                    gone.append((d, t, a, a + len(rec) - 1))
                else:
                    if group and c < gram:
                        close(True)
                    elif len(group) >= GROUP_RECORDS:
                        keep = group.pop()
                        keep[1] = max(keep[1], c)
                        close(False)
                        group = [keep]
                        group.append([rec, c, d, t, a])
                        c = -1
                    if c >= 0:
                        if group:
                            group[-1][1] = max(group[-1][1], c)
                            group.append([rec, c, d, t, a])
                        else:
                            # The record before lies in another part or group; what it shares with that one is less than
                            # a gram, unless the group is cut by the part's border.
                            group = [[rec, window if rec[:gram] == low else 0, d, t, a]]
                if len(gone) > 50_000:
                    yield ranges(gone)
                    gone = []
                if len(hot) > 50_000:
                    yield _rows(2, len(hot), h1=[x[0] for x in hot], h2=[x[1] for x in hot], doc=[x[2] for x in hot], tag=[x[3] for x in hot], at=[x[4] for x in hot])
                    hot.clear()
            if group:
                if group[-1][0][:gram] == high:
                    group[-1][1] = window
                close(True)
            if gone:
                yield ranges(gone)
            if hot:
                yield _rows(2, len(hot), h1=[x[0] for x in hot], h2=[x[1] for x in hot], doc=[x[2] for x in hot], tag=[x[3] for x in hot], at=[x[4] for x in hot])

        now, blobs = None, {}
        for batch in batches:
            kinds = np.array(batch.column("kind").to_pylist(), np.int64)
            passed = batch.filter(pa.array(kinds == 0))
            if passed.num_rows:
                yield passed
            rest = batch.filter(pa.array(kinds == 1))
            for part, run, blob in zip(*(rest.column(c).to_pylist() for c in ("part", "run", "blob")), strict=True):
                if part != now:
                    if blobs:
                        yield from merged(now, blobs)
                    now, blobs = part, {}
                blobs.setdefault(run, []).append(blob)
        if blobs:
            yield from merged(now, blobs)

    sent = by_batch(df.select("doc", "tag", "text"), _ROWS, map_side)
    dealt = sent.repartition(parts, "deal").sortWithinPartitions("part", "run", "seq")
    out = stored(by_batch(dealt, _ROWS, reduce_side).select("kind", "h1", "h2", "doc", "tag", "at", "stop"), "suffixes", compression="zstd")
    hot = out.where("kind = 2").select("h1", "h2", F.struct("doc", "tag", "at").alias("place"))
    first = hot.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = hot.join(first, ["h1", "h2"]).where("place <> first").select("place.*").withColumn("stop", F.col("at") + window)
    return out.where("kind = 0").select("doc", "tag", "at", "stop").union(later)


def keep_outside(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """df (doc, tag, doc_id, text) less ranges (doc, tag, at, stop): doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    per_doc = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("at", "stop")).alias("ranges"))
    joined = df.join(per_doc, ["doc", "tag"], "left").select("doc_id", "text", F.col("ranges.at").alias("at"), F.col("ranges.stop").alias("stop"))

    def body(batches):
        for batch in batches:
            counts, kept = [], []
            for text, a, b in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("at").to_pylist(), batch.column("stop").to_pylist(), strict=True):
                text = text or b""
                if not a:
                    counts.append((len(text), 0, 0))
                    kept.append(text)
                    continue
                gone = covered(np.array(a), np.array(b), len(text))
                counts.append((len(text), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return by_batch(joined, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary", body)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id long, text) -> doc_id, n_bytes, n_removed, n_spans, kept: each text without the bytes covered by a string of ``window`` bytes that also starts earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document; matches never cross documents and are judged
    on the input. Null texts count as empty. Null ids come last. Rows that repeat a doc_id are ordered by a hash of
    their texts; rows equal in both are one document, and each gets its result. ``kept`` is bytes: a removed range may cut
    a character.
    """
    keyed = docs.select("doc_id", "text").withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    if keyed.groupBy("doc").count().where("count > 1").isEmpty():
        return keep_outside(keyed.withColumn("tag", F.lit(0).cast("long")), repeated(keyed.select("doc", F.lit(0).cast("long").alias("tag"), "text"), window, gram))
    keyed = keyed.withColumn("tag", F.xxhash64("text"))
    return keep_outside(keyed, repeated(keyed.select("doc", "tag", "text").dropDuplicates(["doc", "tag"]), window, gram))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL = {
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) <> first),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM g),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
