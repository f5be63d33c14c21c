"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table: its Hamming distances to reference fingerprints (pivots). By the triangle
inequality two fingerprints within r bits differ by at most r in each coordinate, so a pair with a greater difference
anywhere is discarded unseen, and only survivors are verified bit by bit.

The table alone would be compared with every other one. Fingerprints within r bits agree wholly on one of r + 1 bands, so
tables meet within bands only. A band's block that is too large is split again by the same argument over the bits that
are left, until blocks are small: no link is lost, nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, packed, read, small_side, stored, texts
from .components import components

BITS = 64
#: 16 reference fingerprints from a fixed rule: XXH64 of their number.
PIVOTS = tuple(xxhash.xxh64_intdigest(bytes([i]), 0) for i in range(16))
#: A block of more fingerprints is split further.
BLOCK_ROWS = 1024
MAX_SPLITS = 6
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the text in lower case (A-Z only), repeats included; short texts are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, m = xxhash.xxh64_intdigest, len(words) - n + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)), np.uint64, m)


def fingerprint(text: bytes, n: int = 3) -> int:
    """Each bit is set if it is set in over half of the shingle hashes; a text without words gives zero."""
    h = shingle_hashes(text, n)
    if not len(h):
        return 0
    columns = h.view(np.uint8).reshape(-1, 8) if h.dtype.byteorder != ">" else h.byteswap().view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(columns[:, b], minlength=256) @ _BYTE_BITS for b in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * bits > len(h)).tolist()))


def with_fingerprint(df: DataFrame, text: str = "text", n: int = 3, out: str = "fp") -> DataFrame:
    """``df`` without its text, with ``out``: the fingerprint as a signed long. Null texts count as empty."""
    kept = [f for f in df.schema.fields if f.name not in (text, out)]

    def body(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, n) for t in texts(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(fps)], names=[*(f.name for f in kept), out])

    return by_batch(df, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{out}` long", body)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(mask: int, parts: int) -> list[int]:
    """Masks that extend ``mask`` by one of ``parts`` shares of the bits outside it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[len(free) * i // parts : len(free) * (i + 1) // parts]) for i in range(parts)]


def blocks(fps: DataFrame, radius: int, most: int = BLOCK_ROWS) -> DataFrame:
    """(fp) distinct -> (mask, key, fp): every two fingerprints within ``radius`` bits share a block; blocks hold ``most`` rows, or agree on all but a few bits."""
    spark = fps.sparkSession
    level = {m for m in _parts(0, radius + 1)}
    at = fps.withColumn("mask", F.explode(F.array(*(F.lit(_signed(m)) for m in sorted(level)))))
    done: DataFrame | None = None
    for _ in range(MAX_SPLITS):
        at = at.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = at.groupBy("mask", "key").count().where(F.col("count") > most).select("mask", "key").checkpoint()
        if large.isEmpty() or all(BITS - m.bit_count() <= radius for m in level):
            break
        # Few keys: each stands for over ``most`` fingerprints.
        small = at.join(large, ["mask", "key"], "left_anti").select("mask", "key", "fp")
        done = small if done is None else done.union(small)
        children = [(_signed(m), _signed(c)) for m in sorted(level) for c in _parts(m, radius + 1)]
        level = {c for m in level for c in _parts(m, radius + 1)}
        table = spark.createDataFrame(children, "mask long, child long")
        at = at.join(large, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("child").alias("mask")).distinct()
    at = at.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "key", "fp")
    return at if done is None else done.union(at)


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` with ``near`` and ``far``: the distances to the pivots, a byte each in two longs."""
    lane = lambda p, i: F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * i)

    def packed(group):
        out = lane(group[0], 0)
        for i, p in enumerate(group[1:], 1):
            out = out.bitwiseOR(lane(p, i))
        return out

    return fps.withColumns({"near": packed(PIVOTS[:8]), "far": packed(PIVOTS[8:])})


def _survivors(fp: np.ndarray, table: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one sorted batch that lie in one group and within ``radius`` bits.

    Rows are sorted by group and first distance: row i meets row i + lag for growing lags until no row's first distances
    are near enough.
    """
    left, right = [], []
    rows = np.arange(len(fp))
    lag = 1
    while len(rows):
        rows = rows[rows + lag < len(fp)]
        other = rows + lag
        near = (group[rows] == group[other]) & (table[other, 0] - table[rows, 0] <= radius)
        rows, other = rows[near], other[near]
        pair = np.abs(table[rows] - table[other]).max(axis=1) <= radius if len(rows) else np.empty(0, bool)
        a, b = rows[pair], other[pair]
        verified = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        left.append(a[verified])
        right.append(b[verified])
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same components as the pairs do: at most one for each member."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = top(x), top(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(fp) distinct -> (u, v): enough links to join all fingerprints that a chain of steps of ``radius`` bits joins."""
    made = pivot_table(blocks(fps, radius))
    made = made.repartition("mask", "key").sortWithinPartitions("mask", "key", F.col("near").bitwiseAND(F.lit(255)))

    def body(batches):
        held: pd.DataFrame | None = None

        def linked(rows: pd.DataFrame) -> pa.RecordBatch:
            fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
            table = np.concatenate([rows[c].to_numpy(np.int64).copy().view(np.uint8).reshape(-1, 8) for c in ("near", "far")], axis=1).astype(np.int16)
            new = (rows["mask"].diff().ne(0) | rows["key"].diff().ne(0)).to_numpy() if len(rows) else np.empty(0, bool)
            a, b = _survivors(fp, table, np.cumsum(new), radius)
            pairs = np.array(_forest(a, b), np.int64).reshape(-1, 2)
            signed = fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], names=["u", "v"])

        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = ((rows["mask"] == rows["mask"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])).to_numpy()
            held = rows[last]
            if not last.all():
                yield linked(rows[~last].reset_index(drop=True))
        if held is not None:
            yield linked(held.reset_index(drop=True))

    return by_batch(made, "u long, v long", body).distinct()


def classes(df: DataFrame, radius: int = 2, fp: str = "fp", id_col: str = "doc_id") -> DataFrame:
    """``df`` with component_id: the least non-null ``id_col`` of the rows whose fingerprints are joined by steps of ``radius`` bits or fewer.

    Equal fingerprints always join. A null fingerprint is joined to nothing and gets a null component_id, as does a
    component without ids. Copies are collapsed before any pair is looked at.
    """
    df = df.drop("component_id")
    rows = stored(df.select(packed(df), F.col(fp).alias("fp"), F.col(id_col).alias("id")), "fingerprints")
    nodes = stored(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp", "left").select("row.*", "component_id")


WIDE = 512
#: Chance that a pair at the threshold is lost, as it lies beyond the radius or shares no table's block; and the
#: fingerprints that a block should hold by chance.
MISS, BY_CHANCE = 0.02, 32
#: Standard deviations of the distance from its mean to the radius, and below it to the distance that needs no check.
DEVIATIONS = 3
#: Texts whose shingles a task holds at once to check pairs: two buckets of so many.
BUCKET_NODES, BUCKET_BYTES = 500, 16 << 20
SIMILARITY, SHINGLE = 0.8, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of WIDE bits of shingle hashes, as four uint64; no shingles give zero."""
    if not len(h):
        return np.zeros(WIDE // 64, np.uint64)
    with np.errstate(over="ignore"):
        wide = np.stack([h, *(_mixed(h + _GOLD * np.uint64(k)) for k in range(1, WIDE // 64))], axis=1)
    places = wide.view(np.uint8).reshape(len(h), -1).astype(np.int64) + 256 * np.arange(WIDE // 8)
    counts = np.bincount(places.ravel(), minlength=32 * WIDE).reshape(WIDE // 8, 256) @ _BYTE_BITS
    return np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view(np.uint64)


def expected_distance(similarity: float) -> float:
    """The share of bits in which two sets of equal size and this Jaccard similarity are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def chance_of_loss(share: float, radius: int, bits: int, tables: int) -> float:
    """Chance that fingerprints whose bits differ with chance ``share`` lie beyond the radius, or agree on the chosen bits of no table."""
    far = np.arange(WIDE + 1)
    chance = np.array([math.comb(WIDE, d) * share**d * (1 - share) ** (WIDE - d) for d in far.tolist()])
    agree = np.prod([np.maximum(WIDE - far - i, 0) / (WIDE - i) for i in range(bits)], axis=0)
    return float(np.where(far <= radius, chance * (1 - agree) ** tables, chance).sum())


def _near_pairs(words: np.ndarray, group: np.ndarray, radius: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within one group and ``radius`` bits, with their distances. The references are the first and the
    farthest fingerprint of each group; pairs whose distances to either differ by more than the radius are discarded,
    and so are those of which ``apart`` says no."""
    order = np.argsort(group, kind="stable")
    words, group = words[order], group[order]
    first = np.searchsorted(group, group)
    away = lambda x: np.bitwise_count(words ^ words[x]).sum(axis=1, dtype=np.int64)
    one = away(first)
    by_far = np.lexsort((-one, group))
    two = away(by_far[first])
    again = np.lexsort((one, group))
    order, words, group, one, two = order[again], words[again], group[again], one[again], two[again]
    left, right, far = [], [], []
    rows, lag = np.arange(len(words)), 1
    while len(rows):
        rows = rows[rows + lag < len(words)]
        near = (group[rows] == group[rows + lag]) & (one[rows + lag] - one[rows] <= radius)
        rows = rows[near]
        a = rows[np.abs(two[rows] - two[rows + lag]) <= radius]
        a = a if apart is None else a[apart(order[a], order[a + lag])]
        d = np.bitwise_count(words[a] ^ words[a + lag]).sum(axis=1, dtype=np.int64)
        ok = d <= radius
        left.append(order[a[ok]])
        right.append(order[a[ok] + lag])
        far.append(d[ok])
        lag += 1
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(left), cat(right), cat(far)


def keyed_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``tag``, a hash of its text: with the id it tells rows apart, except equal ones."""
    return df.withColumn("tag", F.coalesce(F.xxhash64(text), F.lit(0)))


def pieces(rows: DataFrame) -> DataFrame:
    """Rows (key, node, root, ...) with ``side``, and with a new key where a key has more than BLOCK_ROWS rows.

    Such a block is cut into pieces of about half that, which meet in pairs: any two rows of different roots share a new key,
    on different sides or, in the block of one piece, on side 0. A root with very many rows has pieces of its own, which do
    not meet each other; so a large group that is settled costs as many rows as others have pieces.
    """
    half = max(1, BLOCK_ROWS // 2)
    large = rows.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key").checkpoint()
    if large.isEmpty():
        return rows.withColumn("side", F.lit(0))
    large = small_side(large)
    small = rows.join(large, "key", "left_anti").withColumn("side", F.lit(0)).select(*rows.columns, "side")
    inside = stored(rows.join(large, "key", "left_semi").select(*rows.columns), "large-blocks")
    sizes = inside.groupBy("key", "root").count()
    own = small_side(sizes.where(F.col("count") > half).select("key", "root", F.lit(True).alias("own")).checkpoint())
    # Without a root of its own, a piece has the null root.
    whose = F.when(F.col("own"), F.col("root"))
    parts = sizes.join(own, ["key", "root"], "left").groupBy("key", whose.alias("whose")).agg(F.ceil(F.sum("count") / half).alias("n")).checkpoint()
    number = F.xxhash64(F.col("whose").isNull(), F.coalesce("whose", F.lit(0)), "i")
    cut = parts.select("key", "whose", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("key", "whose", number.alias("piece"))
    mixed = cut.where("whose IS NULL").select("key", F.col("piece").alias("a"))
    settled = cut.where("whose IS NOT NULL")
    with_mixed = mixed.join(cut.select("key", F.col("piece").alias("b")), "key")
    with_settled = settled.select("key", F.col("piece").alias("a"), "whose").join(settled.select("key", F.col("piece").alias("b"), F.col("whose").alias("other")), "key").where("whose <> other").select("key", "a", "b")
    meet = with_mixed.union(with_settled).select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    meet = meet.withColumn("block", F.xxhash64("key", "a", "b"))
    first = meet.select("key", F.col("a").alias("piece"), "block", F.when(F.col("a") == F.col("b"), 0).otherwise(1).alias("side"))
    second = meet.where("a <> b").select("key", F.col("b").alias("piece"), "block", F.lit(2).alias("side"))
    met = small_side(first.union(second).checkpoint())
    dealt = inside.join(own, ["key", "root"], "left").withColumn("whose", whose).drop("own")
    n_of = small_side(parts.select("key", F.col("whose").alias("of"), "n"))
    dealt = dealt.join(n_of, (dealt["key"] == n_of["key"]) & F.col("whose").eqNullSafe(F.col("of"))).drop(n_of["key"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("n"))).withColumn("piece", number)
    return small.union(dealt.join(met, ["key", "piece"]).withColumn("key", F.col("block")).select(*rows.columns, "side"))


def near_labels(df: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, tag, group_id, n_rows) of the rows of ``df``, without their texts; see near_groups.

    Such pairs differ in too many bits for the exact blocks of ``links``: at 0.8, in 15 of a hundred. So fingerprints of
    WIDE bits meet in tables of randomly chosen bits; their number follows from MISS, the chance that a pair at the
    threshold is lost, and the bits of each from the number of fingerprints. In a block, pivot distances
    discard pairs, survivors are verified by their distance, and pairs in doubt by their shingles.

    This takes two passes. The first finds most groups cheaply: it splits a block too large by further bits, and looks at a
    spanning forest of each block's pairs. The second loses nothing that shares a block: it compares all rows of a block
    that the first left in different groups, a block too large in pieces that meet each other (see ``pieces``).
    """
    names = [f"f{i}" for i in range(WIDE // 64)]
    share = expected_distance(similarity)
    deviation = DEVIATIONS * np.sqrt(WIDE * share * (1 - share))
    radius, sure = int(WIDE * share + deviation), int(max(0, WIDE * share - deviation))

    def prints(batches):
        for batch in batches:
            fps = np.array([wide_fingerprint(np.unique(shingle_hashes(t, n))) for t in texts(batch.column(text))], np.uint64).reshape(batch.num_rows, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), batch.column("tag"), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(names)))], names=["id", "tag", *names])

    keyed = keyed_rows(df.select(id_col, text), text)
    rows = stored(by_batch(keyed.select(id_col, "tag", text), "id long, tag long, " + ", ".join(f"{c} long" for c in names), prints), "wide-prints")
    nodes = rows.groupBy(*names).agg(F.coalesce(F.min("id"), F.min("tag")).alias("node"))
    nodes = stored(nodes, "wide-nodes")
    count = max(2, nodes.count())
    bits = int(np.clip(np.ceil(np.log2(count / BY_CHANCE)), 8, 48))
    tables = int(np.ceil(np.log(MISS) / np.log1p(-((1 - share) ** bits))))
    while chance_of_loss(share, radius, bits, tables) > MISS:
        tables += 1
    chosen = [np.random.default_rng([t, WIDE]).permutation(WIDE) for t in range(tables)]

    def keys_of(words: np.ndarray, t: int, k: int) -> np.ndarray:
        b = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, chosen[t][:k]]
        wide = np.packbits(b, axis=1, bitorder="little")
        out = np.full(len(words), t, np.uint64)
        padded = np.zeros((len(words), -(-wide.shape[1] // 8) * 8), np.uint8)
        padded[:, : wide.shape[1]] = wide
        for w in padded.view(np.uint64).T:
            out = _mixed(out * _GOLD + w)
        return out.view(np.int64)

    schema = "key long, t int, node long, " + ", ".join(f"{c} long" for c in names)

    def tabled(level: int, only_table: bool):
        def body(batches):
            for batch in batches:
                words = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
                node = batch.column("node").to_numpy()
                per_row = batch.column("t").to_numpy() if only_table else None
                for t in range(tables) if len(node) else ():
                    w = words[per_row == t] if only_table else words
                    if not len(w):
                        continue
                    i = node[per_row == t] if only_table else node
                    yield pa.RecordBatch.from_arrays([pa.array(keys_of(w, t, bits + 8 * level)), pa.array(np.full(len(w), t, np.int32)), pa.array(i), *(pa.array(np.ascontiguousarray(w[:, c]).view(np.int64)) for c in range(len(names)))], names=["key", "t", "node", *names])

        return body

    at = by_batch(nodes, schema, tabled(0, False))
    done: DataFrame | None = None
    for level in range(1, MAX_SPLITS + 1):
        large = at.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key").checkpoint()
        if large.isEmpty():
            break
        large = small_side(large)
        small = at.join(large, "key", "left_anti").select("key", "t", "node", *names)
        done = small if done is None else done.union(small)
        at = stored(by_batch(at.join(large, "key", "left_semi").select("t", "node", *names), schema, tabled(level, True)), "split-blocks")
    made = (at if done is None else done.union(at)).repartition("key").sortWithinPartitions("key")

    def body(batches):
        held: pd.DataFrame | None = None

        def linked(rows: pd.DataFrame) -> pa.RecordBatch:
            words = rows[names].to_numpy(np.int64).view(np.uint64)
            group = np.cumsum(rows["key"].diff().ne(0).to_numpy())
            a, b, far = _near_pairs(words, group, radius)
            order = np.argsort(far, kind="stable")
            a, b, far = a[order], b[order], far[order]
            kept = _forest(a, b)
            distance = dict(zip(zip(a.tolist(), b.tolist(), strict=True), far.tolist(), strict=True))
            pairs = np.array(kept, np.int64).reshape(-1, 2)
            node = rows["node"].to_numpy(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]]), pa.array([distance[x] for x in kept], pa.int32())], names=["u", "v", "far"])

        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = (rows["key"] == rows["key"].iloc[-1]).to_numpy()
            held = rows[last]
            if not last.all():
                yield linked(rows[~last].reset_index(drop=True))
        if held is not None:
            yield linked(held.reset_index(drop=True))

    found = by_batch(made.select("key", "node", *names), "u long, v long, far int", body)
    edges = stored(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "far").where("u <> v").distinct(), "near-links")

    def sets(batches):
        for batch in batches:
            some = [np.unique(shingle_hashes(t, n)).view(np.int64) for t in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("tag"), pa.array(some, pa.list_(pa.int64()))], names=["node", "tag", "hashes"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (u, v and other longs) whose texts have the similarity.

        Nodes fall into buckets. The pairs of two buckets are checked together, where the shingles of each node come
        once for all of its pairs there.
        """
        ends = small_side(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct())
        # One text stands for a node: the one of its least id, or of its least hash where ids are null.
        by_key = keyed.select(F.coalesce(F.col(id_col).cast("long"), F.col("tag")).alias("node"), "tag", text).join(ends, "node", "left_semi")
        shingles = stored(by_batch(by_key, "node long, tag long, hashes array<long>", sets).dropDuplicates(["node"]), "shingles", compression="zstd")
        size = shingles.agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("hashes")).first()
        n_buckets = max(1, size["n"] // BUCKET_NODES + 1, 8 * (size["hashes"] or 0) // BUCKET_BYTES + 1)
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(n_buckets))
        celled = pairs.select(F.least(bucket("u"), bucket("v")).alias("a"), F.greatest(bucket("u"), bucket("v")).alias("b"), *pairs.columns)
        needed = celled.select("a", "b", F.col("u").alias("node")).union(celled.select("a", "b", F.col("v").alias("node"))).distinct()
        others = [F.lit(None).cast("long").alias(c) for c in pairs.columns]
        brought = needed.join(shingles.select("node", "hashes"), "node").select("a", "b", "node", "hashes", *others)
        asked = celled.select("a", "b", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<long>").alias("hashes"), *pairs.columns)

        def check(batches):
            cell, known = None, {}
            for batch in batches:
                cells = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
                nodes, us, vs = (batch.column(c).to_pylist() for c in ("node", "u", "v"))
                hashes = batch.column("hashes")
                good = []
                for i, here in enumerate(cells):
                    if here != cell:
                        cell, known = here, {}
                    if nodes[i] is not None:
                        known[nodes[i]] = hashes[i].values.to_numpy().view(np.uint64)
                        continue
                    x, y = sorted((known.get(us[i], ()), known.get(vs[i], ())), key=len)
                    if len(x) and len(x) >= similarity * len(y):
                        common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                        if common >= similarity * (len(x) + len(y) - common):
                            good.append(i)
                yield batch.take(pa.array(good, pa.int64())).select(pairs_columns)

        pairs_columns = pairs.columns
        both = brought.union(asked).repartition("a", "b").sortWithinPartitions("a", "b", F.col("node").isNull())
        return by_batch(both, ", ".join(f"{c} long" for c in pairs.columns), check)

    roots = components(edges.where(F.col("far") <= sure).select("u", "v").union(verified(edges.where(F.col("far") > sure).select("u", "v"))))
    named = stored(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *names), "wide-groups")
    carried = ["node", "root", *names]

    def rekeyed(batches):
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            for t in range(tables) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(words, t, bits)), pa.array(np.full(batch.num_rows, t)), *(batch.column(c) for c in carried)], names=["key", "t", *carried])

    made = pieces(by_batch(named, "key long, t long, node long, root long, " + ", ".join(f"{c} long" for c in names), rekeyed))
    made = made.repartition("key").sortWithinPartitions("key")

    masks = np.zeros((tables, WIDE // 64), np.uint64)
    for t, places in enumerate(chosen):
        masks[t] = np.packbits(np.isin(np.arange(WIDE), places[:bits]), bitorder="little").view(np.uint64)

    def crossed(rows: pd.DataFrame) -> pa.RecordBatch:
        """A pair is told of in the first table that it shares a block of."""
        words = rows[names].to_numpy(np.int64).view(np.uint64)
        node, root, side = (rows[c].to_numpy(np.int64) for c in ("node", "root", "side"))
        a, b, far = _near_pairs(words, np.cumsum(rows["key"].diff().ne(0).to_numpy()), radius, lambda x, y: (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 0)))
        table = rows["t"].to_numpy(np.int64)[a]
        differ = words[a] ^ words[b]
        new = np.ones(len(a), bool)
        for t in range(int(table.max(initial=0))):
            new &= (table <= t) | (differ & masks[t]).any(axis=1)
        a, b, far = a[new], b[new], far[new]
        near = far <= sure
        ru, rv = np.array(_forest(root[a[near]], root[b[near]]), np.int64).reshape(-1, 2).T
        # Every pair in doubt stays: one that fails must not stand for one that holds.
        a, b = a[~near], b[~near]
        both = [(ru, node[a]), (rv, node[b]), (ru, root[a]), (rv, root[b]), (np.ones(len(ru), bool), np.zeros(len(a), bool))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in both], names=["u", "v", "ru", "rv", "sure"])

    def crossing(batches):
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            starts = np.flatnonzero(rows["key"].diff().ne(0).to_numpy())
            # Some whole blocks at a time, as each can give many pairs.
            begin = 0
            for i, stop in enumerate(starts[1:].tolist(), 1):
                if i == len(starts) - 1 or starts[i + 1] - begin > 4 * BLOCK_ROWS:
                    yield crossed(rows.iloc[begin:stop].reset_index(drop=True))
                    begin = stop
            held = rows.iloc[begin:].reset_index(drop=True)
        if held is not None:
            yield crossed(held)

    found = by_batch(made.select("key", "t", "side", "node", "root", *names), "u long, v long, ru long, rv long, sure boolean", crossing)
    more = stored(found.distinct(), "cross-links")
    joined = components(more.where("sure").select("ru", "rv").union(verified(more.where("NOT sure").select("u", "v", "ru", "rv")).select("ru", "rv")).toDF("u", "v"))
    named = named.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select(*names, F.coalesce("least", "root").alias("group_id"))
    return rows.join(named, names).groupBy("id", "tag", "group_id").agg(F.count("*").alias("n_rows"))


def near_groups(df: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``group_id``: the least id of the rows that a chain of pairs joins whose shingle sets have this Jaccard similarity.

    Copies (equal fingerprints) always join. Texts that are null or have no words form one group. Ids are integers; rows
    with a null id get a hash of their text as group when nothing smaller is joined to them. A column named group_id is
    replaced.
    """
    base = df.drop("group_id")
    keyed = base.select(packed(base), F.col(id_col).alias("key"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("of"))
    labels = near_labels(base.select(id_col, text), similarity, n, text, id_col).select("id", "tag", "group_id")
    out = keyed.join(labels, F.col("key").eqNullSafe(F.col("id")) & (F.col("of") == F.col("tag")), "left")
    return out.select("row.*", "group_id")


def near_distinct(df: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of ``df`` for each group of near copies: the one of the least id (null ids last), of the least text hash among those.

    Groups are settled on labels alone; the texts then meet their keys in one join.
    """
    labels = stored(near_labels(df.select(id_col, text), similarity, n, text, id_col), "near-labels")
    first = labels.groupBy("group_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("k"))
    keep = first.select(F.col("k.none").alias("none"), F.coalesce("k.id", F.lit(0)).alias("id"), F.col("k.tag").alias("tag"))
    key = F.col(id_col).cast("long")
    out = df.select(packed(df), key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    out = out.join(keep, ["none", "id", "tag"], "left_semi")
    if not labels.where("n_rows > 1").isEmpty():
        out = out.dropDuplicates(["none", "id", "tag"])
    return out.select("row.*")


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fingerprint(read(spark, sf_dir, "documents").select("doc_id", "text"), n=3)
    return classes(docs, radius=2).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
