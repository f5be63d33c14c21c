"""Training-order materialisation of token ids.

Documents are tokenised in the order in which Spark reads them, each followed by an end token, and the stream is cut
into sequences of a fixed number of tokens. A keyed Feistel network permutes the sequence numbers; numbers beyond the
last sequence are permuted again until they fall inside (cycle-walking), so every sequence has one global slot, known
without a sort. Ranges of slots are shards: binary files of fixed-stride records, read from any slot on by a seek.

A shard is written under a temporary name by one task and then moved, so that repeated tasks leave one whole file.
"""

from __future__ import annotations

import json
import struct
import uuid
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
import xxhash
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import RankQueueBpe, default_vocabulary, load_ranks, ship
from .common import by_batch, read, shared_dir, stored

SEQUENCE, SHARD_ROWS, ROUNDS = 2048, 2048, 6
_MASK = (1 << 64) - 1
_PLACE = np.dtype([("none", "?"), ("doc", "<i8"), ("sequence", "<i8"), ("slot", "<i8"), ("start", "<i4"), ("n", "<i4")])


class FastCoder(RankQueueBpe):
    """Parts of a text between spaces are looked up as a whole; what is not yet known goes to the tiktoken library."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _spaced(self, word: str) -> bytes:
        return self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        ids = self.library.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _coder(name: str, pattern: str) -> FastCoder:
    return FastCoder(load_ranks(SparkFiles.get(name)), pattern)


def permute(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """A permutation of 0..count-1, chosen by ``key``, at the places ``numbers``."""
    if count <= 1:
        return numbers.astype(np.int64)
    half = max(1, (int(count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(xxhash.xxh64_intdigest(struct.pack("<QI", key & _MASK, r))) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(count))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _planes(ids: bytes, width: int) -> bytes:
    """The bytes of ids by their place in the id: all first ones, then all second ones, and so on. Compresses better."""
    return np.frombuffer(ids, np.uint8).reshape(-1, width).T.tobytes()


def _ids(planes: bytes, width: int) -> bytes:
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.tobytes()


def _kind(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def materialise(docs: DataFrame, out: str, vocabulary: str, pattern: str, key: int = 0, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes the shards of (doc_id, text) to the folder ``out`` (a URI all executors reach) and returns where each document went.

    Rows: doc_id, sequence, slot, shard, start (token within the sequence), n_tokens; a document has one row for
    each sequence that holds part of it, its end token included. Null texts count as empty and give an end token alone.
    Repeated rows are written as often as they occur. No rows give no shards. The end token is the first id that the
    vocabulary leaves free; it also fills the last sequence. Ids take two bytes if they fit, else four. The order before
    the permutation is that of the input's partitions, and so is fixed for a fixed input layout. Very long texts go on over as
    many sequences as they need, with a row for each; a text and its ids are one value of a row, hence below 2 GB.
    doc_id is cast to long, so ids that are no numbers fail. Other columns are ignored.
    """
    spark = docs.sparkSession
    name = ship(spark, vocabulary)
    end = max(load_ranks(vocabulary).values()) + 1
    kind = _kind(end)
    width = np.dtype(kind).itemsize

    def tokenise(batches):
        coder, task, at = _coder(name, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.append(np.frombuffer(coder.encode(x or ""), "<u4"), end).astype(kind).tobytes() for x in batch.column("text").to_pylist()]
            n = [len(x) // width for x in ids]
            places = [*accumulate(n, initial=at)]
            at = places.pop()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "task", "at", "n", "ids"])

    tokens = stored(by_batch(docs.select("doc_id", "text"), "doc_id long, task int, at long, n long, ids binary", tokenise), "tokens", compression="zstd", **{"parquet.compression.codec.zstd.level": "6"})
    # One row for each input partition; the driver plans those one by one anyway.
    sizes = sorted((r["task"], r["n"]) for r in tokens.groupBy("task").agg(F.sum("n").alias("n")).collect())
    base = dict(zip((t for t, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    total = sum(n for _, n in sizes)
    count = -(-total // sequence)

    def pieces(batches):
        """For each batch and shard one compressed blob: what goes where, then the ids."""
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            rows: list[tuple] = []
            for d, t, a, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "task", "at", "ids")), strict=True):
                at, done, n = base[t] + a, 0, len(ids) // width
                while done < n:
                    s, start = divmod(at + done, sequence)
                    take = min(n - done, sequence - start)
                    rows.append((d is None, d or 0, s, 0, start, take, ids[done * width : (done + take) * width]))
                    done += take
            meta = np.array([r[:6] for r in rows], _PLACE)
            meta["slot"] = permute(meta["sequence"], count, key)
            shard = meta["slot"] // shard_rows
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            made = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some = order[i:j]
                made.append((int(shard[some[0]]), j - i, press(meta[some].tobytes() + _planes(b"".join(rows[k][6] for k in some.tolist()), width))))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())], names=["shard", "n", "blob"])

    def write(batches):
        """Blobs sorted by shard: one shard is put together in memory at a time."""
        fs, folder = pyarrow.fs.FileSystem.from_uri(out)
        unpress = zstandard.ZstdDecompressor().decompress
        now, body = None, None

        def close():
            if body is None:
                return
            temporary, final = f"{folder}/.{now:08d}-{uuid.uuid4().hex}", f"{folder}/shard-{now:08d}.bin"
            with fs.open_output_stream(temporary) as f:
                f.write(body.tobytes())
            if fs.get_file_info(final).type != pyarrow.fs.FileType.NotFound:  # of a task that was lost after its move
                fs.delete_file(final)
            fs.move(temporary, final)

        for batch in batches:
            for shard, n, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "blob")), strict=True):
                if shard != now:
                    close()
                    now, body = shard, np.full(min(shard_rows, count - shard * shard_rows) * sequence, end, kind)
                data = unpress(blob)
                meta = np.frombuffer(data, _PLACE, n)
                ids = np.frombuffer(_ids(data[n * _PLACE.itemsize :], width), kind)
                at = (meta["slot"] - shard * shard_rows) * sequence + meta["start"]
                for a, b, c in zip(at.tolist(), np.cumsum(meta["n"]).tolist(), meta["n"].tolist(), strict=True):
                    body[a : a + c] = ids[b - c : b]
                doc = pa.array(meta["doc"].astype(np.int64), mask=meta["none"].astype(bool))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(meta[c].astype(t)) for c, t in (("sequence", np.int64), ("slot", np.int64))), pa.array(np.full(n, shard, np.int64)), pa.array(meta["start"].astype(np.int32)), pa.array(meta["n"].astype(np.int32))], names=["doc_id", "sequence", "slot", "shard", "start", "n_tokens"])
        close()

    fs, folder = pyarrow.fs.FileSystem.from_uri(out)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/meta.json") as f:
        f.write(json.dumps({"sequences": count, "tokens": total, "sequence": sequence, "shard_rows": shard_rows, "dtype": kind, "end": end, "key": key}).encode())
    schema = "doc_id long, sequence long, slot long, shard long, start int, n_tokens int"
    cut = by_batch(tokens, "shard long, n int, blob binary", pieces)
    shards = max(1, -(-count // shard_rows))
    dealt = cut.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard")
    return stored(by_batch(dealt, schema, write), "places")


def read_slots(out: str, first: int = 0, count: int | None = None):
    """Yields (slot, array of tokens) in training order from slot ``first`` on: resumes anywhere by one seek."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{folder}/meta.json") as f:
        meta = json.loads(f.read())
    stride = meta["sequence"] * np.dtype(meta["dtype"]).itemsize
    last = meta["sequences"] if count is None else min(meta["sequences"], first + count)
    while first < last:
        shard, row = divmod(first, meta["shard_rows"])
        with fs.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            f.seek(row * stride)
            for slot in range(first, min(last, (shard + 1) * meta["shard_rows"])):
                yield slot, np.frombuffer(f.read(stride), meta["dtype"])
        first = (shard + 1) * meta["shard_rows"]


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return materialise(read(spark, sf_dir, "documents").select("doc_id", "text"), out, *default_vocabulary(), key=2024)


QUERIES = {"op9_token_shards": op9_token_shards}
ORACLE_SQL: dict[str, str] = {}
