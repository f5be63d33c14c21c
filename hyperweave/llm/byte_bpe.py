"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of bytes. Each adjacent pair that the vocabulary knows has a rank; the bucket of a
rank holds the list positions where such a pair starts. A two-level bitmap says which buckets hold anything: a summary
integer has one bit for each word of 256 ranks, and find-first-set on summary and word gives the lowest rank in constant
time. Positions whose pair has changed since they were put in are stale and skipped. A pre-token of n bytes thus takes
n insertions and removals, however long it is, where the plain search for the lowest pair takes n squared.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

#: Fixed value: the pattern under which a space between two non-spaces always starts a pre-token.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = 8  # bits of a rank that pick a bit within a bitmap word
#: A space with white space on both sides: only there does cutting at spaces differ from the pattern.
_INNER_SPACE = re.compile(r"\s \s")


class _Cache(dict):
    """Computes what is missing, in two generations: when the young one is full it becomes the old one, from which what
    is asked for again comes back. Frequent keys stay, and memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 48:
            self[key] = value
        return value


@lru_cache(maxsize=4)
def stand_ins(pattern: str) -> dict[int, int]:
    """Code points that a class of ``pattern`` holds here but not in the tiktoken library, or the other way round, each with one
    that both put where the library puts it. The two are built on different versions of Unicode, so the library itself is
    asked: under a class as its pattern it gives back the members alone.
    """
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = np.zeros((2, 0x110000), np.int64)
    for k, name in enumerate(sorted(set(re.findall(r"\\[pP]\{\w+\}|\\[swdSWD]", pattern)))):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        for held, found in ((theirs, bytes(library.encode_ordinary(points)).decode()), (ours, "".join(regex.findall(name, points)))):
            held[np.frombuffer(found.encode("utf-32-le"), "<u4")] |= 1 << k
    agreed = np.flatnonzero(theirs == ours)
    agreed = agreed[(agreed >= 0x250) & ~((agreed >= 0xD800) & (agreed < 0xE000))]  # beyond the letters that patterns spell out
    first = dict(zip(*(x.tolist() for x in np.unique(theirs[agreed], return_index=True)), strict=True))
    return {c: int(agreed[first[int(theirs[c])]]) for c in np.flatnonzero(theirs != ours).tolist()}


class RankQueueBpe:
    """Encoder and decoder for a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 450_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.n_words = (max(ranks.values()) >> WORD) + 1
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.pieces = _Cache(lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes(), cache)
        self.spaced = _Cache(self._spaced, cache)
        self.cuts_at_spaces = pattern == SPACED_PATTERN

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token: lowest rank first, leftmost first among equals."""
        get, n, longest = self.ranks.get, len(piece), self.longest
        if (whole := get(piece)) is not None:
            return [whole]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # the rank of the pair that starts here now; -1: none
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        words = [0] * self.n_words
        summary = 0
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> WORD
                    words[w] |= 1 << (r & 255)
                    summary |= 1 << w
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = w << WORD | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            at = heapq.heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    summary &= summary - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[gone]
            after[at] = end
            pair[gone] = pair[at] = -1
            if end < n:
                before[end] = at
                stop = after[end]
                r = get(piece[at:stop]) if stop - at <= longest else None
                if r is not None:
                    pair[at] = r
                    if r in buckets:
                        heapq.heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        w = r >> WORD
                        words[w] |= 1 << (r & 255)
                        summary |= 1 << w
            if (left := before[at]) >= 0:
                pair[left] = -1
                r = get(piece[left:end]) if end - left <= longest else None
                if r is not None:
                    pair[left] = r
                    if r in buckets:
                        heapq.heappush(buckets[r], left)
                    else:
                        buckets[r] = [left]
                        w = r >> WORD
                        words[w] |= 1 << (r & 255)
                        summary |= 1 << w
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    @cached_property
    def odd(self) -> frozenset[str]:
        return frozenset(map(chr, stand_ins(self.pattern.pattern)))

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, by the Unicode tables of the tiktoken library."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        read_as = text.translate(stand_ins(self.pattern.pattern))
        return [text[slice(*m.span())] for m in self.pattern.finditer(read_as)]

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and a word; of ASCII letters alone it is one pre-token."""
        return self.pieces[" " + word] if word.isascii() and word.isalpha() else self._cut(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Under SPACED_PATTERN every space between two non-spaces starts a pre-token, so the text may be cut there and each
        part be looked up as a whole; where white space surrounds a space, and for any other pattern, the pattern itself
        goes over the text.
        """
        if not self.cuts_at_spaces or _INNER_SPACE.search(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return (self._cut(first) if first else b"") + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4")
        if len(found) and int(found.max()) >= len(self.tokens):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(map(self.tokens.__getitem__, found.tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _coder(name: str, pattern: str) -> RankQueueBpe:
    return RankQueueBpe(load_ranks(SparkFiles.get(name)), pattern)


def ship(spark: SparkSession, path: str) -> str:
    """Hand a vocabulary file of the driver to every executor, later ones included; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column ``ids``: the tokens of ``text``, four bytes each, little-endian.

    vocabulary: path of a rank file on the driver. Null texts count as empty and give zero tokens. A column named
    ``ids`` is replaced. Texts are encoded whole; each row needs memory for its own text and ids only.
    """
    spark = df.sparkSession
    small_batches(spark)
    name = ship(spark, vocabulary)

    @F.arrow_udf("binary")
    def coded(column: pa.Array) -> pa.Array:
        coder = _coder(name, pattern)
        return pa.array([coder.encode(x or "") for x in column.to_pylist()], pa.binary())

    return df.withColumn(ids, coded(F.col(text)))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that ``ids`` stand for. Null ids count as empty; unknown ids raise."""
    spark = df.sparkSession
    small_batches(spark)
    name = ship(spark, vocabulary)

    @F.arrow_udf("binary")
    def back(column: pa.Array) -> pa.Array:
        coder = _coder(name, pattern)
        return pa.array([coder.decode(x or b"") for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, back(F.col(ids)))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens and the digests of ids and decoded bytes of each row of (doc_id, text)."""
    coded = decode(encode(df.select("doc_id", "text"), vocabulary, pattern), vocabulary, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), *default_vocabulary())


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
