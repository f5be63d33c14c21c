"""Benchmark decontamination by template canonicalisation.

Texts are turned into templates: numbers, units after numbers and names become typed placeholders, other words are
lower-cased and stripped of punctuation. Windows of a fixed number of template tokens are joined by hash with those of
the benchmark. A match counts if the slots agree: along one alignment of a document with an item, every value of the
item is replaced by one value everywhere, and different values by different ones; windows with the item's own values
always count. A question with other numbers or names in it is thus found, while a text that merely has the same shape
with unrelated values is not.

A capitalised word that opens a line or sentence may be a name or not. Items are hashed in all such readings; documents
in three: openers are words, are names, or are names unless they are common words.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import gram_hashes
from .common import by_batch, packed, read, stored

WINDOW = 13
#: Items shorter than a window are matched as a whole; those of fewer tokens than this in their own values only.
WITHIN = 4
#: A benchmark window stands for others with new values if this share and number of its tokens are words ...
LITERAL, LEAST_WORDS = 0.5, 4
#: ... or if so many are, of which so many are not common. Other windows, mostly slots, must agree in all values.
FEW_WORDS, UNCOMMON = 3, 2
#: What a benchmark window proves: with new values; with its own in any text; with its own in a text that has no other words.
ANEW, OWN, ALONE = 2, 1, 0
#: A window with more openers is hashed in two readings only: all words, all names.
OPENERS = 8
#: Most windows of the benchmark whose hashes are handed to every task (8 bytes each); beyond, a bitmap of FILTER_BITS bits is.
MAX_FILTER, FILTER_BITS = 2_000_000, 1 << 27
VOCABULARY = 400_000
#: Words that count as units after a number.
UNITS = frozenset(
    """mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound
    pounds oz ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h
    hr hour hours day days week weeks month months year years percent dollars dollar euro euros cents cent usd eur degrees
    degree celsius fahrenheit mph kmh km/h watts watt volts volt""".encode().split()
)
#: Common words that often open a sentence.
COMMON = frozenset(
    """a after all also an and another any are as assume at be because before both but by calculate can compute consider
    could determine did do does during each either every explain few find first for from given has have he her here his how if
    in into is it its last let many more most much my no not now of on one only or other our she should show since so some
    solve state such suppose than that the their then there these they this those though three to two until we were what
    when where which while who whose why will with would write you your""".encode().split()
)
_NUMBER = re.compile(rb"[^\w]*[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?(%|[a-z]{1,3})?[^\w]*$")
_EDGE = bytes(b for b in range(33, 128) if not chr(b).isalnum())
#: Signs that count as words between two numbers.
OPERATORS = frozenset("+ - * / = < > ^ × ÷ − · ≤ ≥ ≠ ±".encode().split())
WORD, NUMBER, NAME, UNIT = range(4)
_SLOT_HASH = np.array([0, *(xxhash.xxh64_intdigest(b"<slot>" + bytes([k])) for k in (NUMBER, NAME, UNIT))], np.uint64)


class Canon(dict):
    """Word -> row of its properties: hash as a literal; bits: number, may be a name, unit, ends a sentence, bare punctuation, common, operator."""

    def __init__(self, most: int = VOCABULARY):
        super().__init__()
        self.most = most
        self.hash, self.props = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint8)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.hash):
            self.hash, self.props = np.resize(self.hash, 2 * k), np.resize(self.props, 2 * k)
        core = word.strip(_EDGE)
        lower = core.decode("utf-8", "replace").lower().encode()
        number = bool(_NUMBER.match(word))
        name = not number and len(lower) > 1 and core[:1].isupper() and core[1:].decode("utf-8", "replace").islower()
        self.hash[k] = xxhash.xxh64_intdigest(lower or word)
        ends = word.rstrip(b"\"')]")[-1:] in b".!?:"
        self.props[k] = number | name << 1 | (lower in UNITS) << 2 | ends << 3 | (not core) << 4 | (lower in COMMON) << 5 | (word in OPERATORS) << 6
        self[word] = k
        return k

    def __call__(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words that count, their kinds if openers are words, which are openers, which words are common, literal hashes."""
        if len(self) > self.most:
            self.clear()
        words = text.split()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        props = self.props[rows]
        keep = props & 16 == 0
        signs = np.flatnonzero(props & 64 > 0)
        if len(signs):
            number = np.pad(props & 1 > 0, 1)  # of the word before i at i, of the one after it at i + 2
            keep[signs] = number[signs] & number[signs + 2]
        if not keep.all():
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            rows, props = rows[keep], props[keep]
        before = np.concatenate((np.array([8], np.uint8), props[:-1])) if len(props) else props
        kinds = np.zeros(len(props), np.int64)
        named = props & 2 > 0
        kinds[named & (before & 8 == 0)] = NAME
        kinds[(props & 4 > 0) & (before & 1 > 0)] = UNIT
        kinds[props & 1 > 0] = NUMBER
        opens = named & (before & 8 > 0) & (kinds == WORD)
        return words, kinds, opens, props & 32 > 0, self.hash[rows]


def _hashes(kinds: np.ndarray, literal: np.ndarray) -> np.ndarray:
    return np.where(kinds == WORD, literal, _SLOT_HASH[kinds])


_ROWS = "id long, at int, size int, h long, readings int, proof int, template string, slots array<struct<place:int,kind:int,value:string>>"


def _described(words: list[bytes], kinds: np.ndarray, at: int, size: int) -> tuple[str, list[dict]]:
    """The template of one window in full, and the values in its slots with their places in the text."""
    plain = [(w.strip(_EDGE) or w).decode("utf-8", "replace").lower() for w in words[at : at + size]]
    ks = kinds[at : at + size].tolist()
    template = " ".join(w if k == WORD else f"<{k}>" for w, k in zip(plain, ks, strict=True))
    return template, [{"place": at + i, "kind": k, "value": w} for i, (w, k) in enumerate(zip(plain, ks, strict=True)) if k != WORD]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 8
    slots = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.int32()), ("value", pa.string())]))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), slots]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "at", "size", "h", "readings", "proof", "template", "slots"])


def _proof(kinds: np.ndarray, common: np.ndarray) -> int:
    """What a window of these kinds proves. Names count as words where nothing matches but the window's own values."""
    size, plain = len(kinds), kinds == WORD
    if size < WITHIN:
        return OWN if np.count_nonzero((plain | (kinds == NAME)) & ~common) >= UNCOMMON else ALONE
    n, rare = np.count_nonzero(plain), np.count_nonzero(plain & ~common)
    return ANEW if n >= max(LITERAL * size, LEAST_WORDS) or n >= FEW_WORDS and rare >= UNCOMMON else OWN


def item_windows(df: DataFrame) -> DataFrame:
    """(id, text) -> rows of _ROWS: all windows of WINDOW tokens, or the whole of a shorter text, in all readings of their openers."""

    def body(batches):
        canon = Canon()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words, kinds, opens, common, literal = canon(text or b"")
                size = min(WINDOW, len(words))
                for at in range(len(words) - size + 1 if words else 0):
                    places = np.flatnonzero(opens[at : at + size]) + at
                    few = len(places) <= OPENERS
                    for names in product((False, True), repeat=len(places)) if few else ((False,) * len(places), (True,) * len(places)):
                        read_as = kinds.copy()
                        read_as[places[np.array(names, bool)]] = NAME
                        h = gram_hashes(_hashes(read_as[at : at + size], literal[at : at + size]), size)
                        template, slots = _described(words, read_as, at, size)
                        out.append((i, at, size, int(h.view(np.int64)[0]), 0, _proof(read_as[at : at + size], common[at : at + size]), template, slots))
            yield _batch(out)

    return by_batch(df, _ROWS, body)


def text_windows(df: DataFrame, sizes: tuple[int, ...], wanted: np.ndarray | None, bitmap: np.ndarray) -> DataFrame:
    """(id, text) -> rows of _ROWS: windows of each size whose hash is in ``bitmap`` (packed, by its low bits) and ``wanted`` (sorted; None: any).

    readings: bits for openers as names unless common (1), as words (2), as names (4). proof: 1 if the window is the whole text.
    """
    low = np.uint64(8 * len(bitmap) - 1)

    def hits(h: np.ndarray, among: np.ndarray | None) -> np.ndarray:
        slot = (h & low).astype(np.int64)
        near = bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
        found = np.flatnonzero(near if among is None else near & among)
        if wanted is None or not len(found):
            return found
        place = np.minimum(np.searchsorted(wanted, h[found]), len(wanted) - 1)
        return found[wanted[place] == h[found]]

    def holding(marked: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marked)))
        return total[size:] > total[:-size]

    def body(batches):
        canon = Canon()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words, kinds, opens, common, literal = canon(text or b"")
                common = opens & common
                as_words, as_names = kinds, np.where(opens, NAME, kinds)
                mixed = np.where(common, WORD, as_names)
                hashes = [_hashes(k, literal) for k in (mixed, as_words, as_names)]
                for size in sizes:
                    if len(words) < size:
                        continue
                    # Windows whose reading differs from the first one.
                    differ = [None, holding(opens & ~common, size), holding(common, size)]
                    for r, read_as in enumerate((mixed, as_words, as_names)):
                        if r and not differ[r].any():
                            continue
                        h = gram_hashes(hashes[r], size)
                        for at in hits(h, differ[r]).tolist():
                            readings = 1 << r if r else 1 | (not differ[1][at]) << 1 | (not differ[2][at]) << 2
                            template, slots = _described(words, read_as, at, size)
                            out.append((i, at, size, int(h[at].view(np.int64)), readings, int(len(words) == size), template, slots))
            yield _batch(out)

    return by_batch(df, _ROWS, body)


def hash_filter(known: DataFrame) -> tuple[np.ndarray | None, np.ndarray]:
    """(h) distinct -> the sorted hashes, if few enough, and a bitmap of their low bits, of at most FILTER_BITS bits."""
    n = known.count()
    if n <= MAX_FILTER:
        wanted = np.sort(known.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        flags = np.zeros(min(FILTER_BITS, 1 << 20), bool)
        flags[(wanted & np.uint64(len(flags) - 1)).astype(np.int64)] = True
        return wanted, np.packbits(flags, bitorder="little")
    low = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    by_byte = known.groupBy(F.shiftright(low, 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(h & 7 AS INT))")).alias("bits"))
    rows = by_byte.toPandas()  # FILTER_BITS / 8 rows at the most
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint8)
    return None, bitmap


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> doc_id, item_id, n_windows, n_slots of the best alignment that agrees.

    A document is contaminated by an item if it has one row here. Items shorter than a window are matched as a whole, those
    of fewer than WITHIN tokens in their own values, and with under UNCOMMON words that are not common by texts that are the item
    and nothing else. Windows with too few words (see LITERAL, FEW_WORDS) match in their own values only. Null ids and texts match nothing, nor do texts without words. Repeated items give a row each;
    documents that repeat an id count as one. Texts may be of any length.
    """
    cleaned = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("id"), "text")
    bench = stored(item_windows(cleaned).distinct(), "benchmark")
    used = tuple(sorted(r["size"] for r in bench.select("size").distinct().collect()))  # at most WINDOW
    wanted, bitmap = hash_filter(bench.select("h").distinct())
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = text_windows(texts, used, wanted, bitmap).withColumnRenamed("proof", "alone")
    b = bench.select("h", "size", "template", "proof", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    hit = found.withColumnRenamed("id", "doc_id").join(b, ["h", "size", "template"])
    own = F.coalesce(F.col("slots")["value"] == F.col("item_slots")["value"], F.lit(False))
    thin = F.col("proof") < ANEW
    hit = hit.where((F.col("proof") >= OWN) | (F.col("alone") > 0)).select("doc_id", "item_id", "at", (F.col("at") - F.col("item_at")).alias("shift"), "readings", own.alias("own"), thin.alias("thin"), "slots", "item_slots").where("own OR NOT thin")
    hit = stored(hit, "matches")
    bits = F.filter(F.array(*map(F.lit, (1, 2, 4))), lambda r: F.col("readings").bitwiseAND(r) > 0)
    hit = hit.withColumn("reading", F.explode(bits))
    keys = ["doc_id", "item_id", "shift", "reading"]
    pairs = hit.where("NOT thin").select(*keys, F.explode(F.arrays_zip("slots", "item_slots")).alias("s")).select(
        *keys, F.col("s.item_slots.place").alias("place"), F.col("s.slots.kind").alias("kind"), F.col("s.slots.value").alias("value"), F.col("s.item_slots.value").alias("item_value")
    ).distinct()
    by_item = pairs.groupBy(*keys, "kind", "item_value").agg(F.count_distinct("value").alias("n"))
    by_value = pairs.groupBy(*keys, "kind", "value").agg(F.count_distinct("item_value").alias("n"))
    torn = by_item.select(*keys, "n").union(by_value.select(*keys, "n")).where("n > 1").select(*keys).distinct().withColumn("torn", F.lit(True))
    slots = pairs.groupBy(*keys).agg(F.count_distinct("place").alias("n_slots"))
    good = hit.join(torn, keys, "left").where("own OR torn IS NULL").groupBy(*keys).agg(F.count_distinct("at").alias("n_windows"))
    good = good.join(slots, keys, "left").fillna(0, ["n_slots"])
    best = F.max_by(F.struct("n_windows", "n_slots"), F.struct("n_windows", -F.abs("shift"), "shift", "n_slots"))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_windows", "b.n_slots")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id has a match; rows with a null id stay. All columns pass through."""
    found = matches(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("id")).distinct()
    return docs.select(packed(docs), F.col("doc_id").cast("long").alias("id")).join(found, "id", "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
