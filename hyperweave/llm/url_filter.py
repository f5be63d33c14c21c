"""URL rules in a sorted digest array.

The rules become one file: sorted 64-bit xxhash keys, then the offsets and bytes of the full rule strings. Executors
memory-map it, look for the keys of a batch of URLs by one vectorised binary search, and compare the stored string of
every hit, so that a digest collision never decides. A URL has one key for each domain suffix of its host and each
path length that the rules have, whatever their number.
"""

from __future__ import annotations

import atexit
import os
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, read

#: Most rules that are shipped to every executor (about 100 MB of keys and strings); larger sets are joined by digest.
MAX_SHIPPED = 1_000_000
MAGIC = b"DGA1"

#: The rules of the contract, as (verdict, host and path).
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def _key(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def write_digest_array(rules: list[tuple[str, str]], path: str) -> None:
    """rules: (verdict, rule). Of a rule given twice, ``block`` stays. Stored as ``b`` or ``a`` + rule."""
    kept: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("block", "allow"):
            raise ValueError(f"unknown verdict {verdict!r}")
        if kept.get(rule) != "block":
            kept[rule] = verdict
    rows = sorted((xxhash.xxh64_intdigest(rule.encode()), (verdict[0] + rule).encode()) for rule, verdict in kept.items())
    lengths = np.unique(np.array([len(_key(r)[1].encode()) for r in kept], "<u4"))
    offsets = np.cumsum([0, *(len(s) for _, s in rows)]).astype("<u8")
    with open(path, "wb") as f:
        f.write(MAGIC + np.array([len(rows), len(lengths)], "<u4").tobytes() + lengths.astype("<u4").tobytes())
        f.write(b"\0" * (-f.tell() % 8))
        f.write(np.array([k for k, _ in rows], "<u8").tobytes() + offsets.tobytes() + b"".join(s for _, s in rows))


class DigestArray:
    """A memory-mapped rule file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:4]) != MAGIC:
            raise ValueError(f"{path} is no digest array")
        n, m = data[4:12].view("<u4")
        self.path_lengths = data[12 : 12 + 4 * m].view("<u4").tolist()
        at = (12 + 4 * int(m) + 7) // 8 * 8
        self.keys = data[at : at + 8 * n].view("<u8")
        self.offsets = data[at + 8 * n : at + 8 * n + 8 * (n + 1)].view("<u8")
        self.strings = data[at + 16 * n + 8 :]

    def probe(self, candidates: list[bytes]) -> list[bytes | None]:
        """For each candidate its stored string (verdict letter + rule), or None."""
        found: list[bytes | None] = [None] * len(candidates)
        if not len(self.keys) or not candidates:
            return found
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, wanted)
        inside = at < len(self.keys)
        for i in np.flatnonzero(inside & (self.keys[np.where(inside, at, 0)] == wanted)).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # collisions lie next to each other
                stored = bytes(self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])])
                if stored[1:] == candidates[i]:
                    found[i] = stored
                    break
                k += 1
        return found


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.col(url), parts, 1), upper, lower)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(F.col(url), parts, 2), F.lit(""))})


def _candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    """What could be a rule for this host and path, longest first."""
    name, p = host.encode(), path.encode()
    suffixes, at = [name], name.find(b".")
    while at >= 0:
        suffixes.append(name[at + 1 :])
        at = name.find(b".", at + 1)
    made = {s + p[:n] for s in suffixes if s for n in lengths if n <= len(p)}
    return sorted(made, key=lambda x: (-len(x), x))


def judge(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict.

    A rule ``host/path`` fits a URL whose host is that host or a subdomain and whose path starts with the rule's path;
    the longest one wins (of equal lengths, the lesser string). Without a rule the digest array has no entry for the
    URL, and the verdict is ``default``. Null and malformed URLs have empty host and path, hence no rule. URLs of any length are
    judged whole: a path is probed at the lengths that paths of rules have, a host at each of its dots (work goes with the square of a host's length).
    Rows are
    neither merged nor lost; columns named host, path, rule or verdict are replaced. More than MAX_SHIPPED rules are
    refused here: ``judge_joined`` takes them as a table.
    """
    if len(rules) > MAX_SHIPPED:
        raise ValueError("too many rules to ship to each executor; use judge_joined")
    spark = df.sparkSession
    fd, local = tempfile.mkstemp(prefix="digests-", suffix=".dga")
    os.close(fd)
    atexit.register(os.unlink, local)  # executors may fetch it as long as the session lasts
    write_digest_array(rules, local)
    spark.sparkContext.addFile(local)
    name = os.path.basename(local)
    split = host_and_path(df.drop("rule", "verdict"), url)
    fields = [*split.schema.fields]

    def body(batches):
        array = _mapped(name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            tried, spans = [], [0]
            for h, p in zip(hosts, paths, strict=True):
                tried += _candidates(h, p, array.path_lengths)
                spans.append(len(tried))
            hits = array.probe(tried)
            best = [next((x for x in hits[a:b] if x is not None), None) for a, b in zip(spans, spans[1:], strict=False)]
            rule = pa.array([x and x[1:].decode() for x in best], pa.string())
            verdict = pa.array([default if x is None else "block" if x[:1] == b"b" else "allow" for x in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", rule string, verdict string"
    return by_batch(split, schema, body)


def judge_joined(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """As ``judge``, for rule tables (verdict, rule) of any size: probes meet rules by digest in a shuffled join.

    Each different host and path is judged once. Probes are made for the lengths that paths of rules have, of which a
    table has few.
    """
    split = host_and_path(df.drop("rule", "verdict"), url)
    rule_set = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block > allow
    rule_set = rule_set.withColumn("digest", F.xxhash64("rule"))
    lengths = [r["n"] for r in rule_set.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = split.select("host", "path").distinct()
    probes = urls.select("host", "path", F.explode(suffixes).alias("suffix")).where("suffix <> ''")
    probes = probes.withColumn("n", F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).where("n <= length(path)")
    probes = probes.select("host", "path", F.concat("suffix", F.expr("substr(path, 1, n)")).alias("probe")).withColumn("digest", F.xxhash64("probe"))
    hit = probes.join(rule_set, "digest").where("probe = rule")
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), F.col("rule"))).alias("best"))
    best = best.select("host", "path", "best.rule", "best.verdict")
    return split.join(best, ["host", "path"], "left").select(*split.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL = {
    "op6_url_filter": r"""
WITH rules(rule, rule_host, rule_path, said) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
best AS (
  SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM cut LEFT JOIN best USING (n)
"""
}
