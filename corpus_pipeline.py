"""The corpus pipeline: quality classifier, near-dedup, substring dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs`` (doc_id, text, lang, source,
n_chars and whatever else came in) for the documents that they keep; the last returns doc_id, n_tokens, ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm import byte_bpe, decontaminate, quality_gam, rlz_dedup, simhash

#: No SQL expresses these stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5. Labels of documents that are not in ``docs`` are not used."""
    model = quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_gam.score(docs.withColumnRenamed("score", "score_before"), model, keep_text=True)
    return scored.where("score >= 0.5").drop("score").withColumnRenamed("score_before", "score").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one of the least doc_id."""
    return simhash.near_distinct(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words that start earlier, too (in a smaller doc_id, or in the same text): the first of the
    copies stays. Documents left empty by that go; a text that loses nothing stays as it is, white space included.
    n_chars is that of the new text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    out = rlz_dedup.dedup(docs.select("doc_id", "text", row), keep_first=True).where("NOT (n_removed > 0 AND kept = '')")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("whole.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("whole.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, re-parameterised or not."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (four bytes each, little-endian) and the text decoded from them."""
    vocabulary = byte_bpe.default_vocabulary()
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), *vocabulary), *vocabulary)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
