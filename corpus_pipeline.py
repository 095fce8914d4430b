"""A corpus from raw documents to packed sequences: each stage writes Parquet that the next one reads.

The stages keep the columns of ``documents`` up to the last, which returns pieces with their sequence and offset.
Further columns pass through unread, whatever their names; null texts and ids are as each operator has them; an empty
table gives no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import op4_simhash, op5_decontam, op6_packing, op9_pii, op10_langid
from tidelog.llm.common import aside, documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or that no language explains better than all others, go; where
    none is stated, the one found is."""
    import public_tokenizers

    own, back = aside(docs, ("doc_id", "text", "lang"))
    model = op10_langid.fit(own, public_tokenizers.path("piece_bpe_32k.model"))
    some = op10_langid.predict(own, model).where("lang_pred <> 'und' and score >= 0.5")
    return back(some.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, once; rows without an id stay."""
    first = op4_simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    own, back = aside(docs, ("doc_id", "text"))
    kept = own.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(own.columns)
    return back(kept.union(own.where("doc_id is null")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op5_decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with personal data replaced and n_chars to match."""
    out = op9_pii.redact(docs, op9_pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op6_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", redact_pii),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
