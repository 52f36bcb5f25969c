"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of ``docs``:

1. quality: documents that the factorisation machine scores below 0.5 go;
2. line_dedup: lines found in at least 10 documents go from every document; ``n_chars`` follows the text;
3. near_dedup: of every group of near duplicates the document with the smallest doc_id stays;
4. decontamination: documents that hold a 10-word window of a benchmark item go;
5. packing: what is left is tokenised and packed; one row per piece, with its token ids.

A document left without text after stage 2 stays, and is one end token in the end. Rows that repeat a doc_id are one
document and stay or go together where a stage judges by doc_id; rows with a null doc_id are judged by their own text,
and stay in stage 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.decontamination import contamination
from waymark.llm.lines import drop_lines
from waymark.llm.near_duplicates import near_duplicates
from waymark.llm.packing import pack_documents
from waymark.llm.quality import fit_on_labels, score
from waymark.session import fresh_path, materialize, prepare


def _others(docs: DataFrame, *names: str) -> list[str]:
    return [c for c in docs.columns if c not in names]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_on_labels(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select("doc_id", "text", "n_chars", *(F.col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)))
    scored = score(spark, named, model, metadata=["n_chars"], keep=kept).filter(F.col("score") >= 0.5)
    return scored.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = _others(docs, "doc_id", "text", "n_chars")
    kept = [f"c{i}" for i in range(len(others))]
    named = docs.select("doc_id", "text", *(F.col(c).alias(k) for c, k in zip(others, kept, strict=True)))
    out = drop_lines(spark, named, keep=kept)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")} | {c: F.col(k) for c, k in zip(others, kept, strict=True)}
    return out.select(*(new[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(spark, docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.select("doc_id", "text", *(F.col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)))
    out = contamination(spark, named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=kept).filter(F.col("n_hit") == 0)
    return out.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs, with_ids=True)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the machine's scores nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name, path=fresh_path(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
