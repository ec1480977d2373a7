"""A training corpus from documents: toxicity, line dedup, near-dedup, benchmark decontamination and mixing, one after the other.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. Every
stage but the last returns the columns of its documents, whatever they are called: where an operator adds columns of its
own, those of documents that have such a name are set aside. Rows are told apart by doc_id and text, so rows that share a
doc_id are judged each by its own text; rows without a doc_id pass near-dedup and line dedup unchanged. An empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from scriptorium.llm._common import clear_scratch, materialize, table, written


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and the way back."""
    back = {f"__aside_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: a for a, c in back.items()}), back


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    own, back = _aside(docs, "held_out", "score", "predicted")
    scored = toxicity.score_toxicity(own, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").drop("held_out", "score", "predicted").withColumnsRenamed(back).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; n_chars follows, if there is one. Documents of nothing else go, unless they were empty before."""
    own, back = _aside(docs, "n_lines", "n_removed")
    out = line_dedup.dedup_lines(own)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_removed").withColumnsRenamed(back).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]
#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's scratch tables go as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_scratch(spark, before, keep=1)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
