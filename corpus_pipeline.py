"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; it
is written as Parquet and read again as the next one's input. All but the last return the
columns of ``documents``.

Defined edge cases: as documented in the operators; stages pass nulls, empty texts, ties,
repeated rows and empty tables through to them, and drop columns other than those of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan.llm import jaccard_join, line_dedup, mixing, packing, pu_quality
from cuespan.llm._common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates of the pipeline: shingles of five words, similarity 0.8.
NEAR = {"size": 5, "num": 80, "den": 100}
#: What a document must score to stay: the classifier rejects only what is likelier bad.
KEEP_AT = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go."""
    model = pu_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = pu_quality.score(docs.select(*COLUMNS), model, *COLUMNS)
    return scored.filter(F.col("score") >= KEEP_AT).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated lines go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of linked ones stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), **NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents are repeated, or left out, by their source's target rate."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sequences of at most 4096 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("source_mix", mix),
    ("packing", pack),
]

#: Not expressible in SQL: stage 1 is a trained model, stage 5 a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
