"""Corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

Every stage works on all rows that its predecessor kept and takes effect; all but the last keep the columns of documents.

Null and empty texts are not toxic, have no lines, hold no window of the benchmark and have no tokens; those of them that have a
doc_id are copies of one another (they have no words), so one stays. Rows with a null doc_id are never taken for copies. Texts of
any length are handled whole. Rows that repeat a doc_id are judged by their own texts; of rows that repeat doc_id and text one
stays. Without toxic labels no document is toxic. Further columns of documents are kept up to the last stage, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm.bpe import encode_documents
from tallystream.llm.decontaminate import drop_contaminated
from tallystream.llm.line_dedup import drop_boilerplate
from tallystream.llm.shared import drop_table, fresh, new_path
from tallystream.llm.simhash import drop_near_duplicates
from tallystream.llm.toxicity import drop_toxic, fit_severity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, takes for toxic go."""
    return drop_toxic(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    own = {c: f"{fresh(docs)}{c}" for c in ("n_lines", "n_dropped")}  # columns of these names are replaced by the operator's
    out = drop_boilerplate(docs.withColumnsRenamed(own))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[chars if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8 or more) stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and the digest of the text decoded from them."""
    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination), ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the regression nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if i:  # the stage before; documents themselves stay
            drop_table(docs)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
