"""The corpus pipeline: quality rules, near-duplicate removal, repeated passages, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. A stage may leave small tables
in the shared folder, which its result reads; what is large it deletes itself or
keeps as a checkpoint. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, mixing, quality, substring_dedup
from tidemark.llm.common import discard, materialize, read_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and their host's verdict.

    A null or empty text has too few words and goes; a null source is a host of its
    own. Repeated rows are judged alike. All columns are kept.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one of least doc_id. Five-word shingles, similarity 0.8 or more.

    Documents without words all stay; of repeated rows one stays. A null doc_id
    comes before all others. All columns are kept.
    """
    return jaccard_join.keep_one(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of recurring passages; a text that loses none stays as it is.

    A null text stays null. Rows with one doc_id are cut apart; repeated rows are
    copies of each other. All columns are kept; n_chars, if there, follows the text.
    """
    # by place, as names may hold dots or differ only in case
    at = [c if c in ("doc_id", "text", "n_chars") else f"o_{i}" for i, c in enumerate(docs.columns)]
    cut = substring_dedup.remove_repeats(docs.toDF(*at), at, own=("words", "removed", "kept"))
    cut = cut.withColumn("text", F.when(F.col("removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in at:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*at).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them.

    A null source is a source of its own; a document without words counts nothing
    and is drawn like its source's others. All columns are kept.
    """
    return mixing.emit_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, source, its number of ids, the ids, and the digest of what they decode to; a null text has none."""
    encoded = bpe.encode(docs, keep=["source"])
    return encoded.select("doc_id", "source", "n_tokens", "ids", F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("byte-level BPE", encoding),
]

#: The stages' methods have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir))
        if i:
            discard(docs)  # written by this run, and read by nothing else
        docs = done
    return docs
