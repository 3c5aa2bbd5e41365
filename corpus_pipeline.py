"""Pipeline from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. For all of
them: an empty table gives an empty table; texts of any length are read whole; other columns go through unchanged,
whatever their names; rows are told apart by what they hold, so a repeated or missing doc_id takes no other row with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, langid, linededup, mixing, ngramjoin
from lattica.llm.staging import drop, stage

#: The stages can't be told in SQL: edit joins, hyperdimensional vectors and seeded components are tested by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those of null text, or without a letter.

    The classifier has no floor for its score, since short clean texts are as far from all profiles as gibberish. Where
    there is nothing to learn from (no labels), documents with a letter stay. Repeated rows fare alike.
    """
    found = langid.detect_language(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) | F.col("row.text").rlike(r"\p{L}")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines one stays, that of the least doc_id (null first) and place.

    A document that lost lines and has no word left goes; null texts and those that were blank before stay. n_chars is
    counted anew where lines went. Rows of equal doc_id and text count as one document and fare alike.
    """
    out = linededup.dedup_lines(docs, shortest=1).where((F.size("removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.size("removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the least by (has no doc_id, doc_id, hash of the row).

    Decisions go by row, named by its doc_id and 96 bits of all its columns; of rows equal in all of them one stays. Rows
    without a word link with nothing and all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("one"), F.hash(*columns).alias("two"))
    found = ngramjoin.ngram_join(docs.select(key.alias("key"), "text"), id_col="key").where("n_shingles > 0")
    # One row for each key that loses rows: it goes as a whole, or all but one of its equal rows.
    less = found.groupBy("key").agg(F.first("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    less = stage(less.where((F.col("first") != F.col("key")) | (F.col("n") > 1)).select(F.col("key.one").alias("_one"), F.col("key.two").alias("_two"), F.col("key.id").alias("_id"), (F.col("first") != F.col("key")).alias("_gone")))
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("one"), F.hash(*columns).alias("two"))
    marked = rows.join(less, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    alone = marked.where("_gone is null").select("row.*")
    return alone.unionByName(marked.where("not _gone").dropDuplicates(["one", "two", "id"]).select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go: ten consecutive words, or a whole item of fewer.

    These are the documents that op5 calls contaminated. Documents without words stay; repeated rows fare alike.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with its other columns: doc_id, source, size, source_size, target, weight,
    epochs, taken, and the rest of docs but columns of these names. A row for each row, those of which nothing is taken too."""
    own = ("size", "source_size", "target", "weight", "epochs", "taken")
    return mixing.mix_sources(docs, keep=tuple(c for c in docs.columns if c not in own))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in STAGES[:-1]:
        before, docs = docs, stage(f(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
