"""Queries of the training-data operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.llm import decontam, htmltext, langid, linededup, mixing, ngramjoin, ppm, quality, secretscan, substring
from lattica.llm.sql import SQL


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(_read(spark, sf_dir, "documents"), shortest=1)
    return out.select("row.doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "first_ids", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_html_text(spark, sf_dir):
    return htmltext.extract_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_substring_dedup(spark, sf_dir):
    return substring.dedup_substrings(_read(spark, sf_dir, "documents")).drop("spans", "paths")


def op5_decontaminate(spark, sf_dir):
    leaks = decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return leaks.select(
        "row.doc_id", "leak.n_words", n_hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op6_quality_rules(spark, sf_dir):
    return quality.quality_rules(_read(spark, sf_dir, "documents"), with_text=False)


def op7_ngram_join(spark, sf_dir):
    return ngramjoin.ngram_join(_read(spark, sf_dir, "documents")).drop("name")


def op8_ppm_score(spark, sf_dir):
    return ppm.score_documents(_read(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    out = langid.detect_language(_read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_secrets(spark, sf_dir):
    found = secretscan.scan_secrets(_read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries():
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_html_text, op4_substring_dedup, op5_decontaminate, op6_quality_rules, op7_ngram_join, op8_ppm_score, op9_language, op10_secrets)}


def oracle_sql():
    return dict(SQL)
