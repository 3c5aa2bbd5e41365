"""Mixing sources to target weights, in DataFrame functions only.

Efraimidis-Spirakis sampling: each document gets the key -ln(u) / weight with u from a hash of its id and text, documents
of a source are taken in the order of their keys until the source's budget is spent. Whole epochs of a source come first,
and only the fraction that is left is selected. A source's documents are dealt into ranges by quantiles of their keys, so no
task sorts a whole source; the ranges' sums, prefix-summed, say where each range begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.staging import stage

#: A word.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of a source's keys, a power of two.
RANGES = 1024


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of letters and white space among the characters, 0.05 at least; 0.05 if there is no text."""
    n = F.length(text)
    plain = n - F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    return F.coalesce(F.when(n > 0, F.greatest(plain / n, F.lit(0.05))), F.lit(0.05))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns, alike in each run."""
    joined = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to rows of (source, source_size).

    Sources by code point, null last, get the weights in turn. They share ``share`` of all sizes by weight; a target stops
    at ``cap`` times its source's size, and the excess goes to the others by weight. In order of cap/weight, the sources
    that stop are a prefix, so one running sum finds the level at which the rest share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_full"), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") - 1) % len(weights) + 1)
    level = (F.col("_goal") - F.col("_before")) / F.col("_weights_left")
    return (
        sources.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_w", w)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_goal", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.first(F.when(level <= F.col("_full"), level), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_level") * F.col("_w")), F.col("_cap")))
        .select("target", *sources.columns)
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, quality: Column | None = None, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each document.

    Returns (id, source, size, source_size, target, weight, epochs, taken) and the columns in ``keep``, a row for each
    row of docs. size is the number of words, taken the words the mix takes with repeats counted: epochs whole passes,
    and what of the fraction falls to the document. The document at which the budget ends gives the words that are left,
    so each source meets its target to the word. quality is the weight of the sampling: documents of weight 0, less, or
    NaN come after all others, in random order, and null counts as 0.05; infinite weights come first. Null text and empty
    text have size 0 and give nothing, very long texts are counted whole; null is a source of its own; equal rows are
    taken in any order among themselves; an empty table gives an empty table; other columns, whatever their names, don't
    matter. A source's keys go by their quantiles into ``RANGES`` ranges: a task sorts a range.
    """
    text = F.col(text_col)
    weight = F.coalesce((text_quality(text) if quality is None else quality).cast("double"), F.lit(0.05))
    kept = [c for c in keep if c not in (id_col, source_col)]
    rest = [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest")] if kept else []
    slim = docs.select(F.monotonically_increasing_id().alias("row"), *rest, F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text).alias("size"), weight.alias("weight"), uniform(seed, F.col(id_col), F.md5(F.coalesce(text, F.lit("")))).alias("u"))
    positive = (F.col("weight") > 0) & ~F.isnan("weight")
    infinite = F.lit(float("inf"))
    key = F.when(positive, F.try_divide(-F.log("u"), F.col("weight"))).otherwise(infinite)
    # The keys' order in [0, 2], with those of no weight behind all others by u, so that they spread over ranges too.
    rank = F.when(positive, F.when(F.col("key") < infinite, F.col("key") / (1 + F.col("key"))).otherwise(1.0)).otherwise(1 + F.col("u"))
    whole_rows = slim = stage(slim.withColumn("key", key).withColumn("rank", rank))
    slim = slim.drop("rest")
    cuts = F.percentile_approx("rank", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(20 * RANGES))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), cuts.alias("_cuts"))
    targets = source_targets(sources, weights, share, cap)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    targets = targets.withColumn("_budget", budget).withColumn("epochs", whole.cast("long")).withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source")
    # Range: how many of the cuts are below, by binary search.
    steps = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col("rank") > F.element_at("_cuts", at + step), at + step).otherwise(at))
    placed = slim.join(targets, slim["source"].eqNullSafe(targets["_source"])).withColumn("bucket", bucket).drop("_source", "_cuts")
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_offset"))
    joined = placed.join(totals, placed["source"].eqNullSafe(totals["_s"]) & (placed["bucket"] == totals["_b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "key", "u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before")))
    out = joined.withColumn("_before", before).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    if kept:  # what is kept goes through one shuffle, and not through the ranges
        out = out.join(whole_rows.select("row", "rest"), "row")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "weight", "epochs", "taken", *[F.col("rest")[c].alias(c) for c in kept])
