"""Mixing sources to target weights (operator 4).

Method: Efraimidis-Spirakis sampling. A document's key is an exponential variate divided by its
quality weight. Within a source, documents in key order are prefix-summed against the source's
word budget. A budget above the source's size first takes every document whole once for each
complete epoch; the rest goes by the keys, and the document that straddles the budget is cut there.

The prefix sums never gather a source in one task: each key falls into one of ``SLICES`` slices in
key order, slices are summed first, and only the rows of a slice are then ordered together.
The plan of budgets works on one row for each source.

Rows: a null text has size 0; null ids draw by their texts, so that they spread over the slices; null sources form one source, ordered last; a null or non-positive
weight counts as 1; rows with equal keys (repeated ids) are ordered by id, size and text hash, and
fully equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import WORD, cut, prepare

SLICES = 4096
MOST_EPOCHS = 3
#: Digits of the md5 that make the variate: 13 hex digits are 52 bits.
DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def variate(doc_id: Column, tie: Column) -> Column:
    """Uniform on (0, 1], from the id alone (where it is null, from the hash of the text), so that reruns agree."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), tie.cast("string")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 1) / float(16**DIGITS)


def budgets(sources: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target. One row for each source.

    Filling by weight until no source is above its limit ends with the level L at which the sum of
    least(3 * size, L * weight) equals the total; sources in the order of size / weight are capped first.
    """
    at = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sources.withColumn("weight", ((F.row_number().over(at) - 1) % 3 + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    upto, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(MOST_EPOCHS * F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
        .withColumn("is_open", MOST_EPOCHS * F.col("source_size") > F.col("level") * F.col("weight"))
    )
    level = F.min(F.when(F.col("is_open"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(whole)["l"]
    limit = (MOST_EPOCHS * F.col("source_size")).cast("double")
    return filled.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weight_col: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The columns doc_id, tie (a hash of the text), source, weight, key, size, source_size, target, taken, one row for each document.

    The quality weight is a column of ``docs`` or comes from ``labels``, which meet rows without texts.
    """
    prepare(docs.sparkSession)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64("text").alias("tie"), F.when(weight > 0, weight).otherwise(1.0).alias("quality"),
    )
    if labels is not None:
        rows = quality_weight(rows.drop("quality"), labels).withColumnRenamed("quality_weight", "quality")
    rows = cut(rows.withColumn("key", -F.log(variate(F.col("doc_id"), F.col("tie"))) / F.col("quality")).withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int")))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    plan = budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("n"), "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("before"))
    p = plan.select(F.col("source").alias("ps"), "source_size", "target")
    slices = slices.join(p, F.col("s").eqNullSafe(F.col("ps")), "left").select("s", "n", "before", "source_size", "target")
    joined = rows.join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("n")), "left")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return joined.select("doc_id", "tie", "source", F.col("quality").alias("weight"), "key", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a column quality_weight: 2 for documents labelled good, 0.5 for bad, else 1."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max("quality").alias("_quality"))
    rows = docs.drop("quality_weight").select(F.struct("*").alias("row"))
    found = rows.join(known, F.col("row.doc_id") == F.col("_label_id"), "left")
    return found.select("row.*", F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0).alias("quality_weight"))


def mixture(docs: DataFrame, weight_col: str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; the row that straddles a budget is cut to its words, space-joined.

    Rows that agree in id and text are taken alike. n_chars follows a cut text; other columns stay.
    """
    plan = mix(docs, weight_col, labels).groupBy(F.col("doc_id").alias("planned"), F.col("tie").alias("planned_tie")).agg(F.max("size").alias("size"), F.max("taken").alias("taken")).where("taken > 0")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != weight_col]).alias("row"))
    rows = rows.join(plan, F.col("row.doc_id").cast("long").eqNullSafe(F.col("planned")) & (F.xxhash64("row.text") == F.col("planned_tie")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words), " ")
    text = F.when(words < F.col("size"), first).otherwise(F.col("row.text"))
    kept = rows.select("row", text.alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c != weight_col])
