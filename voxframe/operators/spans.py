"""Spans of frames: unions, cells between boundaries, and joins in equal bins, as sums of events.

A span is (file, a, b) in frames, a inclusive, b exclusive. Nothing here compares all spans of a file with
each other: counts come from running sums of openings and closings, joins from bins of ``BIN`` frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_S = 0.01
BIN = 3000


def events(spans: DataFrame, name: str, names: tuple[str, ...]) -> DataFrame:
    """file, at and one column for each of names: +1 where a span opens in ``name``, -1 where it closes."""
    steps = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d"))))
    found = spans.where("a < b").select("file", steps.alias("x")).select("file", "x.at", *[(F.col("x.d") if n == name else F.lit(0)).cast("long").alias(n) for n in names])
    return found


def cells(layers: dict[str, DataFrame]) -> DataFrame:
    """file, a, b and for each layer how many of its spans are open there; one shuffle by file, no join."""
    names = tuple(layers)
    steps = reduce(DataFrame.unionAll, [events(spans, n, names) for n, spans in layers.items()])
    steps = steps.groupBy("file", "at").agg(*[F.sum(n).alias(n) for n in names])
    by_time = Window.partitionBy("file").orderBy("at")
    out = steps.select("file", F.col("at").alias("a"), F.lead("at").over(by_time).alias("b"), *[F.sum(n).over(by_time).alias(n) for n in names])
    return out.where("b is not null")


def union_of(spans: DataFrame, *keys: str) -> DataFrame:
    """file, keys, a, b: the union of the spans of each key, as disjoint spans."""
    by = ["file", *keys]
    steps = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d"))))
    steps = spans.where("a < b").select(*by, steps.alias("x")).groupBy(*by, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy(*by).orderBy("at")
    open_ = steps.withColumn("open", F.sum("d").over(order))
    edges = open_.withColumn("before", F.coalesce(F.lag("open").over(order), F.lit(0))).where("(open > 0) <> (before > 0)")
    return edges.withColumn("b", F.lead("at").over(order)).where("open > 0").select(*by, F.col("at").alias("a"), "b")


def in_bins(spans: DataFrame, bin_: int = BIN) -> DataFrame:
    """The spans cut at the bins' bounds, with the bin's number."""
    at = F.sequence(F.floor(F.col("a") / bin_), F.floor((F.col("b") - 1) / bin_))
    rows = spans.where("a < b").withColumn("bin", F.explode(at))
    return rows.withColumn("a", F.greatest(F.col("a"), F.col("bin") * bin_)).withColumn("b", F.least(F.col("b"), (F.col("bin") + 1) * bin_))


def meeting(left: DataFrame, right: DataFrame, bin_: int = BIN) -> DataFrame:
    """Columns of both (right's further ones kept, its file, a and b not), with a, b the stretch that a span of each shares.

    A pair that shares several bins gives one row for each.
    """
    l, r = in_bins(left, bin_), in_bins(right, bin_).withColumnRenamed("file", "rfile").withColumnRenamed("bin", "rbin").withColumnRenamed("a", "ra").withColumnRenamed("b", "rb")
    met = l.join(r, (F.col("file") == F.col("rfile")) & (F.col("bin") == F.col("rbin")) & (F.col("a") < F.col("rb")) & (F.col("ra") < F.col("b")))
    return met.withColumn("a", F.greatest("a", "ra")).withColumn("b", F.least("b", "rb")).drop("rfile", "rbin", "ra", "rb", "bin")


def first_centre(bound: Column) -> Column:
    """The first frame whose centre lies at or after a time in seconds."""
    guess = F.ceil(bound / F.lit(FRAME_S) - 0.5) - 1
    at = lambda i: (i + 0.5) * F.lit(FRAME_S) >= bound
    return F.greatest(F.lit(0), F.when(at(guess), guess).when(at(guess + 1), guess + 1).otherwise(guess + 2)).cast("long")
