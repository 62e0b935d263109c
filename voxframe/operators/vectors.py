"""Means, centroids and nearest centroids of embeddings (file, ord, embedding, label), declared on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.turns import confidence, cosine
from voxframe.functions.vectors import l2_normalize


def finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def mean_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, mean: the mean embedding of each key; vectors that are not finite, empty, or of another length than the key's first are left out."""
    held = rows.where((F.size("embedding") > 0) & finite(F.col("embedding")))
    first = held.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.size("embedding"), "ord").alias("_size"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    held = held.join(first, [*same, F.size("embedding") == F.col("_size")])
    parts = held.select(*keys, F.posexplode("embedding").alias("i", "v")).groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))


def centroids(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, centroid: unit means."""
    return mean_vectors(rows, *keys).select(*keys, l2_normalize(F.col("mean")).alias("centroid"))


def segment_confidence(rows: DataFrame) -> DataFrame:
    """rows with confidence: logistic, of the cosine with the own label's centroid in the file; 0 without one."""
    c = centroids(rows, "file", "label").select(F.col("file").alias("cf"), F.col("label").alias("cl"), "centroid")
    out = rows.join(c, (F.col("file") == F.col("cf")) & (F.col("label") == F.col("cl")), "left")
    return out.withColumn("confidence", F.when(F.col("centroid").isNotNull(), confidence(cosine(F.col("embedding"), F.col("centroid")))).otherwise(0.0)).drop("cf", "cl", "centroid")


def nearest_centroid(rows: DataFrame, found: DataFrame) -> DataFrame:
    """file, ord, label, similarity: of each row the nearest centroid (file, label, centroid) of its file, the smallest label of equals.

    The centroids of a file, one for each of its speakers, come to its rows as one array.
    """
    held = found.groupBy(F.col("file").alias("cf")).agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("c"))
    scored = rows.join(held, F.col("file") == F.col("cf")).select("file", "ord", F.transform("c", lambda x: F.struct(cosine(F.col("embedding"), x["centroid"]).alias("s"), (-x["label"]).alias("less"))).alias("s"))
    best = scored.select("file", "ord", F.array_max("s").alias("m"))
    return best.select("file", "ord", (-F.col("m.less")).alias("label"), F.col("m.s").alias("similarity"))


def pairwise_cosines(rows: DataFrame) -> DataFrame:
    """file, a, b, cosine for a < b of each file's rows; the matrix is symmetric with ones on its diagonal."""
    a = rows.select("file", F.col("ord").alias("a"), F.col("embedding").alias("x"))
    b = rows.select(F.col("file").alias("f2"), F.col("ord").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, (F.col("file") == F.col("f2")) & (F.col("a") < F.col("b"))).select("file", "a", "b", cosine(F.col("x"), F.col("y")).alias("cosine"))


def cohort_statistics(rows: DataFrame, cohort: DataFrame, top: int) -> DataFrame:
    """file, ord, mean, std of each row's best ``top`` cosines with the cohort (id, embedding), a broadcast table of bounded size."""
    held = F.broadcast(cohort.agg(F.collect_list(l2_normalize(F.col("embedding"))).alias("cohort")))
    scores = F.slice(F.sort_array(F.transform("cohort", lambda c: cosine(F.col("embedding"), c)), asc=False), F.lit(1), F.lit(max(1, top)))
    rows = rows.join(held, F.lit(True)).select("file", "ord", scores.alias("s"))  # one row on the other side
    mean = F.aggregate("s", F.lit(0.0), lambda t, x: t + x) / F.size("s")
    rows = rows.withColumn("mean", mean)
    std = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("s"))
    rows = rows.withColumn("std", std)
    flat = F.col("std") < 1e-6
    return rows.select("file", "ord", F.when(flat, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(flat, 1.0).otherwise(F.col("std")).alias("std"))


def prune_clusters(rows: DataFrame, least: float, weight: DataFrame | None = None) -> DataFrame:
    """rows (file, ord, label, embedding) with labels of clusters under ``least`` moved to the nearest of the others and numbered anew.

    weight: file, label, weight; without it the number of members. Without a survivor the heaviest stays, the smallest label of several.
    """
    held = weight if weight is not None else rows.groupBy("file", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    by_file = Window.partitionBy("file")
    best = F.min(F.struct((-F.col("weight")).alias("less"), "label")).over(by_file)
    known = held.withColumn("any", F.max((F.col("weight") >= least).cast("int")).over(by_file)).withColumn("best", best["label"])
    known = known.withColumn("stays", F.when(F.col("any") == 1, F.col("weight") >= least).otherwise(F.col("label") == F.col("best")))
    known = known.withColumn("all_stay", F.min(F.col("stays").cast("int")).over(by_file) == 1)
    known = known.withColumn("slot", F.when(F.col("stays"), F.row_number().over(Window.partitionBy("file", "stays").orderBy("label")) - 1))
    known = known.select(F.col("file").alias("kf"), F.col("label").alias("kl"), "stays", "all_stay", "slot")
    out = rows.join(known, (F.col("file") == F.col("kf")) & (F.col("label") == F.col("kl")))
    kept = out.where("stays and not all_stay").select("file", "ord", "embedding", F.col("slot").alias("label"))
    near = nearest_centroid(out.where("not stays").select("file", "ord", "embedding"), centroids(kept, "file", "label").withColumn("label", F.col("label").cast("long")))
    near = near.select(F.col("file").alias("nf"), F.col("ord").alias("no"), F.col("label").alias("near"))
    out = out.join(near, (F.col("file") == F.col("nf")) & (F.col("ord") == F.col("no")), "left")
    return out.select("file", "ord", F.when(F.col("all_stay"), F.col("label")).when(F.col("stays"), F.col("slot")).otherwise(F.col("near")).cast("long").alias("label"))


def split_short(rows: DataFrame, least: float) -> DataFrame:
    """rows (file, ord, start, end) with kept: at least so long, or the file's longest (the first of several) where none is."""
    by_file = Window.partitionBy("file")
    length = F.col("end") - F.col("start")
    first = F.min(F.struct((-length).alias("less"), "ord")).over(by_file)["ord"]
    any_ = F.max((length >= least).cast("int")).over(by_file)
    return rows.withColumn("kept", F.when(F.lit(least <= 0), True).when(any_ == 1, length >= least).otherwise(F.col("ord") == first))


def reassign_short(rows: DataFrame) -> DataFrame:
    """file, ord, label: labels of the kept rows (file, ord, embedding, kept, label), and the nearest kept centroid's for the others."""
    near = nearest_centroid(rows.where("not kept").select("file", "ord", "embedding"), centroids(rows.where("kept"), "file", "label"))
    return rows.where("kept").select("file", "ord", "label").unionAll(near.select("file", "ord", "label"))


def gap_thresholds(rows: DataFrame) -> DataFrame:
    """file, threshold: the similarity after the largest gap among the lower half of a file's pairs, between 0.2 and 0.7; 0.5 for one row or two."""
    by = Window.partitionBy("file").orderBy("cosine", "a", "b")
    s = pairwise_cosines(rows).withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file"))).withColumn("after", F.lead("cosine").over(by))
    steps = s.where((F.col("i") < F.floor(F.col("n") / 2) - 1) & (F.col("after") > F.col("cosine")))
    found = steps.groupBy("file").agg(F.max(F.struct((F.col("after") - F.col("cosine")).alias("gap"), (-F.col("i")).alias("less"), "after")).alias("m")).select(F.col("file").alias("gf"), F.col("m.after").alias("after"))
    second = s.where("i = 1").select(F.col("file").alias("sf"), F.col("cosine").alias("second"))
    files = rows.select("file").distinct().join(found, F.col("file") == F.col("gf"), "left").join(second, F.col("file") == F.col("sf"), "left")
    at = F.coalesce("after", "second")
    return files.select("file", F.when(at.isNull(), 0.5).otherwise(F.least(F.lit(0.7), F.greatest(F.lit(0.2), at))).alias("threshold"))


def silhouettes(rows: DataFrame) -> DataFrame:
    """file, silhouette of labelled rows by cosine distance: the mean over members of clusters of two and more; 0 for two rows or one cluster."""
    a = rows.select("file", F.col("ord").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("x"))
    b = rows.select(F.col("file").alias("f2"), F.col("ord").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("y"))
    far = a.join(b, (F.col("file") == F.col("f2")) & (F.col("a") != F.col("b"))).select("file", "a", "la", "lb", F.greatest(F.lit(0.0), 1 - cosine(F.col("x"), F.col("y"))).alias("d"))
    mean = far.groupBy("file", "a", "la", "lb").agg(F.avg("d").alias("d"))
    each = mean.groupBy("file", "a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("d"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("d"))).alias("other")).where("own is not null and other is not null")
    s = each.groupBy(F.col("file").alias("ef")).agg(F.avg((F.col("other") - F.col("own")) / F.greatest("own", "other")).alias("s"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.join(s, F.col("file") == F.col("ef"), "left").select("file", F.when(F.col("n") <= 2, 0.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("silhouette"))
