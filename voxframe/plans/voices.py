"""Registered queries of vectors and clustering, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxframe.functions import vectors as fv
from voxframe.functions.turns import rounded
from voxframe.operators import clustering, scoring, sequences, vectors
from voxframe.plans import derived
from voxframe.plans.base import query

#: Fifty vectors are a recording. x: double precision; u: unit length.
EMB = """, emb AS (SELECT (vec_id // 50)::VARCHAR AS file, vec_id AS ord, label % 4 AS label, embedding::DOUBLE[] AS x, vec_id * 0.75::DOUBLE AS start, vec_id * 0.75::DOUBLE + 0.5::DOUBLE + (vec_id % 5) * 0.5::DOUBLE AS "end" FROM embeddings),
cos AS (SELECT a.file, a.ord AS a, b.ord AS b, a.label AS la, b.label AS lb, list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) AS c FROM emb a JOIN emb b ON a.file = b.file AND a.ord <> b.ord),
means AS (SELECT file, label, list(m ORDER BY i) AS mean FROM (SELECT file, label, i, avg(x[i]) AS m FROM emb, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY ALL),
cents AS (SELECT file, label, list_transform(mean, lambda v: v / sqrt(list_dot_product(mean, mean))) AS c FROM means) """


def emb(spark, d):
    derived.importable(spark)
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    start = F.col("vec_id") * 0.75
    return e.select(F.expr("vec_id div 50").cast("string").alias("file"), F.col("vec_id").alias("ord"), (F.col("label") % 4).cast("long").alias("label"), "embedding", start.alias("start"), (start + 0.5 + F.col("vec_id") % 5 * 0.5).alias("end"))


def six(c):
    return rounded(c, 6).alias(c)


@query("p4_cosine_mixed", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], y) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(y, y)), 6) AS cosine FROM (SELECT vec_id, embedding, list_transform(embedding, lambda v: (v + 0.25)::FLOAT::DOUBLE) AS y FROM embeddings)")
def p4(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", rounded(fv.cosine_mixed(F.col("embedding"), F.transform("embedding", lambda v: (v + F.lit(0.25).cast("float")).cast("double"))), 6).alias("cosine"))


@query("p5_l2_normalize", "SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE * 3 / sqrt(9 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings")
def p5(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.transform(fv.l2_normalize(F.transform("embedding", lambda v: v.cast("double") * 3)), lambda v: rounded(v, 6)).alias("unit"))


@query("p6_euclidean", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def p6(spark, d):
    a = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("before"), F.col("embedding").alias("other"))
    return a.join(b, F.col("vec_id") == F.col("before")).select("vec_id", rounded(fv.euclidean(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("p19_pre_emphasis", "SELECT vec_id, list_transform(range(1, 65), lambda i: round(CASE WHEN i = 1 THEN embedding[1]::DOUBLE ELSE embedding[i]::DOUBLE - 0.97::DOUBLE * embedding[i - 1]::DOUBLE END, 6)) AS y FROM embeddings")
def p19(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform(fv.pre_emphasis(F.col("embedding")), lambda v: rounded(v, 6)).alias("y"))


@query("p20_hamming", "SELECT vec_id, list_transform(range(1, 65), lambda i: round(embedding[i]::DOUBLE * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * (i - 1) / 63)), 6)) AS y FROM embeddings")
def p20(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.zip_with("embedding", fv.hamming(64), lambda v, w: rounded(v.cast("double") * w, 6)).alias("y"))


@query("p21_mel_scale", "SELECT event_id, round(2595.0::DOUBLE * log10(1 + value / 700.0::DOUBLE), 6) AS mel, round(700.0::DOUBLE * (10.0::DOUBLE ** (value / 2595.0::DOUBLE) - 1), 6) AS hz FROM events")
def p21(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", rounded(fv.hz_to_mel(F.col("value")), 6).alias("mel"), rounded(fv.mel_to_hz(F.col("value")), 6).alias("hz"))


@query("p26_silence_spans", "SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN (i - 1 >= 5 AND i - 1 < 10) OR (i - 1 >= 50 + vec_id % 3 AND i - 1 < 57) THEN 0.0::DOUBLE ELSE embedding[i]::DOUBLE END) AS y FROM embeddings")
def p26(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    spans = F.array(F.struct(F.lit(0.51).alias("start"), F.lit(0.9375).alias("end")), F.struct(((50 + F.col("vec_id") % 3) / 10.0).alias("start"), F.lit(5.65).alias("end")), F.struct(F.lit(3.0).alias("start"), F.lit(2.0).alias("end")))
    return e.select("vec_id", fv.silence_spans(F.col("embedding"), spans, 10).alias("y"))


@query("p28_center_crop", "SELECT vec_id, list_transform(embedding[18:47], lambda v: v::DOUBLE) AS y FROM embeddings")
def p28(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform(fv.center_crop(F.col("embedding"), 3.0, 10), lambda v: v.cast("double")).alias("y"))


@query("s14_downmix", "SELECT vec_id, list_transform(range(0, 32), lambda i: round((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2, 9)) AS mono FROM embeddings")
def s14(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", i * 2 + 1, F.lit(2)))
    return e.select("vec_id", F.transform(fv.downmix(frames), lambda v: rounded(v, 9)).alias("mono"))


@query("v1_pairwise_cosine", EMB + "SELECT file, a, b, round(c, 6) AS cosine FROM cos WHERE a < b")
def v1(spark, d):
    return vectors.pairwise_cosines(emb(spark, d)).select("file", "a", "b", six("cosine"))


@query("v2_mean_vector", EMB + "SELECT file, label, list_transform(mean, lambda v: round(v, 6)) AS mean FROM means")
def v2(spark, d):
    return vectors.mean_vectors(emb(spark, d), "file", "label").select("file", "label", F.transform("mean", lambda v: rounded(v, 6)).alias("mean"))


@query("v3_centroids", EMB + "SELECT file, label, list_transform(c, lambda v: round(v, 6)) AS centroid FROM cents")
def v3(spark, d):
    return vectors.centroids(emb(spark, d), "file", "label").select("file", "label", F.transform("centroid", lambda v: rounded(v, 6)).alias("centroid"))


@query("v4_speaker_embeddings", EMB + "SELECT file, label, list_transform(c, lambda v: round(v, 6)) AS centroid FROM cents")
def v4(spark, d):
    e = emb(spark, d)
    broken = e.withColumn("embedding", F.when(F.col("ord") % 2 == 0, F.array().cast("array<float>")).otherwise(F.array(F.lit(float("nan")).cast("float"))))
    return vectors.centroids(e.unionAll(broken), "file", "label").select("file", "label", F.transform("centroid", lambda v: rounded(v, 6)).alias("centroid"))


@query("v5_segment_confidence", EMB + "SELECT e.file, e.ord, round(1 / (1 + exp(-10 * (list_dot_product(x, c) / sqrt(list_dot_product(x, x)) - 0.5))), 6) AS confidence FROM emb e JOIN cents c ON e.file = c.file AND e.label = c.label")
def v5(spark, d):
    return vectors.segment_confidence(emb(spark, d)).select("file", "ord", six("confidence"))


NEAREST = ", nearest AS (SELECT e.file, e.ord, c.label, round(list_dot_product(x, c) / sqrt(list_dot_product(x, x)), 6) AS similarity FROM {rows} e JOIN {cents} c ON e.file = c.file QUALIFY row_number() OVER (PARTITION BY e.file, e.ord ORDER BY list_dot_product(x, c) / sqrt(list_dot_product(x, x)) DESC, c.label) = 1) "


@query("v7_nearest_centroid", EMB + NEAREST.format(rows="emb", cents="cents") + "SELECT * FROM nearest")
def v7(spark, d):
    e = emb(spark, d)
    return vectors.nearest_centroid(e.drop("label"), vectors.centroids(e, "file", "label")).select("file", "ord", "label", six("similarity"))


SIZED = EMB + """, sl AS (SELECT file, ord, x, CASE WHEN ord % 50 < 3 THEN 9 WHEN ord % 50 < 10 THEN 8 ELSE label END AS label FROM emb),
w AS (SELECT file, label, count(*)::DOUBLE AS weight FROM sl GROUP BY ALL), """
PRUNED = """k AS (SELECT *, weight >= {least} AS stays FROM w), kk AS (SELECT file, label, row_number() OVER (PARTITION BY file ORDER BY label) - 1 AS slot FROM k WHERE stays),
km AS (SELECT file, slot AS label, list(m ORDER BY i) AS mean FROM (SELECT s.file, slot, i, avg(x[i]) AS m FROM sl s JOIN kk ON s.file = kk.file AND s.label = kk.label, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY ALL),
kc AS (SELECT file, label, list_transform(mean, lambda v: v / sqrt(list_dot_product(mean, mean))) AS c FROM km)""" + NEAREST.format(rows="sl", cents="kc").replace("SELECT e.file", "SELECT e.file") + """, al AS (SELECT file, bool_and(stays) AS al FROM k GROUP BY file)
SELECT s.file, s.ord, CASE WHEN al THEN s.label WHEN kk.slot IS NOT NULL THEN kk.slot ELSE n.label END AS label FROM sl s JOIN al ON s.file = al.file LEFT JOIN kk ON s.file = kk.file AND s.label = kk.label LEFT JOIN nearest n ON s.file = n.file AND s.ord = n.ord"""


def sized(spark, d):
    return emb(spark, d).withColumn("label", F.when(F.col("ord") % 50 < 3, 9).when(F.col("ord") % 50 < 10, 8).otherwise(F.col("label")).cast("long"))


@query("c7_prune_small", SIZED + PRUNED.format(least=5))
def c7(spark, d):
    return vectors.prune_clusters(sized(spark, d), 5)


@query("c8_prune_short", SIZED.replace("SELECT file, ord, x, CASE", 'SELECT file, ord, x, start, "end", CASE').replace("w AS (SELECT file, label, count(*)::DOUBLE AS weight FROM sl GROUP BY ALL), ", """mm AS (SELECT *, max("end") OVER (PARTITION BY file, label ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sl),
w AS (SELECT file, label, sum(greatest(0, "end" - greatest(start, coalesce(before, start)))) AS weight FROM mm GROUP BY ALL), """) + PRUNED.format(least=5))
def c8(spark, d):
    from voxframe.operators import intervals

    e = sized(spark, d)
    said = intervals.merge_by_speaker(e.select("file", F.col("label").alias("speaker"), "start", "end")).groupBy("file", F.col("speaker").alias("label")).agg(F.sum(F.col("end") - F.col("start")).alias("weight"))
    return vectors.prune_clusters(e, 5, said)


@query("c3_gap_threshold", EMB + """, s AS (SELECT file, c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY file) AS n, lead(c) OVER w AS after FROM cos WHERE a < b WINDOW w AS (PARTITION BY file ORDER BY c, a, b)),
g AS (SELECT file, after FROM s WHERE i < n // 2 - 1 AND after > c QUALIFY row_number() OVER (PARTITION BY file ORDER BY after - c DESC, i) = 1)
SELECT file, round(least(0.7::DOUBLE, greatest(0.2::DOUBLE, after)), 6) AS threshold FROM g""")
def c3(spark, d):
    return vectors.gap_thresholds(emb(spark, d)).select("file", six("threshold"))


@query("c10_silhouette", EMB + """, m AS (SELECT file, a, la, lb, avg(greatest(0, 1 - c)) AS d FROM cos GROUP BY ALL),
e AS (SELECT file, a, max(CASE WHEN la = lb THEN d END) AS own, min(CASE WHEN la <> lb THEN d END) AS other FROM m GROUP BY ALL)
SELECT file, round(avg((other - own) / greatest(other, own)), 6) AS silhouette FROM e WHERE own IS NOT NULL AND other IS NOT NULL GROUP BY file""")
def c10(spark, d):
    return vectors.silhouettes(emb(spark, d)).select("file", six("silhouette"))


@query("c17_cohort_stats", EMB + """, s AS (SELECT e.file, e.ord, list_dot_product(e.x, o.x) / sqrt(list_dot_product(e.x, e.x)) / sqrt(list_dot_product(o.x, o.x)) AS c, row_number() OVER (PARTITION BY e.file, e.ord ORDER BY list_dot_product(e.x, o.x) / sqrt(list_dot_product(e.x, e.x)) / sqrt(list_dot_product(o.x, o.x)) DESC) AS n FROM emb e JOIN emb o ON o.ord < 40)
SELECT file, ord, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM s WHERE n <= 10 GROUP BY ALL""")
def c17(spark, d):
    e = emb(spark, d)
    cohort = e.where("ord < 40").select(F.col("ord").alias("id"), "embedding")  # a stated cohort of 40 voices
    return vectors.cohort_statistics(e, cohort, 10).select("file", "ord", six("mean"), six("std"))


@query("c19_split_short", EMB + """SELECT file, ord, CASE WHEN max("end" - start) OVER (PARTITION BY file) >= 2.4 THEN "end" - start >= 2.4 ELSE row_number() OVER (PARTITION BY file ORDER BY "end" - start DESC, ord) = 1 END AS kept FROM (SELECT file, ord, start, CASE WHEN (ord // 50) % 2 = 0 THEN start + 1 ELSE "end" END AS "end" FROM emb)""")
def c19(spark, d):
    e = emb(spark, d).withColumn("end", F.when(F.expr("ord div 50 % 2 = 0"), F.col("start") + 1).otherwise(F.col("end")))
    return vectors.split_short(e, 2.4).select("file", "ord", "kept")


@query("c20_reassign_short", EMB + """, kept AS (SELECT * FROM emb WHERE "end" - start >= 1.5),
km AS (SELECT file, label, list(m ORDER BY i) AS mean FROM (SELECT file, label, i, avg(x[i]) AS m FROM kept, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY ALL), kc AS (SELECT file, label, list_transform(mean, lambda v: v / sqrt(list_dot_product(mean, mean))) AS c FROM km)""" + NEAREST.format(rows="emb", cents="kc") + """SELECT file, ord, label FROM kept UNION ALL SELECT n.file, n.ord, n.label FROM nearest n JOIN emb e ON n.ord = e.ord WHERE e."end" - e.start < 1.5""")
def c20(spark, d):
    return vectors.reassign_short(vectors.split_short(emb(spark, d), 1.5))


@query("c27_local_global", 'SELECT file, speaker AS local, ord % 3 AS global_id, round(sum("end" - start), 6) AS seconds FROM turns WHERE "end" > start GROUP BY ALL')
def c27(spark, d):
    t = derived.turns(spark, d).select("file", F.col("speaker").alias("local"), (F.col("ord") % 3).alias("global_id"), (F.col("end") - F.col("start")).alias("seconds"))
    return sequences.local_global(t).select("file", "local", "global_id", six("seconds"))


def _clustered(name, f):
    @query(name)
    def run(spark, d):
        return clustering.cluster_files(emb(spark, d), f)


A = clustering.Agglomeration
_clustered("c1_ahc", lambda x, s, e: clustering.agglomerate(x, A(0.2), e - s))
_clustered("c2_ahc_ceiling", lambda x, s, e: clustering.agglomerate(x, A(0.3, most=6), e - s))
_clustered("c3_ahc_auto", lambda x, s, e: clustering.agglomerate(x, A(most=10), e - s))
_clustered("c4_ahc_established", lambda x, s, e: clustering.agglomerate(x, A(0.1, members=4), e - s))
_clustered("c5_centroid_euclidean", lambda x, s, e: clustering.centroid_euclidean(x, 1.1))
_clustered("c9_kmeans", lambda x, s, e: clustering.kmeans(x, 4))
_clustered("c11_kmeans_auto", lambda x, s, e: clustering.kmeans_auto(x, 2, 6, 20, 1))
_clustered("c14_spectral", lambda x, s, e: clustering.spectral(x, 10))
_clustered("c15_kmeans_clusterer", clustering.clusterer("kmeans", most=6))
_clustered("c16_min_size", clustering.min_size(clustering.clusterer("ahc", 0.2), 3))
_clustered("c18_domain_profile", clustering.clusterer("ahc", domain="ami"))


@query("c12_laplacian_spectrum")
def c12(spark, d):
    def run(pdf):
        x = np.stack([np.asarray(v, dtype=np.float32) for v in pdf.sort_values("ord")["embedding"]])
        values = np.linalg.eigvalsh(clustering.laplacian(x))
        return pdf[["file"]].head(1).assign(smallest=[values[:5].round(6).tolist()], k=clustering.eigengap(values, 10))

    return emb(spark, d).groupBy("file").applyInPandas(run, "file string, smallest array<double>, k int")


@query("c17_asnorm")
def c17_ahc(spark, d):
    cohort = np.array([r["embedding"] for r in emb(spark, d).where("ord < 40").orderBy("ord").select("embedding").collect()], dtype=np.float32)  # 40 rows
    return clustering.cluster_files(emb(spark, d), clustering.clusterer("asnorm", 1.5, cohort=cohort, top=10))


def made_plda(dim: int = 64, small: int = 32) -> clustering.Plda:
    """A stand-in for trained arrays: random turns of the axes, with falling spread."""
    r = np.random.default_rng(5)
    turn = lambda n: np.linalg.qr(r.standard_normal((n, n)))[0]
    return clustering.Plda(np.zeros(dim), np.zeros(small), turn(dim)[:, :small], np.zeros(small), turn(small), np.linspace(8, 0.5, small))


@query("c21_plda")
def c21(spark, d):
    plda = made_plda()

    def run(batches):
        for b in batches:
            y = plda.apply(np.stack([np.asarray(v, dtype=np.float32) for v in b["embedding"]]))
            yield b[["file", "ord"]].assign(y=[v.round(6).tolist() for v in y])

    return emb(spark, d).select("file", "ord", "embedding").mapInPandas(run, "file string, ord long, y array<double>")


_clustered("c25_vbx", clustering.clusterer("vbx", plda=made_plda()))
_clustered("c26_vbx_windowed", clustering.clusterer("vbx", plda=made_plda(), windowed=True, reconstruct=True))


@query("c28_hungarian_map", """, q AS (SELECT file, speaker % 3 AS l, ord % 3 AS g, sum(ef - sf)::BIGINT AS w FROM turns GROUP BY ALL),
p AS (SELECT f.file, l.l, g.g, coalesce(w, 0) AS w FROM (SELECT DISTINCT file FROM q) f, unnest(range(0, 3)) AS l(l), unnest(range(0, 3)) AS g(g) LEFT JOIN q ON q.file = f.file AND q.l = l.l AND q.g = g.g),
s AS (SELECT a.file, a.g AS g0, b.g AS g1, c.g AS g2, a.w + b.w + c.w AS t FROM p a JOIN p b ON a.file = b.file AND a.g <> b.g JOIN p c ON a.file = c.file AND c.g NOT IN (a.g, b.g) WHERE a.l = 0 AND b.l = 1 AND c.l = 2),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY t DESC) = 1)
SELECT file, l AS local, [g0, g1, g2][l + 1] AS global_id FROM m, unnest(range(0, 3)) AS x(l)""")
def c28(spark, d):
    t = derived.turns(spark, d).select("file", (F.col("speaker") % 3).alias("local"), (F.col("ord") % 3).alias("global_id"), (F.col("ef") - F.col("sf")).cast("double").alias("seconds"))
    return clustering.map_files(t)


@query("a17_cosine_eer", EMB + """, s AS (SELECT round(c, 6) AS score, la = lb AS same FROM cos WHERE a < b), g AS (SELECT score, sum(same::INT) AS pos, sum((NOT same)::INT) AS neg FROM s GROUP BY score),
e AS (SELECT score, (sum(neg) OVER w)::DOUBLE / sum(neg) OVER () AS far, (sum(pos) OVER () - sum(pos) OVER w)::DOUBLE / sum(pos) OVER () AS frr FROM g WINDOW w AS (ORDER BY score DESC))
SELECT 100.0::DOUBLE * ((far + frr) / 2) AS eer FROM e ORDER BY abs(far - frr), score LIMIT 1""")
def a17(spark, d):
    e = emb(spark, d)
    la, lb = e.select(F.col("file").alias("f1"), F.col("ord").alias("oa"), F.col("label").alias("la")), e.select(F.col("file").alias("f2"), F.col("ord").alias("ob"), F.col("label").alias("lb"))
    s = vectors.pairwise_cosines(e).join(la, F.col("a") == F.col("oa")).join(lb, F.col("b") == F.col("ob"))
    return scoring.equal_error_rate(s.select(rounded("cosine", 6).alias("score"), (F.col("la") == F.col("lb")).alias("same")))
