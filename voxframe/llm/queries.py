"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.bpe_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.ann_forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_secrets_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.secrets_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.suffix_array_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe.llm.substring_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_ann_forest": op6_ann_forest,
    "op7_secrets_scan": op7_secrets_scan,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op4_mixing": r"""
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             -ln((('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496) / CASE WHEN q = 1 THEN 2.0::DOUBLE WHEN q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
      FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(3 * sum(source_size) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
      FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - capped)::DOUBLE / open_weight AS level FROM f),
h AS (SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM g WHERE 3 * source_size > level * weight),
t AS (SELECT source, source_size, CASE WHEN h.level IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, h.level * weight) END AS target FROM g LEFT JOIN h ON true),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - start)) END::BIGINT AS taken FROM p""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS x(i)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM s),
g AS (SELECT DISTINCT doc_id, i + j AS at FROM n, unnest(range(0, 20)) AS y(j) WHERE nth > 1),
u AS (SELECT doc_id, i AS at, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS z(i)),
k AS (SELECT u.doc_id, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY u.at) FILTER (WHERE g.at IS NULL) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.at = g.at GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
}
