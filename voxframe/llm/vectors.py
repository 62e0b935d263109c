"""What the two vector searches share: shards of vectors, an index for each, blocks of queries.

The candidates are dealt into shards of about ``SHARD_ROWS`` rows; each shard's index is built once
by one task and kept in the checkpoint folder as one binary value. The queries come in blocks of at
most ``BLOCK`` rows, which are broadcast. A block meets the shards in rounds, each ``WIDEN`` times as
many as the last: what a round finds is merged, and the queries' kth scores go on to the next, so
that shards share what others have found. Each round writes the k best of each query to the checkpoint
folder; the last step merges those. The driver holds one block and its kth scores, whatever the table's size.

Vectors of different lengths never meet: a shard holds one length, and answers queries of that length.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import cut, prepare, stored

SHARD_ROWS = 8192
BLOCK, WIDEN = 4096, 8


def usable(vectors: DataFrame, id_col: str, vector_col: str, drop_zero: bool) -> DataFrame:
    """vec_id, vector (array of double) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.where(F.exists("vector", lambda x: x != 0)) if drop_zero else rows


def build_shards(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], object]) -> DataFrame:
    """width, shard, index: one row for each shard."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        index = build(pdf["vec_id"].to_numpy(np.int64), np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vector"]]))
        return pd.DataFrame({"width": [len(pdf["vector"].iloc[0])], "shard": [pdf["shard"].iloc[0]], "index": [pickle.dumps(index, protocol=5)]})

    dealt = rows.withColumn("shard", F.monotonically_increasing_id() % shards).withColumn("width", F.size("vector"))
    return cut(dealt.groupBy("width", "shard").applyInPandas(run, "width int, shard long, index binary"))


def search_blocks(rows: DataFrame, queries: DataFrame, build: Callable, search: Callable, score_type: str, k: int, best_first: bool) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of every query.

    search(index, ids, matrix, bounds) yields (query's place in the block, ids, scores); bounds has each
    query's kth score so far, or is None in the first round.
    """
    spark = prepare(rows.sparkSession)
    indexes = build_shards(rows, build)
    count = indexes.agg(F.max("shard")).first()[0]
    count = 0 if count is None else count + 1
    schema = f"query long, query_id long, vec_id long, score {score_type}"
    number_type = np.float64 if score_type == "double" else np.int64
    order = Window.partitionBy("query").orderBy(F.desc("score") if best_first else F.asc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def answer(index: DataFrame, parts: dict) -> DataFrame:
        shared = spark.sparkContext.broadcast(parts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, blob in zip(batch["width"], batch["index"]):
                    if width not in shared.value:
                        continue
                    at, ids, matrix, bounds = shared.value[width]
                    got = [(at[q], ids[q], i, s) for q, i, s in search(pickle.loads(blob), ids, matrix, bounds)]
                    sizes = [len(g[2]) for g in got]
                    yield pd.DataFrame({
                        "query": np.repeat([g[0] for g in got], sizes).astype(np.int64), "query_id": np.repeat([g[1] for g in got], sizes).astype(np.int64),
                        "vec_id": np.concatenate([np.zeros(0, np.int64), *(g[2] for g in got)]), "score": np.concatenate([np.zeros(0, number_type), *(g[3] for g in got)]),
                    })

        return stored(best(index.mapInPandas(run, schema)).drop("rank"))

    found, stream, number = [], queries.select("vec_id", "vector").toLocalIterator(), 0
    while count and (block := list(islice(stream, BLOCK))):
        own, start = [], 0
        kth: dict[int, float] = {}
        while start < count:
            parts = {}
            for width in {len(r["vector"]) for r in block}:
                at = [i for i, r in enumerate(block) if len(r["vector"]) == width]
                ids, matrix = np.array([block[i]["vec_id"] for i in at], dtype=np.int64), np.array([block[i]["vector"] for i in at], dtype=np.float64)
                parts[width] = (np.array(at) + number, ids, matrix, [kth.get(number + i) for i in at])
            end = max(1, start * WIDEN)
            own.append(answer(indexes.where((F.col("shard") >= start) & (F.col("shard") < end)), parts))
            start = end
            if start < count:
                full = best(reduce(DataFrame.unionAll, own)).where(F.col("rank") == k)
                kth = {r["query"]: r["score"] for r in full.select("query", "score").collect()}  # a block's at most
        found += own
        number += len(block)
    merged = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    return best(merged).select("query_id", "rank", "vec_id", "score")
