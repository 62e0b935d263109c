"""Near-duplicate groups by SimHash (operator 5).

Method: multi-index hashing. A fingerprint has two 32-bit segments, and a table for each segment holds
the distinct fingerprints by the segment's value. Of two fingerprints that differ in at most two
bits, one segment differs in at most one. So each fingerprint enumerates the ball of radius 1 around
each of its segments, fetches the table's matches, and the complete distance of each is verified. The
ball needs only the values with one more bit set: of two segments, one has the bit that the other lacks.

Buckets of over ``MOST`` fingerprints (near copies that share a segment) would give all pairs of their
members. They are split by the other segment: a member goes to its ball of radius 1 there, and a
fingerprint whose ball reaches the bucket to its own value. All that meet under one such code are
within one bit of it, hence within two of each other, and are linked to the least of them. This
finds the same components, with at most 33 rows a member.

Links join distinct fingerprints only; exact copies share theirs. Components come from repeated
minimum exchange (large star, small star) over the links, each round kept by checkpoint().

Rows: a null or wordless text has fingerprint zero, linked like any other; fewer than three words
make one shingle; repeated rows share their component; a null id is returned, but names no
component unless no other id is in it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, id_and_text, prepare

SEED = 42
WIDTH = 3
RADIUS = 2
SEGMENT_BITS = 32
#: Fingerprints of a bucket that are compared with whatever reaches it; larger buckets are split by the other segment.
MOST = 64


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the word shingles, repeats included; fewer words make one shingle, none make none."""
    from xxhash import xxh64_intdigest

    join = b" ".join
    if len(words) < width:
        return np.array([xxh64_intdigest(join(words), SEED)] if words else [], dtype=np.uint64)
    return np.fromiter((xxh64_intdigest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))), dtype=np.uint64, count=len(words) - width + 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # ASCII case and ASCII white space


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)].astype("<u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash over word shingles; a bit is 1 if it is set in over half of the hashes."""
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def flips(segment: Column) -> Column:
    """The values with one more bit set than a segment."""
    bits = F.array(*[F.lit(1 << bit).cast("long") for bit in range(SEGMENT_BITS)])
    return F.transform(F.filter(bits, lambda m: segment.bitwiseAND(m) == 0), lambda m: segment + m)


def ball(segment: Column) -> Column:
    """The values within one bit of a segment, itself included."""
    return F.transform(F.array(F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(SEGMENT_BITS)]), lambda m: segment.bitwiseXOR(m))


def tables(distinct: DataFrame) -> DataFrame:
    """seg, value, other, fp: each fingerprint under the value of either segment, with the other one."""
    mask = F.lit((1 << SEGMENT_BITS) - 1)
    low, high = F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", SEGMENT_BITS).bitwiseAND(mask)
    both = F.array(F.struct(F.lit(0).alias("seg"), low.alias("value"), high.alias("other")), F.struct(F.lit(1).alias("seg"), high.alias("value"), low.alias("other")))
    return distinct.select("fp", F.explode(both).alias("s")).select("s.seg", "s.value", "s.other", "fp")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """a > b: links that connect all distinct fingerprints (column fp) within the distance."""
    assert radius == 2, "two segments with balls of radius 1 meet at distance 2"
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut(tables(distinct.select("fp").repartition(parts)))
    large = cut(table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("seg", "value"))
    probes = table.select("seg", F.explode(F.concat(F.array("value"), flips(F.col("value")))).alias("value"), "other", "fp", F.col("value").alias("own"))

    held = table.join(large, ["seg", "value"], "left_anti").select("seg", "value", F.col("fp").alias("match"))
    near = probes.join(held, ["seg", "value"]).where((F.col("fp") != F.col("match")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("match"))) <= radius))
    pairs = near.select(F.greatest("fp", "match").alias("a"), F.least("fp", "match").alias("b"))

    inside = table.join(large, ["seg", "value"]).select("seg", "value", F.explode(ball(F.col("other"))).alias("code"), "fp")
    beside = probes.where("own <> value").join(large, ["seg", "value"]).select("seg", "value", F.col("other").alias("code"), "fp")
    met = inside.unionAll(beside).groupBy("seg", "value", "code").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    split = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a > b").select("a", "b")
    return pairs.unionAll(split).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node in the links a > b."""

    def mark(edges: DataFrame):
        """Number and hash sums of the edges, which agree where a round changes nothing."""
        return edges.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(38,0)")) for i in range(2)]).first()

    edges = cut(pairs.select("a", "b").distinct())
    known = mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, large["a"] == least["n"])
        edges = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionAll(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        before, known = known, mark(edges)
        if before == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints = cut(fingerprints(docs))
    by_print = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(by_print.select("fp")))
    rooted = by_print.join(roots, by_print["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).join(named, F.col("_root") == F.col("root")).select("_fp", "component_id")
    ids = cut(ids)  # one row for each distinct fingerprint
    return prints.join(ids, prints["fp"] == F.col("_fp"), "left").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
