"""Near-duplicate groups of similarity 0.8 or more over five-word shingles, for the pipeline (operator 5).

The similarity of two texts is that of their sets of shingles (shared over all, Jaccard). Two steps:

1. Operator 5's multi-index hashing links 64-bit SimHashes within two bits, and the similarity of
   each match is verified on the whole sets. It finds close copies only: at a similarity of 0.8 two
   SimHashes differ in about 10 bits, which no multi-index over 64 bits can search.
2. An exact prefix filter finds the rest. With all shingles in one fixed order, two sets of similarity
   0.8 share one among the first n - ceil(0.8 n) + 1 of each (their heads). Shingles found often in a
   sample come last in the order, so that heads rarely meet by chance; the sample bears on speed only.

Not all pairs of a group are written out. First each set meets one centre for each shingle of its head;
the components of what is verified then stand for their members, and only pairs of different
components are looked for among sets whose heads meet. Of those, a bitmap filter leaves out pairs that
differ too much: each set has ``BITS`` bits, turned over once for each of its shingles, so that two sets
differ in at least as many shingles as their bitmaps in bits. That says little of long sets, so what is
left is compared by finer bitmaps, of a bit or more for each shingle, before whole sets are read. All
filters are exact: every pair of similarity 0.8 is either verified or inside one component already.

Rows: a null or wordless text has the empty set, which is similar only to itself; fewer than five
words make one shingle; a null id names no group unless no other id is in it; repeated rows are one
document; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, discard, free, id_and_text, prepare, stored
from voxframe.llm.simhash import SEED, components, links, majority, shingle_hashes, words_of

WIDTH, SIMILARITY = 5, 0.8
#: Of the sets, one in SAMPLED is counted, and the MOST_COMMON shingles of those are ordered last.
SAMPLED, MOST_COMMON = 16, 100_000
#: Pairs are compared in cells, that hold their sets.
CELLS, CELL_PAIRS = 1024, 1_000_000
BITS = 256
#: Bits that mark the documents whose sets are compared: 16 MB.
MARKS = 1 << 27


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    return np.unique(shingle_hashes(words_of(text), WIDTH).view(np.int64))


def head(hashes: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, one of which any similar set has among its own."""
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    place = np.where(common[at] == hashes, places[at], 0) if len(common) else np.zeros(len(hashes), dtype=np.int64)
    return hashes[np.lexsort((hashes, place))][: len(hashes) - math.ceil(SIMILARITY * len(hashes) - 1e-9) + 1]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as longs: each is the parity of the shingles that fall on it."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fine_bitmap(hashes: np.ndarray) -> np.ndarray:
    """The same with as many bits as shingles, or more: a power of two, 8 at least."""
    size = max(8, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """The bits that two fine bitmaps differ in, with the larger one folded to the smaller one's size."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _lists(rows: list[np.ndarray]):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _key(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED)


def id_text_prepared(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return id_and_text(docs)


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the distinct texts, sorted, and how often each is found."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()), pa.int64())], ["s"])

    sampled = id_text_prepared(docs).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct().mapInArrow(run, "s long")
    often = sorted((r["s"], r["k"]) for r in sampled.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").orderBy(F.desc("k"), "s").limit(MOST_COMMON).collect())
    return np.array([s for s, _ in often], dtype=np.int64), np.array([k for _, k in often], dtype=np.int64)


def heads(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the set of shingles), n (their number), fp (SimHash), bits, fine, head."""
    shared = docs.sparkSession.sparkContext.broadcast(common(docs))

    def run(batches) -> Iterator:
        import pyarrow as pa

        often, places = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                every = [shingle_hashes(words_of(t.as_py()), WIDTH) for t in batch.column(1)]
                found = [np.unique(x.view(np.int64)) for x in every]
                keys = np.array([_key(x) for x in found], dtype=np.uint64).view(np.int64)
                fps = np.array([majority(x) for x in every], dtype=np.uint64).view(np.int64)
                own = [head(x, often, places) if len(x) else x for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array(fps, pa.int64()), _lists([bitmap(x) for x in found]), pa.array([fine_bitmap(x).tobytes() for x in found], pa.binary()), _lists(own)],
                    ["doc_id", "key", "n", "fp", "bits", "fine", "head"],
                )

    return id_text_prepared(docs).mapInArrow(run, "doc_id long, key long, n int, fp long, bits array<long>, fine binary, head array<long>")


def marked(ids: DataFrame) -> dict[int, bytes]:
    """A bitmap of the ids' hashes, in at most ``MARKS`` / 32768 pieces of 4 KB, whatever the number of ids."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    rows = ids.select(at.alias("p")).groupBy(F.call_function("bitmap_bucket_number", F.col("p")).alias("k")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("p"))).alias("m"))
    return {r["k"]: bytes(r["m"]) for r in rows.collect()}


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """key, shingles (as sorted 32-bit halves of their hashes, packed) of the documents with the ids, and of few more."""
    marks = docs.sparkSession.sparkContext.broadcast(marked(ids))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    rows = id_text_prepared(docs).select("text", F.call_function("bitmap_bucket_number", at).alias("k"), F.call_function("bitmap_bit_position", at).alias("p"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        held = marks.value
        for batch in batches:
            places = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            wanted = [i for i, (k, p) in enumerate(places) if k in held and held[k][p >> 3] >> (p & 7) & 1]
            for start in range(0, len(wanted), 500):
                found = [shingles(batch.column(0)[i].as_py()) for i in wanted[start : start + 500]]
                keys = np.array([_key(x) for x in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.sort(x.astype("<u4")).tobytes() for x in found], pa.binary())], ["key", "shingles"])

    return rows.mapInArrow(run, "key long, shingles binary")


def may_be_similar(x: str, y: str) -> Column:
    """Whether sizes and bitmaps of two sets (n, bits under two prefixes) allow the similarity."""
    sizes, most = F.col(f"n{x}") + F.col(f"n{y}"), (1 - SIMILARITY) / (1 + SIMILARITY)
    differ = sum((F.bit_count(F.get(f"bits{x}", F.lit(i)).bitwiseXOR(F.get(f"bits{y}", F.lit(i)))) for i in range(1, BITS // 64)), F.bit_count(F.get(f"bits{x}", F.lit(0)).bitwiseXOR(F.get(f"bits{y}", F.lit(0)))))
    return (F.least(f"n{x}", f"n{y}") >= SIMILARITY * F.greatest(f"n{x}", f"n{y}") - 1e-9) & (differ <= most * sizes + 1e-9)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def by_simhash(sets: DataFrame) -> DataFrame:
    """a, b: keys whose SimHashes are linked by the multi-index, as links to the least key of a fingerprint."""
    first = sets.groupBy("fp").agg(F.min("key").alias("b"))
    same = sets.select("fp", F.col("key").alias("a")).join(first, "fp").select("a", "b")
    near = links(cut(first).select("fp"))
    ends = [first.select(F.col("fp").alias(f"f{x}"), F.col("b").alias(f"k{x}")) for x in "ab"]
    far = near.join(ends[0], F.col("a") == F.col("fa")).join(ends[1], F.col("b") == F.col("fb"))
    return same.unionAll(far.select(F.col("ka").alias("a"), F.col("kb").alias("b")))


def attributes(sets: DataFrame, x: str) -> DataFrame:
    return sets.select(F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))


def by_centres(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: each set with one set of those that have a shingle of its head in theirs, another one for each shingle."""
    centre = rows.groupBy("s").agg(F.min(F.struct(F.xxhash64("s", "key").alias("h"), "key")).alias("c")).select(F.col("s").alias("cs"), F.col("c.key").alias("b"))
    pairs = rows.select("s", F.col("key").alias("a")).join(centre, (F.col("s") == F.col("cs")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    both = pairs.join(attributes(sets, "a"), F.col("a") == F.col("ka")).join(attributes(sets, "b"), F.col("b") == F.col("kb"))
    return both.where(may_be_similar("a", "b")).select("a", "b")


def between(known: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the sets of different components whose heads meet and that may be similar. known: s, key, root."""
    mixed = known.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("s").alias("ms"))
    known = known.join(mixed, F.col("s") == F.col("ms"), "left_semi")
    a, b = (known.select("s", F.col("key").alias(x), F.col("root").alias(f"root{x}")).join(attributes(sets, x), F.col(x) == F.col(f"k{x}")).drop(f"k{x}") for x in "ab")
    a = a.withColumnRenamed("s", "as")
    return a.join(b, (F.col("as") == F.col("s")) & (F.col("a") > F.col("b")) & (F.col("roota") != F.col("rootb")) & may_be_similar("a", "b")).select("a", "b")


def dealt(pairs: DataFrame) -> DataFrame:
    """cell, a, b: pairs with one leader (the least partner of b) in one cell, so that a set goes to few
    cells; the pairs of a leader with over ``CELL_PAIRS`` in a square of cells, by a and by b."""
    leaders = pairs.groupBy("a").agg(F.min("b").alias("leader")).withColumnRenamed("a", "of")
    led = cut(pairs.join(leaders, F.col("b") == F.col("of"), "left").select("a", "b", F.coalesce("leader", "b").alias("leader")))
    hot = led.groupBy(F.col("leader").alias("hot")).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / CELL_PAIRS)).alias("sides")).where("sides > 1")
    sides = F.coalesce("sides", F.lit(1))
    cell = F.concat_ws(":", F.pmod(F.xxhash64("leader"), F.lit(CELLS)), F.pmod("a", sides), F.pmod("b", sides))
    return led.join(hot, F.col("leader") == F.col("hot"), "left").select(cell.alias("cell"), "a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """at, end: the keys of the pairs in each cell, once."""
    return pairs.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("end")).distinct()


def by_cells(pairs: DataFrame, held: DataFrame, column: str, agree) -> DataFrame:
    """cell, a, b: those of the pairs whose values pass. held: at, key, the column (what the keys of a cell hold)."""

    def run(pairs, held):
        import pyarrow as pa

        own = dict(zip(held.column("key").to_pylist(), (x.as_py() for x in held.column(column))))
        rows = [(c, a, b) for c, a, b in zip(*(pairs.column(i).to_pylist() for i in ("cell", "a", "b"))) if agree(own[a], own[b])]
        return pa.table({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate((("cell", pa.string()), ("a", pa.int64()), ("b", pa.int64())))})

    return pairs.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(run, "cell string, a long, b long")


def fine_may_agree(x: dict, y: dict) -> bool:
    """Whether sizes and fine bitmaps of two sets allow the similarity."""
    if min(x["n"], y["n"]) < SIMILARITY * max(x["n"], y["n"]) - 1e-9:
        return False
    differ = apart(*(np.frombuffer(v["fine"], dtype=np.uint8) for v in (x, y)))
    return differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (x["n"] + y["n"]) + 1e-9


def sets_agree(x: bytes, y: bytes) -> bool:
    """Whether two packed sets reach the similarity."""
    both = np.concatenate([np.frombuffer(v, dtype="<u4") for v in (x, y)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= SIMILARITY * (len(both) - shared) - 1e-9


def similar(docs: DataFrame, by_key: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """a > b: those of the pairs of keys that reach the similarity. by_key: key, least (a document that has the set)."""
    pairs = cut(dealt(cut(ordered(pairs))))
    free(docs.sparkSession)
    fine = sets.select("key", F.struct("n", "fine").alias("fine"))
    pairs = cut(by_cells(pairs, ends(pairs).join(fine, F.col("end") == F.col("key")).select("at", "key", "fine"), "fine", fine_may_agree))
    ids = ends(pairs).select("end").distinct().join(by_key, F.col("end") == F.col("key")).select(F.col("least").alias("doc_id"))
    needed = ends(pairs).join(whole_sets(docs, ids), F.col("end") == F.col("key")).dropDuplicates(["at", "key"]).select("at", "key", "shingles")
    return by_cells(pairs, needed, "shingles", sets_agree).select("a", "b")


def shared_heads(sets: DataFrame) -> DataFrame:
    """key, s: the shingles of the heads, without those that are in one head only."""
    rows = sets.select("key", F.explode("head").alias("s"))
    shared = rows.groupBy(F.col("s").alias("s2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s2")
    return stored(rows.join(shared, F.col("s") == F.col("s2"), "left_semi"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group)."""
    spark = docs.sparkSession
    found = stored(heads(docs))
    by_key = cut(found.groupBy("key").agg(F.min("doc_id").alias("least")))
    sets = stored(found.drop("doc_id").dropDuplicates(["key"]))
    keys = stored(found.select("doc_id", "key"))
    discard(found)
    free(spark)
    rows = shared_heads(sets)
    free(spark)
    near = cut(similar(docs, by_key, sets, by_simhash(sets).unionAll(by_centres(rows, sets))))
    free(spark)
    known = stored(rows.join(components(near), F.col("key") == F.col("node"), "left").select("s", "key", F.coalesce("root", "key").alias("root")))
    discard(rows)
    free(spark)
    far = cut(similar(docs, by_key, sets, between(known, sets)))
    discard(known)
    discard(sets)
    free(spark)
    roots = components(near.unionAll(far))
    rooted = by_key.join(roots, by_key["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.select(F.col("key").alias("_key"), F.col("root").alias("_root")).join(named, F.col("_root") == F.col("root")).select("_key", "component_id")
    out = stored(keys.join(ids, F.col("key") == F.col("_key")).select("doc_id", "component_id"))
    discard(keys)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their group: those with the group's least id; of repeated rows, one."""
    # A key without nulls, so that the join and the removal of repeated rows deal the texts out once.
    key = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null"))
    least = groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key("doc_id").alias("least")).distinct()
    free(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), key("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    return rows.join(least, F.col("id") == F.col("least"), "left_semi").dropDuplicates(["id", "text_hash"]).select("row.*")
