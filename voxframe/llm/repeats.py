"""What the two exact repeat finders share: anchors, classes of equal surroundings, and verdicts.

A document is a row of units (bytes, or words by hash). Every window of ``width`` units selects the
anchor in it: the ``gram`` units with the least hash. Equal windows select equal anchors, so only
windows whose anchors agree can be equal, and about one anchor stands for many windows. A row of
work is one anchor with the run of window starts that select it:

1. Anchors with a hash that occurs once end there.
2. Occurrences with equal surroundings (all units of all their windows) form a class; classes are
   counted with partial sums, so a group of copies of any size is one row.
3. Anchors with several classes send one member of each class, with its units, to the operator's
   own kernel, which finds the windows that classes share. A kernel takes up to ``MOST`` classes of an
   anchor. Beyond that (passages in very many different surroundings) the prefix that deals rows out is
   the whole window instead of the anchor: single windows, counted with partial sums. That is as exact, and
   no anchor, however common, has to fit into one task.
4. The verdicts return to the occurrences and, as runs of window starts, to the documents.

Keys that hold over a ``HOT`` th of all rows, of which there are fewer than ``HOT``, are salted in joins, so
that one very common anchor or class is not one task.

Classes are told apart by (anchor's hash, hash of the surroundings), 64 bits each; the surroundings and
single windows are hashed as bytes by XXH3. The anchors' hash is a polynomial: a collision there makes
a group larger but no units equal, as the kernels compare units. Texts are taken ``CHUNK`` windows at
a time, so places fit their bits however long the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import cut, discard, id_and_text, prepare, stored

MOST, HOT, LEAST_HOT, CHUNK = 2000, 1000, 1000, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bits of a place in a document; hashes are compared by the bits above.
PLACE = 28


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int
    units: Callable[[str], np.ndarray]  # the value of each unit of a text, as unsigned integers; their bytes are what is carried
    earlier: bool  # remove only windows that occur earlier; else all that occur elsewhere


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads the bits of a hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Sums:
    """Hashes of any stretch of the units, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.full(n + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.inverse = np.full(n + 1, INVERSE, dtype=np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(values + np.uint64(0x2545F4914F6CDD1D)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def anchors(values: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Arrays place, first, last, h, full: the anchors with their runs of window starts."""
    windows = len(values) - shape.width + 1
    parts = [_anchors(values[start : start + CHUNK + shape.width - 1], shape, start) for start in range(0, windows, CHUNK)]
    return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 5


def _anchors(values: np.ndarray, shape: Shape, begin: int) -> tuple[np.ndarray, ...]:
    from xxhash import xxh3_64_intdigest

    windows = len(values) - shape.width + 1
    sums, span = Sums(values.astype(np.uint64, copy=False)), shape.width - shape.gram + 1
    at = np.arange(len(values) - shape.gram + 1)
    grams = sums.of(at, at + shape.gram)
    key = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    blocks = -(-len(key) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(windows)
    chosen = (np.minimum(behind[start], ahead[start + span - 1]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], windows] - 1
    place, size = chosen[first], values.itemsize
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    full = np.fromiter((xxh3_64_intdigest(raw[a * size : b * size], lead) for a, b, lead in zip(first.tolist(), (last + shape.width).tolist(), (place - first).tolist())), dtype=np.uint64, count=len(first))
    return place + begin, first + begin, last + begin, grams[place].view(np.int64), full.view(np.int64)


def runs(flags: np.ndarray) -> list[list[int]]:
    """[first, last] of each run of True."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [[int(a), int(b) - 1] for a, b in zip(edges[::2], edges[1::2])]


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> list[int]:
    """Hashes of the keys that hold over a ``HOT`` th of ``total`` rows, of which there are fewer than ``HOT``."""
    return [r[0] for r in counted.where(F.col(n) > max(LEAST_HOT, total // HOT)).select(F.xxhash64(*keys)).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: dict[str, str], hot: list[int], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key; left's rows of hot keys are spread over all partitions."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [F.col(a) == F.col(b) for a, b in keys.items()]
    if not hot:
        return left.join(right, on, how)
    spread = F.when(F.xxhash64(*keys).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(F.lit(0))
    copies = F.when(F.xxhash64(*keys.values()).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("salt", spread.cast("int")).join(right.withColumn("salt2", F.explode(copies)), [*on, F.col("salt") == F.col("salt2")], how)


def repeated_windows(docs: DataFrame, shape: Shape, kernel: Callable[[list, pd.DataFrame], list[np.ndarray]]) -> DataFrame:
    """doc_id, text, runs: each document with its runs of removed window starts (an array of arrays).

    kernel(units, rows): for every row of several whole groups (columns h, place, first, last, doc_id,
    th; its units), an array of flags, one for each window, whether it is removed.
    """
    prepare(docs.sparkSession)
    most = MOST
    rows = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.hash("text"))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                doc_ids, hashes, parts = [], [], []
                for doc_id, text, th in zip(*(batch.column(i).slice(start, 500).to_pylist() for i in range(3))):
                    place, first, last, h, full = anchors(shape.units(text), shape)
                    doc_ids += [doc_id] * len(place)
                    hashes += [th] * len(place)
                    parts.append((first << 32 | (place - first) << 16 | (last - first), h, full))
                if doc_ids:
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(hashes, pa.int32()), *(pa.array(np.concatenate(x)) for x in zip(*parts))], ["doc_id", "th", "pos", "h", "full"])

    # Most anchors occur once and end with a count of their hashes alone.
    every = stored(rows.select("doc_id", "text", "th").mapInArrow(find, "doc_id long, th int, pos long, h long, full long"))
    shared = stored(every.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("all")).where("all > 1"))
    hot = hot_keys(shared, ["h2"], "all", every.count())
    found = stored(salted_join(every, shared, {"h": "h2"}, hot, "left_semi").select("doc_id", "th", "pos", "h", "full"))
    discard(every)
    discard(shared)
    occurrence = F.struct("doc_id", "th", "pos")
    counted = stored(found.groupBy("h", "full").agg(F.count(F.lit(1)).alias("n"), F.min(occurrence).alias("least")))
    counts = cut(counted.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("classes")))
    hot = hot_keys(counts, ["h2"], "classes", counted.count())
    classes = stored(salted_join(counted, counts, {"h": "h2"}, hot).select("h", "full", "n", "least", "classes"))
    discard(counted)
    copied = hot_keys(classes, ["h", "full"], "n", found.count())

    # One member of each class of a shared anchor, with its units. All joins with texts are part of one
    # query and have the same key, so that the texts are dealt out once for them together.
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["h", "full", "n", "doc_id", "th", "place", "first", "last", "units"]
        for batch in batches:
            for start in range(0, len(batch), 100):
                part, out = batch.iloc[start : start + 100], []
                for doc_id, text, th, of in zip(part["doc_id"], part["text"], part["th"], part["of"]):
                    values = shape.units(text)
                    for r in of:
                        first, lead, more = r["pos"] >> 32, r["pos"] >> 16 & 0xFFFF, r["pos"] & 0xFFFF
                        out.append((r["h"], r["full"], r["n"], doc_id, th, first + lead, first, first + more, values[first : first + more + shape.width].tobytes()))
                yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    def carried(which) -> DataFrame:
        member = F.struct("h", "full", "n", "least.pos")
        members = classes.where(which).groupBy(F.col("least.doc_id").alias("d"), F.col("least.th").alias("t")).agg(F.collect_list(member).alias("of"))
        schema = "h long, full long, n long, doc_id long, th int, place int, first int, last int, units binary"
        return rows.join(members, same).select("doc_id", "text", "th", "of").mapInPandas(extract, schema).dropDuplicates(["h", "full"])

    kind = shape.units("").dtype.str

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def done(part: pd.DataFrame) -> pd.DataFrame:
            flags = kernel([np.frombuffer(x, dtype=kind) for x in part["units"]], part)
            return pd.DataFrame({"h": part["h"], "full": part["full"], "runs": [runs(f) for f in flags]})

        for batch in batches:  # rows come in the order of h; whole groups are judged together
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) >= most:
                ends = np.flatnonzero(held["h"].to_numpy()[1:] != held["h"].to_numpy()[:-1])
                if len(ends):
                    yield done(held.iloc[: ends[-1] + 1].reset_index(drop=True))
                    held = held.iloc[ends[-1] + 1 :].reset_index(drop=True)
        if held is not None and len(held):
            yield done(held)

    grouped = carried((F.col("classes") > 1) & (F.col("classes") <= most)).repartition("h").sortWithinPartitions("h", "doc_id", "th", "place")
    judged = grouped.mapInPandas(judge, "h long, full long, runs array<array<int>>")

    # Very common anchors: single windows, counted by (anchor, offset from it, hash of the window).
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        size = np.dtype(kind).itemsize
        for batch in batches:
            for h, full, n, doc_id, th, place, first, last, units in zip(*(batch[c] for c in ("h", "full", "n", "doc_id", "th", "place", "first", "last", "units"))):
                raw, at = memoryview(units), np.arange(last - first + 1)
                w = np.fromiter((xxh3_64_intdigest(raw[i * size : (i + shape.width) * size]) for i in range(len(at))), dtype=np.uint64, count=len(at)).view(np.int64)
                yield pd.DataFrame({"h": h, "full": full, "n": n, "doc_id": pd.array([doc_id] * len(at), dtype="Int64"), "th": th, "at": at, "start": at + first, "lead": place - first - at, "w": w})

    single = carried(F.col("classes") > most).mapInPandas(split, "h long, full long, n long, doc_id long, th int, at int, start int, lead int, w long")
    own = F.struct("doc_id", "th", "start")
    seen = single.groupBy(F.col("h").alias("h2"), F.col("lead").alias("lead2"), F.col("w").alias("w2")).agg(F.sum("n").alias("all"), F.min(own).alias("least")).where("all > 1")
    hit = single.join(seen, (F.col("h") == F.col("h2")) & (F.col("lead") == F.col("lead2")) & (F.col("w") == F.col("w2"))).where(own != F.col("least") if shape.earlier else F.lit(True))
    verdicts = judged.unionAll(hit.groupBy("h", "full").agg(F.transform(F.sort_array(F.collect_set("at")), lambda x: F.array(x, x)).alias("runs")))
    verdicts = verdicts.withColumnRenamed("h", "vh").withColumnRenamed("full", "vf")

    known = classes.join(verdicts, (F.col("h") == F.col("vh")) & (F.col("full") == F.col("vf")), "left").select(F.col("h").alias("kh"), F.col("full").alias("kf"), "n", "least", "runs").where("n > 1 or size(runs) > 0")
    first, more = F.shiftright("pos", 32).cast("int"), F.col("pos").bitwiseAND(0xFFFF).cast("int")
    whole = F.array(F.array(first, first + more))
    part = F.transform(F.coalesce("runs", F.array().cast("array<array<int>>")), lambda r: F.array(r[0] + first, r[1] + first))
    all_go = occurrence != F.col("least") if shape.earlier else F.col("n") > 1
    back = salted_join(found, known, {"h": "kh", "full": "kf"}, copied).select("doc_id", "th", F.when(all_go, whole).otherwise(part).alias("r"))
    by_doc = back.where(F.size("r") > 0).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.flatten(F.collect_set("r")).alias("runs"))
    return rows.join(by_doc, same, "left").select("doc_id", "text", "runs")


def covered(runs_: list | None, width: int, size: int) -> np.ndarray:
    """Which of the units are in a window that starts in one of the runs."""
    marks = np.zeros(size + 1, dtype=np.int32)
    if runs_ is not None:
        for first, last in runs_:
            marks[first] += 1
            marks[min(size, last + width)] -= 1
    return np.cumsum(marks[:size]) > 0
