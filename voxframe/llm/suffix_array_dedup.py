"""Removal of long byte strings that occur elsewhere (operator 8).

Method: merging shard Burrows-Wheeler transforms by interleave refinement. Which strings meet is
settled by anchors (see ``repeats``), and only they enter a merge. The strings around one anchor are
aligned at it, and equal windows have equal places, so the transform goes by place (a positional
transform): at each place it lists the symbols in the order of the suffixes that follow. The symbols of
one anchor's strings count as an alphabet of their own, so that anchors don't mix.

1. The strings are dealt into shards by document, and each shard's transform is built by itself, from
   the last place to the first: the symbols in the present order are the transform, and moving every
   string stably by its symbol (the LF step) gives the order at the place.
2. The merge sees no strings, but only the shards' transforms. It starts with the shards one after the
   other; at each place the interleave is refined: the next symbol of each shard is taken as the
   interleave says, and its entries are moved stably by these symbols. No suffix is sorted again.
3. Common prefixes come with it: neighbours that had equal symbols and lay in one stretch share one
   more than the least of that stretch. A window is a repeated interval where the common prefix with a
   neighbour reaches the width.

Rows: a null text counts as empty; matches never cross documents; texts shorter than the width
lose nothing; repeated rows are documents of their own, so each loses what it shares with its
copy; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.repeats import Shape, covered, repeated_windows

WIDTH, GRAM = 400, 64
#: Strings of a shard, about.
SHARD_ROWS = 512


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), dtype=np.uint8)


def transforms(symbols: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards' transforms and string numbers by place (places x strings), shard after shard in each row.

    symbols: strings x places; shard: the shard of each string. A shard's stretch depends on its own strings only.
    """
    order = np.argsort(shard, kind="stable")
    transform, strings = np.empty(symbols.shape[::-1], dtype=symbols.dtype), np.empty(symbols.shape[::-1], dtype=np.int32)
    for p in range(symbols.shape[1] - 1, -1, -1):
        transform[p] = symbols[order, p]
        order = order[np.lexsort((transform[p], shard[order]))]  # each shard stably by its symbols
        strings[p] = order
    return transform, strings


def interleaves(transform: np.ndarray, shard: np.ndarray, ends: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, interleave, common) from the last place to the first; common[i]: the shared prefix of the entries at i - 1 and i.

    shard: which shard each column of the transforms belongs to; symbols that ``ends`` divides end a string and match nothing.
    """
    n = transform.shape[1]
    interleave, common = shard.copy(), np.zeros(n, dtype=np.int64)
    for p in range(len(transform) - 1, -1, -1):
        symbol = np.empty(n, dtype=transform.dtype)
        symbol[np.argsort(interleave, kind="stable")] = transform[p]  # the shards' next symbols, where the interleave has them
        moved = np.argsort(symbol, kind="stable")
        left, right = moved[:-1], moved[1:]
        near = np.flatnonzero((symbol[left] == symbol[right]) & (symbol[left] % ends > 0))
        after = np.zeros(n, dtype=np.int64)
        if len(near):
            a, b = left[near] + 1, right[near] + 1
            least = np.minimum.reduceat(np.r_[common, 0], np.stack([a, b], axis=1).ravel())[::2]
            after[near + 1] = 1 + np.where(b - a == 1, common[right[near]], least)
        interleave, common = interleave[moved], after
        yield p, interleave, common


def kernel(width: int, gram: int, shard_rows: int = SHARD_ROWS):
    before = width - gram

    def run(strings: list[np.ndarray], rows: pd.DataFrame) -> list[np.ndarray]:
        n = len(strings)
        lead = before - (rows["place"] - rows["first"]).to_numpy()
        size = np.array([len(s) for s in strings])
        group = np.cumsum(np.r_[False, rows["h"].to_numpy()[1:] != rows["h"].to_numpy()[:-1]])
        symbols = np.repeat((group * 257).astype(np.int32)[:, None], before + width, axis=1)
        for i, s in enumerate(strings):
            symbols[i, lead[i] : lead[i] + size[i]] += s.astype(np.int32) + 1
        shard = (pd.util.hash_array(rows["doc_id"].to_numpy(np.int64, na_value=-1)) % np.uint64(-(-n // shard_rows))).astype(np.int16)
        transform, numbers = transforms(symbols, shard)
        flags, dealt = np.zeros((n, before + 1), dtype=bool), np.sort(shard)
        for p, interleave, common in interleaves(transform, dealt, 257):
            if p <= before:
                own = np.empty(n, dtype=np.int32)
                own[np.argsort(interleave, kind="stable")] = numbers[p]
                flags[own, p] = (common >= width) | (np.r_[common[1:], 0] >= width)
        return [flags[i, lead[i] : lead[i] + size[i] - width + 1] for i in range(n)]

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes)."""
    found = repeated_windows(docs, Shape(width, gram, units, False), kernel(width, gram))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, runs in zip(batch["text"], batch["runs"]):
                raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                gone = covered(runs, width, len(raw))
                out.append((len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) > 0).sum()), raw[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(doc_id=batch["doc_id"].astype("Int64"))[["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]]

    return found.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
