"""Removal of word windows that occurred before (operator 10).

Method: prefix-partitioned suffix trees. Suffixes are dealt out by prefixes of variable length: those
of the windows of one anchor form a partition (anchors: see ``repeats``; only suffixes in one
partition can share a window), and where an anchor has too many of them, the prefix is the whole
window. Each partition fits into memory and its subtree is built from the root down, a level of words at a
time: the suffixes of a node are split by their next word into its children, and a node with one
suffix is a leaf and rests. What reaches the window's width with several suffixes is a deep internal node,
and so a repeat: its earliest suffix stays and the others are removed.

Rows: a null text has no words; repeated rows with the same id and text are one document, and each
returns that document's result; of documents with one id but different texts, the smaller text
hash counts as earlier; a null id is the smallest; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.repeats import Shape, covered, repeated_windows

WIDTH, GRAM = 20, 8
#: Words of the memory of hashes.
REMEMBERED = 200_000


class Hashes(dict):
    """Hashes of words, remembered; emptied where the words get too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


_hashes = Hashes()


def units(text: str) -> np.ndarray:
    words = text.encode("utf-8").split()
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def deep_nodes(suffixes: np.ndarray, partition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, node): the suffixes below internal nodes as deep as the width, in their own order, and the nodes' numbers.

    suffixes: one a row, of width words; partition: the number of each suffix's subtree.
    """
    leaves, node = np.arange(len(suffixes)), partition
    for depth in range(-1, suffixes.shape[1]):
        if depth >= 0:  # the children of every node, by the next word
            word = suffixes[leaves, depth]
            order = np.lexsort((word, node))
            starts = np.r_[True, (node[order][1:] != node[order][:-1]) | (word[order][1:] != word[order][:-1])]
            child = np.empty(len(leaves), dtype=np.int64)
            child[order] = np.cumsum(starts)
            node = child
        inner = np.bincount(node)[node] > 1
        leaves, node = leaves[inner], node[inner]
        if not len(leaves):
            break
    return leaves, node


def kernel(width: int):
    def run(sequences: list[np.ndarray], rows: pd.DataFrame) -> list[np.ndarray]:
        sizes = np.array([len(s) - width + 1 for s in sequences])
        suffixes = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, width) for s in sequences])
        partition = np.repeat(np.cumsum(np.r_[False, rows["h"].to_numpy()[1:] != rows["h"].to_numpy()[:-1]]), sizes)
        # Rows come in the order of their occurrence, so a suffix's place in the list is its age.
        leaves, node = deep_nodes(suffixes, partition)
        gone = np.zeros(len(suffixes), dtype=bool)
        gone[leaves] = True
        gone[leaves[np.unique(node, return_index=True)[1]]] = False  # the earliest of each node
        return np.split(gone, np.cumsum(sizes)[:-1])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by one space)."""
    found = repeated_windows(docs, Shape(width, gram, units, True), kernel(width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, runs in zip(batch["text"], batch["runs"]):
                words = text.encode("utf-8").split()
                gone = covered(runs, width, len(words))
                out.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"]).assign(doc_id=batch["doc_id"].astype("Int64"))[["doc_id", "n_words", "n_removed", "kept"]]

    return found.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
