"""Token counts with a piece vocabulary and byte fallback (operator 9).

Method: rank-synchronous array merging. The pre-tokens of a batch that are not known yet are held
as one ragged numpy array of symbols. In each round every sequence applies its own lowest-rank
pair (leftmost of equals), all at once, until no sequence has a pair left; the surviving symbols
are counted, a symbol outside the vocabulary with one token for each of its UTF-8 bytes.

Pre-tokens are cut before each run of spaces; no piece of the vocabulary holds a space after
another character (this is asserted), so no merge can cross a cut. Sequences over ``LONG`` symbols go through a heap, alone.

Rows: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted alike; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from voxframe.llm.common import id_and_text, prepare

SPACE = "▁"
LONG = 512
NO_RANK = np.int64(1) << 40
CACHE_WORDS = 300_000
#: A large odd number, for multiplicative hashing.
HASH = 0x9E3779B97F4A7C15


class PieceCounter(dict):
    """As a mapping, it gives the token count of a pre-token."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        super().__init__()
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(library.get_piece_size()) if not (library.is_unknown(i) or library.is_control(i) or library.is_byte(i) or library.is_unused(i))]
        pieces = [library.id_to_piece(i) for i in ids]
        scores = [library.get_score(i) for i in ids]
        self.order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.symbol = {p: n for n, p in enumerate(pieces)}
        self.rank = [self.order[s] for s in scores]
        self.known = len(pieces)
        # Every way to build a piece from two symbols, as sorted arrays for lookups in bulk.
        table: dict[int, int] = {}
        for p, whole in self.symbol.items():
            for cut in range(1, len(p)):
                left, right = self.number(p[:cut]), self.number(p[cut:])
                if left is not None and right is not None:
                    table[left << 32 | right] = whole
        self.pairs = table
        self.shift = 64 - 20
        self.slot_key, self.slot_made = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=np.int64)
        for key, whole in table.items():  # open addressing, under a tenth full
            at = (key * HASH & (1 << 64) - 1) >> self.shift
            while self.slot_key[at] >= 0:
                at = at + 1 & (1 << 20) - 1
            self.slot_key[at], self.slot_made[at] = key, whole
        assert len(table) < 100_000, "too many pairs for the table"
        self.rank_of = np.array(self.rank, dtype=np.int64)
        assert not any(SPACE in p.lstrip(SPACE) for p in pieces), "a piece holds a space after a letter"
        self.split = regex.compile(f"{SPACE}+[^{SPACE}]*").findall
        # Nor does a piece hold one of these marks after a letter, so words are cut there as well.
        after_letter = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(c for c in string.punctuation if c not in after_letter)
        self.cut = regex.compile(rf"(?V1)(?<=\p{{L}})(?=[{regex.escape(marks, special_only=False)}])").split if marks else lambda w: [w]
        self.counts: dict[str, int] = {}

    def number(self, s: str) -> int | None:
        """The symbol of a string: a piece, or a lone character outside the vocabulary."""
        return self.symbol.get(s, self.known + ord(s) if len(s) == 1 else None)

    def learn(self, words: set[str]) -> None:
        """Count all of these pre-tokens together, and keep them until the next call at least."""
        if len(self) > CACHE_WORDS:  # what this batch needs stays
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(kept)
        words = [w for w in words if w not in self and len(w) < LONG]
        parts = [self.cut(SPACE + w) for w in words]
        if len(self.counts) > CACHE_WORDS:
            self.counts.clear()
        unknown = list({p for ps in parts for p in ps}.difference(self.counts))
        for start in range(0, len(unknown), 50_000):
            part = unknown[start : start + 50_000]
            self.counts.update(zip(part, self.merged(part).tolist()))
        get = self.counts.__getitem__
        self.update(zip(words, [sum(map(get, ps)) for ps in parts]))

    def symbols(self, text: str) -> np.ndarray:
        get, known = self.symbol.get, self.known
        return np.fromiter((get(c, known + ord(c)) for c in text), dtype=np.int64, count=len(text))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where there is none."""
        key = left << 32 | right
        at = ((key.view(np.uint64) * np.uint64(HASH)) >> np.uint64(self.shift)).view(np.int64)
        found = self.slot_key[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << 20) - 1
            found[open_] = self.slot_key[at[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        made = self.slot_made[at]
        return np.where(found == key, self.rank_of[made], NO_RANK), made

    def weights(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens of each symbol: 1, or its UTF-8 bytes where it is no piece."""
        cp = symbols - self.known
        return np.where(cp < 0, 1, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))

    def merged(self, words: list[str]) -> np.ndarray:
        size = np.array([len(w) for w in words], dtype=np.int64)
        counts = np.zeros(len(words), dtype=np.int64)
        sym, row = self.symbols("".join(words)), np.repeat(np.arange(len(words)), size)
        if not len(sym):
            return counts
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), dtype=np.int64)  # of the pair that starts at each symbol
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside], made[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            ended = best >= NO_RANK
            if ended.any():  # what no pair can shrink further is counted and leaves
                gone = np.repeat(ended, length)
                counts += np.bincount(row[gone], weights=self.weights(sym[gone]), minlength=len(words)).astype(np.int64)
                sym, row, rank, made = sym[~gone], row[~gone], rank[~gone], made[~gone]
                if not len(sym):
                    break
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                best, length = best[~ended], length[~ended]
            low = np.flatnonzero(rank == np.repeat(best, length))
            low = low[np.r_[True, row[low[1:]] != row[low[:-1]]]]  # the leftmost of each sequence
            sym[low] = made[low]
            keep = np.ones(len(sym), dtype=bool)
            keep[low + 1] = False
            at = low - np.arange(len(low))  # where the merged symbols stand afterwards
            sym, row, rank, made = sym[keep], row[keep], rank[keep], made[keep]
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            rank[changed] = NO_RANK
            changed = changed[changed + 1 < len(sym)]
            changed = changed[row[changed] == row[changed + 1]]
            rank[changed], made[changed] = self.pair_ranks(sym[changed], sym[changed + 1])
        return counts

    def __missing__(self, word: str) -> int:
        """Of a long pre-token, which is not kept."""
        return sum(self.alone(p) for p in self.cut(SPACE + word))

    def alone(self, word: str) -> int:
        if len(word) <= LONG:
            return int(self.merged([word])[0])
        parts, pairs, rank = self.symbols(word).tolist(), self.pairs, self.rank
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(rank[m], i, k) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (m := pairs.get(k := a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= len(parts) or parts[i] << 32 | parts[j] != k:
                continue
            parts[i], parts[j], after[i] = pairs[k], -1, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (m := pairs.get(k := parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (rank[m], a, k))
        return int(self.weights(np.array([x for x in parts if x >= 0], dtype=np.int64)).sum())

    def words(self, text: str) -> list[str]:
        """Pre-tokens without their leading space, which each of them has."""
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " ":
            return text.split(" ")
        return [w[1:] for w in self.split(SPACE + text.replace(" ", SPACE))]


_loaded: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        pieces = counter(vocabulary)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            n_tokens: list[int] = []
            start = 0
            while start < len(texts):  # groups of texts of a few MB, so that memory stays bounded
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) < 2_000_000):
                    size += len(texts[end])
                    end += 1
                words = [pieces.words(t) for t in texts[start:end]]
                pieces.learn(set().union(*words))
                n_tokens += [sum(map(pieces.__getitem__, w)) for w in words]
                start = end
            n_bytes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
