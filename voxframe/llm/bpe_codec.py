"""Byte-pair encoding and decoding with a byte-level vocabulary (operator 3).

Method: contiguous rank array. A short word is held as a list of part boundaries with the rank of
each adjacent pair beside it; the lowest rank is found by scanning, its right boundary is deleted,
and the ranks of the two neighbouring pairs are refreshed. Words over ``LONG_WORD`` bytes go
through a linked list and a heap, which gives the same merges in n log n steps.

Rows: a null text counts as the empty text (no ids); repeated rows are encoded alike; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxframe.llm.common import id_and_text, prepare

#: Fixed value: the split pattern of byte-level BPE with this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: characters whose class differs between Unicode versions of the two regex engines.
UNSURE = r"[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U000107bb-\U0010ffff]"
LONG_WORD = 96
NO_RANK, ID_MASK = 1 << 60, 0xFFFF
#: Words and spaced pieces that a worker remembers (of each, once to twice as many).
CACHE_WORDS = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Remembered(dict):
    """A mapping that computes what it lacks and keeps the last one to two times ``most`` entries."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONG_WORD:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """Encoder and decoder for the vocabulary in one file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        assert max(vocab.values()) <= ID_MASK, "ids over 16 bits"
        #: (left id, right id) -> rank and merged id in one number, so that the least is the lowest rank
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left] << 16 | vocab[right]] = rank << 16 | vocab[left + right]
        self.of_byte = [vocab[c] for c in byte_letters()]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.split = regex.compile(SPLIT).findall
        self.unsure = regex.compile(UNSURE).search
        self.at_run = regex.compile(r" \s|\s ").search
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._library = None
        self.of_word = Remembered(self.packed, CACHE_WORDS).__getitem__
        self.of_spaced = Remembered(self.spaced, CACHE_WORDS).__getitem__

    def words(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self.split(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False).pre_tokenize_str
        return [text[a:b] for _, (a, b) in self._library(text)]

    def packed(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = array("I", self.merged(raw) if len(raw) <= LONG_WORD else self.merged_long(raw))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def spaced(self, piece: str) -> bytes:
        """Ids of a piece between single spaces, with the space before it."""
        if self.unsure(piece) is None:
            if piece.isalpha():
                return self.packed(" " + piece)
            if piece[:-1].isalpha() and piece[-1] in ",.;:!?":
                return self.of_spaced(piece[:-1]) + self.of_word(piece[-1])
        return b"".join(map(self.of_word, self.words(" " + piece)))

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one word. ranks[i] belongs to the parts i and i + 1."""
        get = self.pairs.get
        parts = [self.of_byte[b] for b in raw]
        ranks = [get(a << 16 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            parts[i] = made = low & ID_MASK
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 16 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 16 | made, NO_RANK)
        return parts

    def merged_long(self, raw: bytes) -> list[int]:
        """The same merges for a long word, from a heap over a linked list of parts."""
        get, parts = self.pairs.get, [self.of_byte[b] for b in raw]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(low, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (low := get(a << 16 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= len(parts) or get(parts[i] << 16 | parts[j]) != low:
                continue
            parts[i], parts[j], after[i] = low & ID_MASK, -1, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (low := get(parts[a] << 16 | parts[b])) is not None:
                    heapq.heappush(heap, (low, a))
        return [x for x in parts if x >= 0]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings.

        A split word never runs on into a space between two characters that are no white space, so a
        text can be taken apart at such spaces and whole spaced pieces remembered; where white space
        of any kind touches a space, one word may hold both, which needs the full pattern.
        """
        if self.at_run(text):
            return b"".join(map(self.of_word, self.words(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.of_word, self.words(first))) + b"".join(map(self.of_spaced, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, special strings as their own ids."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if x in self.special else self.plain(x) for x in self.at_special.split(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every whole text, and whether the ids decode to it."""
    prepare(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        bpe = codec(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, 250):  # so that ids in memory stay few
                batch = whole.slice(start, 250)
                texts = [t.as_py() or "" for t in batch.column(1)]
                ids = [np.frombuffer(bpe.encode(t), dtype="<u4").astype(np.int32) for t in texts]
                same = [bpe.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                sizes = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decodes"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decodes boolean")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give the empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [bpe.decode(list(x) if x is not None else []) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens and digests of ids and decoded text."""
    prepare(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        bpe = codec(vocabulary)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                packed = bpe.encode(text.as_py() or "")
                counts.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                decoded = bpe.decode(np.frombuffer(packed, dtype="<u4").tolist())
                text_hex.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
