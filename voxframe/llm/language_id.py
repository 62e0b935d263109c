"""Language identification by compression (operator 2).

Method: each language has a zstandard raw-content dictionary cut from labelled texts. A text is
encoded with every dictionary and the language with the smallest encoding is chosen; where the
margin to the next language is narrow, the text is rejected. Texts of over ``PIECE_BYTES`` bytes are
encoded piece by piece, and the sizes summed.

A margin is narrow, at any length of text, if it is under ``LEAST_MARGIN`` bytes or under ``NARROW`` of the
next size. Both were read off labelled rows that are not held out: on sf0.1, the ties (0.7 % of the
documents, nearly all of one to four words) hold most wrong predictions, and wider limits begin to
reject right ones.

Fitting uses a bounded sample: in each of ``BUCKETS`` hash buckets of a language the labelled text
with the least hash gives its first ``SAMPLE_CHARS`` characters, so a dictionary holds at most
BUCKETS * SAMPLE_CHARS characters whatever the size of the table.

Rows: a null text, or one without letters, gives ``und``, score 0 and a rejection; a tie goes to the
language that comes first by name, with score 0 and a rejection; a null id is never held out and
never learned from; without any labelled row every text is ``und``; repeated rows are predicted alike.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import prepare, spare

BUCKETS = 400
SAMPLE_CHARS = 1024
PIECE_BYTES = 8192
LEVEL = 5
#: Reject below so many bytes, or so large a share of the next-best size.
LEAST_MARGIN, NARROW = 1, 0.003
#: ASCII bytes that are no letters become spaces, runs of which are then closed up.
ONLY_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(ONLY_LETTERS).split())


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """One dictionary for each language, from the bounded sample of the labelled rows."""
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.substring(text_col, 1, SAMPLE_CHARS).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where("i is not null and t is not null and t <> '' and l is not null").withColumn("h", F.xxhash64("i"))
    sample = rows.groupBy("l", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.min(F.struct("h", "t")).alias("m")).select("l", "b", "m.t").collect()
    found: dict[str, list[bytes]] = {}
    for lang, _, text in sorted(sample, key=lambda r: (r[0], r[1])):
        found.setdefault(lang, []).append(folded(text))
    return {lang: b" ".join(texts) for lang, texts in found.items() if any(texts)}


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.by_language = []
        for lang, content in sorted(dictionaries.items()):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.by_language.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin as a score from 0 to 1, and whether the text is rejected."""
        if not text or not self.by_language or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = folded(text)
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = sorted((sum(len(encode(p)) for p in pieces), lang) for lang, encode in self.by_language)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        least, second = sizes[0][0], sizes[1][0]
        return sizes[0][1], 1 - least / max(1, second), second - least < max(LEAST_MARGIN, NARROW * second)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and rejected added (as such columns, replaced)."""
    spark = prepare(docs.sparkSession).sparkContext
    shared = spark.broadcast(dictionaries)

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        identifier = Identifier(shared.value)
        for batch in texts:
            yield pd.DataFrame([identifier.predict(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    # Marked so that a later filter on a result isn't pushed below, which would encode every text twice.
    predict = F.pandas_udf(predict, "lang_pred string, score double, rejected boolean").asNondeterministic()
    names, found = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")], spare(docs, "_lid")
    return docs.withColumn(found, predict(F.col(text_col).cast("string"))).select(*names, *[F.col(f"{found}.{c}") for c in ("lang_pred", "score", "rejected")])


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that are not held out."""
    prepare(docs.sparkSession)
    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify(rows, dictionaries).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with a missing lang filled in; all other columns stay, whatever their names."""
    prepare(docs.sparkSession)
    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    known = identify(docs.select(F.struct("*").alias("row")), dictionaries, "row.text")
    filled = [F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return known.where(~F.col("rejected")).select(*filled)
