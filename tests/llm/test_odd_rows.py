"""Nulls, empty tables, repeated rows, very long texts and clashing column names in the operators that stages call."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lid string, cut_text_ string, row string, base string, tokens string, h long, doc_ids long"
WORDS = "the river runs past an old mill where the miller keeps his seven grey cats and one very loud dog".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "a", "b", "c", "d", "e", 1, 2) for i, t in rows], SCHEMA)


def stages():
    import public_tokenizers
    from voxframe.llm.bpe_codec import encode_documents
    from voxframe.llm.language_id import keep_identified
    from voxframe.llm.mixing import mixture
    from voxframe.llm.near_copies import keep_one
    from voxframe.llm.secrets_scan import mask_secrets

    return {"language": keep_identified, "dedup": keep_one, "secrets": mask_secrets, "mixing": mixture, "encoding": lambda d: encode_documents(d, public_tokenizers.path("byte_bpe_50k.json"))}


@pytest.mark.parametrize("name", ["language", "dedup", "secrets", "mixing", "encoding"])
def test_empty_tables_and_clashing_names(spark, name):
    f = stages()[name]
    text = " ".join(WORDS)
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, " ".join(reversed(WORDS))), (4, "ß" * 50_000), (5, "key AKIA" + "Q" * 20)]
    out = f(table(spark, rows))
    assert out.columns == (["doc_id", "n_tokens", "ids", "decodes"] if name == "encoding" else table(spark, []).columns)
    got = out.collect()
    ids = sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x or 0))
    if name == "encoding":
        assert len(got) == len(rows) and all(r["decodes"] for r in got)
    elif name == "dedup":
        assert ids == [None, 1, 2, 4, 5]  # of the null and the empty text one stays
    elif name == "secrets":
        assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 5} == {"key [SECRET]"}
    elif name == "mixing":
        assert {r["doc_id"] for r in got} <= {None, 1, 4, 5} and all(r["text"] for r in got)
    if name != "encoding":
        assert all((r["_lid"], r["cut_text_"], r["row"], r["base"], r["h"]) == ("a", "b", "c", "d", 1) for r in got)
    assert f(table(spark, [])).count() == 0


def test_language_rejects_ties_at_any_length():
    from voxframe.llm.language_id import Identifier

    both = Identifier({"aa": b"alpha beta gamma " * 40, "bb": b"alpha beta gamma " * 40})
    for text in ("alpha", "alpha beta " * 300):
        lang, score, rejected = both.predict(text)
        assert (lang, score, rejected) == ("aa", 0.0, True)


def test_language_equals_a_plain_version(spark):
    import zlib

    import numpy as np
    import zstandard
    from voxframe.llm.language_id import BUCKETS, LEVEL, SAMPLE_CHARS, fit, folded, held_out, language_id

    r = np.random.default_rng(3)
    voice = {k: ["".join(r.choice(list(a), 5)) for _ in range(80)] for k, a in (("xx", "abcdefg"), ("yy", "defghij"))}
    docs = spark.createDataFrame([(i, " ".join(r.choice(voice[k], int(r.integers(1, 60)))), k if i % 5 else None) for i in range(200) for k in (("xx", "yy")[i % 2],)], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.collect()
    learned = {k: {w for x in rows if x["lang"] == k and zlib.crc32(str(x["doc_id"]).encode()) % 4 != 2 for w in x["text"].split()} for k in voice}
    assert all(set(d.decode().split()) <= learned[k] and len(d) <= BUCKETS * SAMPLE_CHARS for k, d in dictionaries.items())
    expected = {}
    for x in rows:
        sizes = {}
        for k, d in dictionaries.items():
            held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            sizes[k] = len(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(folded(x["text"])))
        expected[x["doc_id"]] = min(sorted(sizes), key=sizes.get)
    assert {x["doc_id"]: x["lang_pred"] for x in language_id(docs).collect()} == expected


def test_very_long_tokens_and_many_secrets(spark):
    import random
    import time

    from voxframe.llm.secrets_scan import digest, mask_secrets, scan

    r = random.Random(1)
    long_ = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300_000))
    many = " ".join(f"{r.getrandbits(64):016x}" for _ in range(3000))
    docs = table(spark, [(1, f"a {long_} b"), (2, many)])
    began = time.time()
    found = {x["doc_id"]: x for x in digest(scan(docs)).collect()}
    assert found[1]["spans"] == "random:2:300002" and found[2]["n_hex"] == 3000
    assert {x["doc_id"]: x["text"] for x in mask_secrets(docs).collect()} == {1: "a [SECRET] b", 2: " ".join(["[SECRET]"] * 3000)}
    assert time.time() - began < 120


def test_added_spans_equal_a_plain_battery(spark):
    """p-values of the battery against their formulas, written out again in plain Python."""
    import math
    import random

    from pyspark.sql import functions as F
    from voxframe.llm.secrets_scan import ALPHABETS, battery

    def cdf(z):
        return 1 / (1 + math.exp(-1.5976 * z - 0.07056 * z**3))

    r = random.Random(7)
    tokens = [("base64", "".join(r.choice(ALPHABETS["base64"]) for _ in range(n)) + "aZ9+") for n in (20, 60)] + [("hex", "".join(r.choice(ALPHABETS["hex"]) for _ in range(40)) + "A1")]
    rows = spark.createDataFrame([(t,) for _, t in tokens], "t string").select("t", battery(F.col("t")).alias("p")).collect()
    for (kind, token), row in zip(tokens, rows):
        x, size, n = [ALPHABETS[kind].index(c) for c in token], len(ALPHABETS[kind]), len(token)
        chi = sum(x.count(k) ** 2 for k in range(size)) * size / n - n
        free = size - 1
        z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
        high = [v >= size / 2 for v in x]
        m = sum(high) * (n - sum(high))
        z_runs = (sum(a != b for a, b in zip(high, high[1:])) - 2 * m / n) / math.sqrt(2 * m * (2 * m - n) / (n * n * (n - 1)))
        mean = sum(x) / n
        z_serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / sum((a - mean) ** 2 for a in x) * math.sqrt(n)
        expected = min(1, 3 * min(1 - cdf(z_chi), 2 * (1 - cdf(abs(z_runs))), 2 * (1 - cdf(abs(z_serial)))))
        assert row["p"]["n"] == n and row["p"]["p_uniform"] == pytest.approx(expected, rel=1e-9, abs=1e-12)
