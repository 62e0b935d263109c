"""Recall of planted random tokens by encoding and length, among written tokens that must stay."""

import numpy as np

DOCS = "doc_id long, text string"
CHARS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Least recall by length; as measured, less a margin.
LEAST = {"hex": {32: 0.5, 64: 0.9}, "base32": {32: 0.8, 64: 0.9}, "base36": {20: 0.3, 32: 0.8}, "base62": {20: 0.3, 32: 0.8}, "base64": {32: 0.8, 64: 0.9}}
WRITTEN = ["getUserName2FromServer", "configuration_2024_release", "INTERNATIONALIZATION18N", "chapter12-introduction-to-methods", "DEADBEEF00000000DEADBEEF00000000", "/Users/Shared/Documents/Report2023", "version2024release", "ISO8601TimestampFormatter", "AAAAAAAAAAAAAAAA1111111111111111", "userAccountSettings2Controller", "202411260123456", "1234-5678-9012-3456", "____________1"]


def recall(spark, n=60):
    from voxframe.llm.secrets_scan import digest, scan

    r = np.random.default_rng(11)
    rows, cells = [], {}
    for name, lengths in LEAST.items():
        for length in lengths:
            for _ in range(n):
                cells[len(rows)] = (name, length)
                rows.append("the key is " + "".join(r.choice(list(CHARS[name]), length)) + " here")
    first = len(rows)
    rows += [f"see {w} there" for w in WRITTEN * 20]
    spans = {x["doc_id"]: x["spans"] for x in digest(scan(spark.createDataFrame(list(enumerate(rows)), DOCS))).collect()}
    found = {c: np.mean([f"random:11:{11 + c[1]}" in spans[i].split(",") for i, own in cells.items() if own == c]) for c in cells.values()}
    return found, {rows[i] for i in range(first, len(rows)) if "random" in spans[i]}


def test_recall_by_encoding_and_length(spark):
    found, wrong = recall(spark)
    print(found)
    assert not wrong
    assert {c: x for c, x in found.items() if x < LEAST[c[0]][c[1]]} == {}
