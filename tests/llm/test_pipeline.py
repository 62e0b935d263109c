"""The whole pipeline against a plain version of all its stages."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from voxframe.llm.language_id import Identifier, folded

SECRETS = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})|AKIA[A-Z0-9]{14,}|(?<![0-9a-f])[0-9a-f]{16,}""", re.I)


def corpus():
    r = np.random.default_rng(11)
    voice = {"aa": "abcdefgh", "bb": "ijklmnop"}
    words = {k: ["".join(r.choice(list(a), int(r.integers(3, 8)))) for _ in range(400)] for k, a in voice.items()}
    rows = []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        text = [str(w) for w in r.choice(words[lang], int(r.integers(30, 120)))]
        if i % 10 == 7:
            text.insert(5, "password=abcdefghijklmnop")
        rows.append((i, " ".join(text), lang if i % 4 else None, f"src{i % 3}" if i % 11 else None))
    for i in range(160, 200):  # near copies of the first ones, and exact ones
        text = rows[i - 160][1].split(" ")
        if i % 2:
            text[-1] = "other"
        rows.append((i, " ".join(text), rows[i - 160][2], "src0"))
    return [*rows, (300, None, None, "src1"), (301, "12 34", None, "src1")]


def plain_language(rows):
    sample = {}
    for i, text, lang, _ in rows:
        if lang and text and zlib.crc32(str(i).encode()) % 4 != 2:
            sample.setdefault(lang, []).append((i, text[:1024]))
    return sample


def plain_mix(rows, quality):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    total = Counter()
    for i, _, _, s in rows:
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= sum(3 * total[s] for s in over)
        open_ -= over
    out = []
    for s in names:
        own = [row for row in rows if row[3] == s]
        key = {i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 1) / 16**13) / quality.get(i, 1.0) for i, *_ in own}
        budget, at = round(target[s]), 0
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for i, text, *_ in sorted(own, key=lambda row: (key[row[0]], row[0])):
            part = max(0, min(size[i], rest - at))
            at += size[i]
            out += [(i, text)] * epochs
            if part:
                out.append((i, text if part == size[i] else " ".join(text.split()[:part])))
    return out


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    labels = [(i, int(i % 5 == 0), 0) for i in range(0, 200, 3)]
    spark.createDataFrame([(*row, len(row[1]) if row[1] else None) for row in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    sample = plain_language(rows)
    sizes = {k: [len(folded(t)) for _, t in v] for k, v in sample.items()}
    assert all(len(v) <= 400 for v in sizes.values())
    identifier = Identifier({k: b" ".join(folded(t) for _, t in v) for k, v in sample.items()})
    kept = [row for row in rows if not identifier.predict(row[1])[2]]
    assert 2 <= len(rows) - len(kept) < 10

    sets = {row[0]: {tuple(w[i : i + 5]) for w in (row[1].lower().split(),) for i in range(len(w) - 4)} for row in kept}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if x == hi else x for i, x in root.items()}
    kept = [row for row in kept if root[row[0]] == row[0]]
    assert len(kept) < 165

    kept = [(i, SECRETS.sub("[SECRET]", t), lang, s) for i, t, lang, s in kept]
    mixed = plain_mix(kept, {i: 2.0 if q else 0.5 for i, q, _ in labels})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in mixed)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
