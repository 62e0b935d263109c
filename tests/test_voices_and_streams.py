"""Clustering on planted groups, frames against loops, streams against their batch twin, binary files."""

import random
import struct

import numpy as np
import pytest

from voxframe.operators import clustering, segmentation
from voxframe.sources import binary
from voxframe.streaming.presets import PRESETS, SpeechParams, StreamParams, preset
from voxframe.streaming.state import Diarizer, SpeakerCache, SpeechTracker, WindowBuffer


def planted(n=60, k=3, dim=32, seed=1):
    r = np.random.default_rng(seed)
    labels = np.arange(n) % k
    return (np.eye(dim)[labels] + 0.05 * r.standard_normal((n, dim))).astype(np.float32), labels


@pytest.mark.parametrize("f", [
    lambda x: clustering.agglomerate(x, clustering.Agglomeration(0.5)), lambda x: clustering.agglomerate(x), lambda x: clustering.centroid_euclidean(x, 0.8),
    lambda x: clustering.kmeans_auto(x, 2, 6, 50, 2), lambda x: clustering.spectral(x, 8), lambda x: clustering.agglomerate(x, clustering.Agglomeration(0.99, most=3)),
])
def test_planted_groups_are_found(f):
    x, labels = planted()
    got = f(x)
    assert len(set(got.tolist())) == 3 and len(set(zip(got.tolist(), labels.tolist()))) == 3


def slow_agglomerate(x, threshold):
    groups, cent = [[i] for i in range(len(x))], [v for v in clustering.normalized(x)]
    while len(groups) > 1:
        sim = clustering.cosines(np.stack(cent), np.stack(cent))
        pairs = [(sim[i, j], -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        best, i, j = max(pairs)
        if best < threshold:
            break
        i, j = -i, -j
        total = len(groups[i]) + len(groups[j])
        cent[i] = clustering.normalized((cent[i] * np.float32(len(groups[i]) / total) + cent[j] * np.float32(len(groups[j]) / total))[None])[0]
        groups[i] += groups[j]
        del groups[j], cent[j]
    out = np.zeros(len(x), dtype=int)
    for g in groups:
        out[g] = min(g)
    return clustering.canonical(out)


def test_agglomeration_equals_a_slow_one():
    r = np.random.default_rng(3)
    for n in (2, 7, 25):
        x = clustering.normalized(r.standard_normal((n, 6)).astype(np.float32))
        assert (clustering.agglomerate(x, clustering.Agglomeration(0.3)) == slow_agglomerate(x, 0.3)).all()


def test_established_clusters_stay_apart():
    x, _ = planted(20, 2)
    x = (x + 0.9).astype(np.float32)
    assert len(set(clustering.agglomerate(x, clustering.Agglomeration(-1.0)).tolist())) == 1
    assert len(set(clustering.agglomerate(x, clustering.Agglomeration(-1.0, members=5)).tolist())) == 2


def test_variational_bayes_finds_speakers():
    r = np.random.default_rng(2)
    centres = 3 * r.standard_normal((3, 16))
    labels = np.repeat([0, 1, 2], 30)
    y = centres[labels] + 0.4 * r.standard_normal((90, 16))
    start = np.arange(90) // 10  # too many
    for loop in (0.0, 0.9):
        gamma, pi = clustering.variational_bayes(y, np.full(16, 9.0), start, clustering.Vbx(fa=1.0, fb=4.0, loop=loop))
        got = clustering.hard_labels(gamma)
        assert np.allclose(gamma.sum(axis=1), 1) and pi.sum() == pytest.approx(1)
        assert len(set(got.tolist())) == 3 and len(set(zip(got.tolist(), labels.tolist()))) == 3


def test_mapping_and_repair():
    assert clustering.map_locals({(0, 5): 9.0, (0, 6): 8.0, (1, 5): 7.0}) == {0: 6, 1: 5}
    assert clustering.map_locals({(0, 5): 9.0, (1, 5): 3.0}) == {0: 5, 1: 5}
    assert clustering.map_locals({(0, 5): 9.0, (1, 5): 3.0, (1, 6): 1.0}, [(0, 1)]) == {0: 5, 1: 6}
    x = np.eye(3, dtype=np.float32)[[0, 0, 1, 0, 1]]
    assert clustering.repair_windows(np.array([0, 0, 1, 2, 2]), x, np.array([0, 0, 1, 0, 1])).tolist() in ([0, 1, 1, 0, 1], [1, 0, 1, 0, 1])


def test_regions_equal_the_tracker(spark):
    r = random.Random(6)
    rows, expected = [], []
    for f in range(12):
        tracker = SpeechTracker(0.5, 2)
        for i in range(50):
            p = float("nan") if r.random() < 0.1 else r.random()
            rows.append((str(f), i, p))
            event = tracker.step(p, i)
            expected += [(str(f), *event[1:])] if event and event[0] == "end" else []
        event = tracker.flush(50)
        expected += [(str(f), *event[1:])] if event else []
    got = segmentation.speech_regions(spark.createDataFrame(rows, "file string, frame long, prob double"), 0.5, 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(e for e in expected if e[2] - e[1] >= 3)


def test_windows_are_numbered_alike(spark):
    classes = [1, 1, 2, 2, 1, 1, 3, 3]
    swap = {1: 2, 2: 1, 3: 3}
    rows = [("f", 0, 0.0, i, c) for i, c in enumerate(classes[:6])] + [("f", 1, 0.25, i, swap[c]) for i, c in enumerate(classes[2:])]
    got = segmentation.window_permutations(spark.createDataFrame(rows, "file string, win long, start double, frame long, cls int"), 0.125)
    assert {r["win"]: r["perm"] for r in got.collect()} == {0: [0, 1, 2], 1: [1, 0, 2]}


def test_window_buffer():
    b = WindowBuffer(4, 2)
    b.extend(np.arange(7, dtype=np.float32))
    assert [b.pop()[0], b.pop()[0], b.pop()] == [0, 2, None]
    start, rest = b.flush()
    assert (start, rest.tolist()) == (4, [4, 5, 6, 0]) and b.flush() is None
    for bad in ((0, 1), (1, 0), (1, 2)):
        with pytest.raises(ValueError):
            WindowBuffer(*bad)


def test_speakers_in_the_order_of_arrival():
    c, e = SpeakerCache(2, 0.5, 2, 0.05), np.eye(4, dtype=np.float32)
    assert [c.assign(e[i])[0] for i in (0, 1, 0)] == [0, 1, 0]
    assert c.assign(e[0])[2] and c.assign(e[3])[3] and len(c.speakers) == 2
    assert c.evict() == 0 and c.assign(e[0])[0] == 2 and c.assign(e[1])[0] == 1


def test_a_stream_gives_the_rows_of_its_batch_twin(spark, tmp_path):
    from voxframe.streaming.jobs import batch_turns, stream_turns

    def made():
        return Diarizer(StreamParams(0.1, 0.05, 0.0, 4, 2, 0.05), SpeechParams(80, 8000, 0.5, 20.0, 0.02), lambda x: float(np.abs(x).max()), lambda x: np.abs(np.fft.rfft(x))[:32].astype(np.float32))

    r = np.random.default_rng(1)
    schema = "file string, seq long, samples array<float>"
    parts = [[(f, s, (np.sin(np.arange(n := int(r.integers(50, 900))) * (0.2 if (s + len(f)) % 5 < 3 else 1.1)) * (s % 4 != 3)).astype(np.float32).tolist()) for f in ("a", "bb") for s in range(3 * i, 3 * i + 3)] for i in range(4)]
    parts[-1] += [(f, 99, None) for f in ("a", "bb")]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_turns(stream, made).writeStream.format("memory").queryName("turns_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    expected = sorted(map(tuple, batch_turns(spark.createDataFrame([x for p in parts for x in p], schema), made).collect()))
    assert len(expected) > 4 and sorted(map(tuple, spark.table("turns_out").collect())) == expected


def test_presets():
    assert preset(" Realtime ") is PRESETS["realtime"] and PRESETS["accurate"].latency(16000, 512) == pytest.approx(2.282)
    for bad in (dict(hop_s=2.0), dict(window_s=float("nan")), dict(threshold=1.5), dict(most_speakers=0)):
        with pytest.raises(ValueError):
            StreamParams(**{"window_s": 1.0, "hop_s": 0.5, "right_s": 0.0, "most_speakers": 4, "hits_to_stable": 2, "margin": 0.1, **bad})
    with pytest.raises(ValueError):
        preset("none")


def wav(data, channels, bits, kind=1, rate=16000):
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data


def test_wav(spark, tmp_path):
    x = np.array([0, 16384, -32768, 8192], dtype="<i2")
    assert binary.wav_samples(wav(x.tobytes(), 1, 16))[0].tolist() == [0, 0.5, -1, 0.25]
    assert binary.wav_samples(wav(x.tobytes(), 2, 16))[0].tolist() == [0.25, -0.375]
    assert binary.wav_samples(wav(bytes([0, 0, 0x40, 0, 0, 0x80]), 1, 24))[0].tolist() == [0.5, -1]
    assert binary.wav_samples(wav(bytes([128, 192]), 1, 8))[0].tolist() == [0, 0.5]
    assert len(binary.wav_samples(wav(b"", 1, 16))[0]) == 0
    with pytest.raises(ValueError):
        binary.wav_samples(wav(b"\0\0", 1, 16, kind=6))
    (tmp_path / "a.wav").write_bytes(wav(x.tobytes(), 1, 16))
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [list(r["samples"]) for r in binary.read_wav(spark, str(tmp_path), 16000).collect()] == [[0, 0.5, -1, 0.25]]
    tone = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert np.abs(binary.resample(tone, 8000, 16000)[::2] - tone).max() < 1e-3


def test_npy_and_artifacts(spark, tmp_path):
    import hashlib

    x = np.arange(6, dtype="<f4").reshape(2, 3)
    np.save(tmp_path / "x.npy", x)
    raw = (tmp_path / "x.npy").read_bytes()
    assert (binary.npy_array(raw, 2) == x).all() and binary.npy_array(raw).shape == (6,)
    for bad in (raw[:-1], raw[:-4], b"no"):
        with pytest.raises(ValueError):
            binary.npy_array(bad, 2)
    assert [r["values"] for r in binary.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == x.tolist()
    assert binary.artifact(spark, str(tmp_path / "x.npy"), hashlib.sha256(raw).hexdigest()) == raw
    with pytest.raises(ValueError):
        binary.artifact(spark, str(tmp_path / "x.npy"), "0" * 64)


def test_masks_and_filter_banks():
    x = np.ones(100, dtype=np.float32)
    assert segmentation.mask_samples(x, np.array([True, False]), 100, 1.0).sum() == 50
    assert len(segmentation.crop_masked(x, np.array([False, True, False, True, False]), 100, 1.0)) == 60
    assert segmentation.crop_masked(x, np.array([False]), 100, 1.0).size == 0
    bank = segmentation.filter_bank(np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000))
    assert bank.shape == (98, 80) and len(segmentation.filter_bank(np.zeros(100))) == 0
    assert abs(segmentation.mel_filters(16000, 80, 512)[int(bank.mean(axis=0).argmax())].argmax() * 16000 / 512 - 1000) < 120


class Recorder:
    """Stands for a session and its tables; mapInPandas gives the function that a worker would run."""

    @property
    def read(self):
        return self

    def parquet(self, *_):
        return self

    def select(self, *_):
        return self

    def mapInPandas(self, f, _):
        return f


def test_workers_make_long_rows_in_parts(spark, monkeypatch):
    import pandas as pd

    from voxframe.plans import base, frames, streams

    monkeypatch.setattr(streams, "emb", lambda *_: Recorder())
    n = 1000
    rows = pd.DataFrame({"file": ["f"] * n, "block": range(n), "seq": range(n), "label": [i % 4 for i in range(n)], "seed": [i % 4 for i in range(n)]})
    for made, each in ((streams.blocks(None, ""), 1), (frames.q17(Recorder(), ""), len(segmentation.filter_bank(np.zeros(1600))))):
        sizes = [len(part) for part in made(iter([rows]))]
        assert sum(sizes) == n * each and max(sizes) <= base.PART * each
