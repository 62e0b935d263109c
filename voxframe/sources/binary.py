"""WAV and NPY files, by any path that Spark can read, and artifacts checked by their digest."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_SECONDS = 1 << 30, 3600


def wav_samples(raw: bytes) -> tuple[np.ndarray, int]:
    """(mono samples from -1 to 1, rate) of PCM with 8, 16, 24 or 32 bits or of floats; channels are averaged. Other codings are an error."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, shape, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE and len(body) >= 26 else kind
            shape = (kind, channels, rate, bits)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if shape is None:
        raise ValueError("no format")
    kind, channels, rate, bits = shape
    data = data[: len(data) // (bits // 8 * channels) * (bits // 8 * channels)]
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(data, dtype=f"<f{bits // 8}").astype(np.float32)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(data, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = (np.frombuffer(data, dtype=f"<i{bits // 8}") / float(1 << (bits - 1))).astype(np.float32)
    elif kind == 1 and bits == 24:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)).astype(np.float32)
    else:
        raise ValueError(f"coding {kind} with {bits} bits is not supported")
    return x.reshape(-1, channels).mean(axis=1, dtype=np.float32) if channels > 1 else x, rate


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by the spectrum; their number is rounded to the same length of time."""
    n = round(len(x) * to / rate)
    if rate == to or not len(x):
        return x.astype(np.float32)
    spectrum = np.fft.rfft(x)
    held = np.zeros(n // 2 + 1, dtype=complex)
    k = min(len(spectrum), len(held))
    held[:k] = spectrum[:k]
    return (np.fft.irfft(held, n) * (n / len(x))).astype(np.float32)


def read_wav(spark: SparkSession, path: str, rate: int | None = None, convert: bool = False) -> DataFrame:
    """path, rate, samples of the WAV files of a folder. rate: what they must have, or are converted to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,WAV}").load(path).select("path", "length", "content")
    files = files.withColumn("content", F.when(F.col("length") <= MOST_BYTES, F.col("content")).otherwise(F.raise_error(F.lit("a WAV file is over 1 GiB")).cast("binary")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, raw in zip(batch["path"], batch["content"]):
                x, own = wav_samples(raw)
                if len(x) > own * MOST_SECONDS:
                    raise ValueError(f"{where}: over an hour")
                if rate is not None and own != rate:
                    if not convert:
                        raise ValueError(f"{where}: {own} samples a second, not {rate}")
                    x, own = resample(x, own, rate), rate
                rows.append((where, own, x))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")


def npy_array(raw: bytes, dims: int | None = None) -> np.ndarray:
    """The array of a version 1 NPY file of 4 or 8 byte floats or 8 byte integers in C order; a part of an element is an error.

    dims = 2 also checks the shape; else what there is comes as a row.
    """
    if raw[:6] != b"\x93NUMPY" or raw[6] != 1:
        raise ValueError("not a version 1 NPY file")
    size = struct.unpack_from("<H", raw, 8)[0]
    header = ast.literal_eval(raw[10 : 10 + size].decode("latin-1").strip())
    if header["descr"] not in ("<f4", "<f8", "<i8") or header["fortran_order"]:
        raise ValueError(f"{header['descr']} is not supported")
    body = raw[10 + size :]
    kind = np.dtype(header["descr"])
    if len(body) % kind.itemsize:
        raise ValueError("a part of an element")
    flat = np.frombuffer(body, dtype=kind)
    if dims is None:
        return flat
    if len(header["shape"]) != dims or int(np.prod(header["shape"])) != len(flat):
        raise ValueError(f"shape {header['shape']} does not fit")
    return flat.reshape(header["shape"])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, row, values of the two-dimensional NPY files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, raw in zip(batch["path"], batch["content"]):
                x = npy_array(raw, 2).astype(np.float64)
                yield pd.DataFrame({"path": where, "row": np.arange(len(x)), "values": list(x)})

    return files.mapInPandas(run, "path string, row long, values array<double>")


def artifact(spark: SparkSession, path: str, sha256: str) -> bytes:
    """The bytes of one file, if its digest is the given one."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("digest")).first()
    if row is None or row["digest"] != sha256.lower():
        raise ValueError(f"{path} is not the expected file")
    return bytes(row["content"])
