"""Streams of samples to turns: a stateful streaming job, and the batch job that gives the same rows.

Input rows: file, seq (rising within a file), samples; null samples end the stream. Rows of a file are put in the order of seq
within a micro-batch; a seq that does not rise across batches is an error. The state of a file is one pickled ``Diarizer`` without its hooks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from voxframe.operators.clustering import LARGEST
from voxframe.streaming.state import Diarizer, SpeakerCache

TURNS = "file string, speaker long, start double, end double, stable boolean"


def advance(made: Callable[[], Diarizer], file: str, held: tuple[Diarizer, int] | None, rows: pd.DataFrame) -> tuple[tuple[Diarizer, int], pd.DataFrame]:
    fresh = made()
    diarizer, last = held or (fresh, -1)
    diarizer.vad, diarizer.embed = fresh.vad, fresh.embed
    out = []
    for seq, samples in rows.sort_values("seq", kind="stable")[["seq", "samples"]].itertuples(index=False):
        if seq <= last:
            raise ValueError(f"{file}: part {seq} after {last}")
        last = int(seq)
        out += diarizer.flush() if samples is None else diarizer.feed(np.asarray(samples, dtype=np.float32))
    return (diarizer, last), pd.DataFrame(out, columns=["speaker", "start", "end", "stable"]).assign(file=file)[["file", "speaker", "start", "end", "stable"]]


def stream_turns(parts: DataFrame, made: Callable[[], Diarizer]) -> DataFrame:
    """The turns of a streaming table, each as soon as its samples are there (append mode)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        held, out = advance(made, key[0], held, pd.concat(list(batches), ignore_index=True))
        state.update((pickle.dumps(held),))
        yield out

    return parts.groupBy("file").applyInPandasWithState(run, TURNS, "held binary", "append", GroupStateTimeout.NoTimeout)


def batch_turns(parts: DataFrame, made: Callable[[], Diarizer]) -> DataFrame:
    """The same rows from a stored table."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return advance(made, key[0], None, rows)[1]

    return parts.select("file", "seq", "samples").groupBy("file").applyInPandas(run, TURNS)


def assign_in_order(units: DataFrame, most: int, threshold: float, hits_to_stable: int, margin: float) -> DataFrame:
    """file, ord, speaker, confidence, stable, merged: the speaker cache over stored vectors (file, ord, embedding) in their order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, pdf = SpeakerCache(most, threshold, hits_to_stable, margin), pdf.sort_values("ord", kind="stable")
        got = [cache.assign(np.asarray(v, dtype=np.float32)) for v in pdf["embedding"]]
        return pd.DataFrame(got, columns=["speaker", "confidence", "stable", "merged"]).assign(file=pdf["file"].to_numpy(), ord=pdf["ord"].to_numpy())[["file", "ord", "speaker", "confidence", "stable", "merged"]]

    assert most <= LARGEST
    return units.select("file", "ord", "embedding").groupBy("file").applyInPandas(run, "file string, ord long, speaker long, confidence double, stable boolean, merged boolean")
