"""Amplitude spectra of series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.operators.segments import spectrum_segment
from flightframe.operators.series import SERIES, runs_begin


def amplitudes(y: np.ndarray) -> np.ndarray:
    """Amplitudes of series of one length (rows): mean removed, Hanning window, real transform, size over n times 2."""
    n = y.shape[1]
    return np.abs(np.fft.rfft((y - y.mean(axis=1, keepdims=True)) * np.hanning(n), axis=1)) * 2 / n


def transformed(rows: pa.RecordBatch, keys: Sequence[str], starts: np.ndarray) -> pa.RecordBatch:
    """rows(keys, v, fs) of whole series that begin at starts -> (keys, bin, freq, mag); equal lengths go together."""
    y, fs = np.asarray(rows.column("v").fill_null(np.nan), float), np.asarray(rows.column("fs").fill_null(0.0), float)[starts]
    size = np.diff(np.append(starts, len(y)))
    plain = (size < 2) | ~(fs > 0)  # these have the one bin 0
    bins = np.where(plain, 1, size // 2 + 1)
    ends = np.cumsum(bins)
    number = np.arange(ends[-1]) - np.repeat(ends - bins, bins)
    mag = np.zeros(ends[-1])
    for n in np.unique(size[~plain]):
        some = np.flatnonzero((size == n) & ~plain)
        found = amplitudes(y[starts[some][:, None] + np.arange(n)])
        mag[(ends - bins)[some][:, None] + np.arange(n // 2 + 1)] = found
    step = np.where(plain, 0.0, 1 / (size * np.where(plain, 1.0, 1 / np.where(plain, 1.0, fs))))
    names = rows.select(list(keys)).take(pa.array(np.repeat(starts, bins)))
    return pa.RecordBatch.from_arrays([*names.columns, pa.array(number.astype(np.int32)), pa.array(number * np.repeat(step, bins)), pa.array(mag)], [*keys, "bin", "freq", "mag"])


def spectrum(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples(keys, t, seq, v, fs) -> (keys, bin int, freq, mag): frequencies 0 to fs / 2.

    A series below two samples or without a rate has one bin of zeros.  Series come one after the other in order of
    time; whole ones are transformed by Arrow batches, and only one that goes on in the next batch waits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = runs_begin(batch, keys)
            new[0] = bool(waiting) and any(waiting[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else -1
            if cut >= 0:
                whole = joined([*waiting, batch.slice(0, cut)])
                yield transformed(whole, keys, np.flatnonzero(runs_begin(whole, keys)))
                waiting = []
            waiting.append(batch.slice(max(cut, 0)))
        if waiting:
            whole = joined(waiting)
            yield transformed(whole, keys, np.flatnonzero(runs_begin(whole, keys)))

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    ordered = samples.select(*keys, "t", "seq", F.col("v").cast("double").alias("v"), F.col("fs").cast("double").alias("fs")).repartition(*keys).sortWithinPartitions(*keys, "t", "seq")
    return ordered.select(*keys, "v", "fs").mapInArrow(run, f"{kinds}, bin int, freq double, mag double")


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def series_spectra(samples: DataFrame, requests: DataFrame, multiplier: float = 20.0, min_gap_s: float = 0.05) -> DataFrame:
    """Spectra of the requested (log_id, series); repeated requests count once and unknown ones have no rows.

    (log_id, series "FFT.mag_<series>", freq_series "FFT.freq_<series>", bin, freq, mag).
    """
    wanted = samples.join(requests.select(*SERIES).distinct(), list(SERIES), "left_semi")
    rows = spectrum(spectrum_segment(wanted, multiplier, min_gap_s))
    return rows.select("log_id", F.concat(F.lit("FFT.mag_"), "series").alias("series"), F.concat(F.lit("FFT.freq_"), "series").alias("freq_series"), "bin", "freq", "mag")
