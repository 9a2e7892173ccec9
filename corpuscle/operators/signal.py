"""Log-mel features of recordings, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def mono(samples: np.ndarray) -> np.ndarray:
    """The mean over channels of (channels, n) samples."""
    return samples.mean(axis=0) if samples.ndim > 1 else samples


def resample(x: np.ndarray, rate: int, to: int = 16_000) -> np.ndarray:
    """Samples at another rate, on straight lines between the old ones."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(np.ceil(len(x) * to / rate))) * rate / to
    return np.interp(at, np.arange(len(x)), x)


def mel_bank(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangles on the mel scale, evenly spread from 0 to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int = 16_000, n_fft: int = 400, hop: int = 160, n_mels: int = 80) -> np.ndarray:
    """(frames, n_mels): logarithms of mel power, frames centred with reflected ends."""
    if not len(x):
        return np.zeros((0, n_mels), np.float32)
    pad = n_fft // 2
    x = np.pad(x, pad, mode="reflect") if len(x) > pad else np.pad(x, pad)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * np.hanning(n_fft + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(power @ mel_bank(n_mels, n_fft, rate).T + 1e-6).astype(np.float32)


def features(df: DataFrame, key: str = "id", samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(key, frame, mel) of rows with mono samples (array of float) and their rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, x, r in zip(b[key], b[samples], b[rate], strict=True):
                m = log_mel(resample(np.asarray(x if x is not None else [], float), int(r)))
                if len(m):
                    yield pd.DataFrame({key: [k] * len(m), "frame": range(len(m)), "mel": list(m)})

    return df.select(key, samples, rate).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, frame int, mel array<float>")


def silence(rate: int, seconds: float = 0.2) -> int:
    """Samples of a pause."""
    return int(np.ceil(seconds * rate))
