"""Array kernels for Pandas UDFs: spectra, beams, interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIGHT = 299_792_458.0


def range_doppler(samples: np.ndarray, bins: int | None = None) -> np.ndarray:
    """Power by (doppler, range) of one frame (chirps, samples).

    Range transform, the mean over chirps taken off (what does not move), then
    the Doppler transform with zero velocity in the middle.
    """
    spectrum = np.fft.fft(samples, axis=-1)[..., :bins]
    moving = spectrum - spectrum.mean(axis=-2, keepdims=True)
    return np.abs(np.fft.fftshift(np.fft.fft(moving, axis=-2), axes=-2)) ** 2


def steering(elements: int, angles: np.ndarray, spacing: float = 0.5) -> np.ndarray:
    """Steering vectors (angles, elements) of a line of antennas, spacing in wavelengths."""
    return np.exp(2j * np.pi * spacing * np.outer(np.sin(angles), np.arange(elements)))


def beam_power(signals: np.ndarray, angles: np.ndarray, spacing: float = 0.5) -> np.ndarray:
    """Power by angle of the signals of a line of antennas."""
    return np.abs(steering(len(signals), angles, spacing).conj() @ signals) ** 2


def beat(delays: np.ndarray, gains: np.ndarray, times: np.ndarray, carrier: float, slope: float) -> np.ndarray:
    """Real beat signal of paths with the given delays, summed."""
    phases = 2 * np.pi * (carrier * delays[:, None] + slope * delays[:, None] * times[None, :] - slope * delays[:, None] ** 2 / 2)
    return (gains[:, None] * np.exp(1j * phases)).sum(axis=0).real


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def range_doppler_16(vectors: pd.Series) -> pd.Series:
    """Range-Doppler power of vectors of 64 samples, as four chirps of 16."""
    return pd.Series([range_doppler(np.asarray(v, float).reshape(-1, 16)).ravel().tolist() for v in vectors])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def beams_9(vectors: pd.Series) -> pd.Series:
    """Beam power at nine angles of vectors read as antennas."""
    angles = np.linspace(-np.pi / 3, np.pi / 3, 9)
    return pd.Series([beam_power(np.asarray(v, float), angles).tolist() for v in vectors])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def beat_32(delays: pd.Series) -> pd.Series:
    """Beat signals of 32 samples of paths, by their delays in nanoseconds."""
    times = np.arange(32) / 10e6
    return pd.Series([beat(np.asarray(d, float) * 1e-9, np.ones(len(d)), times, 77e9, 60e12).tolist() for d in delays])
