"""Column functions over arrays: distances, complex snapshots and feature vectors.

All but lag_features are expressions of built-in functions and run inside the JVM. A snapshot is an array of
structs (re, im), antenna-major.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine_distance(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """1 - dot of the unit vectors; a norm below eps counts as eps."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


DISTANCES = {"euclidean": euclidean, "squared": squared_distance, "cosine": cosine_distance}


def distances(anchor: Column, others: Column, kind: str = "euclidean") -> Column:
    """Distances of an anchor to an array of vectors."""
    if kind not in DISTANCES:
        raise ValueError(f"unknown distance: {kind}")
    return F.transform(others, lambda v: DISTANCES[kind](anchor, v))


def summed_distance(anchor: Column, others: Column, kind: str = "squared") -> Column:
    """The distances' sum, the form of an anchor set against one group."""
    return total(distances(anchor, others, kind))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def times(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def antennas(csi: Column, first: int, count: int, subcarriers: int) -> Column:
    """The part of a snapshot that belongs to ``count`` antennas."""
    return F.slice(csi, first * subcarriers + 1, count * subcarriers)


def by_antenna(csi: Column, n_antennas: int, subcarriers: int) -> Column:
    return F.array(*(antennas(csi, a, 1, subcarriers) for a in range(n_antennas)))


def fft_shift(csi: Column, n_antennas: int, subcarriers: int) -> Column:
    """The two halves of each antenna's (even) spectrum change places."""
    if subcarriers % 2:
        raise ValueError("the number of subcarriers must be even")
    half = subcarriers // 2
    return F.flatten(F.transform(by_antenna(csi, n_antennas, subcarriers), lambda a: F.concat(F.slice(a, half + 1, half), F.slice(a, 1, half))))


def calibrate(csi: Column, sto: Column, cpo: Column, subcarriers: int, bandwidth: int = 1024) -> Column:
    """Multiply antenna a, subcarrier k by exp(i (sto[a] 2 pi k / bandwidth + cpo[a]))."""
    import math

    def turned(v, place):
        antenna, k = F.floor(place / subcarriers).cast("int"), place % subcarriers
        phase = F.get(sto, antenna) * (2 * math.pi) * k / F.lit(bandwidth) + F.get(cpo, antenna)
        return times(v, complex_of(F.cos(phase), F.sin(phase)))

    return F.transform(csi, turned)


def power(csi: Column) -> Column:
    """Mean squared magnitude."""
    return total(F.transform(csi, lambda v: v["re"] * v["re"] + v["im"] * v["im"])) / F.size(csi)


def chunk_features(csi: Column, chunk: int, values: int) -> Column:
    """Means over chunks of neighbouring subcarriers, over the root mean power, real and imaginary parts in turn."""
    if values % chunk:
        raise ValueError("chunks must fill the subcarriers")
    scale = F.sqrt(power(csi)) + 1e-12

    def part(start, name):
        return total(F.transform(F.slice(csi, start * chunk + 1, F.lit(chunk)), lambda v: v[name])) / chunk / scale

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(values // chunk - 1)), lambda c: F.array(part(c, "re"), part(c, "im"))))


def lag_features(csi: Column, n_antennas: int, subcarriers: int, lags: tuple[int, ...]) -> Column:
    """log |mean over f of H[f] conj(H[f + lag])| of each beam: a discrete Fourier transform over antennas, then lags.

    As nested array expressions the transform would be evaluated again for every lag, so this one runs in
    Arrow batches: numpy over whole batches of snapshots.
    """
    @F.pandas_udf("array<double>")
    def found(re: pd.Series, im: pd.Series) -> pd.Series:
        import numpy as np

        h = (np.stack(re) + 1j * np.stack(im)).reshape(len(re), n_antennas, subcarriers)
        beams = np.fft.fft(h, axis=1)
        out = [np.log(np.abs((beams[:, :, : subcarriers - lag] * beams[:, :, lag:].conj()).sum(2) / (subcarriers - lag)) + 1e-12) for lag in lags]
        return pd.Series(list(np.stack(out, 2).reshape(len(re), -1)))

    return found(F.transform(csi, lambda v: v["re"]), F.transform(csi, lambda v: v["im"]))


def features(csi: Column, method: str, n_antennas: int, subcarriers: int, chunk: int = 32, lags: tuple[int, ...] = tuple(range(0, 64, 4))) -> Column:
    """The feature vector by name of the method."""
    if method == "chunks":
        return chunk_features(csi, chunk, n_antennas * subcarriers)
    if method == "lags":
        return lag_features(csi, n_antennas, subcarriers, lags)
    raise ValueError(f"unknown method: {method}")
