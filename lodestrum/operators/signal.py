"""Transforms of packed series that need an FFT: Arrow batches, one vectorised FFT for each batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(d: DataFrame, column: str, out: str, f: Callable[[np.ndarray], pd.DataFrame], keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            for n, part in b.groupby(b[column].map(len)):
                if n:
                    yield pd.concat([part[keep].reset_index(drop=True), f(np.stack(part[column].to_numpy()).astype(float))], axis=1)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*keep).schema)
    return d.select(*keep, column).mapInPandas(run, f"{kept}, {out}")


def power_spectrum(d: DataFrame, column: str, keep: list[str], dt: float = 1.0) -> DataFrame:
    """One-sided periodogram of each series."""

    def f(x: np.ndarray) -> pd.DataFrame:
        p = 2 * dt / x.shape[1] * np.abs(np.fft.rfft(x, axis=1)) ** 2
        return pd.DataFrame({"psd": list(p)})

    return _rows(d, column, "psd array<double>", f, keep)


def median_bias(n: int) -> float:
    """Expected median of n periodograms over their mean."""
    return sum((-1) ** k / (k + 1) for k in range(n if n % 2 else n - 1)) if n < 1000 else float(np.log(2))


def welch(d: DataFrame, column: str, keep: list[str], size: int, stride: int, average: str = "median", dt: float = 1.0) -> DataFrame:
    """Average of Hann-windowed periodograms of overlapping segments; the median is corrected for its bias.

    Samples beyond the last whole segment are left out in equal parts at both ends (the odd
    one at the start). The first and the last bin hold half the power. average: mean, median, median-mean.
    """
    win = np.hanning(size)

    def f(x: np.ndarray) -> pd.DataFrame:
        n = x.shape[1] // stride
        n -= (n - 1) * stride + size > x.shape[1]
        spare = x.shape[1] - (n - 1) * stride - size
        x = x[:, (spare + 1) // 2 :]
        s = np.stack([np.abs(np.fft.rfft(x[:, a : a + size] * win, axis=1)) ** 2 for a in range(0, n * stride, stride)], axis=1) * 2 * dt / (win**2).sum()
        s[:, :, [0, -1]] /= 2
        median = lambda y: np.median(y, axis=1) / median_bias(y.shape[1])
        p = {"mean": lambda: s.mean(axis=1), "median": lambda: median(s), "median-mean": lambda: (median(s[:, ::2]) + median(s[:, 1::2])) / 2}[average]()
        return pd.DataFrame({"psd": list(p)})

    return _rows(d, column, "psd array<double>", f, keep)


def cutoffs(low: float | None, high: float | None, n: int, df: float) -> tuple[int, int]:
    """Bins [first, last) of a filter over n samples: without the mean, the Nyquist bin and what lies beyond the cutoffs."""
    first = int(low / df) if low else 1
    last = min(int(high / df), (n + 1) // 2) if high else (n + 1) // 2
    if first >= last:
        raise ValueError("no bin between the cutoffs")
    return first, last


def sigmasq(template: np.ndarray, psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> float:
    """Inner product of a time-domain template with itself over the spectrum."""
    n = len(template)
    t, df = np.fft.rfft(template) * dt, 1 / (n * dt)
    a, b = cutoffs(low, high, n, df)
    return float(4 * df * (np.abs(t[a:b]) ** 2 / (1 if psd is None else psd[a:b])).sum())


def matched_filter(d: DataFrame, column: str, template: np.ndarray, keep: list[str], psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> DataFrame:
    """Magnitude of the complex signal-to-noise series against a template over a spectrum (none: white of 1): peak and its place.

    Bins run from low (else the first above the mean) to below high (else the Nyquist bin).
    """
    n = len(template)
    df = 1 / (n * dt)
    a, b = cutoffs(low, high, n, df)
    norm = 4 * df / np.sqrt(sigmasq(template, psd, low, high, dt))
    weight = np.zeros(n, complex)
    weight[a:b] = (np.fft.rfft(template) * dt)[a:b].conj() / (1 if psd is None else psd[a:b])

    def f(x: np.ndarray) -> pd.DataFrame:
        z = norm * n * np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * dt * weight, axis=1))
        return pd.DataFrame({"peak": z.max(axis=1), "at": z.argmax(axis=1).astype(np.int32)})

    return _rows(d, column, "peak double, at int", f, keep)


def snr_bins(template: np.ndarray, bins: int, psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> list[int]:
    """Borders of so many runs of frequency bins that hold equal parts of the template's power."""
    n = len(template)
    a, b = cutoffs(low, high, n, 1 / (n * dt))
    power = np.cumsum((np.abs(np.fft.rfft(template)) ** 2 / (1 if psd is None else psd))[a:b])
    return [*(np.searchsorted(power, np.arange(bins) * power[-1] / bins, side="right") + a).tolist(), b]


def power_chisq(d: DataFrame, column: str, template: np.ndarray, bins: int, keep: list[str], psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> DataFrame:
    """Peak of the matched filter, its place, and there the chi-square of equal shares of power against what each run of bins gives."""
    n = len(template)
    borders = snr_bins(template, bins, psd, low, high, dt)
    norm = 4 / (n * dt) / np.sqrt(sigmasq(template, psd, low, high, dt))
    weight = (np.fft.rfft(template) * dt).conj() / (1 if psd is None else psd)

    def f(x: np.ndarray) -> pd.DataFrame:
        q = norm * np.fft.rfft(x, axis=1) * dt * weight
        whole = np.zeros(x.shape, complex)
        whole[:, borders[0] : borders[-1]] = q[:, borders[0] : borders[-1]]
        z = n * np.abs(np.fft.ifft(whole, axis=1))
        at = z.argmax(axis=1)
        turn = np.exp(2j * np.pi * np.arange(q.shape[1]) * at[:, None] / n)
        parts = np.stack([(q * turn)[:, a:b].sum(axis=1) for a, b in zip(borders, borders[1:], strict=False)], axis=1)
        peak = z[np.arange(len(z)), at]
        return pd.DataFrame({"peak": peak, "at": at.astype(np.int32), "chisq": bins * (np.abs(parts) ** 2).sum(axis=1) - peak**2})

    return _rows(d, column, "peak double, at int, chisq double", f, keep)


def match(d: DataFrame, column: str, template: np.ndarray, keep: list[str], psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> DataFrame:
    """Largest overlap with a template over time and phase, both of unit norm."""
    n = len(template)
    a, b = cutoffs(low, high, n, 1 / (n * dt))

    def f(x: np.ndarray) -> pd.DataFrame:
        w = 1 if psd is None else psd[a:b]
        s, t = np.fft.rfft(x, axis=1)[:, a:b], np.fft.rfft(template)[a:b]
        q = np.zeros(x.shape, complex)
        q[:, a:b] = s * t.conj() / w
        own = np.sqrt((np.abs(s) ** 2 / w).sum(axis=1) * (np.abs(t) ** 2 / w).sum())
        return pd.DataFrame({"match": n * np.abs(np.fft.ifft(q, axis=1)).max(axis=1) / np.where(own == 0, 1, own)})

    return _rows(d, column, "match double", f, keep)


def whitened(d: DataFrame, column: str, psd: np.ndarray, keep: list[str], dt: float = 1.0) -> DataFrame:
    """Series divided by the root of a one-sided spectrum, of unit variance for noise of that spectrum."""

    def f(x: np.ndarray) -> pd.DataFrame:
        y = np.fft.irfft(np.fft.rfft(x, axis=1) / np.sqrt(psd), x.shape[1], axis=1) * np.sqrt(2 * dt)
        return pd.DataFrame({"white": list(y)})

    return _rows(d, column, "white array<double>", f, keep)


def truncated_inverse(psd: np.ndarray, length: int, low: int = 1) -> np.ndarray:
    """A spectrum whose inverse's root is no longer than length samples in time, so that filtering with it spoils no more."""
    n = 2 * (len(psd) - 1)
    root = np.zeros(len(psd))
    root[low:-1] = 1 / np.sqrt(psd[low:-1])
    q = np.fft.irfft(root, n)
    q[length // 2 : n - length // 2] = 0
    return 1 / np.maximum(np.abs(np.fft.rfft(q)) ** 2, np.finfo(float).tiny)


def autocorrelation(d: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Normalised autocorrelation by FFT, and its length 1 + 2 sum rho up to the first K with 5 tau <= K (infinite if none)."""

    def f(x: np.ndarray) -> pd.DataFrame:
        n = x.shape[1]
        x = x - x.mean(axis=1, keepdims=True)
        r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, axis=1)[:, :n]
        r = r / np.where(r[:, :1] == 0, 1, r[:, :1])
        tau = 2 * np.cumsum(r, axis=1) - 1
        ok = 5 * tau <= np.arange(n)
        first = ok.argmax(axis=1)
        return pd.DataFrame({"acf": list(r), "acl": np.where(ok.any(axis=1), tau[np.arange(len(tau)), first], np.inf)})

    return _rows(d, column, "acf array<double>, acl double", f, keep)


def spectrum(d: DataFrame, column: str, keep: list[str], dt: float = 1.0) -> DataFrame:
    """Fourier transform over time of each series: arrays re and im, from zero to the Nyquist frequency."""

    def f(x: np.ndarray) -> pd.DataFrame:
        y = np.fft.rfft(x, axis=1) * dt
        return pd.DataFrame({"re": list(y.real), "im": list(y.imag)})

    return _rows(d, column, "re array<double>, im array<double>", f, keep)


def back_to_time(d: DataFrame, keep: list[str], dt: float = 1.0) -> DataFrame:
    """Series of an even number of samples from their spectrum (re, im)."""
    both = d.withColumn("_z", F.concat("re", "im"))

    def f(z: np.ndarray) -> pd.DataFrame:
        n = z.shape[1] // 2
        return pd.DataFrame({"x": list(np.fft.irfft(z[:, :n] + 1j * z[:, n:], axis=1) / dt)})

    return _rows(both, "_z", "x array<double>", f, keep)


def sigmasq_series(template: np.ndarray, psd: np.ndarray | None = None, low: float | None = None, high: float | None = None, dt: float = 1.0) -> np.ndarray:
    """The part of sigmasq up to each bin; zero below the low cutoff, and from the high one on."""
    n = len(template)
    a, b = cutoffs(low, high, n, 1 / (n * dt))
    p = 4 / (n * dt) * np.abs(np.fft.rfft(template) * dt) ** 2 / (1 if psd is None else psd)
    out = np.zeros(len(p))
    out[a:b] = np.cumsum(p[a:b])
    return out


def correlated(d: DataFrame, column: str, template: np.ndarray, keep: list[str], low: int, high: int) -> DataFrame:
    """Spectrum of each series times the conjugate of the template's, in bins low to before high, zero elsewhere: arrays re and im."""
    t = np.fft.rfft(template)

    def f(x: np.ndarray) -> pd.DataFrame:
        y = np.fft.rfft(x, axis=1) * t.conj()
        y[:, :low] = y[:, high:] = 0
        return pd.DataFrame({"re": list(y.real), "im": list(y.imag)})

    return _rows(d, column, "re array<double>, im array<double>", f, keep)


def white_noise(spark, blocks: int, size: int, seed: int = 0) -> DataFrame:
    """Series (block, x) of unit normal samples; a sample is a hash of seed, block and place, so any task can make it anew."""
    from .transforms import normal_quantile

    u = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", i), 11).cast("double") + 0.5) / float(1 << 53)
    return spark.range(blocks).select(F.col("id").alias("block"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: normal_quantile(u(i))).alias("x"))


def coloured(d: DataFrame, column: str, psd: np.ndarray, keep: list[str], dt: float = 1.0) -> DataFrame:
    """Noise of a one-sided spectrum from white noise of unit variance."""

    def f(x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"noise": list(np.fft.irfft(np.fft.rfft(x, axis=1) * np.sqrt(psd / (2 * dt)), x.shape[1], axis=1))})

    return _rows(d, column, "noise array<double>", f, keep)
