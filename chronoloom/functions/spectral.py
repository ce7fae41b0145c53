"""Features that need a transform of the whole series: NumPy over matrices of series of one length, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .native import FS

#: Values of the series that are transformed together.
TOGETHER = 1 << 18
#: Fixed sizes of the cepstral features: points and filters, coefficients, lifter, order of prediction.
N_FFT, N_MEL, N_OUT, LIFTER, ORDER = 512, 40, 12, 22, 12
#: Frames of so many values get their spectrum from their autocorrelation, which is as much work as they have lags.
SHORT_FRAME = 64


@lru_cache(maxsize=8)
def _mel_bank(fs: float) -> np.ndarray:
    edges = np.linspace(0, 2595 * np.log10(1 + fs / 2 / 700), N_MEL + 2)
    bins = np.floor((N_FFT + 1) * 700 * (10 ** (edges / 2595) - 1) / fs).astype(int)
    bank = np.zeros((N_MEL, N_FFT // 2 + 1))
    for m in range(1, N_MEL + 1):
        a, b, c = bins[m - 1 : m + 2]
        bank[m - 1, a:b] = (np.arange(a, b) - a) / max(1, b - a)
        bank[m - 1, b:c] = (c - np.arange(b, c)) / max(1, c - b)
    return bank


@lru_cache(maxsize=8)
def _mel_lags(fs: float, size: int) -> np.ndarray:
    """(lags, filters): what each lag of a frame's autocorrelation adds to the energy of each filter."""
    waves = np.cos(2 * np.pi * np.outer(np.arange(size), np.arange(N_FFT // 2 + 1)) / N_FFT) * np.where(np.arange(size) > 0, 2, 1)[:, None]
    return waves @ _mel_bank(fs).T / N_FFT


@lru_cache(maxsize=64)
def _wavelets(n: int) -> tuple[int, list[tuple[np.ndarray, int]]]:
    """For series of ``n`` values: the size of transforms, and of Ricker wavelets of widths 1 to 9 their transform and middle."""
    sizes = [min(10 * a, n) for a in range(1, 10)]
    points = 1 << (n + max(sizes) - 2).bit_length()
    out = []
    for a, size in enumerate(sizes, 1):
        t = np.arange(size) - (size - 1) / 2
        w = 2 / (np.sqrt(3 * a) * np.pi**0.25) * (1 - (t / a) ** 2) * np.exp(-(t**2) / (2 * a * a))
        out.append((np.fft.rfft(w, points), (size - 1) // 2))
    return points, out


def _share(a: np.ndarray, b: np.ndarray | float, other: float = 0.0) -> np.ndarray:
    """a / b, and ``other`` where b is 0."""
    b = np.broadcast_to(b, np.shape(a))
    return np.divide(a, b, out=np.full(np.shape(a), other, dtype=float), where=b != 0)


class Spectrum:
    """Transforms of a series, or of series of one length (a row each); each is made at most once."""

    def __init__(self, x: np.ndarray, fs: float = FS):
        self.x, self.fs = np.atleast_2d(np.asarray(x, dtype=float)), fs
        self.rows, self.n = self.x.shape
        self._held: dict[str, object] = {}

    def get(self, name: str):
        if name not in self._held:
            self._held[name] = getattr(self, f"_{name}")()
        return self._held[name]

    def _fft(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies and magnitudes."""
        return np.fft.rfftfreq(self.n, 1 / self.fs), np.abs(np.fft.rfft(self.x, axis=1))

    def _cum(self) -> np.ndarray:
        return np.cumsum(self.get("fft")[1], axis=1)

    def _welch(self) -> tuple[np.ndarray, np.ndarray]:
        """Power density of x over its deviation: Hann windows of up to 256 values, half overlapped, each centred."""
        size = min(256, self.n)
        deviation = self.x.std(axis=1, keepdims=True)
        x = self.x / np.where(deviation == 0, 1.0, deviation)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size) if size > 1 else np.ones(1)
        power = np.zeros((self.rows, size // 2 + 1))
        starts = range(0, self.n - size + 1, max(1, size - size // 2))
        for a in starts:  # a sum over segments, whatever the length
            part = x[:, a : a + size]
            power += np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
        power /= len(starts) * self.fs * max((window**2).sum(), 1e-300)
        power[:, 1 : None if size % 2 else -1] *= 2
        return np.fft.rfftfreq(size, 1 / self.fs), power

    def _moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre and spread of the magnitudes."""
        f, m = self.get("fft")
        total = m.sum(axis=1)
        centre = _share(m @ f, total)
        return centre, np.sqrt(_share(((f - centre[:, None]) ** 2 * m).sum(axis=1), total))

    def _lpcc(self) -> np.ndarray:
        """Cepstral coefficients of a linear prediction."""
        r = np.stack([(self.x[:, : self.n - k] * self.x[:, k:]).sum(axis=1) if k < self.n else np.zeros(self.rows) for k in range(ORDER + 1)], axis=1)
        a, e = np.zeros((self.rows, ORDER + 1)), r[:, 0].copy()
        a[:, 0] = 1.0
        for i in range(1, ORDER + 1):
            top = r[:, i] + (a[:, 1:i] * r[:, i - 1 : 0 : -1]).sum(axis=1)
            k = np.divide(-top, e, out=np.zeros(self.rows), where=np.abs(e) > 1e-12)
            a[:, 1 : i + 1] = a[:, 1 : i + 1] + k[:, None] * np.append(a[:, i - 1 : 0 : -1], np.ones((self.rows, 1)), axis=1)
            e *= 1 - k * k
        c = np.zeros((self.rows, ORDER + 1))
        for m in range(1, ORDER + 1):
            c[:, m] = -a[:, m] - sum(k / m * c[:, k] * a[:, m - k] for k in range(1, m))
        return c[:, 1:]

    def _mfcc(self) -> np.ndarray:
        """Mel cepstral coefficients: pre-emphasis 0.97, Hamming frames of 25 ms each 10 ms, mean over frames."""
        y = np.append(self.x[:, :1], self.x[:, 1:] - 0.97 * self.x[:, :-1], axis=1)
        size, hop = max(1, round(0.025 * self.fs)), max(1, round(0.01 * self.fs))
        frames = 1 + max(0, -(-(self.n - size) // hop))
        y = np.append(y, np.zeros((self.rows, max(0, (frames - 1) * hop + size - self.n))), axis=1)
        cut = np.lib.stride_tricks.sliding_window_view(y, size, axis=1)[:, : (frames - 1) * hop + 1 : hop] * np.hamming(size)
        if size <= SHORT_FRAME:
            lags = np.stack([(cut[..., : size - k] * cut[..., k:]).sum(axis=-1) for k in range(size)], axis=-1)
            energy = lags @ _mel_lags(self.fs, size)
        else:
            energy = np.abs(np.fft.rfft(cut, N_FFT)) ** 2 / N_FFT @ _mel_bank(self.fs).T
        energy = 20 * np.log10(np.maximum(energy, np.finfo(float).eps)).mean(axis=1)
        basis = np.cos(np.pi * np.outer(np.arange(1, N_OUT + 1), 2 * np.arange(N_MEL) + 1) / (2 * N_MEL)) * np.sqrt(2 / N_MEL)
        lift = 1 + LIFTER / 2 * np.sin(np.pi * np.arange(1, N_OUT + 1) / LIFTER)
        return energy @ basis.T * lift

    def _cwt(self) -> np.ndarray:
        """(widths, rows, values): convolutions with Ricker wavelets of widths 1 to 9, as long as the series."""
        points, waves = _wavelets(self.n)
        spectrum = np.fft.rfft(self.x, points, axis=1)
        return np.stack([np.fft.irfft(spectrum * w, points, axis=1)[:, at : at + self.n] for w, at in waves])


def _first(f: np.ndarray, reached: np.ndarray, never: np.ndarray | float = 0.0) -> np.ndarray:
    return np.where(reached.any(axis=1), f[reached.argmax(axis=1)], never)


def _fundamental(s: Spectrum) -> np.ndarray:
    """The lowest local peak above half of the largest magnitude, without the mean."""
    f, m = s.get("fft")
    m = np.append(np.zeros((s.rows, 1)), m[:, 1:], axis=1)
    inner = np.zeros(m.shape, dtype=bool)
    inner[:, 1:-1] = (m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] >= m[:, 2:]) & (m[:, 1:-1] > 0.5 * m.max(axis=1, keepdims=True))
    return np.where(m.any(axis=1), _first(f, inner, f[m.argmax(axis=1)]), 0.0)


def _autocorrelation(s: Spectrum) -> np.ndarray:
    """The first lag at which the autocorrelation falls below 1/e; the length if it never does."""
    x = s.x - s.x.mean(axis=1, keepdims=True)
    size = 1 << (2 * s.n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, axis=1)[:, : s.n]
    some = r[:, 0] > 1e-300
    below = np.divide(r, r[:, :1], out=np.ones_like(r), where=some[:, None]) < np.exp(-1)
    return _first(np.arange(s.n, dtype=float), below, float(s.n))


def _bandwidth(s: Spectrum) -> np.ndarray:
    f, p = s.get("welch")
    total = p.sum(axis=1, keepdims=True)
    cum = _share(np.cumsum(p, axis=1), total)
    return np.where(total[:, 0] > 0, _first(f, cum >= 0.975) - _first(f, cum >= 0.025), 0.0)


def _human(s: Spectrum) -> np.ndarray:
    f, m = s.get("fft")
    e = m**2
    return _share(e[:, (f >= 0.6) & (f <= 2.5)].sum(axis=1), e.sum(axis=1))


def _decrease(s: Spectrum) -> np.ndarray:
    m = s.get("fft")[1]
    return _share(((m[:, 1:] - m[:, :1]) / np.arange(1, m.shape[1])).sum(axis=1), m[:, 1:].sum(axis=1))


def _entropy(p: np.ndarray) -> np.ndarray:
    """Of rows of weights, over the logarithm of how many aren't 0."""
    p = _share(p, p.sum(axis=1, keepdims=True))
    some = p > 0
    n = some.sum(axis=1)
    total = -(p * np.log2(np.where(some, p, 1.0))).sum(axis=1)
    return np.where(n > 1, total / np.log2(np.maximum(n, 2)), 0.0)


def _standard_moment(s: Spectrum, k: int) -> np.ndarray:
    f, m = s.get("fft")
    centre, spread = s.get("moments")
    return _share(_share(((f - centre[:, None]) ** k * m).sum(axis=1), m.sum(axis=1)), spread**k)


def _slope(s: Spectrum) -> np.ndarray:
    f, m = s.get("fft")
    c = f - f.mean()
    return m @ c / (c @ c) if len(f) > 1 else np.zeros(s.rows)


def _variation(s: Spectrum) -> np.ndarray:
    m = s.get("fft")[1]
    a, b = m[:, :-1], m[:, 1:]
    norm = np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))
    return 1 - _share((a * b).sum(axis=1), norm)


def _turns(s: Spectrum) -> np.ndarray:
    d = np.diff(s.get("fft")[1], axis=1)
    return ((d[:, :-1] > 0) & (d[:, 1:] < 0)).sum(axis=1).astype(float)


def _distance(s: Spectrum) -> np.ndarray:
    cum = s.get("cum")
    return (np.linspace(np.zeros(s.rows), cum[:, -1], cum.shape[1], axis=1) - cum).sum(axis=1)


def _at_share(s: Spectrum, share: float) -> np.ndarray:
    cum = s.get("cum")
    return _first(s.get("fft")[0], cum >= share * cum[:, -1:])


FEATURES: dict[str, Callable[[Spectrum], np.ndarray]] = {
    "0_Autocorrelation": _autocorrelation,
    "0_Fundamental frequency": _fundamental,
    "0_Human range energy": _human,
    "0_Max power spectrum": lambda s: s.get("welch")[1].max(axis=1),
    "0_Maximum frequency": lambda s: _at_share(s, 0.95),
    "0_Median frequency": lambda s: _at_share(s, 0.5),
    "0_Power bandwidth": _bandwidth,
    "0_Spectral centroid": lambda s: s.get("moments")[0],
    "0_Spectral decrease": _decrease,
    "0_Spectral distance": _distance,
    "0_Spectral entropy": lambda s: _entropy(s.get("fft")[1] ** 2),
    "0_Spectral kurtosis": lambda s: _standard_moment(s, 4),
    "0_Spectral positive turning points": _turns,
    "0_Spectral roll-off": lambda s: _at_share(s, 0.95),
    "0_Spectral roll-on": lambda s: _at_share(s, 0.05),
    "0_Spectral skewness": lambda s: _standard_moment(s, 3),
    "0_Spectral slope": _slope,
    "0_Spectral spread": lambda s: s.get("moments")[1],
    "0_Spectral variation": _variation,
    "0_Wavelet entropy": lambda s: _entropy((s.get("cwt") ** 2).sum(axis=2).T),
}
for _k in range(N_OUT):
    FEATURES[f"0_LPCC_{_k}"] = lambda s, k=_k: s.get("lpcc")[:, k]
    FEATURES[f"0_MFCC_{_k}"] = lambda s, k=_k: s.get("mfcc")[:, k]
for _k in range(9):
    FEATURES[f"0_Wavelet absolute mean_{_k}"] = lambda s, k=_k: np.abs(s.get("cwt")[k].mean(axis=1))
    FEATURES[f"0_Wavelet energy_{_k}"] = lambda s, k=_k: np.sqrt((s.get("cwt")[k] ** 2).mean(axis=1))
    FEATURES[f"0_Wavelet standard deviation_{_k}"] = lambda s, k=_k: s.get("cwt")[k].std(axis=1)
    FEATURES[f"0_Wavelet variance_{_k}"] = lambda s, k=_k: s.get("cwt")[k].var(axis=1)


def spectral_array(values: Column | str, names: list[str], fs: float = FS) -> Column:
    """The named features as an array, in their order; null for null or empty series. Series of one length are
    transformed together, as many at a time as have ``TOGETHER`` values."""

    @F.pandas_udf("array<double>")
    def compute(batch: pd.Series) -> pd.Series:
        out = [None] * len(batch)
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(batch):
            if v is not None and len(v):
                by_length.setdefault(len(v), []).append(i)
        for n, all_ in by_length.items():
            step = max(1, TOGETHER // n)
            for lo in range(0, len(all_), step):
                rows = all_[lo : lo + step]
                s = Spectrum(np.array([batch.iloc[i] for i in rows], dtype=float), fs)
                with np.errstate(invalid="ignore"):
                    found = np.stack([FEATURES[name](s) for name in names], axis=1)
                for i, r in zip(rows, found, strict=True):
                    out[i] = r
        return pd.Series(out)

    return compute(F.col(values) if isinstance(values, str) else values)
