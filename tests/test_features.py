"""Features against NumPy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions.features import statistic_view, with_features
from chronoloom.functions.groups import ALL_FEATURES, GROUPS, load_group, resolve, snake
from chronoloom.functions.spectral import FEATURES, Spectrum


def frame(spark, *series):
    return spark.createDataFrame([(str(i), None if s is None else [float(x) for x in s]) for i, s in enumerate(series)], "sample_id string, values array<double>")


def test_native_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.append(rng.integers(-40, 40, 75) / 16, [-4.0, 4.0])
    r = with_features(frame(spark, x), ["statistics", "distribution", "complexity_peaks", "time_shape_energy", "0_Average power", "0_Centroid"]).first()
    d, n, s = np.diff(x), len(x), np.sort(x)
    t = np.arange(n) / 100
    p = np.unique(x, return_counts=True)[1] / n
    expected = {
        "interquartile_range": np.subtract(*np.percentile(x, [75, 25])), "kurtosis": ((x - x.mean()) ** 4).mean() / x.var() ** 2 - 3, "max": x.max(), "mean": x.mean(),
        "mean_absolute_deviation": abs(x - x.mean()).mean(), "mean_absolute_diff": abs(d).mean(), "mean_diff": d.mean(), "median": np.median(x),
        "median_absolute_deviation": np.median(abs(x - np.median(x))), "median_absolute_diff": np.median(abs(d)), "median_diff": np.median(d), "min": x.min(),
        "skewness": ((x - x.mean()) ** 3).mean() / x.std() ** 3, "standard_deviation": x.std(), "sum_absolute_diff": abs(d).sum(), "variance": x.var(),
        "ecdf_percentile_0": s[int(0.2 * n) - 1], "ecdf_percentile_count_1": int(0.8 * n), "ecdf_3": 4 / n,
        "negative_turning_points": ((d[:-1] < 0) & (d[1:] > 0)).sum(), "positive_turning_points": ((d[:-1] > 0) & (d[1:] < 0)).sum(),
        "neighbourhood_peaks": sum(all(x[i] > x[i - k] and x[i] > x[i + k] for k in range(1, 11)) for i in range(10, n - 10)), "zero_crossing_rate": (np.diff(np.sign(x)) != 0).sum(),
        "absolute_energy": (x**2).sum(), "area_under_the_curve": np.trapezoid(x, t), "entropy": -(p * np.log2(p)).sum() / np.log2(n), "root_mean_square": np.sqrt((x**2).mean()),
        "signal_distance": np.sqrt(1 + d**2).sum(), "slope": np.polyfit(np.arange(n), x, 1)[0], "peak_to_peak_distance": np.ptp(x), "average_power": (x**2).sum() / ((n - 1) / 100), "centroid": (t * x**2).sum() / (x**2).sum(),
    }
    for name, value in expected.items():
        assert r[name] == pytest.approx(float(value), abs=1e-9), name
    place = np.minimum(np.floor((x - x.min()) * 10 / np.ptp(x)), 9)
    assert [r[f"histogram_{k}"] for k in range(10)] == [(place == k).sum() for k in range(10)]


def test_spectral():
    t = np.arange(400) / 100
    s = Spectrum(np.sin(2 * np.pi * 5 * t) + 3)
    assert FEATURES["0_Fundamental frequency"](s) == pytest.approx(5)
    tone = Spectrum(np.sin(2 * np.pi * 2 * t))
    assert FEATURES["0_Human range energy"](tone) == pytest.approx(1)
    assert FEATURES["0_Spectral centroid"](tone) == pytest.approx(2, abs=1e-6)
    assert FEATURES["0_Spectral roll-off"](tone) == FEATURES["0_Median frequency"](tone) == pytest.approx(2)
    assert FEATURES["0_Autocorrelation"](tone) == pytest.approx(10, abs=1)  # cos falls below 1/e within a fifth of 50 lags
    x = np.random.default_rng(0).normal(size=4000)
    for i in range(1, len(x)):
        x[i] += 0.7 * x[i - 1]
    assert FEATURES["0_LPCC_0"](Spectrum(x)) == pytest.approx(0.7, abs=0.06)
    cwt = Spectrum(x).get("cwt")
    assert cwt.shape == (9, 1, 4000) and FEATURES["0_Wavelet variance_3"](Spectrum(x)) == pytest.approx(cwt[3].var())


def by_definition(x, fs=100.0):
    """The transformed features of a series from sums, one term at a time."""
    n, out = len(x), {}
    dft = lambda v, size: [abs(sum(v[t] * np.exp(-2j * np.pi * k * t / size) for t in range(len(v)))) for k in range(size // 2 + 1)]
    m = np.array(dft(x, n))
    f = np.arange(len(m)) * fs / n
    cum = np.array([m[: k + 1].sum() for k in range(len(m))])
    at = lambda share: next(f[k] for k in range(len(m)) if cum[k] >= share * cum[-1])
    centre = sum(a * b for a, b in zip(f, m, strict=True)) / m.sum()
    spread = np.sqrt(sum((a - centre) ** 2 * b for a, b in zip(f, m, strict=True)) / m.sum())
    moment = lambda k: sum((a - centre) ** k * b for a, b in zip(f, m, strict=True)) / m.sum() / spread**k
    share = lambda e: [v / sum(e) for v in e if v > 0]
    entropy = lambda e: -sum(v * np.log2(v) for v in share(e)) / np.log2(len(share(e)))
    peaks = [k for k in range(1, len(m) - 1) if m[k] > (m[k - 1] if k > 1 else 0) and m[k] >= m[k + 1] and m[k] > 0.5 * m[1:].max()]
    r = [sum((x[t] - x.mean()) * (x[t + lag] - x.mean()) for t in range(n - lag)) for lag in range(n)]
    out |= {
        "Autocorrelation": next((k for k in range(n) if r[k] / r[0] < np.exp(-1)), n), "Fundamental frequency": f[peaks[0]] if peaks else f[1 + m[1:].argmax()],
        "Human range energy": sum(v**2 for k, v in zip(f, m, strict=True) if 0.6 <= k <= 2.5) / (m**2).sum(), "Maximum frequency": at(0.95), "Median frequency": at(0.5),
        "Spectral centroid": centre, "Spectral decrease": sum((m[k] - m[0]) / k for k in range(1, len(m))) / m[1:].sum(), "Spectral distance": sum(cum[-1] * k / (len(m) - 1) - cum[k] for k in range(len(m))),
        "Spectral entropy": entropy(m**2), "Spectral kurtosis": moment(4), "Spectral skewness": moment(3), "Spectral spread": spread, "Spectral roll-off": at(0.95), "Spectral roll-on": at(0.05),
        "Spectral positive turning points": sum(m[k] > m[k - 1] and m[k] > m[k + 1] for k in range(1, len(m) - 1)), "Spectral slope": np.polyfit(f, m, 1)[0],
        "Spectral variation": 1 - sum(m[k] * m[k + 1] for k in range(len(m) - 1)) / np.sqrt((m[:-1] ** 2).sum() * (m[1:] ** 2).sum()),
    }
    size = min(256, n)
    y, hann = x / x.std(), [0.5 - 0.5 * np.cos(2 * np.pi * t / size) for t in range(size)]
    parts = [y[a : a + size] for a in range(0, n - size + 1, size - size // 2)]
    power = np.mean([np.array(dft([(v - p.mean()) * h for v, h in zip(p, hann, strict=True)], size)) ** 2 for p in parts], axis=0) / fs / sum(h * h for h in hann)
    power = [v * (1 if k == 0 or 2 * k == size else 2) for k, v in enumerate(power)]
    level = lambda s: next(k * fs / size for k in range(len(power)) if sum(power[: k + 1]) >= s * sum(power) - 1e-15)
    out |= {"Max power spectrum": max(power), "Power bandwidth": level(0.975) - level(0.025)}
    # linear prediction from its normal equations, cepstrum from the logarithm of its spectrum
    r = np.array([sum(x[t] * x[t + k] for t in range(n - k)) for k in range(13)])
    a = np.append(1.0, np.linalg.solve([[r[abs(i - j)] for j in range(12)] for i in range(12)], -r[1:]))
    cepstrum = np.fft.ifft(-np.log(np.abs(np.fft.fft(a, 1 << 16)))).real * 2
    out |= {f"LPCC_{k}": cepstrum[k + 1] for k in range(12)}
    y = [x[0], *(x[t] - 0.97 * x[t - 1] for t in range(1, n))]
    width, hop = round(0.025 * fs), round(0.01 * fs)
    starts = range(0, max(1, n - width + hop), hop)
    mel = [2595 * np.log10(1 + fs / 2 / 700) * k / 41 for k in range(42)]
    edge = [int(513 * 700 * (10 ** (v / 2595) - 1) / fs) for v in mel]
    coefficients = []
    for s in starts:
        cut = [(y[s + t] if s + t < n else 0.0) * (0.54 - 0.46 * np.cos(2 * np.pi * t / (width - 1))) for t in range(width)]
        p = [v**2 / 512 for v in dft(cut, 512)]
        logs = []
        for k in range(40):
            lo, mid, hi = edge[k : k + 3]
            e = sum(p[b] * (b - lo) / (mid - lo) for b in range(lo, mid)) + sum(p[b] * (hi - b) / (hi - mid) for b in range(mid, hi))
            logs.append(20 * np.log10(max(e, np.finfo(float).eps)))
        coefficients.append([(1 + 11 * np.sin(np.pi * j / 22)) * np.sqrt(2 / 40) * sum(v * np.cos(np.pi * j * (2 * k + 1) / 80) for k, v in enumerate(logs)) for j in range(1, 13)])
    out |= {f"MFCC_{k}": np.mean([c[k] for c in coefficients]) for k in range(12)}
    energies = []
    for width in range(1, 10):
        size = min(10 * width, n)
        wave = [2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - ((t - (size - 1) / 2) / width) ** 2) * np.exp(-(((t - (size - 1) / 2) / width) ** 2) / 2) for t in range(size)]
        row = np.array([sum(x[t - j + (size - 1) // 2] * wave[j] for j in range(size) if 0 <= t - j + (size - 1) // 2 < n) for t in range(n)])
        energies.append((row**2).sum())
        k = width - 1
        out |= {f"Wavelet absolute mean_{k}": abs(row.mean()), f"Wavelet energy_{k}": np.sqrt((row**2).mean()), f"Wavelet standard deviation_{k}": row.std(), f"Wavelet variance_{k}": row.var()}
    return out | {"Wavelet entropy": entropy(energies)}


@pytest.mark.parametrize("n", [97, 300])
def test_transformed_features_by_definition(n):
    rng = np.random.default_rng(n)
    t = np.arange(n) / 100
    x = 2 + np.sin(2 * np.pi * 1.3 * t) + 0.4 * np.sin(2 * np.pi * 11 * t) + 0.3 * rng.normal(size=n)
    expected, s = by_definition(x), Spectrum(x)
    assert {f"0_{k}" for k in expected} == set(FEATURES)
    for name, value in expected.items():
        assert FEATURES[f"0_{name}"](s) == pytest.approx(float(value), rel=1e-6, abs=1e-7), name


def test_series_together_are_as_each_alone(spark, monkeypatch):
    """Matrices of series of one length against each series, short and constant ones too."""
    from chronoloom.functions import spectral

    monkeypatch.setattr(spectral, "TOGETHER", 200)
    rng = np.random.default_rng(12)
    rows = [rng.normal(size=n) * 10 for n in (1, 2, 3, 7, 64, 64, 64, 64, 301, 301) for _ in range(2)] + [np.zeros(64), np.ones(64), np.arange(64.0), np.full(3, -2.0)]
    names = list(FEATURES)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(90, None), (91, [])], "i int, v array<double>").coalesce(1)
    got = {r.i: r.f for r in table.select("i", spectral.spectral_array("v", names).alias("f")).collect()}
    assert got[90] is None and got[91] is None
    for i, v in enumerate(rows):
        alone = Spectrum(v)
        with np.errstate(all="ignore"):
            assert np.allclose(got[i], [FEATURES[n](alone)[0] for n in names], rtol=1e-9, atol=1e-9, equal_nan=True), i


def test_all_features_are_finite_on_a_ramp(spark):
    out = statistic_view(frame(spark, np.linspace(1, 100, 256), np.ones(5), [1.0], [], None)).orderBy("sample_id").collect()
    view = out[0].statistic_view
    assert set(view) == set(ALL_FEATURES) and len(ALL_FEATURES) == 133
    assert np.isfinite(list(view.values())).all()
    assert out[1].statistic_view["0_Variance"] == 0 and "0_Kurtosis" not in out[1].statistic_view
    assert out[2].statistic_view["0_Mean"] == 1 and out[2].error is None
    assert [r.statistic_view for r in out[3:]] == [None, None] and [r.error for r in out[3:]] == ["empty series"] * 2


def test_groups(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"features": ["0_Mean", "0_Variance", "", 1]}))
    (tmp_path / "b.txt").write_text("1. 0_Mean\n=== header ===\n0_Variance\n")
    for name in ("a.json", "b.txt"):
        assert load_group(tmp_path / name) == ["0_Mean", "0_Variance"]
        assert resolve([str(tmp_path / name)]) == ["0_Mean", "0_Variance"]
    assert len(resolve(None)) == 133 and resolve(["wavelet"]) == GROUPS["wavelet"]
    with pytest.raises(ValueError):
        resolve(["nothing"])
    assert snake("0_Spectral roll-off") == "spectral_roll_off" and len({snake(n) for n in ALL_FEATURES}) == 133


def test_only_what_is_asked_for(spark):
    out = statistic_view(frame(spark, np.linspace(1, 50, 256), np.linspace(2, 100, 256)), ["0_Mean", "0_Variance"])
    assert all(set(r.statistic_view) == {"0_Mean", "0_Variance"} for r in out.collect())
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [64, 65_536])
def test_density_of_points(spark, monkeypatch, chunk):
    """Of tables of points as of whole series."""
    from chronoloom.operators import series
    from chronoloom.operators.long_series import welch_density

    monkeypatch.setattr(series, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    held = {"a": rng.normal(size=1000) * 3 + 5, "b": np.sin(np.arange(256) / 3.0), "c": np.ones(300), "d": rng.normal(size=20)}
    points = spark.createDataFrame([(s, t, float(v)) for s, x in held.items() for t, v in enumerate(x)], "s string, t long, value double").repartition(4)
    got = {}
    for r in welch_density(points, by=["s"]).collect():
        got.setdefault(r.s, {})[r.k] = (r.frequency, r.power)
    assert set(got) == {"a", "b", "c"}
    for s in got:
        f, p = Spectrum(held[s]).get("welch")
        assert np.allclose([got[s][k] for k in range(129)], np.stack([f, p[0]], axis=1), atol=1e-12)
    with pytest.raises(Exception, match="no value"):
        welch_density(points.withColumn("value", F.lit(None).cast("double")), by=["s"]).collect()
