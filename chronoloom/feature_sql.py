"""SQL of the features that need a transform, as sums over the terms of their definitions, for series ``u`` (sample_id, x, n)."""

from __future__ import annotations

SERIES = "u AS (SELECT user_id AS sample_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS x, count(*) AS n FROM events GROUP BY user_id)"
POINTS = "pt AS (SELECT sample_id, n, unnest(range(0, n)) AS t, unnest(x) AS v FROM u)"


def _rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in columns.items())


def _at(share: str, f: str = "f", cum: str = "cum", total: str = "tot") -> str:
    return f"coalesce(min({f}) FILTER (WHERE {cum} >= {share} * {total}), 0)"


_ENERGY = "sum(m * m)"
_OF_SPECTRUM = {
    "fundamental_frequency": "CASE WHEN max(top) = 0 THEN 0 ELSE coalesce(min(f) FILTER (WHERE k BETWEEN 1 AND nk - 2 AND m > CASE WHEN k > 1 THEN prev ELSE 0 END AND m >= next AND m > 0.5e0 * top), min(f) FILTER (WHERE k > 0 AND m = top)) END",
    "human_range_energy": f"coalesce(sum(m * m) FILTER (WHERE f >= 0.6e0 AND f <= 2.5e0), 0) / {_ENERGY}",
    "maximum_frequency": _at("0.95e0"),
    "median_frequency": _at("0.5e0"),
    "spectral_centroid": "max(c)",
    "spectral_decrease": "sum((m - m0) / k) FILTER (WHERE k > 0) / sum(m) FILTER (WHERE k > 0)",
    "spectral_distance": "sum(tot * k / (nk - 1) - cum)",
    "spectral_entropy": "-sum(CASE WHEN m > 0 THEN m * m / e * log2(m * m / e) ELSE 0 END) / log2(count(*) FILTER (WHERE m > 0))",
    "spectral_kurtosis": "sum(pow(f - c, 4) * m) / max(tot) / pow(max(spread), 4)",
    "spectral_positive_turning_points": "count(*) FILTER (WHERE k BETWEEN 1 AND nk - 2 AND m > prev AND m > next)",
    "spectral_roll_off": _at("0.95e0"),
    "spectral_roll_on": _at("0.05e0"),
    "spectral_skewness": "sum(pow(f - c, 3) * m) / max(tot) / pow(max(spread), 3)",
    "spectral_slope": "sum((f - mid) * m) / sum((f - mid) * (f - mid))",
    "spectral_spread": "max(spread)",
    "spectral_variation": "1 - sum(m * next) FILTER (WHERE k < nk - 1) / sqrt(sum(m * m) FILTER (WHERE k < nk - 1) * sum(m * m) FILTER (WHERE k > 0))",
}

#: Magnitudes of the whole series, Welch's density, and the autocorrelation.
SPECTRAL = f"""WITH {SERIES}, {POINTS},
d AS (SELECT sample_id, n, k, k * (1e0 / (n * 1e-2)) AS f, sqrt(pow(sum(v * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((k * t) % n) / n)), 2)) AS m
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM pt) GROUP BY sample_id, n, k),
s AS (SELECT *, sum(m) OVER (w ORDER BY k) AS cum, sum(m) OVER w AS tot, lag(m) OVER (w ORDER BY k) AS prev, lead(m) OVER (w ORDER BY k) AS next, max(CASE WHEN k > 0 THEN m ELSE 0 END) OVER w AS top,
  max(CASE WHEN k = 0 THEN m END) OVER w AS m0, count(*) OVER w AS nk, avg(f) OVER w AS mid, sum(m * m) OVER w AS e, sum(f * m) OVER w / sum(m) OVER w AS c FROM d WINDOW w AS (PARTITION BY sample_id)),
s2 AS (SELECT *, sqrt(sum((f - c) * (f - c) * m) OVER (PARTITION BY sample_id) / tot) AS spread FROM s),
whole AS (SELECT sample_id, {_rounded(_OF_SPECTRUM)} FROM s2 GROUP BY sample_id),
y AS (SELECT sample_id, n, least(256, n) AS z, t, v / CASE WHEN dev = 0 THEN 1 ELSE dev END AS v FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY sample_id) AS dev FROM pt)),
seg AS (SELECT *, avg(v) OVER (PARTITION BY sample_id, a) AS mean, CASE WHEN z > 1 THEN 0.5e0 - 0.5e0 * cos(2 * pi() * (t - a) / z) ELSE 1 END AS h
  FROM (SELECT *, unnest(range(0, n - z + 1, greatest(1, z - z // 2))) AS a FROM y) WHERE t >= a AND t < a + z),
wd AS (SELECT sample_id, z, a, k, (pow(sum((v - mean) * h * cos(2 * pi() * ((k * (t - a)) % z) / z)), 2) + pow(sum((v - mean) * h * sin(2 * pi() * ((k * (t - a)) % z) / z)), 2)) / (100 * sum(h * h)) AS p
  FROM (SELECT *, unnest(range(0, z // 2 + 1)) AS k FROM seg) GROUP BY sample_id, z, a, k),
wp AS (SELECT sample_id, k * (1e0 / (z * 1e-2)) AS f, avg(p) * CASE WHEN k = 0 OR 2 * k = z THEN 1 ELSE 2 END AS p, k FROM wd GROUP BY sample_id, z, k),
wc AS (SELECT *, sum(p) OVER (PARTITION BY sample_id ORDER BY k) / sum(p) OVER (PARTITION BY sample_id) AS cum FROM wp),
welch AS (SELECT sample_id, round(max(p), 6) AS max_power_spectrum, round({_at('0.975e0', total='1')} - {_at('0.025e0', total='1')}, 6) AS power_bandwidth FROM wc GROUP BY sample_id),
b AS (SELECT sample_id, n, t, v - avg(v) OVER (PARTITION BY sample_id) AS v FROM pt),
ac AS (SELECT x.sample_id, x.n, y.t - x.t AS lag, sum(x.v * y.v) AS r FROM b x JOIN b y ON x.sample_id = y.sample_id AND y.t >= x.t GROUP BY x.sample_id, x.n, y.t - x.t),
auto AS (SELECT sample_id, CAST(coalesce(min(lag) FILTER (WHERE r / r0 < exp(-1e0)), max(n)) AS DOUBLE) AS autocorrelation FROM (SELECT *, max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY sample_id) AS r0 FROM ac) GROUP BY sample_id)
SELECT * FROM whole JOIN welch USING (sample_id) JOIN auto USING (sample_id)"""

_LPCC = ", ".join(f"round(c[{k + 2}], 6) AS lpcc_{k}" for k in range(12))
_MFCC = ", ".join(f"round(max(CASE WHEN j = {k + 1} THEN coefficient END), 6) AS mfcc_{k}" for k in range(12))
#: Levinson's recursion on lists, and energies of mel filters from the autocorrelation of frames of two values.
CEPSTRAL = f"""WITH RECURSIVE {SERIES}, {POINTS},
r AS (SELECT sample_id, list(s ORDER BY lag) AS r FROM (SELECT x.sample_id, y.t - x.t AS lag, sum(x.v * y.v) AS s FROM pt x JOIN pt y ON x.sample_id = y.sample_id AND y.t - x.t BETWEEN 0 AND 12 GROUP BY x.sample_id, y.t - x.t) GROUP BY sample_id),
lev AS (SELECT sample_id, r, 0 AS i, list_transform(range(0, 13), lambda j: CASE WHEN j = 0 THEN 1e0 ELSE 0e0 END) AS a, r[1] AS e FROM r
  UNION ALL
  SELECT sample_id, r, i + 1, list_transform(range(0, 13), lambda j: a[j + 1] + CASE WHEN j BETWEEN 1 AND i + 1 THEN q * a[i + 2 - j] ELSE 0e0 END), e * (1 - q * q)
  FROM (SELECT *, CASE WHEN abs(e) > 1e-12 THEN -(r[i + 2] + coalesce(list_sum(list_transform(range(1, i + 1), lambda j: a[j + 1] * r[i + 2 - j])), 0)) / e ELSE 0e0 END AS q FROM lev WHERE i < 12)),
cep AS (SELECT sample_id, a, 0 AS m, [0e0] AS c FROM lev WHERE i = 12
  UNION ALL
  SELECT sample_id, a, m + 1, list_append(c, -a[m + 2] - coalesce(list_sum(list_transform(range(1, m + 1), lambda k: CAST(k AS DOUBLE) / (m + 1) * c[k + 1] * a[m + 2 - k])), 0)) FROM cep WHERE m < 12),
lpcc AS (SELECT sample_id, {_LPCC} FROM cep WHERE m = 12),
edge AS (SELECT i, CAST(floor(513 * 700 * (pow(10e0, 2595 * log10(1 + 50e0 / 700) * i / 41 / 2595) - 1) / 100) AS BIGINT) AS b FROM (SELECT unnest(range(0, 42)) AS i)),
filter AS (SELECT x.i AS f, x.b AS lo, y.b AS mid, z.b AS hi FROM edge x JOIN edge y ON y.i = x.i + 1 JOIN edge z ON z.i = x.i + 2),
bank AS (SELECT f, k, CASE WHEN k < mid THEN CAST(k - lo AS DOUBLE) / greatest(1, mid - lo) ELSE CAST(hi - k AS DOUBLE) / greatest(1, hi - mid) END AS g FROM (SELECT *, unnest(range(lo, hi)) AS k FROM filter)),
lags AS (SELECT x.f, coalesce(sum(g), 0) / 512 AS w0, coalesce(sum(g * 2 * cos(2 * pi() * k / 512)), 0) / 512 AS w1 FROM filter x LEFT JOIN bank USING (f) GROUP BY x.f),
pre AS (SELECT sample_id, n, t, 8e-2 * (v - coalesce(97e-2 * lag(v) OVER (PARTITION BY sample_id ORDER BY t), 0)) AS y FROM pt),
frame AS (SELECT x.sample_id, x.t, x.y * x.y + coalesce(y.y * y.y, 0) AS r0, x.y * coalesce(y.y, 0) AS r1 FROM pre x LEFT JOIN pre y ON y.sample_id = x.sample_id AND y.t = x.t + 1 WHERE x.t < greatest(1, x.n - 1)),
mel AS (SELECT sample_id, f, avg(20 * log10(greatest(r0 * w0 + r1 * w1, 2.220446049250313e-16))) AS e FROM frame, lags GROUP BY sample_id, f),
mf AS (SELECT sample_id, j, (1 + 11 * sin(pi() * j / 22)) * sqrt(2e0 / 40) * sum(e * cos(pi() * j * (2 * f + 1) / 80)) AS coefficient FROM (SELECT *, unnest(range(1, 13)) AS j FROM mel) GROUP BY sample_id, j),
mfcc AS (SELECT sample_id, {_MFCC} FROM mf GROUP BY sample_id)
SELECT * FROM lpcc JOIN mfcc USING (sample_id)"""

_WAVES = {
    "wavelet_absolute_mean": "abs(mean)", "wavelet_energy": "sqrt(square)", "wavelet_standard_deviation": "sqrt(var)", "wavelet_variance": "var",
}
_BY_WIDTH = ", ".join(f"round(max(CASE WHEN a = {k + 1} THEN {e} END), 6) AS {n}_{k}" for n, e in _WAVES.items() for k in range(9))
#: Convolutions with Ricker wavelets of widths 1 to 9.
WAVELET = f"""WITH {SERIES},
c AS (SELECT sample_id, a, list_sum(list_transform(range(greatest(0, t + (z - 1) // 2 - n + 1), least(z, t + (z - 1) // 2 + 1)), lambda j:
    x[t - j + (z - 1) // 2 + 1] * 2 / (sqrt(3e0 * a) * pow(pi(), 0.25e0)) * (1 - pow((j - (z - 1) / 2e0) / a, 2)) * exp(-pow((j - (z - 1) / 2e0) / a, 2) / 2))) AS v
  FROM (SELECT *, unnest(range(0, n)) AS t FROM (SELECT *, least(10 * a, n) AS z FROM (SELECT *, unnest(range(1, 10)) AS a FROM u)))),
s AS (SELECT sample_id, a, avg(v) AS mean, avg(v * v) AS square, var_pop(v) AS var, sum(v * v) AS e FROM c GROUP BY sample_id, a),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id) AS share FROM s)
SELECT sample_id, {_BY_WIDTH}, round(-sum(CASE WHEN share > 0 THEN share * log2(share) ELSE 0 END) / log2(count(*) FILTER (WHERE share > 0)), 6) AS wavelet_entropy FROM p GROUP BY sample_id"""

#: Welch's density of the events of each type, as one series.
WELCH_POINTS = """WITH pt AS (SELECT event_type, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, CAST(coalesce(value, 0) AS DOUBLE) AS v FROM events),
y AS (SELECT event_type, n, t, v / CASE WHEN dev = 0 THEN 1 ELSE dev END AS v FROM (SELECT *, stddev_pop(v) OVER (PARTITION BY event_type) AS dev FROM pt) WHERE n >= 64),
seg AS (SELECT *, avg(v) OVER (PARTITION BY event_type, a) AS mean, 0.5e0 - 0.5e0 * cos(2 * pi() * (t - a) / 64) AS h FROM (SELECT *, unnest(range(0, n - 63, 32)) AS a FROM y) WHERE t >= a AND t < a + 64),
wd AS (SELECT event_type, a, k, (pow(sum((v - mean) * h * cos(2 * pi() * ((k * (t - a)) % 64) / 64)), 2) + pow(sum((v - mean) * h * sin(2 * pi() * ((k * (t - a)) % 64) / 64)), 2)) / (100 * sum(h * h)) AS p
  FROM (SELECT *, unnest(range(0, 33)) AS k FROM seg) GROUP BY event_type, a, k)
SELECT event_type, k, round(k * 100e0 / 64, 6) AS frequency, round(avg(p) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) AS power FROM wd GROUP BY event_type, k"""
