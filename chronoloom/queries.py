"""Registered queries over the driver's tables, and the SQL that they are held against.

``embeddings`` serve as feature vectors and, in eight pieces, as eight channels; ``events`` as one series for
each user, with errors as point labels. Queries are the last fifth by id against the first four fifths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feature_sql
from .functions import labels as L
from .functions import text as X
from .functions.features import statistic_view, with_features
from .functions.vectors import downsample, rounded, znorm
from .operators import gallery as G
from .operators import metrics as M
from .operators import retrieval as R
from .operators import selector as S
from .operators import series as W
from .operators.long_series import welch_density
from .operators.positions import with_positions
from .schema import RetrieverConfig, SelectorConfig
from .session import shared_folder
from .sources import writers
from .sources.skab import load_skab_sequences, load_skab_windows
from .sources.ucr import load_ucr
from .sources.uea import load_uea

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("entry_id"), F.col("vec_id").cast("string").alias("sample_id"), F.col("label").cast("string").alias("label"),
        F.lit(0).alias("channel_id"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vector"),
    )


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and gallery."""
    rows = W.prefix_split(vectors(spark, sf_dir), 0.8, order="ord")
    return rows.where("split = 'test'").withColumnRenamed("entry_id", "query_id"), rows.where("split = 'train'")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as eight channels of eight steps, as a series table."""
    e = _table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    parts = F.array(*[F.slice(v, 8 * c + 1, 8) for c in range(8)])
    return e.select(
        F.col("vec_id").cast("string").alias("sample_id"), F.lit("train").alias("split"), F.col("vec_id").alias("sample_index"),
        F.posexplode(parts).alias("channel_id", "values"), F.col("label").cast("string").alias("label"),
    )


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of values for each user, by time, with errors as point labels."""
    e = _table(spark, sf_dir, "events")
    point = F.struct("ts", "event_id", F.col("value").cast("double").alias("v"), (F.col("event_type") == "error").cast("int").alias("y"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("p"))
    return rows.select(
        F.col("user_id").alias("sample_id"), F.lit("train").alias("split"), F.col("user_id").alias("sample_index"), F.lit(0).alias("channel_id"),
        F.transform("p", lambda x: x["v"]).alias("values"), F.transform("p", lambda x: x["y"]).alias("point_labels"), F.lit("").alias("label"),
    )


# --- retrieval -----------------------------------------------------------------------------------------------

WEIGHTS = tuple(float(1 + i % 3) for i in range(64))
_E = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
  row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings),
q0 AS (SELECT vec_id, label, v FROM e WHERE r > least(greatest(1, CAST(floor(n * 0.8) AS BIGINT)), n - 1)),
g0 AS (SELECT vec_id, label, v FROM e WHERE r <= least(greatest(1, CAST(floor(n * 0.8) AS BIGINT)), n - 1))"""
_LOG = "list_transform(v, lambda x: sign(x) * ln(1 + abs(x)))"
_LONG = "SELECT unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM {g}"
_FIT = {
    "zscore": "SELECT i, avg(x) AS c, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM long GROUP BY i",
    "robust": """SELECT i, quantile_cont(x, 0.5) AS c, CASE WHEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) = 0 THEN 1.0
  ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END AS s FROM long GROUP BY i""",
}
_DIST = {
    "cosine": """CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 1.0 ELSE
  greatest(0.0, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) END""",
    "l2": "list_distance(a, b)",
    "weighted_l2": "list_distance(list_transform(a, lambda x, i: x * sqrt(1 + (i - 1) % 3)), list_transform(b, lambda x, i: x * sqrt(1 + (i - 1) % 3)))",
}


def knn_sql(distance: str, normalize: str) -> str:
    """CTEs that end in near (query_id, q_label, rank, sample_id, label, d)."""
    steps = [_E]
    if normalize == "none":
        steps.append("q AS (SELECT * FROM q0), g AS (SELECT * FROM g0)")
    else:
        change = _LOG if normalize.startswith("log1p") else "v"
        steps.append(f"q1 AS (SELECT vec_id, label, {change} AS v FROM q0), g1 AS (SELECT vec_id, label, {change} AS v FROM g0)")
        steps.append(f"long AS ({_LONG.format(g='g1')}), st AS ({_FIT['zscore' if normalize == 'zscore' else 'robust']})")
        steps.append("fit AS (SELECT list(c ORDER BY i) AS c, list(s ORDER BY i) AS s FROM st)")
        for k in "qg":
            steps.append(f"{k} AS (SELECT vec_id, label, list_transform(v, lambda x, i: (x - c[i]) / s[i]) AS v FROM {k}1, fit)")
    steps.append(f"""d AS (SELECT query_id, q_label, sample_id, label, {_DIST[distance]} AS d FROM (
  SELECT q.vec_id AS query_id, q.label AS q_label, q.v AS a, g.vec_id AS sample_id, g.label AS label, g.v AS b FROM q, g WHERE q.vec_id <> g.vec_id)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), sample_id) AS rank FROM d QUALIFY rank <= 5)""")
    return "WITH " + ",\n".join(steps)


def _shown(near: DataFrame) -> DataFrame:
    return near.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("sample_id").cast("long").alias("sample_id"), F.col("label").cast("int").alias("label"), F.round("distance", 6).alias("distance"))


for _d in ("cosine", "l2", "weighted_l2"):
    for _n in ("none", "zscore", "robust", "log1p_robust"):

        def _knn(spark: SparkSession, sf_dir: str, d: str = _d, n: str = _n) -> DataFrame:
            q, g = halves(spark, sf_dir)
            return _shown(R.knn(q, g, RetrieverConfig(d, n, 5, WEIGHTS if d == "weighted_l2" else None)))

        query(f"knn_{_d}_{_n}", knn_sql(_d, _n) + "\nSELECT query_id, rank, sample_id, label, round(d, 6) AS distance FROM near")(_knn)


@query(
    "knn_loo_l2",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS sample_id, b.label, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, rank, sample_id, label, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), sample_id) AS rank FROM d) WHERE rank <= 5""",
)
def knn_loo_l2(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _shown(R.knn(rows.withColumnRenamed("entry_id", "query_id"), rows, RetrieverConfig("l2", "none", 5)))


@query("knn_pruned_l2", SQL["knn_loo_l2"])
def knn_pruned_l2(spark, sf_dir):
    """The same with blocks left out by pivots."""
    rows = vectors(spark, sf_dir)
    return _shown(R.knn(rows.withColumnRenamed("entry_id", "query_id"), rows, RetrieverConfig("l2", "none", 5), by_pivots=True))


@query(
    "topk_metrics",
    knn_sql("cosine", "zscore")
    + """
SELECT round(avg(hit), 6) AS top_k_accuracy, round(avg(m / 5.0), 6) AS precision_at_k, count(*) AS num_query FROM (
  SELECT query_id, max(CASE WHEN label = q_label THEN 1.0 ELSE 0.0 END) AS hit, CAST(sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) AS DOUBLE) AS m FROM near GROUP BY query_id)""",
)
def topk_metrics(spark, sf_dir):
    q, g = halves(spark, sf_dir)
    near = R.knn(q, g, RetrieverConfig("cosine", "zscore", 5))
    out = M.batch_metrics(M.query_metrics(q, near, 5))
    return out.select(F.round("top_k_accuracy", 6).alias("top_k_accuracy"), F.round("precision_at_k", 6).alias("precision_at_k"), "num_query")


@query(
    "confidence_top1",
    knn_sql("l2", "robust") + "\nSELECT query_id, label AS prediction, round(1 / (1 + d), 6) AS confidence FROM near WHERE rank = 1",
)
def confidence_top1(spark, sf_dir):
    q, g = halves(spark, sf_dir)
    out = R.top_predictions(R.knn(q, g, RetrieverConfig("l2", "robust", 5)))
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.col("prediction").cast("int").alias("prediction"), F.round("confidence", 6).alias("confidence"))


for _n in ("zscore", "robust"):

    @query(
        f"norm_stats_{_n}",
        f"""WITH e AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), long AS ({_LONG.format(g="e")}),
st AS ({_FIT[_n]}) SELECT CAST(i - 1 AS INT) AS dim, round(c, 6) AS centre, round(s, 6) AS scale FROM st""",
    )
    def _norm(spark, sf_dir, n=_n):
        return R.norm_stats(vectors(spark, sf_dir), n).select("dim", F.round("centre", 6).alias("centre"), F.round("scale", 6).alias("scale"))


_CH = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings),
ch AS (SELECT vec_id, label, r, n, c, list_slice(v, 8 * c + 1, 8 * c + 8) AS v FROM (SELECT *, unnest(generate_series(0, 7)) AS c FROM e))"""


@query(
    "metrics_by_channel_macro",
    f"""WITH {_CH}, d AS (SELECT q.vec_id AS query_id, q.c, q.label AS ql, g.label, row_number() OVER (PARTITION BY q.vec_id, q.c ORDER BY round(list_distance(q.v, g.v), 9), g.vec_id) AS rank
  FROM ch q JOIN ch g ON q.c = g.c AND q.vec_id <> g.vec_id WHERE q.r > least(greatest(1, CAST(floor(q.n * 0.8) AS BIGINT)), q.n - 1) AND g.r <= least(greatest(1, CAST(floor(g.n * 0.8) AS BIGINT)), g.n - 1)),
m AS (SELECT query_id, c, max(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS a, CAST(sum(CASE WHEN label = ql THEN 1 ELSE 0 END) AS DOUBLE) / 5 AS p FROM d WHERE rank <= 5 GROUP BY query_id, c)
SELECT query_id, round(avg(a), 6) AS top_k_accuracy, round(avg(p), 6) AS precision_at_k, count(*) AS num_channels FROM m GROUP BY query_id""",
)
def metrics_by_channel_macro(spark, sf_dir):
    rows = channels(spark, sf_dir).withColumn("ord", F.col("sample_index"))
    rows = _split_samples(rows)
    keyed = rows.select(F.concat("sample_id", F.lit("#"), "channel_id").alias("key"), "sample_id", "channel_id", "label", "ord", F.col("values").alias("vector"), "split")
    q = keyed.where("split = 'test'").withColumnRenamed("key", "query_id")
    near = R.knn(q, keyed.where("split = 'train'").withColumnRenamed("key", "entry_id"), RetrieverConfig("l2", "none", 5))
    per = M.query_metrics(q, near, 5)
    per = per.withColumn("channel_id", F.split("query_id", "#")[1].cast("int")).withColumn("query_id", F.split("query_id", "#")[0].cast("long"))
    return M.macro_metrics(per).select("query_id", F.round("top_k_accuracy", 6).alias("top_k_accuracy"), F.round("precision_at_k", 6).alias("precision_at_k"), "num_channels")


def _split_samples(rows: DataFrame) -> DataFrame:
    """The split of samples, given to all their channels."""
    samples = W.prefix_split(rows.select("sample_id", "ord").distinct(), 0.8, order="ord").select("sample_id", "split")
    return rows.drop("split").join(samples, "sample_id")


# --- labels, splits, windows ---------------------------------------------------------------------------------


@query("label_remap_numeric", "SELECT vec_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS class_id FROM embeddings")
def label_remap_numeric(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return L.remap_labels(rows, L.numeric_label_map(rows), numeric=True)


@query(
    "label_remap_declared",
    "SELECT doc_id, lang, CAST(list_position(['en', 'fr', 'de', 'es'], lang) - 1 AS BIGINT) AS class_id FROM documents",
)
def label_remap_declared(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.remap_labels(rows, L.declared_label_map(spark, ["en", "fr", "de", "es"]), label_col="lang")


@query(
    "label_remap_first_seen",
    "SELECT label, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS class_id FROM (SELECT lang AS label, min(doc_id) AS f FROM documents GROUP BY lang)",
)
def label_remap_first_seen(spark, sf_dir):
    return L.first_seen_label_map(_table(spark, sf_dir, "documents"), order=["doc_id"], label_col="lang")


@query(
    "split_prefix_ratio",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= least(greatest(1, CAST(floor(count(*) OVER () * 0.5) AS BIGINT)), count(*) OVER () - 1)
THEN 'train' ELSE 'test' END AS split FROM orders""",
)
def split_prefix_ratio(spark, sf_dir):
    return W.prefix_split(_table(spark, sf_dir, "orders").select("o_orderkey"), 0.5, order="o_orderkey")


@query(
    "cap_first_n",
    "SELECT event_type AS split, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100",
)
def cap_first_n(spark, sf_dir):
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), "event_id")
    # a limit on the rank itself lets Spark drop the rest before the shuffle
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy("event_id"))).where("n <= 100")
    return W.cap_per_split(first.withColumn("sample_index", F.col("n").cast("long") - 1), 100).select("split", "event_id")


_U = """u AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS v, list(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END ORDER BY ts, event_id) AS y FROM events GROUP BY user_id)"""
_RULE = {"any": "list_max(w) > 0", "all": "list_min(w) > 0", "ratio": "list_sum(w) / 10.0 >= 0.3"}
for _r in ("any", "all", "ratio"):

    @query(
        f"window_{_r}",
        f"""WITH {_U} SELECT user_id || '__w' || s || '_' || (s + 10) AS sample_id, CAST(s AS INT) AS start, CASE WHEN {_RULE[_r]} THEN 1 ELSE 0 END AS label
FROM (SELECT user_id, s, list_slice(y, s + 1, s + 10) AS w FROM (SELECT user_id, y, unnest(generate_series(0, len(y) - 10, 5)) AS s FROM u WHERE len(y) >= 10))""",
    )
    def _window(spark, sf_dir, r=_r):
        rows = user_series(spark, sf_dir).select("sample_id", F.array("values").alias("channels"), "point_labels")
        return W.sliding_windows(rows, size=10, stride=5, rule=r, threshold=0.3).select("sample_id", "start", "label")


@query(
    "sequence_label",
    f"WITH {_U} SELECT user_id AS sample_id, CASE WHEN list_max(y) > 0 THEN 1 ELSE 0 END AS any_error, CASE WHEN list_sum(y) / CAST(len(y) AS DOUBLE) >= 0.2 THEN 1 ELSE 0 END AS many_errors FROM u",
)
def sequence_label(spark, sf_dir):
    return user_series(spark, sf_dir).select("sample_id", L.point_label("point_labels", "any").alias("any_error"), L.point_label("point_labels", "ratio", 0.2).alias("many_errors"))


@query(
    "window_1d_count",
    f"WITH {_U} SELECT user_id AS sample_id, count(*) AS n, round(sum(list_sum(list_slice(v, s + 1, s + 8))), 4) AS total FROM (SELECT user_id, v, unnest(generate_series(0, len(v) - 8, 4)) AS s FROM u WHERE len(v) >= 8) GROUP BY user_id",
)
def window_1d_count(spark, sf_dir):
    rows = user_series(spark, sf_dir).where(F.size("values") >= 8).select("sample_id", "values")
    wins = W.windows_1d(rows, size=8, stride=4)
    return wins.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


@query(
    "downsample",
    f"""WITH {_U} SELECT user_id AS sample_id, CASE WHEN len(v) <= 16 THEN v ELSE list_transform(generate_series(0, 15), lambda i: v[CAST(round_even(i * CAST(len(v) - 1 AS DOUBLE) / 15, 0) AS INT) + 1]) END AS points FROM u""",
)
def downsample_query(spark, sf_dir):
    return user_series(spark, sf_dir).select("sample_id", downsample("values", 16).alias("points"))


@query(
    "znorm_series",
    f"""WITH {_U} SELECT user_id AS sample_id, list_transform(v, lambda x: round((x - list_avg(v)) / CASE WHEN list_var_pop(v) <= 1e-12 THEN 1.0 ELSE sqrt(list_var_pop(v)) END, 6)) AS z FROM u""",
)
def znorm_query(spark, sf_dir):
    return user_series(spark, sf_dir).select("sample_id", F.transform(znorm("values"), lambda x: rounded(x)).alias("z"))


# --- features ------------------------------------------------------------------------------------------------

_X = f"""WITH {_U}, p AS (SELECT user_id AS sample_id, v, CAST(len(v) AS DOUBLE) AS n, list_sort(v) AS s, list_avg(v) AS m,
  list_transform(generate_series(1, len(v) - 1), lambda i: v[i + 1] - v[i]) AS d FROM u)"""


def _round(rows: DataFrame) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("split", "sample_index", "channel_id", "values", "point_labels", "label")]
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.select(*keep).dtypes])



def _q(s: str, n: str, p: float) -> str:
    """A quantile of a sorted list with linear interpolation."""
    h = f"(({n}) - 1) * CAST({p} AS DOUBLE)"
    return f"({s}[CAST(floor({h}) AS INT) + 1] + ({h} - floor({h})) * ({s}[CAST(least(floor({h}) + 1, ({n}) - 1) AS INT) + 1] - {s}[CAST(floor({h}) AS INT) + 1]))"


def _mom(k: int) -> str:
    return f"(list_sum(list_transform(v, lambda x: pow(x - m, {k}))) / n)"


_STATS = {
    "interquartile_range": f"{_q('s', 'n', 0.75)} - {_q('s', 'n', 0.25)}",
    "kurtosis": f"{_mom(4)} / pow({_mom(2)}, 2) - 3",
    "max": "list_max(v)",
    "mean": "m",
    "mean_absolute_deviation": "list_avg(list_transform(v, lambda x: abs(x - m)))",
    "mean_absolute_diff": "list_avg(list_transform(d, lambda x: abs(x)))",
    "mean_diff": "list_avg(d)",
    "median": _q("s", "n", 0.5),
    "median_absolute_deviation": _q(f"list_sort(list_transform(v, lambda x: abs(x - {_q('s', 'n', 0.5)})))", "n", 0.5),
    "median_absolute_diff": _q("list_sort(list_transform(d, lambda x: abs(x)))", "n - 1", 0.5),
    "median_diff": _q("list_sort(d)", "n - 1", 0.5),
    "min": "list_min(v)",
    "skewness": f"{_mom(3)} / pow({_mom(2)}, 1.5)",
    "standard_deviation": f"sqrt({_mom(2)})",
    "sum_absolute_diff": "list_sum(list_transform(d, lambda x: abs(x)))",
    "variance": _mom(2),
}
_SHAPE = {
    "absolute_energy": "list_sum(list_transform(v, lambda x: x * x))",
    "area_under_the_curve": "list_sum(list_transform(generate_series(1, len(v) - 1), lambda i: (v[i] + v[i + 1]) / 2)) / 100",
    "entropy": "(log2(n) - list_sum(list_transform(list_distinct(v), lambda x: len(list_filter(v, lambda y: y = x)) * log2(len(list_filter(v, lambda y: y = x))))) / n) / log2(n)",
    "root_mean_square": "sqrt(list_avg(list_transform(v, lambda x: x * x)))",
    "signal_distance": "list_sum(list_transform(d, lambda x: sqrt(1 + x * x)))",
    "slope": "list_sum(list_transform(v, lambda x, i: (i - 1 - (n - 1) / 2) * x)) / (n * (n * n - 1) / 12)",
    "peak_to_peak_distance": "list_max(v) - list_min(v)",
}
_PEAKS = {
    "negative_turning_points": "CAST(len(list_filter(generate_series(1, len(d) - 1), lambda i: d[i] < 0 AND d[i + 1] > 0)) AS DOUBLE)",
    "positive_turning_points": "CAST(len(list_filter(generate_series(1, len(d) - 1), lambda i: d[i] > 0 AND d[i + 1] < 0)) AS DOUBLE)",
    "neighbourhood_peaks": "CAST(len(list_filter(generate_series(11, len(v) - 10), lambda i: v[i] > list_max(list_slice(v, i - 10, i - 1)) AND v[i] > list_max(list_slice(v, i + 1, i + 10)))) AS DOUBLE)",
    "zero_crossing_rate": "CAST(len(list_filter(generate_series(1, len(v) - 1), lambda i: sign(v[i]) <> sign(v[i + 1]))) AS DOUBLE)",
}
_ECDF = {f"ecdf_{k}": f"CASE WHEN n > {k} THEN {k + 1} / n END" for k in range(10)}
_ECDF |= {f"ecdf_percentile_count_{k}": f"floor(n * CAST({p} AS DOUBLE))" for k, p in enumerate((0.2, 0.8))}
_ECDF |= {f"ecdf_percentile_{k}": f"s[greatest(CAST(floor(n * CAST({p} AS DOUBLE)) AS INT), 1)]" for k, p in enumerate((0.2, 0.8))}
_ECDF |= {
    f"histogram_{k}": f"CAST(len(list_filter(v, lambda x: CASE WHEN list_max(v) = list_min(v) THEN 5 ELSE least(floor((x - list_min(v)) * 10 / (list_max(v) - list_min(v))), 9) END = {k})) AS DOUBLE)"
    for k in range(10)
}
_POWER = {
    "average_power": "list_sum(list_transform(v, lambda x: x * x)) / ((n - 1) / 100)",
    "centroid": "list_sum(list_transform(v, lambda x, i: (i - 1) / 100.0 * x * x)) / list_sum(list_transform(v, lambda x: x * x))",
}


def _feature_sql(exprs: dict[str, str]) -> str:
    return _X + " SELECT sample_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in exprs.items()) + " FROM p"


for _name, _exprs, _groups in (
    ("feat_statistics", _STATS, ["statistics"]),
    ("feat_distribution", _ECDF, ["distribution"]),
    ("feat_complexity_peaks", _PEAKS, ["0_Negative turning points", "0_Positive turning points", "0_Neighbourhood peaks", "0_Zero crossing rate"]),
    ("feat_time_shape_energy", _SHAPE, ["time_shape_energy"]),
    ("feat_power", _POWER, ["0_Average power", "0_Centroid"]),
):

    @query(_name, _feature_sql(_exprs))
    def _features(spark, sf_dir, groups=_groups):
        return _round(with_features(user_series(spark, sf_dir), groups))


_JOINED = lambda *parts: "SELECT * FROM " + " JOIN ".join(f"({SQL.get(p, p)}) AS t{i}" + (" USING (sample_id)" if i else "") for i, p in enumerate(parts))
_SPECTRAL = _JOINED("feat_power", feature_sql.SPECTRAL)
_ALL = _JOINED("feat_statistics", "feat_distribution", "feat_complexity_peaks", "feat_time_shape_energy", _SPECTRAL, feature_sql.CEPSTRAL, feature_sql.WAVELET)
for _name, _sql, _groups in (
    ("feat_spectral", _SPECTRAL, ["spectral_frequency", "0_Autocorrelation"]),
    ("feat_cepstral", feature_sql.CEPSTRAL, ["cepstral"]),
    ("feat_wavelet", feature_sql.WAVELET, ["wavelet"]),
    ("feat_all", _ALL, None),
):

    @query(_name, _sql)
    def _more(spark, sf_dir, groups=_groups):
        return _round(with_features(user_series(spark, sf_dir), groups))


# --- gallery, selector, text ---------------------------------------------------------------------------------


def channel_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistic_view(channels(spark, sf_dir), ["0_Mean", "0_Max", "0_Min", "0_Variance"])
    return G.build_gallery(rows, dataset="embeddings").withColumn("ord", F.col("ord") * 8 + F.col("channel_id"))


@query(
    "gallery_filter",
    f"WITH {_CH} SELECT vec_id || '__ch' || c AS entry_id, CAST(c AS INT) AS channel_id, CAST(label AS VARCHAR) AS label, round(list_avg(v), 6) AS mean FROM ch WHERE c IN (1, 3) AND label = 2 AND vec_id <> 5",
)
def gallery_filter(spark, sf_dir):
    out = G.filter_gallery(channel_gallery(spark, sf_dir), task_type="classification", label="2", channel_ids=[1, 3], exclude_sample_id="5", has_view="statistic_view")
    return out.select("entry_id", "channel_id", "label", F.round(F.element_at("statistic_view", F.lit("0_Mean")), 6).alias("mean"))


@query(
    "gallery_vectors",
    f"WITH {_CH} SELECT vec_id || '__ch' || c AS entry_id, [round(list_max(v), 6), round(list_avg(v), 6), round(list_min(v), 6), round(list_var_pop(v), 6)] AS vector FROM ch",
)
def gallery_vectors(spark, sf_dir):
    rows, _ = G.gallery_vectors(channel_gallery(spark, sf_dir))
    return rows.select("entry_id", F.transform("vector", lambda x: rounded(x)).alias("vector"))


@query(
    "gallery_summary",
    f"""WITH {_CH} SELECT 'total' AS kind, 'entries' AS key, count(*) AS n FROM ch UNION ALL SELECT 'total', 'samples', count(DISTINCT vec_id) FROM ch
UNION ALL SELECT 'total', 'channels', count(DISTINCT c) FROM ch UNION ALL SELECT 'view', 'statistic_view', count(*) FROM ch
UNION ALL SELECT 'view', 'ts_view', 0 UNION ALL SELECT 'view', 'summary_view', 0 UNION ALL SELECT 'task_type', 'classification', count(*) FROM ch
UNION ALL SELECT 'channel', CAST(c AS VARCHAR), count(*) FROM ch GROUP BY c""",
)
def gallery_summary(spark, sf_dir):
    return G.summarize(channel_gallery(spark, sf_dir))


@query("group_by_channel", f"WITH {_CH} SELECT CAST(c AS INT) AS channel_id, list(vec_id || '__ch' || c ORDER BY vec_id) AS entry_ids FROM ch GROUP BY c")
def group_by_channel(spark, sf_dir):
    return G.group_entries(channel_gallery(spark, sf_dir), "channel_id")


_Z = f"""{_CH}, z AS (SELECT vec_id, label, c, list_transform(v, lambda x: (x - list_avg(v)) / CASE WHEN list_var_pop(v) <= 1e-12 THEN 1.0 ELSE sqrt(list_var_pop(v)) END) AS v FROM ch),
cen AS (SELECT c, label, list(m ORDER BY i) AS m FROM (SELECT c, label, i, avg(x) AS m FROM (SELECT c, label, unnest(generate_series(1, 8)) AS i, unnest(v) AS x FROM z) GROUP BY c, label, i) GROUP BY c, label),
wi AS (SELECT c, avg(d) AS w FROM (SELECT z.c, z.label, avg(list_distance(z.v, cen.m)) AS d FROM z JOIN cen ON z.c = cen.c AND z.label = cen.label GROUP BY z.c, z.label) GROUP BY c),
be AS (SELECT a.c, avg(list_distance(a.m, b.m)) AS b FROM cen a JOIN cen b ON a.c = b.c AND a.label < b.label GROUP BY a.c),
sb AS (SELECT wi.c, w, b, b / (w + 1e-8) AS score_b FROM wi JOIN be ON wi.c = be.c)"""
_NN = """, nn AS (SELECT a.c, a.vec_id, a.label, b.label AS found, row_number() OVER (PARTITION BY a.c, a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS k FROM z a JOIN z b ON a.c = b.c AND a.vec_id <> b.vec_id),
sc AS (SELECT c, avg(CASE WHEN label = found THEN 1.0 ELSE 0.0 END) AS score_c FROM nn WHERE k = 1 GROUP BY c)"""
ALL_PROBES = SelectorConfig(top_k=3, nn_eval=0)


@query("class_centroids", f"WITH {_Z} SELECT CAST(c AS INT) AS channel_id, label, list_transform(m, lambda x: round(x, 6)) AS centroid FROM cen")
def class_centroids(spark, sf_dir):
    out = S.class_centroids(S.prepare_channels(channels(spark, sf_dir), ALL_PROBES))
    return out.select("channel_id", "label", F.transform("centroid", lambda x: rounded(x)).alias("centroid"))


@query("prototype_margin", f"WITH {_Z} SELECT CAST(c AS INT) AS channel_id, round(w, 6) AS within, round(b, 6) AS between, round(score_b, 6) AS score_b FROM sb")
def prototype_margin(spark, sf_dir):
    return _round(S.prototype_margin(S.prepare_channels(channels(spark, sf_dir), ALL_PROBES)).withColumnRenamed("channel_id", "channel")).withColumnRenamed("channel", "channel_id")


@query("onenn_loo_accuracy", f"WITH {_Z}{_NN} SELECT CAST(c AS INT) AS channel_id, round(score_c, 6) AS score_c FROM sc")
def onenn_loo_accuracy(spark, sf_dir):
    out = S.one_nn_accuracy(S.prepare_channels(channels(spark, sf_dir), ALL_PROBES), ALL_PROBES)
    return out.select("channel_id", F.round("score_c", 6).alias("score_c"))


@query(
    "channel_fusion_rank",
    f"""WITH {_Z}{_NN}, f AS (SELECT sb.c, 0.5 * (score_b - avg(score_b) OVER ()) / stddev_samp(score_b) OVER () + 0.5 * (score_c - avg(score_c) OVER ()) / stddev_samp(score_c) OVER () AS fused FROM sb JOIN sc ON sb.c = sc.c)
SELECT CAST(c AS INT) AS channel_id, round(fused, 6) AS fused, row_number() OVER (ORDER BY round(fused, 9) DESC, c) AS rank, row_number() OVER (ORDER BY round(fused, 9) DESC, c) <= 3 AS selected FROM f""",
)
def channel_fusion_rank(spark, sf_dir):
    out = S.select_channels(channels(spark, sf_dir), ALL_PROBES)
    return out.select("channel_id", F.round("fused", 6).alias("fused"), F.col("rank").cast("long").alias("rank"), "selected")


def _fmt(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DECIMAL(38, 3)) AS VARCHAR), '0+$', ''), '\\.$', '')"


@query(
    "format_series",
    f"""WITH {_U} SELECT user_id AS sample_id, 'Channel 0: [' || array_to_string(list_transform(list_slice(v, 1, 12), lambda x: {_fmt('x')}), ', ') || ']' || CASE WHEN len(v) > 12 THEN ' ... (total_length=' || len(v) || ')' ELSE '' END AS text FROM u""",
)
def format_series(spark, sf_dir):
    return user_series(spark, sf_dir).select("sample_id", X.format_channel("channel_id", "values", max_items=12).alias("text"))


@query(
    "format_retrieved",
    knn_sql("cosine", "none")
    + f""" SELECT query_id, string_agg('Example ' || rank || ':' || chr(10) || 'Sample: ' || sample_id || ' | Label: ' || label || ' | Score: ' || {_fmt('round(d, 6)')}, chr(10) || chr(10) ORDER BY rank) AS text FROM near GROUP BY query_id""",
)
def format_retrieved(spark, sf_dir):
    q, g = halves(spark, sf_dir)
    near = R.knn(q, g, RetrieverConfig("cosine", "none", 5)).withColumn("distance", F.round("distance", 6))
    shown = near.select(F.col("query_id").cast("long").alias("query_id"), "rank", X.format_example("sample_id", label="label", score="distance").alias("t"))
    return shown.groupBy("query_id").agg(X.format_set(F.col("t"), F.col("rank")).alias("text"))


# --- sources -------------------------------------------------------------------------------------------------

_SPLIT = """e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) AS r,
  count(*) OVER () AS n, dense_rank() OVER (ORDER BY label) AS up, dense_rank() OVER (ORDER BY label DESC) AS down FROM embeddings),
f AS (SELECT *, least(greatest(1, CAST(floor(n * 0.5) AS BIGINT)), n - 1) AS cut FROM e),
s AS (SELECT *, CASE WHEN r <= cut THEN 'train' ELSE 'test' END AS split, CASE WHEN r <= cut THEN r - 1 ELSE r - cut - 1 END AS sample_index FROM f)"""


@query("source_ucr", f"WITH {_SPLIT} SELECT 'X' AS dataset, split, split || '_' || sample_index AS sample_id, sample_index, CAST(0 AS INT) AS channel_id, v AS values, CAST(up - 1 AS VARCHAR) AS label FROM s")
def source_ucr(spark, sf_dir):
    """Univariate files written from the embeddings, and loaded with labels mapped."""
    folder = shared_folder(spark, "ucr")
    rows = W.prefix_split(vectors(spark, sf_dir), 0.5, order="ord")
    writers.write_ucr(rows.select("split", F.col("ord").alias("sample_index"), "label", F.col("vector").alias("values")), "X", folder)
    data = load_ucr(spark, "X", folder)
    return data.series.select(F.lit(data.name).alias("dataset"), "split", "sample_id", "sample_index", "channel_id", "values", "label")


@query(
    "source_uea",
    f"""WITH {_SPLIT} SELECT split, split || '_' || sample_index AS sample_id, sample_index, CAST(c AS INT) AS channel_id, list_slice(v, 8 * c + 1, 8 * c + 8) AS values, CAST(down - 1 AS VARCHAR) AS label
FROM (SELECT *, unnest(generate_series(0, 7)) AS c FROM s)""",
)
def source_uea(spark, sf_dir):
    """Multivariate files with declared classes, from eight pieces of each embedding."""
    folder = shared_folder(spark, "uea")
    rows = W.prefix_split(vectors(spark, sf_dir), 0.5, order="ord")
    pieces = F.array(*[F.slice("vector", 8 * c + 1, 8) for c in range(8)])
    samples = rows.select("split", F.col("ord").alias("sample_index"), pieces.alias("channels"), F.concat(F.lit("c"), "label").alias("label"))
    classes = [f"c{r.label}" for r in _table(spark, sf_dir, "embeddings").select("label").distinct().orderBy(F.desc("label")).collect()]
    writers.write_uea(samples, "X", folder, dimensions=8, class_values=classes)
    return load_uea(spark, "X", folder).series.select("split", "sample_id", "sample_index", "channel_id", "values", "label")


_FILES = """u AS (SELECT event_type, list(CAST(coalesce(value, 0) AS DOUBLE) ORDER BY ts, event_id) AS v, list(CAST(user_id AS DOUBLE) ORDER BY ts, event_id) AS w,
  list(CASE WHEN coalesce(value, 0) > 50 THEN 1 ELSE 0 END ORDER BY ts, event_id) AS y FROM events GROUP BY event_type),
o AS (SELECT *, row_number() OVER (ORDER BY event_type) AS r, count(*) OVER () AS n FROM u),
s AS (SELECT *, CASE WHEN r <= least(greatest(1, CAST(floor(n * 0.5) AS BIGINT)), n - 1) THEN 'train' ELSE 'test' END AS split FROM o)"""
_BOTH = "CAST(c AS INT) AS channel_id, CASE WHEN c = 0 THEN v ELSE w END AS values"


def _sensor_files(spark: SparkSession, sf_dir: str) -> str:
    """A file of points for each type of event: two channels, and values over 50 as anomalies."""
    e = _table(spark, sf_dir, "events")
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    points = e.select("event_type", F.col("ts").alias("datetime"), "event_id", value.alias("value"), F.col("user_id").cast("double").alias("user"), (value > 50).cast("int").alias("anomaly"))
    return writers.write_sensors(points, shared_folder(spark, "sensors"), key="event_type", order=["datetime", "event_id"])


@query(
    "source_sensor_sequence",
    f"""WITH {_FILES} SELECT split, row_number() OVER (PARTITION BY split, c ORDER BY r) - 1 AS sample_index, {_BOTH}, CASE WHEN list_sum(y) / len(y) >= 0.4 THEN '1' ELSE '0' END AS label
FROM (SELECT *, unnest([0, 1]) AS c FROM s)""",
)
def source_sensor_sequence(spark, sf_dir):
    data = load_skab_sequences(spark, _sensor_files(spark, sf_dir), rule="ratio", threshold=0.4, drop_columns=("event_id",))
    return data.series.select("split", "sample_index", "channel_id", "values", "label")


@query(
    "source_sensor_window",
    f"""WITH {_FILES}, p AS (SELECT split, r, v, w, y, unnest(generate_series(0, len(y) - 60, 10)) AS b FROM s WHERE len(y) >= 60),
x AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY r, b) - 1 AS sample_index, list_slice(v, b + 1, b + 60) AS v, list_slice(w, b + 1, b + 60) AS w, list_slice(y, b + 1, b + 60) AS y FROM p)
SELECT split, sample_index, {_BOTH}, CASE WHEN list_sum(y) / 60.0 >= 0.5 THEN '1' ELSE '0' END AS label FROM (SELECT *, unnest([0, 1]) AS c FROM x)""",
)
def source_sensor_window(spark, sf_dir):
    data = load_skab_windows(spark, _sensor_files(spark, sf_dir), rule="ratio", threshold=0.5, drop_columns=("event_id",))
    return data.series.select("split", "sample_index", "channel_id", "values", "label")


@query(
    "window_points",
    """WITH u AS (SELECT event_type, list(CAST(coalesce(value, 0) AS DOUBLE) ORDER BY ts, event_id) AS v, list(CASE WHEN coalesce(value, 0) > 50 THEN 1 ELSE 0 END ORDER BY ts, event_id) AS y FROM events GROUP BY event_type),
p AS (SELECT event_type, v, y, unnest(generate_series(0, len(v) - 60, 10)) AS b FROM u WHERE len(v) >= 60)
SELECT event_type, CAST(b AS BIGINT) AS start, CAST(b + 60 AS BIGINT) AS "end", list_slice(v, b + 1, b + 60) AS values, CASE WHEN list_sum(list_slice(y, b + 1, b + 60)) / 60.0 >= 0.4 THEN 1 ELSE 0 END AS label FROM p""",
)
def window_points(spark, sf_dir):
    """Windows of a table of points, in the order of time by type of event, labelled from their points."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    points = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id", value.alias("values"), (value > 50).cast("int").alias("y"))
    placed = with_positions(points, ["ts", "event_id"], by=["event_type"], name="t")
    wins = W.point_windows(placed, size=60, stride=10, values=["values", "y"], by=["event_type"])
    return wins.select("event_type", "start", "end", "values", L.point_label("y", "ratio", 0.4).alias("label"))


@query("welch_points", feature_sql.WELCH_POINTS)
def welch_points(spark, sf_dir):
    """The density of the events' values, each type as one series in the order of time."""
    points = _table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    out = welch_density(with_positions(points, ["ts", "event_id"], by=["event_type"], name="t"), by=["event_type"], size=64)
    return out.select("event_type", "k", F.round("frequency", 6).alias("frequency"), F.round("power", 6).alias("power"))


@query(
    "positions_by_text",
    "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS position FROM orders",
)
def positions_by_text(spark, sf_dir):
    """Places in a global order by text and number."""
    return with_positions(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"])


# --- kept memories -------------------------------------------------------------------------------------------

_VECTORS = SQL["gallery_vectors"]


@query("gallery_kept_parquet", _VECTORS)
def gallery_kept_parquet(spark, sf_dir):
    """A gallery written as Parquet and read again."""
    path = f"{shared_folder(spark, 'gallery')}/entries.parquet"
    G.save_gallery(channel_gallery(spark, sf_dir), path)
    rows, _ = G.gallery_vectors(G.load_gallery(spark, path))
    return rows.select("entry_id", F.transform("vector", lambda x: rounded(x)).alias("vector"))


@query("gallery_kept_json", _VECTORS)
def gallery_kept_json(spark, sf_dir):
    """A gallery written as lines of JSON and read again."""
    path = f"{shared_folder(spark, 'gallery')}/entries.json"
    G.save_gallery_json(channel_gallery(spark, sf_dir), path)
    rows, _ = G.gallery_vectors(G.load_gallery_json(spark, path))
    return rows.select("entry_id", F.transform("vector", lambda x: rounded(x)).alias("vector"))


@query("index_kept", f"WITH {_CH} SELECT vec_id || '__ch' || c AS entry_id, CAST(vec_id AS VARCHAR) AS sample_id, CAST(label AS VARCHAR) AS label, CAST(c AS INT) AS channel_id, [round(list_max(v), 6), round(list_avg(v), 6), round(list_min(v), 6), round(list_var_pop(v), 6)] AS vector FROM ch")
def index_kept(spark, sf_dir):
    """The vectors of a gallery written as an index and read again."""
    path = f"{shared_folder(spark, 'index')}/index"
    G.save_index(channel_gallery(spark, sf_dir), path)
    rows, _ = G.load_index(spark, path)
    return rows.select("entry_id", "sample_id", "label", "channel_id", F.transform("vector", lambda x: rounded(x)).alias("vector"))
