"""Loaders on small files."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.labels import first_seen_label_map, numeric_label_map, point_label, remap_labels
from chronoloom.functions.text import path_of_sample_id, sample_id_of_path
from chronoloom.operators.series import cap_per_split, collate, describe_modes, feature_columns_of, pick_channel, point_windows, prefix_split, sliding_windows, windows_1d
from chronoloom.sources import files
from chronoloom.sources.ordered import ordered_lines
from chronoloom.sources.registry import get_loader, list_loaders, load_prediction, register_loader
from chronoloom.sources.skab import load_skab_sequences, load_skab_windows, scan_sequences
from chronoloom.sources.ucr import list_ucr, load_ucr
from chronoloom.sources.uea import list_uea, load_uea, parse_header
from chronoloom.sources.writers import write_ucr, write_uea


def ucr(root, train, test, name="ToyDS"):
    (root / name).mkdir(parents=True, exist_ok=True)
    (root / name / f"{name}_TRAIN").write_text("\n".join(train) + "\n")
    (root / name / f"{name}_TEST").write_text("\n".join(test) + "\n")


def test_ucr(spark, tmp_path):
    ucr(tmp_path, ["1.0,0.1,0.2", "2.0,0.3,0.4"], ["2.0,0.5,0.6"])
    assert list_ucr(tmp_path) == ["ToyDS"] and list_ucr(tmp_path / "none") == []
    data = load_ucr(spark, "ToyDS", tmp_path, remap_labels_=False)
    rows = data.split("train").orderBy("sample_index").collect()
    assert [(r.sample_id, list(r["values"]), float(r.label)) for r in rows] == [("train_0", [0.1, 0.2], 1.0), ("train_1", [0.3, 0.4], 2.0)]
    assert [float(r.label) for r in data.split("test").collect()] == [2.0]
    with pytest.raises(FileNotFoundError):
        load_ucr(spark, "Other", tmp_path)


def test_ucr_cap_before_remap(spark, tmp_path):
    ucr(tmp_path, ["1,1,2,3", "2,1,2,3", "7,1,2,3"], ["2,1,2,3", "3,1,2,3", "9,1,2,3"])
    data = load_ucr(spark, "ToyDS", tmp_path, max_samples_per_split=2)
    assert sorted((r.label, r.class_id) for r in data.label_map.collect()) == [(1.0, 0), (2.0, 1), (3.0, 2)]
    assert data.split("train").count() == 2 and data.split("test").count() == 2


HEADER = ["@problemName ToyUEA", "@timeStamps false", "@missing false", "@univariate false", "@dimensions 2", "@equalLength true", "@seriesLength 3", "@classLabel true dog cat"]


def uea(root, train, test, header=HEADER, test_header=None):
    d = root / "Toy"
    d.mkdir(parents=True, exist_ok=True)
    for split, rows, head in (("TRAIN", train, header), ("TEST", test, test_header or header)):
        (d / f"Toy_{split}.ts").write_text("\n".join(["# a comment", *head, "@data", *rows]) + "\n")


def test_uea(spark, tmp_path):
    uea(tmp_path, ["1,2,3:4,5,6:cat", "1,1,1:2,2,2:dog"], ["3,3,3:1,1,1:cat"])
    assert list_uea(tmp_path) == ["Toy"]
    data = load_uea(spark, "Toy", tmp_path)
    assert {r.label: r.class_id for r in data.label_map.collect()} == {"dog": 0, "cat": 1}
    rows = data.split("train").orderBy("sample_index", "channel_id").collect()
    assert [(r.sample_id, r.channel_id, list(r["values"]), r.label) for r in rows] == [
        ("train_0", 0, [1, 2, 3], "1"), ("train_0", 1, [4, 5, 6], "1"), ("train_1", 0, [1, 1, 1], "0"), ("train_1", 1, [2, 2, 2], "0"),
    ]


def test_uea_numeric_labels(spark, tmp_path):
    uea(tmp_path, ["1,2,3:4,5,6:20", "1,1,1:2,2,2:10"], ["3,3,3:1,1,1:20"], [*HEADER[:-1], "@classLabel true 10 20"])
    data = load_uea(spark, "Toy", tmp_path)
    assert {r.label: r.class_id for r in data.label_map.collect()} == {10.0: 0, 20.0: 1}


GOOD = "1,2,3:4,5,6:dog"


@pytest.mark.parametrize(
    ("train", "header", "test", "test_header", "message"),
    [
        ([GOOD], HEADER, ["1,2,3:4,5,6:bird"], None, "Observed labels not"),
        ([GOOD], [h for h in HEADER if "dimensions" not in h], [GOOD], None, "Missing required header fields"),
        ([GOOD], [*HEADER[:-1], "@classLabel true"], [GOOD], None, "requires explicit class values"),
        (["1,2,a:4,5,6:dog"], HEADER, [GOOD], None, "non-numeric"),
        (["1,2,nan:4,5,6:dog"], HEADER, [GOOD], None, "NaN/Inf"),
        (["1,2,inf:4,5,6:dog"], HEADER, [GOOD], None, "NaN/Inf"),
        ([GOOD], [h.replace("Length 3", "Length 2") for h in HEADER], [GOOD], None, "seriesLength mismatch"),
        ([GOOD], HEADER, ["1,2,3:4,5,6:7,8,9:dog"], [h.replace("dimensions 2", "dimensions 3") for h in HEADER], "shape mismatch"),
        ([GOOD], HEADER, [GOOD], [h.replace("cat", "bird") for h in HEADER], "class label declaration mismatch"),
        (["1,2,3:dog"], HEADER, [GOOD], None, "dimension mismatch"),
        (["1,2,3:4,5:dog"], HEADER, [GOOD], None, "unequal channel lengths"),
        (["1,2,3: :dog"], HEADER, [GOOD], None, "empty channel"),
        ([GOOD], [h.replace("equalLength true", "equalLength false") for h in HEADER], [GOOD], None, "Variable-length"),
    ],
)
def test_uea_rejects(spark, tmp_path, train, header, test, test_header, message):
    uea(tmp_path, train, test, header, test_header)
    with pytest.raises(Exception, match=message):
        load_uea(spark, "Toy", tmp_path).series.collect()


def test_header_without_data():
    with pytest.raises(ValueError, match="@data"):
        parse_header("\n".join(HEADER))


SENSORS = ["Accelerometer1RMS", "Current", "Volume Flow RateRMS"]


def skab(path, anomalies, time_col="datetime"):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [";".join([time_col, *SENSORS, "anomaly", "changepoint"])]
    lines += [";".join([str(i) if time_col != "datetime" else f"2020-01-01 00:00:0{i}", *(str(float(j + i)) for j in (1, 2, 3)), str(a), "0"]) for i, a in enumerate(anomalies)]
    path.write_text("\n".join(lines) + "\n")


def test_skab_sequences(spark, tmp_path):
    skab(tmp_path / "a.csv", [0, 1, 0])
    skab(tmp_path / "b.csv", [0, 0, 0])
    seq = scan_sequences(spark, tmp_path).orderBy("seq_index").collect()
    assert [r.sample_id for r in seq] == ["a", "b"] and seq[0].feature_columns == SENSORS
    assert seq[0].channels[1] == [2.0, 3.0, 4.0] and seq[0].point_labels == [0, 1, 0]
    data = load_skab_sequences(spark, tmp_path)
    assert [r.label for r in data.split("train").where("channel_id = 0").collect()] == ["1"]
    assert [r.label for r in data.split("test").where("channel_id = 0").collect()] == ["0"]


def test_skab_windows(spark, tmp_path):
    skab(tmp_path / "a.csv", [0, 1, 0, 0])
    skab(tmp_path / "b.csv", [0, 0, 0, 0])
    data = load_skab_windows(spark, tmp_path, window_size=2, stride=1)
    by = {s: [r.label for r in data.split(s).where("channel_id = 0").orderBy("sample_index").collect()] for s in ("train", "test")}
    assert by == {"train": ["1", "1", "0"], "test": ["0", "0", "0"]}
    assert data.split("train").where("channel_id = 0").orderBy("sample_index").first().sample_id == "a__w0_2"


def test_skab_folders(spark, tmp_path):
    for p in ("anomaly-free/anomaly-free", "valve1/1", "valve1/2", "valve2/1", "other/1", "root"):
        skab(tmp_path / f"{p}.csv", [0, 1], time_col="Time[s]" if p == "other/1" else "datetime")
    rows = scan_sequences(spark, tmp_path).orderBy("seq_index").collect()
    assert [r.sample_id for r in rows] == ["anomaly-free__anomaly-free", "other__1", "root", "valve1__1", "valve1__2", "valve2__1"]
    assert rows[1].feature_columns[0] == "Time[s]"
    assert scan_sequences(spark, tmp_path, subdirs=["valve1", "valve2"]).count() == 3
    assert scan_sequences(spark, tmp_path, subdirs=["valve1", "valve2"], max_files=1).count() == 1
    one = load_skab_sequences(spark, tmp_path, subdirs=["anomaly-free"]).series
    assert {r.split for r in one.collect()} == {"train", "test"}
    with pytest.raises(FileNotFoundError):
        scan_sequences(spark, tmp_path, subdirs=["none"])
    skab(tmp_path / "bad" / "x.csv", [])
    with pytest.raises(Exception, match="no rows"):
        scan_sequences(spark, tmp_path / "bad").collect()
    with pytest.raises(Exception, match="no column"):
        scan_sequences(spark, tmp_path, label_col="nothing").collect()


def test_registry(spark):
    assert list_loaders() == ["skab_sequence", "skab_window", "ucr2015", "uea"]
    assert get_loader(" UCR2015 ") is load_ucr
    with pytest.raises(KeyError):
        get_loader("none")
    with pytest.raises(ValueError):
        register_loader(" ", load_ucr)
    with pytest.raises(NotImplementedError):
        load_prediction()


def test_splits_and_labels(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    for n, ratio, cut in ((7, 0.5, 3), (7, 0.01, 1), (7, 0.99, 6), (2, 0.9, 1)):
        out = prefix_split(rows.where(F.col("k") < n), ratio, order="k")
        assert sorted(r.k for r in out.where("split = 'train'").collect()) == list(range(cut))
    assert prefix_split(rows.where("k = 0"), 0.5, order="k").count() == 2
    assert prefix_split(rows.where("k < 0"), 0.5, order="k").count() == 0
    with pytest.raises(ValueError):
        prefix_split(rows, 1.0, order="k")
    a, b = (spark.createDataFrame([(x,) for x in xs], "label double") for xs in ([5.0, 9.0, 5.0], [9.0, 11.0]))
    assert {r.label: r.class_id for r in numeric_label_map(a, b).collect()} == {5.0: 0, 9.0: 1, 11.0: 2}
    with pytest.raises(Exception, match="unknown label"):
        remap_labels(b, numeric_label_map(a), numeric=True).collect()
    seen = spark.createDataFrame([(0, "x"), (1, "a"), (2, "x")], "i int, label string")
    assert {r.label: r.class_id for r in first_seen_label_map(seen, order=["i"]).collect()} == {"x": 0, "a": 1}


def test_ranged_positions(spark, monkeypatch):
    from chronoloom.operators import series

    monkeypatch.setattr(series, "RANK_IN_ONE", 40)
    rows = spark.range(0, 500).selectExpr("(id * 7919) % 500 as k").repartition(4)
    out = prefix_split(rows, 0.3, order="k")
    assert sorted(r.k for r in out.where("split = 'train'").collect()) == list(range(150))


def test_positions_of_any_order(spark):
    import random

    from chronoloom.operators.positions import with_positions

    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "x", "b", None, "é"]), rng.choice("pq"), i) for i in range(900)] + [("x", "p", 7)] * 3
    table = spark.createDataFrame(rows, "k string, g string, i long").repartition(5)
    got = with_positions(table, ["k"], partitions=9).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    keys = [r.k for r in sorted(got, key=lambda r: r.position)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or "")) and sorted(map(str, ((r.k, r.g, r.i) for r in got))) == sorted(map(str, rows))
    for r in (by := with_positions(table, ["i", "k"], by=["g"], partitions=4).collect()):
        assert 0 <= r.position < len(rows)
    for g in "pq":
        mine = sorted((r for r in by if r.g == g), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine))) and [r.i for r in mine] == sorted(r.i for r in mine)
    plan = with_positions(table, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "HashAggregate(keys=[__range" in plan[plan.index("SinglePartition") :]  # ranges, not rows
    assert with_positions(table.limit(0), ["k"]).count() == 0


def test_string_orders_beyond_one_task(spark, monkeypatch):
    from chronoloom.operators import series

    monkeypatch.setattr(series, "RANK_IN_ONE", 40)
    rows = spark.range(0, 300).selectExpr("lpad(cast((id * 7919) % 300 as string), 3, '0') as k").repartition(4)
    out = prefix_split(rows, 0.5, order="k")
    assert sorted(int(r.k) for r in out.where("split = 'train'").collect()) == list(range(150))


def test_point_windows(spark, monkeypatch):
    from chronoloom.operators import series

    rows = [(s, t, float(t * 3 % 7), t % 5) for s, n in (("a", 47), ("b", 3), ("c", 20)) for t in range(n)]
    points = spark.createDataFrame(rows, "s string, t long, v double, y int").repartition(3)
    for chunk, size, stride in ((8, 5, 2), (4, 9, 3), (1, 4, 1), (65_536, 4, 4), (6, 4, 10)):
        monkeypatch.setattr(series, "CHUNK", chunk)
        got = {(r.s, r.start): (r.end, list(r.v), list(r.y)) for r in point_windows(points, size=size, stride=stride, values=["v", "y"], by=["s"]).collect()}
        want = {}
        for s, n in (("a", 47), ("b", 3), ("c", 20)):
            for at in range(0, n - size + 1, stride):
                want[s, at] = (at + size, [float(t * 3 % 7) for t in range(at, at + size)], [t % 5 for t in range(at, at + size)])
        assert got == want


def test_rows_of_long_series_stay_small(spark):
    """A window is cut from a copy of its chunk, which must not grow with the series."""
    from chronoloom.operators.series import _chunks

    points = spark.range(0, 30_000).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    held, length = _chunks(points, size=60, stride=10, values=["v"], by=["s"], at="t")
    assert held.selectExpr("max(size(__points))").first()[0] <= length - 10 + 60 < 600
    assert point_windows(points, size=60, stride=10, values=["v"], by=["s"]).count() == 2995


def test_files_are_read_by_many_tasks(spark, tmp_path):
    """A UCR, a .ts and a sensor file of several blocks each, in the order of their lines."""
    lines = [f"{i % 3},{i}.0,{i}.5" for i in range(4000)]
    ucr(tmp_path, lines, lines[:5])
    uea(tmp_path, [f"{i},1,2:3,4,5:{'cat' if i % 2 else 'dog'}" for i in range(3000)], [GOOD])
    skab(tmp_path / "s" / "one.csv", [i % 2 for i in range(3000)])
    skab(tmp_path / "s" / "two words+é.csv", [0] * 70)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = ordered_lines(spark, str(tmp_path / "ToyDS" / "ToyDS_TRAIN"))
        assert spark.read.text(str(tmp_path / "ToyDS" / "ToyDS_TRAIN")).rdd.getNumPartitions() > 3
        assert [r.line for r in rows.orderBy("line_no").collect()] == lines
        assert [r.line_no for r in rows.orderBy("line_no").collect()] == list(range(4000))
        got = load_ucr(spark, "ToyDS", tmp_path).split("train").orderBy("sample_index").collect()
        assert [r["values"][0] for r in got] == [float(i) for i in range(4000)] and got[3999].sample_id == "train_3999"
        got = load_uea(spark, "Toy", tmp_path, remap_labels_=False).split("train").where("channel_id = 0").orderBy("sample_index").collect()
        assert [r["values"][0] for r in got] == [float(i) for i in range(3000)]
        seq = scan_sequences(spark, tmp_path / "s").orderBy("seq_index").collect()
        assert [r.sample_id for r in seq] == ["one", "two words+é"] and seq[0].channels[0] == [float(1 + i) for i in range(3000)]
        wins = load_skab_windows(spark, tmp_path / "s", window_size=60, stride=10).split("train").where("channel_id = 2").orderBy("sample_index").collect()
        assert [r.sample_index for r in wins] == list(range(295)) and wins[200]["values"] == [float(3 + i) for i in range(2000, 2060)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_splits_in_parts(spark, tmp_path):
    """A split may be a folder of parts, written by many tasks."""
    rows = [("train" if i < 50 else "test", i, str(i % 3), [float(i), 1.0]) for i in range(70)]
    series = spark.createDataFrame(rows, "split string, sample_index long, label string, values array<double>").repartition(4)
    for one in (False, True):
        root = f"file://{tmp_path}/{one}"
        write_ucr(series, "X", root, one_file=one)
        got = load_ucr(spark, "X", root, remap_labels_=False).series.orderBy("split", "sample_index").collect()
        assert [r["values"][0] for r in got] == [*map(float, range(50, 70)), *map(float, range(50))]
        samples = series.select("split", "sample_index", F.array("values", "values").alias("channels"), F.concat(F.lit("c"), "label").alias("label"))
        write_uea(samples, "Y", root, dimensions=2, class_values=["c2", "c0", "c1"], one_file=one)
        got = load_uea(spark, "Y", root).split("test").where("channel_id = 1").orderBy("sample_index").collect()
        assert [r["values"][0] for r in got] == [*map(float, range(50, 70))] and list_uea(root) == ["Y"] and list_ucr(root) == ["X"]


def test_store(spark, tmp_path):
    from chronoloom.sources.store import Store

    at = Store(spark, f"file://{tmp_path}") / "a" / "b.json"
    assert not at.exists() and (Store(spark, tmp_path) / "none").names(True) == []
    at.write_json({"x": [1, "é"]})
    at.write_json({"x": [2, "é"]})
    assert at.read_json() == {"x": [2, "é"]} and list(Store(spark, tmp_path).walk()) == ["a/b.json"]
    assert (Store(spark, tmp_path) / "a").names(False) == ["b.json"] and Store(spark, tmp_path).names(True) == ["a"]
    at.delete()
    assert not at.exists()


def test_point_labels(spark):
    row = spark.createDataFrame([([0, 1, 0, 2],), ([0, 0],), ([1, 1],)], "y array<int>")
    got = row.select(point_label("y").alias("a"), point_label("y", "all").alias("b"), point_label("y", "ratio", 0.5).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (0, 0, 0), (1, 1, 1)]
    with pytest.raises(ValueError):
        point_label("y", "most")


def test_windows(spark):
    rows = spark.createDataFrame([("s", [[1.0, 2.0, 3.0]], [0, 1, 0]), ("t", [[1.0]], [0])], "sample_id string, channels array<array<double>>, point_labels array<int>")
    got = sliding_windows(rows, size=2, stride=1).orderBy("start").collect()
    assert [(r.sample_id, r.channels, r.label) for r in got] == [("s__w0_2", [[1.0, 2.0]], 1), ("s__w1_3", [[2.0, 3.0]], 1)]
    for size, stride in ((0, 1), (2, 0)):
        with pytest.raises(ValueError):
            sliding_windows(rows, size=size, stride=stride)
    with pytest.raises(Exception, match="no point labels"):
        sliding_windows(rows.withColumn("point_labels", F.lit(None).cast("array<int>")), size=2, stride=1).collect()
    series = spark.createDataFrame([("s", [1.0, 2.0, 3.0, 4.0])], "sample_id string, values array<double>")
    assert [list(r["values"]) for r in windows_1d(series, size=2, stride=2).orderBy("start").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(Exception, match="shorter"):
        windows_1d(series, size=5, stride=1).collect()


def test_channels(spark):
    rows = [("a", "train", 0, c, [float(c), 1.0], "1") for c in (0, 1)] + [("u", "train", 1, 0, [5.0], "0")]
    series = spark.createDataFrame(rows, "sample_id string, split string, sample_index long, channel_id int, values array<double>, label string")
    assert sorted((r.sample_id, list(r["values"])) for r in pick_channel(series, 1).collect()) == [("a", [1.0, 1.0]), ("u", [5.0])]
    with pytest.raises(Exception, match="no such channel"):
        pick_channel(series, 2).collect()
    modes = {r.sample_id: (r.n_channels, r.length, r.data_mode) for r in describe_modes(series).collect()}
    assert modes == {"a": (2, 2, "multivariate"), "u": (1, 1, "univariate")}
    assert {r.sample_id: r.channels for r in collate(series).collect()}["a"] == [[0.0, 1.0], [1.0, 1.0]]
    assert cap_per_split(series, 1).count() == 2
    with pytest.raises(ValueError):
        cap_per_split(series, 0)
    assert feature_columns_of(["a", "b"], ("a",)) == ["b"]
    with pytest.raises(ValueError):
        feature_columns_of(["a"], ("a",))


def test_files(tmp_path, spark):
    import numpy as np

    files.write_json(tmp_path / "x" / "a.json", {"k": np.array([1, 2]), 3: {"b", "a"}})
    assert files.read_json(tmp_path / "x" / "a.json") == {"k": [1, 2], "3": ["a", "b"]}
    files.write_jsonl(tmp_path / "b.jsonl", [{"a": 1}])
    files.write_jsonl(tmp_path / "b.jsonl", [{"a": 2}], append=True)
    assert files.read_jsonl(tmp_path / "b.jsonl") == [{"a": 1}, {"a": 2}]
    assert files.normalize_name(" My run/1 ") == "My_run1"
    with pytest.raises(ValueError):
        files.normalize_name(" / ")
    row = spark.createDataFrame([("valve1/1.csv",)], "p string").select(sample_id_of_path("p").alias("i")).select("i", path_of_sample_id("i").alias("p")).first()
    assert tuple(row) == ("valve1__1", "valve1/1")
