"""The reference operators on small inputs with known results."""

import math
import os
import zipfile

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowquarry.functions import scalars
from flowquarry.operators import correlation, duplicates, explain, features, iforest, metrics, models, orderstats, profile, sampling, serving
from flowquarry.sources import files, sinks
from flowquarry.streaming import replay

NAN, INF = float("nan"), float("inf")


COLUMNS = ["Destination Port", "Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "Bwd PSH Flags", "Total Fwd Packets"]


def own_rows(seed):
    """Rows of text cells and a label, with every kind of odd cell, repeated rows and one vector under two labels."""
    rng = np.random.default_rng(seed)
    out = []
    for n in range(30):
        k = str(rng.integers(1, 90))
        rate = str(rng.choice(["1.25", "2e3", "NaN", "Infinity", "-Infinity", "oops", "7"]))
        out.append([str(rng.choice([22, 80, 8443])), str(rng.integers(-2, 400)), k, rate, "0", k, str(rng.choice(["BENIGN", "Bot", "Web Attack \u2013 XSS"]))])
        if n % 7 == 3:
            out.append(list(out[-1]))
        if n == 20:
            out.append([*out[-1][:-1], "PortScan"])
    return out


@pytest.fixture(scope="module")
def quirky(spark, tmp_path_factory):
    """A loose UTF-8 file and a cp1252 one in an archive, beside what macOS leaves in archives."""
    folder = tmp_path_factory.mktemp("csv")
    first, second = own_rows(1), own_rows(2)
    second += first[:4]
    text = lambda rows: "\n".join([" , ".join([*COLUMNS, "Label"]), *(",".join(r) for r in rows), ""])
    (folder / "early.csv").write_text(text(first), encoding="utf-8")
    with zipfile.ZipFile(folder / "more.zip", "w") as z:
        z.writestr("deep/late.csv", text(second).encode("cp1252"))
        z.writestr("__MACOSX/deep/._late.csv", b"\0\1\2")
    sources = files.discover(str(folder))
    table, headers = files.read_rows(spark, sources)
    names = [c for c in table.columns if c not in ("source_file", "row_no", "__fields", "Label")]
    return sources, headers, names, files.to_numbers(table, names, ["source_file", "row_no", "Label"]).cache(), {"early.csv": first, "late.csv": second}


def test_discovery_and_scan(quirky, spark, tmp_path):
    sources, headers, names, _, texts = quirky
    assert [s.name for s in sources] == ["early.csv", "late.csv"]
    assert [headers[s.name][0].encoding for s in sources] == ["utf-8", "cp1252"]
    assert {r["name"]: (r["encoding"], r["line_count"]) for r in files.scan_files(spark, sources).collect()} == {"early.csv": ("utf-8", len(texts["early.csv"]) + 1), "late.csv": ("cp1252", len(texts["late.csv"]) + 1)}
    assert names == [*COLUMNS[:5], "Total Fwd Packets.1"]
    assert headers["early.csv"][1].deduplicated == {"Total Fwd Packets.1": "Total Fwd Packets"}
    with pytest.raises(FileNotFoundError):
        files.discover(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.discover(str(tmp_path))
    for d in ("a", "b"):
        os.makedirs(tmp_path / d)
        (tmp_path / d / "x.csv").write_text("Label\nx\n")
    with pytest.raises(ValueError):
        files.discover(str(tmp_path))
    assert files.label_column(["a", "LABEL"]) == "LABEL"
    with pytest.raises(ValueError):
        files.label_column(["a"])
    assert files.normalized_header(["a,b ", "c", "c"]).names == ["a,b", "c", "c.1"]


def test_encodings_and_odd_rows(spark, tmp_path):
    latin = b"Name,Label\n\x81\x96,x\n"  # 0x81 is nothing in cp1252
    (tmp_path / "l.csv").write_bytes(latin)
    (tmp_path / "w.csv").write_bytes(b"Label,Name\nx,a \x96 b\n\ny\nz,1,2,3\n")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.csv", 'Name,Label\n"two\nlines","q, r"\n\nshort\n')
    got, headers = files.read_rows(spark, files.discover(str(tmp_path)))
    assert {n: h[0].encoding for n, h in headers.items()} == {"l.csv": "latin-1", "w.csv": "cp1252", "m.csv": "utf-8"}
    cells = {(r["source_file"], r["Label"]): (r["Name"], r["__fields"]) for r in got.collect()}
    assert cells[("l.csv", "x")] == ("\x81\x96", 2) and cells[("w.csv", "x")] == ("a \u2013 b", 2)
    assert cells[("m.csv", "q, r")] == ("two\nlines", 2) and cells[("m.csv", None)] == ("short", 1)
    assert cells[("w.csv", "y")][0] is None and cells[("w.csv", "z")][1] == 4
    (tmp_path / "other.csv").write_text("Name\nx\n")
    with pytest.raises(ValueError):
        files.read_rows(spark, files.discover(str(tmp_path)))


def number(text):
    try:
        return float(text)
    except ValueError:
        return NAN


def test_profile_of_quirky_files(quirky):
    _, _, names, df, texts = quirky
    got = {r["column_name"]: r for r in profile.column_profile(df, names).collect()}
    for i, n in enumerate(names):
        v = np.array([number(r[i]) for rows_ in texts.values() for r in rows_])
        f = v[np.isfinite(v)]
        assert (got[n]["nan"], got[n]["pos_inf"], got[n]["neg_inf"], got[n]["zeros"], got[n]["negatives"]) == (np.isnan(v).sum(), (v == INF).sum(), (v == -INF).sum(), (f == 0).sum(), (f < 0).sum())
        assert (got[n]["min"], got[n]["max"]) == (f.min(), f.max()) and math.isclose(got[n]["mean"], f.mean(), abs_tol=1e-12) and math.isclose(got[n]["std"], f.std(ddof=1), abs_tol=1e-12)
    assert [c for c, r in got.items() if r["constant"]] == ["Bwd PSH Flags"]
    assert rows(profile.identical_columns(df, names)) == [("Total Fwd Packets", "Total Fwd Packets.1")]
    assert df.agg(F.sum("__unparseable")).first()[0] == sum(r[3] == "oops" for rows_ in texts.values() for r in rows_)


def test_identifier_names():
    kinds = {"Destination Port": "port", "dst_port": "port", "SrcPort": "port", "Flow ID": "flow id", "flowid": "flow id", "Time_Stamp": "timestamp", "Protocol": "protocol", "My Source IP": "ip address", "source_ip": "ip address"}
    assert profile.identifier_columns([*kinds, "Port", "Airport", "resource ip", "Flow  ID", "Protocols", "Timestamp 2", "source  port"]) == kinds


def test_duplicates_and_cleaning(quirky):
    _, _, names, df, texts = quirky
    key = lambda r: (*(x if x == x else None for x in map(number, r[:6])), r[6])
    all_rows = [(f, key(r)) for f, rs in texts.items() for r in rs]
    keys = duplicates.keyed(df, names, F.col("Label"), F.col("source_file"))
    s = duplicates.duplicate_summary(keys).first()
    total, unique, within = len(all_rows), len({k for _, k in all_rows}), len(set(all_rows))
    assert (s["row_count"], s["exact_duplicates"], s["within_files"], s["across_files"]) == (total, total - unique, total - within, within - unique)
    by_vector = {}
    for _, k in all_rows:
        by_vector.setdefault(k[:-1], []).append(k[-1])
    odd = {v: ls for v, ls in by_vector.items() if len(set(ls)) > 1}
    assert len(odd) >= 2 and duplicates.conflicting_rows(keys).count() == sum(len(ls) for ls in odd.values())
    assert sum(r[1] for r in rows(duplicates.conflicting_label_sets(keys))) == len(odd)
    clean = df.withColumn("Label", scalars.canonical_label(F.col("Label")))
    kept = duplicates.keep_first(clean, names, F.col("Label"), [F.col("source_file"), F.col("row_no")])
    assert kept.count() == unique
    rep = {r[0]: tuple(r)[1:] for r in duplicates.removal_report(clean, kept, F.col("Label"), "label").collect()}
    benign = [k for _, k in all_rows if k[-1] == "BENIGN"]
    assert rep["BENIGN"] == (len(benign), len(set(benign)), len(benign) - len(set(benign)))


def test_labels(spark):
    texts = ["  benign ", "BENIGN", "DoS Hulk", "Web Attack � XSS", "web attack–brute  force", "Web Attack \u0096 Sql Injection"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalars.canonical_label(F.col("t"))).collect()]
    assert got == ["BENIGN", "BENIGN", "DoS Hulk", "Web Attack - XSS", "Web Attack - Brute Force", "Web Attack - Sql Injection"]
    for bad in ("Nonsense", None):
        with pytest.raises(Exception, match="unknown label"):
            spark.createDataFrame([(bad,)], "t string").select(scalars.canonical_label(F.col("t"))).collect()


def test_split_and_samples(spark):
    df = spark.range(920).select("id", F.when(F.col("id") < 700, "BENIGN").when(F.col("id") < 900, "DoS Hulk").otherwise("Heartbleed").alias("label"))
    key = sampling.order_key("1", F.col("id"))
    split = sampling.stratified_split(df, F.col("label"), key)
    table = {r["label"]: (r["train"], r["val"], r["test"]) for r in sampling.split_table(split, "label").collect()}
    assert table == {"BENIGN": (490, 105, 105), "DoS Hulk": (140, 30, 30), "Heartbleed": (14, 3, 3)}
    assert rows(split.select("id", "split")) == rows(sampling.stratified_split(df.repartition(7), F.col("label"), key).select("id", "split"))
    assert split.count() == 920
    assert sampling.stratified_sample(df, F.col("label"), 30, key).groupBy("label").count().orderBy("label").collect()[-1]["count"] == 20
    assert sampling.bottom_k(df, 5, key).count() == 5


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(v)) for g, n in (("a", 101), ("b", 50), (None, 7), ("t", 40)) for v in (rng.lognormal(3, 4, n) * rng.choice([-1, 1], n) if g != "t" else [2.0] * 30 + [3.0] * 10)]
    df = spark.createDataFrame([*data, ("a", NAN), ("a", INF), ("z", None), ("b", -INF)], "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in orderstats.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for g in ("a", "b", None, "t"):
        vs = [v for h, v in data if h == g]
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert math.isclose(got[(g, p)], np.quantile(vs, p), rel_tol=1e-12), (g, p)
    assert len(got) == 20
    assert orderstats.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).collect() == []


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.7), (0, 0.3), (1, 0.9), (1, 0.4)], "y int, s double")
    c = metrics.rates(metrics.confusion(df, F.col("y"), scalars.at_least(F.col("s"), 0.5))).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (3, 1, 1, 1)
    r = metrics.ranking_metrics(df, F.col("y"), F.col("s")).first()
    assert math.isclose(r["roc_auc"], 0.875) and math.isclose(r["average_precision"], 5 / 6)
    one = metrics.ranking_metrics(df.where("y = 0"), F.col("y"), F.col("s")).first()
    assert one["roc_auc"] is None and one["average_precision"] is None
    none = spark.createDataFrame([(0, 0.0)] * 95 + [(1, 0.0)] * 5, "y int, s double")
    m = metrics.rates(metrics.confusion(none, F.col("y"), F.col("s") >= 0.5)).first()
    assert (m["accuracy"], m["recall"], m["f1"]) == (0.95, 0, 0)
    assert math.isnan(metrics.rates(metrics.confusion(none.where("y = 1"), F.col("y"), F.col("s") >= 0.5), "nan").first()["fpr"])
    assert metrics.rates(metrics.confusion(none.where("y = 1"), F.col("y"), F.col("s") >= 0.5), "null").first()["fpr"] is None
    t = metrics.threshold_for_fpr(spark.range(1000).select(F.col("id").cast("double").alias("s")), "s", [0.01]).first()
    assert math.isclose(t["threshold"], 989.01)
    d = spark.createDataFrame([(0.5, 0.0), (0.9, 2.0), (0.1, 1.0), (0.1, 0.5), (NAN, NAN), (None, None)], "p double, a double")
    assert [x[0] for x in d.select(metrics.hybrid_decision(F.col("p"), F.col("a"), 1.0)).collect()] == ["known_attack", "known_attack", "anomaly", "benign", "benign", "benign"]
    assert {r["decision"]: r["n"] for r in metrics.decision_counts(d.limit(0).withColumn("x", F.lit("benign")), F.col("x")).collect()} == dict.fromkeys(metrics.DECISIONS, 0)


def test_ranking_with_ties_against_pairs(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 10 - 0.4
    got = metrics.ranking_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)] + [(1, None), (0, NAN)], "y int, s double"), F.col("y"), F.col("s")).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(got["roc_auc"], auc)
    ap = sum((y[s == v].sum()) * y[s >= v].sum() / (s >= v).sum() for v in set(s.tolist())) / y.sum()
    assert math.isclose(got["average_precision"], ap)


def test_preprocessing(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(50):
        d = float(rng.integers(1, 1000))
        data.append((80.0, INF if i == 0 else NAN if i == 1 else d, float(i), d, 0.0, -1.0 if i == 0 else d, d))
    cols = ["Destination Port", "Flow Bytes/s", "Total Fwd Packets", "Flow Duration", "Bwd PSH Flags", "Init_Win_bytes_forward", "Subflow"]
    df = spark.createDataFrame([(*r[:6], r[2]) for r in data], cols)
    p = features.fit_preprocessor(df, cols, scale=False)
    assert p.excluded == ["Destination Port"] and p.constant == ["Bwd PSH Flags"] and p.duplicate_of == {"Subflow": "Total Fwd Packets"}
    out = p.transform(df.select(*reversed(cols), F.lit(1).alias("extra"))).toPandas()
    assert list(out) == ["Flow Bytes/s", "Total Fwd Packets", "Flow Duration", "Init_Win_bytes_forward"]
    v = [r[1] for r in data[2:]]
    assert out["Flow Bytes/s"].iloc[0] == out["Flow Bytes/s"].iloc[1] == np.median(v)
    assert out["Init_Win_bytes_forward"].iloc[0] == -1
    with pytest.raises(features.SchemaError):
        p.transform(df.drop("Flow Duration"))
    z = features.fit_preprocessor(df, cols, scale=True).transform(df).toPandas()
    assert np.allclose(z.std(ddof=0), 1) and np.allclose(z.mean(), 0)


def test_correlations_histograms_boxes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(2 * a + 1), NAN if i < 180 else float(a), "b" if i % 2 else None) for i, a in enumerate(x)], "a double, b double, c double, k string")
    got = {(r["column_a"], r["column_b"]): (r["r"], r["n"]) for r in correlation.correlations(df, ["a", "b", "c"]).collect()}
    assert math.isclose(got[("a", "b")][0], 1) and got[("a", "c")] == (None, 20)
    h = correlation.signed_log_histogram(df, "a", F.col("k")).collect()
    assert sum(r["n"] for r in h) == 200 and max(r["bin"] for r in h) == 39
    b = {r["label"]: r for r in correlation.box_plot(df, "k", "a").collect()}
    assert math.isclose(b["b"]["median"], np.median(x[1::2])) and math.isclose(b[None]["q3"], np.quantile(x[::2], 0.75))


def test_serving(spark):
    bodies = ['{"a": 1, " b ": null}', '{"a": "1", "c": 2, "Label": "x"}', '{"a": true, "b": [1]}', "no json", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [tuple(map(lambda x: list(x) if x is not None else None, r)) for r in df.orderBy("i").select(*serving.checked_features(F.col("body"), ["a", "b"]).values()).collect()]
    assert got[0] == ([], [], [], ["b"])
    assert got[1] == (["c"], ["b"], ["a"], [])
    assert got[2] == ([], [], ["a", "b"], [])
    assert got[3] == got[4] == (None, None, None, None)
    r = spark.range(10).select("id", F.when(F.col("id") % 3 == 0, "benign").otherwise("anomaly").alias("d"), F.concat(F.lit("s"), F.col("id") % 4).alias("src"))
    assert [x["id"] for x in serving.newest_alerts(r, F.col("d"), [F.col("id")], 3).collect()] == [8, 7, 5]
    with pytest.raises(ValueError):
        serving.newest_alerts(r, F.col("d"), [F.col("id")], 0)
    with pytest.raises(ValueError):
        serving.newest_alerts(r, F.col("d"), [F.col("id")], 5, ["benign"])
    assert tuple(serving.store_state(r, F.col("d"), 4).first()) == (4, 6, 4, 6, 0)
    c = {x["source"]: x["n"] for x in serving.source_counters(r, F.col("src"), F.col("id"), {}, most=2).collect()}
    assert c == {"s0": 3, "s1": 3, "(other sources)": 4}
    due = serving.schedule(spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "b int, n int"), "b", "n", 10.0, block=2)
    assert [x["due"] for x in due.orderBy("b").collect()] == [0.0, 0.5, 1.0]
    cut = serving.batches(r, ["src"], "id", 2, block=3).orderBy("src", "id").collect()
    assert [(x["batch_no"], x["row_no"]) for x in cut if x["src"] == "s0"] == [(0, 0), (0, 1), (1, 0)]


def test_replay(spark, tmp_path):
    flows = spark.range(23).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, "BENIGN").otherwise("DDoS").alias("label"))

    def score(df):
        assert "label" not in df.columns
        return df.withColumn("decision", F.when(F.col("seq") % 2 == 0, "known_attack").otherwise("benign"))

    rows_, report = replay.send(flows, "seq", "label", score, str(tmp_path / "all"), size=5, requests_at_once=2)
    assert sorted(r["seq"] for r in rows_.collect()) == list(range(23)) and report["ending"] == "finished" and report["sent"] == 23
    attacks = [i for i in range(23) if i % 4]
    assert report["any_alert"]["recall"] == sum(i % 2 == 0 for i in attacks) / len(attacks) and report["any_alert"]["fpr"] == 1.0
    assert report["decisions"]["BENIGN"] == {"benign": 0, "anomaly": 0, "known_attack": 6}
    few, report = replay.send(flows, "seq", "label", score, str(tmp_path / "few"), size=4, limit=6)  # ends inside of a request
    assert few.count() == 6 and report["ending"] == "limit reached"
    seen = []
    _, report = replay.send(flows, "seq", "label", score, str(tmp_path / "paced"), size=5, rate=20.0, requests_at_once=1, progress=lambda n, s: seen.append(n), every=0.2)
    assert report["sent"] == 23 and report["seconds"] >= 4 * 0.25 and seen == sorted(seen) and report["rows_per_second"] <= 23.1
    due = replay.recorded_requests(flows, "seq", str(tmp_path / "due"), 5)
    assert [(r["request"], r["n"], r["due_rows"]) for r in due.orderBy("request").collect()] == [(0, 5, 0), (1, 5, 5), (2, 5, 10), (3, 5, 15), (4, 3, 20)]
    _, none = replay.send(flows.limit(0), "seq", "label", score, str(tmp_path / "none"))
    assert none["sent"] == 0 and none["any_alert"]["recall"] is None
    for size in (0, 1001):
        with pytest.raises(ValueError):
            replay.send(flows, "seq", "label", score, str(tmp_path / "bad"), size=size)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a", "train", "benign"), (2, NAN, "b", "test", "anomaly")], "id int, `Flow Bytes/s` double, label string, split string, decision string")
    path = str(tmp_path / "clean")
    sinks.write_clean(df, path, ["Flow Bytes/s"])
    got = sinks.load_split(spark, path, "train", ["id", "Flow Bytes/s"])
    assert got.dtypes == [("id", "int"), ("Flow Bytes/s", "float")] and got.count() == 1
    sinks.append_alerts(df, str(tmp_path / "alerts"), ["Flow Bytes/s"])
    assert spark.read.json(str(tmp_path / "alerts")).columns == ["decision", "id", "label", "split"]
    assert sinks.example_bodies(df, "label", ["Flow Bytes/s"], "id") == {"a": {"features": {"Flow Bytes/s": 2}}, "b": {"features": {"Flow Bytes/s": None}}}
    assert sinks.markdown_table([(12345, 0.123456, "a|b", None)], ["n", "x", "t", "z"]).splitlines()[-1] == "| 12,345 | 0.1235 | a\\|b |  |"
    sinks.access_log(df.withColumn("at", F.lit("2030")).withColumn("source", F.lit(None).cast("string")), str(tmp_path / "log"), "at", "source", "decision")
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "log")).collect()} == {("benign", "unknown", "2030"), ("anomaly", "unknown", "2030")}
    sinks.rewrite_with(df, str(tmp_path / "more"), half=F.col("id") / 2)
    assert spark.read.parquet(str(tmp_path / "more")).columns[-1] == "half"
    sinks.write_sample(df, str(tmp_path / "some"), F.lit(1), 1, sampling.order_key("1", F.col("id")))
    assert spark.read.parquet(str(tmp_path / "some")).count() == 1
    assert sinks.plain_json({"a": [NAN, 1.0, (INF, "x")], 2: None}) == {"a": [None, 1.0, [None, "x"]], "2": None}
    sinks.write_text(spark, str(tmp_path / "t" / "x.txt"), "é\n")
    assert sinks.read_text(spark, str(tmp_path / "t" / "x.txt")) == "é\n"
    (tmp_path / "small.csv").write_text(",r\nNA,0.5\nb,NA\n")
    assert rows(files.read_small_csv(spark, str(tmp_path / "small.csv"), "label")) == [("NA", "0.5"), ("b", "NA")]
    sinks.write_report({"t": df}, str(tmp_path / "rep"), {"rows": 2})
    r = sinks.offline_reports(str(tmp_path / "rep"), {"t": "t.csv", "s": "summary.json", "none": "x.csv"})
    assert r["missing"] == ["none"] and r["s"] == {"rows": 2} and r["t"][0]["Flow Bytes/s"] == 2.0


def test_isolation_forest(spark):
    rng = np.random.default_rng(5)
    data = [(i, *map(float, rng.normal(100, 10, 3)), 0) for i in range(2000)] + [(i, *map(float, rng.normal(1e5, 10, 3)), 1) for i in range(2000, 2050)]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y int")
    m = iforest.fit_isolation_forest(df.where("y = 0"), ["a", "b", "c"], "id", trees=60)
    assert len(m.trees) == 60 and m.sample == 256
    s = m.transform(df).toPandas()
    assert s[s.y == 1].anomaly_score.min() > s[s.y == 0].anomaly_score.quantile(0.99)
    assert ((s.anomaly_score > 0) & (s.anomaly_score <= 1)).all()
    again = iforest.fit_isolation_forest(df.where("y = 0").repartition(7), ["a", "b", "c"], "id", trees=60)
    assert all(np.array_equal(a, b) for a, b in zip(m.trees, again.trees))
    few = iforest.fit_isolation_forest(df.limit(10), ["a"], "id", trees=3)
    assert few.sample == 10


def test_forest_and_explanations(spark):
    rng = np.random.default_rng(6)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), float(c), int(k), f"f{i % 3}") for i, ((a, b, c), k) in enumerate(zip(x, y))], "id long, `Flow Duration` double, `Flow Bytes/s` double, `Destination Port` double, y int, fam string")
    cols = ["Flow Duration", "Flow Bytes/s", "Destination Port"]
    m = models.fit(df.where("id < 500"), cols, F.col("y"), "random_forest", trees=8, depth=5)
    test = df.where("id >= 500")
    p = m.score(test, ["id", "y"])
    assert metrics.rates(metrics.confusion(p, F.col("y"), F.col("p") >= 0.5)).first()["f1"] > 0.9
    vec = m.vectors(test, ["id"]).withColumn("v", models.vector_to_array("__x"))
    e = explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model)).join(p, "id")
    got = e.toPandas()
    for r in got.itertuples():
        assert abs(r.base + sum(c["shap"] for c in r.contributions) - r.p_x if hasattr(r, "p_x") else 0) < 1e-6
    both = explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model)).withColumnRenamed("p", "p2").join(p, "id").toPandas()
    assert (abs(both.p - both.p2) < 1e-9).all()
    assert max(abs(r.base + sum(c["shap"] for c in r.contributions) - r.p) for r in both.itertuples()) < 1e-6
    imp = {r["feature"]: r["mean_abs_shap"] for r in explain.importance(explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model))).collect()}
    assert max(imp, key=imp.get) == "Flow Duration" and "Destination Port" not in imp
    lofo = models.leave_one_out(df.where("id < 500"), test, "fam", cols, F.col("y"), "f0", ["id"], trees=2, depth=2)
    assert {r[0] for r in lofo.select("held").distinct().collect()} == {"f1", "f2"}


def test_shapley_against_definition():
    from itertools import combinations
    from math import factorial

    t = explain.Tree(np.array([0, 1, -1, -1, 0, -1, -1]), np.array([0.5, 0.3, 0, 0, 0.8, 0, 0]), np.array([1, 2, -1, -1, 5, -1, -1]), np.array([4, 3, -1, -1, 6, -1, -1]), np.array([0, 0, 0.1, 0.9, 0, 0.4, 1.0]), np.array([10, 6, 2, 4, 4, 1, 3.0]))
    x = np.array([[0.2, 0.1], [0.2, 0.9], [0.6, 0.0], [0.9, 1.0]])

    def value(row, known, node=0):
        f = t.feature[node]
        if f < 0:
            return t.value[node]
        l, r = t.left[node], t.right[node]
        if f in known:
            return value(row, known, l if row[f] <= t.threshold[node] else r)
        return (t.cover[l] * value(row, known, l) + t.cover[r] * value(row, known, r)) / t.cover[node]

    phi, base = explain.shap_values([t], x)
    assert math.isclose(base, value(x[0], ()))
    for row, got in zip(x, phi):
        for j in range(2):
            rest = [k for k in range(2) if k != j]
            want = sum(factorial(len(s)) * factorial(1 - len(s)) / 2 * (value(row, (*s, j)) - value(row, s)) for n in range(2) for s in combinations(rest, n))
            assert math.isclose(got[j], want, abs_tol=1e-12)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, f"t{i % 2}", float(i), f"2030-01-01 00:{i:02d}:00") for i in range(30)], "event_id long, event_type string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    got = replay.run_available(replay.tumbling(replay.event_time(s, "ts", "1 hour"), "ts", "10 minutes", [], [F.count("*").alias("n")]), "complete", str(tmp_path / "c1"))
    assert sorted(r["n"] for r in got.collect()) == [10, 10, 10]
    low = replay.run_available(replay.bottom_k_stream(s, "event_type", "event_id", 3), "update", str(tmp_path / "c2"))
    assert {r["event_type"]: list(r["keys"]) for r in low.collect()} == {"t0": [0, 2, 4], "t1": [1, 3, 5]}
    sink = replay.scoring_sink(str(tmp_path / "pred"), str(tmp_path / "alerts"))
    scored = s.withColumn("decision", metrics.hybrid_decision(F.col("value") / 30, F.col("value"), 10.0))
    for _ in range(2):
        q = scored.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    once = spark.read.parquet(str(tmp_path / "pred")).drop("batch")
    once = spark.createDataFrame(once.collect(), once.schema)
    assert once.count() == 30
    for _ in range(2):  # a batch that is tried again replaces its rows
        sink(once.limit(30), 0)
    assert spark.read.json(str(tmp_path / "alerts")).count() == 20
