import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.models import metrics, random_forest
from logwarden.models.isolation_forest import IsolationForest, IsolationForestModel
from logwarden.operators import alerts, drift, ensemble, feedback, labels, reports
from logwarden.plans.analysis import AnalysisConfig, Models, analyze, score
from logwarden.plans.features import FeatureConfig, build_features, definitions

CASES = [
    # anomaly, class, confidence -> risk, level, priority
    (0.9, "Exfiltration", 0.95, 1.0, "Critical", "P0-Critical"),
    (0.6, "Malware", 0.9, (0.24 + 0.6 * 0.81) * 1.2, "Critical", "P0-Critical"),
    (0.5, "Malware", 0.7, (0.2 + 0.6 * 0.63) * 1.2, "High", "P1-High"),
    (0.9, "BruteForce", 0.9, 0.36 + 0.6 * 0.63, "High", "P2-Medium"),
    (0.4, "DDoS", 0.9, 0.16 + 0.6 * 0.54, "Medium", "P3-Low"),
    (0.3, "Benign", 0.9, 0.06, "Low", "P4-Info"),
    (0.9, "Benign", 0.9, 0.36, "Low", "P4-Info"),
    (0.5, "Other", 0.3, 0.2 + 0.6 * 0.25, "Low", "P4-Info"),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, a, c, p, f"10.0.0.{i}", dt.datetime(2026, 1, 1, 0, 0, i)) for i, (a, c, p, *_) in enumerate(CASES)]
    return ensemble.score(spark.createDataFrame(
        rows, "record_id long, anomaly_score double, classification string, class_confidence double, src_ip string, ts timestamp_ntz"))


def test_ensemble_table(scored):
    for r, (a, c, p, risk, level, priority) in zip(scored.orderBy("record_id").collect(), CASES):
        assert r["combined_risk_score"] == pytest.approx(risk)
        assert (r["risk_level"], r["alert_priority"]) == (level, priority)
        assert r["requires_alert"] == (priority < "P3")


def test_reasons_and_actions(scored):
    r = {x["record_id"]: x for x in scored.collect()}
    assert r[0]["reasoning"] == ["Classified as Exfiltration with 95.0% confidence", "High anomaly score (0.90)",
                                 "Risk boosted: severe threat with anomalous behavior"]
    assert r[5]["reasoning"] == ["Risk reduced: confident benign with normal behavior"]
    assert r[7]["reasoning"] == ["Low classification confidence (30.0%)", "Moderate anomaly score (0.50)"]
    assert r[2]["suggested_action"] == "Isolate endpoint and investigate" and r[5]["suggested_action"] == "Monitor"
    assert r[7]["threat_category"] == "Unknown" and r[7]["contributing_factors"]["threat_severity"] == 0.5


def test_alerts_are_reproducible(scored):
    one, two = (sorted(r["alert_id"] for r in alerts.generate_alerts(scored).collect()) for _ in range(2))
    assert one == two and len(one) == 4
    a = alerts.generate_alerts(scored)
    assert a.where("classification = 'Malware'").first()["mitre_tactics"] == ["Execution", "Persistence", "Defense Evasion"]
    assert alerts.at_least(a, "P0-Critical").count() == 2
    assert [r["priority"] for r in alerts.by_urgency(a, "timestamp").collect()] == ["P0-Critical", "P0-Critical", "P1-High", "P2-Medium"]
    assert alerts.search(a, "critical", "EXFIL", ["classification"]).count() == 1
    text = alerts.summary_text(a).where("priority = 'P2-Medium'").first()["summary_text"]
    assert text.startswith("ALERT: P2-Medium - BruteForce") and "T1110 - Brute Force, T1078 - Valid Accounts" in text


def test_counts(scored):
    risk = {r["risk_level"]: r["n"] for r in reports.risk_distribution(scored.where("risk_level <> 'Medium'")).collect()}
    assert risk == {"Low": 3, "Medium": 0, "High": 2, "Critical": 2}
    a = alerts.generate_alerts(scored)
    assert reports.threat_level(a).first()["threat_level"] == "critical"
    assert reports.threat_level(a.where("priority = 'P2-Medium'")).first()["threat_level"] == "elevated"
    assert reports.threat_level(a.limit(0)).first()["threat_level"] == "normal"


def test_drift_guards(spark, tmp_path):
    def history(n, high):
        return spark.range(n).select(
            F.col("id").alias("record_id"), F.expr("timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2026-01-01 00:00:00')").alias("ts"),
            F.when(F.col("id") >= n - 100, high).otherwise(0.5).alias("anomaly_score"), F.lit(0.5).alias("risk_score"),
            F.when(F.col("id") >= n - 100, "DDoS").otherwise("Benign").alias("classification"))

    report = lambda n, high: drift.drift_report(history(n, high), "ts", "record_id").first()
    assert report(5, 0.5)["window_size"] == 0
    r = report(105, 0.6)
    assert (r["window_size"], r["baseline_size"], r["anomaly_drift"]) == (100, 0, "NONE") and r["anomaly_score_mean"] == pytest.approx(0.6)
    r = report(300, 0.7)
    for n in (300, 200):
        drift.save_report(drift.drift_report(history(n, 0.7), "ts", "record_id"), str(tmp_path / "reports"))
    assert drift.report_history(spark.read.parquet(str(tmp_path / "reports")), 1).count() == 1
    assert r["anomaly_change_pct"] == pytest.approx(40.0) and r["anomaly_drift"] == "MODERATE" and r["class_drift"] == "HIGH"


def test_calibration(spark):
    report = spark.createDataFrame([(0.65, 30.0)], "anomaly_score_mean double, anomaly_change_pct double")
    fb = spark.createDataFrame([("reject",)] * 10 + [("accept",)] * 10, "analyst_action string")
    out = {r["path"]: r for r in drift.calibrate(report, feedback.feedback_totals(fb)).collect()}
    assert out["anomaly.high_threshold"]["recommended"] == pytest.approx(0.75)
    assert out["priority.critical"]["reason"].startswith("High rejection rate (10/20 = 50.0%)")
    few = feedback.feedback_totals(fb.limit(19))
    calm = spark.createDataFrame([(0.5, 30.0)], "anomaly_score_mean double, anomaly_change_pct double")
    assert drift.calibrate(calm, few).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(" DoS Hulk ",), ("PortScan",), ("what",)], "`Attack` string")
    named = labels.normalize_training_columns(df)
    assert [r["label"] for r in labels.map_labels(named).collect()] == ["DDoS", "BruteForce", "Unknown"]


def test_stratified_split_is_exact(spark, small_runs):
    df = spark.range(103).select(F.col("id").alias("record_id"), F.when(F.col("id") < 50, "a").otherwise("b").alias("label"))
    got = {(r["label"], r["is_test"]): r["count"] for r in labels.stratified_split(df, "record_id").groupBy("label", "is_test").count().collect()}
    assert got == {("a", False): 40, ("a", True): 10, ("b", False): 42, ("b", True): 11}


@pytest.mark.parametrize("share,rounds,digits", [(0.2, 2, 12), (0.5, 1, 3), (1.0, 2, 4), (0.0, 3, 5), (0.01, 2, 2)])
def test_stratified_split_ids(spark, share, rounds, digits):
    import hashlib
    import math

    rows = [(f"r{i}", "abc"[min(2, i % 7)] if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id string, label string")
    got = {r.record_id: r.is_test for r in labels.stratified_split(df, "record_id", test_share=share, seed=5, rounds=rounds, digits=digits).collect()}
    want = {}
    for label in "abc":
        ids = sorted((int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:15], 16), i) for i, x in rows if x == label)
        keep = math.floor(len(ids) * (1.0 - share) + 1e-9)
        want |= {i: n >= keep for n, (_, i) in enumerate(ids)}
    assert got == want


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(7)
    benign = rng.normal(size=(300, 3))
    attack = rng.normal(size=(40, 3)) * 3 + 8
    data = [(i, *map(float, x), "Benign") for i, x in enumerate(benign)] + [(1000 + i, *map(float, x), "DDoS") for i, x in enumerate(attack)]
    return spark.createDataFrame(data, "record_id long, a double, b double, c double, label string")


def test_isolation_forest(clusters, tmp_path):
    model = IsolationForest(features=["a", "b", "c"], trees=50).fit(labels.benign_only(clusters))
    out = model.transform(clusters)
    sep = metrics.score_separation(out).first()
    assert 0.4 < sep["benign_mean"] < 0.5 < sep["attack_mean"] < 0.7
    path = str(tmp_path / "forest")
    model.write().overwrite().save(path)
    again = IsolationForestModel.load(path).transform(clusters)
    key = lambda df: [(r["record_id"], r["anomaly_score"]) for r in df.orderBy("record_id").collect()]
    assert key(again) == key(out)
    # A bad value counts as 0 and does not break the batch.
    odd = clusters.limit(1).withColumn("a", F.lit(float("nan"))).withColumn("b", F.lit(None).cast("double"))
    assert model.transform(odd).first()["anomaly_score"] is not None


def test_random_forest(clusters, tmp_path):
    model = random_forest.fit_random_forest(clusters, ["a", "b", "c"], trees=10, max_depth=5)
    out = random_forest.classify(clusters, model)
    assert metrics.accuracy(metrics.confusion(out, "label", "classification")).first()["accuracy"] > 0.97
    r = out.where("label = 'DDoS'").first()
    assert r["class_confidence"] == pytest.approx(max(r["class_probabilities"].values())) and set(r["class_probabilities"]) == {"Benign", "DDoS"}
    assert random_forest.classify(clusters, None).first()["classification"] == "Unknown"
    assert random_forest.feature_importance(model, clusters.sparkSession).count() == 3


def test_features_and_analysis(spark, skewed, tmp_path):
    records = skewed.select(F.col("event_id").alias("record_id"), "ts", F.col("user").alias("src_ip"), F.col("event_type").alias("action"),
                            F.concat(F.lit("d"), F.col("event_id") % 7).alias("dst_ip"), (F.col("event_id") % 9 * 1000).cast("int").alias("dst_port"),
                            F.lit("TCP").alias("protocol"), F.col("value").alias("bytes_total"))
    config = FeatureConfig(ts="ts")
    feats = build_features(records, config)
    names = [d.name for d in definitions(config)]
    assert len(names) == 64 and set(names) <= set(feats.columns) and feats.count() == 1000
    empty = feats.where("src_ip IS NULL").first()
    assert empty["stat_record_count"] == 0 and empty["behav_events_in_session"] == 0 and empty["net_is_tcp"] == 1
    assert feats.where("behav_is_new_action = 1").count() == 0
    fresh = build_features(records, config, baseline=records.limit(0))
    assert fresh.where("behav_is_new_action = 1").count() == records.where("src_ip IS NOT NULL").select("src_ip", "action").distinct().count()

    forest = IsolationForest(features=["bytes_total", "net_conn_count"], trees=10).fit(feats)
    models = Models(forest, random_forest.fit_random_forest(
        feats.withColumn("label", F.when(F.col("bytes_total") > 60, "Malware").otherwise("Benign")), ["bytes_total", "dst_port"], trees=5, max_depth=4))
    models.save(str(tmp_path / "models"))
    results, found = analyze(records, Models.load(str(tmp_path / "models")), AnalysisConfig(features=config))
    assert set(r[0] for r in results.select("classification").distinct().collect()) == {"Malware", "Benign"}
    assert results.count() > 0 and found.count() == results.where("requires_alert").count()


def test_foreign_models_plug_in(spark):
    class Detector:
        def transform(self, df):
            return df.withColumn("anomaly_score", F.when(F.col("bytes_total") > 100, 0.9).otherwise(0.1))

    class Classifier:
        def transform(self, df):
            return df.withColumn("classification", F.when(F.col("bytes_total") > 100, "Malware").otherwise("Benign"))

    df = spark.createDataFrame([(1, 500.0), (2, 5.0)], "record_id long, bytes_total double")
    rows = {r["record_id"]: r for r in score(df, Models(Detector(), Classifier())).collect()}
    assert (rows[1]["classification"], rows[1]["anomaly_score"], rows[1]["class_confidence"]) == ("Malware", 0.9, 1.0)
    assert rows[1]["combined_risk_score"] > rows[2]["combined_risk_score"]
    with pytest.raises(ValueError):
        score(df, Models(Detector(), Detector()))


def test_training_makes_its_rows_once(spark):
    from logwarden.plans import analysis

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i % 17)

    rows = spark.range(240).select(F.col("id").alias("record_id"), value("id").alias("x"),
                                   F.when(F.col("id") % 3 == 0, "DDoS").otherwise("Benign").alias("label"))
    models = analysis.train(rows, ["x"], trees=2, max_depth=2)
    assert made.value == 240
    assert models.random_forest is not None and models.isolation_forest is not None
