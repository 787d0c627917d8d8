"""Queries on model output: relations that hold whatever the trees are."""

import pytest

import __spark_entry__ as E
from vigil.operators import aggregates as A
from vigil.operators import detect as D
from vigil.operators import features as M
from vigil.operators import joins as J
from vigil.plans import flagship as FL
from vigil.sources.adapters import Tables
from vigil.sources.files import write_csv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def intel(spark):
    t = Tables(spark, SF)
    return t, FL.process_intelligence(t.process, t.network)


def test_top_and_critical_anomalies(intel):
    _, i = intel
    bad = sorted((r.anomaly_score, r.id) for r in i.process.filter("is_anomaly = -1").collect())
    assert bad and [(r.anomaly_score, r.id) for r in FL.top_anomalies(i.process).collect()] == bad[:10]
    limit = bad[len(bad) // 2][0]
    assert sorted(r.id for r in D.critical_anomalies(i.process, limit).collect()) == sorted(x for s, x in bad if s < limit)


def test_related_activity(intel):
    _, i = intel
    top = {(r.pid, r.timestamp) for r in FL.top_anomalies(i.process).collect()}
    want = sorted((r.id, r.src_ip or "") for r in i.merged.collect() if (r.pid, r.timestamp) in top)
    assert sorted((r.id, r.src_ip or "") for r in FL.related_activity(i).collect()) == want


def test_matrices_equal_the_join(intel):
    """The pre-aggregated matrices give what aggregating the whole join gives."""
    _, i = intel
    stats = A.network_window_stats(i.network)
    pdf = J.network_behavior_join(i.process, stats).select("command", "n_dst_ports", "anomaly_risk", "bytes_sent", "pid").toPandas()
    pdf = pdf.dropna(subset=["command", "n_dst_ports"])
    g = pdf.groupby(["command", "n_dst_ports"])
    want = {k: (v.anomaly_risk.max(), v.bytes_sent.sum(), v.pid.nunique(), v.anomaly_risk.mean()) for k, v in g}
    got = {(r.command, r.n_dst_ports): (r.max_risk, r.bytes_sent, r.n_pids) for r in A.threat_matrix(i.process, stats).collect()}
    assert got == {k: v[:3] for k, v in want.items()} and got
    mean = {(r.command, r.n_dst_ports): r.avg_risk for r in A.risk_density(i.process, stats).collect()}
    assert mean == pytest.approx({k: v[3] for k, v in want.items()})
    top = A.top_matrix(A.threat_matrix(i.process, stats)).collect()
    assert [r.max_risk for r in top] == sorted((v[0] for v in want.values()), reverse=True)[:10]


def test_alert_rows_and_counts(intel):
    _, i = intel
    process = i.process.withColumn("anomaly_score", i.process.anomaly_score - 1)
    network = i.network.withColumn("threat_score", i.network.dst_port % 5 * 25)
    got = D.alert_rows(process, network).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {
        "anomaly": D.critical_anomalies(process).count(), "network": network.filter("threat_score > 80").count()}
    assert all(r["count"] > 0 for r in got) and len(got) == 2
    counts = A.threat_counts(i.process, i.network).collect()
    assert counts and all(v is not None for r in counts for v in r)


def test_assemble_has_every_feature(spark, intel):
    from vigil import rules

    t, _ = intel
    _, matrix, _, _ = M.prepare_model_input(t.process)
    assert [c for c in matrix.columns if c in rules.MODEL_FEATURES] == rules.MODEL_FEATURES
    assert matrix.count() == t.process.count()
    assert matrix.filter(" or ".join(f"{c} is null or isnan({c})" for c in rules.MODEL_FEATURES)).count() == 0


def test_kmeans_separates_a_planted_source(spark):
    from conftest import net_rows
    from vigil.operators.cluster import kmeans_sources

    rows = [dict(src_ip=f"10.0.0.{i % 8}", dst_port=80, bytes_sent=10) for i in range(80)]
    rows += [dict(src_ip="6.6.6.6", dst_port=p, dst_ip=f"1.1.1.{p % 250}", flags="S", bytes_sent=10**6) for p in range(200)]
    got = {r.src_ip: r for r in kmeans_sources(net_rows(spark, rows), k=2).collect()}
    assert got["6.6.6.6"].n_dst_ports == 200
    assert {r.cluster for ip, r in got.items() if ip != "6.6.6.6"}.isdisjoint({got["6.6.6.6"].cluster})


def test_anomaly_histogram_covers_all_scores(spark, intel):
    _, i = intel
    bins = A.value_histogram(i.process, "anomaly_score", 0.05).collect()
    assert sum(r["count"] for r in bins) == i.process.count()
    assert "anomaly_score_histogram" in E.queries()


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "id long, text string")
    write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted((r.id, r.text) for r in back.collect()) == [("1", 'a,"b"'), ("2", None)]


def test_ip_shapes(spark):
    from pyspark.sql import functions as F
    from vigil.functions.predicates import validate_ip

    good = ["1.2.3.4", "::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "a::b:c"]
    bad = ["1:2:3", ":::", "::::", "1::2::3", "1:2:3:4:5:6:7:8:9", "12345::", "1:2:3:4:5:6:7", "::1.2.3", "1.2.3.256", "x", "1:2:3:4:5:6:7::8"]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "ip string").select("ip", validate_ip(F.col("ip")).alias("ok")).collect()
    assert {r.ip for r in rows if r.ok} == set(good)


def test_nan_is_over_no_limit(spark):
    from conftest import proc_rows
    from vigil.functions import scalars as S

    df = proc_rows(spark, [dict(memory=float("nan"), cpu=float("nan"), command="x")])
    assert D.high_memory_filter(df).count() == 0
    assert df.select(S.threat_score(df).alias("s")).first().s == 0


def test_stored_network_schema_has_defaults(spark):
    df = spark.createDataFrame([], "id long, timestamp timestamp, src_ip string")
    assert A.network_window_stats(df).columns == ["time_window", "src_ip", "bytes_sent", "n_dst_ports", "n_dst_ips"]
    one = spark.createDataFrame([(1, "1.1.1.1")], "id long, src_ip string")
    assert D.detect_port_scanning(one).first().scan_risk == 0
