"""Ranged (hot-key safe) windows equal the plain windows."""

import random

import pytest
from conftest import net_rows, proc_rows, ts

from vigil.operators import windows as W


def _hot_rows(n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rnd.random() < 0.6 else f"u{rnd.randint(0, 5)}"
        rows.append(dict(user_name=user, cpu=float(rnd.randint(0, 100)), memory=float(rnd.randint(0, 50)),
                         timestamp=ts(h=rnd.randint(0, 200), m=rnd.randint(0, 3))))
    return rows


def _split(spark, n):
    """More ranges than the session's few shuffle partitions, none merged."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


@pytest.fixture(autouse=True)
def _reset(spark):
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rolling_ranged_equals_plain(spark):
    df = proc_rows(spark, _hot_rows())
    for n in (3, 40):
        _split(spark, n)
        a = sorted(W.rolling_stats(df, ["user_name"], ["cpu", "memory"], ranged=False).collect())
        b = sorted(W.rolling_stats(df, ["user_name"], ["cpu", "memory"]).collect())
        assert len(a) == len(b) == 400
        for x, y in zip(a, b):
            assert x.id == y.id
            for c in ("cpu_rolling_mean", "cpu_rolling_std", "memory_rolling_mean", "memory_rolling_std"):
                assert (x[c] is None and y[c] is None) or abs(x[c] - y[c]) < 1e-9


def test_time_diff_ranged_equals_plain(spark):
    rnd = random.Random(3)
    rows = [dict(src_ip="hot" if rnd.random() < 0.5 else "cold", dst_ip="d",
                 timestamp=ts(h=rnd.randint(0, 100), s=rnd.randint(0, 59))) for _ in range(300)]
    df = net_rows(spark, rows)
    _split(spark, 30)
    a = sorted((r.id, r.time_diff) for r in W.time_diff(df, ranged=False).collect())
    b = sorted((r.id, r.time_diff) for r in W.time_diff(df).collect())
    assert a == b


def test_file_changes_ranged_equals_plain(spark):
    rnd = random.Random(5)
    rows = [(i, ts(h=rnd.randint(0, 100)), "/etc/hot" if rnd.random() < 0.7 else "/etc/x", rnd.randint(0, 1000))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, file string, mtime_s long")
    _split(spark, 30)
    a = sorted(r.id for r in W.file_mod_changes(df, ranged=False).collect())
    b = sorted(r.id for r in W.file_mod_changes(df).collect())
    assert a == b and len(a) > 0


def test_a_burst_of_one_key_spreads_over_ranges(spark):
    """All rows of a hot key within one minute still fill many ranges."""
    rows = [dict(user_name="hot", timestamp=ts(h=1, m=1, s=i % 60)) for i in range(900)]
    rows += [dict(user_name="cold", timestamp=ts(h=i)) for i in range(20)]
    df = proc_rows(spark, rows)
    _split(spark, 16)
    parts = W.into_ranges(df, ["user_name", "timestamp", "id"]).filter("user_name = 'hot'").groupBy(W.PART).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 200
    a = sorted(W.rolling_stats(df, ["user_name"], ["cpu"], ranged=False).collect())
    b = sorted(W.rolling_stats(df, ["user_name"], ["cpu"]).collect())
    assert [(x.id, x.cpu_rolling_mean) for x in a] == [(y.id, y.cpu_rolling_mean) for y in b]


def test_hot_value_joins_are_split(spark):
    """With broadcasts off and one value in 60 % of the rows, adaptive
    execution splits the join of counts and of scan verdicts."""
    from vigil.operators import detect as D

    _split(spark, 8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes") if spark.conf.get(k, None) is not None}
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(0, 40_000, 1, 8).selectExpr(
            "id", "case when id % 10 < 6 then 'hot' else concat('c', id) end as hashed_command", "timestamp'2024-01-01' as timestamp",
            "case when id % 10 < 6 then '1.1.1.1' else concat('2.2.2.', id % 200) end as src_ip", "'9.9.9.9' as dst_ip",
            "cast(id % 50 as int) as dst_port")
        for df in (W.value_frequency(many), D.detect_port_scanning(many)):
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def test_dense_codes_without_exchange_reuse(spark):
    """Codes rest on written ranges, not on the optimizer sharing an exchange."""
    from vigil.operators.features import dense_codes

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        labels = spark.range(400_000).selectExpr("'f' as feature", "concat('label', id) as label")
        got = dense_codes(labels, "feature", "label").selectExpr("count(distinct code) as n", "min(code) as a", "max(code) as b").first()
        assert (got.n, got.a, got.b) == (400_000, 0, 399_999)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
