"""Boundary cases of process filters, scorers, features, dedup (hand-written rows)."""

import math

from conftest import proc_rows, ts
from pyspark.sql import functions as F

from vigil.functions import predicates as P
from vigil.functions import scalars as S
from vigil.operators import clean as C
from vigil.operators import detect as D
from vigil.operators import features as M
from vigil.operators import joins as J
from vigil.operators import sets as X
from vigil.operators import windows as W


def test_high_memory_incident(spark):
    df = proc_rows(spark, [dict(memory=25.0, command="java"), dict(memory=25.1, command="java"),
                           dict(memory=99.0, command="/usr/bin/python3 x.py")])
    got = [r.description for r in D.incident_high_memory(df).collect()]
    assert got == ["Process using 25.1% Memory: java"]


def test_whitelist_is_substring(spark):
    df = spark.createDataFrame([("bash -c curl x",), (None,), ("",), ("curl x",)], "c string")
    got = [r[0] for r in df.select(P.is_whitelisted(F.col("c"))).collect()]
    assert got == [True, False, False, False]


def test_suspicious_process_regex(spark):
    df = proc_rows(spark, [dict(command="NMAP -sS"), dict(command="bash -c curl x"), dict(command="nc -l"),
                           dict(command="ncat")])
    got = [r.command for r in D.suspicious_process_filter(df).orderBy("id").collect()]
    assert got == ["NMAP -sS", "nc -l"]


def test_threat_score(spark):
    rows = [("ls", 1.0, 1.0, None), ("wget x", 1.0, 1.0, None), ("wget x | curl y", 1.0, 1.0, None),
            ("ls", 91.0, 91.0, None), ("ls", 90.0, 91.0, None), ("ls", 1.0, 1.0, "BruteForce"),
            ("ls", 1.0, 1.0, "portscan ddos"), ("rm -rf / ; nmap", 95.0, 95.0, None)]
    df = spark.createDataFrame(rows, "command string, cpu double, memory double, type string")
    got = [r[0] for r in df.select(S.threat_score(df)).collect()]
    assert got == [0, 60, 100, 40, 0, 70, 100, 100]


def test_high_risk_minimal_set_equivalent(spark):
    from vigil import rules

    cmds = ["id", "nc -e /bin/sh", "echo hi", "scp -r a b", "cat ~/.bash_history", "", None, "xyz whoami"]
    df = spark.createDataFrame([(c,) for c in cmds], "c string")
    got = [r[0] for r in df.select(P.high_risk_match(F.col("c"))).collect()]
    want = [bool(c) and any(p in c for p in rules.HIGH_RISK_COMMANDS) for c in cmds]
    assert got == want


def test_time_used_and_scalars(spark):
    df = spark.createDataFrame([("5:03.25",), ("0:00.5",), (None,), ("bad",), ("1:2:3",)], "t string")
    got = [r[0] for r in df.select(S.time_used_seconds(F.col("t"))).collect()]
    assert got == [303.25, 0.5, 0.0, None, 62.0]
    e = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "c string")
    ent = [r[0] for r in e.select(S.command_entropy(F.col("c"))).collect()]
    assert ent[0] == 1.0 and ent[1] == 0.0 and math.isclose(ent[2], 2.0)
    m = spark.createDataFrame([("12m",), ("1.5g",), ("100",), ("x",)], "v string")
    assert [r[0] for r in m.select(S.parse_mem_unit(F.col("v"))).collect()] == [12288, 1572864, 100, None]


def test_process_info(spark):
    df = spark.createDataFrame([("/usr/bin/NMAP -sS",), ("curl x",), ("java -jar",), (None,), ("   ",)], "c string")
    got = [(r.i.process, r.i.risk_level, r.i.description) for r in df.select(S.process_info(F.col("c")).alias("i"))
           .collect()]
    assert got == [("NMAP", "High", "Network scanning tool"), ("curl", "Medium", "Data transfer tool"),
                   ("java", "Unknown", "Unknown"), ("Unknown", "Unknown", "No process information available"),
                   ("Unknown", "Unknown", "No process information available")]


def test_rolling_matches_plain_and_min_periods(spark):
    rows = [dict(user_name="a", cpu=float(i), timestamp=ts(h=i * 5)) for i in range(6)]
    rows += [dict(user_name="b", cpu=7.0, timestamp=ts(h=1))]
    rows += [dict(user_name="c", cpu=float(i), timestamp=ts(h=2)) for i in range(5)]  # ties on time
    df = proc_rows(spark, rows)
    plain = W.rolling_stats(df, ["user_name"], ["cpu"], ranged=False)
    spread = W.rolling_stats(df, ["user_name"], ["cpu"], ranged=True)
    a = sorted((r.id, r.cpu_rolling_mean, r.cpu_rolling_std) for r in plain.collect())
    b = sorted((r.id, r.cpu_rolling_mean, r.cpu_rolling_std) for r in spread.collect())
    assert a == b
    by_id = {r[0]: r for r in a}
    assert by_id[0][2] is None and by_id[0][1] == 0.0          # first row: std NULL
    assert by_id[5][1] == 3.0                                   # mean of 1..5
    assert by_id[6][2] is None                                  # single row user


def test_vocab_and_unseen(spark):
    train = proc_rows(spark, [dict(command=c) for c in ["b", "a", "c", "a"]])
    vocab = M.fit_vocab(train, ["command"])
    assert sorted((r.label, r.code) for r in vocab.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    later = proc_rows(spark, [dict(command=c) for c in ["c", "zz"]])
    got = [r.command_encoded for r in M.encode(later, vocab, ["command"]).orderBy("id").collect()]
    assert got == [2, -1]


def test_dense_codes_many_partitions(spark):
    labels = spark.range(0, 5000).select(F.lit("f").alias("feature"), F.format_string("%05d", "id").alias("label"))
    codes = M.dense_codes(labels, "feature", "label")
    got = sorted((r.label, r.code) for r in codes.collect())
    assert [c for _, c in got] == list(range(5000))


def test_scaler_constant_column(spark):
    df = proc_rows(spark, [dict(cpu=5.0, memory=float(i)) for i in range(4)])
    sc = {r.feature: (r.mean, r.scale) for r in M.fit_scaler(df, ["cpu", "memory"]).collect()}
    assert sc["cpu"] == (5.0, 1.0)
    assert math.isclose(sc["memory"][1], math.sqrt(1.25))


def test_dedup_first_and_new_rows(spark):
    new = proc_rows(spark, [dict(id=1, timestamp=ts(s=1), command="first"), dict(id=2, timestamp=ts(s=1), command="second"),
                            dict(id=3, timestamp=ts(s=2)), dict(id=4, timestamp=ts(s=3))])
    stored = proc_rows(spark, [dict(id=9, timestamp=ts(s=3))])
    got = J.new_rows_only(X.dedup_first(new, ["timestamp"], ["id"]), stored)
    assert sorted((r.id, r.command) for r in got.collect()) == [(1, "first"), (3, "ls")]
    once = X.dedup_first(new, ["timestamp"], ["id"])
    assert sorted(once.collect()) == sorted(X.dedup_first(once, ["timestamp"], ["id"]).collect())


def test_over_limit_and_manager_view(spark):
    df = proc_rows(spark, [dict(cpu=31.0, command="miner"), dict(cpu=30.0, command="miner"),
                           dict(cpu=99.0, command="python3 /tst.py"), dict(cpu=50.0, command="x /script.py")])
    assert [r.cpu for r in C.over_limit_candidates(df, "cpu").collect()] == [31.0]
    assert [r.cpu for r in C.manager_view(df, pool=2).collect()] == []


def test_null_user_gets_no_rolling_stats(spark):
    df = proc_rows(spark, [dict(user_name=None, cpu=1.0), dict(user_name=None, cpu=3.0), dict(user_name="a", cpu=2.0)])
    for ranged in (False, True):
        got = {r.id: r.cpu_rolling_mean for r in W.rolling_stats(df, ["user_name"], ["cpu"], ranged=ranged).collect()}
        assert got == {0: None, 1: None, 2: 2.0}
