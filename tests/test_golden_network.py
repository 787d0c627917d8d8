"""Boundary cases of the network detectors (hand-written rows)."""

from conftest import net_rows, ts
from pyspark.sql import functions as F

from vigil.operators import aggregates as A
from vigil.operators import detect as D
from vigil.operators import joins as J
from vigil.operators import windows as W

OWN = "192.168.154.133"


def test_syn_flood_threshold(spark):
    rows = [dict(src_ip="1.1.1.1", flags="S") for _ in range(14)] + [dict(src_ip="2.2.2.2", flags="S")
                                                                    for _ in range(15)]
    got = D.incident_syn_flood(net_rows(spark, rows)).collect()
    assert [(r.source, r.description, r.severity) for r in got] == [
        ("2.2.2.2", "2.2.2.2 sent 15 SYN packets", "Critical")]


def test_multi_port_threshold(spark):
    rows = [dict(src_ip="1.1.1.1", dst_port=p) for p in range(4)] + [dict(src_ip="2.2.2.2", dst_port=p)
                                                                    for p in range(5)]
    rows.append(dict(src_ip="3.3.3.3", dst_ip="8.8.8.8", dst_port=9))  # not towards us
    got = D.incident_multi_port(net_rows(spark, rows)).collect()
    assert [(r.source, r.description) for r in got] == [("2.2.2.2", "2.2.2.2 accessed 5 different ports")]


def test_port_scan_rules(spark):
    rows = []
    rows += [dict(src_ip="a", dst_ip="x", dst_port=p, timestamp=ts(h=p)) for p in range(19)]   # 19 slow
    rows += [dict(src_ip="b", dst_ip="x", dst_port=p, timestamp=ts(h=p)) for p in range(20)]   # 20 slow
    rows += [dict(src_ip="c", dst_ip="x", dst_port=p, timestamp=ts(s=p * 30)) for p in range(10)] + [
        dict(src_ip="c", dst_ip="x", dst_port=1, timestamp=ts(s=300))]                        # 10 in 300 s
    rows += [dict(src_ip="d", dst_ip="x", dst_port=p, timestamp=ts(s=p * 30)) for p in range(10)] + [
        dict(src_ip="d", dst_ip="x", dst_port=1, timestamp=ts(s=301))]                        # 10 in 301 s
    rows += [dict(src_ip="e", dst_ip="x", dst_port=p, timestamp=ts(s=0)) for p in range(9)]    # 9 in 0 s
    stats = {r.src_ip: r.is_scan for r in D.port_scan_stats(net_rows(spark, rows)).collect()}
    assert stats == {"a": False, "b": True, "c": True, "d": False, "e": False}
    detail = D.detect_port_scanning(net_rows(spark, rows))
    assert detail.filter("scan_risk = 1").count() == 20 + 11


def test_exfil_boundaries(spark):
    rows = [
        dict(dst_ip="8.8.8.8", bytes_sent=1048576),
        dict(dst_ip="8.8.8.8", bytes_sent=1048577),
        dict(dst_ip="172.99.0.1", bytes_sent=10 ** 9),
        dict(dst_ip=None, bytes_sent=10 ** 9),
    ]
    got = [r.exfil_risk for r in D.detect_exfil(net_rows(spark, rows)).orderBy("id").collect()]
    assert got == [0, 1, 0, 1]


def test_c2_rule(spark):
    rows = [dict(dst_port=8443, dst_ip="1.1.1.1"), dict(dst_port=443, dst_ip="1.1.1.1"),
            dict(dst_port=443, dst_ip="pastebinXcom"), dict(dst_port=443, dst_ip="GitHub.IO"),
            dict(dst_port=443, dst_ip=None)]
    got = [r.c2_risk for r in D.detect_c2(net_rows(spark, rows)).orderBy("id").collect()]
    assert got == [1, 0, 1, 1, 0]


def test_c2_extended_adds_protocol_and_night(spark):
    rows = [dict(dst_port=1, protocol="DNS", timestamp=ts(h=12)), dict(dst_port=1, protocol="TCP", timestamp=ts(h=5)),
            dict(dst_port=1, protocol="TCP", timestamp=ts(h=6)), dict(dst_port=1, dst_ip="a.ddns.net",
                                                                   timestamp=ts(h=12))]
    got = [r.c2_risk for r in D.detect_c2_extended(net_rows(spark, rows)).orderBy("id").collect()]
    assert got == [1, 1, 0, 1]


def test_beaconing_gaps(spark):
    rows = [dict(timestamp=ts(s=0)), dict(timestamp=ts(s=0)), dict(timestamp=ts(s=3600)),
            dict(timestamp=ts(s=7201))]
    for ranged in (False, True):
        got = [(r.time_diff, r.periodic_flag) for r in
               W.beaconing(net_rows(spark, rows), ranged=ranged).orderBy("id").collect()]
        assert got == [(None, False), (0.0, False), (3600.0, True), (3601.0, False)]


def test_interval_join_inclusive(spark):
    from conftest import proc_rows

    proc = proc_rows(spark, [dict(pid=40000, timestamp=ts(h=1))])
    net = net_rows(spark, [dict(src_port=40000, timestamp=ts(h=1, s=300)), dict(src_port=40000, timestamp=ts(h=1, s=-300)),
                           dict(src_port=40000, timestamp=ts(h=1, s=301)), dict(src_port=40000, timestamp=ts(h=1, s=-301)),
                           dict(src_port=40001, timestamp=ts(h=1))])
    got = sorted(r.id for r in J.correlate_process_network(proc, net).collect())
    assert got == [0, 1]


def test_flag_text(spark):
    from vigil.functions.scalars import tcp_flag_text

    vals = [None, "", "None", "SA", "sec", "XYZ", "PA"]
    df = spark.createDataFrame([(v,) for v in vals], "f string")
    got = [r[0] for r in df.select(tcp_flag_text(F.col("f"))).collect()]
    assert got == ["No flags", "No flags", "No flags", "SYN-ACK (Connection established)",
                   "SYN (Connection initiation)", "Uncommon flags: XYZ", "PSH-ACK (Data transmission)"]


def test_hourly_timeline_zero_fill(spark):
    df = net_rows(spark, [dict(timestamp=ts(h=0)), dict(timestamp=ts(h=0, m=5)), dict(timestamp=ts(h=3))])
    got = [(r.hour.hour, r.events) for r in A.hourly_timeline(df).orderBy("hour").collect()]
    assert got == [(0, 2), (1, 0), (2, 0), (3, 1)]


def test_syn_pairs_and_port_counts(spark):
    rows = [dict(src_ip="1.1.1.1", dst_port=22) for _ in range(5)] + [dict(src_ip="1.1.1.1", dst_port=23)
                                                                     for _ in range(4)]
    got = [(r.src_ip, r.dst_port, r["count"]) for r in A.port_access_counts(net_rows(spark, rows)).collect()]
    assert got == [("1.1.1.1", 22, 5)]


def test_ip_enrich_range_join(spark):
    ips = spark.createDataFrame([("203.0.113.5",), ("203.0.113.200",), ("not-an-ip",), (OWN,)], "ip string")
    geo = spark.createDataFrame([(3405803776, 3405803785, "A"), (3405803976, 3405804031, "B")],
                                "ip_start long, ip_end long, country string")
    got = {r.ip: (r.status, r.country) for r in J.ip_enrich(ips, geo).collect()}
    assert got == {"203.0.113.5": ("OK", "A"), "203.0.113.200": ("OK", "B"),
                   "not-an-ip": ("Invalid IP address", None), OWN: ("Whitelisted", None)}


def test_null_keys_belong_to_no_group(spark):
    rows = [dict(src_ip=None, dst_ip="x", dst_port=p, timestamp=ts(s=p)) for p in range(25)]
    rows += [dict(src_ip="a", dst_ip=None, dst_port=1, timestamp=ts(s=1)), dict(src_ip="a", dst_ip=None, dst_port=2,
                                                                               timestamp=ts(s=2))]
    df = net_rows(spark, rows)
    assert D.port_scan_stats(df).count() == 0
    assert D.detect_port_scanning(df).filter("scan_risk = 1").count() == 0
    for ranged in (False, True):
        diffs = [r.time_diff for r in W.time_diff(df, ranged=ranged).collect()]
        assert all(d is None for d in diffs)
    assert D.incident_multi_port(net_rows(spark, [dict(src_ip=None, dst_port=p) for p in range(6)])).count() == 0


def test_network_view_panels_share_one_scored_frame(spark):
    from vigil.plans.network_view import network_view

    rows = [dict(src_ip="9.9.9.9", flags="S", dst_port=p % 3) for p in range(16)]      # 6/5/5 per port
    rows += [dict(src_ip="9.9.9.9", flags="PA", dst_port=10 + p) for p in range(5)]    # 8 distinct ports
    v = network_view(net_rows(spark, rows))
    assert v.syn_floods.count() == 1 and v.port_access.count() == 3
    assert [r.src_ip for r in v.top_inbound.collect()] == ["9.9.9.9"]
    assert {r.type for r in v.incidents.collect()} == {"Multiple Ports Accessed", "Possible SYN Flood"}
    assert v.metrics.first().total_events == 21
