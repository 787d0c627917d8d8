import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_session

    s = get_session(master="local[*]", shuffle_partitions=8, app="vigil-tests")
    yield s


def ts(h=0, m=0, s=0, day=1):
    return dt.datetime(2024, 1, day, 0, 0, 0) + dt.timedelta(hours=h, minutes=m, seconds=s)


NET_SCHEMA = ("id long, timestamp timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
              "flags string, bytes_sent long, duration double, protocol string")
PROC_SCHEMA = ("id long, timestamp timestamp, pid int, user_name string, cpu double, memory double, virt long, "
               "res long, shr long, s string, time_used string, command string, hashed_command string")


def net_rows(spark, rows):
    """rows: dicts with any NET_SCHEMA fields; the rest defaulted."""
    base = dict(src_ip="10.0.0.1", dst_ip="192.168.154.133", src_port=40000, dst_port=80, flags="PA",
                bytes_sent=10, duration=1.0, protocol="TCP")
    out = []
    for i, r in enumerate(rows):
        d = {**base, **r}
        out.append((i, d.get("timestamp", ts(s=i)), d["src_ip"], d["dst_ip"], d["src_port"], d["dst_port"],
                    d["flags"], d["bytes_sent"], d["duration"], d["protocol"]))
    return spark.createDataFrame(out, NET_SCHEMA)


def proc_rows(spark, rows):
    base = dict(pid=1, user_name="u", cpu=1.0, memory=1.0, virt=1000, res=10, shr=1, s="S", time_used="0:01.00",
                command="ls", hashed_command=None)
    out = []
    for i, r in enumerate(rows):
        d = {**base, **r}
        out.append((d.get("id", i), d.get("timestamp", ts(s=i)), d["pid"], d["user_name"], d["cpu"], d["memory"],
                    d["virt"], d["res"], d["shr"], d["s"], d["time_used"], d["command"], d["hashed_command"]))
    return spark.createDataFrame(out, PROC_SCHEMA)
