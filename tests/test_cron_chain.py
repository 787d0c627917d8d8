"""The cron state rule by pointers against a plain fold."""

import datetime as dt
import random

import pytest

from vigil.operators import cron_chain as C

T0 = dt.datetime(2024, 1, 1)
JOBS = "cron_file string, snapshot_ts timestamp, job string"


def fold(rows, known):
    files, added, state = {}, [], {}
    for f, t, j in rows:
        files.setdefault(f, {}).setdefault(t, set()).add(j)
    for f, snaps in files.items():
        jobs = {j for g, j in known if g == f}
        for t in sorted(snaps):
            new = snaps[t] - jobs
            if new:
                added += [(f, t, j) for j in new]
                jobs = snaps[t]
                state[f] = [(f, t, j) for j in jobs]
    return sorted(added, key=repr), sorted((r for s in state.values() for r in s), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_snapshots(spark, seed):
    rng = random.Random(seed)
    rows, known = [], []
    for f in ("/a", "/b", "/c", None):
        jobs = [f"job {k}" for k in range(rng.choice([3, 6]))]
        known += [(f, j) for j in jobs if rng.random() < 0.3]
        on = {j: rng.random() < 0.5 for j in jobs}
        for t in range(rng.choice([1, 30, 45])):
            for j in jobs:
                if rng.random() < 0.25:
                    on[j] = not on[j]
                if on[j]:
                    rows += [(f, T0 + dt.timedelta(hours=t), j)] * rng.choice([1, 2])
    known += [("/gone", "job 1")]
    added, state = C.state_changes(spark.createDataFrame(rows, JOBS).repartition(5), spark.createDataFrame(known, "cron_file string, job string"))
    assert (got(added), got(state)) == fold(rows, known)


def test_hot_file_spreads_over_ranges(spark):
    """One file with nearly all snapshots, a job in every one of them and one that flaps."""
    rows = [("/hot", T0 + dt.timedelta(minutes=t), j) for t in range(1500) for j in
            ["always"] + ["flaps"] * (t % 3 == 0) + [f"once {t}"] * (t % 100 == 7)]
    rows += [("/cold", T0, "x")]
    frame = spark.createDataFrame(rows, JOBS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = C.into_ranges(frame, ["cron_file", "snapshot_ts", "job"]).groupBy(C.PART).count().collect()
        assert len(parts) >= 6 and max(r["count"] for r in parts) < 700
        added, state = C.state_changes(frame, spark.createDataFrame([], "cron_file string, job string"))
        assert (got(added), got(state)) == fold(rows, [])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nothing(spark):
    added, state = C.state_changes(spark.createDataFrame([], JOBS), spark.createDataFrame([("/a", "j")], "cron_file string, job string"))
    assert added.count() == state.count() == 0
    added, state = C.state_changes(spark.createDataFrame([("/a", T0, "j"), ("/a", None, "k"), ("/a", T0, None)], JOBS),
                                   spark.createDataFrame([("/a", "j")], "cron_file string, job string"))
    assert added.count() == state.count() == 0
