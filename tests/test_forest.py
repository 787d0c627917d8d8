"""Isolation forest properties (planted outliers, contamination, determinism)."""

import numpy as np
import pandas as pd

from vigil.operators import forest as FR


def _data(spark, n=2000, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, size=(n, 3))
    X[:10] += 12.0  # planted outliers, ids 0..9
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf.insert(0, "id", np.arange(n))
    return spark.createDataFrame(pdf).repartition(parts)


def test_outliers_rank_first_and_contamination(spark):
    X = _data(spark)
    model = FR.train(X, ["a", "b", "c"], n_trees=60)
    scored = FR.score_anomalies(X, model)
    top = [r.id for r in scored.orderBy("anomaly_score").limit(10).collect()]
    assert sorted(top) == list(range(10))
    share = scored.filter("is_anomaly = -1").count() / 2000
    assert 0.03 <= share <= 0.07
    lo, hi = scored.agg({"anomaly_score_raw": "min"}).first()[0], scored.agg({"anomaly_score_raw": "max"}).first()[0]
    assert -1.0 <= lo <= hi <= 0.0


def test_same_seed_same_trees_any_partitioning(spark):
    a = FR.fit_isolation_forest(_data(spark, parts=2), ["a", "b", "c"], n_trees=20).nodes
    b = FR.fit_isolation_forest(_data(spark, parts=7), ["a", "b", "c"], n_trees=20).nodes
    ka = sorted(tuple(r) for r in a.fillna(-9.0).collect())
    kb = sorted(tuple(r) for r in b.fillna(-9.0).collect())
    assert ka == kb


def test_c_factor():
    assert FR.c_factor(1) == 0.0 and FR.c_factor(2) == 1.0
    assert abs(FR.c_factor(256) - 10.244770920116851) < 1e-9


def test_model_and_preprocessing_round_trip(spark):
    import tempfile

    from conftest import proc_rows, ts
    from vigil.operators import features as M
    from vigil.plans.flagship import process_intelligence, retrain

    rows = [dict(user_name=f"u{i % 3}", cpu=float(i % 17), memory=float(i % 11), command=f"cmd{i % 4}",
                 timestamp=ts(h=i % 48, m=i % 60)) for i in range(300)]
    proc = proc_rows(spark, rows)
    net = spark.createDataFrame([], "id long, timestamp timestamp, src_ip string, dst_ip string, src_port int, "
                                    "dst_port int, flags string, bytes_sent long, duration double, protocol string")
    path = tempfile.mkdtemp(prefix="vigil-model-", dir="/tmp")
    a = process_intelligence(proc, net, model_path=path)
    first = sorted((r.id, r.anomaly_score) for r in a.process.collect())
    vocab1 = sorted(tuple(r) for r in spark.read.parquet(f"{path}/vocab").collect())
    # Second run reuses the stored forest, vocabulary and scaler: same scores.
    b = process_intelligence(proc, net, model_path=path)
    assert sorted((r.id, r.anomaly_score) for r in b.process.collect()) == first
    # Retrain refits the trees but keeps the vocabulary (never refit by default).
    retrain(proc.filter("cpu < 10"), hours=None, model_path=path)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/vocab").collect()) == vocab1
    v, s = M.load_preprocessing(spark, path)
    assert v is not None and s is not None


def _plain_walk(X, nodes):
    """Path lengths by asking at every step which rows have arrived."""
    total, rows = np.zeros(len(X)), np.arange(len(X))
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        feat, thr, left, right, plen = (tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path_len"))
        at = np.zeros(len(X), dtype=int)
        while (inner := feat[at] >= 0).any():
            go_left = X[rows, np.where(inner, feat[at], 0)] <= thr[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += np.nan_to_num(plen)[at]
    return total / nodes["tree"].nunique()


def test_walk_is_the_plain_walk_in_half_the_time():
    import time
    from types import SimpleNamespace

    rng, names = np.random.default_rng(3), [f"f{i}" for i in range(20)]
    grown = []
    for t in range(40):
        rows = pd.DataFrame(np.round(rng.normal(size=(256, 20)), 1), columns=names).assign(tree=t, _h=rng.permutation(256))
        grown.append(FR._grow_tree(rows, names, 7, 8))
    grown.append(FR._grow_tree(rows.head(1).assign(tree=40), names, 7, 8))  # a root without children
    nodes = pd.concat(grown).sample(frac=1.0, random_state=1)
    m = FR._model_arrays(SimpleNamespace(nodes=SimpleNamespace(toPandas=nodes.copy)))
    X = np.round(rng.normal(size=(10_000, 20)), 1)
    X[0], X[1], X[2, 3] = np.inf, -np.inf, np.nan
    took = {}
    for name, walk in (("plain", lambda: _plain_walk(X, nodes)), ("new", lambda: FR._path_lengths(X, m))):
        took[name] = min(_timed(walk, time.process_time) for _ in range(3))
    assert np.array_equal(_plain_walk(X, nodes), FR._path_lengths(X, m))
    assert FR._path_lengths(X[:0], m).size == 0
    assert took["new"] < 0.6 * took["plain"]


def _timed(fn, clock):
    start = clock()
    fn()
    return clock() - start
