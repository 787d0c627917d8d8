"""Isolation forest trained and scored on Spark (Liu, Ting & Zhou, 2008).

Training data never passes through the driver or through one task:

1. **Sample.**  Each tree needs psi = min(256, n) rows.  A row is kept for the
   candidate pool when ``hash(id, seed)`` falls under p = min(1, 4*T*psi/n);
   each pooled row is offered to every tree with probability
   q = min(1, 2*psi/pool) using a second hash; per tree the psi rows with the
   smallest hash are kept (``row_number() <= psi``, planned as a partial
   WindowGroupLimit).  Deterministic for a seed, independent of the
   partitioning, and the shuffle is bounded by ~T*2*psi rows for any n.
2. **Grow.**  ``groupBy(tree).applyInPandas`` grows one tree per group of at
   most psi rows into a node table (tree, node, feature, threshold, left,
   right, size, path_len).  Height limit ceil(log2 psi).
3. **Score.**  The node table is bounded (T * (2*psi - 1) rows) and is
   broadcast; ``mapInPandas`` walks all trees for a batch of rows with numpy
   (one vectorised step per level).  score = -2^(-E[h]/c(psi)); the offset is
   the ``contamination`` quantile of the training scores (approximate
   quantile, bounded memory); decision = score - offset; label -1 if < 0.

Not bit-identical to other implementations (different random streams).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("path_len", T.DoubleType()),
])


def c_factor(n: int | float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


@dataclass
class ForestModel:
    nodes: DataFrame          # NODE_SCHEMA rows
    features: list[str]
    psi: int
    offset: float | None = None

    def meta(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, f) for i, f in enumerate(self.features)], "feature_idx int, feature string"
        ).withColumn("psi", F.lit(self.psi)).withColumn("offset", F.lit(self.offset).cast("double"))


def _grow_tree(pdf: pd.DataFrame, features: list[str], seed: int, height_limit: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = pdf[features].to_numpy(dtype=float)
    # Stable row order inside the group so the tree does not depend on how
    # Spark delivered the rows.
    X = X[np.argsort(pdf["_h"].to_numpy(), kind="stable")]
    rng = np.random.default_rng([seed, tree])
    rows: list[tuple] = []
    stack = [(0, np.arange(len(X)), 0)]
    next_id = 1
    while stack:
        node, idx, depth = stack.pop()
        n = len(idx)
        sub = X[idx]
        lo, hi = (sub.min(axis=0), sub.max(axis=0)) if n else (None, None)
        movable = np.flatnonzero(hi > lo) if n > 1 else np.array([], dtype=int)
        if depth >= height_limit or n <= 1 or movable.size == 0:
            rows.append((tree, node, -1, float("nan"), -1, -1, n, depth + c_factor(n)))
            continue
        f = int(movable[rng.integers(movable.size)])
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        left, right = next_id, next_id + 1
        next_id += 2
        rows.append((tree, node, f, thr, left, right, n, float("nan")))
        stack.append((right, idx[~go_left], depth + 1))
        stack.append((left, idx[go_left], depth + 1))
    return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])


def sample_for_trees(X: DataFrame, n_trees: int, psi: int, seed: int, n_rows: int, key: str = "id") -> DataFrame:
    """Rows assigned to trees (tree, _h, features...), <= psi per tree."""
    p = min(1.0, 4.0 * n_trees * psi / max(n_rows, 1))
    pool_size = max(1.0, p * n_rows)
    q = min(1.0, 2.0 * psi / pool_size)
    u1 = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    pooled = X.filter(u1 < p) if p < 1.0 else X
    exploded = pooled.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    h = F.xxhash64(F.col(key), F.col("tree"), F.lit(seed + 1))
    u2 = F.pmod(h, F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    offered = exploded.withColumn("_h", h).filter(u2 < q) if q < 1.0 else exploded.withColumn("_h", h)
    w = Window.partitionBy("tree").orderBy("_h", key)
    return offered.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi).drop("_rn")


def fit_isolation_forest(X: DataFrame, features: list[str] | None = None, n_trees: int = rules.FOREST_TREES,
                         max_samples: int = rules.FOREST_MAX_SAMPLES, seed: int = rules.FOREST_SEED,
                         key: str = "id") -> ForestModel:
    """Grow the forest; ``X`` holds ``key`` and double feature columns."""
    features = features or [c for c in X.columns if c not in (key, "timestamp", "pid", "user_name", "command")]
    n_rows = X.count()
    if n_rows == 0:
        raise ValueError("No data available for training")
    psi = min(max_samples, n_rows)
    height = max(1, math.ceil(math.log2(max(psi, 2))))
    sampled = sample_for_trees(X.select(key, *features), n_trees, psi, seed, n_rows, key)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grow_tree(pdf, features, seed, height)

    nodes = sampled.groupBy("tree").applyInPandas(grow, schema=NODE_SCHEMA)
    return ForestModel(nodes=nodes, features=features, psi=psi)


def _model_arrays(model: ForestModel) -> dict[str, np.ndarray]:
    """Node table -> dense arrays [tree, node] (bounded: T x (2 psi - 1))."""
    pdf = model.nodes.toPandas()
    n_trees = int(pdf["tree"].max()) + 1
    width = int(pdf["node"].max()) + 1
    # A node's entries stand at twice its number, its right and left child there and behind.  Both children of a leaf
    # are the leaf itself, so every row takes the tree's depth in steps, without asking which ones have arrived.
    feat = np.zeros((n_trees, 2 * width), dtype=np.intp)
    thr = np.full((n_trees, 2 * width), np.nan)
    kids = np.tile(np.repeat(2 * np.arange(width), 2), (n_trees, 1))
    plen = np.zeros((n_trees, 2 * width))
    pdf = pdf.sort_values(["tree", "node"])
    t, at = pdf["tree"].to_numpy(), 2 * pdf["node"].to_numpy().astype(np.intp)
    inner = pdf["feature"].to_numpy() >= 0
    plen[t, at] = np.nan_to_num(pdf["path_len"].to_numpy())
    t, at, pdf = t[inner], at[inner], pdf[inner]
    feat[t, at] = pdf["feature"].to_numpy()
    thr[t, at] = np.nan_to_num(pdf["threshold"].to_numpy())
    kids[t, at] = 2 * pdf["right"].to_numpy().astype(np.intp)
    kids[t, at + 1] = 2 * pdf["left"].to_numpy().astype(np.intp)
    return {"feat": feat, "thr": thr, "kids": kids, "plen": plen, "depth": _depths(kids)}


def _depths(kids: np.ndarray) -> np.ndarray:
    """Steps after which every path of a tree has ended."""
    depth = np.zeros(len(kids), dtype=int)
    for t, k in enumerate(kids):
        level = np.zeros(1, dtype=np.intp)
        while (level := np.concatenate([k[level], k[level + 1]])[np.tile(k[level] != level, 2)]).size:
            depth[t] += 1
    return depth


def _path_lengths(X: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    n_trees = m["feat"].shape[0]
    total = np.zeros(len(X))
    values, row = np.ascontiguousarray(X).ravel(), np.arange(len(X)) * X.shape[1]
    for feat, thr, kids, plen, depth in zip(m["feat"], m["thr"], m["kids"], m["plen"], m["depth"]):
        at = np.zeros(len(X), dtype=np.intp)
        for _ in range(depth):
            at = kids.take(at + (values.take(feat.take(at) + row) <= thr.take(at)))
        total += plen.take(at)
    return total / n_trees


def score_samples(X: DataFrame, model: ForestModel, out: str = "anomaly_score_raw",
                  inputs: list | None = None) -> DataFrame:
    """Append ``-2^(-E[h]/c(psi))`` (in [-1, 0]; lower = more anomalous).
    ``inputs`` are the columns of the model's features (default: the columns
    of that name).  Only these go to Python; the other columns stay in the JVM."""
    spark = X.sparkSession
    bc = spark.sparkContext.broadcast(_model_arrays(model))
    cpsi = c_factor(model.psi)

    def run(*cols: pd.Series) -> pd.Series:
        arr = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = _path_lengths(arr, bc.value) if len(arr) else np.zeros(0)
        return pd.Series(-np.power(2.0, -h / cpsi) if cpsi > 0 else -np.ones(len(arr)))

    score = F.pandas_udf(run, T.DoubleType())
    return X.withColumn(out, score(*(inputs or [F.col(f) for f in model.features])))


def fit_offset(scored: DataFrame, contamination: float = rules.FOREST_CONTAMINATION,
               col: str = "anomaly_score_raw", accuracy: int = 100_000) -> float:
    """``contamination`` quantile of the training scores (a single number)."""
    return float(scored.agg(F.percentile_approx(col, contamination, accuracy)).first()[0])


def score_anomalies(X: DataFrame, model: ForestModel, inputs: list | None = None) -> DataFrame:
    """anomaly_score = raw - offset; is_anomaly = -1 if < 0 else 1;
    anomaly_risk = 10 - half-even(10 * score)."""
    return judge_scores(score_samples(X, model, inputs=inputs), model.offset)


def judge_scores(raw: DataFrame, offset: float | None) -> DataFrame:
    """The same on rows that hold ``anomaly_score_raw``."""
    from vigil.functions.scalars import anomaly_risk

    s = F.col("anomaly_score_raw") - F.lit(offset if offset is not None else 0.0)
    return raw.withColumn("anomaly_score", s).withColumn(
        "is_anomaly", F.when(s < 0, -1).otherwise(1)
    ).withColumn("anomaly_risk", anomaly_risk(F.col("anomaly_score")))


def grow(X: DataFrame, features: list[str] | None = None, **kw) -> ForestModel:
    """Fit the trees; the node table (at most trees x (2 psi - 1) rows) is
    brought to the driver once, for every later scoring pass."""
    model = fit_isolation_forest(X, features, **kw)
    model.nodes = model.nodes.sparkSession.createDataFrame(model.nodes.toPandas(), NODE_SCHEMA)
    return model


def train(X: DataFrame, features: list[str] | None = None, **kw) -> ForestModel:
    """Fit the trees, then the offset from the training scores."""
    model = grow(X, features, **kw)
    model.offset = fit_offset(score_samples(X, model))
    return model


# -- persistence (M8) -----------------------------------------------------------------

def save_model(model: ForestModel, path: str) -> None:
    spark = model.nodes.sparkSession
    model.nodes.write.mode("overwrite").parquet(f"{path}/forest_nodes")
    model.meta(spark).write.mode("overwrite").parquet(f"{path}/forest_meta")


def load_model(spark: SparkSession, path: str) -> ForestModel:
    nodes = spark.read.parquet(f"{path}/forest_nodes")
    meta = spark.read.parquet(f"{path}/forest_meta").orderBy("feature_idx").collect()
    return ForestModel(nodes=nodes, features=[r["feature"] for r in meta], psi=int(meta[0]["psi"]),
                       offset=meta[0]["offset"])


def model_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/forest_meta")
    return p.getFileSystem(conf).exists(p)


def load_or_fit(spark: SparkSession, X: DataFrame, path: str | None, features: list[str] | None = None,
                **kw) -> ForestModel:
    """Reuse the stored model when one exists, else fit (and store) one."""
    if path and model_exists(spark, path):
        return load_model(spark, path)
    model = train(X, features, **kw)
    if path:
        save_model(model, path)
    return model
