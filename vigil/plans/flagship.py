"""Process intelligence (M9/M10): features -> forest -> scores -> network context.

    process, network --fetch_window--> detectors (C2, exfil, port scan)
    process --M1 preprocess--> M2 behaviour --M3 encode--> M4 scale --> M5 matrix
    matrix --stored or new forest--> scores, written once (anomaly_score, is_anomaly, anomaly_risk)
    scored process --bucket join--> per-(5 min, source) network stats = merged

Everything stays distributed: the only driver-side values are the model
tables (bounded by trees x nodes, features) and one quantile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import rules
from vigil.operators import aggregates as A
from vigil.operators import clean as C
from vigil.operators import detect as D
from vigil.operators import features as M
from vigil.operators import forest as FR
from vigil.operators import joins as J
from vigil.session import cut_lineage


@dataclass
class Intelligence:
    process: DataFrame      # scored process rows (+ features)
    network: DataFrame      # network rows with c2/exfil/scan flags
    merged: DataFrame       # process x per-bucket network stats
    model: FR.ForestModel


def retrain(process: DataFrame, hours: int | None = rules.TRAIN_HOURS, model_path: str | None = None,
            refit_preprocessing: bool = False) -> FR.ForestModel:
    """M9: window -> M1..M5 -> forest.  Raises on an empty window.  The
    stored vocabulary and scaler are reused (never refit, as in the source)
    unless ``refit_preprocessing``; the forest itself is always refit."""
    p = C.fetch_window(process, hours) if hours else process
    spark = process.sparkSession
    vocab = scaler = None
    if model_path and not refit_preprocessing:
        vocab, scaler = M.load_preprocessing(spark, model_path)
    _, matrix, vocab, scaler = M.prepare_model_input(p, vocab, scaler)
    model = FR.train(matrix, [c for c in rules.MODEL_FEATURES if c in matrix.columns])
    if model_path:
        FR.save_model(model, model_path)
        M.save_preprocessing(vocab, scaler, model_path)
    return model


def process_intelligence(process: DataFrame, network: DataFrame, hours: int | None = None,
                         model_path: str | None = None) -> Intelligence:
    """M10: the whole chain.  ``hours=None`` analyses every row."""
    if hours:
        process = C.fetch_window(process, hours)
        network = C.fetch_window(network, hours)
    net = D.detect_network_threats(network)
    spark = process.sparkSession
    vocab, scaler = M.load_preprocessing(spark, model_path) if model_path else (None, None)
    feats, matrix, vocab, scaler = M.prepare_model_input(process, vocab, scaler)
    stored = bool(model_path) and FR.model_exists(spark, model_path)
    model = (FR.load_model(spark, model_path) if stored
             else FR.grow(matrix, [c for c in rules.MODEL_FEATURES if c in matrix.columns]))
    # Encode, scale and score in one pass; the written scores give the offset and everything after it.
    inputs = M.feature_columns(feats, model.features)
    raw = cut_lineage(FR.score_samples(feats, model, inputs=[inputs[f] for f in model.features]), "scored")
    if model.offset is None:
        model.offset = FR.fit_offset(raw)
    if model_path and not stored:
        FR.save_model(model, model_path)
    if model_path:
        M.save_preprocessing(vocab, scaler, model_path)
    scored = FR.judge_scores(raw, model.offset).drop("anomaly_score_raw")
    merged = J.network_behavior_join(scored, A.network_window_stats(net))
    return Intelligence(process=scored, network=net, merged=merged, model=model)


def top_anomalies(scored: DataFrame, n: int = rules.TOP_ANOMALIES) -> DataFrame:
    """Most anomalous ``n`` rows among the anomalies (lowest score first)."""
    return scored.filter(F.col("is_anomaly") == -1).orderBy(F.col("anomaly_score"), F.col("id")).limit(n)


def related_activity(intel: Intelligence, n: int = rules.TOP_ANOMALIES) -> DataFrame:
    top = top_anomalies(intel.process, n)
    rel = J.related_activity(top, intel.merged)
    return rel.select("id", "pid", "timestamp", "command", "src_ip", "n_dst_ports", "n_dst_ips", "bytes_sent")
