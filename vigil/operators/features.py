"""Feature engineering for the process model (M1-M5) and row helpers.

Scale notes
-----------
* ``fit_vocab`` assigns dense codes 0..n-1 in label order without sending a
  feature's labels to one task: labels are range-partitioned and written
  once, per-range counts (a tiny table) give each range its offset, and
  the code is offset + row number inside the range.
* ``fit_scaler`` is one global algebraic aggregate (partial per partition).
* ``behavior_features`` uses the ranged rolling window and a pre-aggregated
  frequency join (see ``windows``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import rules
from vigil.functions import scalars as S
from vigil.operators import windows as W
from vigil.session import cut_lineage


# M1 ----------------------------------------------------------------------------
def preprocess_process(process: DataFrame) -> DataFrame:
    """hour, minute, day_of_week (Monday=0), time_used_seconds, mem_ratio."""
    return process.withColumns({
        "hour": F.hour("timestamp"),
        "minute": F.minute("timestamp"),
        "day_of_week": S.day_of_week(F.col("timestamp")),
        "time_used_seconds": S.time_used_seconds(F.col("time_used")),
        "mem_ratio": S.mem_ratio(F.col("res"), F.col("virt")),
    })


# M2 ----------------------------------------------------------------------------
def behavior_features(process: DataFrame, ranged: bool = True) -> DataFrame:
    """Rolling mean/std (last 5 rows per user) of CPU, memory and run time,
    plus the frequency of the command hash."""
    x = W.rolling_stats(process, ["user_name"], list(rules.ROLLING_FEATURES), rules.ROLLING_ROWS, ranged=ranged)
    return W.value_frequency(x, "hashed_command", "command_frequency")


# M3 ----------------------------------------------------------------------------
def dense_codes(labels: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label) distinct rows -> code = rank of label within group, 0-based.

    Labels are range-partitioned and numbered inside each range; a range's
    offset is the number of labels of the same group in earlier ranges.  The
    ranges come from sampling, so the labels are written once with their
    range and every later pass reads that table: all of them see the same
    ranges.  No window sees more than one range, or one row per range."""
    r = cut_lineage(labels.repartitionByRange(group, label).withColumn("_part", F.spark_partition_id()), "labels")
    sizes = r.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    r = r.withColumn("_pos", F.row_number().over(Window.partitionBy(group, "_part").orderBy(label)))
    return r.join(offsets, [group, "_part"]).select(
        group, label, (F.col("_off") + F.col("_pos") - 1).cast("int").alias("code")
    )


def fit_vocab(process: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long vocabulary table (feature, label, code): sorted distinct labels of
    each categorical column numbered 0..n-1."""
    cols = cols or list(rules.CATEGORICAL_FEATURES)
    parts = [
        process.select(F.lit(c).alias("feature"), F.col(c).cast("string").alias("label")).filter(
            F.col("label").isNotNull())
        for c in cols
    ]
    labels = reduce(DataFrame.unionByName, parts).distinct()
    return cut_lineage(dense_codes(labels, "feature", "label"), "vocab")


#: Vocabulary rows up to which one column's vocabulary is broadcast.
BROADCAST_LABELS = 500_000


def encode(df: DataFrame, vocab: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``<col>_encoded`` = vocabulary code, -1 for labels not in the vocabulary.

    One join per column with that column's part of the vocabulary.  ``vocab``
    should be a written table (``fit_vocab`` returns one); its sizes are
    counted first: a small part is broadcast, so rows are not shuffled, a
    larger one is joined by an exchange whose hot labels adaptive execution
    can split."""
    cols = cols or [c for c in rules.CATEGORICAL_FEATURES if c in df.columns]
    sizes = {r["feature"]: r["count"] for r in vocab.groupBy("feature").count().collect()}  # one row per column
    for c in cols:
        v = vocab.filter(F.col("feature") == c).select(F.col("label").alias(c), F.col("code").alias(f"{c}_encoded"))
        v = F.broadcast(v) if sizes.get(c, 0) <= BROADCAST_LABELS else v
        df = df.join(v, c, "left").withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(-1)))
    return df


# M4 ----------------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, mean, scale): population std, zero std -> 1."""
    cols = cols or list(rules.SCALED_FEATURES)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', m_{c}, s_{c}" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std)")
    return long.select(
        "feature", "mean",
        F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0)).otherwise(F.col("std")).alias("scale"),
    )


def scale(df: DataFrame, scaler: DataFrame, suffix: str = "_scaled") -> DataFrame:
    """Add ``<col><suffix>`` = (col - mean) / scale.  The scaler table has
    one row per feature (bounded), so it is read on the driver."""
    params = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items() if c in df.columns
    })


# M5 ----------------------------------------------------------------------------
def assemble(df: DataFrame, features: list[str] | None = None, scaled: bool = True) -> DataFrame:
    """Model matrix: the fixed feature list (scaled columns where present),
    NULL/NaN -> 0.0, as double columns named after the features."""
    cols = [c.alias(f) for f, c in feature_columns(df, features, scaled).items()]
    return df.select(*[c for c in ("id", "timestamp", "pid", "user_name", "command") if c in df.columns], *cols)


def feature_columns(df: DataFrame, features: list[str] | None = None, scaled: bool = True) -> dict:
    """feature name -> model input expression (scaled column where present,
    NULL/NaN -> 0.0) for the features ``df`` can provide."""
    feats = features or list(rules.MODEL_FEATURES)
    out = {}
    for f in feats:
        src = f"{f}_scaled" if scaled and f"{f}_scaled" in df.columns else f
        if src in df.columns:
            v = F.col(src).cast("double")
            out[f] = F.when(F.isnan(v) | v.isNull(), F.lit(0.0)).otherwise(v)
    return out


def prepare_model_input(process: DataFrame, vocab: DataFrame | None = None,
                        scaler: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """M1 -> M2 -> M3 -> M4: returns (features frame, assembled, vocab, scaler).

    Only the behaviour features are written: vocabulary, scaler, sampling and
    scoring read that table, and the codes and scaled values are expressions
    on top of it (broadcast look-ups and arithmetic)."""
    feats = cut_lineage(behavior_features(preprocess_process(process)), "features")
    vocab = vocab if vocab is not None else fit_vocab(feats)
    scaler = scaler if scaler is not None else fit_scaler(feats)
    x = scale(encode(feats, vocab), scaler)
    return x, assemble(x), vocab, scaler


# -- row helpers used by registered queries -------------------------------------------

def high_risk_detail(process: DataFrame) -> DataFrame:
    """Which high-risk literals each command contains (one row per hit):
    the fixed pattern list is a literal array filtered per row and exploded,
    so no join is needed."""
    pats = F.array(*[F.lit(p) for p in dict.fromkeys(rules.HIGH_RISK_COMMANDS)])
    hits = F.filter(pats, lambda p: F.coalesce(F.col("command").contains(p), F.lit(False)))
    return process.select("id", "command", F.explode(hits).alias("pattern"))


def process_info_columns(process: DataFrame) -> DataFrame:
    info = S.process_info(F.col("command"))
    return process.select("id", "command", info.alias("i")).select(
        "id", "command", F.col("i.process").alias("process"), F.col("i.description").alias("description"),
        F.col("i.risk_level").alias("risk_level"),
        F.col("i.sources")["ProcessLibrary"].alias("url_processlibrary"),
        F.col("i.sources")["File.net"].alias("url_filenet"),
    )


def command_scalars(process: DataFrame) -> DataFrame:
    # Memory text as `top` prints it: zombie rows in MiB, running rows in GiB.
    suffix = F.when(F.col("s") == "Z", "m").when(F.col("s") == "R", "g").otherwise("")
    mem_text = F.concat((F.col("res") + 1).cast("string"), suffix)
    return process.select(
        "id", "command",
        S.hash_command(F.col("command")).alias("hash_command"),
        S.truncate_command(F.col("command")).alias("command_short"),
        S.cpu_mem_ratio(F.col("cpu"), F.col("memory")).alias("cpu_mem_ratio"),
        mem_text.alias("mem_text"),
        S.parse_mem_unit(mem_text).alias("mem_kib"),
    )


def rule_risk(t) -> tuple[DataFrame, DataFrame]:
    """Process rows with the rule threat score as risk, and the per-bucket
    network stats: inputs of the rule-based matrices."""
    from vigil.operators import aggregates as A

    return t.process.withColumn("threat_score", S.threat_score(t.process)), A.network_window_stats(t.network)


#: Columns that can size a marker in the correlation view, best first.
SIZE_CANDIDATES = ["bytes_sent", "cpu", "memory", "time_used_seconds"]


def size_column(df: DataFrame) -> str | None:
    """The best numeric candidate the frame has."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    ranked = sorted(numeric.intersection(SIZE_CANDIDATES), key=SIZE_CANDIDATES.index)
    return ranked[0] if ranked else None


# M8: persisted preprocessing (fit once, never refit) ----------------------------------

def save_preprocessing(vocab: DataFrame, scaler: DataFrame, path: str) -> None:
    """Store vocabulary and scaler next to the forest (first fit only)."""
    from vigil.sources.files import path_exists

    spark = vocab.sparkSession
    if not path_exists(spark, f"{path}/vocab"):
        vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if not path_exists(spark, f"{path}/scaler"):
        scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def load_preprocessing(spark, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    from vigil.sources.files import path_exists

    vocab = spark.read.parquet(f"{path}/vocab") if path_exists(spark, f"{path}/vocab") else None
    scaler = spark.read.parquet(f"{path}/scaler") if path_exists(spark, f"{path}/scaler") else None
    return vocab, scaler
