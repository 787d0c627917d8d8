"""Clustering of network sources (README-level capability, M11).

Per-source behaviour is aggregated on Spark (partial aggregates), then
clustered with Spark ML k-means; the model state is k centroids.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_FEATURES = ["events", "n_dst_ports", "n_dst_ips", "bytes_sent", "syn_share"]


def source_profiles(network: DataFrame) -> DataFrame:
    return (
        network.filter(F.col("src_ip").isNotNull())
        .groupBy("src_ip")
        .agg(
            F.count(F.lit(1)).cast("double").alias("events"),
            F.countDistinct("dst_port").cast("double").alias("n_dst_ports"),
            F.countDistinct("dst_ip").cast("double").alias("n_dst_ips"),
            F.sum("bytes_sent").cast("double").alias("bytes_sent"),
            (F.count_if(F.col("flags") == "S") / F.count(F.lit(1))).alias("syn_share"),
        )
    )


def kmeans_sources(network: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    prof = source_profiles(network)
    vec = VectorAssembler(inputCols=SOURCE_FEATURES, outputCol="raw").transform(prof)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec).transform(vec)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).select("src_ip", *SOURCE_FEATURES, "cluster")
