"""Connected components by star rounds; each round is a written table, so lost executors cost one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def saved(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir (a temporary folder where that is unset), in folders by the columns by."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="datelode-")
    path, schema = f"{base.rstrip('/')}/{uuid.uuid4().hex}", df.schema
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root for each node of edges(a, b): root is the smallest node that can be reached."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = saved(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
