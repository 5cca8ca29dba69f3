"""Integer layers derived from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-parallel rectangles, many on top of each other: pk, attribute, box."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "o_orderkey as pk", "o_orderpriority as attribute", "(o_orderkey * 7919) % 1000 as xmin", "(o_orderkey * 104729) % 1000 as ymin",
        "(o_orderkey * 7919) % 1000 + 1 + o_custkey % 7 as xmax", "(o_orderkey * 104729) % 1000 + 1 + o_orderkey % 5 as ymax",
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares on a regular lattice."""
    x, y = "p_partkey % 100 * 40", "p_partkey div 100 * 40"
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as pk", "p_brand as attribute", f"{x} as xmin", f"{y} as ymin", f"{x} + p_size as xmax", f"{y} + p_size as ymax")


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger rectangles that overlap in part: pk, attribute (nation), box."""
    x, y = "(s_suppkey * 37) % 200", "(s_suppkey * 53) % 150"
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as pk", "s_nationkey as attribute", f"{x} as xmin", f"{y} as ymin", f"{x} + 5 + s_suppkey % 17 as xmax", f"{y} + 4 + s_nationkey % 11 as ymax")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as pk", "cast(floor(1000 * cast(embedding[0] as double)) as bigint) as x", "cast(floor(1000 * cast(embedding[1] as double)) as bigint) as y")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pk (user), ts, event_id, x (minutes since the start of 2024), y."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as pk", "ts", "event_id", "cast(timestampdiff(MINUTE, timestamp_ntz '2024-01-01 00:00:00', ts) as double) as x", "floor(value) * 1.0D as y")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each user: pk, pts."""
    p = F.struct("ts", "event_id", F.struct("x", "y").alias("p"))
    return track_points(spark, sf_dir).groupBy("pk").agg(F.transform(F.sort_array(F.collect_list(p)), lambda e: e["p"]).alias("pts"))


PARCELS = "(select o_orderkey as pk, o_orderpriority as attribute, (o_orderkey * 7919) % 1000 as xmin, (o_orderkey * 104729) % 1000 as ymin, (o_orderkey * 7919) % 1000 + 1 + o_custkey % 7 as xmax, (o_orderkey * 104729) % 1000 + 1 + o_orderkey % 5 as ymax from orders)"
PARTS = "(select p_partkey as pk, p_brand as attribute, p_partkey % 100 * 40 as xmin, p_partkey // 100 * 40 as ymin, p_partkey % 100 * 40 + p_size as xmax, p_partkey // 100 * 40 + p_size as ymax from part)"
PLOTS = "(select s_suppkey as pk, s_nationkey as attribute, (s_suppkey * 37) % 200 as xmin, (s_suppkey * 53) % 150 as ymin, (s_suppkey * 37) % 200 + 5 + s_suppkey % 17 as xmax, (s_suppkey * 53) % 150 + 4 + s_nationkey % 11 as ymax from supplier)"
POINTS = "(select vec_id as pk, floor(1000 * embedding[1]::double)::bigint as x, floor(1000 * embedding[2]::double)::bigint as y from embeddings)"
TRACKS = "(select user_id as pk, row_number() over (partition by user_id order by ts, event_id) as n, date_diff('minute', timestamp '2024-01-01', ts)::double as x, floor(value)::double as y from events)"
