"""Ratings and votes as views of the star-schema tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def event_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Each event rates item ``props.k``."""
    return table(spark, folder, "events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (1 + F.floor("value") % 5).cast("double").alias("rating"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
    )


def order_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Each order line rates its part on behalf of the customer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (1 + F.floor("l_quantity") % 5).cast("double").alias("rating"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )


def event_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Each event is a vote on ``props.k``: errors against, views neutral, the rest in favour."""
    vote = F.when(F.col("event_type") == "error", -1.0).when(F.col("event_type") == "view", 0.0).otherwise(1.0)
    return table(spark, folder, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("electee_id"),
        F.col("user_id").alias("voter_id"),
        vote.alias("vote"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
    )
