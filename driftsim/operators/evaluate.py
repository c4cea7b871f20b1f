"""Quality and latency figures."""

from pyspark.sql import DataFrame, functions as F

from driftsim.operators.ordering import positions


def prediction_error(predicted: DataFrame) -> DataFrame:
    """RMSE, MAE, the RMSE of the plain user mean, and the number of predictions."""
    miss = F.col("pred") - F.col("rating")
    base = F.col("mean") - F.col("rating")
    return predicted.agg(
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(base * base)).alias("rmse_mean"),
        F.count(F.lit(1)).alias("n"),
    )


def hit_join(clicked: DataFrame, recommended: DataFrame) -> DataFrame:
    """Distinct (user, item) that were both recommended and clicked."""
    keys = ["user_id", "item_id"]
    return clicked.select(*keys).distinct().join(recommended.select(*keys), keys, "left_semi")


def user_hits(clicked: DataFrame, recommended: DataFrame) -> DataFrame:
    """Distinct clicks, recommendations and hits of users with both a click and an answer.

    A null item stands for an answered but empty list.
    """
    keys = ["user_id", "item_id"]
    marks = clicked.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(
        recommended.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("r"))
    )
    per_item = marks.groupBy(*keys).agg(F.max("c").alias("c"), F.max("r").alias("r"))
    real = F.col("item_id").isNotNull()
    return (
        per_item.groupBy("user_id")
        .agg(
            F.sum("c").alias("clicks"),
            F.count_if(real & (F.col("r") == 1)).alias("recommended"),
            F.count_if((F.col("c") == 1) & (F.col("r") == 1)).alias("hits"),
            F.max("r").alias("answered"),
        )
        .filter((F.col("clicks") > 0) & (F.col("answered") == 1))
        .drop("answered")
    )


def ctr_recall(hits: DataFrame) -> DataFrame:
    """Mean click-through and recall over users."""
    ctr = F.when(F.col("recommended") > 0, F.col("hits") / F.col("recommended")).otherwise(F.lit(0.0))
    return hits.agg(
        F.avg(ctr).alias("ctr"),
        F.avg(F.col("hits") / F.col("clicks")).alias("recall"),
        F.count(F.lit(1)).alias("users"),
    )


def hit_totals(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.sum("hits").alias("relevant"),
        F.sum("recommended").alias("recommended"),
        F.count(F.lit(1)).alias("users"),
    )


def avg_view_similarity(neighbors: DataFrame, items: DataFrame) -> DataFrame:
    """Mean over all items of their mean neighbour similarity; no list counts 0."""
    per_item = neighbors.groupBy("item_id").agg(F.avg("sim").alias("mean"))
    return per_item.agg(F.sum("mean").alias("total")).select(
        (F.col("total") / items.agg(F.count(F.lit(1))).scalar()).alias("view_similarity")
    )


def latency_summary(metrics: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, minimum, percentiles and maximum of a value column.

    A percentile lies between two ranks. Values are numbered within their group, which
    splits a large group over tasks, and only the rows of these ranks are summed; no
    group is buffered.
    """
    shares = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    rows = metrics.select(by, F.col(value).alias("value")).filter("value is not null")
    placed = positions(rows, [F.col("value")], "place", (by,))
    sizes = rows.groupBy(by).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n")
    )
    zero_based = F.col("place") - 1

    def at(share):
        spot = (F.col("n") - 1) * F.lit(share)
        return F.sum(F.col("value") * F.greatest(F.lit(0.0), 1 - F.abs(zero_based - spot)))

    # A null group is a group like any other.
    counts = sizes.select(F.col(by).alias("group"), "n")
    ranks = placed.join(counts, F.col(by).eqNullSafe(F.col("group"))).groupBy("group").agg(
        *(at(share).alias(name) for name, share in shares.items())
    )
    return sizes.join(ranks, F.col(by).eqNullSafe(F.col("group"))).select(by, "mean", "min", *shares, "max")


def watch_items(batches: DataFrame, metrics: DataFrame, items: list[int]) -> DataFrame:
    """When the batches holding a watched item were processed.

    ``metrics`` has (batch, started, ended) in epoch seconds, in any number of phases.
    """
    watched = batches.filter(F.col("item_id").isin(items)).select("batch", "item_id").distinct()
    whole = metrics.groupBy("batch").agg(F.min("started").alias("started"), F.max("ended").alias("ended"))
    return watched.join(whole, "batch").select(
        "batch",
        "item_id",
        F.from_unixtime("started").alias("started"),
        F.from_unixtime("ended").alias("ended"),
    )
