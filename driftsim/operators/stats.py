"""Sums per user and per item."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftsim.functions.scoring import decay
from driftsim.operators.ordering import GROUP_ROWS, positions
from driftsim.session import durable

PROFILE_ROWS = 4096


def user_stats(profile: DataFrame) -> DataFrame:
    """Per user: last timestep ``t``, mean rating, and ``e``, how far the last rating moved the mean."""
    n, total = F.count(F.lit(1)), F.sum("rating")
    last = F.max_by("rating", "timestep")
    before = F.when(n > 1, (total - last) / (n - 1)).otherwise(F.lit(0.0))
    mean = F.avg("rating")
    return profile.groupBy("user_id").agg(
        F.max("timestep").alias("t"), mean.alias("avg_rating"), (mean - before).alias("e")
    )


def weighted_ratings(
    profile: DataFrame, alpha: float, largest: int | None = None, limit: int = GROUP_ROWS
) -> DataFrame:
    """Every rating with its decay-weighted deviation ``x`` from the user mean, and ``w*e``.

    If no user is known to exceed ``limit`` rows the statistics come from a window over
    the user, in the pass that already holds the user's rows; otherwise they are
    aggregated first and joined.
    """
    if largest is not None and largest <= limit:
        user = W.partitionBy("user_id")
        n, total = F.count(F.lit(1)).over(user), F.sum("rating").over(user)
        last = F.max_by("rating", "timestep").over(user)
        rows = profile.select(
            "*", n.alias("n"), total.alias("total"), last.alias("last"), F.max("timestep").over(user).alias("t")
        )
        before = F.when(F.col("n") > 1, (F.col("total") - F.col("last")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
        rows = rows.withColumn("avg_rating", F.col("total") / F.col("n")).withColumn(
            "e", F.col("avg_rating") - before
        )
    else:
        # Written, so that a hot user is a skewed join of two tables, which Spark can split.
        rows = profile.join(durable(user_stats(profile)), "user_id")
    return rows.withColumn("w", decay("t", "timestep", alpha)).select(
        "user_id",
        "item_id",
        (F.col("w") * (F.col("rating") - F.col("avg_rating"))).alias("x"),
        (F.col("w") * F.col("e")).alias("we"),
    )


def item_info(weighted: DataFrame) -> DataFrame:
    """Per item: L (drift term), n (popularity) and Q (squared norm)."""
    return weighted.groupBy("item_id").agg(
        F.sum(F.col("x") * F.col("we")).alias("l"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x") * F.col("x")).alias("q"),
    )


def item_popularity(profile: DataFrame) -> DataFrame:
    return profile.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def entity_counts(profile: DataFrame) -> DataFrame:
    """Number of distinct items and users."""
    items = profile.select("item_id").distinct().agg(F.count(F.lit(1)).alias("items"))
    users = profile.select("user_id").distinct().agg(F.count(F.lit(1)).alias("users"))
    return items.select("items", users.scalar().alias("users"))


def user_profiles(profile: DataFrame, segment_rows: int = PROFILE_ROWS) -> DataFrame:
    """The ratings of each user as arrays in clock order.

    A profile longer than ``segment_rows`` continues in further segments, so no
    array grows with the user.
    """
    segment = F.floor((F.col("timestep") - 1) / F.lit(segment_rows)).alias("segment")
    return profile.groupBy("user_id", segment).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("timestep", "item_id", "rating"))),
            lambda x: F.struct(x.item_id.alias("item_id"), x.rating.alias("rating"), x.timestep.alias("timestep")),
        ).alias("profile")
    )


def item_profiles(
    profile: DataFrame, segment_rows: int = PROFILE_ROWS, limit: int = GROUP_ROWS
) -> DataFrame:
    """The ratings of each item as arrays in user order, segmented like ``user_profiles``."""
    placed = positions(profile, [F.col("user_id")], "__pos", ("item_id",), limit=limit, unique=True)
    segment = F.floor((F.col("__pos") - 1) / F.lit(segment_rows)).alias("segment")
    return placed.groupBy("item_id", segment).agg(
        F.sort_array(F.collect_list(F.struct("user_id", "rating", "timestep"))).alias("profile")
    )


def explode_profiles(profiles: DataFrame) -> DataFrame:
    """One row per rating out of nested user profiles; empty profiles vanish."""
    return profiles.filter(F.size("profile") > 0).select("user_id", F.inline("profile"))


def running_user_mean(profile: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge stored and fresh ratings of the fresh users.

    ``rubar`` is the merged mean, ``e`` its change, ``t`` the clock after the batch and
    ``n_old`` the clock before it.
    """
    old = (
        profile.join(fresh.select("user_id").distinct(), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.sum("rating").alias("s_old"), F.count(F.lit(1)).alias("n_old"))
    )
    return merged_means(old, fresh)


def merged_means(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The same, from the sums (user_id, s_old, n_old) of the stored ratings."""
    new = fresh.groupBy("user_id").agg(F.sum("rating").alias("s_new"), F.count(F.lit(1)).alias("n_new"))
    s_old, n_old = F.coalesce("s_old", F.lit(0.0)), F.coalesce("n_old", F.lit(0))
    rubar = (s_old + F.col("s_new")) / (n_old + F.col("n_new"))
    old_mean = F.when(n_old > 0, s_old / n_old).otherwise(F.lit(0.0))
    return new.join(old, "user_id", "left").select(
        "user_id",
        n_old.alias("n_old"),
        (n_old + F.col("n_new")).alias("t"),
        rubar.alias("rubar"),
        (rubar - old_mean).alias("e"),
    )


def profile_parts(profile: DataFrame, asked: Column) -> DataFrame:
    """Per user the sum ``s_old`` and number ``n_old`` of all ratings, and in ``some`` those that are ``asked`` for.

    One pass, summed before the shuffle: however long a profile is, what comes out of it
    is bounded by the items asked for.
    """
    entry = F.when(asked, F.struct("item_id", "rating", "timestep"))
    return profile.groupBy("user_id").agg(
        F.sum("rating").alias("s_old"), F.count(F.lit(1)).alias("n_old"), F.collect_list(entry).alias("some")
    )


def ratings_profile(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """Time range, largest id, distinct ids and row count of a raw table."""
    items = rows.select(item).distinct().agg(F.count(F.lit(1)).alias("items"))
    return rows.agg(
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.max(item).alias("max_id"),
        F.count(F.lit(1)).alias("rows"),
    ).select("*", items.scalar().alias("items"))


def default_neighbors(new_items: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """A new item starts with the k most popular other items at similarity 0."""
    top = popular.orderBy(F.desc("n"), "item_id").limit(k + 1)
    ids = top.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "item_id"))), lambda x: x.item_id
        )
    )
    others = F.slice(F.filter("top", lambda i: i != F.col("item_id")), 1, k)
    return (
        new_items.select("item_id", ids.scalar().alias("top"))
        .select("item_id", F.posexplode(others).alias("rank", "neighbor_id"))
        .select("item_id", "neighbor_id", F.lit(0.0).alias("sim"), (F.col("rank") + 1).alias("rank"))
    )


def top_popular(info: DataFrame, p: int) -> DataFrame:
    """The p items with most ratings."""
    return info.select("item_id", "n").orderBy(F.desc("n"), "item_id").limit(p)


def pair_space(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Size of the dense pair table without building it.

    Per item i: pairs (i, j) with j > i, how many of them are stored, and how many
    are the implied zero rows.
    """
    ranked = positions(items.select("item_id").distinct(), [F.col("item_id").desc()], "after", unique=True)
    stored = pairs.groupBy(F.col("item_i").alias("item_id")).agg(F.count(F.lit(1)).alias("stored"))
    dense = F.col("after") - 1
    have = F.coalesce("stored", F.lit(0))
    return ranked.join(stored, "item_id", "left").select(
        "item_id", dense.alias("dense_pairs"), have.alias("stored_pairs"), (dense - have).alias("zero_pairs")
    )


def new_item_pairs(known: DataFrame, new_items: DataFrame) -> DataFrame:
    """Zero rows every new item adds to the dense pair table, split by which end it takes.

    Counts positions in the merged item order instead of building the rows. Pairs of
    two new items are counted at their smaller id.
    """
    both = known.select("item_id", F.lit(0).alias("is_new")).unionByName(
        new_items.select("item_id", F.lit(1).alias("is_new"))
    )
    merged = both.groupBy("item_id").agg(F.min("is_new").alias("is_new"))
    total = merged.agg(F.count(F.lit(1))).scalar()
    placed = positions(merged, [F.col("item_id")], "pos", unique=True)
    fresh = placed.filter(F.col("is_new") == 1)
    placed = positions(fresh, [F.col("item_id")], "new_pos", unique=True)
    return placed.select(
        "item_id",
        (total - F.col("pos")).alias("as_smaller"),
        (F.col("pos") - F.col("new_pos")).alias("as_larger"),
    )
