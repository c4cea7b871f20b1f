"""Cleaning, ordering and batching of raw ratings."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftsim.operators.ordering import GROUP_ROWS, largest_group, positions


def latest_rating(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the newest, and the higher rating among equal times.

    An aggregate, so repeats collapse before the shuffle and no repeated key can grow hot.
    """
    newest = F.max(F.struct("ts", "rating"))
    return (
        ratings.groupBy("user_id", "item_id")
        .agg(newest.alias("last"))
        .select("user_id", "item_id", F.col("last.rating").alias("rating"), F.col("last.ts").alias("ts"))
    )


def timestep(clean: DataFrame, largest: int | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """The logical clock 1..n of every user, by time and then item."""
    return positions(
        clean, [F.col("ts"), F.col("item_id")], "timestep", ("user_id",), largest, limit, unique=True
    ).select("user_id", "item_id", "rating", "timestep")


def user_ratings(ratings: DataFrame, largest: int | None = None, limit: int = GROUP_ROWS) -> DataFrame:
    """Cleaned ratings with their timestep.

    With every user below ``limit`` rows the table is hashed by user once, and
    de-duplication, clock and user statistics all reuse that partitioning.
    """
    if largest is None:
        largest = largest_group(ratings, ["user_id"])
    if largest <= limit:
        ratings = ratings.repartition("user_id")
    return timestep(latest_rating(ratings), largest, limit)


def sort_by_time(df: DataFrame, ties: list[str]) -> DataFrame:
    """Global order by timestamp; a range partitioning, not a single task."""
    return df.orderBy("ts", *ties)


def split_head_tail(
    ratings: DataFrame, tail: int, order=("ts", "user_id", "item_id"), limit: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """All rows but the last ``tail`` in order, and those last rows.

    Only the border row is searched for, by a top-``tail`` scan that Spark keeps to
    ``tail`` rows per task. The tables themselves are then plain filters of the scan.
    """
    names = [*order, *(c for c in ratings.columns if c not in order)]
    border = ratings.orderBy(*(F.col(c).desc() for c in names)).limit(tail).orderBy(*names).first()
    if border is None:
        return ratings, ratings
    at = F.lit(True)
    after = F.lit(False)
    for name in names:
        after = after | (at & _beyond(name, border[name]))
        at = at & F.col(name).eqNullSafe(F.lit(border[name]))
    # Rows equal to the border row are interchangeable; only their number counts.
    # The first scalar bound lets the scan skip row groups.
    first, bound = names[0], border[names[0]]
    head, test = ratings.filter(~after & ~at), ratings.filter(after)
    if bound is not None:
        head = head.filter((F.col(first) <= F.lit(bound)) | F.col(first).isNull())
        test = test.filter(F.col(first) >= F.lit(bound))
    equal = ratings.filter(at)
    n_equal, n_after = equal.count(), test.count()
    in_test = tail - n_after
    if n_equal <= in_test:
        return head, test.unionByName(equal)
    placed = positions(equal, [F.col(names[0])], "__pos", (), n_equal, limit)
    kept = F.col("__pos") <= n_equal - in_test
    return (
        head.unionByName(placed.filter(kept).drop("__pos")),
        test.unionByName(placed.filter(~kept).drop("__pos")),
    )


def _beyond(name: str, border) -> Column:
    """Whether a value comes after the border's, nulls first as in an ascending sort."""
    if border is None:
        return F.col(name).isNotNull()
    return F.coalesce(F.col(name) > F.lit(border), F.lit(False))


def assign_microbatches(
    rows: DataFrame, size: int, order: list[Column], limit: int = GROUP_ROWS
) -> DataFrame:
    """Cut into floor(n/size) slices of equal length, the first n mod slices one longer.

    Adds ``arrival`` (1..n) and ``batch`` (from 1).
    """
    total = largest_group(rows, ())
    slices = max(1, total // size)
    short, longer = divmod(total, slices)
    placed = positions(rows, order, "arrival", (), total, limit)
    zero_based = F.col("arrival") - 1
    edge = longer * (short + 1)
    batch = F.when(zero_based < edge, F.floor(zero_based / (short + 1))).otherwise(
        longer + F.floor((zero_based - edge) / F.lit(max(short, 1)))
    )
    return placed.withColumn("batch", (batch + 1).cast("long"))


def assign_count_batches(
    rows: DataFrame, size: int, order: list[Column], limit: int = GROUP_ROWS
) -> DataFrame:
    """Batch number of every row, flushed before each ``size``-th row.

    The open last batch is dropped: it is never applied.
    """
    total = largest_group(rows, ())
    placed = positions(rows, order, "arrival", (), total, limit)
    batch = F.floor(F.col("arrival") / F.lit(size)).cast("long")
    return placed.withColumn("batch", batch).filter(F.col("batch") < total // size)


def batch_timestep(batched: DataFrame) -> DataFrame:
    """Position of an observation among those of its user in the same batch."""
    window = W.partitionBy("batch", "user_id").orderBy("arrival")
    return batched.withColumn("position", F.row_number().over(window).cast("long"))


def last_in_batch(positioned: DataFrame) -> DataFrame:
    """One row per (batch, user, item): the last to arrive."""
    rest = [c for c in positioned.columns if c not in ("batch", "user_id", "item_id", "arrival")]
    return (
        positioned.groupBy("batch", "user_id", "item_id")
        .agg(F.max(F.struct("arrival", *rest)).alias("last"))
        .select("batch", "user_id", "item_id", "last.*")
    )
