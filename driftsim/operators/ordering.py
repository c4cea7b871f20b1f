"""Exact row positions, over a whole table or within keys of any size.

A plain ``row_number`` puts each group in one task, which is right only while the
groups are known to fit. Group sizes are therefore counted first. Beyond the limit
the rows are range-partitioned instead: each task numbers its own slice and the
slices are chained by their row counts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftsim.session import durable

GROUP_ROWS = 1_000_000
_COPY, _SEQ = "__copy", "__seq"


def largest_group(df: DataFrame, keys) -> int:
    """Row count of the largest group (of the whole table without keys)."""
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return sizes.agg(F.max("count")).first()[0] or 0


@dataclass(frozen=True)
class GroupSizes:
    """How large the groups of a table are: the largest, the sum of squares, and all rows."""

    largest: int
    squares: float
    rows: int = 0


def group_sizes(df: DataFrame, keys) -> GroupSizes:
    sizes = df.groupBy(*keys).count()
    square = F.col("count").cast("double") * F.col("count")
    row = sizes.agg(F.max("count"), F.sum(square), F.sum("count")).first()
    return GroupSizes(row[0] or 0, row[1] or 0.0, row[2] or 0)


def positions(
    df: DataFrame,
    order: list[Column],
    name: str,
    keys: tuple[str, ...] = (),
    largest: int | None = None,
    limit: int = GROUP_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Add ``name`` = 1..n in ``order`` within ``keys``.

    ``largest`` is a known upper bound of the group size. ``unique`` states that no
    two rows share both the keys and the order columns.
    """
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= limit:
        window = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    return _chained_positions(df, order, name, keys, unique, max(2, -(-largest // limit)))


def _chained_positions(df, order, name, keys, unique, pieces) -> DataFrame:
    spark = df.sparkSession
    columns = df.columns
    if not unique:
        # Equal rows could not be split by a range; the copy number tells them apart.
        df = durable(df.withColumn(_COPY, F.monotonically_increasing_id()))
        order = [*order, F.col(_COPY)]
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces)
    by = [*(F.col(k) for k in keys), *order]
    # The slice borders come from a sample, so they are frozen before being used twice.
    placed = durable(
        df.repartitionByRange(slices, *by)
        .sortWithinPartitions(*by)
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    # monotonically_increasing_id holds the partition above bit 33 and the row below it.
    piece = F.shiftright(_SEQ, 33)
    counts = placed.groupBy(piece.alias("__piece")).agg(F.count(F.lit(1)).alias("__rows"))
    starts = counts.select(
        "__piece",
        F.coalesce(
            F.sum("__rows").over(W.orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__start"),
    )
    # One row per slice: its size is the partition count chosen above.
    out = (
        placed.withColumn("__piece", piece)
        .join(F.broadcast(starts), "__piece")
        .withColumn(name, F.col("__start") + F.col(_SEQ).bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    )
    if keys:
        # Written, so that the join is one of two plain tables, whose hot keys Spark can split.
        first = durable(out.groupBy(*keys).agg(F.min(name).alias("__first")))
        out = out.join(first, list(keys)).withColumn(name, F.col(name) - F.col("__first") + 1)
    return out.select(*columns, name)


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark trims every map task to ``k`` rows before the shuffle."""
    window = W.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
