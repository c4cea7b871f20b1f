"""Key-based access and set operations on relations."""

from pyspark.sql import DataFrame


def lookup(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``table`` whose key is in ``keys``.

    A semi-join: Spark ships the key side when its measured size is small, and shuffles
    both otherwise.
    """
    return table.join(keys.select(*on), on, "left_semi")


def present(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys that ``table`` holds. The table is filtered in place, not shuffled to few keys."""
    return lookup(table, keys, on).select(*on).distinct()


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key."""
    return old.join(new.select(*on), on, "left_anti").unionByName(new.select(*old.columns))


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows present in both."""
    return a.intersect(b.select(*a.columns))
