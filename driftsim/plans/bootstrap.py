"""Ratings to item similarities, neighbours and recommendations."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from driftsim.operators import increment, keys, pairs, prepare, recommend, stats
from driftsim.operators.ordering import group_sizes
from driftsim.schemas import STATE
from driftsim.session import Held, among, durable, hold


@dataclass(frozen=True)
class Settings:
    k: int = 5
    r: int = 10
    p: int = 100
    alpha: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Relations:
    """The stored relations, as flat tables."""

    user_ratings: DataFrame
    item_info: DataFrame
    pair_info: DataFrame
    neighbors: DataFrame
    popular: DataFrame
    recommendations: DataFrame | None = None

    def find(self, name: str, wanted: DataFrame, on: list[str]) -> DataFrame:
        """Rows of a relation whose key is wanted."""
        return keys.lookup(getattr(self, name), wanted, on)

    def hold(self, name: str, ids: np.ndarray) -> Held:
        """Rows of a relation whose lookup key is among a few ids, at the driver."""
        return hold(self.rows_of(name, ids))

    def rows_of(self, name: str, ids: np.ndarray) -> DataFrame:
        """The same as a plan."""
        return getattr(self, name).filter(among(STATE[name][2][0], ids))

    def hold_pairs(self, wanted: Held) -> Held:
        """The stored sums of a few (item_i, item_j)."""
        return hold(keys.lookup(self.pair_info, wanted.frame, ["item_i", "item_j"]))

    def candidates(self, n: int, seed: int, batch: int) -> DataFrame:
        """(item_id) of known items, with the n first drawn in a batch among them."""
        return increment.drawn(self.item_info, n, seed, batch).select("item_id")


def similarity_bootstrap(ratings: DataFrame, settings: Settings) -> DataFrame:
    """Raw ratings to (item_id, neighbor_id, sim, rank)."""
    # Written, so that counting them does not make them twice.
    ratings = durable(ratings)
    sizes = group_sizes(ratings, ["user_id"])
    profile = prepare.user_ratings(ratings, sizes.largest)
    # Feeds the item norms and both sides of the pair join.
    weighted = durable(stats.weighted_ratings(profile, settings.alpha, sizes.largest))
    # Written, so that a hot item is a skewed join of two tables, which Spark can split.
    info = durable(stats.item_info(weighted))
    return pairs.nearest_items(weighted, info, settings.k, sizes)


def relations(ratings: DataFrame, settings: Settings, keep=lambda name, df: durable(df)) -> Relations:
    """All relations of a raw ratings table.

    ``keep`` stores a relation under its name and returns it as read back.
    """
    ratings = durable(ratings)
    sizes = group_sizes(ratings, ["user_id"])
    profile = keep("user_ratings", prepare.user_ratings(ratings, sizes.largest))
    weighted = durable(stats.weighted_ratings(profile, settings.alpha, sizes.largest))
    info = keep("item_info", stats.item_info(weighted))
    # Stored, and ranked: the pairs are summed once for both.
    sums = durable(pairs.pair_info_with_similarity(weighted, info, sizes))
    stored = keep("pair_info", sums.drop("sim"))
    neighbors = keep("neighbors", pairs.topk_neighbors(pairs.mirror_pairs(sums), settings.k))
    popular = keep("popular", stats.top_popular(info, settings.p))
    return Relations(profile, info, stored, neighbors, popular)


def topr_bootstrap(base: Relations, r: int) -> DataFrame:
    """The r best recommendations of every user."""
    return recommend.topr_recommendations(base.user_ratings, base.popular, base.neighbors, r)
