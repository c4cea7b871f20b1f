"""The relations after one micro-batch, as plans over the relations before it."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from driftsim.operators import increment, pairs, recommend, stats
from driftsim.plans.bootstrap import Relations, Settings
from driftsim.session import LOCAL_ROWS, Held, among, distinct_ids, durable, held, hold, id_frame, local


@dataclass(frozen=True)
class Update:
    """The changed rows of each relation.

    ``popular`` and the lists in ``neighbors`` and ``recommendations`` are whole new values.
    """

    user_ratings: DataFrame
    item_info: DataFrame
    pair_info: DataFrame
    neighbors: DataFrame
    popular: DataFrame
    recommendations: DataFrame
    touched: DataFrame
    touched_pairs: DataFrame
    users: DataFrame


def small_rows(settings: Settings) -> int:
    """The most rows of a batch whose whole reach is small enough for local frames.

    A rating touches k neighbours, their k neighbours and k random items; every touched
    or popular item brings a list of k.
    """
    reach = 1 + 2 * settings.k + settings.k**2
    return max(0, (LOCAL_ROWS // (1 + settings.k) - settings.p) // reach)


def apply_batch(
    base: Relations,
    fresh: DataFrame,
    settings: Settings,
    batch: int = 0,
    batch_rows: int = 0,
    ignore_new: bool = False,
    contain_duplicates: bool = True,
    keep=None,
    small: bool | None = None,
    near: Held | None = None,
) -> Update:
    """Update every relation by one batch of (user_id, item_id, rating, position).

    ``keep`` stores a changed relation under its name and returns it as read back; the
    third argument are keys whose old list goes even if they have no new one.

    A batch of up to ``small_rows`` looks its rows up in the relations and then works on
    local frames, one short job a step. A larger one goes through written tables. Both
    give the same rows; ``small`` says which way to go if the caller knows, and ``near`` are
    the stored lists of the batch's items if they were looked up before.
    """
    if ignore_new:
        fresh = increment.ignore_new(fresh, base.user_ratings, base.item_info)
    fresh = fresh.select("user_id", "item_id", "rating", "position")
    most, few = small_rows(settings), None
    if small is not False:
        few = fresh.limit(most + 1).toArrow() if small is None else fresh.toArrow()
    if few is not None and (small or few.num_rows <= most):
        keep = keep or (lambda name, df, owners=None: hold(df))
        return _apply_small(base, held(fresh.sparkSession, few), settings, batch, batch_rows, contain_duplicates, keep, near)
    keep = keep or (lambda name, df, owners=None: durable(df))
    return _apply_large(base, fresh, settings, batch, batch_rows, contain_duplicates, keep)


#: So many asked items are a filter; more are broadcast.
FILTER_IDS = 5000


def small_profiles(base: Relations, users: np.ndarray, items: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Sums (user_id, s_old, n_old) of the stored ratings of ``users``, and their ratings of ``items``."""
    rows = base.rows_of("user_ratings", users)
    if len(items) > FILTER_IDS:
        asked = F.broadcast(id_frame(rows.sparkSession, "item_id", items).withColumn("__asked", F.lit(True)))
        rows, entry = rows.join(asked, "item_id", "left"), F.col("__asked")
    else:
        entry = among("item_id", items)
    parts = local(stats.profile_parts(rows, entry))
    return parts.drop("some"), parts.select("user_id", F.inline("some"))


def _apply_small(base, batch_table, settings, batch, batch_rows, contain_duplicates, keep, near=None) -> Update:
    """``keep`` may return a frame, as in ``apply_batch``, or what it ``Held`` of it."""
    k, fresh, store = settings.k, batch_table.frame, keep

    def keep(*args):
        found = store(*args)
        return found if isinstance(found, Held) else hold(found)

    spark = base.popular.sparkSession
    users, items = batch_table.ids("user_id"), batch_table.ids("item_id")
    # Lists of the batch's items and of their neighbours, and the drawn candidates.
    near = near or base.hold("neighbors", items)
    further = base.hold("neighbors", near.ids("neighbor_id"))
    item_rows, listed = id_frame(spark, "item_id", items), near.ids("item_id")
    first = increment.one_hop(item_rows, near.frame)
    pool = first.unionByName(increment.two_hop(first, further.frame))
    if len(listed):
        # The batch's own new items can be drawn as well.
        n = k * len(listed)
        known = local(base.candidates(n, settings.seed, batch))
        known = hold(increment.drawn(known.unionByName(item_rows).distinct(), n, settings.seed, batch))
        pool = pool.unionByName(increment.deal(id_frame(spark, "item_id", listed), known.frame, k, len(listed), known.table.num_rows))
    pool = hold(pool.distinct())
    touched_ids = distinct_ids(pool.table.column("candidate_id"), items)
    touched = id_frame(spark, "item_id", touched_ids)
    wanted = hold(increment.touched_pairs(pool.frame))
    # Whatever can be popular afterwards, and every list that can be served.
    was_popular = hold(base.popular)
    lists = base.hold("neighbors", distinct_ids(touched_ids, was_popular.ids("item_id")))
    asked = distinct_ids(touched_ids, was_popular.ids("item_id"), lists.ids("neighbor_id"))
    sums, old = small_profiles(base, users, asked)

    clocked = local(increment.clocked(fresh, stats.merged_means(sums, fresh)))
    old_info = base.hold("item_info", touched_ids)
    info = keep("item_info", increment.update_item_info(old_info.frame, touched, clocked, old, settings.alpha))
    met = increment.fresh_prev_pairs(clocked, old, touched, settings.alpha)
    old_pairs = base.hold_pairs(wanted).frame
    pairs = keep("pair_info", increment.update_pair_info(old_pairs, wanted.frame, met, settings.alpha))

    popular = keep("popular", increment.maintain_popular(was_popular.frame, info.frame, settings.p))
    mine = lists.frame.join(touched, "item_id", "left_semi")
    every, new_items = lists.frame, np.setdiff1d(items, old_info.ids("item_id"))
    if len(new_items):
        defaults = local(stats.default_neighbors(id_frame(spark, "item_id", new_items), popular.frame, k))
        mine, every = mine.unionByName(defaults), every.unionByName(defaults)
    neighbors = keep("neighbors", increment.refresh_neighbors(mine, touched, info.frame, pairs.frame, k, keep=local))

    rows = clocked.select("user_id", "item_id", "rating", "timestep")
    again = old.select(*rows.columns).join(rows.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    ratings = keep("user_ratings", rows if contain_duplicates else rows.unionByName(again))
    profile = increment.merge_profiles(old, clocked, contain_duplicates)
    changed = fresh.select("user_id", F.col("rating").alias("s"), F.lit(1).alias("c"))
    if contain_duplicates:
        changed = changed.unionByName(again.select("user_id", (-F.col("rating")).alias("s"), F.lit(-1).alias("c")))
    moved = changed.groupBy("user_id").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).join(sums, "user_id", "left")
    whole = F.coalesce("s_old", F.lit(0.0)) + F.col("s")
    means = moved.select("user_id", (whole / (F.coalesce("n_old", F.lit(0)) + F.col("c"))).alias("mean"))
    served = local(increment_lists(every, neighbors.frame, popular.frame))
    owners = id_frame(spark, "user_id", users)
    recommendations = keep(
        "recommendations", recommend.topr_recommendations(profile, popular.frame, served, settings.r + batch_rows, means), owners
    )
    return Update(
        *(x.frame for x in (ratings, info, pairs, neighbors, popular, recommendations)), touched, wanted.frame, owners
    )


def _apply_large(base, fresh, settings, batch, batch_rows, contain_duplicates, keep) -> Update:
    users = increment.fresh_keys(fresh, "user_id")
    # The earlier ratings of the batch's users, the batch with its clock, and the
    # candidates drawn for it feed every step below.
    old = durable(base.find("user_ratings", users, ["user_id"]))
    means = stats.running_user_mean(old, fresh)
    clocked = durable(increment.clocked(fresh, means))
    items = increment.fresh_keys(clocked, "item_id")
    near = base.find("neighbors", items, ["item_id"])
    middle = near.select(F.col("neighbor_id").alias("item_id")).distinct()
    near = durable(near.unionByName(base.find("neighbors", middle, ["item_id"])).distinct())
    # The batch's own new items can be drawn as well.
    known = base.item_info.select("item_id").unionByName(items).distinct()
    pool = durable(increment.candidates(clocked, near, known, settings.k, settings.seed, batch))
    touched = durable(increment.touched_items(clocked, pool))
    wanted = increment.touched_pairs(pool)

    old_info = base.find("item_info", touched, ["item_id"])
    info = keep("item_info", increment.update_item_info(old_info, touched, clocked, old, settings.alpha))
    met = increment.fresh_prev_pairs(clocked, old, touched, settings.alpha)
    old_sums = base.find("pair_info", wanted, ["item_i", "item_j"])
    sums = keep("pair_info", increment.update_pair_info(old_sums, wanted, met, settings.alpha))

    new_items = increment.new_entities(clocked, old_info, "item_id")
    popular = keep("popular", increment.maintain_popular(base.popular, info, settings.p))
    defaults = stats.default_neighbors(new_items, popular, settings.k)
    lists = base.find("neighbors", touched, ["item_id"]).unionByName(defaults)
    neighbors = keep("neighbors", increment.refresh_neighbors(lists, touched, info, sums, settings.k))

    rows = clocked.select("user_id", "item_id", "rating", "timestep")
    if not contain_duplicates:
        # What is written under a key replaces what was there, so the earlier rows go along.
        rows = rows.unionByName(old.select(*rows.columns).join(rows.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"))
    ratings = keep("user_ratings", rows)
    profile = increment.merge_profiles(old, clocked, contain_duplicates)
    stored = base.find("neighbors", popular, ["item_id"]).unionByName(defaults)
    served = durable(increment_lists(stored, neighbors, popular))
    recommendations = keep(
        "recommendations",
        recommend.topr_recommendations(profile, popular, served, settings.r + batch_rows),
        users,
    )
    return Update(
        ratings,
        info,
        sums,
        neighbors,
        popular,
        recommendations,
        touched,
        wanted,
        users,
    )


def increment_lists(lists: DataFrame, changed: DataFrame, popular: DataFrame) -> DataFrame:
    """Neighbour lists of the popular items after the batch."""
    wanted = popular.select("item_id")
    kept = lists.join(wanted, "item_id", "left_semi").join(changed.select("item_id"), "item_id", "left_anti")
    return kept.unionByName(changed.join(wanted, "item_id", "left_semi"))


def merged_relations(base: Relations, change: Update) -> Relations:
    """The relations after the batch, for callers that keep them as plans."""

    def put(old, new, key, owners=None):
        gone = (new if owners is None else owners).select(*key).distinct()
        return old.join(gone, key, "left_anti").unionByName(new.select(*old.columns))

    recommendations = change.recommendations
    if base.recommendations is not None:
        recommendations = put(base.recommendations, change.recommendations, ["user_id"], change.users)
    return Relations(
        put(base.user_ratings, change.user_ratings, ["user_id", "item_id"]),
        put(base.item_info, change.item_info, ["item_id"]),
        put(base.pair_info, change.pair_info, ["item_i", "item_j"]),
        put(base.neighbors, change.neighbors, ["item_id"]),
        change.popular,
        recommendations,
    )
