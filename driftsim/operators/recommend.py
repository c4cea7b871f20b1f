"""Rating prediction and top-R recommendation."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftsim.functions.scoring import rank_key
from driftsim.operators.keys import lookup, present
from driftsim.operators.ordering import top_per_key


def candidate_items(profile: DataFrame, popular: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Popular items with neighbours that a user has not rated.

    ``popular`` is bounded by the popularity cut-off, so it travels as one array; the
    items already seen are looked for among these only.
    """
    return _unseen(profile, _served(popular, neighbors)).select(
        "user_id", F.explode("unseen").alias("item_id")
    )


def topr_recommendations(
    profile: DataFrame, popular: DataFrame, neighbors: DataFrame, r: int, means: DataFrame | None = None
) -> DataFrame:
    """The r best predicted candidates of every user.

    With ``means`` (user_id, mean) of all users, ``profile`` need only hold their ratings
    of popular items and of the neighbours of these.

    Ratings meet the neighbour lists of the popular items through the neighbour id,
    which yields only (user, candidate) sums with evidence. Candidates without
    evidence fall back to the user mean. Ranking happens inside the user's row.
    """
    served = _served(popular, neighbors)
    # At most (popular items) x (list length) rows.
    lists = F.broadcast(
        neighbors.join(served, "item_id", "left_semi").select("item_id", "neighbor_id", "sim")
    )
    users = _unseen(profile, served, means)
    evidence = (
        profile.select("user_id", F.col("item_id").alias("neighbor_id"), "rating")
        .join(lists, "neighbor_id")
        .groupBy("user_id", "item_id")
        .agg(
            F.sum(F.col("sim") * F.col("rating")).alias("sr"),
            F.sum("sim").alias("s"),
            F.sum(F.abs("sim")).alias("a"),
        )
        .filter(F.col("a") > 0)
    )
    by_user = evidence.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", F.struct("sr", "s", "a")))).alias("sums")
    )
    mean = F.col("mean")

    def score(item):
        sums = F.try_element_at("sums", item)
        moved = mean + (sums["sr"] - mean * sums["s"]) / sums["a"]
        pred = F.coalesce(moved, mean)
        return F.struct(rank_key(pred).alias("key"), item.alias("item_id"), pred.alias("pred"))

    ranked = F.slice(F.array_sort(F.transform("unseen", score)), 1, r)
    return (
        users.join(by_user, "user_id", "left")
        .select("user_id", F.posexplode(ranked).alias("pos", "entry"))
        .select("user_id", "entry.item_id", "entry.pred", (F.col("pos") + 1).alias("rank"))
    )


def predict_observations(
    observed: DataFrame, profile: DataFrame, neighbors: DataFrame, means: DataFrame | None = None
) -> DataFrame:
    """Prediction and user mean for each (user, item) of a batch, from the state before it.

    Users without a profile get none, as there is no mean to start from. With ``means``
    (user_id, mean), ``profile`` need only hold ratings of neighbours of the items.
    """
    keys = observed.select("user_id", "item_id").distinct()
    rated = lookup(profile, keys.select("user_id").distinct(), ["user_id"])
    if means is None:
        means = rated.groupBy("user_id").agg(F.avg("rating").alias("mean"))
    evidence = (
        keys.join(
            lookup(neighbors, keys.select("item_id").distinct(), ["item_id"]).select("item_id", "neighbor_id", "sim"),
            "item_id",
        )
        .join(rated.select("user_id", F.col("item_id").alias("neighbor_id"), "rating"), ["user_id", "neighbor_id"])
        .groupBy("user_id", "item_id")
        .agg(
            F.sum(F.col("sim") * F.col("rating")).alias("sr"),
            F.sum("sim").alias("s"),
            F.sum(F.abs("sim")).alias("a"),
        )
    )
    moved = F.when(F.col("a") > 0, F.col("mean") + (F.col("sr") - F.col("mean") * F.col("s")) / F.col("a"))
    return (
        observed.join(means, "user_id")
        .join(evidence, ["user_id", "item_id"], "left")
        .withColumn("pred", F.coalesce(moved, F.col("mean")))
        .drop("sr", "s", "a")
    )


def serve_recommendations(
    observed: DataFrame,
    recommendations: DataFrame,
    cutoffs: list[int],
    most: int | None = None,
    served_before: DataFrame | None = None,
    turns: DataFrame | None = None,
) -> DataFrame:
    """What each observation is answered with, one list per cut-off.

    ``observed`` has (batch, user_id, item_id, arrival). The stored list of the user
    loses every item the user has rated in this batch so far, the current one
    included; the first R of the rest are served. Lists and batches are both bounded.
    With ``most`` an item that has been in the longest lists of a user that often gives
    way to the next one. Earlier turns come as counts, ``turns`` (user_id, item_id, n),
    or as the rows of earlier lists, ``served_before``.
    """
    so_far = W.partitionBy("batch", "user_id").orderBy("arrival")
    queries = observed.select(
        "batch", "user_id", "arrival", F.collect_set("item_id").over(so_far).alias("rated")
    )
    asked = lookup(recommendations, observed.select("user_id").distinct(), ["user_id"])
    lists = asked.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("stored")
    )
    if most is not None:
        if turns is None and served_before is not None:
            turns = turns_of(lookup(served_before, observed.select("user_id"), ["user_id"]))
        served = _serve_at_most(queries.join(lists, "user_id"), max(cutoffs), most, turns)
        return multi_cutoff(served, cutoffs)
    left = F.filter("stored", lambda x: ~F.array_contains("rated", x.item_id))
    best = F.transform(F.slice(left, 1, max(cutoffs)), lambda x: x.item_id)
    served = queries.join(lists, "user_id").select(
        "batch", "arrival", "user_id", F.posexplode_outer(best).alias("pos", "item_id")
    )
    # A list with nothing left is still an answer: one row without an item.
    rank = F.coalesce(F.col("pos") + 1, F.lit(1))
    return multi_cutoff(served.withColumn("rank", rank).drop("pos"), cutoffs)


def turns_of(served: DataFrame) -> DataFrame:
    """How often each item was in the lists of each user: (user_id, item_id, n)."""
    return served.filter("item_id is not null").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def added_turns(turns: DataFrame, served: DataFrame) -> DataFrame:
    """The new counts of the (user, item) in ``served``, on top of those in ``turns``."""
    new = turns_of(served)
    old = turns.select("user_id", "item_id", F.col("n").alias("before"))
    return new.join(old, ["user_id", "item_id"], "left").select(
        "user_id", "item_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n")
    )


def _serve_at_most(queries: DataFrame, size: int, most: int, turns: DataFrame | None) -> DataFrame:
    """Answers in order of arrival, each of which uses up one turn of the items in it.

    What is served depends on all earlier answers of the batch, so a user's queries are
    folded in one row, with the turns of the listed items beside them; queries and lists
    are no longer than the batch and the stored list.
    """
    asked = F.sort_array(F.collect_list(F.struct("arrival", "batch", "rated")))
    users = queries.groupBy("user_id").agg(asked.alias("asked"), F.first(F.transform("stored", lambda x: x.item_id)).alias("items"))
    if turns is None:
        users = users.withColumn("used", F.lit(None).cast("map<bigint,bigint>"))
    else:
        entries = F.map_from_entries(F.collect_list(F.struct("item_id", "n"))).alias("used")
        listed = users.select("user_id", F.explode("items").alias("item_id"))
        used = turns.join(listed, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(entries)
        users = users.join(used, "user_id", "left")
    items = F.col("items")
    begin = F.transform(items, lambda x: F.coalesce(F.try_element_at("used", x), F.lit(0).cast("long")))
    answers = F.array().cast("array<struct<batch: bigint, arrival: bigint, best: array<bigint>>>")

    def step(state: Column, query: Column) -> Column:
        counted = F.transform(items, lambda x, i: F.struct(x.alias("item"), state["used"][i].alias("n")))
        left = F.filter(counted, lambda x: ~F.array_contains(query["rated"], x["item"]) & (x["n"] < most))
        best = F.transform(F.slice(left, 1, size), lambda x: x["item"])
        moved = F.transform(
            counted, lambda x: x["n"] + F.when(F.array_contains(best, x["item"]), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        )
        answer = F.struct(query["batch"].alias("batch"), query["arrival"].alias("arrival"), best.alias("best"))
        return F.struct(moved.alias("used"), F.concat(state["answers"], F.array(answer)).alias("answers"))

    folded = F.aggregate("asked", F.struct(begin.alias("used"), answers.alias("answers")), step, lambda state: state["answers"])
    served = users.select("user_id", F.explode(folded).alias("answer")).select(
        "answer.batch", "answer.arrival", "user_id", F.posexplode_outer("answer.best").alias("pos", "item_id")
    )
    # A list with nothing left is still an answer: one row without an item.
    return served.withColumn("rank", F.coalesce(F.col("pos") + 1, F.lit(1))).drop("pos")


def multi_cutoff(ranked: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One list per cut-off out of a single ranked list."""
    fitting = F.filter(F.array(*(F.lit(c) for c in sorted(set(cutoffs)))), lambda c: c >= F.col("rank"))
    return ranked.withColumn("cutoff", F.explode(fitting))


def cap_repeats(log: DataFrame, most: int) -> DataFrame:
    """Drop what was recommended to the same user ``most`` times before.

    ``log`` has (user_id, item_id, arrival). Only the first ``most`` rows of each
    (user, item) remain, which every map task already trims for itself.
    """
    window = W.partitionBy("user_id", "item_id").orderBy("arrival")
    return log.withColumn("__seen", F.row_number().over(window)).filter(F.col("__seen") <= most).drop("__seen")


def unseen_items(candidates: DataFrame, rated: DataFrame) -> DataFrame:
    return candidates.join(rated.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def has_neighbors(items: DataFrame, neighbors: DataFrame) -> DataFrame:
    return items.join(present(items, neighbors, ["item_id"]), "item_id", "left_semi")


def top_recommendations(scored: DataFrame, r: int) -> DataFrame:
    """The first r of scored (user, item) rows."""
    return top_per_key(scored, "user_id", [rank_key("pred"), F.col("item_id")], r)


def _served(popular: DataFrame, neighbors: DataFrame) -> DataFrame:
    return present(popular, neighbors, ["item_id"])


def _unseen(profile: DataFrame, served: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Per user: mean rating and the served items not rated yet."""
    ids = served.agg(F.sort_array(F.collect_list("item_id"))).scalar()
    marked = profile.join(F.broadcast(served.withColumn("__served", F.lit(True))), "item_id", "left")
    seen = F.collect_set(F.when(F.col("__served"), F.col("item_id"))).alias("seen")
    if means is None:
        users = marked.groupBy("user_id").agg(F.avg("rating").alias("mean"), seen)
    else:
        users = means.join(marked.groupBy("user_id").agg(seen), "user_id", "left").withColumn(
            "seen", F.coalesce("seen", F.array().cast("array<bigint>"))
        )
    return users.select("user_id", "mean", F.array_except(ids, F.col("seen")).alias("unseen"))
