"""One micro-batch applied to the stored relations.

``fresh`` is the de-duplicated batch (user_id, item_id, rating, position); its size is
the micro-batch size, and everything looked up for it stays within the items and pairs
it touches.
"""

from pyspark.sql import Column, DataFrame, functions as F

from driftsim.functions.scoring import decay, pair_similarity
from driftsim.operators.ordering import positions, top_per_key
from driftsim.operators.keys import lookup, present
from driftsim.operators.pairs import canonical_pair, mirror_pairs, topk_neighbors, with_zero_fill
from driftsim.session import durable


def fresh_keys(fresh: DataFrame, key: str) -> DataFrame:
    return fresh.select(key).distinct()


def new_entities(fresh: DataFrame, known: DataFrame, key: str) -> DataFrame:
    keys = fresh_keys(fresh, key)
    return keys.join(present(keys, known, [key]), key, "left_anti")


def ignore_new(fresh: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Only ratings whose user and item are both known."""
    old_users = present(fresh_keys(fresh, "user_id"), users, ["user_id"])
    old_items = present(fresh_keys(fresh, "item_id"), items, ["item_id"])
    return fresh.join(old_users, "user_id", "left_semi").join(old_items, "item_id", "left_semi")


def clocked(fresh: DataFrame, means: DataFrame) -> DataFrame:
    """Fresh ratings with their timestep and the merged user means of ``running_user_mean``."""
    return fresh.join(means, "user_id").select(
        "user_id",
        "item_id",
        "rating",
        (F.col("n_old") + F.col("position")).alias("timestep"),
        "t",
        "rubar",
        "e",
    )


def merge_profiles(profile: DataFrame, fresh: DataFrame, contain_duplicates: bool = True) -> DataFrame:
    """Profiles after the batch: a re-rated item is replaced, or kept twice if told so."""
    new = fresh.select("user_id", "item_id", "rating", "timestep")
    if contain_duplicates:
        profile = profile.join(new, ["user_id", "item_id"], "left_anti")
    return profile.select(*new.columns).unionByName(new)


def one_hop(items: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(fresh item, neighbour)."""
    return lookup(neighbors, items, ["item_id"]).select(
        F.col("item_id").alias("fresh_id"), F.col("neighbor_id").alias("candidate_id")
    )


def two_hop(first: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(fresh item, neighbour of a neighbour)."""
    middle = first.select(F.col("candidate_id").alias("item_id")).distinct()
    step = lookup(neighbors, middle, ["item_id"]).select(
        F.col("item_id").alias("candidate_id"), F.col("neighbor_id").alias("next_id")
    )
    return first.join(step, "candidate_id").select("fresh_id", F.col("next_id").alias("candidate_id")).distinct()


def draw_of(seed: int, batch: Column) -> Column:
    """The hash by which an item is drawn in a batch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), batch.cast("string"), F.col("item_id").cast("string")))


def drawn(known: DataFrame, n: int, seed: int, batch: int = 0) -> DataFrame:
    """The n known items (item_id, draw) with the lowest hash; the same for the same seed and batch."""
    return known.select("item_id", draw_of(seed, F.lit(batch)).alias("draw")).orderBy("draw", "item_id").limit(n)


def drawn_ahead(known: DataFrame, n: int, seed: int, first: int, last: int) -> DataFrame:
    """(version, item_id, draw): the same for every batch from ``first`` to ``last``, in one pass.

    Every map task keeps no more than n items of a batch.
    """
    rows = known.select("item_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("version"))
    rows = rows.withColumn("draw", draw_of(seed, F.col("version")))
    return top_per_key(rows, "version", [F.col("draw"), F.col("item_id")], n).drop("rank")


def deal(items: DataFrame, pool: DataFrame, k: int, count: int, size: int | None = None) -> DataFrame:
    """k items of the drawn ``pool`` for each of the ``count`` ``items``.

    Item number f takes pool slots f*k .. f*k+k-1, around the end if the pool is short.
    ``size`` is that of the pool, if it is known.
    """
    pool = positions(pool, [F.col("draw"), F.col("item_id")], "slot", largest=k * count, unique=True)
    size = pool.agg(F.count(F.lit(1))).scalar() if size is None else F.lit(size).cast("long")
    turns = F.explode(F.sequence(F.lit(0), F.least(F.lit(k), size.cast("int")) - 1))
    wanted = (
        positions(items.select("item_id"), [F.col("item_id")], "turn", largest=count, unique=True)
        .select(F.col("item_id").alias("fresh_id"), "turn", turns.alias("step"))
        .select("fresh_id", (((F.col("turn") - 1) * k + F.col("step")) % size + 1).alias("slot"))
    )
    return wanted.join(pool, "slot").select("fresh_id", F.col("item_id").alias("candidate_id"))


def random_k(items: DataFrame, known: DataFrame, k: int, seed: int, batch: int = 0) -> DataFrame:
    """k distinct random known items per item, the same for the same seed and batch.

    The k*n known items with the lowest hash form one pool, which is dealt out. The
    catalogue is scanned once and never paired with the batch.
    """
    count = items.agg(F.count(F.lit(1))).first()[0]
    if not count:
        return items.select(F.col("item_id").alias("fresh_id"), F.col("item_id").alias("candidate_id"))
    return deal(items, drawn(known, k * count, seed, batch), k, count)


def candidates(
    fresh: DataFrame, neighbors: DataFrame, known: DataFrame, k: int, seed: int, batch: int = 0
) -> DataFrame:
    """Candidate partners of every fresh item that owns a neighbour list."""
    items = fresh_keys(fresh, "item_id")
    listed = present(items, neighbors, ["item_id"])
    first = one_hop(listed, neighbors)
    return (
        first.unionByName(two_hop(first, neighbors))
        .unionByName(random_k(listed, known, k, seed, batch))
        .distinct()
    )


def touched_items(fresh: DataFrame, pool: DataFrame) -> DataFrame:
    """All items a batch updates: the candidates and the fresh items."""
    return (
        pool.select(F.col("candidate_id").alias("item_id")).unionByName(fresh.select("item_id")).distinct()
    )


def touched_pairs(pool: DataFrame) -> DataFrame:
    return canonical_pair(pool, "fresh_id", "candidate_id")


def update_item_info(
    info: DataFrame, touched: DataFrame, fresh: DataFrame, profile: DataFrame, alpha: float
) -> DataFrame:
    """New (L, n, Q) of every touched item, rated now or not."""
    fade = decay(F.lit(2.0), F.lit(0.0), alpha)
    keys = ["user_id", "item_id"]
    before = lookup(profile, fresh, keys).select(*keys, F.lit(True).alias("again"))
    rated = fresh.join(before, keys, "left")
    dev = F.col("rating") - F.col("rubar")
    twice = F.when(F.col("again"), 2 * decay("t", "timestep", alpha)).otherwise(F.lit(0.0))
    delta = rated.groupBy("item_id").agg(
        F.sum(dev * F.col("e") * (1 + twice)).alias("dl"),
        F.sum(dev * dev).alias("dq"),
        F.count(F.lit(1)).alias("dn"),
    )

    def at(column, zero=0.0):
        return F.coalesce(column, F.lit(zero))

    new_q = at("dq") + fade * (at("q") - 2 * at("l"))
    return (
        touched.join(lookup(info, touched, ["item_id"]), "item_id", "left")
        .join(delta, "item_id", "left")
        .select(
            "item_id",
            F.when(new_q < 0, at("l")).otherwise(at("dl") + fade * at("l")).alias("l"),
            (at("n", 0) + at("dn", 0)).alias("n"),
            F.when(new_q < 0, at("q")).otherwise(new_q).alias("q"),
        )
    )


def fresh_prev_pairs(
    fresh: DataFrame, profile: DataFrame, touched: DataFrame, alpha: float
) -> DataFrame:
    """Deviations of the co-ratings a batch creates, one row per pair and user.

    A fresh rating meets the earlier ratings of its user, faded by their age, and the
    user's other fresh ratings. Only touched items are looked at.
    """
    a = fresh.select(
        "user_id", "t", "rubar", "e", F.col("item_id").alias("a"), (F.col("rating") - F.col("rubar")).alias("da")
    )
    earlier = profile.join(touched, "item_id", "left_semi").select(
        "user_id", F.col("item_id").alias("b"), F.col("rating").alias("rb"), "timestep", F.lit(False).alias("now")
    )
    now = fresh.select(
        "user_id", F.col("item_id").alias("b"), F.col("rating").alias("rb"), "timestep", F.lit(True).alias("now")
    )
    met = a.join(earlier.unionByName(now), "user_id").filter(
        (F.col("a") != F.col("b")) & (~F.col("now") | (F.col("a") < F.col("b")))
    )
    factor = F.when(F.col("now"), F.lit(1.0)).otherwise(decay("t", "timestep", alpha))
    db = F.col("rb") - F.col("rubar")
    first = F.col("a") < F.col("b")
    return met.select(
        F.least("a", "b").alias("item_i"),
        F.greatest("a", "b").alias("item_j"),
        "user_id",
        F.when(first, F.col("da")).otherwise(db).alias("x_i"),
        F.when(first, db).otherwise(F.col("da")).alias("x_j"),
        "e",
        factor.alias("factor"),
    )


def update_pair_info(
    pairs: DataFrame, wanted: DataFrame, met: DataFrame, alpha: float
) -> DataFrame:
    """New (L_i, L_j, P) of every touched pair. A pair absent from the state starts at zero."""
    fade = decay(F.lit(2.0), F.lit(0.0), alpha)
    keys = ["item_i", "item_j"]
    delta = (
        met.join(wanted, keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.sum(F.col("factor") * F.col("x_i") * F.col("e")).alias("dl_i"),
            F.sum(F.col("factor") * F.col("x_j") * F.col("e")).alias("dl_j"),
            F.sum(F.col("factor") * F.col("x_i") * F.col("x_j")).alias("dp"),
        )
    )

    def at(column):
        return F.coalesce(column, F.lit(0.0))

    return (
        wanted.join(lookup(pairs, wanted, keys), keys, "left")
        .join(delta, keys, "left")
        .select(
            *keys,
            (at("dl_i") + fade * at("l_i")).alias("l_i"),
            (at("dl_j") + fade * at("l_j")).alias("l_j"),
            (at("dp") + fade * (at("p") - at("l_i") - at("l_j"))).alias("p"),
        )
    )


def update_candidates(listed: DataFrame, neighbors: DataFrame, scored: DataFrame) -> DataFrame:
    """Explicit candidates per item: stored neighbours and partners scored in this batch."""
    old = neighbors.join(listed, "item_id", "left_semi").select(
        "item_id", "neighbor_id", F.col("sim").alias("old_sim"), F.lit(None).cast("double").alias("new_sim")
    )
    new = scored.join(listed, "item_id", "left_semi").select(
        "item_id", "neighbor_id", F.lit(None).cast("double").alias("old_sim"), F.col("sim").alias("new_sim")
    )
    return (
        old.unionByName(new)
        .filter(F.col("item_id") != F.col("neighbor_id"))
        .groupBy("item_id", "neighbor_id")
        .agg(F.max("old_sim").alias("old_sim"), F.max("new_sim").alias("new_sim"))
    )


def refresh_neighbors(
    neighbors: DataFrame, touched: DataFrame, new_info: DataFrame, new_pairs: DataFrame, k: int, keep=durable
) -> DataFrame:
    """New lists of every touched item that owns one.

    A pair updated in this batch, with two norms, gets a new similarity; a stored
    neighbour keeps its old one; any other touched item competes with similarity 0.
    ``keep`` holds the explicit candidates, which are used more than once.
    """
    listed = present(touched, neighbors, ["item_id"])
    q = new_info.select("item_id", "q").filter(F.col("q") != 0)
    scored = (
        new_pairs.join(q.select(F.col("item_id").alias("item_i"), F.col("q").alias("q_i")), "item_i")
        .join(q.select(F.col("item_id").alias("item_j"), F.col("q").alias("q_j")), "item_j")
        .select("item_i", "item_j", pair_similarity("p", "q_i", "q_j").alias("sim"))
    )
    scored = mirror_pairs(scored)
    explicit = keep(
        update_candidates(listed, neighbors, scored).select(
            "item_id", "neighbor_id", F.coalesce("new_sim", "old_sim").alias("sim")
        )
    )
    return topk_neighbors(with_zero_fill(explicit, listed, touched, k), k)


def maintain_popular(popular: DataFrame, new_info: DataFrame, p: int) -> DataFrame:
    """The p most popular items after a batch.

    Counts only grow, so an untouched item outside the list cannot enter it: the old
    list and the touched items are enough.
    """
    merged = popular.select("item_id", "n").unionByName(new_info.select("item_id", "n"))
    return (
        merged.groupBy("item_id").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "item_id").limit(p)
    )
