"""Co-rating pairs, their sums, and the neighbour graph."""

from pyspark.sql import Column, DataFrame, functions as F

from driftsim.functions.scoring import clamp, pair_similarity, rank_key
from driftsim.operators.item_lists import neighbor_lists
from driftsim.operators.ordering import GROUP_ROWS, GroupSizes, group_sizes, positions, top_per_key
from driftsim.session import durable

# Rows of one group that one side of a pair join may hold.
CELL_ROWS = 4096
# Pairs that one task should make.
PAIR_ROWS = 4_000_000
# Pairs whose sums one pass leaves on disk; the rows of a shuffle of pairs hardly collapse before it.
PASS_PAIRS = 50_000_000
# Pairs for each two items up to which hardly any is met again in the task that makes it.
REPEATS = 8
# Rows that a row meets on average, from which on a pair join hashes one side.
HASHED = 8


def pairs_within(
    df: DataFrame,
    group: str,
    member: str,
    columns: list[str],
    sizes: GroupSizes | None = None,
    cell_rows: int = CELL_ROWS,
    passes: int = 1,
    nth: int = 0,
) -> DataFrame:
    """Pairs (member_i < member_j) that meet in a group, with both rows' ``columns``.

    Of several ``passes`` the ``nth`` makes the pairs whose member_i falls to it by hash.

    Columns come out suffixed ``_i`` and ``_j``. ``sizes`` are known bounds of the group
    sizes. A group above ``cell_rows`` is cut into g chunks by member hash; its rows are
    laid out on a g x g grid of cells and joined per (group, cell), so that no task holds
    more than one chunk pair of it and each pair meets in exactly one cell.
    """
    if sizes is None:
        sizes = group_sizes(df, [group])
    keep = [group, member, *columns]
    df = df.select(*keep)
    keys = [group]
    left = right = df
    if sizes.largest > cell_rows:
        counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > cell_rows)
        chunks = F.ceil(F.col("__n") / F.lit(cell_rows))
        sized = df.join(counted, group, "left").withColumn("__g", F.coalesce(chunks, F.lit(1)))
        chunk = F.pmod(F.xxhash64(member), F.col("__g"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__g") - 1))
        left = sized.select(*keep, chunk.alias("__row"), every.alias("__column"))
        right = sized.select(*keep, every.alias("__row"), chunk.alias("__column"))
        keys += ["__row", "__column"]
    if passes > 1:
        left = left.filter(F.pmod(F.xxhash64(member), F.lit(passes)) == nth)
    tasks = pair_tasks(df, sizes, passes)
    names = [member, *columns]
    left = left.repartition(tasks, *keys).select(*keys, *(F.col(c).alias(f"{c}_i") for c in names))
    right = right.repartition(tasks, *keys).select(*keys, *(F.col(c).alias(f"{c}_j") for c in names))
    if sizes.rows and sizes.squares >= HASHED * sizes.rows:
        # With this many pairs a row, a task of PAIR_ROWS pairs holds few rows: they are
        # hashed, which passes over the pairs faster than a merge.
        right = right.hint("shuffle_hash")
    return (
        left.join(right, keys)
        .filter(F.col(f"{member}_i") < F.col(f"{member}_j"))
        .select(group, *(f"{c}_{side}" for c in names for side in "ij"))
    )


def pair_tasks(df: DataFrame, sizes: GroupSizes, passes: int = 1) -> int:
    """Tasks of a pair join. Its input says little about its work, so the pairs are counted in."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, round(sizes.squares / 2 / PAIR_ROWS / passes))


_pair_tasks = pair_tasks


def co_rated_pairs(profile: DataFrame, sizes: GroupSizes | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For item pairs i < j every user who rated both, with both ratings and timesteps."""
    return _named(pairs_within(profile, "user_id", "item_id", ["rating", "timestep"], sizes, cell_rows))


def pair_info(weighted: DataFrame, sizes: GroupSizes | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per item pair: drift terms L_i, L_j and the weighted product P."""
    pairs = _named(pairs_within(weighted, "user_id", "item_id", ["x", "we"], sizes, cell_rows))
    return pairs.groupBy("item_i", "item_j").agg(*_pair_sums())


def unit_ratings(weighted: DataFrame, info: DataFrame) -> DataFrame:
    """Weighted ratings with ``v``, the deviation over the norm of its item.

    The norms meet the ratings here and not the far larger pair table later.
    """
    norm = F.sqrt("q")
    unit = F.when(norm != 0, F.col("x") / norm).otherwise(F.lit(0.0))
    return weighted.join(info.select("item_id", "q"), "item_id").withColumn("v", unit).drop("q")


def pair_similarities(
    weighted: DataFrame, info: DataFrame, sizes: GroupSizes | None = None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Similarity of every co-rated pair."""
    rows = unit_ratings(weighted, info).select("user_id", "item_id", "v")
    return _unit_similarities(rows, sizes, cell_rows)


def _unit_similarities(rows: DataFrame, sizes, cell_rows, passes: int = 1, nth: int = 0) -> DataFrame:
    pairs = _named(pairs_within(rows, "user_id", "item_id", ["v"], sizes, cell_rows, passes, nth))
    return pairs.groupBy("item_i", "item_j").agg(_similarity_sum())


def nearest_items(
    weighted: DataFrame, info: DataFrame, k: int, sizes: GroupSizes, pass_pairs: int = PASS_PAIRS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The k most similar co-rated items of every item.

    More than ``pass_pairs`` pairs are made in passes by their smaller item. Each pair
    falls to one pass, whole, so the best k of every pass hold the best k of all; a pass
    leaves these lists only, and what it shuffled is deleted when they are written. Where
    there are so many items that pairs hardly repeat, whole lists of users make the pairs
    (``item_lists``), in passes of as many pairs as there are ratings or more.
    """
    pairs = sizes.squares / 2
    passes = max(1, -(-round(pairs) // pass_pairs))
    if passes == 1:
        return topk_neighbors(mirror_pairs(pair_similarities(weighted, info, sizes, cell_rows)), k)
    rows = durable(unit_ratings(weighted, info).select("user_id", "item_id", "v"), last_use=True)
    if info.count() ** 2 / 2 * REPEATS >= pairs:
        known = rows.filter("user_id is not null and item_id is not null")
        if known.filter("v is null or isnan(v)").isEmpty():
            return neighbor_lists(known, k, pairs, max(pass_pairs, sizes.rows), sizes.largest, cell_rows)
    found = None
    for nth in range(passes):
        sims = _unit_similarities(rows, sizes, cell_rows, passes, nth)
        part = durable(topk_neighbors(mirror_pairs(sims), k).drop("rank"), last_use=True)
        found = part if found is None else found.unionByName(part)
    return topk_neighbors(found, k)


def pair_info_with_similarity(
    weighted: DataFrame, info: DataFrame, sizes: GroupSizes | None = None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The pair sums and the similarity out of one pass over the pairs."""
    rows = unit_ratings(weighted, info)
    pairs = _named(pairs_within(rows, "user_id", "item_id", ["x", "we", "v"], sizes, cell_rows))
    return pairs.groupBy("item_i", "item_j").agg(*_pair_sums(), _similarity_sum())


def similarity_of_pairs(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Similarity of stored pairs, by looking up the norms of both ends."""
    q = info.select("item_id", "q")
    return (
        pairs.join(q.select(F.col("item_id").alias("item_i"), F.col("q").alias("q_i")), "item_i")
        .join(q.select(F.col("item_id").alias("item_j"), F.col("q").alias("q_j")), "item_j")
        .select("item_i", "item_j", "p", pair_similarity("p", "q_i", "q_j").alias("sim"))
    )


def mirror_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, in one pass."""
    ways = F.array(
        F.struct(F.col("item_i").alias("item_id"), F.col("item_j").alias("neighbor_id")),
        F.struct(F.col("item_j").alias("item_id"), F.col("item_i").alias("neighbor_id")),
    )
    return pairs.select(F.explode(ways).alias("way"), "sim").select("way.*", "sim")


def topk_neighbors(directed: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours per item; ties by id."""
    order = [rank_key("sim"), F.col("neighbor_id")]
    return top_per_key(directed, "item_id", order, k).select("item_id", "neighbor_id", "sim", "rank")


def canonical_pair(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs as (smaller, larger), without self pairs."""
    return (
        pairs.filter(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("item_i"), F.greatest(a, b).alias("item_j"))
        .distinct()
    )


def ranked_list(rows: DataFrame, key: str, fields: list[str], name: str, rank: Column | str = "rank") -> DataFrame:
    """Ranked rows as one array per key. The rank cut-off bounds the array."""
    entry = F.struct(rank, *fields)
    return rows.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(entry)), lambda x: F.struct(*(x[f].alias(f) for f in fields))
        ).alias(name)
    )


def unranked(lists: DataFrame, key: str, name: str, first: int | None = None) -> DataFrame:
    """The rows of ranked arrays, optionally only the first few."""
    values = F.col(name) if first is None else F.slice(name, 1, first)
    return lists.select(key, F.posexplode(values).alias("pos", "entry")).select(
        key, "entry.*", (F.col("pos") + 1).alias("rank")
    )


def with_zero_fill(
    explicit: DataFrame, listed: DataFrame, universe: DataFrame, k: int, key: str = "item_id"
) -> DataFrame:
    """Explicit (key, neighbor_id, sim) rows plus the zeros that can still make a top-k list.

    Every id of ``universe`` competes in the list of every ``listed`` key, with 0 unless
    it is explicit. Zeros are equal, so only the k smallest non-explicit ids matter, and
    only to keys with fewer than k positive candidates. Number the universe by id: if
    the m-th explicit id of a key has slot s, then s - m other ids lie below it, so the
    j-th missing slot is j plus the explicit ids with s - m < j. Those counts per key
    are all that is needed; the full set of zeros is never built.
    """
    ids = universe.select(F.col(key).alias("neighbor_id")).distinct()
    size = ids.count()
    numbered = positions(ids, [F.col("neighbor_id")], "slot", (), size, unique=True)
    positive = F.count_if(rank_key("sim") < 0)
    full = explicit.groupBy(key).agg(positive.alias("n")).filter(F.col("n") >= k)
    short = listed.select(key).distinct().join(full, key, "left_anti")
    taken = (
        explicit.select(key, "neighbor_id")
        .join(short, key, "left_semi")
        .unionByName(short.select(key, F.col(key).alias("neighbor_id")))
        .distinct()
        .join(numbered, "neighbor_id")
    )
    gap = F.col("slot") - F.col("m")
    below = (
        positions(taken, [F.col("slot")], "m", (key,), size if size <= GROUP_ROWS else None, unique=True)
        .filter(gap < k)
        .groupBy(key, gap.alias("gap"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most k counts per key.
    hist = below.groupBy(key).agg(F.collect_list(F.struct("gap", "n")).alias("hist"))
    none = F.array().cast("array<struct<gap:bigint,n:bigint>>")
    hist = short.join(hist, key, "left").withColumn("hist", F.coalesce("hist", none))
    wanted = F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))
    slots = F.transform(
        wanted,
        lambda j: j
        + F.aggregate("hist", F.lit(0).cast("long"), lambda total, h: total + F.when(h.gap < j, h.n).otherwise(0)),
    )
    zeros = (
        hist.select(key, F.explode(slots).alias("slot"))
        .join(numbered, "slot")
        .select(key, "neighbor_id", F.lit(0.0).alias("sim"))
    )
    return explicit.select(key, "neighbor_id", "sim").unionByName(zeros)


def _pair_sums() -> list[Column]:
    return [
        F.sum(F.col("x_i") * F.col("we_j")).alias("l_i"),
        F.sum(F.col("x_j") * F.col("we_i")).alias("l_j"),
        F.sum(F.col("x_i") * F.col("x_j")).alias("p"),
    ]


def _similarity_sum() -> Column:
    return clamp(F.sum(F.col("v_i") * F.col("v_j"))).alias("sim")


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnsRenamed({"item_id_i": "item_i", "item_id_j": "item_j"})
