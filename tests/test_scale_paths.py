"""The routes taken for hot keys and large tables give what the plain routes give."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import Window as W, functions as F

from checks.catalog import shaped
from driftsim.operators import item_lists, pairs, prepare, recommend, stats, trust
from driftsim.operators.ordering import GroupSizes, group_sizes, positions
from driftsim.schemas import RATINGS
from driftsim.session import durable
from driftsim.sources import views

FOLDER = "/root/testdata/sf0.001"


def bag(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def ratings(spark):
    """Events, with one user holding a third of the rows and many equal times."""
    rows = views.event_ratings(spark, FOLDER)
    hot = F.when(F.col("ts") % 3 == 0, F.lit(10_000)).otherwise(F.col("user_id"))
    return rows.withColumn("user_id", hot.cast("long")).withColumn("ts", F.floor(F.col("ts") / 10**10).cast("long")).cache()


def test_positions_in_slices(ratings):
    order = [F.col("ts"), F.col("item_id"), F.col("rating")]
    plain = positions(ratings, order, "pos", ("user_id",))
    sliced = positions(ratings, order, "pos", ("user_id",), limit=50)
    assert bag(plain) == bag(sliced)
    assert bag(positions(ratings, order, "pos")) == bag(positions(ratings, order, "pos", limit=100))


def test_positions_of_equal_rows(ratings):
    same = ratings.select(F.lit(1).alias("a"))
    got = positions(same, [F.col("a")], "pos", limit=100)
    assert sorted(r.pos for r in got.collect()) == list(range(1, ratings.count() + 1))


def test_user_ratings_of_hot_user(ratings):
    assert bag(prepare.user_ratings(ratings)) == bag(prepare.user_ratings(ratings, limit=50))


def test_weighted_ratings_by_window_and_by_join(ratings):
    profile = prepare.user_ratings(ratings).cache()
    joined = bag(stats.weighted_ratings(profile, 0.1))
    window = bag(stats.weighted_ratings(profile, 0.1, largest=1000))
    assert np.allclose(np.array(joined), np.array(window))


@pytest.mark.parametrize("cell_rows", [1, 7, 40])
def test_pair_cells(ratings, cell_rows):
    profile = prepare.user_ratings(ratings).cache()
    assert bag(pairs.co_rated_pairs(profile)) == bag(pairs.co_rated_pairs(profile, cell_rows=cell_rows))


def test_cells_bound_each_join_key(ratings):
    """No (user, cell) holds more than about one chunk from either side."""
    profile = prepare.user_ratings(ratings).cache()
    sizes = group_sizes(profile, ["user_id"])
    assert sizes.largest > 60
    weighted = stats.weighted_ratings(profile, 0.0, sizes.largest)
    plain = bag(pairs.pair_info(weighted, sizes).select("item_i", "item_j", F.round("p", 9)))
    split = bag(pairs.pair_info(weighted, GroupSizes(10**9, 0.0), cell_rows=20).select("item_i", "item_j", F.round("p", 9)))
    assert plain == split


@pytest.mark.parametrize("k", [1, 3, 8])
def test_zero_fill_equals_all_zeros(spark, k):
    rng = random.Random(k)
    ids = rng.sample(range(100), 12)
    explicit = [(a, b, rng.choice([-0.5, 0.0, 0.25, 0.5])) for a in ids for b in ids if a != b and rng.random() < 0.5]
    explicit += [(ids[0], 500, 0.1)]
    listed = ids[:9]
    explicit = [e for e in explicit if e[0] in listed]
    known = {(a, b): s for a, b, s in explicit}
    want = []
    for a in listed:
        row = [(b, known.get((a, b), 0.0)) for b in ids if b != a] + [(b, s) for (x, b), s in known.items() if x == a and b not in ids]
        want += [(a, b, s, r + 1) for r, (b, s) in enumerate(sorted(row, key=lambda x: (-x[1], x[0]))[:k])]
    rows = spark.createDataFrame(explicit, "item_id long, neighbor_id long, sim double")
    ids_df = spark.createDataFrame([(i,) for i in ids], "item_id long")
    listed_df = spark.createDataFrame([(i,) for i in listed], "item_id long")
    got = pairs.topk_neighbors(pairs.with_zero_fill(rows, listed_df, ids_df, k), k)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_asof_join_of_voters_with_few_and_many_votes(spark):
    """A heavy electee meets voters with few votes by what they bring, others by looking them up."""
    seen = {(b, v, (3 * b + v) % 3) for b in range(6) for v in range(8)} | {(b, 9, e) for b in range(6) for e in range(3)}
    deltas = spark.createDataFrame([(*k, float(sum(k) % 3 - 1)) for k in seen], "batch long, voter_id long, electee_id long, vote double")
    want = bag(trust.asof_profile_join(deltas, 1000))
    assert want and all(bag(trust.asof_profile_join(deltas, rows)) == want for rows in (5, 6, 17))


def test_asof_join_light_and_heavy(spark):
    votes = views.event_votes(spark, FOLDER)
    order = [F.col(c) for c in ("ts", "electee_id", "voter_id", "vote")]
    deltas = trust.batch_deltas(prepare.assign_count_batches(votes, 50, order)).cache()
    light = trust.asof_profile_join(deltas, 10_000)
    assert bag(light) == bag(trust.asof_profile_join(deltas, 9)) == bag(trust.asof_profile_join(deltas, 9, limit=1))
    assert light.count() > 1000


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pair_products_follow_the_batch_loop(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(6), rng.randrange(7), rng.choice([-1.0, 0.0, 1.0]), t) for t in range(313)]
    votes = spark.createDataFrame(rows, "electee_id long, voter_id long, vote double, ts long")
    fade = np.exp(-0.6)
    q, p, done = {}, {}, {}
    flush = [rows[i * size - 1 if i else 0 : (i + 1) * size - 1] for i in range(len(rows) // size)]
    for batch in flush:
        now = {}
        for e, v, x, _ in batch:
            now.setdefault(v, {})[e] = x
        for v in now:
            q[v] = sum(x * x for x in now[v].values()) + fade * q.get(v, 0)
        for i in now:
            for j in now:
                if i < j:
                    d = sum(now[i][e] * done.get(j, {}).get(e, 0) for e in now[i])
                    d += sum(now[j][e] * done.get(i, {}).get(e, 0) for e in now[j])
                    d += sum(now[i][e] * now[j].get(e, 0) for e in now[i])
                    p[i, j] = d + fade * p.get((i, j), 0)
        for v in now:
            done.setdefault(v, {}).update(now[v])
    deltas = trust.batch_deltas(prepare.assign_count_batches(votes, size, [F.col("ts")])).cache()
    got_q = {r.voter_id: r.q for r in trust.voter_norms(deltas, 0.3).collect()}
    assert got_q == pytest.approx(q)
    got_p = {(r.voter_i, r.voter_j): r.p for r in trust.pair_products(deltas, 0.3, size).collect()}
    assert all(got_p.get(k, 0.0) == pytest.approx(v, abs=1e-12) for k, v in p.items())
    assert set(got_p) <= set(p)


def test_split_with_equal_rows(spark):
    rows = [(1, 1, 1.0, 5)] * 6 + [(1, 2, 1.0, 9), (1, 3, 1.0, 1)]
    df = spark.createDataFrame(rows, RATINGS)
    for limit in (100, 2):
        head, tail = prepare.split_head_tail(df, 4, limit=limit)
        assert bag(tail) == sorted([(1, 1.0, 5, 1)] * 3 + [(2, 1.0, 9, 1)])
        assert bag(head) == sorted([(1, 1.0, 5, 1)] * 3 + [(3, 1.0, 1, 1)])
    head, tail = prepare.split_head_tail(df, 100)
    assert (head.count(), tail.count()) == (0, 8)


def test_microbatch_sizes(spark):
    df = spark.range(107).select(F.col("id").alias("ts"))
    got = prepare.assign_microbatches(df, 10, [F.col("ts")])
    sizes = [r["count"] for r in got.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [len(x) for x in np.array_split(np.arange(107), 10)]
    assert prepare.assign_microbatches(df, 500, [F.col("ts")]).select("batch").distinct().count() == 1


def test_profiles_in_segments(ratings):
    profile = prepare.user_ratings(ratings).cache()
    nested = stats.user_profiles(profile, segment_rows=10)
    assert nested.agg(F.max(F.size("profile"))).first()[0] == 10
    assert bag(stats.explode_profiles(nested)) == bag(profile)
    items = stats.item_profiles(profile, segment_rows=3)
    assert items.agg(F.max(F.size("profile"))).first()[0] == 3
    assert items.agg(F.sum(F.size("profile"))).first()[0] == profile.count()


def test_neighbour_invariants(ratings):
    profile = prepare.user_ratings(ratings)
    weighted = stats.weighted_ratings(profile, 0.05)
    lists = pairs.topk_neighbors(pairs.mirror_pairs(pairs.pair_similarities(weighted, stats.item_info(weighted))), 5)
    low, high = lists.agg(F.min("sim"), F.max("sim")).first()
    assert -1 <= low <= high <= 1
    assert lists.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 5


def test_bootstrap_ignores_row_order(ratings):
    shuffled = ratings.orderBy(F.rand(3))
    a, b = (stats.weighted_ratings(prepare.user_ratings(x), 0.05) for x in (ratings, shuffled))
    assert bag(a) == bag(b)


def test_cap_repeats_keeps_first_rows(ratings):
    log = ratings.select("user_id", "item_id", F.monotonically_increasing_id().alias("arrival"))
    kept = recommend.cap_repeats(log, 2)
    most = kept.groupBy("user_id", "item_id").count().agg(F.max("count")).first()[0]
    assert most == 2
    rank = F.row_number().over(W.partitionBy("user_id", "item_id").orderBy("arrival"))
    assert bag(kept) == bag(log.withColumn("o", rank).filter("o <= 2").drop("o"))


def shuffled_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def test_neighbours_in_passes(spark):
    """Passes give the lists of one pass, and what one shuffles is gone when its lists are written."""
    rows = spark.range(3000).selectExpr("id % 40 as user_id", "pmod(hash(id), 60) as item_id", "pmod(hash(id, 1), 9) - 4.0 as x")
    weighted = durable(rows.groupBy("user_id", F.col("item_id").cast("long")).agg(F.min("x").cast("double").alias("x"), F.lit(0.1).alias("we")))
    info = durable(stats.item_info(weighted))
    sizes = group_sizes(weighted, ["user_id"])
    want = [tuple(r) for r in pairs.nearest_items(weighted, info, 5, sizes).orderBy("item_id", "rank").collect()]
    assert len(want) == 60 * 5
    for cell_rows in (pairs.CELL_ROWS, 7):
        left = shuffled_files(spark)
        in_passes = pairs.nearest_items(weighted, info, 5, sizes, pass_pairs=round(sizes.squares / 2 / 6), cell_rows=cell_rows)
        for _ in range(50):
            if not shuffled_files(spark) - left:
                break
            time.sleep(0.1)
        assert not shuffled_files(spark) - left
        got = [tuple(r) for r in in_passes.orderBy("item_id", "rank").collect()]
        assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
        assert max(abs(x[2] - y[2]) for x, y in zip(got, want, strict=True)) < 1e-9


@pytest.mark.parametrize("list_rows", [pairs.CELL_ROWS, 7])
def test_neighbours_out_of_user_lists(spark, monkeypatch, list_rows):
    """Where pairs hardly repeat, no sum of a pair is shuffled; the lists are those of the pair join."""
    rows = spark.range(900).selectExpr("id % 40 as user_id", "pmod(hash(id), 300) - 50 as item_id", "pmod(hash(id, 1), 9) - 4.0 as x")
    weighted = durable(rows.groupBy("user_id", F.col("item_id").cast("long")).agg(F.min("x").cast("double").alias("x"), F.lit(0.1).alias("we")))
    info = durable(stats.item_info(weighted))
    sizes = group_sizes(weighted, ["user_id"])
    want = [tuple(r) for r in pairs.nearest_items(weighted, info, 5, sizes).orderBy("item_id", "rank").collect()]
    monkeypatch.setattr(pairs, "pairs_within", None)
    # A pass takes as many pairs as there are ratings.
    found = pairs.nearest_items(weighted, info, 5, sizes, pass_pairs=100, cell_rows=list_rows)
    got = [tuple(r) for r in found.orderBy("item_id", "rank").collect()]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert max(abs(x[2] - y[2]) for x, y in zip(got, want, strict=True)) < 1e-9
    assert found.schema["rank"].dataType.simpleString() == "int"


def test_products_are_summed_in_any_pieces(monkeypatch):
    """Sums of a part, with few products kept at once and with items that do not fit a packed key."""
    rng = np.random.default_rng(2)
    for shift in (0, -9, 1 << 62):
        lists = [[(int(i) + shift, float(rng.integers(-3, 4))) for i in rng.choice(12, 6, replace=False)] for _ in range(30)]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("v", pa.float64())]))
        entries = [[{"item_id": i, "v": v} for i, v in own] for own in lists]
        batches = [pa.record_batch([pa.array(entries[a : a + 4], kind), pa.nulls(len(entries[a : a + 4]), kind)], ["rated", "others"]) for a in range(0, 30, 4)]
        want = {}
        for own in lists:
            for i, v in own:
                for j, w in own:
                    if i != j:
                        want[i, j] = want.get((i, j), 0.0) + v * w
        best = {i: sorted((-min(1.0, max(-1.0, s)), j) for (a, j), s in want.items() if a == i)[:3] for i, _ in want}
        for chunk in (1, 50, 1 << 21):
            monkeypatch.setattr(item_lists, "CHUNK_PRODUCTS", chunk)
            found = {}
            for nth in range(2):
                dealt = list(item_lists._dealt(iter(batches), nth, 2, 3))
                for part in range(3):
                    mine = [b.filter(pa.compute.equal(b.column("part"), part)) for b in dealt]
                    for item, other, sim, rank in zip(*(c.to_pylist() for c in item_lists._ranked(iter(mine), 3).columns)) if mine else ():
                        found.setdefault(item, []).append((rank, -sim, other))
            assert {i: [x[1:] for x in sorted(rows)] for i, rows in found.items()} == best


def test_whole_values_are_not_rounded(spark):
    """Doubles come out rounded to 6 digits, and a decimal is made only of those that are not whole."""
    values = [-1.0, 0.0, -0.0, 4.0, 1e15, 1e300, 0.1, -2.5000005, 1234567.1234565, 1e-7, -1e-7, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = shaped(df, "x:d")
    plain = df.select((F.round("x", 6) + F.lit(0.0)).alias("x"))
    assert [str(r.x) for r in got.collect()] == [str(r.x) for r in plain.collect()]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == plan.count("ELSE round(") == 1
