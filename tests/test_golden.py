"""Small tables with known results."""

import pytest
from pyspark.sql import functions as F

from driftsim.operators import increment, pairs, prepare, recommend, stats, trust
from driftsim.operators.prepare import assign_count_batches
from driftsim.schemas import RATINGS, VOTES

ALPHA = 0.1
ROWS = [
    (1, 10, 5.0, 100), (1, 20, 3.0, 200), (1, 30, 4.0, 300), (2, 10, 4.0, 110), (2, 20, 2.0, 120),
    (3, 20, 5.0, 50), (3, 30, 1.0, 60), (3, 10, 2.0, 70), (4, 30, 5.0, 10), (1, 20, 1.0, 150),
]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-8)


@pytest.fixture(scope="module")
def profile(spark):
    return prepare.user_ratings(spark.createDataFrame(ROWS, RATINGS)).cache()


@pytest.fixture(scope="module")
def state(profile):
    weighted = stats.weighted_ratings(profile, ALPHA)
    return profile, stats.item_info(weighted).cache(), pairs.pair_info(weighted).cache()


def test_profiles_and_stats(profile):
    assert rows(profile, "user_id", "timestep") == [
        (1, 10, 5.0, 1), (1, 20, 3.0, 2), (1, 30, 4.0, 3), (2, 10, 4.0, 1), (2, 20, 2.0, 2),
        (3, 20, 5.0, 1), (3, 30, 1.0, 2), (3, 10, 2.0, 3), (4, 30, 5.0, 1),
    ]
    near(
        rows(stats.user_stats(profile), "user_id"),
        [(1, 3, 4, 0), (2, 2, 3, -1), (3, 3, 8 / 3, -1 / 3), (4, 1, 5, 5)],
    )


def test_item_and_pair_info(state):
    _, info, sums = state
    near(
        rows(info, "item_id"),
        [(10, -0.596508531, 3, 1.933495244), (20, 0.478639964, 3, 5.468251004), (30, 0.454850418, 3, 2.274252092)],
    )
    near(
        rows(sums, "item_i", "item_j"),
        [
            (10, 20, -0.722897251, 0.268046832, -2.919236810),
            (10, 30, 0.201074982, 0.502687454, 1.005374909),
            (20, 30, -0.576191949, 0.411565678, -2.880959747),
        ],
    )
    near(
        rows(pairs.similarity_of_pairs(sums, info).drop("p"), "item_i", "item_j"),
        [(10, 20, -0.897787495), (10, 30, 0.479443226), (20, 30, -0.816946597)],
    )


def test_both_similarity_routes_agree(profile, state):
    weighted = stats.weighted_ratings(profile, ALPHA)
    direct = pairs.pair_similarities(weighted, state[1])
    near(rows(direct, "item_i", "item_j"), rows(pairs.similarity_of_pairs(state[2], state[1]).drop("p"), "item_i", "item_j"))


def test_prediction(spark, profile, state):
    sims = pairs.similarity_of_pairs(state[2], state[1])
    lists = pairs.topk_neighbors(pairs.mirror_pairs(sims), 5)
    asked = spark.createDataFrame([(2, 30), (4, 10)], "user_id long, item_id long")
    got = recommend.predict_observations(asked, profile, lists).select("user_id", "item_id", "pred")
    near(rows(got, "user_id"), [(2, 30, 4.0), (4, 10, 5.0)])


def test_one_microbatch(spark, state):
    profile, info, sums = state
    fresh = spark.createDataFrame(
        [(2, 30, 5.0, 1), (5, 10, 4.0, 1), (5, 20, 2.0, 2)],
        "user_id long, item_id long, rating double, position long",
    )
    clocked = increment.clocked(fresh, stats.running_user_mean(profile, fresh))
    touched = info.select("item_id")
    new_info = increment.update_item_info(info, touched, clocked, profile, ALPHA)
    near(
        rows(new_info, "item_id"),
        [(10, 2.511620121, 4, 3.559771774), (20, -2.608122742, 4, 4.693270746), (30, 1.261288914, 4, 2.894977855)],
    )
    met = increment.fresh_prev_pairs(clocked, profile, touched, ALPHA)
    new_sums = increment.update_pair_info(sums, sums.select("item_i", "item_j"), met, ALPHA)
    near(
        rows(new_sums, "item_i", "item_j"),
        [
            (10, 20, 2.408141790, -2.780541815, -3.017668926),
            (10, 30, 0.346566439, 1.139326348, 0.610819742),
            (20, 30, -1.477120978, 1.141261405, -4.234695570),
        ],
    )
    sims = pairs.similarity_of_pairs(new_sums, new_info).drop("p")
    near(rows(sims, "item_i", "item_j"), [(10, 20, -0.738282729), (10, 30, 0.190273963), (20, 30, -1)])


VOTES_ROWS = [
    (1, 1, 1), (1, 2, 1), (2, 1, -1), (2, 2, -1), (1, 3, -1), (2, 3, 1), (3, 1, 1), (3, 2, 0), (1, 2, -1),
    (3, 3, 1), (2, 1, 1), (3, 1, -1), (2, 2, 1),
]


@pytest.mark.parametrize("limit,batch_rows", [(1000, 1000), (1, 1)])
def test_trust(spark, limit, batch_rows):
    votes = spark.createDataFrame([(e, v, float(x), t) for t, (e, v, x) in enumerate(VOTES_ROWS)], VOTES)
    batched = assign_count_batches(votes, 4, [F.col("ts")], limit)
    assert [r.batch for r in batched.orderBy("arrival").collect()] == [0] * 3 + [1] * 4 + [2] * 4
    deltas = trust.batch_deltas(batched).cache()
    assert rows(trust.pair_deltas(deltas, batch_rows, limit).select("batch", "voter_i", "voter_j", "dp"), "batch", "voter_i", "voter_j") == [
        (0, 1, 2, 1), (1, 1, 2, 1), (1, 1, 3, -2), (1, 2, 3, -2), (2, 1, 2, -2), (2, 1, 3, 2), (2, 2, 3, 1),
    ]
    norms = trust.voter_norms(deltas, 0.3, limit)
    near(rows(norms, "voter_id"), [(1, 2.151200060), (2, 1.850005848), (3, 2.097623272)])
    products = trust.pair_products(deltas, 0.3, batch_rows, limit)
    near(rows(products, "voter_i", "voter_j"), [(1, 2, -1.149994152), (1, 3, 0.902376728), (2, 3, -0.097623272)])
    lists = trust.trust_neighbors(products, norms, votes, 2).select("voter_id", "neighbor_id", "sim", "rank")
    near(
        rows(lists, "voter_id", "rank"),
        [
            (1, 3, 0.424799248, 1), (1, 2, -0.576459341, 2), (2, 3, -0.049556778, 1), (2, 1, -0.576459341, 2),
            (3, 1, 0.424799248, 1), (3, 2, -0.049556778, 2),
        ],
    )
    assert rows(trust.applied_profiles(deltas), "voter_id", "electee_id") == [
        (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, -1), (2, 2, -1), (2, 3, 0), (3, 1, -1), (3, 2, 1), (3, 3, 1),
    ]
