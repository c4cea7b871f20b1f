"""Trust batch by batch against the closed form over all batches."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftsim.operators import trust, voter_blocks
from driftsim.plans import trust as plans
from driftsim.plans.trust import TrustSettings
from driftsim.sources import folders, state

SETTINGS = TrustSettings(k=4, alpha=0.2, batch_rows=12)


@pytest.fixture(scope="module")
def deltas(spark):
    rng = random.Random(8)
    rows = {(b, rng.randrange(9), rng.randrange(5)): rng.choice([1.0, -1.0, 0.0]) for b in range(5) for _ in range(12)}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], "batch long, voter_id long, electee_id long, vote double").persist()


def stepwise(rows, alpha):
    """The recurrences one batch after another in plain Python."""
    fade, votes, q, p = math.exp(-2 * alpha), {}, {}, {}
    for b in sorted({r.batch for r in rows}):
        batch = [r for r in rows if r.batch == b]
        present, dq, dp = {r.voter_id for r in batch}, {}, {}
        for r in batch:
            dq[r.voter_id] = dq.get(r.voter_id, 0) + r.vote**2
            for other in present - {r.voter_id}:
                if (other, r.electee_id) in votes:
                    key = tuple(sorted((other, r.voter_id)))
                    dp[key] = dp.get(key, 0) + r.vote * votes[other, r.electee_id]
            for s in batch:
                if s.electee_id == r.electee_id and s.voter_id < r.voter_id:
                    dp[s.voter_id, r.voter_id] = dp.get((s.voter_id, r.voter_id), 0) + r.vote * s.vote
        for v in present:
            q[v] = dq[v] + fade * q.get(v, 0)
        for key in {k for k in p if set(k) <= present} | set(dp):
            p[key] = dp.get(key, 0) + fade * p.get(key, 0)
        votes |= {(r.voter_id, r.electee_id): r.vote for r in batch}
    return votes, q, p


def found(store):
    votes = {(r.voter_id, r.electee_id): r.vote for r in store.read("applied_votes").collect()}
    q = {r.voter_id: r.q for r in store.read("voter_norms").collect()}
    return votes, q, {(r.voter_i, r.voter_j): r.p for r in store.read("voter_products").collect()}


def close(a, b):
    return set(a) == set(b) and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


@pytest.mark.parametrize("history, buckets", [(-1, 1), (1, 3)])
def test_batches_equal_the_closed_form(spark, deltas, tmp_path, history, buckets):
    store = plans.trust_store(spark, str(tmp_path / "s"), buckets, keep_seconds=0)
    plans.start_trust(store, deltas.filter(F.col("batch") <= history), SETTINGS)
    rows = deltas.collect()
    for b in range(history + 1, 5):
        plans.apply_trust_batch(store, deltas.filter(F.col("batch") == b), SETTINGS, "votes", b, compact_every=2)
        so_far = deltas.filter(F.col("batch") <= b)
        got, want = found(store), stepwise([r for r in rows if r.batch <= b], SETTINGS.alpha)
        assert all(map(close, got, want))
    closed = {(r.voter_i, r.voter_j): r.p for r in trust.pair_products(so_far, SETTINGS.alpha, SETTINGS.batch_rows).collect()}
    assert close(got[2], closed)
    joined = {(r.voter_i, r.voter_j): r.p for r in trust.pair_products(so_far, SETTINGS.alpha, SETTINGS.batch_rows, mask_bytes=0).collect()}
    assert close(got[2], joined)
    # A batch handed in again does nothing, and no replaced version is left.
    version = store.last()
    plans.apply_trust_batch(store, deltas.filter("batch = 4"), SETTINGS, "votes", 4)
    assert store.last() == version
    assert len(folders.names(spark, f"{store.folder}/voter_products")) <= 2
    voters = deltas.select("voter_id")
    lists = plans.stored_trust_lists(store, voters, SETTINGS)
    same = plans.trust_incremental_knn(voters, SETTINGS, deltas)
    rounded = [sorted((r.voter_id, r.neighbor_id, round(r.sim, 9), r["rank"]) for r in x.collect()) for x in (lists, same)]
    assert rounded[0] == rounded[1]


def test_masks_of_many_words(spark):
    """Batches far apart: both ways of counting the later common ones."""
    rng = random.Random(3)
    rows = {(rng.choice([0, 1, 61, 62, 63, 123, 124, 186, 300]), rng.randrange(7), rng.randrange(4)): rng.choice([1.0, -1.0]) for _ in range(120)}
    deltas = spark.createDataFrame([(*k, v) for k, v in rows.items()], "batch long, voter_id long, electee_id long, vote double").persist()
    want = stepwise(deltas.collect(), 0.1)[2]
    for size in (trust.MASK_BYTES, 0):
        got = {(r.voter_i, r.voter_j): r.p for r in trust.pair_products(deltas, 0.1, 50, mask_bytes=size).collect()}
        assert close(got, want)


def test_null_and_empty_batches(spark, tmp_path):
    store = plans.trust_store(spark, str(tmp_path / "s"))
    none = spark.createDataFrame([], "batch long, voter_id long, electee_id long, vote double")
    plans.start_trust(store, none, SETTINGS)
    plans.apply_trust_batch(store, none, SETTINGS)
    assert store.last() == (1, 0) and found(store) == ({}, {}, {})


@pytest.mark.parametrize("block", [2, 4, 100])
def test_blocks_of_voters_equal_the_loop(spark, deltas, block):
    """Whole lists and products by blocks, with a voter who never voted in a whole batch."""
    rows = deltas.collect()
    votes, q, p = stepwise(rows, 0.2)
    pairs = voter_blocks.block_products(deltas, 0.2, block)
    assert close({(r.voter_i, r.voter_j): r.p for r in pairs.collect()}, p)
    voters = deltas.select("voter_id").unionByName(spark.createDataFrame([(77,), (None,)], "voter_id long"))
    for size in (3, 50):
        lists = trust.best_of(voter_blocks.block_lists(deltas, voters, 0.2, size, block), size)
        exact = trust.best_of(voter_blocks.exact_lists(trust.applied_profiles(deltas), voters, size, block), size)
        dot = lambda a, b: sum(x * votes.get((b, e), 0) for (v, e), x in votes.items() if v == a)
        plain = [{(r.voter_id, r.neighbor_id): r.sim for r in x.collect()} for x in (lists, exact)]
        for found, product, norm in ((plain[0], lambda a, b: p.get((min(a, b), max(a, b)), 0), lambda a: q.get(a, 0)), (plain[1], dot, lambda a: dot(a, a))):
            want = {}
            for a in [*q, 77]:
                root = lambda b: math.sqrt(norm(a)) * math.sqrt(norm(b))
                sims = {b: product(a, b) / root(b) if root(b) else 0.0 for b in [*q, 77] if b != a}
                want |= {(a, b): sims[b] for b in sorted(sims, key=lambda b: (-round(sims[b], 9), b))[:size]}
            assert close(found, want)


def test_many_voters_are_summed_in_blocks(spark, deltas, monkeypatch):
    """Where all meet, no pair of votes is made; results are those of the joins."""
    joined = {(r.voter_i, r.voter_j): r.p for r in trust.pair_products(deltas, 0.2, 12).collect()}
    lists = [plans.trust_incremental_knn(deltas, SETTINGS, deltas).collect()]
    monkeypatch.setattr(trust, "BLOCKED", 2)
    monkeypatch.setattr(trust, "vote_products", None)
    assert close({(r.voter_i, r.voter_j): r.p for r in trust.pair_products(deltas, 0.2, 12).collect()}, joined)
    monkeypatch.setattr(voter_blocks, "TABLE_CELLS", 0)
    lists.append(plans.trust_incremental_knn(deltas, SETTINGS, deltas).collect())
    a, b = (sorted((r.voter_id, r.neighbor_id, round(r.sim, 9), r["rank"]) for r in x) for x in lists)
    assert a == b


def random_votes(rng, voters, batches, rows):
    found = {(rng.randrange(batches) * 3, rng.choice(voters), rng.choice([None, 0, 1, 2])): rng.choice([1.0, -1.0, 0.0]) for _ in range(rows)}
    return [(*k, v) for k, v in found.items()]


def block_of(rows, voters, fade):
    """The votes of some voters, packed and unpacked."""
    mine = [r for r in rows if r[1] in voters]
    mine += [(None, v, None, None) for v in voters if v not in {r[1] for r in mine}]
    columns = [pa.array(c, t) for c, t in zip(zip(*mine), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
    table = pa.table(columns, ["batch", "voter_id", "electee_id", "vote"])
    return voter_blocks.unpack(voter_blocks.pack(0, table, fade).to_batches()[0], 0)


@pytest.mark.parametrize("seed", range(4))
def test_batches_of_few_pairs_are_applied_many_at_once(monkeypatch, seed):
    """One batch after another, and all pairs of many batches in order: the same products and lists."""
    rng = random.Random(seed)
    rows = random_votes(rng, range(20), 9, 90)
    blocks = [block_of(rows, range(0, 12), 0.6), block_of(rows, range(12, 22), 0.6)]
    for sides in ((blocks[0], None), (blocks[0], blocks[1])):
        found = []
        for few, chunk, times, positive in ((0, 1, 16, 0), (10**9, 1, 16, 1), (10**9, 40, 0, 0), (10**9, 10**6, 16, 1)):
            for name, value in (("FEW_PAIRS", few), ("CHUNK_PAIRS", chunk), ("FEW_TIMES", times), ("POSITIVE", positive)):
                monkeypatch.setattr(voter_blocks, name, value)
            products = voter_blocks.Products(*sides, 0.6, True)
            lists = sorted((*r, round(s, 9)) for b in products.best(3) for *r, s in zip(*(c.to_pylist() for c in b.columns)))
            pairs = {(i, j): p for b in products.met_pairs() for i, js, ps in zip(*(c.to_pylist() for c in b.columns)) for j, p in zip(js, ps)}
            found.append((lists, pairs))
        for lists, pairs in found[1:]:
            assert lists == found[0][0] and close(pairs, found[0][1])


def test_passes_over_the_blocks(spark, deltas):
    """A pass shuffles so many copies of the packed votes, one row a block, and all passes give the whole."""
    rows, fade = deltas.collect(), 0.2
    parts = voter_blocks.block_product_parts(deltas, fade, 2, copies=2)
    found = {}
    for part in parts:
        some = {(r.voter_i, j): p for r in part.collect() for j, p in zip(r.voter_j, r.p)}
        assert not set(some) & set(found)
        found |= some
    # Five blocks make fifteen pairs of blocks, and two copies of the votes are five of these.
    assert len(parts) == 3 and close(found, stepwise(rows, fade)[2])
    lists = [trust.best_of(voter_blocks.block_lists(deltas, deltas, fade, 3, 2, copies=n), 3) for n in (2, 100)]
    a, b = (sorted((r.voter_id, r.neighbor_id, round(r.sim, 9), r["rank"]) for r in x.collect()) for x in lists)
    assert a == b


@pytest.mark.parametrize("local_rows", [10, 200_000])
def test_state_in_lists(spark, deltas, tmp_path, monkeypatch, local_rows):
    """Products of many voters are stored in lists as made, and ranked there: no pair is stored again."""
    monkeypatch.setattr(trust, "BLOCKED", 2)
    monkeypatch.setattr(state, "LOCAL_ROWS", local_rows)
    store = plans.trust_store(spark, str(tmp_path / "s"), 3, keep_seconds=0)
    plans.start_trust(store, deltas.filter("batch <= 2"), SETTINGS)
    assert folders.exists(spark, f"{store.folder}/voter_products/v=0/{state.PACKED}")
    rows, voters = deltas.collect(), deltas.select("voter_id").unionByName(spark.createDataFrame([(77,)], "voter_id long"))
    monkeypatch.setattr(trust, "trust_neighbors", None)
    for b in (None, 3, 4):
        if b:
            plans.apply_trust_batch(store, deltas.filter(F.col("batch") == b), SETTINGS, "votes", b)
        so_far = deltas.filter(F.col("batch") <= (b or 2))
        assert all(map(close, found(store), stepwise([r for r in rows if r.batch <= (b or 2)], SETTINGS.alpha)))
    lists = plans.stored_trust_lists(store, voters, SETTINGS)
    same = plans.trust_incremental_knn(voters, SETTINGS, so_far)
    rounded = [sorted((r.voter_id, r.neighbor_id, round(r.sim, 9), r["rank"]) for r in x.collect()) for x in (lists, same)]
    assert rounded[0] == rounded[1]
    # Compacted, they are rows again.
    store.compact()
    assert close(found(store)[2], stepwise(rows, SETTINGS.alpha)[2])
    assert not folders.exists(spark, f"{store.folder}/voter_products/v=3/{state.PACKED}")


def test_nearest_sifts_as_it_goes():
    """The best of each voter, whatever is sifted when; who has no norm is left out."""
    rng = np.random.default_rng(4)
    ids, q = np.array([2, 5, 7, 11, 30]), np.array([1.0, 4.0, 2.0, 1.0, 9.0])
    pairs = [(i, j, float(rng.integers(-3, 4))) for n, i in enumerate([2, 3, 5, 7, 11, 30]) for j in [2, 3, 5, 7, 11, 30][n + 1 :]]
    root = dict(zip(ids.tolist(), np.sqrt(q)))
    want = {}
    for i, j, p in pairs:
        if 3 not in (i, j):
            want.setdefault(i, []).append((-round(p / root[i] / root[j], 9), j))
            want.setdefault(j, []).append((-round(p / root[i] / root[j], 9), i))
    for at_once in (0, 3, 100):
        best = voter_blocks.Nearest(ids, q, 2, at_once)
        for start in range(0, len(pairs), 4):
            best.add(*map(np.array, zip(*pairs[start : start + 4])))
        got = {}
        for voter, other, sim in zip(*(c.to_pylist() for c in best.rows().columns)):
            got.setdefault(voter, []).append((-round(sim, 9), other))
        assert {v: sorted(x) for v, x in got.items()} == {v: sorted(x)[:2] for v, x in want.items()}
