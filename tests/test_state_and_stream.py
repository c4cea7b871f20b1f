"""Versioned state, the serving loop, and restarts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsim.operators import increment, prepare
from driftsim.operators.ordering import positions
from driftsim.plans import bootstrap, update
from driftsim.plans.bootstrap import Settings
from driftsim.schemas import RATINGS, STATE
from driftsim.session import distinct_ids, durable
from driftsim.sources import files, folders, views
from driftsim.sources.state import StateStore
from driftsim.streaming import loop, replay

SETTINGS = Settings(k=3, r=4, p=20, alpha=0.05)
ORDER = ["ts", "user_id", "item_id", "rating"]


def bag(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def same(a, b):
    rounded = [
        df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes)) for df in (a, b)
    ]
    return bag(rounded[0]) == bag(rounded[1])


@pytest.fixture(scope="module")
def rows(spark):
    return views.event_ratings(spark, "/root/testdata/sf0.001").cache()


@pytest.fixture(scope="module")
def split(rows):
    """The tail has a new user and a new item."""
    train, test = prepare.split_head_tail(rows, 30)
    test = positions(test, [F.col(c) for c in ORDER], "n")
    user = F.when(F.col("n") % 10 == 3, F.lit(777)).otherwise(F.col("user_id"))
    item = F.when(F.col("n") % 15 == 4, F.lit(888)).otherwise(F.col("item_id"))
    return train.cache(), durable(test.withColumn("user_id", user.cast("long")).withColumn("item_id", item.cast("long")).drop("n"))


def new_store(spark, train, folder, buckets=1):
    store = StateStore(spark, str(folder), buckets)
    store.bootstrap(
        lambda keep: bootstrap.relations(train, SETTINGS, keep),
        lambda base: bootstrap.topr_bootstrap(base, SETTINGS.r + 15),
    )
    return store


def test_state_round_trip(spark, split, tmp_path):
    store = new_store(spark, split[0], tmp_path / "s")
    kept = {name: bag(store.read(name)) for name in STATE}
    assert all(kept.values())
    again = StateStore(spark, str(tmp_path / "s"))
    assert {name: bag(again.read(name)) for name in STATE} == kept
    assert again.load(2).neighbors.agg(F.max("rank")).first()[0] == 2
    with pytest.raises(FileExistsError):
        new_store(spark, split[0], tmp_path / "s")
    # An upsert shows the newest row of each key; an uncommitted version shows nothing.
    changed = store.read("item_info").limit(3).withColumn("n", F.lit(10**6))
    store.write(1, "item_info", changed)
    assert bag(store.read("item_info")) == kept["item_info"]
    store.write(1, "popular", store.read("popular"))
    store.commit(1, 0)
    assert store.read("item_info").filter("n = 1000000").count() == 3
    assert store.read("item_info").count() == len(kept["item_info"])
    store.compact()
    assert store.read("item_info").filter("n = 1000000").count() == 3
    assert bag(store.read("pair_info")) == kept["pair_info"]
    store.truncate()
    assert all(store.read(name).count() == 0 for name in STATE)


def test_stream_equals_folded_batches(spark, split, tmp_path):
    train, test = split
    store = new_store(spark, train, tmp_path / "s", buckets=5)
    staged = replay.stage_replay(test, 15, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    point = str(tmp_path / "point")
    loop.run_loop(store, staged, SETTINGS, [2, 4], point)
    assert store.last() == (2, 0)

    base = bootstrap.relations(train, SETTINGS)
    base = bootstrap.Relations(*(getattr(base, n) for n in ("user_ratings", "item_info", "pair_info", "neighbors", "popular")),
                               recommendations=bootstrap.topr_bootstrap(base, SETTINGS.r + 15))
    batched = prepare.assign_microbatches(test, 15, [F.col(c) for c in ORDER])
    fresh = prepare.last_in_batch(prepare.batch_timestep(batched))
    for b in (1, 2):
        one = fresh.filter(F.col("batch") == b).select("user_id", "item_id", "rating", "position")
        base = update.merged_relations(base, update.apply_batch(base, one, SETTINGS, b, 15))
    for name in ("user_ratings", "item_info", "pair_info", "neighbors", "popular", "recommendations"):
        want, got = getattr(base, name), store.read(name)
        assert same(want.select(*got.columns), got), name
    assert store.read("user_ratings").filter("user_id = 777").count() > 0
    assert store.read("item_info").filter("item_id = 888").count() == 1
    assert store.read("neighbors").filter("item_id = 888").count() == SETTINGS.k

    # The same batch handed in again, as after a crash past the commit, changes nothing.
    before = bag(store.read("pair_info"))
    again = loop.Loop(store, SETTINGS, [2, 4], point)
    again(replay.read_messages(spark, staged).filter("batch = 2"), 1)
    assert store.last() == (2, 0) and bag(store.read("pair_info")) == before
    # A restarted stream goes on with new files only.
    more = test.limit(3).withColumn("ts", F.col("ts") + 10**12)
    replay.stage_replay(more, 3, [F.col(c) for c in ORDER], staged)
    loop.run_loop(store, staged, SETTINGS, [2, 4], point)
    assert store.last() == (3, 0)
    report = loop.run_report(store).collect()
    steps = {f"update {n}" for n in STATE}
    assert {r.phase for r in report} == {"batching", "update"} | steps and all(r.batches == 3 for r in report)
    answers = files.parse_recommendation_messages(store.log("messages"))
    assert answers.filter("cutoff = 2").agg(F.max("rank")).first()[0] <= 2


def test_crash_before_commit_is_repeated(spark, split, tmp_path):
    train, test = split
    store = new_store(spark, train, tmp_path / "s")
    staged = replay.stage_replay(test.limit(5), 5, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    real = store.commit

    def fail(*args):
        raise RuntimeError("lost before commit")

    store.commit = fail
    with pytest.raises(Exception):
        loop.run_loop(store, staged, SETTINGS, [4], str(tmp_path / "point"))
    assert store.last() == (0, 0)
    store.commit = real
    loop.run_loop(store, staged, SETTINGS, [4], str(tmp_path / "point"))
    assert store.last() == (1, 0)
    clean = new_store(spark, train, tmp_path / "clean")
    loop.run_loop(clean, staged, SETTINGS, [4], str(tmp_path / "point2"))
    assert all(same(store.read(n), clean.read(n)) for n in STATE)


def job_count(spark):
    return spark._jsc.sc().dagScheduler().numTotalJobs()


def test_batches_take_few_jobs_and_leave_no_versions(spark, split, tmp_path):
    """A micro-batch is at most 40 jobs, and what it replaces is deleted."""
    train, test = split
    store = StateStore(spark, str(tmp_path / "s"), 3, keep_seconds=0)
    store.bootstrap(lambda keep: bootstrap.relations(train, SETTINGS, keep), lambda base: bootstrap.topr_bootstrap(base, SETTINGS.r + 5))
    staged = replay.stage_replay(test, 7, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    jobs, sizes = [], []

    class Counted(loop.Loop):
        def __call__(self, messages, epoch):
            before, compacted = job_count(spark), store.last()[1]
            super().__call__(messages, epoch)
            if store.last()[1] == compacted:
                jobs.append(job_count(spark) - before)
            kept = [n for part in (*STATE, "changes", "draws", "commits") for n in folders.names(spark, f"{store.folder}/{part}")]
            sizes.append(len(kept))

    handle = Counted(store, SETTINGS, [2, 4], "s", compact_every=2, most_repeats=3)
    replay.run_to_end(replay.microbatch_source(spark, staged), replay.in_order(spark, staged, handle), str(tmp_path / "point"))
    assert len(sizes) == 4 and max(jobs) <= 40
    # One base of each relation, the changes and draws since, and the last commits.
    assert max(sizes) <= len(STATE) + 2 + 1 + 3
    same_in_one = new_store(spark, train, tmp_path / "one", buckets=2)
    loop.run_loop(same_in_one, staged, SETTINGS, [2, 4], str(tmp_path / "point2"), most_repeats=3)
    # Draws go by the version, and a compaction is one, so only these must be equal.
    for name in ("user_ratings", "popular"):
        assert same(store.read(name), same_in_one.read(name)), name
    turns = store.log("served").filter("item_id is not null").groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    assert bag(turns) == bag(store.read("turns"))
    assert turns.agg(F.max("n")).first()[0] <= 3


def test_draws_need_no_scan_of_the_catalogue(spark, split, tmp_path):
    store = new_store(spark, split[0], tmp_path / "s", buckets=2)
    store.write(1, "item_info", store.read("item_info").limit(2).withColumn("item_id", F.col("item_id") + 5000))
    store.write(1, "popular", store.read("popular"))
    store.draw_ahead(6, SETTINGS.seed, 4)
    store.commit(1, 0)
    base = store.relations(drawn_ahead=6)
    for batch, n in ((2, 6), (4, 3), (2, 7), (9, 2)):
        found = base.candidates(n, SETTINGS.seed, batch)
        opened = found.inputFiles()
        assert any("/item_info/" in f for f in opened) == (n > 6 or batch > 4)
        want = increment.drawn(store.read("item_info"), n, SETTINGS.seed, batch)
        assert bag(increment.drawn(found.distinct(), n, SETTINGS.seed, batch)) == bag(want)


def test_few_keys_are_a_filter_of_the_scan(spark, split, tmp_path):
    store = new_store(spark, split[0], tmp_path / "s", buckets=4)
    ids = store.read("item_info").select("item_id").limit(12).collect()
    rows = store.rows_of("item_info", distinct_ids(np.array([r.item_id for r in ids])))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(item_id", plan) and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan)
    assert rows.count() == 12


def test_deletion_cut_short_is_taken_up_again(spark, tmp_path, monkeypatch):
    store = small_store(spark, tmp_path / "s")
    store.keep_seconds = 0
    before = bag(store.read("item_info"))
    store.compact()
    assert bag(store.read("item_info")) == before
    real, seen = folders.delete, []

    def fail(session, path):
        seen.append(path)
        if len(seen) == 2:
            raise RuntimeError("lost while deleting")
        real(session, path)

    monkeypatch.setattr(folders, "delete", fail)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.setattr(folders, "delete", real)
    again = StateStore(spark, store.folder, 3, keep_seconds=0)
    kept = bag(again.read("neighbors"))
    again.compact()
    again.compact()
    assert bag(again.read("neighbors")) == kept
    assert all(len(folders.names(spark, f"{again.folder}/{name}")) == 1 for name in STATE)
    assert folders.names(spark, f"{again.folder}/changes") == []


def test_replaced_versions_stay_for_open_readers(spark, tmp_path):
    store = small_store(spark, tmp_path / "s")
    old = store.relations()
    before = bag(old.pair_info)
    for _ in range(3):
        store.compact()
    assert bag(old.pair_info) == before
    assert len(folders.names(spark, f"{store.folder}/pair_info")) == 4


def test_large_batches_give_the_same_rows(spark, split):
    """The way over written tables and the one over local frames."""
    train, test = split
    base = bootstrap.relations(train, SETTINGS)
    batched = prepare.batch_timestep(prepare.assign_microbatches(test, 30, [F.col(c) for c in ORDER]))
    fresh = prepare.last_in_batch(batched).select("user_id", "item_id", "rating", "position")
    for again in (True, False):
        small, large = (update.apply_batch(base, fresh, SETTINGS, 1, 30, contain_duplicates=again, small=s) for s in (True, False))
        for name in ("user_ratings", "item_info", "pair_info", "neighbors", "popular", "recommendations", "touched", "touched_pairs", "users"):
            got, want = getattr(small, name), getattr(large, name)
            assert same(got.select(*want.columns), want), name


def test_messages_out_of_order_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(n, n, 1.0, n) for n in range(1, 4)], RATINGS)
    folder = replay.stage_replay(rows, 1, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    handle = replay.in_order(spark, folder, lambda messages, epoch: None)
    with pytest.raises(RuntimeError):
        handle(spark.createDataFrame([(2,)], "batch long"), 0)
    # Only the files of the wanted message are opened.
    assert len(replay.read_messages(spark, folder, 2).inputFiles()) == 1


def test_find_reads_only_the_wanted_buckets(spark, split, tmp_path):
    store = new_store(spark, split[0], tmp_path / "s", buckets=12)
    some = durable(store.read("pair_info").select("item_i", "item_j").limit(2))
    found = store.find("pair_info", some, ["item_i", "item_j"])
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([-\d,]+)\)", plan)
    assert len(filters.group(1).split(",")) <= 3
    # A store opened with another number still finds everything.
    other = StateStore(spark, store.folder, 7)
    assert other.find("pair_info", some, ["item_i", "item_j"]).count() == 2


def test_ignore_new(spark, split):
    train, test = split
    base = bootstrap.relations(train, SETTINGS)
    batched = prepare.batch_timestep(prepare.assign_microbatches(test, 30, [F.col(c) for c in ORDER]))
    fresh = prepare.last_in_batch(batched).select("user_id", "item_id", "rating", "position")
    change = update.apply_batch(base, fresh, SETTINGS, 1, 30, ignore_new=True)
    assert change.user_ratings.filter("user_id = 777 OR item_id = 888").count() == 0
    assert change.item_info.filter("item_id = 888").count() == 0


def test_negative_norm_keeps_old_values(spark):
    from driftsim.operators import increment

    info = spark.createDataFrame([(1, 5.0, 3, 1.0)], "item_id long, l double, n long, q double")
    fresh = spark.createDataFrame(
        [(9, 1, 4.0, 2, 2, 3.9, 0.1)],
        "user_id long, item_id long, rating double, timestep long, t long, rubar double, e double",
    )
    profile = spark.createDataFrame([], "user_id long, item_id long, rating double, timestep long")
    got = increment.update_item_info(info, info.select("item_id"), fresh, profile, 0.0).first()
    assert tuple(got) == (1, 5.0, 4, 1.0)


def test_block_log_across_splits(spark, tmp_path):
    text = "# head\nU\t30\tx\nV\t1\t7\t2004-09-21 01:15:53\tn\nV\t-1\t8\t2004-09-21 01:16:53\tn\n\nU\t31\ty\n"
    text += "".join(f"V\t1\t{i}\t2004-09-22 00:00:00\tn\n" for i in range(200))
    (tmp_path / "log.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = files.scan_block_log(spark, str(tmp_path / "log.txt"))
        splits = spark.read.text(str(tmp_path / "log.txt")).select("_metadata.file_block_start").distinct()
        assert splits.count() > 1
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows[:2] == [(30, 7, 1.0, 1095729353), (30, 8, -1.0, 1095729413)]
    assert len(rows) == 202 and all(r[0] == 31 for r in rows[2:])


def test_block_log_in_latin_1(spark, tmp_path):
    text = 'U\t30\tJos\u00e9 "x"\nV\t1\t7\t2004-09-21 01:15:53\t\u00fc\u00df\n\nU\t31\t\u00e9\nV\t-1\t8\t2004-09-21 01:16:53\t\u00e9,"\n'
    (tmp_path / "log.txt").write_bytes(text.encode("latin-1"))
    lines = sorted(r.value for r in files.read_lines(spark, str(tmp_path / "log.txt"), "ISO-8859-1").collect())
    assert lines == sorted(x for x in text.split("\n") if x)
    got = files.ingest_block_log(spark, str(tmp_path / "log.txt"), str(tmp_path / "out"), "ISO-8859-1")
    assert sorted(map(tuple, got.collect())) == [(30, 7, 1.0, 1095729353), (31, 8, -1.0, 1095729413)]


def test_message_formats(spark):
    text = '{"user":{"0":1,"1":2},"item":{"0":10,"1":20},"rating":{"0":4.0,"1":3.5},"unixtimestamp":{"0":100,"1":200}}'
    got = files.parse_columnar_json(spark.createDataFrame([(text,)], "value string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 10, 4.0, 100), (2, 20, 3.5, 200)]
    served = spark.createDataFrame([(5, 30, 2), (5, 20, 1), (6, None, 1)], "user_id long, item_id long, rank int")
    messages = files.recommendation_messages(served)
    assert sorted(r.value for r in messages.collect()) == ['["5","20","30"]', '["6"]']
    back = files.parse_recommendation_messages(messages).select("user_id", "item_id")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(5, 20), (5, 30), (6, None)], key=str)


SMALL = Settings(k=2, r=3, p=3, alpha=0.0)
SMALL_ROWS = [(1, 1, 4.0, 1), (1, 2, 3.0, 2), (2, 1, 5.0, 1), (2, 2, 2.0, 2), (2, 3, 4.0, 3), (3, 3, 1.0, 1), (3, 4, 2.0, 2)]


def small_store(spark, folder):
    train = spark.createDataFrame(SMALL_ROWS, RATINGS)
    store = StateStore(spark, str(folder), 3)
    store.bootstrap(
        lambda keep: bootstrap.relations(train, SMALL, keep), lambda base: bootstrap.topr_bootstrap(base, SMALL.r)
    )
    return store


def test_list_that_ran_empty_is_replaced(spark, tmp_path):
    store = small_store(spark, tmp_path / "s")
    # Items 1, 2 and 3 are popular; user 1 lacks item 3 and then rates it.
    assert {(r.user_id, r.item_id) for r in store.read("recommendations").collect()} == {(1, 3), (3, 1), (3, 2)}
    rows = spark.createDataFrame([(1, 3, 5.0, 10)], RATINGS)
    staged = replay.stage_replay(rows, 1, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    base = store.relations()
    fresh = spark.createDataFrame([(1, 3, 5.0, 1)], "user_id long, item_id long, rating double, position long")
    folded = update.merged_relations(base, update.apply_batch(base, fresh, SMALL, 1, 1))
    assert {r.user_id for r in folded.recommendations.collect()} == {3}
    loop.run_loop(store, staged, SMALL, [2], str(tmp_path / "point"))
    assert {r.user_id for r in store.read("recommendations").collect()} == {3}
    store.compact()
    assert {r.user_id for r in store.read("recommendations").collect()} == {3}


@pytest.mark.parametrize("upsert", [True, False])
def test_rated_again_through_the_loop(spark, tmp_path, upsert):
    store = small_store(spark, tmp_path / "s")
    rows = spark.createDataFrame([(1, 1, 1.0, 10), (1, 1, 2.0, 11)], RATINGS)
    staged = replay.stage_replay(rows, 1, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    loop.run_loop(store, staged, SMALL, [2], str(tmp_path / "point"), contain_duplicates=upsert)
    got = sorted(r.rating for r in store.read("user_ratings").filter("user_id = 1 and item_id = 1").collect())
    assert got == ([2.0] if upsert else [1.0, 2.0, 4.0])
    assert store.read("user_ratings").filter("user_id = 2").count() == 3


def test_replay_goes_by_number(spark, tmp_path):
    rows = spark.createDataFrame([(n, n, 1.0, n) for n in range(1, 8)], RATINGS)
    folder = replay.stage_replay(rows, 2, [F.col(c) for c in ORDER], str(tmp_path / "in"))
    files.parse_columnar_json(replay.read_messages(spark, folder)).createOrReplaceTempView("sent")
    sizes = spark.sql("select batch, count(*) n, min(ts) low from sent group by batch order by batch").collect()
    assert [(r.batch, r.n, r.low) for r in sizes] == [(1, 3, 1), (2, 2, 4), (3, 2, 6)]
    seen = []
    handle = replay.in_order(spark, folder, lambda messages, epoch: seen.append([r.batch for r in messages.collect()]))
    replay.run_to_end(replay.microbatch_source(spark, folder), handle, str(tmp_path / "point"))
    assert seen == [[1], [2], [3]]


def test_replay_takes_runs_of_messages(spark, tmp_path):
    """Several messages a trigger: a folder and a trigger for each run, and every row once, in order."""
    rows = spark.createDataFrame([(n, n, 1.0, n) for n in range(1, 16)], RATINGS)
    folder = replay.stage_runs(rows, 2, [F.col(c) for c in ORDER], 3)
    assert sorted(n for n in folders.names(spark, folder) if "=" in n) == ["run=1", "run=2", "run=3"]
    out = replay.replay_stream(spark, folder, str(tmp_path / "out"), str(tmp_path / "point"))
    assert sorted(n for n in folders.names(spark, str(tmp_path / "out")) if "=" in n) == ["epoch=0", "epoch=1", "epoch=2"]
    # 15 rows in 7 messages, the first of them one row longer.
    want = [(1, 1, 1), (1, 1, 2), (1, 1, 3), *((b, b, t) for b in range(2, 8) for t in (2 * b, 2 * b + 1))]
    assert sorted((r.nth, r.batch, r.ts) for r in out.collect()) == want


def test_watched_batches_are_listed_once(spark):
    from driftsim.operators import evaluate

    rows = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "batch long, item_id long")
    metrics = spark.createDataFrame(
        [(1, 0.0, 5.0), (1, 5.0, 9.0), (2, 10.0, 11.0)], "batch long, started double, ended double"
    )
    got = evaluate.watch_items(rows, metrics, [7])
    assert sorted((r.batch, r.started[-2:], r.ended[-2:]) for r in got.collect()) == [(1, "00", "09"), (2, "10", "11")]


def test_split_keeps_rows_with_nulls(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1.0, None), (None, 1, 1.0, 5), (2, None, 1.0, 5), (2, 2, None, 5), (3, 3, 1.0, 6), (None, None, None, None)], RATINGS
    )
    for tail in range(1, 6):
        head, test = prepare.split_head_tail(rows, tail)
        assert (head.count(), test.count()) == (6 - tail, tail)


def test_latency_percentiles_are_exact(spark):
    from driftsim.operators import evaluate

    rows = spark.createDataFrame([("a", float(n)) for n in range(1, 12)] + [("b", 3.0), (None, 4.0), ("a", None)], "phase string, seconds double")
    got = {r.phase: (r.p50, r.p90, r["max"]) for r in evaluate.latency_summary(rows, "phase", "seconds").collect()}
    assert got == {"a": (6.0, 10.0, 11.0), "b": (3.0, 3.0, 3.0), None: (4.0, 4.0, 4.0)}


def test_pair_tasks_follow_the_pairs(spark):
    from driftsim.operators import pairs
    from driftsim.operators.ordering import GroupSizes

    one = pairs._pair_tasks(spark.range(1), GroupSizes(10, 1e9))
    many = pairs._pair_tasks(spark.range(1), GroupSizes(10, 1e12))
    assert (one, many) == (125, 125_000)


def test_served_item_gives_way_to_the_next(spark):
    from driftsim.operators import recommend

    asked = spark.createDataFrame([(1, 5, 90, n) for n in range(1, 4)] + [(1, 6, 90, 4)], "batch long, user_id long, item_id long, arrival long")
    lists = spark.createDataFrame([(5, 10, 1), (5, 20, 2), (5, 30, 3), (6, 10, 1)], "user_id long, item_id long, rank int")
    before = spark.createDataFrame([(5, 10), (6, 10), (6, 10), (5, None)], "user_id long, item_id long")
    got = recommend.serve_recommendations(asked, lists, [1, 2], 2, before)
    rows = sorted((r.cutoff, r.arrival, r.rank, r.item_id) for r in got.collect())
    assert rows == [
        (1, 1, 1, 10), (1, 2, 1, 20), (1, 3, 1, 30), (1, 4, 1, None),
        (2, 1, 1, 10), (2, 1, 2, 20), (2, 2, 1, 20), (2, 2, 2, 30), (2, 3, 1, 30), (2, 4, 1, None),
    ]
