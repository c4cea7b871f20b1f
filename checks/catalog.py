"""Every query by name: its output columns, its Spark form and, where SQL can say it, its SQL form.

A column spec names the columns and their kinds: l(ong), d(ouble, 6 digits), s(tring).
"""

from dataclasses import replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from checks import oracle as sql
from driftsim.functions import scoring
from driftsim.operators import evaluate, increment, keys, pairs, prepare, recommend, stats, trust
from driftsim.operators.ordering import positions
from driftsim.plans import bootstrap, trust as trust_plans, update
from driftsim.plans.bootstrap import Relations, Settings
from driftsim.plans.trust import VOTE_ORDER, TrustSettings
from driftsim.schemas import RATINGS, STATE
from driftsim.session import durable, scratch_path
from driftsim.sources import files, views
from driftsim.sources.state import StateStore
from driftsim.streaming import loop, replay

SETTINGS = Settings(k=sql.K, r=sql.R, p=sql.P, alpha=sql.ALPHA, seed=sql.SEED)
TRUST = TrustSettings(k=sql.TRUST_K, alpha=sql.TRUST_ALPHA, batch_rows=sql.TRUST_BATCH)
ORDER = ["ts", "user_id", "item_id"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, spec: str, body: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shaped(fn(spark, folder), spec)

        QUERIES[name] = run
        if body is not None:
            ORACLE[name] = sql.statement(spec, body)
        return fn

    return register


def shaped(df: DataFrame, spec: str) -> DataFrame:
    columns = []
    for name, kind in (c.split(":") for c in spec.split()):
        column = F.col(name)
        if kind == "l":
            column = column.cast("long")
        elif kind == "d":
            # Rounding goes through a decimal, which takes longer than making a row of a pair
            # join: values that are whole already, as votes and ratings are, skip it.
            column = column.cast("double")
            column = F.when(column == F.rint(column), column).otherwise(F.round(column, 6)) + F.lit(0.0)
        else:
            column = column.cast("string")
        columns.append(column.alias(name))
    return df.select(*columns)


# ---------------------------------------------------------------- shared inputs


def ratings(spark, folder):
    return views.event_ratings(spark, folder)


def split(spark, folder):
    """Ratings but the last ones, and the last ones in arrival order."""
    train, test = prepare.split_head_tail(ratings(spark, folder), sql.TAIL, ORDER)
    return train, positions(test, [F.col(c) for c in [*ORDER, "rating"]], "arrival", largest=sql.TAIL)


def slices(spark, folder):
    """The first of many equal slices of the table, and the rest."""
    rows = ratings(spark, folder)
    size = max(1, rows.count() // sql.SLICES)
    cut = prepare.assign_microbatches(rows, size, [F.col(c) for c in ORDER])
    return cut.filter("batch = 1").select(*RATINGS.names), cut.filter("batch > 1")


def profile(spark, folder):
    return prepare.user_ratings(ratings(spark, folder))


def weighted(spark, folder):
    return stats.weighted_ratings(profile(spark, folder), sql.ALPHA)


@cache
def _relations(spark, folder, part) -> Relations:
    rows = ratings(spark, folder) if part == "all" else split(spark, folder)[0]
    return bootstrap.relations(rows, SETTINGS)


def whole(spark, folder) -> Relations:
    """Relations of all ratings, written once per session and table folder."""
    return _relations(spark, folder, "all")


def before(spark, folder) -> Relations:
    """Relations before the last micro-batch."""
    return _relations(spark, folder, "train")


def fresh(spark, folder):
    test = split(spark, folder)[1].withColumn("batch", F.lit(1))
    rows = prepare.last_in_batch(prepare.batch_timestep(test))
    return rows.select("user_id", "item_id", "rating", "position")


def clocked(spark, folder):
    rows = fresh(spark, folder)
    return increment.clocked(rows, stats.running_user_mean(before(spark, folder).user_ratings, rows))


@cache
def _change(spark, folder) -> update.Update:
    return update.apply_batch(before(spark, folder), fresh(spark, folder), SETTINGS, 1, sql.TAIL)


def known_items(base, rows):
    """The items of the state and of the batch."""
    return base.item_info.select("item_id").unionByName(rows.select("item_id")).distinct()


def pool(spark, folder):
    base = before(spark, folder)
    known = known_items(base, fresh(spark, folder))
    return increment.candidates(clocked(spark, folder), base.neighbors, known, sql.K, sql.SEED, 1)


def flat_profile(name: str) -> str:
    return f"user_id:l item_id:l rating:d {name}:l"


RATING_SPEC = "user_id:l item_id:l rating:d ts:l"
STEP_SPEC = "user_id:l item_id:l rating:d timestep:l"
NEIGHBOR_SPEC = "item_id:l neighbor_id:l sim:d rank:l"
REC_SPEC = "user_id:l item_id:l pred:d rank:l"
INFO_SPEC = "item_id:l l:d n:l q:d"
PAIR_SPEC = "item_i:l item_j:l l_i:d l_j:d p:d"

# ---------------------------------------------------------------- sources and sinks


@query("scan_ratings", RATING_SPEC, "SELECT * FROM r1")
def _(spark, folder):
    path = scratch_path(spark, "csv")
    ratings(spark, folder).write.csv(path)
    return files.scan_ratings(spark, path)


@query("ingest_delimited", RATING_SPEC, "SELECT * FROM r1")
def _(spark, folder):
    source, target = scratch_path(spark, "tsv"), scratch_path(spark, "csv")
    ratings(spark, folder).write.option("sep", "\t").csv(source)
    return files.ingest_delimited(spark, source, target)


def placed_in_files(rows):
    """Rows read from files with their place ``nth`` in them, file by file."""
    where = rows.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    numbered = durable(where.withColumn("i", F.monotonically_increasing_id()))
    return positions(numbered, [F.col("f"), F.col("b"), F.col("i")], "nth", unique=True)


BY_TIME = "SELECT row_number() OVER (ORDER BY ts, user_id, item_id, rating) AS nth, * FROM r1"


@query("ingest_delimited_order", f"nth:l {RATING_SPEC}", BY_TIME)
def _(spark, folder):
    source, target = scratch_path(spark, "tsv"), scratch_path(spark, "csv")
    ratings(spark, folder).write.option("sep", "\t").csv(source)
    return placed_in_files(files.ingest_delimited(spark, source, target))


def stage_block_log(spark, folder) -> str:
    """The votes as a block log; a popular electee has several blocks."""
    path = scratch_path(spark, "log")
    votes = views.event_votes(spark, folder).withColumn("block", F.col("voter_id") % 16)
    when = F.from_unixtime(F.floor(F.col("ts") / 1_000_000))
    line = F.concat_ws("\t", F.lit("V"), F.col("vote").cast("int"), "voter_id", when, F.lit("name"))
    body = votes.select("electee_id", "block", F.lit(1).alias("part"), line.alias("line"))
    head = votes.select("electee_id", "block").distinct().select(
        "electee_id", "block", F.lit(0).alias("part"), F.concat(F.lit("U\t"), "electee_id", F.lit("\tname")).alias("line")
    )
    where = ["electee_id", "block"]
    lines = body.unionByName(head).repartition(*where).sortWithinPartitions(*where, "part", "line")
    lines.select("line").write.text(path)
    return path


@query(
    "ingest_block_log",
    "electee_id:l voter_id:l vote:d ts:l",
    "SELECT electee_id, voter_id, vote, ts // 1000000 AS ts FROM v1",
)
def _(spark, folder):
    return files.ingest_block_log(spark, stage_block_log(spark, folder), scratch_path(spark, "votes"))


@query(
    "ingest_block_log_order",
    "nth:l electee_id:l voter_id:l vote:d ts:l",
    """SELECT row_number() OVER (ORDER BY ts, electee_id, voter_id, vote) AS nth, *
       FROM (SELECT electee_id, voter_id, vote, ts // 1000000 AS ts FROM v1)""",
)
def _(spark, folder):
    return placed_in_files(files.ingest_block_log(spark, stage_block_log(spark, folder), scratch_path(spark, "votes")))


@query(
    "carry_forward",
    "electee_id:l votes:l voters:l",
    "SELECT electee_id, count(*) AS votes, count(DISTINCT voter_id) AS voters FROM v1 GROUP BY 1",
)
def _(spark, folder):
    rows = files.scan_block_log(spark, stage_block_log(spark, folder))
    return rows.groupBy("electee_id").agg(
        F.count(F.lit(1)).alias("votes"), F.countDistinct("voter_id").alias("voters")
    )


STATE_BUCKETS = 8


def stored_state(spark, folder) -> StateStore:
    store = StateStore(spark, scratch_path(spark, "state"), STATE_BUCKETS)
    store.bootstrap(
        lambda keep: bootstrap.relations(ratings(spark, folder), SETTINGS, keep),
        lambda base: bootstrap.topr_bootstrap(base, SETTINGS.r),
    )
    return store


STATE_SIZES = """
    SELECT 'user_ratings' AS relation, count(*) AS n_rows FROM f_prof
    UNION ALL SELECT 'item_info', count(*) FROM f_info UNION ALL SELECT 'pair_info', count(*) FROM f_sums
    UNION ALL SELECT 'neighbors', count(*) FROM f_nb UNION ALL SELECT 'popular', count(*) FROM f_pop
    UNION ALL SELECT 'recommendations', count(*) FROM f_recs"""


def state_sizes(store: StateStore) -> DataFrame:
    out = None
    for name in STATE:
        one = store.read(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("state_store", "relation:s n_rows:l", STATE_SIZES)
def _(spark, folder):
    return state_sizes(stored_state(spark, folder))


@query("state_load", NEIGHBOR_SPEC, "SELECT * FROM f_nb WHERE rank <= 3")
def _(spark, folder):
    return stored_state(spark, folder).load(3).neighbors


@query("state_resume", INFO_SPEC, "SELECT * FROM f_info")
def _(spark, folder):
    left = stored_state(spark, folder).folder
    return StateStore(spark, left).relations().item_info


@query(
    "table_define_truncate",
    "relation:s rows_before:l rows_after:l",
    f"SELECT relation, n_rows AS rows_before, 0 AS rows_after FROM ({STATE_SIZES})",
)
def _(spark, folder):
    store = stored_state(spark, folder)
    sizes = state_sizes(store).withColumnRenamed("n_rows", "rows_before")
    store.truncate()
    return sizes.join(state_sizes(store).withColumnRenamed("n_rows", "rows_after"), "relation")


@query("key_lookup_in", STEP_SPEC, "SELECT * FROM t_prof WHERE user_id IN (SELECT user_id FROM test)")
def _(spark, folder):
    users = split(spark, folder)[1].select("user_id").distinct()
    return keys.lookup(before(spark, folder).user_ratings, users, ["user_id"])


@query("scan_project", "item_id:l n:l", "SELECT item_id, n FROM f_info")
def _(spark, folder):
    return whole(spark, folder).item_info.select("item_id", "n")


@query("upsert_by_key", RATING_SPEC, "SELECT * FROM f_clean")
def _(spark, folder):
    train, test = split(spark, folder)
    return keys.upsert(
        prepare.latest_rating(train), prepare.latest_rating(test), ["user_id", "item_id"]
    )


REPLAY_ROWS = 100  # of a message, whatever the table's size
REPLAY_SQL = f"""
    SELECT batch, user_id, item_id, rating, ts FROM (
      {sql.array_split('r1', f"(SELECT greatest(1, count(*) // {REPLAY_ROWS}) FROM r1)", 'ts, user_id, item_id')})"""


@cache
def replayed(spark, folder):
    """All ratings through the stream, with the place at which each message was handled."""
    staged = replay.stage_runs(ratings(spark, folder), REPLAY_ROWS, [F.col(c) for c in ORDER])
    return replay.replay_stream(spark, staged, scratch_path(spark, "rows"), scratch_path(spark, "stream"))


@query("microbatch_source", f"batch:l {RATING_SPEC}", REPLAY_SQL)
def _(spark, folder):
    return replayed(spark, folder)


@query(
    "replay_stream",
    "batch:l n_rows:l first_ts:l last_ts:l",
    f"SELECT batch, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM ({REPLAY_SQL}) GROUP BY 1",
)
def _(spark, folder):
    return replayed(spark, folder).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("replay_order", "nth:l batch:l n_rows:l", f"SELECT batch AS nth, batch, count(*) AS n_rows FROM ({REPLAY_SQL}) GROUP BY 1, 2")
def _(spark, folder):
    """Messages are handled in the order of their numbers, a run of them in a trigger."""
    return replayed(spark, folder).groupBy("nth", "batch").agg(F.count(F.lit(1)).alias("n_rows"))


def ten_sliced(spark, folder, size=100):
    return prepare.assign_microbatches(ratings(spark, folder), size, [F.col(c) for c in ORDER])


MICRO_SQL = sql.array_split("r1", "(SELECT greatest(1, count(*) // 100) FROM r1)", "ts, user_id, item_id")


@query("parse_columnar_json", f"batch:l {RATING_SPEC}", f"SELECT batch, user_id, item_id, rating, ts FROM ({MICRO_SQL})")
def _(spark, folder):
    return files.parse_columnar_json(files.microbatch_messages(ten_sliced(spark, folder)))


@query("recommendation_sink", "user_id:l item_id:l rank:l", "SELECT user_id, item_id, rank FROM f_recs")
def _(spark, folder):
    served = bootstrap.topr_bootstrap(whole(spark, folder), SETTINGS.r)
    path = scratch_path(spark, "messages")
    files.recommendation_messages(served).write.text(path)
    return files.parse_recommendation_messages(spark.read.text(path))


# ---------------------------------------------------------------- projections and filters


@query("explode_profiles", STEP_SPEC, "SELECT * FROM f_prof")
def _(spark, folder):
    return stats.explode_profiles(stats.user_profiles(profile(spark, folder)))


@query("mirror_pairs", "item_id:l neighbor_id:l sim:d", "SELECT * FROM f_dirs")
def _(spark, folder):
    base = whole(spark, folder)
    return pairs.mirror_pairs(pairs.similarity_of_pairs(base.pair_info, base.item_info))


@query(
    "canonical_pair",
    "item_i:l item_j:l",
    """SELECT DISTINCT least(item_id, neighbor_id) AS item_i, greatest(item_id, neighbor_id) AS item_j FROM f_nb
       WHERE item_id <> neighbor_id""",
)
def _(spark, folder):
    return pairs.canonical_pair(whole(spark, folder).neighbors, "item_id", "neighbor_id")


@query(
    "unseen_items",
    "user_id:l item_id:l",
    """SELECT DISTINCT user_id, item_id FROM rest_rows
       WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM early)""",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    return recommend.unseen_items(rest.select("user_id", "item_id").distinct(), early)


@query(
    "has_neighbors",
    "item_id:l n:l",
    "SELECT item_id, n FROM f_pop WHERE item_id IN (SELECT item_id FROM t_nb)",
)
def _(spark, folder):
    return recommend.has_neighbors(whole(spark, folder).popular, before(spark, folder).neighbors)


WATCHED = [1, 7, 42]


@query(
    "watch_items",
    "batch:l item_id:l started:s ended:s",
    f"""SELECT DISTINCT m.batch, m.item_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS started,
          strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M:%S') AS ended
        FROM ({MICRO_SQL}) m
        JOIN (SELECT batch, min(ts) // 1000000 AS s, max(ts) // 1000000 AS e FROM ({MICRO_SQL}) GROUP BY 1) b USING (batch)
        WHERE m.item_id IN ({', '.join(map(str, WATCHED))})""",
)
def _(spark, folder):
    batches = ten_sliced(spark, folder)
    spans = batches.groupBy("batch").agg(
        F.floor(F.min("ts") / 1_000_000).alias("started"), F.floor(F.max("ts") / 1_000_000).alias("ended")
    )
    return evaluate.watch_items(batches, spans, WATCHED)


@query(
    "ignore_new",
    RATING_SPEC,
    """SELECT user_id, item_id, rating, ts FROM rest_rows
       WHERE user_id NOT IN (SELECT user_id FROM new_users) AND item_id NOT IN (SELECT item_id FROM new_items)""",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    return increment.ignore_new(rest, early, early)


# ---------------------------------------------------------------- joins


@query(
    "co_rated_pairs",
    "user_id:l item_i:l item_j:l rating_i:d rating_j:d timestep_i:l timestep_j:l",
    """SELECT a.user_id, a.item_id AS item_i, b.item_id AS item_j, a.rating AS rating_i, b.rating AS rating_j,
              a.timestep AS timestep_i, b.timestep AS timestep_j
       FROM f_prof a JOIN f_prof b ON a.user_id = b.user_id AND a.item_id < b.item_id""",
)
def _(spark, folder):
    return pairs.co_rated_pairs(profile(spark, folder))


@query(
    "all_item_pairs",
    "item_id:l dense_pairs:l stored_pairs:l zero_pairs:l",
    """SELECT i.item_id, count(j.item_id) AS dense_pairs, count(s.item_j) AS stored_pairs,
              count(j.item_id) - count(s.item_j) AS zero_pairs
       FROM f_info i LEFT JOIN f_info j ON j.item_id > i.item_id
       LEFT JOIN f_sums s ON s.item_i = i.item_id AND s.item_j = j.item_id GROUP BY 1""",
)
def _(spark, folder):
    base = whole(spark, folder)
    return stats.pair_space(base.item_info, base.pair_info)


@query("one_hop", "fresh_id:l candidate_id:l", "SELECT * FROM hop1")
def _(spark, folder):
    items = increment.fresh_keys(fresh(spark, folder), "item_id")
    return increment.one_hop(items, before(spark, folder).neighbors)


@query("two_hop", "fresh_id:l candidate_id:l", "SELECT * FROM hop2")
def _(spark, folder):
    neighbors = before(spark, folder).neighbors
    items = increment.fresh_keys(fresh(spark, folder), "item_id")
    return increment.two_hop(increment.one_hop(items, neighbors), neighbors)


@query(
    "new_item_pairs",
    "item_id:l as_smaller:l as_larger:l",
    """SELECT i.item_id, count(*) FILTER (j.item_id > i.item_id) AS as_smaller,
              count(*) FILTER (j.item_id < i.item_id AND j.item_id NOT IN (SELECT item_id FROM new_items)) AS as_larger
       FROM new_items i, (SELECT DISTINCT item_id FROM r1) j GROUP BY 1""",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    known = early.select("item_id").distinct()
    return stats.new_item_pairs(known, increment.new_entities(rest, known, "item_id"))


@query("candidate_items", "user_id:l item_id:l", "SELECT * FROM f_cand")
def _(spark, folder):
    base = whole(spark, folder)
    return recommend.candidate_items(base.user_ratings, base.popular, base.neighbors)


@query(
    "fresh_prev_pairs",
    "item_i:l item_j:l user_id:l x_i:d x_j:d e:d factor:d",
    "SELECT item_i, item_j, user_id, x_i, x_j, e, factor FROM met_pairs",
)
def _(spark, folder):
    rows = durable(clocked(spark, folder))
    touched = increment.touched_items(rows, pool(spark, folder))
    return increment.fresh_prev_pairs(rows, before(spark, folder).user_ratings, touched, sql.ALPHA)


def recommended(spark, folder):
    return bootstrap.topr_bootstrap(before(spark, folder), SETTINGS.r)


@query(
    "hit_join",
    "user_id:l item_id:l",
    "SELECT DISTINCT c.user_id, c.item_id FROM test c JOIN t_recs r ON r.user_id = c.user_id AND r.item_id = c.item_id",
)
def _(spark, folder):
    return evaluate.hit_join(split(spark, folder)[1], recommended(spark, folder))


def vote_split(spark, folder):
    order = list(VOTE_ORDER)
    train, test = prepare.split_head_tail(views.event_votes(spark, folder), sql.TAIL, order)
    return train, positions(test, [F.col(c) for c in order], "arrival", largest=sql.TAIL)


@cache
def deltas(spark, folder):
    return trust_plans.applied_deltas(vote_split(spark, folder)[0], TRUST)


@query(
    "common_votes",
    "electee_id:l voter_i:l voter_j:l vote_i:d vote_j:d",
    """SELECT a.electee_id, a.voter_id AS voter_i, b.voter_id AS voter_j, a.vote AS vote_i, b.vote AS vote_j
       FROM applied a JOIN applied b ON a.electee_id = b.electee_id AND a.voter_id < b.voter_id""",
)
def _(spark, folder):
    return trust.common_votes(trust.applied_profiles(deltas(spark, folder)))


@query(
    "asof_profile_join",
    "batch:l electee_id:l voter_id:l other_id:l vote:d other_vote:d",
    "SELECT * FROM asof_rows",
)
def _(spark, folder):
    return trust.asof_profile_join(deltas(spark, folder), TRUST.batch_rows)


# ---------------------------------------------------------------- aggregations


@query("user_stats", "user_id:l t:l avg_rating:d e:d", "SELECT * FROM f_stats")
def _(spark, folder):
    return stats.user_stats(profile(spark, folder))


@query("item_info", INFO_SPEC, "SELECT * FROM f_info")
def _(spark, folder):
    return stats.item_info(weighted(spark, folder))


@query("pair_info", PAIR_SPEC, "SELECT * FROM f_sums")
def _(spark, folder):
    return pairs.pair_info(weighted(spark, folder))


def profile_text(kind: str):
    def entry(x):
        return F.concat(x[kind], F.lit(":"), x.rating.cast("int"), F.lit("@"), x.timestep)

    return F.array_join(F.transform("profile", entry), " ")


@query(
    "user_profiles",
    "user_id:l segment:l profile:s",
    f"""SELECT user_id, (timestep - 1) // {stats.PROFILE_ROWS} AS segment,
               string_agg(item_id || ':' || CAST(rating AS INTEGER) || '@' || timestep, ' ' ORDER BY timestep) AS profile
        FROM f_prof GROUP BY 1, 2""",
)
def _(spark, folder):
    return stats.user_profiles(profile(spark, folder)).withColumn("profile", profile_text("item_id"))


@query(
    "item_profiles",
    "item_id:l segment:l profile:s",
    f"""SELECT item_id, (o - 1) // {stats.PROFILE_ROWS} AS segment,
               string_agg(user_id || ':' || CAST(rating AS INTEGER) || '@' || timestep, ' ' ORDER BY user_id) AS profile
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY user_id) AS o FROM f_prof) GROUP BY 1, 2""",
)
def _(spark, folder):
    return stats.item_profiles(profile(spark, folder)).withColumn("profile", profile_text("user_id"))


@query("item_popularity", "item_id:l n:l", "SELECT item_id, count(*) AS n FROM f_prof GROUP BY 1")
def _(spark, folder):
    return stats.item_popularity(profile(spark, folder))


@query(
    "entity_counts",
    "items:l users:l",
    "SELECT count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users FROM f_prof",
)
def _(spark, folder):
    return stats.entity_counts(profile(spark, folder))


@query(
    "avg_view_similarity",
    "view_similarity:d",
    """SELECT sum(m) / (SELECT count(*) FROM f_info) AS view_similarity
       FROM (SELECT avg(sim) AS m FROM f_nb GROUP BY item_id)""",
)
def _(spark, folder):
    base = whole(spark, folder)
    return evaluate.avg_view_similarity(base.neighbors, base.item_info)


def predicted(spark, folder):
    base = before(spark, folder)
    return recommend.predict_observations(split(spark, folder)[1], base.user_ratings, base.neighbors)


@query(
    "prediction_error",
    "rmse:d mae:d rmse_mean:d n:l",
    """SELECT sqrt(avg((pred - rating) ** 2)) AS rmse, avg(abs(pred - rating)) AS mae,
              sqrt(avg((mean - rating) ** 2)) AS rmse_mean, count(*) AS n FROM predictions""",
)
def _(spark, folder):
    return evaluate.prediction_error(predicted(spark, folder))


USER_HITS = """
    SELECT c.user_id, count(DISTINCT c.item_id) AS clicks, any_value(r.n) AS recommended,
           count(DISTINCT h.item_id) AS hits
    FROM test c JOIN (SELECT user_id, count(*) AS n FROM t_recs GROUP BY 1) r ON r.user_id = c.user_id
    LEFT JOIN t_recs h ON h.user_id = c.user_id AND h.item_id = c.item_id GROUP BY 1"""


@query(
    "ctr_recall",
    "ctr:d recall:d users:l",
    f"SELECT avg(hits / recommended) AS ctr, avg(hits / clicks) AS recall, count(*) AS users FROM ({USER_HITS})",
)
def _(spark, folder):
    return evaluate.ctr_recall(evaluate.user_hits(split(spark, folder)[1], recommended(spark, folder)))


@query(
    "hit_totals",
    "relevant:l recommended:l users:l",
    f"SELECT sum(hits) AS relevant, sum(recommended) AS recommended, count(*) AS users FROM ({USER_HITS})",
)
def _(spark, folder):
    return evaluate.hit_totals(evaluate.user_hits(split(spark, folder)[1], recommended(spark, folder)))


@query(
    "latency_summary",
    "event_type:s mean:d min:d p50:d p90:d p99:d max:d",
    """SELECT event_type, avg(value) AS mean, min(value) AS min, quantile_cont(value, 0.5) AS p50,
              quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, max(value) AS max
       FROM events GROUP BY 1""",
)
def _(spark, folder):
    return evaluate.latency_summary(views.table(spark, folder, "events"), "event_type", "value")


@query(
    "running_user_mean",
    "user_id:l n_old:l t:l rubar:d e:d",
    "SELECT user_id, n_old, t, rubar, e FROM means",
)
def _(spark, folder):
    return stats.running_user_mean(before(spark, folder).user_ratings, fresh(spark, folder))


@query(
    "ratings_profile",
    "min_ts:l max_ts:l max_id:l rows:l items:l",
    """SELECT min(ts) AS min_ts, max(ts) AS max_ts, max(voter_id) AS max_id, count(*) AS rows,
              count(DISTINCT voter_id) AS items FROM v1""",
)
def _(spark, folder):
    return stats.ratings_profile(views.event_votes(spark, folder), "voter_id")


@query("voter_norms", "voter_id:l decayed:d exact:d", """
    SELECT t.voter_id, t.q AS decayed, e.q AS exact FROM t_norms t JOIN e_norms e ON e.voter_id = t.voter_id""")
def _(spark, folder):
    rows = deltas(spark, folder)
    decayed = trust.voter_norms(rows, TRUST.alpha).withColumnRenamed("q", "decayed")
    exact = trust.exact_norms(trust.applied_profiles(rows)).withColumnRenamed("q", "exact")
    return decayed.join(exact, "voter_id")


# ---------------------------------------------------------------- windows, sorts, limits


@query("latest_rating", RATING_SPEC, "SELECT * FROM f_clean")
def _(spark, folder):
    return prepare.latest_rating(ratings(spark, folder))


@query("timestep", STEP_SPEC, "SELECT * FROM f_prof")
def _(spark, folder):
    return prepare.timestep(prepare.latest_rating(ratings(spark, folder)))


@query("topk_neighbors", NEIGHBOR_SPEC, "SELECT * FROM f_nb")
def _(spark, folder):
    base = whole(spark, folder)
    sims = pairs.similarity_of_pairs(base.pair_info, base.item_info)
    return pairs.topk_neighbors(pairs.mirror_pairs(sims), sql.K)


@query("topr_recommendations", REC_SPEC, "SELECT * FROM f_recs")
def _(spark, folder):
    base = whole(spark, folder)
    wide = recommend.topr_recommendations(base.user_ratings, base.popular, base.neighbors, sql.P)
    return recommend.top_recommendations(wide.drop("rank"), SETTINGS.r)


@query("assign_microbatches", f"arrival:l batch:l {RATING_SPEC}", MICRO_SQL)
def _(spark, folder):
    return ten_sliced(spark, folder)


@query("assign_count_batches", "arrival:l batch:l electee_id:l voter_id:l vote:d", "SELECT * FROM v_batched")
def _(spark, folder):
    train = vote_split(spark, folder)[0]
    return prepare.assign_count_batches(train, TRUST.batch_rows, [F.col(c) for c in VOTE_ORDER])


@query(
    "batch_timestep",
    "batch:l arrival:l user_id:l position:l",
    f"""SELECT batch, arrival, user_id, row_number() OVER (PARTITION BY batch, user_id ORDER BY arrival) AS position
        FROM ({MICRO_SQL})""",
)
def _(spark, folder):
    return prepare.batch_timestep(ten_sliced(spark, folder))


@query(
    "last_in_batch",
    f"batch:l {RATING_SPEC}",
    f"""SELECT batch, user_id, item_id, rating, ts FROM (
          SELECT *, row_number() OVER (PARTITION BY batch, user_id, item_id ORDER BY arrival DESC) AS o
          FROM ({MICRO_SQL})) WHERE o = 1""",
)
def _(spark, folder):
    return prepare.last_in_batch(ten_sliced(spark, folder))


@query(
    "multi_cutoff",
    "user_id:l item_id:l rank:l cutoff:l",
    "SELECT user_id, item_id, rank, cutoff FROM f_recs JOIN (SELECT unnest([3, 5, 10]) AS cutoff) ON rank <= cutoff",
)
def _(spark, folder):
    return recommend.multi_cutoff(bootstrap.topr_bootstrap(whole(spark, folder), SETTINGS.r), [3, 5, 10])


@query(
    "cap_repeats",
    "user_id:l item_id:l arrival:l",
    """SELECT user_id, item_id, ts AS arrival FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts) AS o FROM r1) WHERE o <= 2""",
)
def _(spark, folder):
    log = ratings(spark, folder).select("user_id", "item_id", F.col("ts").alias("arrival"))
    return recommend.cap_repeats(log, 2)


@query("sort_by_time", RATING_SPEC, "SELECT * FROM r1")
def _(spark, folder):
    return prepare.sort_by_time(ratings(spark, folder), ["user_id", "item_id", "rating"])


@query("sort_by_time_order", f"nth:l {RATING_SPEC}", BY_TIME)
def _(spark, folder):
    rows = prepare.sort_by_time(ratings(spark, folder), ["user_id", "item_id", "rating"])
    numbered = durable(rows.withColumn("i", F.monotonically_increasing_id()))
    return positions(numbered, [F.col("i")], "nth", unique=True)


@query("top_popular", "item_id:l n:l", "SELECT * FROM f_pop")
def _(spark, folder):
    return stats.top_popular(stats.item_popularity(profile(spark, folder)), sql.P)


@query(
    "default_neighbors",
    NEIGHBOR_SPEC,
    f"""SELECT * FROM (
          SELECT i.item_id, p.item_id AS neighbor_id, 0 AS sim,
                 row_number() OVER (PARTITION BY i.item_id ORDER BY n DESC, p.item_id) AS rank
          FROM new_items i JOIN (SELECT item_id, n FROM f_pop ORDER BY n DESC, item_id LIMIT {sql.K} + 1) p
            ON p.item_id <> i.item_id) WHERE rank <= {sql.K}""",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    new = increment.new_entities(rest, early.select("item_id").distinct(), "item_id")
    return stats.default_neighbors(new, whole(spark, folder).popular, sql.K)


@query(
    "split_head_tail",
    f"{RATING_SPEC} side:s",
    "SELECT user_id, item_id, rating, ts, 'train' AS side FROM train "
    "UNION ALL SELECT user_id, item_id, rating, ts, 'test' FROM test",
)
def _(spark, folder):
    train, test = prepare.split_head_tail(ratings(spark, folder), sql.TAIL, ORDER)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query("maintain_popular", "item_id:l n:l", "SELECT * FROM n_pop")
def _(spark, folder):
    return _change(spark, folder).popular


# ---------------------------------------------------------------- sets


@query(
    "fresh_keys",
    "kind:s id:l",
    "SELECT DISTINCT 'user' AS kind, user_id AS id FROM rest_rows UNION ALL SELECT DISTINCT 'item', item_id FROM rest_rows",
)
def _(spark, folder):
    _, rest = slices(spark, folder)
    users = increment.fresh_keys(rest, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    items = increment.fresh_keys(rest, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return users.unionByName(items)


@query(
    "new_entities",
    "kind:s id:l",
    "SELECT 'user' AS kind, user_id AS id FROM new_users UNION ALL SELECT 'item', item_id FROM new_items",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    users = increment.new_entities(rest, early, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    items = increment.new_entities(rest, early, "item_id").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"))
    return users.unionByName(items)


@query("candidate_union", "fresh_id:l candidate_id:l", "SELECT * FROM pool")
def _(spark, folder):
    return pool(spark, folder)


@query(
    "append_known",
    "item_id:l n:l",
    """SELECT item_id, count(*) AS n FROM early GROUP BY 1
       UNION ALL SELECT item_id, 0 FROM new_items""",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    known = early.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(increment.new_entities(rest, known, "item_id").withColumn("n", F.lit(0)))


@query("update_candidates", "item_id:l neighbor_id:l old_sim:d new_sim:d", "SELECT * FROM explicit")
def _(spark, folder):
    base, change = before(spark, folder), _change(spark, folder)
    q = change.item_info.filter("q <> 0")
    scored = pairs.mirror_pairs(pairs.similarity_of_pairs(change.pair_info, q))
    listed = change.touched.join(base.neighbors.select("item_id"), "item_id", "left_semi")
    return increment.update_candidates(listed, base.neighbors, scored)


@query(
    "set_intersection",
    "user_id:l item_id:l",
    "SELECT user_id, item_id FROM early INTERSECT SELECT user_id, item_id FROM rest_rows",
)
def _(spark, folder):
    early, rest = slices(spark, folder)
    return keys.common_rows(early.select("user_id", "item_id"), rest)


# ---------------------------------------------------------------- scalar functions


@query(
    "decay",
    "user_id:l item_id:l weight:d",
    f"""SELECT p.user_id, item_id, exp(-{sql.ALPHA} * (t - timestep)) AS weight
        FROM f_prof p JOIN f_stats s ON s.user_id = p.user_id""",
)
def _(spark, folder):
    rows = profile(spark, folder)
    clocks = stats.user_stats(rows).select("user_id", "t")
    return rows.join(clocks, "user_id").withColumn("weight", scoring.decay("t", "timestep", sql.ALPHA))


@query("pair_similarity", "item_i:l item_j:l sim:d", "SELECT * FROM f_sims")
def _(spark, folder):
    base = whole(spark, folder)
    return pairs.similarity_of_pairs(base.pair_info, base.item_info)


@query("predict_rating", "user_id:l item_id:l mean:d pred:d", "SELECT * FROM f_scored")
def _(spark, folder):
    base = whole(spark, folder)
    asked = recommend.candidate_items(base.user_ratings, base.popular, base.neighbors)
    return recommend.predict_observations(asked, base.user_ratings, base.neighbors)


@query(
    "time_convert",
    "event_id:l epoch:l text:s",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
              strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS text FROM events""",
)
def _(spark, folder):
    events = views.table(spark, folder, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    epoch = events.select("event_id", scoring.to_epoch(text).alias("epoch"))
    return epoch.withColumn("text", scoring.from_epoch("epoch"))


@query("random_k", "fresh_id:l candidate_id:l", "SELECT * FROM rnd")
def _(spark, folder):
    base = before(spark, folder)
    items = increment.fresh_keys(fresh(spark, folder), "item_id")
    listed = recommend.has_neighbors(items, base.neighbors)
    return increment.random_k(listed, known_items(base, items), sql.K, sql.SEED, 1)


# ---------------------------------------------------------------- streaming and state


def run_stream(spark, folder, size, **options):
    """Bootstrap on the head, then stream the tail through the serving loop."""
    train, test = split(spark, folder)
    store = StateStore(spark, scratch_path(spark, "state"), STATE_BUCKETS)
    store.bootstrap(
        lambda keep: bootstrap.relations(train, SETTINGS, keep),
        lambda base: bootstrap.topr_bootstrap(base, SETTINGS.r + size),
    )
    staged = replay.stage_replay(test.select(*RATINGS.names), size, [F.col(c) for c in [*ORDER, "rating"]])
    watched = tuple(range(3, 500, 7))
    loop.run_loop(store, staged, SETTINGS, [5, SETTINGS.r], view_similarity=True, watched=watched, **options)
    return store


@cache
def streamed(spark, folder):
    return run_stream(spark, folder, sql.HALF)


@cache
def streamed_once(spark, folder):
    return run_stream(spark, folder, sql.TAIL)


@query("incremental_state", NEIGHBOR_SPEC, "SELECT * FROM all_nb")
def _(spark, folder):
    return streamed_once(spark, folder).read("neighbors")


@query("incremental_state_two_batches", PAIR_SPEC, "SELECT * FROM bm_sums")
def _(spark, folder):
    return streamed(spark, folder).read("pair_info")


@query("two_batches_neighbors", NEIGHBOR_SPEC, "SELECT * FROM bm_nb")
def _(spark, folder):
    return streamed(spark, folder).read("neighbors")


@query("two_batches_recommendations", REC_SPEC, "SELECT * FROM bm_recs")
def _(spark, folder):
    return streamed(spark, folder).read("recommendations")


@query("two_batches_profiles", STEP_SPEC, "SELECT * FROM bm_prof")
def _(spark, folder):
    return streamed(spark, folder).read("user_ratings")


def next_rows(spark, folder):
    """The rows after the first slice, as one batch. Most of its users and items are new."""
    rest = slices(spark, folder)[1].orderBy("arrival").limit(sql.TAIL)
    rows = prepare.last_in_batch(prepare.batch_timestep(rest.withColumn("batch", F.lit(1))))
    return rows.select("user_id", "item_id", "rating", "position")


@cache
def _grown(spark, folder):
    early = bootstrap.relations(slices(spark, folder)[0], SETTINGS)
    early = replace(early, recommendations=durable(bootstrap.topr_bootstrap(early, SETTINGS.r)))
    change = update.apply_batch(early, next_rows(spark, folder), SETTINGS, 1, sql.TAIL)
    return update.merged_relations(early, change)


@query("new_entities_item_info", INFO_SPEC, "SELECT * FROM um_info")
def _(spark, folder):
    return _grown(spark, folder).item_info


@query("new_entities_pair_info", PAIR_SPEC, "SELECT * FROM um_sums")
def _(spark, folder):
    return _grown(spark, folder).pair_info


@query("new_entities_neighbors", NEIGHBOR_SPEC, "SELECT * FROM um_nb")
def _(spark, folder):
    return _grown(spark, folder).neighbors


@query("new_entities_recommendations", REC_SPEC, "SELECT * FROM um_recs")
def _(spark, folder):
    return _grown(spark, folder).recommendations


@cache
def _met_anew(spark, folder):
    """The last rows applied to the ratings of all users and items they do not hold."""
    train, test = split(spark, folder)
    users, items = (F.broadcast(test.select(c).distinct()) for c in ("user_id", "item_id"))
    rest = train.join(users, "user_id", "left_anti").join(items, "item_id", "left_anti").select(*RATINGS.names)
    base = bootstrap.relations(rest, SETTINGS)
    base = replace(base, recommendations=durable(bootstrap.topr_bootstrap(base, SETTINGS.r)))
    return update.merged_relations(base, update.apply_batch(base, fresh(spark, folder), SETTINGS, 1, sql.TAIL))


@query("unseen_entities_item_info", INFO_SPEC, "SELECT * FROM qm_info")
def _(spark, folder):
    return _met_anew(spark, folder).item_info


@query("unseen_entities_pair_info", PAIR_SPEC, "SELECT * FROM qm_sums")
def _(spark, folder):
    return _met_anew(spark, folder).pair_info


@query("unseen_entities_neighbors", NEIGHBOR_SPEC, "SELECT * FROM qm_nb")
def _(spark, folder):
    return _met_anew(spark, folder).neighbors


@query("unseen_entities_recommendations", REC_SPEC, "SELECT * FROM qm_recs")
def _(spark, folder):
    return _met_anew(spark, folder).recommendations


def exhausted(spark, folder, choose):
    """Through the store: users who rate all popular items in a batch have nothing left to be recommended."""
    train = split(spark, folder)[0]
    few = replace(SETTINGS, p=sql.FEW)
    store = StateStore(spark, scratch_path(spark, "state"), STATE_BUCKETS)
    base = store.bootstrap(
        lambda keep: bootstrap.relations(train, few, keep), lambda found: bootstrap.topr_bootstrap(found, few.r)
    )
    users = choose(train, base.popular).select("user_id").distinct()
    rows = users.crossJoin(F.broadcast(base.popular.select("item_id"))).withColumn("rating", F.lit(4.0))
    position = F.row_number().over(W.partitionBy("user_id").orderBy("item_id")).cast("long")
    update.apply_batch(
        store.relations(),
        durable(rows.withColumn("position", position)),
        few,
        1,
        keep=lambda name, df, owners=None: store.write(1, name, df, owners=owners),
    )
    store.commit(1, 0)
    return store.read("recommendations")


@query(
    "refresh_recommendations_exhausted",
    REC_SPEC,
    "SELECT * FROM w_long WHERE user_id NOT IN (SELECT user_id FROM asked_w)",
)
def _(spark, folder):
    return exhausted(spark, folder, lambda train, popular: train.filter("user_id % 5 = 2"))


@query(
    "refresh_recommendations_of_raters",
    REC_SPEC,
    "SELECT * FROM w_long WHERE user_id NOT IN (SELECT user_id FROM raters_w)",
)
def _(spark, folder):
    """The users are those who rated the most popular item."""
    return exhausted(
        spark, folder, lambda train, popular: train.join(popular.orderBy(F.desc("n"), "item_id").limit(1), "item_id", "left_semi")
    )


@query("prequential_eval", "arrival:l user_id:l item_id:l rating:d mean:d pred:d",
       "SELECT arrival - 1 AS arrival, user_id, item_id, rating, mean, pred FROM predictions")
def _(spark, folder):
    return streamed_once(spark, folder).log("predictions")


PHASES = ["batching", "update", *(f"update {name}" for name in ("item_info", "pair_info", "popular", "neighbors", "user_ratings", "recommendations"))]
SERVED_HITS = """
    SELECT c.user_id, count(DISTINCT c.item_id) AS clicks, any_value(r.n) AS recommended, count(DISTINCT h.item_id) AS hits
    FROM test c JOIN (SELECT user_id, count(DISTINCT item_id) AS n FROM lists GROUP BY 1) r ON r.user_id = c.user_id
    LEFT JOIN lists h ON h.user_id = c.user_id AND h.item_id = c.item_id GROUP BY 1"""


@query(
    "run_report",
    "phase:s batches:l n:l rmse:d mae:d rmse_mean:d ctr:d recall:d relevant:l recommended:l users:l",
    f"""
    WITH lists AS (SELECT DISTINCT user_id, item_id FROM served WHERE rank <= {sql.R}),
    hits AS ({SERVED_HITS})
    SELECT phase, 1 AS batches, count(*) AS n, sqrt(avg((pred - rating) ** 2)) AS rmse,
           avg(abs(pred - rating)) AS mae, sqrt(avg((mean - rating) ** 2)) AS rmse_mean,
           (SELECT avg(CASE WHEN recommended > 0 THEN hits / recommended ELSE 0 END) FROM hits) AS ctr,
           (SELECT avg(hits / clicks) FROM hits) AS recall, (SELECT sum(hits) FROM hits) AS relevant,
           (SELECT sum(recommended) FROM hits) AS recommended, (SELECT count(*) FROM hits) AS users
    FROM predictions CROSS JOIN (SELECT unnest({PHASES}) AS phase) GROUP BY phase""",
)
def _(spark, folder):
    return loop.run_report(streamed_once(spark, folder))


@query(
    "batch_metrics",
    "batch:l phase:s rows:l took:s",
    f"""SELECT batch, phase, 50 AS rows, 'true' AS took
        FROM (SELECT unnest([1, 2]) AS batch) CROSS JOIN (SELECT unnest({PHASES}) AS phase)""",
)
def _(spark, folder):
    return streamed(spark, folder).log("metrics").withColumn("took", F.col("seconds") >= 0)


TIMES = ("triggerExecution", "latestOffset", "addBatch", "walCommit", "commitOffsets")


@query(
    "batch_progress",
    "epoch:l messages:l step:s took:s",
    f"""SELECT epoch, 1 AS messages, step, 'true' AS took
        FROM (SELECT unnest([0, 1]) AS epoch) CROSS JOIN (SELECT unnest({list(TIMES)}) AS step)""",
)
def _(spark, folder):
    """Spark's own times of the triggers of two batches; a trigger has one message."""
    rows = streamed(spark, folder).log("progress").select("epoch", F.col("rows").alias("messages"), F.explode("times").alias("step", "ms"))
    return rows.filter(F.col("step").isin(*TIMES)).withColumn("took", F.col("ms") >= 0)


@query(
    "batch_view_similarity",
    "batch:l view_similarity:d",
    """SELECT 1 AS batch, sum(m) / (SELECT count(*) FROM (SELECT item_id FROM t_info UNION SELECT item_id FROM n_info)) AS view_similarity
       FROM (SELECT avg(sim) AS m FROM all_nb GROUP BY item_id)""",
)
def _(spark, folder):
    return streamed_once(spark, folder).log("view_similarity")


@query(
    "batch_watch_items",
    "batch:l item_id:l timed:s",
    "SELECT DISTINCT 1 AS batch, item_id, 'true' AS timed FROM test WHERE item_id % 7 = 3 AND item_id < 500",
)
def _(spark, folder):
    return streamed_once(spark, folder).log("watched").withColumn("timed", F.col("ended") >= F.col("started"))


@query(
    "duplicate_policy",
    "policy:s user_id:l item_id:l rating:d",
    """SELECT 'upsert' AS policy, user_id, item_id, rating FROM bm_prof
       UNION ALL SELECT 'append', user_id, item_id, rating FROM b_fresh
       UNION ALL SELECT 'append', user_id, item_id, rating FROM a_fresh
       UNION ALL SELECT 'append', user_id, item_id, rating FROM t_prof""",
)
def _(spark, folder):
    """The stored state after two batches of the loop, under both policies."""
    found = None
    for policy, store in (("upsert", streamed(spark, folder)), ("append", run_stream(spark, folder, sql.HALF, contain_duplicates=False))):
        rows = store.read("user_ratings").withColumn("policy", F.lit(policy))
        found = rows if found is None else found.unionByName(rows)
    return found


MOST = 2
SERVE_SQL = f"""
    WITH RECURSIVE lists AS (
      SELECT 1 AS batch, user_id, list(item_id ORDER BY rank) AS stored FROM h_recs GROUP BY user_id
      UNION ALL SELECT 2, user_id, list(item_id ORDER BY rank) FROM am_recs GROUP BY user_id
    ), asked AS (
      SELECT arrival, 1 + (arrival - 1) // {sql.HALF} AS batch, user_id,
             list(item_id) OVER (PARTITION BY user_id, (arrival - 1) // {sql.HALF} ORDER BY arrival) AS rated FROM test
    ), open AS (
      SELECT arrival, a.batch, a.user_id, list_filter(stored, lambda x: NOT list_contains(rated, x)) AS items
      FROM asked a LEFT JOIN lists l ON l.batch = a.batch AND l.user_id = a.user_id
    ), walk AS (
      SELECT 0 AS arrival, 0 AS batch, 0 AS user_id, []::BIGINT[] AS best, []::VARCHAR[] AS used
      UNION ALL
      SELECT arrival, batch, user_id, best, list_concat(used, list_transform(coalesce(best, []), lambda x: user_id || ':' || x)) FROM (
        SELECT o.arrival, o.batch, o.user_id, w.used,
               list_slice(list_filter(o.items, lambda x: len(list_filter(w.used, lambda u: u = o.user_id || ':' || x)) < {MOST}), 1, {sql.R}) AS best
        FROM walk w JOIN open o ON o.arrival = w.arrival + 1)
    ), answers AS (
      SELECT arrival, batch, user_id, CASE WHEN len(best) = 0 THEN [NULL] ELSE best END AS best FROM walk WHERE arrival > 0 AND best IS NOT NULL
    )
    SELECT batch, (arrival - 1) % {sql.HALF} AS arrival, user_id, unnest(best) AS item_id, unnest(range(1, len(best) + 1)) AS rank FROM answers"""


@query("serve_at_most", "batch:l arrival:l user_id:l item_id:l rank:l", SERVE_SQL)
def _(spark, folder):
    """Two batches through the loop; no item is in a user's longest lists more than MOST times."""
    return run_stream(spark, folder, sql.HALF, most_repeats=MOST).log("served")


# ---------------------------------------------------------------- composite analytics


@query("similarity_bootstrap", NEIGHBOR_SPEC, "SELECT * FROM f_nb")
def similarity(spark, folder):
    return bootstrap.similarity_bootstrap(ratings(spark, folder), SETTINGS)


@query("similarity_bootstrap_undecayed", NEIGHBOR_SPEC, "SELECT * FROM z_nb")
def _(spark, folder):
    return bootstrap.similarity_bootstrap(ratings(spark, folder), Settings(k=sql.K, alpha=0.0))


@query("similarity_bootstrap_orders", NEIGHBOR_SPEC, "SELECT * FROM b_nb")
def similarity_orders(spark, folder):
    return bootstrap.similarity_bootstrap(views.order_ratings(spark, folder), SETTINGS)


@query("topr_bootstrap", REC_SPEC, "SELECT * FROM f_recs")
def topr(spark, folder):
    return bootstrap.topr_bootstrap(whole(spark, folder), SETTINGS.r)


@query("update_item_info", INFO_SPEC, "SELECT * FROM n_info")
def _(spark, folder):
    return _change(spark, folder).item_info


@query("update_pair_info", PAIR_SPEC, "SELECT * FROM n_sums")
def _(spark, folder):
    return _change(spark, folder).pair_info


@query("refresh_neighbors", NEIGHBOR_SPEC, "SELECT * FROM n_nb")
def _(spark, folder):
    return _change(spark, folder).neighbors


@query("refresh_recommendations", REC_SPEC, "SELECT * FROM n_recs")
def _(spark, folder):
    return _change(spark, folder).recommendations


@query("predict_observations", "arrival:l user_id:l item_id:l rating:d mean:d pred:d", "SELECT * FROM predictions")
def _(spark, folder):
    return predicted(spark, folder)


@query(
    "serve_recommendations",
    "arrival:l user_id:l item_id:l rank:l cutoff:l",
    "SELECT s.*, cutoff FROM served s JOIN (SELECT unnest([5, 10]) AS cutoff) ON rank <= cutoff",
)
def _(spark, folder):
    lists = bootstrap.topr_bootstrap(before(spark, folder), SETTINGS.r + sql.TAIL)
    asked = split(spark, folder)[1].withColumn("batch", F.lit(1))
    return recommend.serve_recommendations(asked, lists, [5, 10])


LIST_SPEC = "voter_id:l neighbor_id:l sim:d rank:l"


@query("trust_incremental_knn", LIST_SPEC, "SELECT * FROM t_lists")
def trust_knn(spark, folder):
    return trust_plans.trust_incremental_knn(vote_split(spark, folder)[0], TRUST)


@query("trust_exact_knn", LIST_SPEC, "SELECT * FROM e_lists")
def _(spark, folder):
    return trust_plans.trust_exact_knn(vote_split(spark, folder)[0], TRUST)


@cache
def trust_state(spark, folder):
    """The state after all batches of votes but two, and these two applied to it."""
    rows = deltas(spark, folder)
    border = rows.agg(F.max("batch")).first()[0] - 2
    store = trust_plans.trust_store(spark, scratch_path(spark, "trust"), STATE_BUCKETS)
    trust_plans.start_trust(store, rows.filter(F.col("batch") <= border), TRUST)
    for batch in (border + 1, border + 2):
        trust_plans.apply_trust_batch(store, rows.filter(F.col("batch") == batch), TRUST)
    return store


@query("trust_state_knn", LIST_SPEC, "SELECT * FROM t_lists")
def _(spark, folder):
    return trust_plans.stored_trust_lists(trust_state(spark, folder), vote_split(spark, folder)[0], TRUST)


@query("trust_state_norms", "voter_id:l q:d", "SELECT voter_id, q FROM t_norms")
def _(spark, folder):
    return trust_state(spark, folder).read("voter_norms")


@query("trust_state_votes", "voter_id:l electee_id:l vote:d", "SELECT voter_id, electee_id, vote FROM applied")
def _(spark, folder):
    return trust_state(spark, folder).read("applied_votes")


TRUSTED_SPEC = "arrival:l electee_id:l voter_id:l vote:d positive:l negative:l predicted:l"


@query("trust_predict", TRUSTED_SPEC, "SELECT * FROM trusted")
def trusted(spark, folder):
    return trust_plans.trust_predict(*vote_split(spark, folder), TRUST)


@query(
    "trust_eval",
    "hits:l total:l error:d skipped:l",
    """SELECT count(*) FILTER (predicted = vote AND vote <> 0) AS hits,
              count(*) FILTER (predicted IS NOT NULL AND vote <> 0) AS total,
              avg(abs(predicted - vote)) AS error, count(*) FILTER (predicted IS NULL) AS skipped FROM trusted""",
)
def _(spark, folder):
    return trust.trust_eval(trusted(spark, folder))
