"""The serving loop: per micro-batch predict, recommend, then update the state."""

import time
import uuid

from pyspark.sql import DataFrame, functions as F

from driftsim.operators import evaluate, prepare, recommend
from driftsim.plans.bootstrap import Settings
from driftsim.plans.update import apply_batch, small_profiles, small_rows
from driftsim.session import calm_session, durable, held, hold, local, scratch_path
from driftsim.sources.files import parse_columnar_json, recommendation_messages
from driftsim.sources.state import StateStore, stored_form
from driftsim.streaming.progress import Progress
from driftsim.streaming.replay import in_order, microbatch_source, run_to_end

PROGRESS = "epoch long, rows long, times map<string, long>"
METRICS = "batch long, phase string, started double, ended double, seconds double, rows long"


class Loop:
    """``foreachBatch`` handler that moves a state store one version per micro-batch.

    A batch is handled from the last committed version and committed once, last of all,
    together with its stream and epoch: a batch replayed after a failure either finds
    its commit and does nothing, or is computed again from the same version.

    A batch of up to ``small_rows`` is looked up in the state and worked through on local
    frames; what it changed is written as one table and what it served as another. A
    larger one writes every step.
    """

    def __init__(
        self,
        store: StateStore,
        settings: Settings,
        cutoffs: list[int],
        stream: str,
        ignore_new: bool = False,
        contain_duplicates: bool = True,
        compact_every: int = 20,
        view_similarity: bool = False,
        watched: tuple[int, ...] = (),
        most_repeats: int | None = None,
    ):
        """``most_repeats``: how often an item may be in the longest lists of a user;
        ``view_similarity``: log the mean similarity of all lists after every batch;
        ``watched``: items whose batches are reported by ``watch_report``."""
        self.most_repeats = most_repeats
        self.view_similarity, self.watched = view_similarity, tuple(watched)
        self.store, self.settings, self.cutoffs, self.stream = store, settings, cutoffs, stream
        self.ignore_new, self.contain_duplicates = ignore_new, contain_duplicates
        self.compact_every = compact_every

    def __call__(self, messages: DataFrame, epoch: int) -> None:
        store = self.store
        if store.applied(self.stream, epoch):
            return
        last, base_version = store.last()
        if last - base_version >= self.compact_every:
            store.compact()
            last, base_version = store.last()
        version = last + 1
        steps = Steps(version)

        rows = parse_columnar_json(messages.select("value")).withColumn("batch", F.lit(version).cast("long"))
        most = small_rows(self.settings)
        few = rows.limit(most + 1).toArrow()
        small = few.num_rows <= most
        ahead = most * self.settings.k if small else 0
        if small:
            store.draw_ahead(ahead, self.settings.seed, self.compact_every)
        base = store.relations(not small or self.ignore_new, ahead)
        if small:
            few, steps.rows = held(store.spark, few), few.num_rows
            rows = few.frame
        else:
            rows = durable(rows)
            steps.rows = rows.count()
        predicted, served, turns, near = self._answer(few if small else rows, base, small)
        longest = served.filter(F.col("cutoff") == max(self.cutoffs))
        store.append_logs(
            version, {"observations": rows, "predictions": predicted, "messages": recommendation_messages(served), "served": longest}
        )
        steps.end("batching")

        fresh = prepare.last_in_batch(prepare.batch_timestep(rows)).select("user_id", "item_id", "rating", "position")
        changes, written = {}, 0

        def keep(name: str, df: DataFrame, owners: DataFrame | None = None):
            """Hold a changed relation until all are written, or write it, and note how long its step took."""
            nonlocal written
            if small:
                found = hold(df)
                changes[name] = stored_form(name, found.frame, owners)
                written += found.table.num_rows + (steps.rows if owners is not None else 0)
            else:
                found = store.write(version, name, df, owners=owners)
            steps.end(f"update {name}", of="update")
            return found

        apply_batch(base, fresh, self.settings, version, steps.rows, self.ignore_new, self.contain_duplicates, keep, small, near)
        if turns is not None:
            turns = recommend.added_turns(turns, longest)
            if small:
                changes["turns"] = stored_form("turns", turns)
                written += steps.rows * max(self.cutoffs)
            else:
                store.write(version, "turns", turns)
        if small:
            store.write_changes(version, changes)
            store.note_rows(version, written)
        steps.end("update")
        metrics = calm_session(store.spark).createDataFrame(steps.found, METRICS)
        store.append_logs(version, {"metrics": metrics})
        store.commit(version, base_version, self.stream, epoch)
        if self.view_similarity:
            found = evaluate.avg_view_similarity(store.read("neighbors"), store.read("item_info"))
            store.append_log(version, "view_similarity", found.withColumn("batch", F.lit(version).cast("long")))
        if self.watched:
            found = evaluate.watch_items(rows, metrics.filter("phase in ('batching', 'update')"), list(self.watched))
            store.append_log(version, "watched", found)

    def _answer(self, rows, base, small: bool):
        """Predictions for the batch and the lists it is served, both from the state before it.

        With them come the turns that items had before, if repeats are capped, and the
        lists of the batch's items, if they are at hand.
        """
        turns = lists = None
        if small:
            users, items, rows = rows.ids("user_id"), rows.ids("item_id"), rows.frame
            lists = base.hold("neighbors", items)
            sums, some = small_profiles(base, users, lists.ids("neighbor_id"))
            means = sums.select("user_id", (F.col("s_old") / F.col("n_old")).alias("mean"))
            predicted = recommend.predict_observations(rows, some, lists.frame, means)
            stored = base.hold("recommendations", users).frame
            if self.most_repeats is not None:
                turns = self.store.hold("turns", users, base.head).frame
        else:
            users, items = (durable(rows.select(c).distinct()) for c in ("user_id", "item_id"))
            predicted = recommend.predict_observations(
                rows, base.find("user_ratings", users, ["user_id"]), base.find("neighbors", items, ["item_id"])
            )
            stored = base.find("recommendations", users, ["user_id"])
            if self.most_repeats is not None:
                turns = durable(self.store.find("turns", users, ["user_id"], base.head))
        served = recommend.serve_recommendations(rows, stored, self.cutoffs, self.most_repeats, turns=turns)
        return predicted, local(served) if small else durable(served), turns, lists


class Steps:
    """Wall time of the phases of a batch and of the steps inside one."""

    def __init__(self, version: int):
        self.version, self.rows, self.found = version, 0, []
        self.begun = {None: time.time()}

    def end(self, phase: str, of: str | None = None) -> None:
        """A phase ends now. It began when the one before it did end, on its own level."""
        now = time.time()
        since = self.begun.get(of, self.begun[None])
        self.found.append((self.version, phase, since, now, now - since, self.rows))
        self.begun[of] = now
        if of is None:
            self.begun = {None: now}


def run_loop(
    store: StateStore, folder: str, settings: Settings, cutoffs: list[int], checkpoint: str | None = None, **options
) -> None:
    """Apply every message below ``folder`` to the state.

    Afterwards the log ``progress`` has Spark's own times of every trigger of the run.
    """
    spark = store.spark
    checkpoint = checkpoint or scratch_path(spark, "stream")
    loop = Loop(store, settings, cutoffs, checkpoint, **options)
    handled = set()

    def handle(messages: DataFrame, epoch: int) -> None:
        loop(messages, epoch)
        handled.add(epoch)

    progress = Progress(f"loop-{uuid.uuid4().hex}")
    spark.streams.addListener(progress)
    try:
        run_to_end(microbatch_source(spark, folder), in_order(spark, folder, handle), checkpoint, progress.name)
        progress.wait_for(handled)
    finally:
        spark.streams.removeListener(progress)
    if progress.found:
        store.append_log(store.last()[0], "progress", calm_session(spark).createDataFrame(progress.rows(), PROGRESS))


def run_report(store: StateStore) -> DataFrame:
    """One row per phase: its latency figures, and those of the whole run.

    These are the batches, the prediction errors, and what became of the longest lists
    that were served: click-through, recall, and the totals behind them.
    """
    latency = evaluate.latency_summary(store.log("metrics"), "phase", "seconds")
    batches = store.log("metrics").select("batch").distinct().agg(F.count(F.lit(1)).alias("batches"))
    errors = evaluate.prediction_error(store.log("predictions"))
    hits = durable(evaluate.user_hits(store.log("observations"), store.log("served")))
    rates, totals = evaluate.ctr_recall(hits).drop("users"), evaluate.hit_totals(hits)
    whole = [frame.select(c).scalar().alias(c) for frame in (batches, errors, rates, totals) for c in frame.columns]
    return latency.select("*", *whole)
