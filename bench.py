"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (table folder) and BENCH_CPUS (local threads).
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession, functions as F

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks import catalog, oracle
    from driftsim.operators import prepare
    from driftsim.plans import bootstrap
    from driftsim.schemas import RATINGS
    from driftsim.session import scratch_path
    from driftsim.sources.state import StateStore
    from driftsim.streaming import loop, replay

    times: dict[str, float] = {}

    def timed(name, action):
        start = time.time()
        action()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    # One untimed run, so that the first figure is not the start of the JVM.
    consume(catalog.QUERIES["similarity_bootstrap"](spark, FOLDER))
    for name in ("similarity_bootstrap", "similarity_bootstrap_orders"):
        timed(name, lambda: consume(catalog.QUERIES[name](spark, FOLDER)))
    timed("relations", lambda: catalog.before(spark, FOLDER))
    base = catalog.before(spark, FOLDER)
    timed("topr_bootstrap", lambda: consume(bootstrap.topr_bootstrap(base, oracle.R)))
    timed("predict_observations", lambda: consume(catalog.QUERIES["predict_observations"](spark, FOLDER)))
    timed("serve_recommendations", lambda: consume(catalog.QUERIES["serve_recommendations"](spark, FOLDER)))
    timed("trust_incremental_knn", lambda: consume(catalog.QUERIES["trust_incremental_knn"](spark, FOLDER)))
    timed("trust_exact_knn", lambda: consume(catalog.QUERIES["trust_exact_knn"](spark, FOLDER)))

    # Latency per micro-batch of the serving loop, for batches of 10 and of 100 ratings.
    train, test = prepare.split_head_tail(catalog.ratings(spark, FOLDER), 100, catalog.ORDER)
    order = [F.col(c) for c in catalog.ORDER]
    store = StateStore(spark, scratch_path(spark, "bench-state"), 8)
    timed(
        "state_bootstrap",
        lambda: store.bootstrap(
            lambda keep: bootstrap.relations(train, catalog.SETTINGS, keep),
            lambda found: bootstrap.topr_bootstrap(found, oracle.R + 100),
        ),
    )
    latency = {}
    for size, rows in ((100, test), (10, test.orderBy(*catalog.ORDER).limit(30))):
        staged = replay.stage_replay(rows.select(*RATINGS.names), size, order)
        before = store.last()[0]
        timed(f"stream_batches_of_{size}", lambda: loop.run_loop(store, staged, catalog.SETTINGS, [oracle.R]))
        spent = [
            r.seconds
            for r in store.log("metrics").filter((F.col("batch") > before) & (F.col("phase") == "update")).collect()
        ]
        latency[size] = {"batches": len(spent), "p50": round(statistics.median(spent), 3), "max": round(max(spent), 3)}

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "update_latency": latency,
                "sf": FOLDER.rstrip("/").rsplit("/", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
