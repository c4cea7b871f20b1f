"""Spark session defaults, and where intermediate data is kept."""

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "driftsim", **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: AQE on and UTC clocks."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. A folder of our own is
    made only in local mode with the setting absent.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="driftsim-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, last_use: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Later reads all see the same rows, survive lost executors, prune columns, and know
    the size of the data, so Spark broadcasts it only when it measures small. With
    ``last_use`` the files shuffled on the way are deleted once the rows are written, and
    not when the driver's memory happens to be collected.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "frame")
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF)
    try:
        if last_use:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def few_records(spark: SparkSession, records: int = 1024):
    """Rows that hold long lists go to Python in batches of so many."""
    before = spark.conf.get(BATCH_CONF)
    try:
        spark.conf.set(BATCH_CONF, str(min(records, int(before)) if int(before) > 0 else records))
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


#: A frame with more rows than this is never held as local data.
LOCAL_ROWS = 200_000
_calm: dict[str, SparkSession] = {}


def calm_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for plans over small local frames.

    Its shuffles have one partition, nothing is broadcast, compiled or planned anew while
    running, so that a plan over local data is one job of a few short tasks. Tables are
    read and large frames made in the caller's own session.
    """
    key = spark.sparkContext.applicationId
    if key not in _calm:
        calm = spark.newSession()
        for name, value in {
            "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "1",
            "spark.sql.leafNodeDefaultParallelism": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.sql.optimizer.disableHints": "true",
            "spark.sql.session.timeZone": "UTC",
        }.items():
            calm.conf.set(name, value)
        _calm[key] = calm
    return _calm[key]


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table as a local frame."""
    if not table.num_rows:
        table = pa.Table.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)
    return calm_session(spark).createDataFrame(table)


@dataclass(frozen=True)
class Held:
    """A small table at the driver, and the local frame of its rows."""

    table: pa.Table
    frame: DataFrame

    def ids(self, column: str) -> np.ndarray:
        """The distinct values of an id column, without null."""
        return distinct_ids(self.table.column(column))


def distinct_ids(*columns) -> np.ndarray:
    values = [c.drop_null().to_numpy() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return np.unique(np.concatenate(values).astype(np.int64))


def held(spark: SparkSession, table: pa.Table) -> Held:
    return Held(table, local_table(spark, table))


def hold(df: DataFrame) -> Held:
    """``df`` as local data, by one action. For frames whose size a parameter bounds."""
    return held(df.sparkSession, df.toArrow())


def local(df: DataFrame) -> DataFrame:
    return hold(df).frame


def id_frame(spark: SparkSession, name: str, ids: np.ndarray) -> DataFrame:
    """Ids as a local frame of one column."""
    return local_table(spark, pa.table({name: pa.array(ids, pa.int64())}))


def among(column: str, ids: np.ndarray) -> Column:
    """Whether a column is one of the ids, as a filter that scans understand."""
    return F.expr(f"`{column}` in ({', '.join(f'{i}L' for i in ids.tolist())})") if len(ids) else F.lit(False)


def is_local(df: DataFrame) -> bool:
    """Whether the rows are at the driver already, so that reading them takes no job."""
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"
