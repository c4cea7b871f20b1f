"""Relations kept as parquet in a shared folder: a base version, and the rows changed since.

A base version, from ``bootstrap`` or ``compact``, is laid out in buckets by lookup key
and sorted inside them. Every later version is one table of all rows it changed, each
under the name of its relation. Reading takes the newest row of each key up to the last
commit; ``find`` opens only the buckets of the wanted keys and the changes. A commit is a
small text put in place in one step: it names the versions that are alive, and those that
were replaced, which are deleted once no reader can be using them any more.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from driftsim.operators import increment
from driftsim.operators.keys import lookup
from driftsim.operators.pairs import ranked_list, unranked
from driftsim.plans.bootstrap import Relations
from driftsim.schemas import COUNTERS, LOGS, STATE, TRUST_STATE
from driftsim.session import LOCAL_ROWS, SHUFFLE_CLEANUP_CONF, Held, among, durable, held, hold, id_frame, is_local
from driftsim.sources import folders

#: Seconds for which a replaced version stays, for readers that have opened it.
KEEP_SECONDS = 600.0
#: Where a base in lists lies, and the lookup keys that a file of it may have.
PACKED, PART_KEYS = "packed", 8192
#: Commits that stay readable.
COMMITS = 3
#: So many wanted keys also go to the scan as a filter, which skips row groups.
FILTER_KEYS = 100
_NONE = -1  # no bucket's number
_REPEATED = {"user_ratings"}  # may hold several rows of one key
# Relations stored as one ranked array per key, and the fields of an entry.
_LISTS = {"neighbors": ("item_id", ["neighbor_id", "sim"]), "recommendations": ("user_id", ["item_id", "pred"])}


@dataclass(frozen=True)
class Head:
    """A commit. ``changes``: version and number of rows of each one after the base;
    ``retired``: folder, and when it was replaced; ``streams``: the last epoch of each."""

    version: int
    base: int
    buckets: int
    changes: list = field(default_factory=list)
    retired: list = field(default_factory=list)
    streams: dict = field(default_factory=dict)


@dataclass(frozen=True)
class StoredRelations(Relations):
    """Relations of a store, which looks keys up by bucket."""

    store: StateStore | None = None
    head: Head | None = None
    #: How many items of each batch were drawn with the base, if any were.
    drawn_ahead: int = 0

    def find(self, name: str, wanted: DataFrame, on: list[str]) -> DataFrame:
        return self.store.find(name, wanted, on, self.head)

    def hold(self, name: str, ids: np.ndarray) -> Held:
        return self.store.hold(name, ids, self.head)

    def rows_of(self, name: str, ids: np.ndarray) -> DataFrame:
        return self.store.rows_of(name, ids, self.head)

    def hold_pairs(self, wanted: Held) -> Held:
        return self.store.hold("pair_info", wanted.ids("item_i"), self.head, wanted)

    def candidates(self, n: int, seed: int, batch: int) -> DataFrame:
        return self.store.candidates(n, seed, batch, self.head, self.drawn_ahead)


class StateStore:
    """``buckets`` applies to bases written from here on; a stored base keeps its own number.

    ``layout`` has the relations: schema, key and lookup columns by name.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 1, keep_seconds: float = KEEP_SECONDS, layout: dict = STATE | COUNTERS):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.buckets = buckets
        self.keep_seconds = keep_seconds
        self.layout = layout
        self._bases: dict = {}
        self._changed: tuple = (None, {})
        self._rows: dict[int, int] = {}

    # ------------------------------------------------------------ commits

    def _head(self) -> Head | None:
        found = [n for n in folders.names(self.spark, f"{self.folder}/commits") if n.endswith(".json")]
        return Head(**json.loads(folders.read_text(self.spark, f"{self.folder}/commits/{found[-1]}"))) if found else None

    def last(self) -> tuple[int, int] | None:
        """Version and base of the newest commit."""
        head = self._head()
        return (head.version, head.base) if head else None

    def applied(self, stream: str, epoch: int) -> bool:
        """Whether the epoch of a stream, or a later one, was committed."""
        head = self._head()
        return bool(head) and head.streams.get(stream, -1) >= epoch

    def commit(self, version: int, base: int, stream: str = "", epoch: int = -1) -> None:
        """Make a version visible. Written last, so a version cut short is never seen.

        Only what an earlier commit has replaced is deleted before, and what this one
        replaces after it: if that is cut short, the commit still names it and the next
        one deletes it again.
        """
        old, now = self._head() or Head(-1, -1, self.buckets), time.time()
        streams = old.streams | ({stream: epoch} if stream else {})
        due = self._expired(old.retired, now)
        retired = [r for r in old.retired if r not in due]
        if version == base:
            gone = [f"{name}/v={old.base}" for name in (*self.layout, "draws") if old.base >= 0] + [f"changes/v={v}" for v, _ in old.changes]
            head = Head(version, base, self.buckets, [], retired + [[path, now] for path in gone], streams)
        else:
            rows = self._rows.pop(version, None)
            if rows is None:
                rows = self.spark.read.schema("part string").parquet(f"{self.folder}/changes/v={version}").count()
            head = Head(version, old.base, old.buckets, [*old.changes, [version, rows]], retired, streams)
        folders.write_text(self.spark, f"{self.folder}/commits/{version:012d}.json", json.dumps(head.__dict__))
        self._expired(head.retired, now)
        for name in folders.names(self.spark, f"{self.folder}/commits")[:-COMMITS]:
            folders.delete(self.spark, f"{self.folder}/commits/{name}")

    def _expired(self, retired: list, now: float) -> list:
        """Delete what was replaced long enough ago."""
        due = [r for r in retired if r[1] + self.keep_seconds <= now]
        for path, _ in due:
            folders.delete(self.spark, f"{self.folder}/{path}")
        return due

    def sweep(self) -> None:
        """Delete bases and changes that no commit names, left by work that was cut short."""
        head = self._head()
        named = {path for path, _ in head.retired} | {f"{name}/v={head.base}" for name in (*self.layout, "draws")} | {f"changes/v={v}" for v, _ in head.changes}
        for parent in (*self.layout, "draws", "changes"):
            for name in folders.names(self.spark, f"{self.folder}/{parent}"):
                if f"{parent}/{name}" not in named:
                    folders.delete(self.spark, f"{self.folder}/{parent}/{name}")

    # ------------------------------------------------------------ writing

    def write(
        self, version: int, name: str, rows: DataFrame, base: bool = False, owners: DataFrame | None = None
    ) -> DataFrame:
        """Put rows of one relation under a version not yet committed, and return them as read back.

        ``owners`` are keys whose list is replaced even if nothing is left in it.
        """
        rows = stored_form(name, rows, owners, self.layout)
        schema = self.layout[name][0]
        if base:
            path = self._put_base(version, name, rows)
        else:
            path = f"{self.folder}/changes/v={version}/part={name}"
            rows.write.mode("overwrite").parquet(path)
        return _flat(name, self.spark.read.schema(schema).parquet(path).select(*schema.names))

    def write_changes(self, version: int, parts: dict[str, DataFrame]) -> None:
        """All changed rows of a version (in ``stored_form``) as one table, written by one job."""
        tagged_union(parts).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/changes/v={version}")

    def note_rows(self, version: int, rows: int) -> None:
        """How many changed rows a version has, where the caller knows."""
        self._rows[version] = rows

    def _put_base(self, version: int, name: str, rows: DataFrame) -> str:
        path = f"{self.folder}/{name}/v={version}"
        key, by = self.layout[name][1:]
        writer = rows
        if by and self.buckets > 1:
            # Rebalancing splits a bucket that one key has made large.
            writer = rows.withColumn("bucket", _bucket(by, self.buckets)).hint("rebalance", "bucket")
        else:
            writer = rows.withColumn("bucket", F.lit(0))
        if key:
            # Sorted, so that few row groups hold a key.
            writer = writer.sortWithinPartitions("bucket", *key)
        writer = writer.write.mode("overwrite").partitionBy("bucket")
        for column in by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
        return path

    def _put_parts(self, version: int, name: str, parts: list[DataFrame]) -> None:
        """The base of a relation too large to be shuffled, in lists as the tasks return them."""
        path = f"{self.folder}/{name}/v={version}/{PACKED}"
        by = self.layout[name][2]
        before = self.spark.conf.get(SHUFFLE_CLEANUP_CONF)
        try:
            self.spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
            for nth, rows in enumerate(parts):
                rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self._packed(name)))
                writer = rows.write.mode("append" if nth else "overwrite").option("compression", "zstd")
                for column in by:
                    # Many files, each of few keys: a filter of the usual size would be as large as the rows.
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(PART_KEYS))
                writer.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP_CONF, before)

    def _packed(self, name: str) -> StructType:
        """Rows of a relation in lists: the lookup key once, and an array of each other column."""
        schema, _, by = self.layout[name]
        return StructType([f if f.name in by else StructField(f.name, ArrayType(f.dataType)) for f in schema.fields])

    def append_log(self, version: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/part={name}/v={version}")

    def append_logs(self, version: int, parts: dict[str, DataFrame]) -> None:
        """Several logs of a batch, by one job; what a batch wrote before it was cut short is replaced."""
        rows = tagged_union({name: logged(name, rows) for name, rows in parts.items()}).withColumn("v", F.lit(version))
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part", "v").parquet(f"{self.folder}/log")

    def log(self, name: str) -> DataFrame:
        """A log up to the last commit."""
        version, _ = self.last()
        reader = self.spark.read
        if name in LOGS:
            reader = reader.schema(StructType([*LOGS[name].fields, StructField("v", IntegerType())]))
        return reader.parquet(f"{self.folder}/log/part={name}").filter(F.col("v") <= version)

    # ------------------------------------------------------------ reading

    def read(self, name: str) -> DataFrame:
        """A relation as of the last commit."""
        return _flat(name, self._stored(name, self._head()))

    def find(self, name: str, wanted: DataFrame, on: list[str], head: Head | None = None) -> DataFrame:
        """Rows of a relation whose key is wanted, out of the buckets that can hold them.

        A few wanted keys at hand are a filter of the scan as well.
        """
        head = head or self._head()
        key, by = self.layout[name][1:]
        keep = []
        if by and set(by) <= set(on):
            own = wanted.select(*by)
            if is_local(own):
                values = {r[0] for r in own.collect()}
                if len(values) <= FILTER_KEYS:
                    keep.append(F.col(by[0]).isin(sorted(v for v in values if v is not None)))
            if head.buckets > 1:
                # Bucket numbers only: at most as many as there are buckets.
                numbers = wanted.select(_bucket(by, head.buckets).alias("bucket"))
                numbers = numbers if is_local(numbers) else numbers.distinct()
                keep.append(F.col("bucket").isin([_NONE, *sorted({r.bucket for r in numbers.collect()})]))
        return _flat(name, self._stored(name, head, keep, lambda rows: lookup(rows, wanted, on)))

    def hold(self, name: str, ids: np.ndarray, head: Head | None = None, wanted: Held | None = None) -> Held:
        """Rows of a relation whose lookup key is among a few ids, at the driver: one scan of their buckets.

        ``wanted`` narrows them to whole keys. The changes since the base are laid over
        the rows of the base as they arrive.
        """
        head = head or self._head()
        schema, key, by = self.layout[name]
        if not self._is_small(head):
            rows = self.rows_of(name, ids, head)
            return hold(rows if wanted is None else lookup(rows, wanted.frame, list(key)))
        rows = self._base(name, head.base)
        for condition in self._scan_filters(by, ids, head):
            rows = rows.filter(condition)
        rows = rows.select(*schema.names)
        if wanted is not None:
            rows = lookup(rows.filter(among(key[1], wanted.ids(key[1]))), wanted.frame, list(key))
        table = rows.toArrow()
        if head.changes:
            changed = self._changes(name, head).table
            asked = changed.filter(pc.is_in(changed.column(by[0]), pa.array(ids, pa.int64())))
            if wanted is not None:
                asked = asked.filter(_key_in(asked, wanted.table, key))
            old = table.filter(pc.invert(_key_in(table, asked, key)))
            table = pa.concat_tables([old, asked.cast(old.schema)])
        return held(self.spark, _flat_table(name, table))

    def rows_of(self, name: str, ids: np.ndarray, head: Head | None = None) -> DataFrame:
        """Rows of a relation whose lookup key is among a few ids, as a plan."""
        head = head or self._head()
        by = self.layout[name][2]
        return _flat(name, self._stored(name, head, self._scan_filters(by, ids, head), lambda rows: rows.filter(among(by[0], ids))))

    def _scan_filters(self, by: tuple, ids: np.ndarray, head: Head) -> list:
        found = [among(by[0], ids)]
        if head.buckets > 1:
            numbers = id_frame(self.spark, by[0], ids).select(_bucket(by, head.buckets).alias("bucket")).collect()
            found.append(F.col("bucket").isin([_NONE, *sorted({r.bucket for r in numbers})]))
        return found

    def draw_ahead(self, n: int, seed: int, versions: int) -> None:
        """Draw the n first items of each of the next ``versions`` out of the base's, once for a base.

        The base never changes and draws go by hash, so whoever draws gets the same.
        """
        head = self._head()
        path = self._draws(head, n, seed)
        if not folders.exists(self.spark, f"{path}/_SUCCESS"):
            rows = increment.drawn_ahead(self._base("item_info", head.base), n, seed, head.base + 1, head.base + versions)
            rows.write.mode("overwrite").partitionBy("version").parquet(path)

    def _draws(self, head: Head, n: int, seed: int) -> str:
        return f"{self.folder}/draws/v={head.base}/of={seed}x{n}"

    def candidates(self, n: int, seed: int, batch: int, head: Head | None = None, ahead: int = 0) -> DataFrame:
        """(item_id) of known items, with the n first drawn in a batch among them; one may come twice.

        Those drawn ``ahead`` for the batch and all items changed since are enough;
        without them the items of the base are scanned.
        """
        head = head or self._head()
        path = f"{self._draws(head, ahead, seed)}/version={batch}"
        if n <= ahead and folders.exists(self.spark, path):
            drawn = self.spark.read.schema("item_id long, draw string").parquet(path).orderBy("draw", "item_id").limit(n)
        else:
            drawn = increment.drawn(self._base("item_info", head.base), n, seed, batch)
        drawn = drawn.select("item_id")
        return drawn.unionByName(self._changed_rows("item_info", head).select("item_id")) if head.changes else drawn

    def relations(self, whole: bool = True, drawn_ahead: int = 0) -> Relations:
        """The relations as of the last commit.

        Without ``whole`` only the popular items are there as a frame; the others can be
        looked up, and cost nothing until they are.
        """
        head = self._head()
        found = {name: _flat(name, self._stored(name, head)) if whole or name == "popular" else None for name in STATE}
        return StoredRelations(**found, store=self, head=head, drawn_ahead=drawn_ahead)

    def load(self, k: int) -> Relations:
        """The stored relations with only the first ``k`` neighbours of each item."""
        found = self.relations()
        lists = unranked(self._stored("neighbors", found.head), "item_id", "neighbors", k)
        return replace(found, neighbors=lists)

    def _stored(self, name: str, head: Head, keep=(), narrow=lambda rows: rows) -> DataFrame:
        """A relation as of ``head``; ``keep`` filters the base's scan, ``narrow`` both parts."""
        schema, key, by = self.layout[name]
        if not key:
            # Every version holds the whole list.
            if head.version != head.base:
                return self._changed_rows(name, head).select(*schema.names)
            return self._base(name, head.base).select(*schema.names)
        rows = self._base(name, head.base)
        for condition in keep:
            rows = rows.filter(condition)
        rows = narrow(rows.select(*schema.names))
        if not head.changes:
            return rows
        changed = narrow(self._changed_rows(name, head))
        gone = changed.select(*key)
        touched = self._touched(name, head) if self._lists(name, head.base) is not None else None
        if touched is not None:
            # Few of the rows can have been replaced: only those with a lookup key that was
            # changed meet the changed keys, and the base is not shuffled.
            kept = rows.join(touched, list(by), "left_semi").join(gone, list(key), "left_anti").select(*schema.names)
            rows = rows.join(touched, list(by), "left_anti").select(*schema.names).unionByName(kept)
            return rows.unionByName(changed.select(*schema.names))
        return rows.join(gone, list(key), "left_anti").select(*schema.names).unionByName(changed.select(*schema.names))

    def _touched(self, name: str, head: Head) -> DataFrame | None:
        """The lookup keys of all changed rows, to be broadcast; None if so few rows are changed or so many keys."""
        if self._is_small(head):
            return None
        touched = durable(self._changed_rows(name, head).select(*self.layout[name][2]).distinct())
        return F.broadcast(touched) if touched.count() <= LOCAL_ROWS else None

    def lists_and_rows(self, name: str) -> tuple[DataFrame | None, DataFrame]:
        """A relation as of the last commit: those of its lists in which no row was changed, and all other rows.

        Without lists, or if many were changed, all are rows.
        """
        head = self._head()
        lists, (schema, key, by) = self._lists(name, head.base), self.layout[name]
        if lists is None:
            return None, self.read(name)
        if not head.changes:
            return lists, self.spark.createDataFrame([], schema)
        changed = self._changed_rows(name, head).select(*schema.names)
        touched = self._touched(name, head)
        if touched is None:
            if not self._is_small(head):
                return None, self.read(name)
            touched = F.broadcast(changed.select(*by).distinct())
        rest = _unpacked(lists.join(touched, list(by), "left_semi").select(*schema.names), by)
        rest = rest.join(changed.select(*key), list(key), "left_anti").select(*schema.names)
        return lists.join(touched, list(by), "left_anti").select(*schema.names), rest.unionByName(changed)

    def _base(self, name: str, version: int) -> DataFrame:
        """The base of a relation, which never changes: its files are listed once."""
        if (name, version) not in self._bases:
            path = f"{self.folder}/{name}/v={version}"
            schema = StructType([*self.layout[name][0].fields, StructField("bucket", IntegerType())])
            if name in COUNTERS and not folders.exists(self.spark, path):
                return self.spark.createDataFrame([], schema)
            self._bases = {k: v for k, v in self._bases.items() if k[1] == version}
            lists = self._lists(name, version)
            if lists is None:
                self._bases[name, version] = self.spark.read.schema(schema).parquet(path)
            else:
                # Not in buckets.
                self._bases[name, version] = _unpacked(lists, self.layout[name][2]).withColumn("bucket", F.lit(_NONE))
        return self._bases[name, version]

    def _lists(self, name: str, version: int) -> DataFrame | None:
        """The base of a relation as it lies in lists, if it does."""
        path = f"{self.folder}/{name}/v={version}/{PACKED}"
        if self.layout is not TRUST_STATE or not folders.exists(self.spark, path):
            return None
        return self.spark.read.schema(self._packed(name)).parquet(path)

    def _is_small(self, head: Head) -> bool:
        return sum(rows for _, rows in head.changes) <= LOCAL_ROWS

    def _changes(self, name: str, head: Head) -> Held:
        """The newest changed row of each key since the base, read once for all relations."""
        if self._changed[0] != head.version:
            self._changed = (head.version, self._local_changes(head))
        return self._changed[1][name]

    def _changed_rows(self, name: str, head: Head) -> DataFrame:
        """The newest changed row of each key since the base; up to LOCAL_ROWS are local data."""
        if self._is_small(head):
            return self._changes(name, head).frame
        schema, key, _ = self.layout[name]
        rows = self._read_changes(head, [*schema.fields]).filter(F.col("part") == name).drop("part")
        if not key:
            return rows.filter(F.col("v") == head.version).drop("v")
        rest = [c for c in schema.names if c not in key]
        if name in _REPEATED:
            # A version's rows of a key replace all earlier ones. A key has a row for each
            # time it was rated and each version since the base, however large its user is.
            every = F.collect_list(F.struct("v", *rest))
            found = rows.groupBy(*key).agg(every.alias("every"), F.max("v").alias("newest"))
            last = F.filter("every", lambda x: x["v"] == F.col("newest"))
            return found.select(*key, F.inline(last)).drop("v")
        newest = F.max_by(F.struct(*rest), "v").alias("row")
        return rows.groupBy(*key).agg(newest).select(*key, "row.*")

    def _read_changes(self, head: Head, fields: list[StructField]) -> DataFrame:
        layout = [StructField("v", LongType()), StructField("part", StringType())]
        paths = [f"{self.folder}/changes/v={v}" for v, _ in head.changes]
        return self.spark.read.schema(StructType([*fields, *layout])).option("basePath", f"{self.folder}/changes").parquet(*paths)

    def _local_changes(self, head: Head) -> dict[str, Held]:
        fields = {f.name: f for schema, *_ in self.layout.values() for f in schema.fields}
        every = self._read_changes(head, list(fields.values())).toArrow()
        parts, versions = every.column("part").to_numpy(), every.column("v").to_numpy()
        out = {}
        for name, (schema, key, _) in self.layout.items():
            mine = parts == name
            rows = every.filter(pa.array(mine)).select(list(schema.names))
            v = versions[mine]
            if key:
                keys = rows.select(list(key)).to_pandas().assign(v=v)
                rows = rows.filter(pa.array((keys["v"] == keys.groupby(list(key), dropna=False)["v"].transform("max")).to_numpy(bool)))
            else:
                rows = rows.filter(pa.array(v == head.version))
            out[name] = held(self.spark, rows)
        return out

    # ------------------------------------------------------------ whole versions

    def bootstrap(self, build, topr) -> Relations:
        """Store freshly built relations as version 0.

        ``build`` gets a function that stores one relation by name, ``topr`` derives the
        recommendations from the stored ones. Fails if the folder holds a state already.
        """
        if self.last() is not None:
            raise FileExistsError(f"{self.folder} holds a state already")
        found = build(lambda name, rows: self.write(0, name, rows, base=True))
        recommendations = self.write(0, "recommendations", topr(found), base=True)
        self.commit(0, 0)
        return replace(found, recommendations=recommendations)

    def start(self, relations: dict[str, DataFrame | list[DataFrame]]) -> None:
        """Store all relations of the layout as version 0. Fails if the folder holds a state already.

        A relation may come in parts of lists (a lookup key, and arrays of the other columns),
        which are written one after another.
        """
        if self.last() is not None:
            raise FileExistsError(f"{self.folder} holds a state already")
        for name in self.layout:
            if isinstance(relations[name], list):
                self._put_parts(0, name, relations[name])
            else:
                self.write(0, name, relations[name], base=True)
        self.commit(0, 0)

    def compact(self) -> None:
        """Write every relation whole, as the base of a new version, and delete what is long replaced."""
        head = self._head()
        version = head.version + 1
        for name in self.layout:
            self._put_base(version, name, self._stored(name, head))
        self.commit(version, version)
        self.sweep()

    def truncate(self) -> None:
        """Commit a new version in which every relation is empty."""
        last = self.last()
        version = last[0] + 1 if last else 0
        for name, (schema, *_) in self.layout.items():
            self._put_base(version, name, self.spark.createDataFrame([], schema))
        self.commit(version, version)


def stored_form(name: str, rows: DataFrame, owners: DataFrame | None = None, layout: dict = STATE | COUNTERS) -> DataFrame:
    """Rows of a relation as they are stored: its schema, and ranked lists as one array per key."""
    schema = layout[name][0]
    if name in _LISTS:
        key, fields = _LISTS[name]
        rows = ranked_list(rows, key, fields, name)
        if owners is not None:
            empty = F.array().cast(schema[name].dataType)
            rows = owners.select(key).join(rows, key, "left").withColumn(name, F.coalesce(name, empty))
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def logged(name: str, rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS[name].fields))


def tagged_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several shapes in one frame; ``part`` says which shape a row has."""
    found = None
    for name, rows in parts.items():
        rows = rows.withColumn("part", F.lit(name))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _unpacked(lists: DataFrame, by: tuple) -> DataFrame:
    """Lists of a relation as its rows."""
    return lists.select(*by, F.inline(F.arrays_zip(*(c for c in lists.columns if c not in by))))


def _flat(name: str, rows: DataFrame) -> DataFrame:
    if name in _LISTS:
        key, _ = _LISTS[name]
        return unranked(rows, key, name)
    return rows


def _flat_table(name: str, table: pa.Table) -> pa.Table:
    """``_flat`` of a table at the driver."""
    if name not in _LISTS:
        return table
    key, fields = _LISTS[name]
    lists = table.column(name).combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    entries = lists.flatten()
    rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    columns = {key: table.column(key).take(pa.array(np.repeat(np.arange(len(size)), size)))}
    columns |= {f: entries.field(f) for f in fields} | {"rank": pa.array(rank.astype(np.int32))}
    return pa.table(columns)


def _key_in(rows: pa.Table, others: pa.Table, key: tuple) -> pa.Array:
    """Whether the key of each row is that of one of the others."""
    if len(key) == 1:
        return pc.is_in(rows.column(key[0]), others.column(key[0]).combine_chunks())
    mine, theirs = (pd.MultiIndex.from_frame(t.select(list(key)).to_pandas()) for t in (rows, others))
    return pa.array(mine.isin(theirs), pa.bool_())


def _bucket(by, buckets: int):
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
