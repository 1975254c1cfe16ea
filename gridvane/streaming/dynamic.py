"""A dynamic index as numbered versions of tables, fed by batches or by a stream.

One writer makes versions; readers use the last complete one. A version is a file in `current/`
that names the folders of its tables, so what a step leaves alone is not written again. It is made
from the last version below it, in a fresh folder, and named when its tables are there. A batch of a
stream that is replayed finds its versions named and leaves them; one that was cut short is made
again from the same base.

An insert or a consolidation writes what it changed (new points, lists that got or lost an edge,
points that went), not the index: a version is a base and a log of changes, merged when it is read.
After COMPACT changes the next one writes a new base; compact() does so at any time.
"""

from __future__ import annotations

import functools
import json
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance, vamana
from ..plans.tables import scratch, written

_POINTS = vamana._INDEX
_TABLES = {"index": _POINTS, "tombstones": "id bigint"}
#: Changes that a version may have beside its base.
COMPACT = 8


def _tidy(step):
    """The step without the shared tables that it made: what it leaves is named in a version."""

    @functools.wraps(step)
    def run(self, *args, **options):
        with scratch(self.spark):
            return step(self, *args, **options)

    return run


class DynamicIndex:
    """Insert, delete, consolidate and search over versions; ids are the tags, 0 is reserved."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2", degree: int = 64, width: int = 100, alpha: float = 1.2, capacity: int | None = None, frozen: int = 0):
        vamana.check_build(degree, width, alpha)
        vamana.check_metric(metric)
        self.spark, self.path, self.metric = spark, path, metric
        self.degree, self.width, self.alpha, self.capacity, self.frozen = degree, width, alpha, capacity, frozen

    # ------------------------------------------------------------ versions

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the last complete version, -1 before the first."""
        return self._below(None)

    def _below(self, version: int | None) -> int:
        """The last complete version below a number, or the last of all; -1 if there is none."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/current")):
            return -1
        done = [int(s.getPath().getName()) for s in fs.listStatus(path(f"{self.path}/current")) if s.getPath().getName().isdigit()]
        return max((v for v in done if version is None or v < version), default=-1)

    def committed(self, version: int) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.path}/current/{version}"))

    def _folders(self, version: int) -> dict:
        """The folder of each table of a version, as its commit names them, and those of its changes in order."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/current/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v < 0:
            return self.spark.createDataFrame([], _TABLES[name])
        folders = self._folders(v)
        rows = self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{folders[name]}")
        logs = folders.get("changes", []) if name == "index" else []
        if not logs:
            return rows
        read = self.spark.read.schema(vamana.CHANGES)
        parts = [read.parquet(f"{self.path}/{f}").withColumn("at", F.lit(i)) for i, f in enumerate(logs)]
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p)
        # of each point, the last list and flags, and the last vector and labels that a change carries
        last = lambda c, at=F.col("at"): F.max_by(F.when(at.isNotNull(), F.struct(c)), at)[c].alias(c)
        carried = F.when(F.col("vec").isNotNull(), F.col("at"))
        return vamana.merged(rows, log.groupBy("shard", "id").agg(last("vec", carried), last("nbrs"), last("labels", carried), last("start"), last("gone")))

    def _commit(self, version: int, base: int, changes: DataFrame | None = None, **tables: DataFrame) -> None:
        """Writes tables to a fresh folder and then names them, and the base's others, as a version.

        changes: what the version's index has beyond the base's; written as such, or as a new index
        where the base has COMPACT of them. The name appears at once by a rename; who finds it there
        already leaves it as it is.
        """
        own = f"v{version}-{uuid.uuid4().hex}"
        folders = self._folders(base) if base >= 0 else {}
        logs = folders.get("changes", [])
        if changes is not None and len(logs) >= COMPACT:
            tables["index"] = vamana.merged(self.table("index", base), written(changes))
        elif changes is not None:
            changes.write.parquet(f"{self.path}/{own}/changes")
            folders["changes"] = [*logs, f"{own}/changes"]
        if "index" in tables:
            folders["changes"] = []
        for name, t in tables.items():
            t.write.parquet(f"{self.path}/{own}/{name}")
        folders |= {name: f"{own}/{name}" for name in tables}
        fs, path = self._fs()
        made = path(f"{self.path}/current/_{own}")
        stream = fs.create(made, True)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if self.committed(version) or not fs.rename(made, path(f"{self.path}/current/{version}")):
            fs.delete(made, False)

    def _numbers(self, version: int | None) -> tuple[int, int]:
        """(the version to be made, the one it is made from)"""
        base = self._below(version)
        return (base + 1 if version is None else version), base

    # ------------------------------------------------------------ changes

    def points(self, version: int | None = None) -> DataFrame:
        """(shard, id, vec, nbrs, labels, start) without start points that are no rows."""
        return self.table("index", version).where(~vamana.is_frozen(F.col("id")))

    def n_live(self) -> int:
        return self.points().select("id").distinct().join(self.table("tombstones"), "id", "left_anti").count()

    @_tidy
    def insert(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """Adds rows(id, vec[, labels]); returns rejected(id, reason).

        When the capacity would be passed and something is deleted, the index is consolidated first
        (with a warning); if it still does not fit, RuntimeError.
        """
        version, base = self._numbers(version)
        index, dead = self.table("index", base), self.table("tombstones", base)
        old = index.where(~vamana.is_frozen(F.col("id"))).select("id", "vec").dropDuplicates(["id"])
        plain = rows.select("id", F.col("vec").cast("array<float>").alias("vec"))
        accepted, rejected = maintenance.insert_new(old, plain)
        new = accepted.join(old.select("id"), "id", "left_anti")
        n_new = new.count()
        tables = {}
        if self.capacity is not None and old.count() + n_new > self.capacity:
            if dead.isEmpty():
                raise RuntimeError(f"capacity {self.capacity} would be passed")
            warnings.warn("capacity would be passed: consolidating deletions first", stacklevel=2)
            index = written(vamana.consolidate(index, dead, self.degree, self.alpha, self.metric))
            if index.where(~vamana.is_frozen(F.col("id"))).select("id").distinct().count() + n_new > self.capacity:
                raise RuntimeError(f"capacity {self.capacity} would be passed")
            tables = {"index": index, "tombstones": dead.limit(0)}
        labels = rows.select("id", F.col("labels").cast("array<bigint>").alias("labels")).dropDuplicates(["id"]) if "labels" in rows.columns else None
        new = new.join(labels, "id", "left") if labels is not None else new
        changes = None
        if n_new and index.isEmpty():
            tables["index"] = vamana.build(new, self.degree, self.width, self.alpha, self.metric, filtered=labels is not None, frozen=self.frozen)
        elif n_new and "index" in tables:  # the index is written anew in any case
            tables["index"] = vamana.insert(index, new, self.degree, self.width, self.alpha, self.metric)
        elif n_new:
            changes = vamana.insert_changes(index, new, self.degree, self.width, self.alpha, self.metric)
        if base < 0:
            tables = {"index": index, "tombstones": dead} | tables
        self._commit(version, base, changes, **tables)
        return rejected

    def delete(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """Marks ids(id) as deleted; returns failed(id): unknown or deleted before. The index is not written again."""
        version, base = self._numbers(version)
        index = self.table("index", base)
        dead, failed = maintenance.lazy_delete(index.where(~vamana.is_frozen(F.col("id"))).select("id").distinct(), self.table("tombstones", base), ids)
        self._commit(version, base, tombstones=dead, **({"index": index} if base < 0 else {}))
        return failed

    @_tidy
    def consolidate(self, version: int | None = None) -> DataFrame:
        """Removes deleted points for good; returns a one-row report."""
        version, base = self._numbers(version)
        index, dead = self.table("index", base), self.table("tombstones", base)
        real = index.where(~vamana.is_frozen(F.col("id")))
        edges = real.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))
        report = maintenance.consolidate_report(real.select("id").distinct(), edges.where(~vamana.is_frozen(F.col("dst"))), dead, self.capacity or 0)
        self._commit(version, base, vamana.consolidate_changes(index, dead, self.degree, self.alpha, self.metric), tombstones=dead.limit(0))
        return report

    def compact(self, version: int | None = None) -> None:
        """Writes the index with its changes as a new base."""
        version, base = self._numbers(version)
        if base >= 0:
            self._commit(version, base, index=self.table("index", base))

    def search(self, queries: DataFrame, k: int, width: int, version: int | None = None, **options) -> DataFrame:
        """As vamana.search; a width below k is raised to k with a warning."""
        if width < k:
            warnings.warn(f"complexity {width} is raised to k = {k}", stacklevel=2)
            width = k
        return vamana.search(self.table("index", version), queries, k, width, self.metric, tombstones=self.table("tombstones", version), **options)

    def vector(self, tag: int):
        """The vector of a tag, or None."""
        row = self.table("index").join(self.table("tombstones"), "id", "left_anti").where(F.col("id") == tag).select("vec").first()
        return row.vec if row else None

    # ------------------------------------------------------------ streams

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of changes (op, id, vec[, seq]): inserts, then deletes, then consolidations; versions are its own.

        With a column seq the batch is a log in that order: of the changes of one id the last counts, so
        a point that is deleted and then inserted is there afterwards. An insert of an id that is there
        is rejected as always; a log that replaces points deletes and consolidates in an earlier batch.
        """
        if "seq" in batch.columns:
            last = batch.where("id is not null").groupBy("id").agg(F.max_by(F.struct("op", "vec"), "seq").alias("last")).select("last.op", "id", "last.vec")
            batch = last.unionByName(batch.where("id is null").select("op", "id", "vec"))
        batch = batch.persist()
        try:
            ops = {r.op for r in batch.select("op").distinct().collect()}
            if "insert" in ops and not self.committed(4 * number + 1):
                self.insert(batch.where("op = 'insert'").select("id", "vec"), 4 * number + 1)
            if "delete" in ops and not self.committed(4 * number + 2):
                self.delete(batch.where("op = 'delete'").select("id"), 4 * number + 2)
            if "consolidate" in ops and not self.committed(4 * number + 3):
                self.consolidate(4 * number + 3)
        finally:
            batch.unpersist()

    def stream(self, changes: DataFrame, checkpoint: str, **trigger):
        """Starts a query that applies a stream of changes; checkpoint is its folder."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sliding_window(index: DynamicIndex, points: DataFrame, active: int, interval: int) -> list[dict]:
    """Runs the window over points(position, vec): tags are 1 + position.

    The first `active` points go in, then each step adds `interval` and, once there is something to
    drop, deletes those that have left the window and consolidates. Returns (step, live) of each step.
    """
    total = points.count()
    maintenance.check_window(active, interval, total)
    tagged = points.select((F.col("position") + 1).alias("id"), "vec", "position")
    index.insert(tagged.where(F.col("position") < active).select("id", "vec"))
    done = []
    for s in range(active, total, interval):
        index.insert(tagged.where((F.col("position") >= s) & (F.col("position") < s + interval)).select("id", "vec"))
        if s >= active + interval:
            lo = s - active - interval
            index.delete(tagged.where((F.col("position") >= lo) & (F.col("position") < s - active)).select("id"))
            index.consolidate()
        done.append({"step": s, "live": index.n_live()})
    return done
