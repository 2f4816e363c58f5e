"""State that versions follow each other in: a small table of watermarks, and incremental runs that commit it after their data.

A version's rows are Parquet in a folder of their own. What makes them the version is one small file, log/<number>, that names the folder
and is created only if it is not there: a run that dies before leaves a folder that nobody reads, and of two runs that started from the
same version one fails. Readers take the highest number. All keys of a run move together or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.functions.dates import overlap_start
from pricelattice.operators.dedup import keep_last, settled
from pricelattice.sources import sinks


class Conflict(RuntimeError):
    """Another run has committed the version that this one wanted to."""


class StateTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the newest version, 0 if there is none."""
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        n = self.version() if version is None else version
        if not n:
            return None
        stream = self._fs.open(self._path(f"{self.path}/log/{n:012d}"))
        try:
            folder = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def prepare(self, rows: DataFrame) -> str:
        """Writes rows as a folder that no version names yet."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, folder: str, after: int) -> int:
        """Makes the folder version after + 1."""
        at = self._path(f"{self.path}/log/{after + 1:012d}")
        if self._fs.exists(at):
            raise Conflict(f"version {after + 1} of {self.path} is taken")
        jvm_exceptions = self.spark.sparkContext._gateway.jvm.org.apache.hadoop.fs.FileAlreadyExistsException
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getName() == jvm_exceptions._fqn:
                raise Conflict(f"version {after + 1} of {self.path} is taken") from None
            raise
        try:
            out.write(folder.encode())
        finally:
            out.close()
        return after + 1


def advanced(state: DataFrame | None, rows: DataFrame, key: str, at: str) -> DataFrame:
    """key, last_observation_at: the newest time of each key in rows or before. A key without new rows keeps its time."""
    seen = rows.groupBy(key).agg(F.max(at).alias("last_observation_at")).filter("last_observation_at is not null")
    both = seen if state is None else state.select(key, "last_observation_at").unionByName(seen)
    return both.groupBy(key).agg(F.max("last_observation_at").alias("last_observation_at"))


def due(rows: DataFrame, state: DataFrame | None, key: str, at: str, floor, overlap_hours: int) -> DataFrame:
    """The source's rows that a run reads: of each key, from overlap_hours before its newest time on, or from the floor."""
    first = F.lit(floor).cast("timestamp")
    if state is None:
        return rows.filter(F.col(at) >= first)
    s = state.select(F.col(key).alias("_key"), "last_observation_at")
    j = rows.join(s, F.col(key).eqNullSafe(F.col("_key")), "left")
    return j.filter(F.col(at) >= overlap_start(F.col("last_observation_at").cast("timestamp"), first, overlap_hours)).drop("_key", "last_observation_at")


def run(spark: SparkSession, source: DataFrame, target: str, state_path: str, key: str, at: str, row_keys: list[str], parts: list[str], floor, late: str = "accept", overlap_hours: int = 48, before_commit=None) -> int:
    """One incremental run; the number of the committed state version. The data is written first and the state is committed after it, so
    a run that dies between is repeated over the same rows and ends alike.

    late = 'accept': rows back to overlap_hours before a key's newest time are read again and replace rows of their row_keys. late =
    'drop': partitions that are there stay as they are; only new ones are written. `parts` are partition columns of the source.
    before_commit() is called between the two (tests crash there).
    """
    if late not in ("accept", "drop"):
        raise ValueError(late)
    table = StateTable(spark, state_path)
    version, state = table.version(), table.read()
    rows = due(source, state, key, at, floor, overlap_hours if late == "accept" else 0)
    if late == "accept":
        sinks.upsert_partitions(spark, keep_last(rows, row_keys, settled(rows, row_keys)), target, row_keys, parts)
    else:
        sinks.write_missing_partitions(spark, rows, target, parts)
    folder = table.prepare(advanced(state, rows, key, at))
    if before_commit:
        before_commit()
    return table.commit(folder, version)


def stale(state: DataFrame, now, minutes: int) -> DataFrame:
    """Keys that are due: never seen, or last seen `minutes` ago or more."""
    return state.filter(F.col("last_observation_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_observation_at") >= minutes * 60))


def stale_days(state: DataFrame, today, days: int = 1) -> DataFrame:
    """Keys whose last day lies `days` calendar days back or more, whatever the hour; never seen ones too."""
    return state.filter(F.col("last_observation_at").isNull() | (F.datediff(today, F.to_date("last_observation_at")) >= days))
