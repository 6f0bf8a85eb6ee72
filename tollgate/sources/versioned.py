"""Published table versions: data folders plus one manifest per version.

A transition (U1-U10) returns rows; this module publishes them as the table's next version.

* Data files are written first, each write into a folder of its own that is never changed
  again.  A version is one small manifest, ``_versions/<n>.json``, that lists the folders of
  every partition.  It appears by an atomic rename that fails if the version exists, so a
  reader sees the whole version or none of it, and of two writers one has to try again.
* A reader is pinned: ``read(version)`` names the folders of that manifest, whatever is
  published meanwhile.
* A write is scoped: ``rewrite`` replaces only the partitions that hold changed rows,
  ``append`` adds files to partitions, and all other partitions keep their files, names included.
* Publishing is idempotent by (writer, batch id): a replayed batch finds its id in the newest
  manifest and changes nothing.  A crash between data and manifest leaves folders that no
  manifest names; the replay writes new ones.

The manifest has one entry a partition (a day, a hash bucket), so it follows the number of
partitions, not of rows or files.  Partition columns stay in the data files as well.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class VersionExists(RuntimeError):
    """Another writer published this version first: read the newest one and try again."""


class _Files:
    """The shared file system of a path, through Hadoop's own client (any store Spark can reach)."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        hadoop = self._jvm.org.apache.hadoop
        conf = spark._jsc.hadoopConfiguration()
        self._fs = hadoop.fs.Path(path).getFileSystem(conf)
        self._context = hadoop.fs.FileContext.getFileContext(hadoop.fs.Path(path).toUri(), conf) if "://" in path else hadoop.fs.FileContext.getFileContext(conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write ``text`` beside ``path`` and rename it there; fails if ``path`` exists."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self._fs.create(self._path(draft), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(self._path(draft), self._path(path), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise VersionExists(path) from None
            raise


class VersionedTable:
    """A table at ``path`` whose rows are partitioned by ``partition`` (an expression over them, as text)."""

    def __init__(self, spark: SparkSession, path: str, partition: Column):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), F.coalesce(partition.cast("string"), F.lit("none"))
        self._files = _Files(spark, self.path)

    # -- versions

    def _versions(self) -> list[int]:
        return sorted(int(n[: -len(".json")]) for n in self._files.names(f"{self.path}/_versions") if n.endswith(".json"))

    def version(self) -> int | None:
        """The newest version, or None before the first."""
        return max(self._versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None or version < 0:
            return {"version": -1, "partitions": {}, "batches": {}, "schema": None}
        return json.loads(self._files.read(f"{self.path}/_versions/{version}.json"))

    def _commit(self, base: dict, partitions: dict[str, list[str]], schema: str, batch: tuple[str, int] | None) -> int:
        batches = dict(base["batches"])
        if batch:
            batches[batch[0]] = batch[1]
        n = base["version"] + 1
        text = json.dumps({"version": n, "partitions": partitions, "batches": batches, "schema": schema}, sort_keys=True)
        self._files.publish(f"{self.path}/_versions/{n}.json", text)
        return n

    @staticmethod
    def done(base: dict, batch: tuple[str, int] | None) -> bool:
        """Whether the version of this manifest holds the (writer, batch id) already."""
        return batch is not None and base["batches"].get(batch[0], -1) >= batch[1]

    def before(self, batch: tuple[str, int]) -> dict:
        """The newest manifest without the (writer, batch id): what a replay of the batch has to start from."""
        for n in reversed(self._versions()):
            m = self.manifest(n)
            if not self.done(m, batch):
                return m
        return self.manifest(-1)

    # -- data

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write ``rows`` into a new folder; each partition value's sub-folder.

        The rows are dealt by partition first, so that a partition is one file or a few, not one from
        every task; AQE splits a partition that is large and puts small ones together."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn(PART, self.partition).hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(folder)
        prefix = f"{PART}="
        return {unquote(n[len(prefix):]): f"{folder[len(self.path) + 1:]}/{n}" for n in self._files.names(folder) if n.startswith(prefix)}

    def read(self, version: int | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of one version (the newest by default); ``only`` these partitions' files."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"no version of {self.path} has been published")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        wanted = m["partitions"] if only is None else {p: m["partitions"][p] for p in only if p in m["partitions"]}
        paths = [f"{self.path}/{folder}" for folders in wanted.values() for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def partitions_of(self, rows: DataFrame) -> list[str]:
        """The partition values that ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.partition.alias("p")).distinct().collect())

    # -- publishing

    def replace(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """The whole table anew."""
        base = self.manifest()
        if self.done(base, batch):
            return base["version"]
        return self._commit(base, {p: [f] for p, f in self._write(rows).items()}, rows.schema.json(), batch)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """New rows; no file of the version before is touched."""
        base = self.manifest()
        if self.done(base, batch):
            return base["version"]
        parts = {p: list(f) for p, f in base["partitions"].items()}
        for p, folder in self._write(rows).items():
            parts.setdefault(p, []).append(folder)
        return self._commit(base, parts, base["schema"] or rows.schema.json(), batch)

    def rewrite(self, rows: DataFrame, changed: list[str], batch: tuple[str, int] | None = None) -> int:
        """``rows`` in place of the partitions ``changed``; all others keep their files.

        ``rows`` must be all the rows of those partitions, and only theirs."""
        base = self.manifest()
        if self.done(base, batch):
            return base["version"]
        parts = {p: f for p, f in base["partitions"].items() if p not in set(changed)}
        written = self._write(rows)
        stray = sorted(set(written) - set(changed))
        if stray:
            raise ValueError(f"rows of partitions that were not to be rewritten: {stray[:3]}")
        return self._commit(base, parts | {p: [f] for p, f in written.items()}, base["schema"] or rows.schema.json(), batch)
