"""A sharded table kept by size-tiered compaction under a versioned manifest. DataFrame functions only.

Arrivals are appended as runs: folders of small immutable Parquet shards. A manifest lists the live shards of one version with their
runs and sizes. Compaction puts runs into tiers by size, each tier four times the one below; runs that share a tier are merged into
files of the target size, and a new manifest that names the merged run in their place is committed. A merge is a scan whose partitions
are packed by the shards' sizes, so it needs no shuffle.

A commit has two steps. The manifest is written as Parquet under a name that nobody else uses. Then one small file named after the
version, whose text is that name, is put in place by an operation that fails if the file exists: a hard link on a local disk, else a
rename without overwriting, which HDFS and stores with its semantics do in one step. So a version is there whole or not at all, of two
writers of a version exactly one succeeds, and the other gets :class:`VersionExists` and may start again from the latest version.
What no version names is invisible, so a job that dies in the middle leaves only waste.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm.common import delete_folder, prepare, shared_folder

TARGET_BYTES = 128 << 20
#: Growth of a tier's sizes, and the number of runs of a tier that a merge needs at least.
TIER_FACTOR = 4
LEAST_RUNS = 2
#: Runs that one bulk load is dealt into.
ARRIVALS = 16
_MANIFEST = "version int, run string, path string, bytes long"


class VersionExists(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Store:
    """A sharded table under ``root``, a path that Spark can write to.

    On the driver are the names of the runs of a version, and of its versions: the table's size divided by the target, once compacted.
    """

    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed versions, the oldest first."""
        found = self._files(self._path("versions")).globStatus(self._path("versions/v*")) or []
        return sorted(int(m[1]) for status in found if (m := re.fullmatch(r"v(\d+)", status.getPath().getName())))

    def latest(self) -> int | None:
        """The last committed version; None for a store without any."""
        return max(self.versions(), default=None)

    def _manifest_folder(self, version: int) -> str:
        rows = self.spark.read.text(f"{self.root}/versions/v{version:06d}").collect()
        return f"{self.root}/manifests/{rows[0]['value']}"

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(self._manifest_folder(version))

    def _commit(self, version: int, shards: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows = shards.select(F.lit(version).alias("version"), "run", "path", "bytes")
        rows.coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        self._put(f"versions/v{version:06d}", name)

    def _put(self, name: str, text: str) -> None:
        """Creates a file with its whole content in one step, or raises VersionExists if it is there."""
        jvm, target, draft = self.spark.sparkContext._jvm, self._path(name), self._path(f"drafts/{uuid.uuid4().hex}")
        files = self._files(target)
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            files.mkdirs(target.getParent())
            if files.getUri().getScheme() == "file":
                at = [jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(files.makeQualified(p).toUri().toString())) for p in (target, draft)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(files.makeQualified(draft), files.makeQualified(target), options)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise VersionExists(name) from None
            raise
        finally:
            files.delete(draft, False)

    def _shards(self, folder: str) -> DataFrame:
        """(run, path, bytes) of the shards below a folder, from the file listing; contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("run"), "path", F.col("length").alias("bytes"))

    def _folder(self) -> str:
        """A place for shards that no other writer uses."""
        return f"{self.root}/shards/{uuid.uuid4().hex}"

    def load(self, rows: DataFrame, arrivals: int = ARRIVALS) -> int:
        """Version 1: each task appends its rows to one of ``arrivals`` runs."""
        run = next(name for k in range(len(rows.columns) + 1) if (name := f"run{k or ''}") not in {c.lower() for c in rows.columns})
        folder = self._folder()
        rows.withColumn(run, F.pmod(F.spark_partition_id(), F.lit(arrivals))).write.partitionBy(run).parquet(folder)
        self._commit(1, self._shards(folder))
        return 1

    def append(self, version: int, rows: DataFrame) -> int:
        """Adds one run to ``version`` and returns the new version."""
        folder = f"{self._folder()}/run=0"
        rows.write.parquet(folder)
        self._commit(version + 1, self.manifest(version).drop("version").unionByName(self._shards(folder)))
        return version + 1

    def append_to_latest(self, rows: DataFrame) -> int:
        """Adds one run to the latest version, whatever other writers commit meanwhile; rows are written once."""
        folder = f"{self._folder()}/run=0"
        rows.write.parquet(folder)
        while True:
            version = self.latest() or 0
            shards = self._shards(folder)
            try:
                self._commit(version + 1, self.manifest(version).drop("version").unionByName(shards) if version else shards)
            except VersionExists:
                continue
            return version + 1

    def _tiers(self, version: int, target_bytes: int, least_runs: int) -> DataFrame:
        of_run = self.manifest(version).groupBy("run").agg(F.sum("bytes").alias("bytes"), F.avg("bytes").alias("mean"))
        small = of_run.where(F.col("mean") < target_bytes / 2)
        tier = F.floor(F.log(float(TIER_FACTOR), F.greatest(F.col("bytes"), F.lit(1)))).cast("int")
        tiers = small.groupBy(tier.alias("tier")).agg(F.sort_array(F.collect_list("run")).alias("runs"), F.sum("bytes").alias("bytes"))
        return tiers.where(F.size("runs") >= least_runs)

    def plan(self, version: int, target_bytes: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> list:
        """(tier, runs, bytes) of each tier to merge. Runs whose shards have the target size already stay as they are."""
        return self._tiers(version, target_bytes, least_runs).select("tier", "runs", "bytes").orderBy("tier").collect()

    def compact(self, version: int, target_bytes: int = TARGET_BYTES, least_runs: int = LEAST_RUNS) -> int:
        """Merges every tier that holds enough runs and commits the result as the next version; the same version if none does."""
        merges = self.plan(version, target_bytes, least_runs)
        if not merges:
            return version
        merged = self._tiers(version, target_bytes, least_runs).select(F.explode("runs").alias("run"))
        live = self.manifest(version).drop("version").join(merged, "run", "left_anti")
        for row in merges:
            folder = f"{self._folder()}/tier={row['tier']}"
            with self._scan_by_size(target_bytes):
                self.spark.read.parquet(*row["runs"]).write.parquet(folder)
            live = live.unionByName(self._shards(folder))
        self._commit(version + 1, live)
        return version + 1

    @contextmanager
    def _scan_by_size(self, target_bytes: int) -> Iterator[None]:
        """While it lasts, a scan packs files into partitions of at most the target, by their sizes alone, and splits larger ones."""
        wanted = {"maxPartitionBytes": str(target_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}
        before = {name: self.spark.conf.get(f"spark.sql.files.{name}", None) for name in wanted}
        for name, value in wanted.items():
            self.spark.conf.set(f"spark.sql.files.{name}", value)
        try:
            yield
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(f"spark.sql.files.{name}")
                else:
                    self.spark.conf.set(f"spark.sql.files.{name}", value)

    def read(self, version: int, empty: DataFrame) -> DataFrame:
        """The rows of a version; ``empty`` gives the columns if it has none."""
        runs = [row["run"] for row in self.manifest(version).select("run").distinct().orderBy("run").collect()]
        return self.spark.read.schema(empty.schema).parquet(*runs) if runs else empty.where(F.lit(False))

    def vacuum(self, version: int) -> None:
        """Removes the versions before ``version``, then their manifests and the runs that only they name."""
        older = [v for v in self.versions() if v < version]
        live = self.manifest(version).select("run").distinct()
        dead = {row["run"] for old in older for row in self.manifest(old).select("run").distinct().join(live, "run", "left_anti").collect()}
        for old in older:
            folder = self._manifest_folder(old)
            self._files(self._path("versions")).delete(self._path(f"versions/v{old:06d}"), False)
            delete_folder(self.spark, folder)
        for run in sorted(dead):
            delete_folder(self.spark, run)


def shard_table(rows: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[Store, int]:
    """Loads rows into a new store, compacts it until no tier can be merged, and removes what is no longer live.

    All columns keep their names and values, nulls, repeated rows and very long texts included; ties cannot occur; an empty table makes
    an empty version.
    """
    spark = rows.sparkSession
    prepare(spark)
    store = Store(spark, root or shared_folder(spark, "shards"))
    version = store.load(rows)
    while (then := store.compact(version, target_bytes)) != version:
        version = then
    store.vacuum(version)
    return store, version


def sharded_digest(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The rows of docs as read back through the manifest: doc_id, lang, source, n_chars, n_bytes and text_md5 (null for a null text)."""
    store, version = shard_table(docs, target_bytes=target_bytes)
    text = F.col("text").cast("string")
    back = store.read(version, docs)
    return back.select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"))


DIGEST_SQL = "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"
