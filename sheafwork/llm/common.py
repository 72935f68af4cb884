"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.session import bound_batches, ship_package


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors, bounds Arrow batches and makes sure that checkpoints have a shared folder."""
    ship_package(spark)
    bound_batches(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken under a local master, whose executors live on this machine; a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sheafwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system interface, whatever the store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, (doc_id, raw): the UTF-8 bytes of each text. Other columns are pruned, so that no name can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Of each batch of :func:`texts_of`, the ids and the texts as bytes (None stays None)."""
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist()


class Recent:
    """A bounded table of results for words. When its younger half is full it becomes the older one; what is asked for again moves back.

    The bound counts the characters of the words and a fixed share for each entry, and words of over LONGEST characters are not kept:
    unbroken runs of letters rarely recur. Neither changes a result.
    """

    LONGEST = 64
    ENTRY = 64

    def __init__(self, size: int):
        self.half, self.used, self.young, self.old = size // 2, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(key) <= self.LONGEST:
            if self.used >= self.half:
                self.old, self.young, self.used = self.young, {}, 0
            self.young[key] = value
            self.used += self.ENTRY + len(key)
        return value
