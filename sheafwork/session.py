"""What plans with Python functions need of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch. Spark's defaults (10,000 rows, no tight bound of bytes) are too much for a worker with long documents or rasters.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_sheafwork_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sheafwork-"), "sheafwork.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("sheafwork", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._sheafwork_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches. The bounds are settings of the session; they only ever become smaller, and stay set for the plans that need them.

    A batch holds at least one row, so one text or raster of any length passes.
    """
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower()
        if not now.removesuffix("b").isdigit() or not 0 < int(now.removesuffix("b")) <= bound:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of which a side holds rasters. Spark takes a binary for 100 bytes and would broadcast them all; here rows are merged, which spills."""
    return left.join(right.hint("merge"), keys, how)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below ``spark.checkpoint.dir``, which the driver and all executors share.

    Where that is unset, a temporary folder is taken under a local master; a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sheafwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
