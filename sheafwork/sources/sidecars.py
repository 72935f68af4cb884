"""JSON sidecars beside a scan, as tables: decisions, overrides, orientation, page order, geometry, blocks, ledger, queue, provenance.

A missing file is an empty table. Writers replace a file's folder by one JSON document: it is written beside the old one, which steps
aside under ``.old`` until the new one stands in its place. Readers that find only what stepped aside read that, so a writer that dies
at any point loses nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import text as X
from sheafwork.sources.roster import exists

BOX = "struct<l:double,t:double,r:double,b:double>"


def _current(spark: SparkSession, path: str) -> str | None:
    """The path, or that of what stepped aside for a successor that never came; None without either."""
    return next((p for p in (path, f"{path}.old") if exists(spark, p)), None)


def _text(spark: SparkSession, path: str) -> DataFrame | None:
    found = _current(spark, path)
    return None if found is None else spark.read.text(found, wholetext=True).select(F.col("value").alias("json"))


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Lets ``write`` make a new folder beside ``path`` and puts it in its place by renames; what it reads may be the old one."""
    jvm = spark.sparkContext._jvm
    target, aside, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old", f"{path}.{uuid.uuid4().hex}"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write(fresh.toString())
    if files.exists(target):
        files.delete(aside, True)
        files.rename(target, aside)
    if not files.rename(fresh, target):
        raise OSError(f"cannot put {path} in place")
    files.delete(aside, True)


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One column ``v``; no row without a file; an error for text that is no such JSON."""
    text = _text(spark, path)
    if text is None:
        return spark.range(0).select(F.from_json(F.lit("null"), schema).alias("v"))
    return text.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("v"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(tag, sid): no row for a pending packet, a null sid for one confirmed without consent."""
    return _parsed(spark, path, "map<string,string>").select(F.explode("v").alias("tag", "sid"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(tag) of a detection or composition override file."""
    return _parsed(spark, path, "array<string>").select(F.explode("v").alias("tag")).distinct()


def read_orientation_overrides(spark: SparkSession, path: str, file_id: str) -> DataFrame:
    rows = _parsed(spark, path, "map<string,int>").select(F.explode("v").alias("page", "angle"))
    return rows.select(F.lit(file_id).alias("file_id"), F.col("page").cast("int").alias("page_idx"), "angle")


def read_page_order(spark: SparkSession, path: str, file_id: str) -> DataFrame:
    """(file_id, sequence); no row, and so the natural order, without a file."""
    return _parsed(spark, path, "struct<sequence:array<int>>").select(F.lit(file_id).alias("file_id"), "v.sequence")


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """(tag, offset, boxes): drawn boxes per page of a packet, offset 0 for the header's."""
    inner = "struct<band_override:struct<left:double,top:double,right:double,bottom:double>,header_bbox_override:array<array<double>>,extra_page_regions:map<string,array<array<double>>>>"
    rows = _parsed(spark, path, f"map<string,{inner}>").select(F.explode("v").alias("tag", "g"))
    boxes = lambda a: F.transform(a, lambda x: F.struct(x[0].alias("l"), x[1].alias("t"), x[2].alias("r"), x[3].alias("b")))
    head = rows.where("g.header_bbox_override IS NOT NULL").select("tag", F.lit(0).alias("offset"), boxes(F.col("g.header_bbox_override")).alias("boxes"))
    more = rows.select("tag", F.explode("g.extra_page_regions").alias("offset", "r"))
    return head.unionByName(more.select("tag", F.col("offset").cast("int").alias("offset"), boxes(F.col("r")).alias("boxes")))


def read_geometry_bands(spark: SparkSession, path: str) -> DataFrame:
    """(tag, band): the border that a reviewer drew for a packet's header."""
    rows = _parsed(spark, path, "map<string,struct<band_override:struct<left:double,top:double,right:double,bottom:double>>>").select(F.explode("v").alias("tag", "g"))
    band = F.struct(*[F.col(f"g.band_override.{name}").alias(name[0]) for name in ("left", "top", "right", "bottom")])
    return rows.where("g.band_override IS NOT NULL").select("tag", band.alias("band"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(teacher_code, block, class_period, month) of a block file; block names get two digits."""
    v = _parsed(spark, path, "struct<teacher_code:string,blocks:map<string,struct<class_period:int,month:int>>>")
    rows = v.select("v.teacher_code", F.explode("v.blocks").alias("block", "m"))
    return rows.select("teacher_code", X.zero_filled("block").alias("block"), "m.class_period", "m.month")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    rows = _parsed(spark, path, "map<string,struct<sid:string,path:string>>").select(F.explode("v").alias("tag", "e"))
    return rows.select("tag", "e.sid", "e.path")


_QUEUE = "struct<packet_tag:string,sid:string,worksheet_type:string,reason:string,pdf_path:string,flagged_regions:map<string,array<array<double>>>>"


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, sid, worksheet_type, reason, pdf_path, flagged_regions): the manual queue, one JSON document per packet.

    ``flagged_regions`` maps a page's place in its packet to boxes (left, top, right, bottom); null where nothing was flagged.
    """
    found = _current(spark, folder)
    if found is None:
        rows = spark.range(0).select(F.from_json(F.lit("null"), _QUEUE).alias("v"))
    else:
        files = spark.read.text(found, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{json,txt}")
        rows = files.select(F.from_json("value", _QUEUE, {"mode": "FAILFAST"}).alias("v"))
    return rows.select(F.col("v.packet_tag").alias("tag"), "v.sid", "v.worksheet_type", "v.reason", "v.pdf_path", "v.flagged_regions")


def flagged_boxes(queue: DataFrame) -> DataFrame:
    """(tag, offset, box) of the flagged regions of a queue."""
    rows = queue.select("tag", F.explode("flagged_regions").alias("offset", "boxes")).select("tag", F.col("offset").cast("int").alias("offset"), F.explode("boxes").alias("b"))
    return rows.select("tag", "offset", F.struct(*[F.get("b", k).alias(name) for k, name in enumerate("ltrb")]).alias("box"))


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """(block, class_period, month) that a run was resolved to."""
    return _parsed(spark, path, "struct<block:string,class_period:int,month:int>").select("v.*")


def _write(spark: SparkSession, one: DataFrame, path: str) -> None:
    replace_folder(spark, path, lambda fresh: one.coalesce(1).write.text(fresh))


def _as_map(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """One JSON object of sorted keys; nulls are kept."""
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), by_key)
    return rows.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("json"))


def write_decisions(spark: SparkSession, rows: DataFrame, path: str) -> None:
    _write(spark, _as_map(rows, "tag", F.col("sid")), path)


def write_tags(spark: SparkSession, rows: DataFrame, path: str) -> None:
    _write(spark, rows.agg(F.to_json(F.sort_array(F.collect_set("tag"))).alias("json")), path)


def write_orientation_overrides(spark: SparkSession, rows: DataFrame, path: str) -> None:
    _write(spark, _as_map(rows.withColumn("page", F.col("page_idx").cast("string")), "page", F.col("angle")), path)


def write_page_order(spark: SparkSession, sequence: list[int] | None, path: str) -> None:
    """Replaces the order; None removes it, so that the natural order holds."""
    if sequence is None:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return
    _write(spark, spark.range(1).select(F.to_json(F.struct(F.array(*map(F.lit, sequence)).alias("sequence")))), path)


def write_geometry(spark: SparkSession, rows: DataFrame, path: str, bands: DataFrame | None = None) -> None:
    """From boxes (tag, offset, boxes) and, where there are any, drawn borders (tag, band)."""
    flat = F.transform("boxes", lambda b: F.array(b["l"], b["t"], b["r"], b["b"]))
    rows = rows.withColumn("flat", flat)
    entry = F.struct(F.col("offset").cast("string").alias("k"), F.col("flat").alias("v"))
    per_tag = rows.groupBy("tag").agg(
        F.first(F.when(F.col("offset") == 0, F.col("flat")), ignorenulls=True).alias("header_bbox_override"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("offset") > 0, entry)))).alias("extra_page_regions"),
    )
    if bands is None:
        per_tag = per_tag.withColumn("band_override", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"))
    else:
        drawn = bands.select("tag", F.struct(*[F.col(f"band.{name[0]}").alias(name) for name in ("left", "top", "right", "bottom")]).alias("band_override"))
        per_tag = per_tag.join(drawn, "tag", "full")
    _write(spark, _as_map(per_tag, "tag", F.struct("band_override", "header_bbox_override", "extra_page_regions")), path)


def write_ledger(spark: SparkSession, rows: DataFrame, path: str, before: DataFrame | None = None) -> bool:
    """Writes the ledger if it differs from ``before``; whether it did."""
    if before is not None and not rows.exceptAll(before.select(*rows.columns)).take(1) and not before.select(*rows.columns).exceptAll(rows).take(1):
        return False
    _write(spark, _as_map(rows, "tag", F.struct("sid", "path")), path)
    return True


def write_queue(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Replaces the queue: one JSON document per packet, in a folder per packet, which :func:`read_queue` reads back."""
    optional = {"pdf_path": "string", "flagged_regions": "map<string,array<array<double>>>"}
    more = [F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    line = F.to_json(F.struct(F.col("tag").alias("packet_tag"), "sid", "worksheet_type", "reason", *more), {"ignoreNullFields": "false"})
    replace_folder(spark, folder, lambda fresh: rows.select("tag", line.alias("value")).write.partitionBy("tag").text(fresh))


def write_provenance(spark: SparkSession, block: str, class_period: int, month: int | None, path: str) -> None:
    one = spark.range(1).select(F.to_json(F.struct(F.lit(block).alias("block"), F.lit(class_period).alias("class_period"), F.lit(month).cast("int").alias("month"))))
    _write(spark, one, path)
