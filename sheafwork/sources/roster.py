"""Rosters: CSV files with blocks of rows parted by blank rows, and the names that are held back from them.

Problems come as a table of violations; a load raises the first by row. Reading keeps the row number, which a CSV reader does not: a
roster is one class, so its file is read as one text and split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions import text as X

SID = r"^\d{10}$"
COLUMNS = ["SID", "Last Name", "First Name"]
HELD_COLUMNS = ["Last Name", "First Name"]


class RosterError(ValueError):
    """A roster or its sidecar is not to be trusted."""


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_numbered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(row_num, *columns) of a CSV file with a header; row 1 is the header and empty lines do not count."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("l"))
    lines = lines.select(F.posexplode(F.filter("l", lambda x: x != "")).alias("pos", "line"))
    header = lines.where("pos = 0").select(F.from_csv("line", ", ".join(f"c{k} string" for k in range(64))).alias("h")).first()
    names = [(n or "").strip().lstrip("﻿") for n in header["h"]] if header else []
    missing = [c for c in columns if c not in names]
    if missing:
        raise RosterError(f"{path} has no column {missing}")
    width = max(k for k, n in enumerate(names) if n) + 1
    row = F.from_csv("line", ", ".join(f"c{k} string" for k in range(width)))
    found = lines.where("pos > 0").select((F.col("pos") + 1).alias("row_num"), row.alias("r"))
    return found.select("row_num", *[X.trimmed(F.coalesce(F.col(f"r.c{names.index(c)}"), F.lit(""))).alias(c) for c in columns])


def read_roster_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = read_numbered_csv(spark, path, COLUMNS)
    return rows.select("row_num", F.col("SID").alias("sid"), F.col("Last Name").alias("last_name"), F.col("First Name").alias("first_name"))


def roster_blocks(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Filled rows with their block, the period of its first row, and its start; ``keys`` part several rosters in one table."""
    by = list(keys or [])
    order = Window.partitionBy(*by).orderBy("row_num")
    blank = (F.col("sid") == "") & (F.col("last_name") == "") & (F.col("first_name") == "")
    rows = rows.withColumn("block_id", F.sum(F.when(blank, 1).otherwise(0)).over(order)).where(~blank)
    whole = rows.withColumn("complete", (F.col("sid") != "") & (F.col("last_name") != "") & (F.col("first_name") != ""))
    first = Window.partitionBy(*by, "block_id").orderBy("row_num")
    return whole.withColumns({"period": F.substring("sid", 7, 2), "block_period": F.first(F.substring("sid", 7, 2)).over(first), "block_start": F.first("row_num").over(first)})


def roster_violations(rows: DataFrame, held: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(row_num, code, sid) of every problem: partly blank rows, malformed or repeated numbers, a period that is not its block's, held names."""
    by = list(keys or [])
    blocks = roster_blocks(rows, keys)
    again = F.row_number().over(Window.partitionBy(*by, "sid").orderBy("row_num"))
    checked = blocks.withColumn("nth", again)
    code = (
        F.when(~F.col("complete"), "partly_blank")
        .when(~F.col("sid").rlike(SID), "malformed_sid")
        .when(F.col("nth") > 1, "duplicate_sid")
        .when(F.col("period") != F.col("block_period"), "period_mismatch")
    )
    out = checked.select(*by, "row_num", code.alias("code"), "sid").where("code IS NOT NULL")
    if held is not None:
        out = out.unionByName(overlap_with_held(blocks, held, keys).select(*by, "row_num", F.lit("held_name").alias("code"), "sid"))
    return out


def overlap_with_held(roster: DataFrame, held: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries whose name is held back too: a contradiction that a human has to settle."""
    by = list(keys or [])
    names = [F.lower(X.trimmed("last_name")).alias("_last"), F.lower(X.trimmed("first_name")).alias("_first")]
    keyed = roster.withColumns({"_last": F.lower(X.trimmed("last_name")), "_first": F.lower(X.trimmed("first_name"))})
    return keyed.join(held.select(*by, *names).distinct(), [*by, "_last", "_first"], "left_semi").drop("_last", "_first")


def entries(rows: DataFrame) -> DataFrame:
    """(ord, sid, last_name, first_name, full_name, teacher_code, period, student_index) of the filled rows."""
    blank = (F.col("sid") == "") & (F.col("last_name") == "") & (F.col("first_name") == "")
    kept = rows.where(~blank)
    return kept.select(F.col("row_num").alias("ord"), "sid", "last_name", "first_name", F.concat_ws(" ", "first_name", "last_name").alias("full_name"), *X.sid_parts("sid"))


def in_period(roster: DataFrame, period: str | int) -> DataFrame:
    """The entries of one period; raises if there are none, naming those that there are."""
    wanted = str(period).strip()
    wanted = wanted.zfill(2) if wanted.isdigit() else wanted
    found = roster.where(F.col("period") == wanted)
    if not found.take(1):
        there = sorted(r[0] for r in roster.select("period").distinct().collect())
        raise RosterError(f"no roster entries for period {wanted!r}; the roster has {there}")
    return found


def search(roster: DataFrame, query: str) -> DataFrame:
    """Entries whose full name contains the query in any case; all for a blank one."""
    q = query.strip().lower()
    return roster.where(F.contains(F.lower("full_name"), F.lit(q))) if q else roster


def held_path(path: str) -> str:
    stem = path[: path.rindex(".")] if "." in path.rsplit("/", 1)[-1] else path
    return f"{stem}_holds.csv"


def read_held(spark: SparkSession, roster_path: str) -> DataFrame:
    """(ord, last_name, first_name) of the held names beside a roster; empty without such a file."""
    path = held_path(roster_path)
    if not exists(spark, path):
        return spark.range(0).select(F.col("id").cast("int").alias("ord"), F.lit("").alias("last_name"), F.lit("").alias("first_name"))
    rows = read_numbered_csv(spark, path, HELD_COLUMNS)
    rows = rows.select(F.col("row_num").alias("ord"), F.col("Last Name").alias("last_name"), F.col("First Name").alias("first_name"))
    rows = rows.where("last_name <> '' OR first_name <> ''")
    part = rows.where("last_name = '' OR first_name = ''").orderBy("ord").first()
    if part:
        raise RosterError(f"row {part['ord']} of {path}: a held name needs both fields")
    return rows


def load_roster(spark: SparkSession, path: str, period: str | int | None = None, infer_from: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, held names), validated, and narrowed to a period.

    Without a period it is taken from the name of the scan ``infer_from``; a roster of one period needs neither.
    """
    rows = read_roster_rows(spark, path)
    held = read_held(spark, path)
    bad = roster_violations(rows, held).orderBy("row_num").first()
    if bad:
        raise RosterError(f"row {bad['row_num']}: {bad['code']} {bad['sid']!r}")
    roster = entries(rows)
    if period is None and infer_from is not None:
        period = spark.range(1).select(X.period_from_file_name(F.lit(infer_from)).alias("p")).first()["p"]
    if period is None:
        periods = sorted(r[0] for r in roster.select("period").distinct().collect())
        if len(periods) > 1:
            raise RosterError(f"the roster has periods {periods}, and none was given or could be read from the scan's name")
        return roster, held
    return in_period(roster, period), held


def load_full_roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, held names) of all periods, for verification."""
    rows, held = read_roster_rows(spark, path), read_held(spark, path)
    bad = roster_violations(rows, held).orderBy("row_num").first()
    if bad:
        raise RosterError(f"row {bad['row_num']}: {bad['code']} {bad['sid']!r}")
    return entries(rows), held


def prepare_roster(raw: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, held names) from raw rows (row_num, sid, last_name, first_name).

    Punctuation at the end of a field goes; rows whose number occurs twice or more leave the roster for the held names; blank rows
    stay as block delimiters; existing held names are kept. Rows without a number that are not blank stay for validation to report.
    """
    clean = raw.select("row_num", *[X.strip_trailing_punctuation(X.trimmed(c)).alias(c) for c in ("sid", "last_name", "first_name")])
    n = F.count("*").over(Window.partitionBy("sid"))
    counted = clean.withColumn("n", n)
    double = (F.col("n") > 1) & (F.col("sid") != "")
    moved = counted.where(double).select("row_num", "last_name", "first_name").groupBy("last_name", "first_name").agg(F.min("row_num").alias("row_num"))
    if held is None:
        names = moved.select(F.col("row_num").alias("ord"), "last_name", "first_name")
    else:
        new = moved.join(held.select("last_name", "first_name").distinct(), ["last_name", "first_name"], "left_anti")
        names = held.select("ord", "last_name", "first_name").unionByName(new.select((F.col("row_num") + 1_000_000).alias("ord"), "last_name", "first_name"))
    return counted.where(~double).select("row_num", "sid", "last_name", "first_name"), names


def write_roster(rows: DataFrame, held: DataFrame, path: str) -> None:
    """Two folders of one CSV file each, the roster in row order and its held names."""
    rows.coalesce(1).sortWithinPartitions("row_num").select(F.col("sid").alias("SID"), F.col("last_name").alias("Last Name"), F.col("first_name").alias("First Name")).write.mode("overwrite").csv(path, header=True, emptyValue="")
    held.coalesce(1).sortWithinPartitions("ord").select(F.col("last_name").alias("Last Name"), F.col("first_name").alias("First Name")).write.mode("overwrite").csv(held_path(path), header=True, emptyValue="")
