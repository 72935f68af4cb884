"""Collection rounds: runs of packets whose dates agree, and the block that a file's dates speak for.

``dated(file_id, ord, tag, date_text, first_page, last_page)`` holds the packets of a file in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import dates as D
from sheafwork.functions import text as X

#: Dated packets that a majority needs, and the share of them that it must hold.
LEAST_DATED = 3
LEAST_SHARE = 0.6


def round_groups(dated: DataFrame) -> DataFrame:
    """Adds ``own_label`` (null for undated), ``group_id`` and ``label`` to each packet.

    A change of label opens a round only if the next dated packet does not return to the label before. Among dated packets a row is
    a candidate for a stray label if its neighbours agree and it does not; of a run of candidates every other one, from the first
    on, is a stray, since the one after it belongs to the old label again. A round's label is its most frequent one, the first seen
    of equal ones. Windows over one distribution by file, and nothing is computed twice.
    """
    file = Window.partitionBy("file_id")
    order, back = file.orderBy("ord"), file.orderBy(F.desc("ord"))
    until = Window.unboundedPreceding
    rows = dated.withColumn("own_label", F.nullif(D.round_label("date_text"), F.lit(D.UNDATED)))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(until, -1))
    rows = rows.withColumns({"_before": last("own_label", order), "_after": last("own_label", back)})
    stray = (F.col("_before") == F.col("_after")) & (F.col("own_label") != F.col("_before"))
    rows = rows.withColumn("_stray", F.coalesce(stray, F.lit(False)))
    dated_row = F.col("own_label").isNotNull()
    rows = rows.withColumn("_run", F.sum(F.when(dated_row & ~F.col("_stray"), 1).otherwise(0)).over(order))
    place = F.sum(F.when(F.col("_stray"), 1).otherwise(0)).over(Window.partitionBy("file_id", "_run").orderBy("ord"))
    rows = rows.withColumn("_absorbed", F.when(dated_row, F.col("_stray") & (place % 2 == 1)))
    after_absorbed = F.coalesce(last("_absorbed", order), F.lit(False))
    opens = F.coalesce((F.col("own_label") != F.col("_before")) & ~F.col("_absorbed") & ~after_absorbed, F.lit(False))
    rows = rows.withColumn("_opens", opens).withColumn("group_id", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(order))
    same = Window.partitionBy("file_id", "group_id", "own_label")
    rank = F.when(dated_row, F.struct(F.count("*").over(same).alias("n"), (-F.min("ord").over(same)).alias("seen")))
    rows = rows.withColumn("_rank", rank)
    most = F.max_by("own_label", "_rank").over(Window.partitionBy("file_id", "group_id"))
    rows = rows.withColumn("label", F.coalesce(most, F.lit(D.UNDATED)))
    return rows.drop("_before", "_after", "_stray", "_run", "_absorbed", "_opens", "_rank")


def disagrees() -> Column:
    """Whether a packet's own label is not that of its round."""
    return F.coalesce(F.col("own_label") != F.col("label"), F.lit(False))


def round_summary(grouped: DataFrame) -> DataFrame:
    """One row per round: label, packets, first and last page counted from 1, and packets that disagree."""
    return grouped.groupBy("file_id", "group_id").agg(
        F.first("label").alias("label"),
        F.count("*").alias("n_packets"),
        (F.min("first_page") + 1).alias("first_page"),
        (F.max("last_page") + 1).alias("last_page"),
        F.count_if(disagrees()).alias("n_disagreeing"),
    )


def duplicate_round_labels(summary: DataFrame) -> DataFrame:
    """Labels that several rounds of a file carry, without undated ones."""
    counted = summary.where(F.col("label") != D.UNDATED).groupBy("file_id", "label").agg(F.count("*").alias("n_rounds"))
    return counted.where("n_rounds > 1")


def in_round(packets: DataFrame, grouped: DataFrame, label: str) -> DataFrame:
    """The packets of a round; a packet without a round counts as undated."""
    labels = grouped.select("file_id", "tag", F.col("label").alias("_label"))
    joined = packets.join(labels, ["file_id", "tag"], "left")
    return joined.where(F.coalesce("_label", F.lit(D.UNDATED)) == label).drop("_label")


def month_histogram(dated: DataFrame) -> DataFrame:
    """(file_id, month, n) of the packets whose date can be read."""
    months = dated.select("file_id", D.parse_month("date_text").alias("month")).where("month IS NOT NULL")
    return months.groupBy("file_id", "month").agg(F.count("*").alias("n"))


def resolve_block(dated: DataFrame, blocks: DataFrame, class_period: int) -> DataFrame:
    """One row per file: the block that its dates speak for, or why none does.

    ``blocks(block, class_period, month)``. At least LEAST_DATED packets must be dated, one month must hold LEAST_SHARE of them (of
    equal months the one seen first), and exactly one block must have that period and month.
    """
    rows = dated.withColumn("month", D.parse_month("date_text"))
    total = rows.groupBy("file_id").agg(F.count("*").alias("n_total"), F.count("month").alias("n_parsed"))
    votes = rows.where("month IS NOT NULL").groupBy("file_id", "month").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n"))))
    best = F.max_by(F.struct("month", "n"), F.struct(F.col("n"), -F.col("seen")))
    voted = votes.groupBy("file_id").agg(entries.alias("month_histogram"), best.alias("best"))
    known = blocks.where(F.col("class_period") == class_period).select(X.zero_filled("block").alias("block"), "month")
    known = known.groupBy("month").agg(F.sort_array(F.collect_list("block")).alias("matching"))
    joined = total.join(voted, "file_id", "left").withColumn("month", F.when(F.col("n_parsed") >= LEAST_DATED, F.col("best.month")))
    joined = joined.join(F.broadcast(known), "month", "left")  # at most twelve rows, one a month
    share = F.when(F.col("month").isNotNull(), F.col("best.n") / F.col("n_parsed"))
    n_matching = F.coalesce(F.size("matching"), F.lit(0))
    reason = (
        F.when(F.col("n_parsed") < LEAST_DATED, "too_few_dates")
        .when(F.col("share") < LEAST_SHARE, "no_majority")
        .when(n_matching == 0, "no_block")
        .when(n_matching > 1, "ambiguous_blocks")
    )
    out = joined.withColumn("share", share).withColumn("reason", reason)
    return out.select(
        "file_id",
        F.lit(class_period).alias("class_period"),
        F.when(F.col("reason").isNull(), F.get("matching", 0)).alias("block"),
        "month_histogram",
        "n_parsed",
        "n_total",
        F.col("month").alias("majority_month"),
        F.col("share").alias("confidence"),
        "reason",
    )


def disagreeing_packets(dated: DataFrame, resolved: DataFrame) -> DataFrame:
    """Packets whose own month is not their file's majority month."""
    rows = dated.select("file_id", "tag", D.parse_month("date_text").alias("month"))
    joined = rows.join(resolved.select("file_id", "majority_month"), "file_id")
    return joined.where("month IS NOT NULL AND month <> majority_month").select("file_id", "tag", "month", "majority_month")


def scope_mismatches(decisions: DataFrame, block: str) -> DataFrame:
    """Decisions whose number belongs to another period than the block."""
    return decisions.where(F.col("sid").isNotNull() & (F.substring("sid", 7, 2) != block)).select("tag", "sid")
