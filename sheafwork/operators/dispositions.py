"""What becomes of each packet: the decision table, output paths, the ledger, the manual queue, releases and reports.

Decisions have three states: no row (pending), a row with a null sid (confirmed without consent), a row with a sid. A left join with
a marker column keeps the first two apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.operators import segmentation as S


def mark(rows: DataFrame, keys: list[str], marker: str) -> DataFrame:
    """The distinct keys with a column that is true, so that a left join shows which rows met one."""
    return rows.select(*keys).distinct().withColumn(marker, F.lit(True))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def natural_path(sid: Column | str, worksheet_type: Column | str) -> Column:
    """``<teacher>/<type>/<period>/<sid>``, without a suffix."""
    s = F.col(sid) if isinstance(sid, str) else sid
    kind = F.col(worksheet_type) if isinstance(worksheet_type, str) else worksheet_type
    return F.concat_ws("/", F.substring(s, 1, 6), kind, F.substring(s, 7, 2), s)


#: What a ledger's path is made of: the natural path, and a number from 2 on if it was taken.
_PATH = r"^(.*?)(?:_(\d+))?\.pdf$"


def taken_paths(ledger: DataFrame, freed: DataFrame) -> DataFrame:
    """(base, taken): the sorted numbers of each natural path that ledger rows own and keep; those of the tags in ``freed`` go or move."""
    kept = ledger.select("tag", "path").join(freed.select("tag"), "tag", "left_anti")
    number = F.coalesce(F.regexp_extract("path", _PATH, 2).try_cast("int"), F.lit(1))
    return kept.select(F.regexp_extract("path", _PATH, 1).alias("base"), number.alias("n")).groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("taken"))


def claim_paths(written: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds ``path``: the natural path for the first of its packets, ``_2``, ``_3`` ... for the others, set-wise by place.

    A packet that already owns a path of this name in the ledger (``old_path``) comes before those that do not, in the order of that
    path's number, so that a rerun changes nothing and a freed natural path is taken again. Numbers that another packet's ledger row
    keeps (:func:`taken_paths`) are passed over, so that no published file is overwritten by another packet's.
    """
    base = natural_path("sid", "worksheet_type")
    number = F.coalesce(F.regexp_extract("old_path", _PATH, 2).try_cast("int"), F.lit(1))
    own = F.when(F.regexp_extract("old_path", _PATH, 1) == base, number)
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.asc_nulls_last("_own"), "ord", "tag"))
    rows = written.withColumns({"base": base, "_own": own}).join(taken, "base", "left").withColumn("_place", place)
    # of the sorted numbers taken, the i-th (from 0) has itself minus i minus 1 free ones below it
    passed = F.size(F.filter(F.coalesce("taken", F.array().cast("array<int>")), lambda t, i: t - i - 1 < F.col("_place")))
    rows = rows.withColumn("_place", F.col("_place") + passed)
    suffix = F.when(F.col("_place") > 1, F.concat(F.lit("_"), F.col("_place").cast("string"))).otherwise("")
    return rows.withColumn("path", F.concat("base", suffix, F.lit(".pdf"))).drop("base", "taken", "_own", "_place")


def decide(
    packets: DataFrame,
    decisions: DataFrame,
    roster: DataFrame,
    ledger: DataFrame,
    *,
    held_matches: DataFrame,
    undetected: DataFrame,
    leaks: DataFrame,
    detection_overrides: DataFrame,
    composition_overrides: DataFrame,
    allow_delete: bool = True,
) -> DataFrame:
    """One row per packet with ``outcome``, ``reason`` and ``path``.

    ``packets(tag, ord, worksheet_type, issues)``, ``decisions(tag, sid)``, ``roster(sid)``, ``ledger(tag, sid, path)``; the others
    hold tags: whose best match is a held name, whose border was not found, whose redacted text still names someone, and what a
    reviewer confirmed. The first condition that holds decides; a leak can be confirmed by nobody. The costly stages that find
    borders and leaks are tables here, so they run for the packets that a caller puts into them.
    """
    rows = packets.join(decisions.select("tag", "sid", F.lit(True).alias("decided")), "tag", "left")
    rows = rows.join(ledger.select("tag", F.col("sid").alias("old_sid"), F.col("path").alias("old_path")), "tag", "left")
    for table, name in ((held_matches, "held"), (undetected, "borderless"), (leaks, "leaking"), (detection_overrides, "seen"), (composition_overrides, "confirmed")):
        rows = rows.join(mark(table, ["tag"], name), "tag", "left")
    rows = rows.join(mark(roster, ["sid"], "known"), "sid", "left")  # last, so that the joins by tag share one distribution
    decided, issues = _flag("decided"), F.coalesce(F.size("issues"), F.lit(0)) > 0
    rejected = decided & F.col("sid").isNull()
    recorded = F.col("old_path").isNotNull()
    steps = [
        (~decided & _flag("held"), "consent_hold", "held_name"),
        (~decided, "pending", "no_decision"),
        (rejected & recorded & F.lit(allow_delete), "rejected", "deleted"),
        (rejected & recorded, "deletion_skipped", "delete_not_allowed"),
        (rejected, "rejected", "no_consent"),
        (~_flag("known"), "held_back", "not_on_roster"),
        (issues & ~(_flag("confirmed") & S.issues_confirmable("issues")), "held_back", "issues"),
        (_flag("borderless") & ~_flag("seen"), "held_back", "border_not_detected"),
        (_flag("leaking"), "held_back", "leak"),
    ]
    outcome, reason = F.lit("written"), F.lit("ok")
    for condition, result, why in reversed(steps):
        outcome, reason = F.when(condition, result).otherwise(outcome), F.when(condition, why).otherwise(reason)
    rows = rows.withColumns({"outcome": outcome, "reason": reason})
    written = claim_paths(rows.where("outcome = 'written'"), taken_paths(ledger, rows.where("outcome IN ('written', 'rejected')")))
    rows = rows.where("outcome <> 'written'").withColumn("path", F.lit(None).cast("string")).unionByName(written)
    notes = F.array_compact(
        F.array(
            F.when((F.col("outcome") == "written") & _flag("borderless"), "detection_confirmed"),
            F.when((F.col("outcome") == "written") & issues, "composition_confirmed"),
            F.when(F.col("path").rlike(r"_\d+\.pdf$"), "collision"),
            F.when(~F.lit(allow_delete) & (F.col("outcome") == "written") & (F.col("old_path") != F.col("path")), "deletion_skipped"),
        )
    )
    return rows.select("tag", "ord", "sid", "worksheet_type", "outcome", "reason", "path", "old_sid", "old_path", notes.alias("notes"))


def deletions(decided: DataFrame, allow_delete: bool = True) -> DataFrame:
    """(tag, old_path): files to remove, of rejected packets and of written ones whose path changed. Only a packet's own file goes."""
    gone = (F.col("outcome") == "rejected") & (F.col("reason") == "deleted")
    moved = (F.col("outcome") == "written") & (F.col("old_path") != F.col("path"))
    live = decided.where("path IS NOT NULL").select(F.col("path").alias("old_path"))
    dead = decided.where(F.col("old_path").isNotNull() & (gone | (moved if allow_delete else F.lit(False)))).select("tag", "old_path")
    return dead.join(live, "old_path", "left_anti").select("tag", "old_path")


def merge_ledger(ledger: DataFrame, decided: DataFrame) -> DataFrame:
    """The ledger after a run: written packets replace their row, rejected ones lose it, all others keep it."""
    new = decided.where("outcome = 'written'").select("tag", F.col("sid").alias("new_sid"), F.col("path").alias("new_path"), F.lit(True).alias("fresh"))
    lost = decided.where("outcome = 'rejected'").select("tag", F.lit(True).alias("lost"))
    both = ledger.join(new, "tag", "full").join(lost, "tag", "left").where("lost IS NULL")
    fresh = _flag("fresh")
    return both.select("tag", F.when(fresh, F.col("new_sid")).otherwise(F.col("sid")).alias("sid"), F.when(fresh, F.col("new_path")).otherwise(F.col("path")).alias("path"))


def path_owner(ledger: DataFrame) -> DataFrame:
    """Ledger rows whose path another tag owns as well."""
    n = F.count("*").over(Window.partitionBy("path"))
    return ledger.withColumn("n_owners", n).where("n_owners > 1")


def enqueue(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The manual queue after a run: packets held back for their border enter it, in place of an older row."""
    new = decided.where("outcome = 'held_back' AND reason = 'border_not_detected'")
    new = new.select("tag", "sid", "worksheet_type", "reason")
    return queue.join(new, "tag", "left_anti").unionByName(new, allowMissingColumns=True)


def clear_queue(queue: DataFrame, tags: DataFrame) -> DataFrame:
    return queue.join(tags, "tag", "left_anti")


def release(queue: DataFrame, roster: DataFrame, uncovered: DataFrame, leaks: DataFrame, ledger: DataFrame) -> DataFrame:
    """What releasing each queued packet gives. ``uncovered`` and ``leaks`` hold tags. Gates: roster, flagged regions, leaks."""
    rows = queue.join(mark(uncovered, ["tag"], "open"), "tag", "left").join(mark(leaks, ["tag"], "leaking"), "tag", "left")
    rows = rows.join(ledger.select("tag", F.col("path").alias("old_path")), "tag", "left").withColumn("ord", F.col("tag"))
    rows = rows.join(mark(roster, ["sid"], "known"), "sid", "left")
    reason = F.when(~_flag("known"), "not_on_roster").when(_flag("open"), "flagged_region_uncovered").when(_flag("leaking"), "leak").otherwise("ok")
    rows = rows.withColumn("release_reason", reason)
    done = claim_paths(rows.where("release_reason = 'ok'"), taken_paths(ledger, rows.where("release_reason = 'ok'")))
    rest = rows.where("release_reason <> 'ok'").withColumn("path", F.lit(None).cast("string"))
    return rest.unionByName(done).select("tag", "sid", (F.col("release_reason") == "ok").alias("released"), "release_reason", "path")


def run_summary(decided: DataFrame) -> DataFrame:
    """One row of counts by outcome."""
    kinds = ["written", "rejected", "held_back", "consent_hold", "pending", "deletion_skipped"]
    counts = [F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds]
    deleted = F.count_if((F.col("outcome") == "rejected") & (F.col("reason") == "deleted")).alias("n_deleted")
    return decided.agg(F.count("*").alias("n_packets"), *counts, deleted)


def holds_by_round(decided: DataFrame, labels: DataFrame) -> DataFrame:
    """Per round: packets that would be written, and those held by reason group. ``labels(tag, label)``."""
    rows = decided.join(labels.select("tag", "label"), "tag", "left").withColumn("label", F.coalesce("label", F.lit("undated")))
    return rows.groupBy("label").agg(
        F.count("*").alias("n_packets"),
        F.count_if(F.col("outcome") == "written").alias("n_clean"),
        F.count_if(F.col("reason") == "issues").alias("n_issues"),
        F.count_if(F.col("reason") == "border_not_detected").alias("n_border"),
        F.count_if(F.col("reason") == "leak").alias("n_leak"),
    )


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows of ``changes`` in place of those with the same keys."""
    return table.join(changes, keys, "left_anti").unionByName(changes)
