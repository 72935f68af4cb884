"""Command line: ``run``, ``analyze``, ``preflight`` and ``verify`` over tables or PDF files.

Inputs are folders of Parquet tables: pages, words, and, where there are any, detections and bands. A scan is given as PDF files
where their text layer can be read. Sidecars are JSON files in the decisions folder, named after the scan.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.operators import dispositions as O
from sheafwork.operators import leak
from sheafwork.operators import rounds as R
from sheafwork.operators import segmentation as S
from sheafwork.plans import pipeline as P
from sheafwork.plans import reports as T
from sheafwork.sources import documents, roster, sidecars


def _stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rpartition(".")[0] or name


def load_inputs(spark: SparkSession, args: argparse.Namespace) -> tuple[P.Inputs, DataFrame | None]:
    """The tables of a run and, if the folder has them, the detected bands."""
    stem = _stem(args.scan)
    if args.scan.endswith(".pdf"):
        pages = documents.decode_pages(documents.scan_files(spark, args.scan), lambda: documents.read_pdf).where("page_idx IS NOT NULL")
        words = documents.words_of(pages)
    else:
        pages, words = spark.read.parquet(f"{args.scan}/pages"), spark.read.parquet(f"{args.scan}/words")
    optional = {n: spark.read.parquet(f"{args.scan}/{n}") for n in ("detections", "bands") if not args.scan.endswith(".pdf") and roster.exists(spark, f"{args.scan}/{n}")}
    entries, held = roster.load_roster(spark, args.roster, args.period, args.scan)
    names = entries.select("ord", "sid", "last_name", "first_name")
    order = sidecars.read_page_order(spark, f"{args.decisions}/{stem}.page_order.json", stem)
    turned = sidecars.read_orientation_overrides(spark, f"{args.decisions}/{stem}.orientation.json", stem)
    inputs = P.Inputs(pages, words, names, held, detections=optional.get("detections"), orientation_overrides=turned, sequences=order)
    return inputs, optional.get("bands")


def _block_gate(spark: SparkSession, args: argparse.Namespace, made: P.Stages, decisions: DataFrame) -> str | None:
    """Why a run must stop over its block, or None. Only a roster with a block file has blocks."""
    path = f"{args.roster.rpartition('.')[0]}_blocks.json"
    if not roster.exists(spark, path):
        print(T.histogram_text(R.month_histogram(made.dated)))
        return None
    if args.class_period is None:
        return "the roster has blocks: --class-period is needed"
    resolved = R.resolve_block(made.dated, sidecars.read_blocks(spark, path), args.class_period)
    print(T.resolution_text(resolved))
    row = resolved.first()
    block = args.block or (row["block"] if row else None)
    if block is None:
        return "no block could be resolved: give one with --block"
    if args.confirm_block != block:
        return f"confirm the block with --confirm-block {block}"
    off = R.scope_mismatches(decisions, block).count()
    if off:
        return f"{off} decision(s) belong to another block than {block}"
    sidecars.write_provenance(spark, block, args.class_period, row["majority_month"] if row else None, f"{args.decisions}/{_stem(args.scan)}.block.json")
    return None


@dataclass
class _Run:
    """What a run or a dry run has worked out."""

    inputs: P.Inputs
    made: P.Stages
    decisions: DataFrame
    ledger: DataFrame
    outcomes: DataFrame
    plan: DataFrame
    kept: DataFrame


def _outcomes(spark: SparkSession, args: argparse.Namespace) -> _Run:
    inputs, bands = load_inputs(spark, args)
    stem = _stem(args.scan)
    decisions = sidecars.read_decisions(spark, f"{args.decisions}/{stem}.json")
    ledger = sidecars.read_ledger(spark, f"{args.out}/.ledger/{stem}.json").cache()
    made = P.stages(inputs)
    made.packets, made.grouped = made.packets.cache(), made.grouped.cache()  # several actions follow, and a scan is small
    outcomes, _ = P.run_dispositions(
        inputs,
        decisions,
        ledger,
        detection_overrides=sidecars.read_tags(spark, f"{args.decisions}/{stem}.overrides.json"),
        composition_overrides=sidecars.read_tags(spark, f"{args.decisions}/{stem}.composition.json"),
        bands=bands,
        allow_delete=not args.no_delete,
        tags=made.grouped.where(F.col("label") == args.round).select("tag") if args.round else None,
    )
    plan, kept = P.redaction_plan(inputs, made, bands)
    return _Run(inputs, made, decisions, ledger, outcomes.cache(), plan.cache(), kept.cache())


def cmd_run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Applies decisions: writes PDF files and their words, removes files, keeps the queue and the ledger. 1 if anything was held back.

    What belongs to packets that this run does not write or reject (other rounds, packets that are pending again) stays as it is.
    """
    run = _outcomes(spark, args)
    outcomes, stem = run.outcomes, _stem(args.scan)
    print(T.rounds_text(R.round_summary(run.made.grouped)))
    why = _block_gate(spark, args, run.made, run.decisions)
    if why:
        print(why)
        return 2
    print(T.duplicates_text(_duplicates(run.decisions, run.made)))
    files = P.published_files(run.inputs, run.made, run.plan, run.kept, outcomes)
    for row in files.toLocalIterator():  # the packets of one scan, one at a time
        documents.write_file(spark, f"{args.out}/{row['path']}", bytes(row["content"]))
    pages = run.made.packets.select("file_id", "tag", F.explode("page_indices").alias("page_idx"))
    written = outcomes.where("outcome = 'written'").select("tag", "path")
    shown = run.kept.join(pages, ["file_id", "page_idx"]).join(written, "tag").withColumn("packet", F.col("tag"))
    words = f"{args.out}/words/{stem}"
    shown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("packet").parquet(words)
    for row in O.deletions(outcomes, not args.no_delete).select("old_path").collect():
        documents.delete_file(spark, f"{args.out}/{row['old_path']}")
    for row in outcomes.where("outcome = 'rejected'").select("tag").collect():
        documents.delete_file(spark, f"{words}/packet={row['tag']}")
    folder = f"{args.out}/.manual_queue/{stem}"
    queue = sidecars.read_queue(spark, folder)
    held = O.enqueue(O.clear_queue(queue, written.select("tag")), outcomes).withColumn("pdf_path", F.coalesce("pdf_path", F.lit(args.scan)))
    sidecars.write_queue(spark, held, folder)
    sidecars.write_ledger(spark, O.merge_ledger(run.ledger, outcomes), f"{args.out}/.ledger/{stem}.json", run.ledger)
    print(T.counts_text(O.run_summary(outcomes), "Outcomes"))
    return int(outcomes.where("outcome = 'held_back'").limit(1).count() > 0)


def _duplicates(decisions: DataFrame, made: P.Stages) -> DataFrame:
    from sheafwork.operators.match import duplicate_decisions

    return duplicate_decisions(decisions, made.grouped)


def cmd_analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    """Holds by round of a dry run; nothing is written."""
    run = _outcomes(spark, args)
    print(T.holds_text(P.analyze(run.outcomes, run.made.grouped)))
    return 0


def cmd_preflight(spark: SparkSession, args: argparse.Namespace) -> int:
    """What a reviewer will meet, and the pages that need a look."""
    inputs, bands = load_inputs(spark, args)
    found = P.preflight(inputs, bands=bands).cache()
    print(T.counts_text(P.preflight_counts(found), "Preflight"))
    for r in P.other_blocked(found).orderBy("file_id", "packet_index").select("tag", F.transform("issues", S.issue_text).alias("why")).collect():
        print(f"  {r['tag']}: {'; '.join(r['why']) or 'border not detected'}")
    return 0


def cmd_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether the published words name anyone of the whole roster. 1 for a finding or if there is nothing to verify."""
    folder = f"{args.out}/words"
    if not roster.exists(spark, folder):
        print("nothing to verify")
        return 1
    words = spark.read.option("recursiveFileLookup", "true").parquet(folder).select(F.col("path").alias("file_id"), "page_idx", "text").cache()
    if not words.take(1):
        print("nothing to verify")
        return 1
    entries, _ = roster.load_full_roster(spark, args.roster)
    text, ok = T.verify_text(leak.leak_report(words, entries), leak.leak_findings(words, entries))
    print(text)
    return int(not ok)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sheafwork", description=__doc__.splitlines()[0])
    commands = out.add_subparsers(dest="command", required=True)
    for name, function in (("run", cmd_run), ("analyze", cmd_analyze), ("preflight", cmd_preflight), ("verify", cmd_verify)):
        one = commands.add_parser(name, help=function.__doc__.splitlines()[0])
        one.set_defaults(function=function)
        one.add_argument("--roster", required=True)
        one.add_argument("--out", default="out")
        if name != "verify":
            one.add_argument("--scan", required=True, help="a PDF file, or a folder of tables")
            one.add_argument("--decisions", default="decisions")
            one.add_argument("--period")
            one.add_argument("--round")
            one.add_argument("--no-delete", action="store_true")
            one.add_argument("--class-period", type=int)
            one.add_argument("--block")
            one.add_argument("--confirm-block")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sheafwork").getOrCreate()
    try:
        return args.function(spark, args)
    except roster.RosterError as e:
        print(f"roster: {e}")
        return 2


if __name__ == "__main__":
    sys.exit(main())
