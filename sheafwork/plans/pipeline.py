"""The stages from words to outcomes, as lazily composed tables, and the plans built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import fuzzy
from sheafwork.functions import text as X
from sheafwork.operators import dispositions as O
from sheafwork.operators import leak, match, redaction, rounds
from sheafwork.operators import orientation as R
from sheafwork.operators import segmentation as S
from sheafwork.session import join_heavy
from sheafwork.sources import documents


@dataclass
class Inputs:
    """Tables of one or many scans. Optional ones default to nothing recorded."""

    pages: DataFrame
    words: DataFrame
    roster: DataFrame
    held: DataFrame | None = None
    detections: DataFrame | None = None
    orientation_overrides: DataFrame | None = None
    sequences: DataFrame | None = None
    rasters: DataFrame | None = None
    manual_boxes: DataFrame | None = None

    @property
    def by(self) -> list[str] | None:
        """The class key of names: a roster of many scans says which scan each entry belongs to; that of one scan needs none."""
        return ["file_id"] if "file_id" in self.roster.columns else None


@dataclass
class Stages:
    """What the inputs give, each a DataFrame: nothing runs before a report or a sink asks for it."""

    packets: DataFrame
    fields: DataFrame
    anchors: DataFrame
    dated: DataFrame
    grouped: DataFrame
    orientation: DataFrame | None = field(default=None)


def stages(inputs: Inputs) -> Stages:
    """Segments, reads header fields, and groups packets into rounds."""
    features = S.apply_page_sequence(S.page_features(inputs.pages, inputs.words), inputs.sequences)
    packets = S.with_tags(S.segment_packets(features))
    oriented = None
    if inputs.detections is not None:
        oriented = R.resolve(inputs.detections, inputs.orientation_overrides)
        packets = S.with_orientation_issues(packets, R.flags(oriented))
    fields = S.header_fields(inputs.words)
    filled = S.packet_fields(packets, fields)
    dated = filled.select(
        "file_id", F.col("packet_index").alias("ord"), "tag", "date_text", F.get("page_indices", 0).alias("first_page"), F.element_at("page_indices", -1).alias("last_page")
    )
    return Stages(filled, fields, S.header_anchors(inputs.words), dated, rounds.round_groups(dated), oriented)


def propose_all(made: Stages, roster: DataFrame, held: DataFrame | None = None, scorer: match.Scorer = fuzzy.name_score, by: list[str] | None = None) -> DataFrame:
    """Proposals and automatic assignments of all packets; those without a header page have no name and no candidate clears the bar."""
    labels = made.grouped.select("file_id", "tag", F.col("label").alias("round"))
    probes = made.packets.select("file_id", "tag", F.col("packet_index").alias("ord"), "name_text").join(labels, ["file_id", "tag"], "left")
    return match.assign_exclusive(match.propose(probes, roster, held, scorer, by))


def preflight(inputs: Inputs, scorer: match.Scorer = fuzzy.name_score, bands: DataFrame | None = None) -> DataFrame:
    """One row per packet with all that a reviewer would meet; nothing is written and no page is read as a whole.

    Columns: tag, round, page_count_mismatch, is_orphan, has_plausible_match, would_auto_assign, oriented (no flag on its pages),
    detected (null where no raster was given), n_uncovered, n_issues, blocked, cannot_process and clean.
    """
    made = stages(inputs)
    proposals = propose_all(made, inputs.roster, inputs.held, scorer, inputs.by)
    rows = made.packets.join(proposals.select("file_id", "tag", "round", "top_score", "auto_sid", "is_held_match"), ["file_id", "tag"], "left")
    if inputs.rasters is not None and bands is None:
        bands = redaction.detect_bands(inputs.rasters, made.anchors)
    if bands is not None:
        found = redaction.header_geometry(bands, inputs.words, made.anchors).withColumnRenamed("page_idx", "header_page")
        rows = rows.join(found, ["file_id", "header_page"], "left")
    else:
        rows = rows.withColumns({"detected": F.lit(None).cast("boolean"), "n_uncovered": F.lit(None).cast("long")})
    return verdicts(rows)


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds the preflight verdicts to packets with issues, proposals and geometry."""
    flagged = F.exists("issues", lambda x: x["code"].isin("orientation_unresolved", "orientation_pending"))
    plausible = F.coalesce(F.col("top_score") >= match.LEAST_SCORE, F.lit(False))
    cannot = F.col("is_orphan") | flagged
    rows = rows.withColumns(
        {
            "n_issues": F.size("issues"),
            "oriented": ~flagged,
            "has_plausible_match": plausible,
            "would_auto_assign": F.col("auto_sid").isNotNull(),
            "cannot_process": cannot,
        }
    )
    undetected = ~F.coalesce("detected", F.lit(True))
    blocked = (F.col("n_issues") > 0) | undetected
    rows = rows.withColumn("blocked", blocked)
    return rows.withColumn("clean", ~F.col("cannot_process") & ~F.col("blocked") & F.col("has_plausible_match"))


def preflight_counts(packets: DataFrame) -> DataFrame:
    """One row of counts; packets that need an editor are those that are neither clean nor unprocessable."""
    return packets.agg(
        F.count("*").alias("n_packets"),
        F.count_if("page_count_mismatch").alias("n_mismatch"),
        F.count_if("is_orphan").alias("n_orphans"),
        F.count_if(~F.col("has_plausible_match")).alias("n_no_match"),
        F.count_if(~F.col("oriented")).alias("n_orientation"),
        F.count_if("blocked").alias("n_blocked"),
        F.count_if(F.col("n_uncovered") > 0).alias("n_advisory"),
        F.count_if("would_auto_assign").alias("n_auto"),
        F.count_if("clean").alias("n_clean"),
        F.count_if("cannot_process").alias("n_cannot_process"),
        (F.count("*") - F.count_if("clean") - F.count_if("cannot_process")).alias("n_needs_editor"),
    )


def other_blocked(packets: DataFrame) -> DataFrame:
    """Blocked packets that are no orphans, have the declared pages, and stand upright."""
    return packets.where(F.col("blocked") & ~F.col("is_orphan") & ~F.col("page_count_mismatch") & F.col("oriented"))


def page_reasons(packets: DataFrame) -> DataFrame:
    """(file_id, page_idx, reasons): why a page would be shown on a contact sheet; none for a file without problems."""
    issues = packets.select("file_id", "header_page", "page_indices", F.explode("issues").alias("i"))
    page = F.coalesce("i.page", "header_page", F.get("page_indices", 0))
    reasons = issues.select("file_id", page.alias("page_idx"), S.issue_text(F.col("i")).alias("reason"))
    unmatched = packets.where(~F.col("has_plausible_match")).select("file_id", F.coalesce("header_page", F.get("page_indices", 0)).alias("page_idx"), F.lit("no plausible match").alias("reason"))
    return reasons.unionByName(unmatched).groupBy("file_id", "page_idx").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def redaction_plan(inputs: Inputs, made: Stages, bands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes per header page, words that stay), for packets with a header page; other pages keep all their words."""
    if bands is None:
        bands = redaction.detect_bands(inputs.rasters, made.anchors) if inputs.rasters is not None else None
    if bands is None:
        bands = made.packets.where("header_page IS NOT NULL").select(
            "file_id", F.col("header_page").alias("page_idx"), F.struct(*[F.lit(redaction.G.BAND_FALLBACK[k]).alias(k[0]) for k in ("left", "top", "right", "bottom")]).alias("band"), F.lit(False).alias("detected")
        )
    plan = redaction.plan_boxes(bands, made.anchors, inputs.manual_boxes)
    return plan, redaction.kept_words(inputs.words, plan)


def run_dispositions(
    inputs: Inputs,
    decisions: DataFrame,
    ledger: DataFrame,
    *,
    detection_overrides: DataFrame,
    composition_overrides: DataFrame,
    bands: DataFrame | None = None,
    full_roster: DataFrame | None = None,
    allow_delete: bool = True,
    scorer: match.Scorer = fuzzy.name_score,
    tags: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, words that would be published). With ``tags`` only these packets are looked at; the ledger is whole, so that the paths
    of others stay theirs.

    Held matches are looked for among undecided packets only, leaks among decided ones only: the costly joins see no other rows. The
    leak check uses the roster of the run, or ``full_roster``.
    """
    made = stages(inputs)
    plan, kept = redaction_plan(inputs, made, bands)
    packets = made.packets.select("file_id", "tag", F.col("packet_index").alias("ord"), "worksheet_type", "issues", "header_page", "page_indices", "name_text")
    if tags is not None:
        packets = packets.join(tags.select("tag"), "tag", "left_semi")
    undecided = packets.join(decisions.select("tag"), "tag", "left_anti")
    probes = undecided.select("file_id", "tag", "ord", F.lit("").alias("round"), "name_text")
    held = match.propose(probes, inputs.roster, inputs.held, scorer, inputs.by).where("is_held_match").select("tag")
    decided = packets.join(decisions.where("sid IS NOT NULL").select("tag"), "tag", "left_semi")
    lacking = decided.join(plan.where("detected").select("file_id", F.col("page_idx").alias("header_page")), ["file_id", "header_page"], "left_anti").select("tag")
    shown = decided.select("file_id", "tag", F.explode("page_indices").alias("page_idx")).join(kept, ["file_id", "page_idx"])
    found = leak.leak_findings(shown.select(F.col("tag").alias("file_id"), "page_idx", "text"), full_roster if full_roster is not None else inputs.roster)
    outcomes = O.decide(
        packets.select("tag", "ord", "worksheet_type", "issues"),
        decisions,
        inputs.roster,
        ledger,
        held_matches=held,
        undetected=lacking,
        leaks=found.select(F.col("file_id").alias("tag")),
        detection_overrides=detection_overrides,
        composition_overrides=composition_overrides,
        allow_delete=allow_delete,
    )
    published = shown.join(outcomes.where("outcome = 'written'").select("tag"), "tag", "left_semi")
    return outcomes, published


def published_files(inputs: Inputs, made: Stages, plan: DataFrame, kept: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(path, content): the PDF of each written packet, the boxes over its header, the stamp, and the words that stay.

    A page's raster is drawn with its boxes if ``inputs.rasters`` has it; else the page holds vector boxes and the text layer.
    """
    written = outcomes.where("outcome = 'written'").select("tag", "sid", "path")
    places = made.packets.join(written.select("tag"), "tag", "left_semi").select("file_id", "tag", "header_page", F.posexplode("page_indices").alias("offset", "page_idx"))
    pages = places.join(inputs.pages.select("file_id", "page_idx", "width", "height"), ["file_id", "page_idx"])
    boxes = plan.select("file_id", "page_idx", "boxes")
    heads = pages.join(boxes, ["file_id", "page_idx"]).join(written, "tag").withColumn("lines", X.stamp_lines("sid"))
    marks = redaction.mark_operators(heads.select("file_id", "page_idx", "boxes", "lines", "height"))
    words = kept.join(pages.select("file_id", "page_idx", "height"), ["file_id", "page_idx"])
    texts = redaction.text_operators(words, F.col("height")).select("file_id", "page_idx", "word_seq", "operator").unionByName(marks)
    operators = texts.join(places.select("file_id", "page_idx", "tag", "offset"), ["file_id", "page_idx"]).select("tag", "offset", "word_seq", "operator")
    shown = pages.select("file_id", "page_idx", "tag", "offset", "width", "height")
    if inputs.rasters is not None:
        shown = join_heavy(shown, redaction.redacted_rasters(inputs.rasters, boxes), ["file_id", "page_idx"], "left")
    return documents.publish(operators, shown.drop("file_id", "page_idx"), written.select("tag", "path"))


def analyze(outcomes: DataFrame, grouped: DataFrame) -> DataFrame:
    """Holds by round, from a dry run of the outcomes."""
    return O.holds_by_round(outcomes, grouped)
