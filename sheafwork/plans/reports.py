"""Reports as text, from rows that are few by nature: rounds, resolutions, counts, duplicates, findings."""

from __future__ import annotations

import calendar

from pyspark.sql import DataFrame

_REASONS = {
    "too_few_dates": "too few packets have a date that can be read",
    "no_majority": "no month holds enough of the dates",
    "no_block": "no block has this period and month",
    "ambiguous_blocks": "several blocks have this period and month",
}


def rounds_text(summary: DataFrame) -> str:
    lines = ["Rounds:"]
    for r in summary.orderBy("file_id", "first_page").collect():
        off = f", {r['n_disagreeing']} with another date" if r["n_disagreeing"] else ""
        lines.append(f"  {r['label']}: {r['n_packets']} packet(s), pages {r['first_page']}-{r['last_page']}{off}")
    return "\n".join(lines)


def resolution_text(resolved: DataFrame) -> str:
    out = []
    for r in resolved.orderBy("file_id").collect():
        months = ", ".join(f"{calendar.month_name[m]}: {n}" for m, n in sorted((r["month_histogram"] or {}).items())) or "none"
        out += [f"{r['file_id']}, class period {r['class_period']}", f"  months: {months}", f"  dated packets: {r['n_parsed']} of {r['n_total']}"]
        out.append(f"  block {r['block']} ({r['confidence']:.0%})" if r["block"] else f"  no block: {_REASONS[r['reason']]}")
    return "\n".join(out)


def histogram_text(histogram: DataFrame) -> str:
    months = ", ".join(f"{calendar.month_name[r['month']]}: {r['n']}" for r in histogram.orderBy("file_id", "month").collect())
    return f"Months of the packets' dates (for information only): {months or 'none can be read'}"


def duplicates_text(duplicates: DataFrame) -> str:
    rows = duplicates.orderBy("label", "sid").collect()
    if not rows:
        return "No entry is decided twice in a round."
    return "\n".join(["Entries decided twice in a round:", *(f"  {r['label']}, {r['sid']}: {', '.join(r['tags'])}" for r in rows)])


def counts_text(counts: DataFrame, title: str) -> str:
    """Any row of counts, one line a column."""
    row = counts.first().asDict()
    return "\n".join([f"{title}:", *(f"  {name.removeprefix('n_').replace('_', ' ')}: {n}" for name, n in row.items())])


def holds_text(holds: DataFrame) -> str:
    lines = ["Holds by round:"]
    for r in holds.orderBy("label").collect():
        lines.append(f"  {r['label']}: {r['n_clean']} of {r['n_packets']} clean; issues {r['n_issues']}, border {r['n_border']}, leak {r['n_leak']}")
    return "\n".join(lines)


def verify_text(report: DataFrame, findings: DataFrame) -> tuple[str, bool]:
    """The lines of a verification, and whether all files are free of names."""
    lines, ok = [], True
    by_file: dict[str, list[str]] = {}
    for f in findings.orderBy("file_id", "page_idx", "token").collect():
        how = "is" if f["exact"] else "resembles"
        by_file.setdefault(f["file_id"], []).append(f"    page {f['page_idx']}: {f['token']!r} {how} a name of {f['sid']}")
    for r in report.orderBy("file_id").collect():
        ok &= r["ok"]
        lines += [f"{'ok  ' if r['ok'] else 'FAIL'} {r['file_id']}", *by_file.get(r["file_id"], [])]
    n = len(lines) and sum(not line.startswith(" ") for line in lines)
    lines.append(f"{n} file(s), {len(by_file)} with findings")
    return "\n".join(lines), ok
