"""Segmentation, header fields, rounds and blocks on fixtures and on random streams."""

import datetime
import random
import re

from pyspark.sql import functions as F

from sheafwork.functions import dates as D
from sheafwork.operators import rounds as R
from sheafwork.operators import segmentation as S
from sheafwork.streaming.ingest import PacketFold

FEATURES = "file_id string, page_idx int, is_header boolean, page_num int, page_total int, readable boolean, worksheet_type string"


def stream(spark, *files):
    rows = []
    for name, pages in files:
        for k, page in enumerate(pages.split()):
            num, _, total = page[1:].partition("/")
            known = num != "-"
            rows.append((name, k, page[0] == "H", int(num) if known else None, int(total) if known else None, known, "PRT" if page[0] == "H" else None))
    return spark.createDataFrame(rows, FEATURES)


def packets(frame):
    return [(r["page_indices"], r["is_orphan"], [i["code"] for i in r["issues"]]) for r in S.segment_packets(frame).orderBy("file_id", "packet_index").collect()]


def test_footer_edge_cases(spark):
    assert packets(stream(spark, ("a", "H1/2 C2/2 C2/2 H-"))) == [([0, 1], False, []), ([2], True, ["no_header", "total_mismatch"]), ([3], False, ["footer_unreadable"])]


def test_unreadable_continuation_is_confirmable(spark):
    found = S.segment_packets(stream(spark, ("a", "H1/2 C-")))
    assert packets(stream(spark, ("a", "H1/2 C-"))) == [([0, 1], False, ["sequence_unreadable"])]
    assert found.select(S.issues_confirmable("issues")).first()[0]


def test_reversed_pair_and_its_sequence(spark):
    pages = stream(spark, ("a", "H1/2 C2/2 C2/2 H1/2"))
    pair = S.reversed_pairs(S.segment_packets(pages)).collect()
    assert [(r["continuation_page"], r["header_page"], r["declared_total"]) for r in pair] == [(2, 3, 2)]
    order = spark.createDataFrame([("a", [0, 1, 3, 2])], "file_id string, sequence array<int>")
    fixed = S.apply_page_sequence(pages, order)
    assert packets(fixed) == [([0, 1], False, []), ([3, 2], False, [])]


def test_issue_texts(spark):
    found = S.segment_packets(stream(spark, ("a", "H1/3 C-"))).select(F.transform("issues", S.issue_text).alias("t")).first()["t"]
    assert found == ["page 1: unreadable footer, the sequence cannot be verified", "packet has 2 page(s), its footer declares 3"]


def test_random_streams_equal_the_stateful_fold(spark):
    random.seed(3)
    files = []
    for k in range(60):
        pages = []
        for _ in range(random.randint(1, 25)):
            total = random.randint(1, 3)
            mark = "-" if random.random() < 0.15 else f"{random.randint(1, total)}/{total}"
            pages.append(("H" if random.random() < 0.35 else "C") + mark)
        files.append((f"f{k:02}", " ".join(pages)))
    want = []
    for _, pages in files:
        fold, n = PacketFold(), len(pages.split())
        for k, page in enumerate(pages.split()):
            num, _, total = page[1:].partition("/")
            known = num != "-"
            done = fold.feed(k, page[0] == "H", int(num) if known else None, int(total) if known else None, "PRT" if page[0] == "H" else None, k == n - 1)
            want += [(d["pages"], d["orphan"], d["issues"]) for d in done]
    assert packets(stream(spark, *files)) == want


def test_months_of_every_form(spark):
    """Dates of a calendar in each form that is read, and each with one part out of its range."""
    random.seed(31)
    rows = []
    for _ in range(150):
        day = datetime.date(random.randint(1990, 2060), 1, 1) + datetime.timedelta(random.randrange(365))
        mark = random.choice("/-")
        number = day.strftime(random.choice([f"%m{mark}%d{mark}%Y", f"%m{mark}%d{mark}%y"]))
        if random.random() < 0.5:
            number = re.sub(r"\b0(\d[/-])", r"\1", number)
        named = random.choice([day.strftime("%B"), day.strftime("%b"), day.strftime("%b") + "."])
        rows += [(number, day.month), (f"{named} {day.day}{random.choice([',', ''])} {day.year}", day.month)]
        bad = random.choice([f"{day.month + 12}/{day.day}/{day.year}", f"{day.month}/{day.day + 31}/{day.year}", f"{day.month}//{day.year}", f"0/{day.day}/{day.year}", f"{day.year}"])
        rows.append((bad, None))
    rows += [(" " * k, None) for k in range(3)] + [(None, None), ("unreadable", None)]
    frame = spark.createDataFrame(rows, "text string, month int")
    assert frame.where(~D.parse_month("text").eqNullSafe(F.col("month"))).collect() == []


def test_short_years_stay_as_written(spark):
    assert spark.range(1).select(D.round_label(F.lit("7/19/731"))).first()[0] == "0731-07"


def sequential_rounds(labels):
    """The rule of rounds one packet at a time."""
    groups, now, anchor = [], [], None
    for k, label in enumerate(labels):
        if label is None or anchor is None or label == anchor:
            anchor = anchor if label is None else label
            now.append(k)
            continue
        later = next((x for x in labels[k + 1 :] if x is not None), None)
        if later != anchor:
            groups.append(now)
            now, anchor = [k], label
        else:
            now.append(k)
    return groups + [now] if now else groups


def test_rounds_equal_the_sequential_rule(spark):
    random.seed(11)
    files = [[random.choice([None, "2025-10", "2025-10", "2026-02", "2026-03"]) for _ in range(random.randint(1, 14))] for _ in range(400)]
    rows = [(f"f{f}", k, f"f{f}_{k}", "" if x is None else f"{int(x[5:])}/1/{x[:4]}", 2 * k, 2 * k + 1) for f, labels in enumerate(files) for k, x in enumerate(labels)]
    frame = spark.createDataFrame(rows, "file_id string, ord int, tag string, date_text string, first_page int, last_page int")
    found = {}
    for r in R.round_groups(frame).collect():
        found.setdefault(r["file_id"], {}).setdefault(r["group_id"], []).append(r["ord"])
    for f, labels in enumerate(files):
        assert [sorted(g) for _, g in sorted(found[f"f{f}"].items())] == sequential_rounds(labels), labels


def test_block_resolution(spark):
    """Random months of a file against the rule: enough dates, a month that three fifths of them show, and one block of the class."""
    random.seed(37)
    table = [("4", 6, 9), ("7", 6, 11), ("9", 5, 11), ("8", 6, 12)]
    blocks = spark.createDataFrame(table, "block string, class_period int, month int")
    files = [[random.choice([9, 9, 9, 11, 12, 4]) for _ in range(random.randint(0, 7))] for _ in range(60)]
    rows = [(f"f{f}", k, f"f{f}_{k}", f"{m}/2/2031") for f, months in enumerate(files) for k, m in enumerate(months)]
    rows += [(f"f{f}", 99, f"f{f}_99", "") for f in range(len(files))]
    found = {r["file_id"]: (r["block"], r["reason"]) for r in R.resolve_block(spark.createDataFrame(rows, "file_id string, ord int, tag string, date_text string"), blocks, 6).collect()}
    reasons = set()
    for f, months in enumerate(files):
        top = max(set(months), key=months.count, default=None)
        if len(months) < R.LEAST_DATED:
            want = (None, "too_few_dates")
        elif months.count(top) < R.LEAST_SHARE * len(months):
            want = (None, "no_majority")
        else:
            of = [f"{int(b):02}" for b, period, m in table if period == 6 and m == top]
            want = (of[0], None) if len(of) == 1 else (None, "no_block")
        assert found[f"f{f}"] == want, months
        reasons.add(want[1])
    assert reasons == {"too_few_dates", "no_majority", "no_block", None}


def test_header_fields(spark):
    """Labels at their places, values right of them, in any order of the words."""
    values = {"name": ("Name:", 45, 68, 150, ["Oskar", "Brandt"]), "teacher": ("Teacher:", 45, 87, 150, ["Lindqvist"]), "date": ("Date:", 413, 68, 450, ["7/19/2031"]), "period": ("Period:", 413, 87, 450, ["06"])}
    words = [(label, x, y) for label, x, y, _, _ in values.values()]
    words += [(t, at + 45 * k, y + (k % 3 - 1)) for _, _, y, at, texts in values.values() for k, t in enumerate(texts)]
    words += [("Group", 46, 111), ("members,", 80, 111), ("if", 130, 111), ("any:", 140, 111), ("Wilma", 190, 112), ("Read", 45, 170), ("Heading", 45, 20)]
    random.seed(41)
    random.shuffle(words)
    rows = [("f", 0, k, t, float(x), x + 20.0, float(y), y + 12.0) for k, (t, x, y) in enumerate(words)]
    found = S.header_fields(spark.createDataFrame(rows, "file_id string, page_idx int, word_seq int, text string, x0 double, x1 double, top double, bottom double")).first()
    assert {k: found[f"{k}_text"] for k in values} == {k: " ".join(v[4]) for k, v in values.items()} and found["group_text"] == "Wilma"
