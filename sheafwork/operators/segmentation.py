"""Pages and words to packets: page features, the ordered fold that forms packets, header fields, page sequences.

Tables: ``pages(file_id, page_idx, width, height, has_text)``, ``words(file_id, page_idx, word_seq, text, x0, x1, top, bottom)``,
``features(file_id, page_idx, is_header, page_num, page_total, readable, worksheet_type)`` and
``packets(file_id, packet_index, page_indices, header_page, declared_total, is_orphan, worksheet_type, issues)``; an issue is
``struct(code, page, detail)`` and can be written out as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions import text as X

# Fixed values of the worksheet layout, in page points from the top left.
HEADER_SEARCH_BOTTOM = 188.0
FOOTER_TOP = 700.0
TYPE_COLUMN_RIGHT = (160 + 513) / 2
ANCHOR_FALLBACK = {"name": 68.0, "teacher": 87.0, "group": 111.0}
ROW_SLACK = 10.0
BAND_SLACK = 1.5
ABOVE_ANCHORS = 20.0
COLUMN_SPLIT_X = 400.0
ANCHOR_WORDS = {"name": ["name:", "name"], "teacher": ["teacher:", "teacher"], "group": ["group"]}
LABEL_WORDS = {
    "name": ["name:", "name", "date:", "date"],
    "teacher": ["teacher:", "teacher", "period:", "period"],
    "group": ["group", "members,", "members", "if", "any:", "any"],
}

#: Issue codes whose packets a reviewer may confirm as they are.
CONFIRMABLE = ["total_mismatch", "footer_unreadable", "sequence_unreadable", "out_of_sequence", "total_differs"]

ISSUE = "struct<code:string,page:int,detail:string>"


def page_features(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Header test, page marker and worksheet type of each page, from the words of its header and footer bands only."""
    in_header = (F.col("top") <= HEADER_SEARCH_BOTTOM) & X.normalize_word("text").isin(ANCHOR_WORDS["name"])
    in_footer = F.col("top") >= FOOTER_TOP
    word = F.struct("top", "x0", "text")
    of_page = (
        words.where((F.col("top") <= HEADER_SEARCH_BOTTOM) | in_footer)
        .groupBy("file_id", "page_idx")
        .agg(
            F.bool_or(in_header).alias("is_header"),
            F.collect_list(F.when(in_footer, word)).alias("footer"),
            F.collect_list(F.when(in_footer & (F.col("x0") < TYPE_COLUMN_RIGHT), word)).alias("left"),
        )
    )
    rows = pages.select("file_id", "page_idx", "height").join(of_page, ["file_id", "page_idx"], "left")
    fits = F.col("height") > FOOTER_TOP
    marker = F.when(fits, X.page_marker(X.reading_order("footer")))
    rows = rows.withColumn("m", marker)
    return rows.select(
        "file_id",
        "page_idx",
        F.coalesce("is_header", F.lit(False)).alias("is_header"),
        F.col("m.num").alias("page_num"),
        F.col("m.total").alias("page_total"),
        F.col("m").isNotNull().alias("readable"),
        F.when(fits, X.worksheet_slug(X.reading_order("left"))).alias("worksheet_type"),
    )


def apply_page_sequence(features: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Adds ``ord``, the place in processing order. Files in ``sequences(file_id, sequence)`` follow it; pages it leaves out are gone."""
    natural = features.withColumn("ord", F.col("page_idx"))
    if sequences is None:
        return natural
    places = sequences.select("file_id", F.posexplode("sequence").alias("ord", "page_idx"))
    own = features.join(places, ["file_id", "page_idx"])
    return natural.join(sequences.select("file_id"), "file_id", "left_anti").unionByName(own)


def _issue(code: str, page: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), page.cast("int").alias("page"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def _present(*issues: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, issue) for condition, issue in issues]))


def _close(packet: Column) -> Column:
    """The packet with the issue that its number of pages is not the declared one, if so."""
    n = F.size(packet["page_indices"])
    total = packet["declared_total"]
    mismatch = _issue("total_mismatch", F.lit(None), F.concat(n.cast("string"), F.lit("/"), total.cast("string")))
    issues = F.when(total.isNotNull() & (n != total), F.array_append(packet["issues"], mismatch)).otherwise(packet["issues"])
    return packet.withField("issues", issues)


_PACKET = f"struct<page_indices:array<int>,header_page:int,declared_total:int,is_orphan:boolean,worksheet_type:string,issues:array<{ISSUE}>>"


def _opened(page: Column, orphan: bool, issues: Column) -> Column:
    return F.struct(
        F.array(page["page_idx"]).alias("page_indices"),
        (F.lit(None).cast("int") if orphan else page["page_idx"]).alias("header_page"),
        F.when(page["readable"], page["page_total"]).alias("declared_total"),
        F.lit(orphan).alias("is_orphan"),
        (F.lit(None).cast("string") if orphan else page["worksheet_type"]).alias("worksheet_type"),
        issues.cast(f"array<{ISSUE}>").alias("issues"),
    ).cast(_PACKET)


def segment_packets(features: DataFrame) -> DataFrame:
    """The packets of each file, by one fold over its pages in order.

    A header page opens a packet. Another page continues the open packet unless that already has all its declared pages or the
    page's own number is not the next one; then, and if none is open, it opens a packet without a header. Files are short, so a
    file's pages are one array; files are spread over the cluster.
    """
    if "ord" not in features.columns:
        features = apply_page_sequence(features)
    page = F.struct("ord", "page_idx", "is_header", "page_num", "page_total", "readable", "worksheet_type")
    files = features.groupBy("file_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    nothing = F.lit(None).cast(_PACKET)
    start = F.struct(F.array().cast(f"array<{_PACKET}>").alias("done"), nothing.alias("open"))

    def finish(state: Column) -> Column:
        return F.when(state["open"].isNotNull(), F.array_append(state["done"], _close(state["open"]))).otherwise(state["done"])

    def step(state: Column, p: Column) -> Column:
        opened, idx = state["open"], p["page_idx"]
        n = F.size(opened["page_indices"])
        breaks = (opened["declared_total"] <= n) | (p["readable"] & (p["page_num"] != n + 1))
        goes_on = ~p["is_header"] & opened.isNotNull() & ~F.coalesce(breaks, F.lit(False))
        header = _opened(
            p,
            False,
            _present(
                (~p["readable"], _issue("footer_unreadable", idx)),
                (p["readable"] & (p["page_num"] != 1), _issue("header_not_first", idx, p["page_num"])),
                (p["worksheet_type"].isNull(), _issue("type_unreadable", idx)),
            ),
        )
        orphan = _opened(p, True, _present((F.lit(True), _issue("no_header", idx)), (~p["readable"], _issue("footer_unreadable", idx))))
        differs = p["readable"] & opened["declared_total"].isNotNull() & (p["page_total"] != opened["declared_total"])
        both = F.concat(p["page_total"].cast("string"), F.lit("/"), opened["declared_total"].cast("string"))
        more = _present((~p["readable"], _issue("sequence_unreadable", idx)), (differs, _issue("total_differs", idx, both)))
        longer = opened.withField("page_indices", F.array_append(opened["page_indices"], idx)).withField("issues", F.concat(opened["issues"], more.cast(f"array<{ISSUE}>")))
        return F.struct(
            F.when(goes_on, state["done"]).otherwise(finish(state)).alias("done"),
            F.when(goes_on, longer.cast(_PACKET)).when(p["is_header"], header).otherwise(orphan).alias("open"),
        )

    folded = files.select("file_id", F.aggregate("pages", start, step, finish).alias("packets"))
    out = folded.select("file_id", F.posexplode("packets").alias("k", "p"))
    return out.select("file_id", (F.col("k") + 1).alias("packet_index"), "p.*")


def issue_text(issue: Column) -> Column:
    """An issue as the sentence that reports show."""
    page = F.concat(F.lit("page "), issue["page"].cast("string"), F.lit(": "))
    first, second = F.split_part(issue["detail"], F.lit("/"), F.lit(1)), F.split_part(issue["detail"], F.lit("/"), F.lit(2))
    code = issue["code"]
    return (
        F.when(code == "total_mismatch", F.concat(F.lit("packet has "), first, F.lit(" page(s), its footer declares "), second))
        .when(code == "footer_unreadable", F.concat(page, F.lit("unreadable footer, the page count cannot be verified")))
        .when(code == "header_not_first", F.concat(page, F.lit("header page is numbered "), issue["detail"], F.lit(", not 1")))
        .when(code == "type_unreadable", F.concat(page, F.lit("worksheet type cannot be read, so the output cannot be filed")))
        .when(code == "no_header", F.concat(page, F.lit("continuation page with no preceding header")))
        .when(code == "sequence_unreadable", F.concat(page, F.lit("unreadable footer, the sequence cannot be verified")))
        .when(code == "total_differs", F.concat(page, F.lit("footer declares "), first, F.lit(" pages, the packet began with "), second))
        .when(code == "orientation_unresolved", F.concat(page, F.lit("orientation cannot be determined, held for review")))
        .when(code == "orientation_pending", F.concat(page, F.lit("detected as rotated by "), issue["detail"], F.lit(" degrees, not confirmed yet")))
        .otherwise(F.concat(page, code))
    )


def issues_confirmable(issues: Column | str) -> Column:
    """Whether a reviewer's confirmation may lift all issues."""
    return F.forall(F.col(issues) if isinstance(issues, str) else issues, lambda x: x["code"].isin(CONFIRMABLE))


def with_orientation_issues(packets: DataFrame, flags: DataFrame) -> DataFrame:
    """Appends an issue for each page of ``flags(file_id, page_idx, angle, status)`` with status unresolved, then pending, by page."""
    located = packets.select("file_id", "packet_index", F.explode("page_indices").alias("page_idx")).join(flags, ["file_id", "page_idx"])
    code = F.concat(F.lit("orientation_"), F.col("status"))
    rank = F.when(F.col("status") == "unresolved", 0).otherwise(1)
    entry = F.struct(rank.alias("rank"), F.col("page_idx").alias("page"), code.alias("code"), F.when(rank == 1, F.col("angle").cast("string")).otherwise("").alias("detail"))
    more = located.groupBy("file_id", "packet_index").agg(F.sort_array(F.collect_list(entry)).alias("more"))
    added = F.transform("more", lambda x: F.struct(x["code"].alias("code"), x["page"].alias("page"), x["detail"].alias("detail"))).cast(f"array<{ISSUE}>")
    joined = packets.join(more, ["file_id", "packet_index"], "left")
    return joined.withColumn("issues", F.concat("issues", F.coalesce(added, F.array().cast(f"array<{ISSUE}>")))).drop("more")


def with_tags(packets: DataFrame, stem: Column | str = "file_id") -> DataFrame:
    """Adds ``tag``, ``n_pages`` and ``page_count_mismatch``."""
    n = F.size("page_indices")
    return packets.withColumns({"tag": X.packet_tag(stem, F.get("page_indices", 0)), "n_pages": n, "page_count_mismatch": F.coalesce(n != F.col("declared_total"), F.lit(False))})


def reversed_pairs(packets: DataFrame) -> DataFrame:
    """Single continuation pages scanned before their header page: the next page opens a packet with the same declared total."""
    lone = packets.where(F.col("is_orphan") & (F.size("page_indices") == 1) & F.col("declared_total").isNotNull())
    lone = lone.select("file_id", F.get("page_indices", 0).alias("continuation_page"), "declared_total")
    heads = packets.where("header_page IS NOT NULL").select("file_id", (F.col("header_page") - 1).alias("continuation_page"), F.col("header_page"), "declared_total")
    return lone.join(heads, ["file_id", "continuation_page", "declared_total"]).select("file_id", "continuation_page", "header_page", "declared_total")


# Edits of a page sequence


def move_page(sequence: Column | str, page: Column, place: Column) -> Column:
    """The sequence with a page moved to a place counted from 0."""
    rest = F.array_remove(F.col(sequence) if isinstance(sequence, str) else sequence, page)
    return F.concat(F.slice(rest, F.lit(1), place), F.array(page), F.slice(rest, place + 1, F.greatest(F.size(rest) - place, F.lit(0))))


def remove_page(sequence: Column | str, page: Column) -> Column:
    return F.array_remove(F.col(sequence) if isinstance(sequence, str) else sequence, page)


def insert_page(sequence: Column | str, page: Column, beside: Column, after: bool = False) -> Column:
    """The sequence with a page before or after another; at the end if that is not there."""
    rest = F.array_remove(F.col(sequence) if isinstance(sequence, str) else sequence, page)
    place = F.array_position(rest, beside).cast("int")
    at = F.when(place == 0, F.size(rest)).otherwise(place if after else place - 1)
    return F.concat(F.slice(rest, F.lit(1), at), F.array(page), F.slice(rest, at + 1, F.greatest(F.size(rest) - at, F.lit(0))))


def removed_pages(sequence: Column | str, n_pages: Column) -> Column:
    every = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, F.col(sequence) if isinstance(sequence, str) else sequence)


# Header fields


def header_anchors(words: DataFrame) -> DataFrame:
    """The tops of the printed row labels of each page, the layout's where a label is not found, and the height of a row."""
    band = words.where(F.col("top") <= HEADER_SEARCH_BOTTOM)
    low = X.normalize_word("text")
    tops = [F.min(F.when(low.isin(ANCHOR_WORDS[k]), F.col("top"))).alias(k) for k in ANCHOR_WORDS]
    found = band.groupBy("file_id", "page_idx").agg(*tops)
    out = found.select(
        "file_id",
        "page_idx",
        *[F.coalesce(k, F.lit(ANCHOR_FALLBACK[k])).alias(f"{k}_top") for k in ANCHOR_WORDS],
        *[F.col(k).isNotNull().alias(f"{k}_found") for k in ANCHOR_WORDS],
    )
    upper, lower = F.col("group_top") - F.col("teacher_top"), F.col("teacher_top") - F.col("name_top")
    return out.withColumn("row_height", F.when(upper > 0, upper).when(lower > 0, lower).otherwise(F.lit(ANCHOR_FALLBACK["group"] - ANCHOR_FALLBACK["teacher"])))


def nearest_row(top: Column | str, name_top: Column | str, teacher_top: Column | str, group_top: Column | str) -> Column:
    """The row whose anchor is nearest; ties go to name, then teacher."""
    t = F.col(top) if isinstance(top, str) else top
    name, teacher, group = (F.abs(t - (F.col(x) if isinstance(x, str) else x)) for x in (name_top, teacher_top, group_top))
    return F.when((name <= teacher) & (name <= group), "name").when(teacher <= group, "teacher").otherwise("group")


def row_words(words: DataFrame, anchors: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Header words with their row. The lower bound follows the rows' own height, or the border ``bands(file_id, page_idx, band)``."""
    rows = words.where(F.col("top") <= HEADER_SEARCH_BOTTOM).join(anchors, ["file_id", "page_idx"])
    bound = F.col("group_top") + F.col("row_height") + ROW_SLACK
    if bands is not None:
        rows = rows.join(bands.select("file_id", "page_idx", F.col("band.b").alias("band_bottom")), ["file_id", "page_idx"], "left")
        bound = F.coalesce(F.col("band_bottom") + BAND_SLACK, bound)
    inside = F.col("top").between(F.least("name_top", "teacher_top", "group_top") - ABOVE_ANCHORS, F.least(F.lit(HEADER_SEARCH_BOTTOM), bound))
    return rows.where(inside).withColumn("row", nearest_row("top", "name_top", "teacher_top", "group_top"))


def header_fields(words: DataFrame) -> DataFrame:
    """name, teacher, group, date and period as written, of each page that has words in the header band."""
    anchors = header_anchors(words)
    word = F.struct("text", "x0", "top")
    collected = row_words(words, anchors).groupBy("file_id", "page_idx").agg(*[F.collect_list(F.when(F.col("row") == k, word)).alias(k) for k in ANCHOR_WORDS])
    rows = anchors.join(collected, ["file_id", "page_idx"], "left")
    split = COLUMN_SPLIT_X
    fields = {
        "name_text": X.row_text("name", LABEL_WORDS["name"], x_max=split),
        "teacher_text": X.row_text("teacher", LABEL_WORDS["teacher"], x_max=split),
        "group_text": X.row_text("group", LABEL_WORDS["group"]),
        "date_text": X.row_text("name", LABEL_WORDS["name"], x_min=split),
        "period_text": X.row_text("teacher", LABEL_WORDS["teacher"], x_min=split),
    }
    return rows.select(*anchors.columns, *[F.coalesce(value, F.lit("")).alias(name) for name, value in fields.items()])


def packet_fields(packets: DataFrame, fields: DataFrame) -> DataFrame:
    """Each packet with the fields of its header page; packets without one keep empty fields."""
    texts = ["name_text", "teacher_text", "group_text", "date_text", "period_text"]
    head = fields.select("file_id", F.col("page_idx").alias("header_page"), *texts)
    joined = packets.join(head, ["file_id", "header_page"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def page_places(packets: DataFrame) -> DataFrame:
    """(file_id, packet_index, page_idx, offset): where each page lies in its packet, counted from 1."""
    return packets.select("file_id", "packet_index", F.posexplode("page_indices").alias("k", "page_idx")).select("file_id", "packet_index", "page_idx", (F.col("k") + 1).alias("offset"))


def renumbered(packets: DataFrame) -> DataFrame:
    """packet_index anew from 1, after packets were filtered."""
    return packets.withColumn("packet_index", F.row_number().over(Window.partitionBy("file_id").orderBy("packet_index")))
