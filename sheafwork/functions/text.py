"""Scalar text expressions. All are built-in expressions and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the worksheet layout: the printed page marker, the printed type with its revision date, the period in a file name.
PAGE_MARKER = r"Page\s+(\d+)\s+of\s+(\d+)"
WORKSHEET_TYPE = r"(.+?)\s*\(?\d{2}[/\s]\d{4}\)?"
PERIOD_IN_NAME = r"(?i)PD\s*0*(\d+)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def normalize_name(x: Column | str) -> Column:
    """Lower case, one blank between words, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(x)), r"(?U)\s+", " "))


def normalize_word(x: Column | str) -> Column:
    return F.lower(trimmed(x))


def name_variants(first: Column | str, last: Column | str) -> Column:
    """Both orders, and each name alone, normalized; empty variants are left out."""
    f, n = _col(first), _col(last)
    forms = F.array(F.concat_ws(" ", f, n), F.concat_ws(" ", n, f), n, f)
    return F.filter(F.transform(forms, normalize_name), lambda v: v != "")


def too_short_to_read(x: Column | str, least: int = 3) -> Column:
    """Whether a normalized name has fewer than ``least`` characters beside blanks."""
    return F.length(F.replace(normalize_name(x), F.lit(" "), F.lit(""))) < least


def tokens(x: Column | str) -> Column:
    """Distinct runs of ASCII letters and apostrophes in lower case, in order of first occurrence."""
    found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit("([A-Za-z']+)"), 1)
    return F.array_distinct(F.transform(found, F.lower))


def page_marker(x: Column | str) -> Column:
    """struct(num, total) if the text holds exactly one marker and 1 <= num <= total, else null."""
    text = F.coalesce(_col(x), F.lit(""))
    nums, totals = (F.regexp_extract_all(text, F.lit(PAGE_MARKER), k) for k in (1, 2))
    num, total = F.get(nums, 0).try_cast("int"), F.get(totals, 0).try_cast("int")
    return F.when((F.size(nums) == 1) & (num >= 1) & (num <= total), F.struct(num.alias("num"), total.alias("total")))


def worksheet_slug(x: Column | str) -> Column:
    """The printed worksheet type as a path segment; null if the text has no revision date or nothing before it."""
    head = F.regexp_extract(F.coalesce(_col(x), F.lit("")), WORKSHEET_TYPE, 1)
    slug = F.upper(F.regexp_replace(F.regexp_replace(head, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.nullif(slug, F.lit(""))


def zero_filled(x: Column | str, width: int = 2) -> Column:
    """Digits filled with zeros to a width; other or longer texts stay as they are."""
    s = trimmed(_col(x).cast("string"))
    return F.when(s.rlike(r"^\d+$") & (F.length(s) < width), F.lpad(s, width, "0")).otherwise(s)


def period_from_file_name(path: Column | str) -> Column:
    """The two-digit period that the stem of a file name mentions, else null."""
    digits = F.regexp_extract(file_stem(path), PERIOD_IN_NAME, 1)
    return F.when(digits != "", zero_filled(digits))


def file_stem(path: Column | str) -> Column:
    """The last part of a path without its last suffix."""
    name = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def strip_trailing_punctuation(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), r"\p{Punct}+$", "")


def packet_tag(stem: Column | str, first_page: Column | str) -> Column:
    """``<stem>_p<first page>``, the page with three digits at least."""
    return F.format_string("%s_p%03d", _col(stem), _col(first_page))


def issue_page(issue: Column | str, fallback: Column | str) -> Column:
    """The page that an issue's text begins with, else the fallback."""
    digits = F.regexp_extract(_col(issue), r"^page (\d+):", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), _col(fallback))


def pdf_escaped(x: Column | str) -> Column:
    """A text as it stands in a PDF string: backslashes first, then parentheses."""
    out = F.replace(_col(x), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)"))


def sidecar_path(path: Column | str, suffix: str) -> Column:
    """The path of a file beside another: ``dir/<stem><suffix>``."""
    folder = F.regexp_extract(_col(path), r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, file_stem(path), F.lit(suffix))


def stamp_lines(sid: Column | str) -> Column:
    """What is stamped on a redacted header: the entry's number and period, or the plain notice."""
    s = _col(sid)
    return F.when(s.isNotNull(), F.array(F.concat(F.lit("SID: "), s), F.concat(F.lit("PD: "), F.substring(s, 7, 2)))).otherwise(F.array(F.lit("REDACTED")))


def sid_parts(sid: Column | str) -> list[Column]:
    """teacher_code, period and student_index of a ten-digit number."""
    s = _col(sid)
    return [F.substring(s, 1, 6).alias("teacher_code"), F.substring(s, 7, 2).alias("period"), F.substring(s, 9, 2).alias("student_index")]


def reading_order(words: Column | str) -> Column:
    """The texts of an array of words (text, x0, top, ...) joined from top to bottom, then from left to right."""
    ordered = F.array_sort(F.transform(_col(words), lambda w: F.struct(w["top"].alias("top"), w["x0"].alias("x0"), w["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda w: w["text"]), " ")


def row_text(words: Column | str, exclude: list[str], x_min: float | None = None, x_max: float | None = None) -> Column:
    """Words of a row from left to right, without printed labels, with ``x_min <= x0 < x_max``."""

    def kept(w: Column) -> Column:
        ok = ~normalize_word(w["text"]).isin(exclude)
        ok = ok & (w["x0"] >= F.lit(float(x_min))) if x_min is not None else ok
        return ok & (w["x0"] < F.lit(float(x_max))) if x_max is not None else ok

    ordered = F.array_sort(F.transform(F.filter(_col(words), kept), lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda w: w["text"]), " ")
