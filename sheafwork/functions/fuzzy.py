"""String similarity from 0 to 100 by longest common subsequences.

``ratio`` and ``token_sort_ratio`` are built-in expressions: a bit-parallel recurrence over the characters of one text, with the other
as bit masks in a 64-bit number, and a row of the table of subsequences where both texts are longer than such a number allows. The
weighted ratio needs windows and token sets; it runs in Python over Arrow batches, each pair of texts computed once a batch.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.binding import let

#: Characters that fit the masks without overflow in a signed 64-bit sum.
MASK_CHARS = 61
#: A text of so few characters has no window of a ratio over 95 but one that equals it: a letter less gives 200 * 9 / 19 at most.
WHOLE_WINDOW_CHARS = 10


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _lcs_masks(short: Column, other: Column) -> Column:
    """Length of the longest common subsequence of two character arrays; ``short`` has at most MASK_CHARS.

    The places of each character of ``short`` are a bit mask, made once; a step looks the mask of its character up.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    letters = F.array_distinct(short)
    bits = lambda c: F.transform(short, lambda x, i: F.when(x == c, F.call_function("shiftleft", one, i)).otherwise(none))
    masks = F.map_from_arrays(letters, F.transform(letters, lambda c: F.aggregate(bits(c), none, lambda a, b: a.bitwiseOR(b))))
    full = F.call_function("shiftleft", one, F.size(short)) - one

    def folded(bound: Column) -> Column:
        step = lambda s, m: let(s.bitwiseAND(m), lambda u: (s + u).bitwiseOR(s.bitwiseAND(F.bitwise_not(u))).bitwiseAND(bound["full"]))
        of_other = F.transform(other, lambda c: F.coalesce(F.try_element_at(bound["masks"], c), none))
        return F.size(short) - F.bit_count(F.aggregate(of_other, bound["full"], step)).cast("int")

    return let(F.struct(masks.alias("masks"), full.alias("full")), folded)


def _lcs_rows(a: Column, b: Column) -> Column:
    """The same for any lengths, by one row of the table after another."""
    zeros = F.array_repeat(F.lit(0), F.size(a) + 1)

    def row(before: Column, c: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(a)),
            F.array(F.lit(0)),
            lambda out, i: F.array_append(out, F.when(F.get(a, i - 1) == c, F.get(before, i - 1) + 1).otherwise(F.greatest(F.get(before, i), F.get(out, i - 1)))),
        )

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.get(F.aggregate(b, zeros, row), F.size(a)))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two texts."""

    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        return F.when(F.size(x) <= MASK_CHARS, _lcs_masks(x, y)).when(F.size(y) <= MASK_CHARS, _lcs_masks(y, x)).otherwise(_lcs_rows(x, y))

    return let(F.struct(_chars(_col(a)).alias("x"), _chars(_col(b)).alias("y")), of)


def ratio(a: Column | str, b: Column | str) -> Column:
    """100 * 2 * LCS / (length + length); 100 for two empty texts."""

    def of(pair: Column) -> Column:
        total = F.length(pair["a"]) + F.length(pair["b"])
        return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(pair["a"], pair["b"]) / total)

    return let(F.struct(_col(a).alias("a"), _col(b).alias("b")), of)


def sorted_tokens(x: Column | str) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(_col(x), r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """The ratio of the texts with their words in order."""
    return ratio(sorted_tokens(a), sorted_tokens(b))


# The same scorers in Python, and those that are not built in


def py_lcs(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    s = full
    for c in a:
        u = s & masks.get(c, 0)
        s = (s + u | s & ~u) & full
    return len(b) - s.bit_count()


def py_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * py_lcs(a, b) / total if total else 100.0


def py_token_sort(a: str, b: str) -> float:
    return py_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def py_token_set(a: str, b: str) -> float:
    """Compares what the token sets share and what each has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 100.0
    rest_x, rest_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    shared = len(" ".join(sorted(both)))
    blank = 1 if shared else 0
    size_x, size_y = shared + blank + len(rest_x), shared + blank + len(rest_y)
    apart = len(rest_x) + len(rest_y) - 2 * py_lcs(rest_x, rest_y)
    best = 100.0 * (1 - apart / (size_x + size_y))
    if shared:
        for rest, size in ((rest_x, size_x), (rest_y, size_y)):
            best = max(best, 100.0 * (1 - (blank + len(rest)) / (shared + size)))
    return best


def _windows(short: str, long: str) -> float:
    n = len(short)
    spans = {long[max(0, k) : k + n] for k in range(1 - n, len(long))}
    return max((py_ratio(short, w) for w in spans), default=0.0)


def py_partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length on the longer, windows cut off by the ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if a in b or b in a:
        return 100.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(*sorted((a, b), key=len))


def py_partial_token(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    whole = py_partial(" ".join(sorted(x)), " ".join(sorted(y)))
    return max(whole, py_partial(" ".join(sorted(set(x) - set(y))), " ".join(sorted(set(y) - set(x)))))


def py_weighted(a: str, b: str, known: float | None = None) -> float:
    """The weighted ratio: full comparison for like lengths, scaled partial comparison for unlike ones.

    ``known`` is the greater of the plain and the token-sorted ratio, where the caller has both and takes the greater of it and this score.
    """
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    plain = py_ratio(a, b) if known is None else known
    if unlike < 1.5:
        return max(plain, 0.95 * max(py_token_sort(a, b) if known is None else 0.0, py_token_set(a, b)))
    scale = 0.9 if unlike <= 8 else 0.6
    by_words = 0.95 * scale * py_partial_token(a, b)
    if by_words == 0.95 * scale * 100.0 and min(len(a), len(b)) <= WHOLE_WINDOW_CHARS and not (a in b or b in a):
        return max(plain, by_words)  # a partial ratio over 95 needs the whole of a text this short
    return max(plain, scale * py_partial(a, b), by_words)


def py_normalize(x: str) -> str:
    return " ".join(x.lower().split())


@lru_cache(maxsize=200_000)
def py_score(probe: str, first: str, last: str, least_chars: int = 3) -> float:
    """The best of weighted and token-sorted ratio over the variants of a name; 0 for a probe too short to read."""
    text = py_normalize(probe)
    if len(text.replace(" ", "")) < least_chars:
        return 0.0
    variants = {py_normalize(v) for v in (f"{first} {last}", f"{last} {first}", last, first)} - {""}
    return max((max(py_weighted(text, v), py_token_sort(text, v)) for v in variants), default=0.0)


@F.pandas_udf(T.DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([py_weighted(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def name_score(probe: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([py_score(p or "", f or "", n or "") for p, f, n in zip(probe, first, last, strict=True)], dtype="float64")


def native_name_score(probe: Column | str, first: Column | str, last: Column | str) -> Column:
    """The name score with plain and token-sorted ratios only, built in. A form that several variants share is compared once."""
    from sheafwork.functions.text import name_variants, normalize_name, too_short_to_read

    def of(text: Column) -> Column:
        plain = F.transform(name_variants(first, last), lambda v: ratio(text["plain"], v))
        ordered = F.transform(F.array_distinct(F.transform(name_variants(first, last), sorted_tokens)), lambda v: ratio(text["ordered"], v))
        return F.array_max(F.concat(plain, ordered))

    text = normalize_name(probe)
    best = let(F.struct(text.alias("plain"), sorted_tokens(text).alias("ordered")), of)
    return F.when(too_short_to_read(probe), F.lit(0.0)).otherwise(F.coalesce(best, F.lit(0.0)))


# Fixed value of the DuckDB statement: the masks of the left text and the recurrence over the right one.
def lcs_sql(a: str, b: str) -> str:
    """DuckDB SQL for lcs_length of two text expressions of at most MASK_CHARS characters."""
    full = f"((1::BIGINT << length({a})::INT) - 1)"
    mask = f"list_reduce(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN 1::BIGINT << i::INT ELSE 0::BIGINT END), lambda p, q: p | q, 0::BIGINT)"
    step = f"(((s + (s & m)) | (s & ~(s & m))) & {full})"
    folded = f"list_reduce(list_transform(string_split({b}, ''), lambda c: {mask}), lambda s, m: {step}, {full})"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({folded}) END)"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs_sql(a, b)} / (length({a}) + length({b})) END)"
