"""Quality rules as a short-circuit cascade. DataFrame functions only.

A rule is a boolean expression over statistics of a text that rejects it. On a bounded sample each rule's cost (seconds a row) and
rejection rate are measured, and the rules are put in the order of rejection per cost, so that a ``CASE`` stops at the first rule that
rejects. Statistics are expressions too: where only the verdict is wanted, a rule computes its own when its turn comes, so a text that
a cheap rule rejects never pays for the sort of its windows. A verdict is a conjunction, so the order changes the time and never the
result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.binding import let
from sheafwork.llm.common import delete_folder, prepare, shared_folder


#: Places of windows that fit into the lower bits of a sorted number, beside the upper 40 bits of a hash.
_PLACES = 1 << 24
#: Texts of the sample that orders the rules.
SAMPLE_ROWS = 64
#: A rule is timed over so many copies of the sample that it takes this long beyond an empty job, or over this many copies at most.
LEAST_SECONDS = 0.05
MOST_COPIES = 256
LEAST_WORDS = 50
#: Limits in percent: of words that lie in repeated windows, symbols to words, repeated lines to lines, capitals and letters to characters of words.
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 40
CAPITAL_PERCENT = 40
LETTER_PERCENT = 55
#: Mean characters of a word.
LEAST_MEAN_WORD, MOST_MEAN_WORD = 2, 20


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes, from a function that gives a statistic's column by its name, a column that is true for a text to reject."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def base_rules() -> list[Rule]:
    """The two rules whose verdict is part of the contract (``base_failed``)."""
    return [
        Rule("few_words", lambda q: q("n_words") < LEAST_WORDS),
        Rule("repeated_words", lambda q: q("n_repeat_words") * 100 > q("n_words") * REPEAT_PERCENT),
    ]


def further_rules() -> list[Rule]:
    """The rules of the cascade beside the base rules."""
    return [
        Rule("symbols", lambda q: q("n_symbols") * 100 > q("n_words") * SYMBOL_PERCENT),
        Rule("repeated_lines", lambda q: let(q("lines"), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 100 > F.size(x) * DUP_LINE_PERCENT)),
        Rule("word_length", lambda q: (q("word_chars") < q("n_words") * LEAST_MEAN_WORD) | (q("word_chars") > q("n_words") * MOST_MEAN_WORD)),
        Rule("capitals", lambda q: F.length(F.regexp_replace(q("text"), r"\P{Lu}+", "")) * 100 > q("word_chars") * CAPITAL_PERCENT),
        Rule("letters", lambda q: (F.length(q("text")) - F.length(F.regexp_replace(q("text"), r"\p{L}+", ""))) * 100 < q("word_chars") * LETTER_PERCENT),
    ]


def words_of(text: Column) -> Column:
    """The runs of characters other than U+0020 and U+0009 to U+000D."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(words: Column) -> Column:
    """The words that lie in some three-word window found twice or more in the text, the first one included.

    Windows whose 64-bit hashes all differ cannot repeat, which settles most texts. Else numbers made of a hash's upper bits and the
    window's place are sorted; neighbours with equal hashes are compared word by word, and the union of the windows so marked is
    measured. If unequal windows share a hash, or there are more windows than places fit, windows are sorted by their text instead.
    That is n log n steps for any length of text.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    place = lambda x: x.bitwiseAND(F.lit(_PLACES - 1)).cast("int")
    near = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(-_PLACES)) == 0, F.lit(False))
    alike = lambda i, j: (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def union(starts: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        grown = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(F.sort_array(starts), start, grown, lambda a: a["n"])

    def by_text(windows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(windows, k)["g"] == x["g"], F.lit(False))
        return union(F.transform(F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def by_hash(keys: Column) -> Column:
        marked = F.filter(keys, lambda x, k: near(x, F.get(keys, k - 1)) | near(x, F.get(keys, k + 1)))
        return let(marked, lambda m: F.when(~differ(m), union(F.transform(m, place))))

    def differ(m: Column) -> Column:
        before = lambda x, k: let(F.get(m, k - 1), lambda y: F.coalesce(near(x, y) & ~alike(place(x), place(y)), F.lit(False)))
        return F.size(F.filter(m, before)) > 0

    def of(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(-_PLACES)).bitwiseOR(i.cast("long"))))
        windows = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *three(i)).alias("g"), i.alias("p"))))
        quick = F.when(F.size(hashes) <= _PLACES, let(keys, by_hash))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(F.coalesce(quick, let(windows, by_text)))

    return F.when(F.size(words) <= 3, F.lit(0)).otherwise(let(F.transform(places, lambda i: F.xxhash64(*three(i))), of)).cast("long")


def lazy(text: Column, words: Column, n_words: Column, word_chars: Column) -> Callable[[str], Column]:
    """Statistics of a text (never null): its words and their number and characters, and others as expressions, computed where and if
    they are used."""
    makers = {
        "text": lambda: text,
        "n_words": lambda: n_words,
        "word_chars": lambda: word_chars,
        "n_symbols": lambda: F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "lines": lambda: lines_of(text),
        "n_repeat_words": lambda: repeated_words(words),
    }
    return lambda name: makers[name]()


def of_text(text: Column, use: Callable[[Callable[[str], Column]], Column]) -> Column:
    """What ``use`` makes of the statistics of a text; null counts as empty."""
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"))
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(words_of(whole), lambda w: let(counted(w), lambda c: use(lazy(whole, w, c["n"], c["chars"]))))


def _known(text: Column, statistics: Column) -> Callable[[str], Column]:
    """Statistics that a report has computed already, and the others as expressions."""
    rest = lazy(text, words_of(text), statistics["n_words"], statistics["word_chars"])
    return lambda name: statistics[name] if name in ("n_words", "word_chars", "n_symbols", "n_repeat_words") else rest(name)


def text_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, read whole; null counts as empty.

    n_dup_lines counts the lines that hold a word and equal an earlier line; for n_repeat_words see :func:`repeated_words`.
    """

    def of(q: Callable[[str], Column]) -> Column:
        dups = let(q("lines"), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        return F.struct(*[(dups if name == "n_dup_lines" else q(name)).alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])

    return of_text(text, of)


def any_of(rules: list[Rule], q: Callable[[str], Column]) -> Column:
    """True if a rule rejects; rules are tried in the order given and the first rejection ends it."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(q), F.lit(False)), F.lit(True)).otherwise(out)
    return out


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text): at most ``rows`` distinct texts of any length, those with the least hashes, so that no layout of the table favours any.

    One pass over the column keeps about four times as many rows as are wanted before they are sorted.
    """
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    steps = 1 << 30
    rate = min(steps, -(-steps * 4 * rows // max(1, docs.select().count())))
    hashed = texts.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(steps))).where(F.col("h") < rate)
    return hashed.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(rows).select("text")


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, computed: bool = False) -> list[Rule]:
    """The rules in the order of rejection per cost, as measured on :func:`sample_texts`; rules measured alike keep their order.

    A rule's cost is the time of a job that counts its rejections over copies of the sample, less that of a job that counts nothing;
    copies are doubled until the difference is beyond the noise of a job. ``computed``: the statistics of the report are at hand, so
    a rule pays only for what it adds. The sample is written to the shared folder and removed afterwards; the driver sees counts only.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "quality-sample")
    text = F.col("text")
    sample_texts(docs, text_col, sample_rows).select("text", words_of(text).alias("words"), text_statistics(text).alias("q")).write.parquet(folder)
    schema = "text string, words array<string>, q struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"
    sample = spark.read.schema(schema).parquet(folder)
    q = _known(text, F.col("q")) if computed else lazy(text, F.col("words"), F.col("q.n_words"), F.col("q.word_chars"))

    def timed(rejects: Column, copies: int) -> tuple[float, int]:
        job = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")).agg(F.count_if(rejects & (F.col("copy") > 0)))
        began = time.perf_counter()
        return job.first()[0] / copies, time.perf_counter() - began

    try:
        n = sample.count()
        if not n:
            return rules
        rated = []
        empty: dict[int, float] = {}
        for place, rule in enumerate(rules):
            rejects, copies = F.coalesce(rule.rejects(q), F.lit(False)), 1
            timed(rejects, 1)  # classes load and code is generated
            while True:
                if copies not in empty:
                    empty[copies] = min(timed(F.lit(False), copies)[1] for _ in range(2))
                rejected, took = timed(rejects, copies)
                beyond = took - empty[copies]
                if beyond >= LEAST_SECONDS or copies >= MOST_COPIES:
                    break
                copies *= 4
            cost = max(beyond, LEAST_SECONDS / 10) / (n * copies)
            rated.append((-(rejected + 0.5) / n / cost, place, rule))
        return [rule for *_, rule in sorted(rated, key=lambda x: x[:2])]
    finally:
        delete_folder(spark, folder)


def quality_kept(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever these are called.

    Null and empty texts have no words and go. Repeated rows are judged alike, ties cannot occur, an empty table stays empty, and
    texts of any length are read whole. All rules are in the cascade; only the words and their characters are known before it begins.
    """
    rules = plan_cascade(docs, [*base_rules(), *further_rules()], text_col, sample_rows)
    return docs.where(~of_text(docs[text_col], lambda q: any_of(rules, q)))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows are judged alike, ties cannot occur, and an empty table gives an empty
    result; other columns are ignored. As the statistics are columns of the result, the cascade orders the further rules by what they
    cost beyond them.
    """
    rules = plan_cascade(docs, further_rules(), text_col, computed=True)
    whole = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), whole.alias("_t"), text_statistics(docs[text_col]).alias("_q"))
    # A filter on a result must not be pushed below the statistics: they would be copied into every use. The always true test of the
    # partition number is no deterministic expression, which ends the push-down here; a test holds the plan to that.
    rows = rows.withColumn("_here", F.spark_partition_id() >= 0)
    q = _known(F.col("_t"), F.col("_q"))
    rows = rows.withColumn("_base_failed", any_of(base_rules(), q) & F.col("_here"))
    kept = F.when(F.col("_base_failed"), F.lit(False)).otherwise(~any_of(rules, q))
    return rows.select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", F.col("_base_failed").alias("base_failed"), kept.alias("kept"))


#: DuckDB SQL for :func:`quality_report` over the whole table ``{docs}``. Its last column list is that of the query.
REPORT_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM f, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
s AS (SELECT w.rid, doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT rid, doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 10 OR n_dup_lines * 100 > n_lines * 40
    OR word_chars < n_words * 2 OR word_chars > n_words * 20
    OR length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) * 100 > word_chars * 40
    OR length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) * 100 < word_chars * 55) AS kept
FROM b
"""
