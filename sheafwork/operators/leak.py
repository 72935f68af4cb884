"""Whether published text still names someone of the roster: exact and fuzzy joins of tokens.

``output_words(file_id, page_idx, text)`` and ``roster(sid, last_name, first_name)``. A finding is a row (file_id, page_idx, sid, token,
exact). Fuzzy findings keep their multiplicity: a page token that resembles two names of an entry counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import fuzzy
from sheafwork.functions import text as X

#: Least lengths for exact and fuzzy comparison, and the least ratio of a fuzzy one.
LEAST_EXACT = 3
LEAST_FUZZY = 5
LEAST_RATIO = 80.0


def roster_tokens(roster: DataFrame) -> DataFrame:
    """(sid, token) of the names, each once an entry."""
    name = F.concat_ws(" ", "first_name", "last_name")
    return roster.select("sid", F.explode(X.tokens(name)).alias("token")).where(F.length("token") >= LEAST_EXACT)


def page_tokens(output_words: DataFrame) -> DataFrame:
    """(file_id, page_idx, token), each once a page."""
    return output_words.select("file_id", "page_idx", F.explode(X.tokens("text")).alias("token")).distinct()


def exact_findings(pages: DataFrame, names: DataFrame) -> DataFrame:
    return pages.join(names, "token").select("file_id", "page_idx", "sid", "token", F.lit(True).alias("exact"))


#: Letters from rare to frequent. Any order gives the same pairs; this one lets few tokens meet.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate'"
#: Words meet on two letters up to this length of the longer one, beyond it on one: the pairs of a long prefix would be too many.
_PAIRED_CHARS = 24


def _letters(token: str) -> Column:
    """A token's letters as structs (nth, place), in an order that is the same for all tokens; the second a has nth -2."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    count = lambda c, i: F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c))
    places = F.split(F.lit(_RARE_FIRST), "")
    return F.sort_array(F.transform(letters, lambda c, i: F.struct((-count(c, i)).alias("nth"), F.array_position(places, c).cast("int").alias("place"))))


def _signed(words: DataFrame) -> DataFrame:
    """(word, elements, bits, beyond): letters as numbers in their order, the first two of each kind as bits, and the count of the rest.

    Two words share at most the bits of both and the lesser count of the rest. Neither is null by type, so that no join asks the scan
    whether they are.
    """
    rows = words.withColumn("letters", _letters("word"))
    early = lambda x: (x["nth"] >= -2) & (x["place"] > 0)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x["place"] * 2 + x["nth"])
    bits = F.aggregate(F.filter("letters", early), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    elements = F.transform("letters", lambda x: x["nth"] * 32 + x["place"])
    beyond, never_null = F.size(F.filter("letters", lambda x: ~early(x))), lambda x: F.coalesce(x, F.lit(0))
    return rows.select("word", elements.alias("elements"), never_null(bits).alias("bits"), never_null(beyond).alias("beyond"))


def _keyed(words: DataFrame, own: str) -> DataFrame:
    """(word, bits, beyond, key): a key for each length of a partner and each one or two of the word's first letters.

    Words of m and n letters with a ratio of 80 share t = 2 (m + n) / 5 letters or more, counted as multisets. Of letters in a fixed
    order the first m - t + k of one and n - t + k of the other must then have k in common, for any k up to t. Equal keys of different
    letters are harmless: candidates are compared. Lengths are taken of the text, as the optimizer moves conditions on them to the scan.
    """
    other = "n" if own == "m" else "m"
    rows = _signed(words).withColumn(own, F.length("word"))
    rows = rows.withColumn(other, F.explode(F.sequence(F.ceil(F.col(own) / 1.5).cast("int"), F.floor(F.col(own) * 1.5).cast("int"))))
    needed = F.ceil((F.col("m") + F.col("n")) * 2 / 5).cast("int")
    rows = rows.withColumn("needed", needed).where(F.col("needed") <= F.least("m", "n"))
    first = lambda k: F.slice("elements", F.lit(1), F.col(own) - F.col("needed") + k)
    two = F.transform(first(2), lambda x, i: F.transform(F.slice("elements", i + 2, F.greatest(F.col(own) - F.col("needed") + 1 - i, F.lit(0))), lambda y: F.xxhash64("m", "n", x, y)))
    one = F.transform(first(1), lambda x: F.xxhash64("m", "n", x))
    keys = F.when((F.greatest("m", "n") <= _PAIRED_CHARS) & (F.col("needed") >= 2), F.flatten(two)).otherwise(one)
    return rows.select("word", "bits", "beyond", F.explode(keys).alias("key"))


def _spread(words: DataFrame, name: str) -> DataFrame:
    """(word) over all tasks of a shuffle: a word is few bytes and much work, and adaptive plans join partitions by their bytes.

    The hash keeps the optimizer from taking this for the shuffle that made the words distinct.
    """
    return words.select(F.col(name).alias("word")).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("word"))


def fuzzy_pairs(page_words: DataFrame, name_words: DataFrame) -> DataFrame:
    """(token, name) of distinct tokens with a ratio of at least LEAST_RATIO.

    Candidates meet in an equality join on both lengths and one or two letters of their prefixes, which loses no pair. Those with enough
    letters in common, whatever their order, are compared.
    """
    tokens = _keyed(_spread(page_words, "token"), "m").withColumnsRenamed({c: f"token_{c}" for c in ("bits", "beyond")} | {"word": "token"})
    names = _keyed(_spread(name_words, "name"), "n").withColumnsRenamed({c: f"name_{c}" for c in ("bits", "beyond")} | {"word": "name"})
    shared = F.bit_count(F.col("token_bits").bitwiseAND(F.col("name_bits"))) + F.least("token_beyond", "name_beyond")
    enough = shared * 5 >= (F.length("token") + F.length("name")) * 2
    met = tokens.join(names, "key").where(enough)
    return met.select("token", "name").distinct().where(fuzzy.ratio("token", "name") >= LEAST_RATIO)


def similar_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """(token, sid): page tokens that resemble a name of an entry and are none of its names; a row for each name that they resemble.

    Distinct tokens are compared once for all pages. Whether a token is an exact hit of an entry depends on the two alone, not on the
    page, so those are taken out here, before any page is looked at.
    """
    long_names = names.where(F.length("token") >= LEAST_FUZZY)
    like = fuzzy_pairs(pages.where(F.length("token") >= LEAST_FUZZY).select("token").distinct(), long_names.select(F.col("token").alias("name")).distinct())
    entries = like.join(long_names.select("sid", F.col("token").alias("name")), "name").select("token", "sid")
    return entries.join(names.select("token", "sid"), ["token", "sid"], "left_anti")


def fuzzy_findings(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Findings of tokens that are no exact hit of the same entry on their page."""
    return pages.join(similar_names(pages, names), "token").select("file_id", "page_idx", "sid", "token", F.lit(False).alias("exact"))


def leak_findings(output_words: DataFrame, roster: DataFrame) -> DataFrame:
    """Exact and fuzzy findings; nothing found is the wanted result.

    The texts are read twice: for their distinct tokens, and to find the tokens of either kind in one join.
    """
    pages, names = page_tokens(output_words), roster_tokens(roster)
    wanted = names.select("token", "sid", F.lit(True).alias("exact")).unionByName(similar_names(pages, names).withColumn("exact", F.lit(False)))
    return pages.join(wanted, "token").select("file_id", "page_idx", "sid", "token", "exact")


def leak_report(output_words: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per file: findings and whether it is free of them."""
    found = leak_findings(output_words, roster).groupBy("file_id").agg(F.count("*").alias("n_findings"), F.count_if("exact").alias("n_exact"))
    files = output_words.select("file_id").distinct().join(found, "file_id", "left").na.fill(0, ["n_findings", "n_exact"])
    return files.withColumn("ok", F.col("n_findings") == 0)
