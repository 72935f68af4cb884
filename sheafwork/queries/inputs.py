"""Tables that the registered queries run on, derived from all rows of the driver's tables by SQL that Spark and DuckDB both read.

Defects (unreadable footers, swapped pages, misread dates, malformed numbers) are planted by values, never by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def first_name(k: str) -> str:
    return f"translate(lpad(CAST({k} * 37 % 9973 AS STRING), 4, '0'), '0123456789', 'aeioubcdfg')"


def last_name(k: str) -> str:
    return f"translate(lpad(CAST({k} * 101 % 99991 AS STRING), 5, '0'), '0123456789', 'rstlnmaeio')"


_MONTHS = "January February March April May June July August September October November December".split()
_FULL = "CASE month(o_orderdate) " + " ".join(f"WHEN {k + 1} THEN '{m}'" for k, m in enumerate(_MONTHS)) + " END"
_SHORT = "CASE month(o_orderdate) " + " ".join(f"WHEN {k + 1} THEN '{m[:3]}'" for k, m in enumerate(_MONTHS)) + " END"
_M, _D, _Y = (f"CAST({f}(o_orderdate) AS STRING)" for f in ("month", "day", "year"))

PAGE_STREAM = """
SELECT concat('s', CAST(CAST(floor(conv_id / 6) AS INT) AS STRING)) AS file_id,
  CAST(row_number() OVER (PARTITION BY CAST(floor(conv_id / 6) AS INT) ORDER BY conv_id, CASE WHEN conv_id % 7 = 2 AND turn <= 1 THEN 1 - turn ELSE turn END) - 1 AS INT) AS page_idx,
  (turn = 0 AND conv_id % 11 <> 3) AS is_header,
  CASE WHEN (conv_id * 5 + turn) % 13 = 4 THEN NULL ELSE CAST(turn + 1 AS INT) END AS page_num,
  CASE WHEN (conv_id * 5 + turn) % 13 = 4 THEN NULL
    ELSE CAST(max(turn) OVER (PARTITION BY conv_id) + 1 + CASE WHEN (conv_id + turn) % 29 = 7 THEN 1 ELSE 0 END AS INT) END AS page_total,
  ((conv_id * 5 + turn) % 13 <> 4) AS readable,
  CASE WHEN (conv_id + turn) % 17 = 5 THEN NULL ELSE concat('TYPE_', CAST(conv_id % 3 AS STRING)) END AS worksheet_type
FROM conversations
"""

DATES = f"""
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN concat({_M}, '/', {_D}, '/', {_Y}) WHEN 1 THEN concat({_M}, '-', {_D}, '-', substr({_Y}, 3, 2))
  WHEN 2 THEN concat({_FULL}, ' ', {_D}, ', ', {_Y}) WHEN 3 THEN concat({_SHORT}, '. ', {_D}, ' ', {_Y})
  WHEN 4 THEN concat('1', {_M}, '/45/', {_Y}) WHEN 5 THEN concat('  0', {_M}, '/', {_D}, '/', {_Y}, ' ')
  WHEN 6 THEN concat({_FULL}, ' ', {_D}) ELSE NULL END AS date_text
FROM orders
"""

_DATED = """
SELECT concat('c', CAST(o_custkey AS STRING)) AS file_id, CAST(row_number() OVER w AS INT) AS ord, concat('c', CAST(o_custkey AS STRING), '_o', CAST(o_orderkey AS STRING)) AS tag,
  {text} AS date_text, CAST(2 * row_number() OVER w - 2 AS INT) AS first_page, CAST(2 * row_number() OVER w - 1 AS INT) AS last_page
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""
DATED = _DATED.format(text=f"CASE WHEN o_orderkey % 9 = 4 THEN '' WHEN o_orderkey % 7 = 3 THEN '2/9/2031' ELSE concat('1/5/', {_Y}) END")
DATED_MONTHS = _DATED.format(text=f"CASE WHEN o_orderkey % 9 = 4 THEN '' WHEN o_orderkey % 3 = 0 THEN concat({_M}, '/1/2024') ELSE concat(CAST(1 + o_custkey % 12 AS STRING), '/2/2024') END")
BLOCKS = "SELECT CAST(n_nationkey AS STRING) AS block, CAST(n_nationkey % 2 AS INT) AS class_period, CAST(1 + n_nationkey % 11 AS INT) AS month FROM nation"

_BLANK = "c_custkey % 20 = 7"
ROSTER_ROWS = f"""
SELECT concat('n', CAST(c_nationkey AS STRING)) AS file_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS INT) AS row_num,
  CASE WHEN {_BLANK} THEN '' WHEN c_custkey % 97 = 5 THEN '12345'
    ELSE concat(lpad(CAST(c_nationkey AS STRING), 6, '0'), CASE WHEN c_custkey % 31 = 2 THEN '02' ELSE '01' END, lpad(CAST(c_custkey % 100 AS STRING), 2, '0')) END AS sid,
  CASE WHEN {_BLANK} OR c_custkey % 53 = 1 THEN '' ELSE {last_name("c_custkey")} END AS last_name,
  CASE WHEN {_BLANK} THEN '' ELSE {first_name("c_custkey")} END AS first_name
FROM customer
"""
RAW_ROSTER = f"""
SELECT CAST(c_custkey AS INT) AS row_num, CASE WHEN {_BLANK} THEN '' ELSE lpad(CAST(c_custkey % 1201 AS STRING), 10, '0') END AS sid,
  CASE WHEN {_BLANK} THEN '' ELSE concat({last_name("c_custkey")}, CASE c_custkey % 3 WHEN 0 THEN '.,' WHEN 1 THEN '*' ELSE '' END) END AS last_name,
  CASE WHEN {_BLANK} THEN '' ELSE concat(' ', {first_name("c_custkey")}, '!') END AS first_name
FROM customer
"""
HELD_NAMES = f"SELECT concat('n', CAST(c_nationkey AS STRING)) AS file_id, CAST(c_custkey AS INT) AS ord, upper({last_name('c_custkey')}) AS last_name, {first_name('c_custkey')} AS first_name FROM customer WHERE c_mktsegment = 'BUILDING'"

_CLASS = "concat('k', CAST({k} % 25 AS STRING))"
ROSTER = f"SELECT {_CLASS.format(k='s_suppkey')} AS file_id, CAST(s_suppkey AS INT) AS ord, lpad(CAST(s_suppkey AS STRING), 10, '0') AS sid, {last_name('s_suppkey')} AS last_name, {first_name('s_suppkey')} AS first_name FROM supplier WHERE s_acctbal >= 0"
HELD = f"SELECT {_CLASS.format(k='s_suppkey')} AS file_id, CAST(s_suppkey AS INT) AS ord, {last_name('s_suppkey')} AS last_name, {first_name('s_suppkey')} AS first_name FROM supplier WHERE s_acctbal < 0"
PROBES = f"""
SELECT {_CLASS.format(k="t")} AS file_id, concat('c', CAST(c_custkey AS STRING)) AS tag, CAST(c_custkey AS INT) AS ord, c_mktsegment AS round,
  CASE c_custkey % 5 WHEN 0 THEN concat({first_name("t")}, ' ', {last_name("t")}) WHEN 1 THEN concat(substr({first_name("t")}, 1, 2), ' ', substr({first_name("t")}, 4), ' ', {last_name("t")})
    WHEN 2 THEN concat(upper({last_name("t")}), '   ', {first_name("t")}) WHEN 3 THEN 'x 8' ELSE concat({first_name("t")}, ' ', substr({last_name("t")}, 1, 3)) END AS name_text
FROM (SELECT c_custkey, c_mktsegment, c_custkey % (SELECT count(*) FROM supplier) AS t FROM customer)
"""

PAGES = "SELECT 'f' AS file_id, CAST(o_orderkey AS INT) AS page_idx, CAST(612 AS DOUBLE) AS width, CAST(CASE WHEN o_orderkey % 40 = 9 THEN 612 ELSE 792 END AS DOUBLE) AS height, true AS has_text FROM orders"
_WORD_TEXT = f"""CASE l_linenumber WHEN 1 THEN 'Name:' WHEN 2 THEN 'Teacher:' WHEN 3 THEN 'Group'
  WHEN 4 THEN concat('Page ', CAST(1 + l_partkey % 3 AS STRING), ' of 2') WHEN 5 THEN concat('Type', CAST(l_suppkey % 5 AS STRING), '+B (0', CAST(1 + l_partkey % 9 AS STRING), '/2024)')
  WHEN 6 THEN {last_name("l_partkey")} ELSE '10/03/2025' END"""
WORDS = f"""
SELECT file_id, page_idx, word_seq, text, x0, x0 + 6.0E0 * length(text) AS x1, top, top + 12 AS bottom FROM (
  SELECT 'f' AS file_id, CAST(l_orderkey AS INT) AS page_idx,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS word_seq, {_WORD_TEXT} AS text,
    CAST(CASE l_linenumber WHEN 4 THEN 513 WHEN 5 THEN 29 WHEN 6 THEN 120 + l_partkey % 60 WHEN 7 THEN 420 + l_suppkey % 60 ELSE 45 END AS DOUBLE) AS x0,
    CAST(CASE l_linenumber WHEN 1 THEN 68 + l_partkey % 3 WHEN 2 THEN 87 + l_partkey % 3 WHEN 3 THEN 111 + l_partkey % 3 WHEN 4 THEN 747 WHEN 5 THEN 736 WHEN 6 THEN 45 + l_partkey % 110 ELSE 60 + l_suppkey % 40 END AS DOUBLE) AS top
  FROM lineitem)
"""
_B = "CAST({} AS DOUBLE)"
#: Drawn boxes: two of each page, corners in any order.
BOXES = f"""
SELECT 'f' AS file_id, CAST(o_orderkey AS INT) AS page_idx, {_B.format("38 + o_custkey % 90")} AS l1, {_B.format("58 + o_orderkey % 20")} AS t1, {_B.format("400 - o_custkey % 200")} AS r1, {_B.format("148 - o_orderkey % 60")} AS b1,
  {_B.format("574 - o_custkey % 70")} AS l2, {_B.format("760 - o_orderkey % 30")} AS t2, {_B.format("505 + o_custkey % 20")} AS r2, {_B.format("740 + o_orderkey % 15")} AS b2
FROM orders
"""

DETECTIONS = """
SELECT concat('b', p_brand) AS file_id, CAST(p_partkey AS INT) AS page_idx, CAST(90 * CASE WHEN p_size % 6 > 3 THEN 0 ELSE p_size % 4 END AS INT) AS angle,
  CAST(p_size AS DOUBLE) / 50 AS score, CASE WHEN p_size % 7 = 1 THEN NULL ELSE CAST(p_partkey % 9 - 4 AS DOUBLE) END AS skew
FROM part
"""
ORIENTATION_OVERRIDES = "SELECT concat('b', p_brand) AS file_id, CAST(p_partkey AS INT) AS page_idx, CAST(90 * (p_size % 4) AS INT) AS angle FROM part WHERE p_type = 'ECONOMY'"

# Packets of a run: orders. The five priorities and three statuses give the states; customers with a balance are on the roster.
_SID = "concat(lpad(CAST(o_custkey % 7 AS STRING), 6, '0'), '0', CAST(1 + o_custkey % 2 AS STRING), lpad(CAST(o_custkey % 100 AS STRING), 2, '0'))"
RUN_PACKETS = """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CAST(o_orderkey AS INT) AS ord, concat('T', CAST(o_orderkey % 2 AS STRING)) AS worksheet_type,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'total_mismatch' ELSE 'no_header' END END AS issue, o_totalprice AS price, o_custkey AS cust FROM orders
"""
DECISIONS = f"SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE {_SID} END AS sid FROM orders WHERE o_orderpriority <> '5-LOW'"
RUN_ROSTER = f"SELECT DISTINCT {_SID} AS sid FROM (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal >= 0)"
#: Earlier outputs: two thirds under paths of their own, a third under natural ones, numbered where several share one.
LEDGER = f"""
SELECT tag, sid, CASE WHEN k % 3 > 0 THEN concat('old/', CAST(c AS STRING), '/', CAST(k AS STRING), '.pdf')
  ELSE concat(base, CASE WHEN n > 1 THEN concat('_', CAST(n AS STRING)) ELSE '' END, '.pdf') END AS path
FROM (SELECT tag, sid, k, c, base, row_number() OVER (PARTITION BY base, k % 3 ORDER BY k DESC) AS n FROM (
  SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, {_SID} AS sid, o_orderkey AS k, o_custkey AS c,
    concat(substr({_SID}, 1, 6), '/T', CAST(o_orderkey % 2 AS STRING), '/', substr({_SID}, 7, 2), '/', {_SID}) AS base FROM orders WHERE o_totalprice < 150000) AS inner_rows) AS numbered
"""
HELD_TAGS = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag FROM orders WHERE o_totalprice > 400000"
BORDERLESS_TAGS = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag FROM orders WHERE o_totalprice BETWEEN 200000 AND 250000"
LEAK_TAGS = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag FROM orders WHERE o_totalprice BETWEEN 240000 AND 270000"
SEEN_TAGS = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag FROM orders WHERE o_totalprice BETWEEN 230000 AND 300000"
CONFIRMED_TAGS = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag FROM orders WHERE o_orderpriority = '1-URGENT'"
ROUND_OF_TAG = "SELECT concat('o', CAST(o_orderkey AS STRING)) AS tag, concat(CAST(year(o_orderdate) AS STRING), '-01') AS label FROM orders WHERE o_orderpriority <> '2-HIGH'"

#: Published words, one text a page.
OUTPUT_WORDS = "SELECT concat('v', CAST(conv_id AS STRING)) AS file_id, CAST(turn AS INT) AS page_idx, text FROM conversations"
DOCUMENT_WORDS = "SELECT concat('d', CAST(doc_id AS STRING)) AS file_id, CAST(0 AS INT) AS page_idx, text FROM documents"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one of the statements above in Spark."""
    used = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if f"FROM {name}" in sql.replace("\n", " ")}
    for name in used:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **used)
