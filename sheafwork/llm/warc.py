"""WARC archives: written by Spark's text sink, read back in byte ranges through verified record boundaries.

Writing. A record is one row of text whose line separator is the record separator, so the part files of the sink are archives and any
store that Spark can write to will do. A payload that equals an earlier one (by SHA-1) becomes a revisit record without a block. The
files are plain, so that any range of them can be read by itself.

Reading. A scan splits each file, in ranges of bounded size, at the bytes that open a record. A payload may hold these bytes too, so
they prove nothing. Each task reports every place where a record could start, with the place its successor would start at by its
length. Only what can be reached from the start of the file is a record. A task follows the links inside a block of its range; pointer
jumping joins the blocks' exits, doubling the reach in each round, so the rounds grow with the logarithm of the number of blocks; at
the end each block keeps what its entries reach. A task holds the candidates of one block and one stretch between two openings.

A payload's digest is taken while its range is scanned, also across stretches. What a range cannot tell, as the record goes on beyond
it or the range began amid a payload, is gathered from its stretches in a second scan, for these records alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import delete_folder, prepare, shared_folder

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"
#: Bytes of the blocks that links are followed in.
BLOCK_BYTES = 2 << 20
#: Parts that a group of equal payloads is dealt into when its rows look for their response.
SALTS = 16
_LINKS = "file string, split long, block long, at long, next long, leaves long, open boolean, begin long, page_id long, kind string, refers_to long, bytes long, digest string, sha string, total long"
_BASE32_OF_DIGITS = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_of_hex(digits: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits, five of which make four."""
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), *_BASE32_OF_DIGITS)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record for each row of pages, in files under ``folder``.

    Of rows with equal payloads (null counts as empty), those with the smallest id are response records; the others are revisits of
    it, which state the payload's length. The choice is made on ids and digests alone: only groups of two or more are kept, written,
    and read again, so that their size decides whether they are broadcast or joined by a shuffle, for which a group is dealt into
    SALTS parts.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    narrow = rows.select("id", "sha1").checkpoint()
    least = narrow.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL")
    groups = f"{folder}-copies"
    least.select("sha1", "first").write.parquet(groups)
    copies = spark.read.schema("sha1 string, first long").parquet(groups).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(copies, ["sha1", "salt"]).where("id <> first OR id IS NULL").select("sha1", "id", "first").distinct()
    revisits.write.parquet(f"{groups}-ids")
    marked = spark.read.schema("sha1 string, id long, first long").parquet(f"{groups}-ids").withColumnRenamed("sha1", "s").withColumnRenamed("id", "i")
    rows = rows.join(marked, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha1") == F.col("s")), "left")
    is_revisit, size = F.col("first").isNotNull(), F.octet_length("html").cast("string")
    again = F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\nWARC-Refers-To-Payload-Length: "), size)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20]+", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_of_hex(F.col("sha1")),
        F.when(is_revisit, again).otherwise(""),
        F.lit("\r\nContent-Length: "),
        F.when(is_revisit, "0").otherwise(size),
        F.lit("\r\n\r\n"),
    )
    record = F.concat(head, F.when(is_revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", _END.decode()).option("compression", "none").text(folder)
    delete_folder(spark, groups)
    delete_folder(spark, f"{groups}-ids")


_FIELD = {
    name: re.compile(rb"^" + pattern + rb"\r?$", re.M | re.I)
    for name, pattern in {
        "kind": rb"WARC-Type: *(\w+)",
        "page_id": rb"WARC-Record-ID: *<urn:page:(-?\d{1,19})>",
        "refers_to": rb"WARC-Refers-To: *<urn:page:(-?\d{1,19})>",
        "full": rb"WARC-Refers-To-Payload-Length: *(\d{1,18})",
        "digest": rb"WARC-Payload-Digest: *sha1:(\w+)",
        "length": rb"Content-Length: *(\d{1,18})",
    }.items()
}


def header(stretch: bytes) -> dict | None:
    """The fields of the record header that a stretch after MAGIC begins with, and ``begin``, the place of its payload; None without."""
    stop = stretch.find(_END)
    if stop < 0:
        return None
    head = stretch[: stop + 2]
    found = {name: m[1] for name, pattern in _FIELD.items() if (m := pattern.search(head))}
    return found | {"begin": stop + 4} if "length" in found and "kind" in found else None


class _Range:
    """The stretches of one range of a file, in their order. Places are counted from the first stretch, whose own place is not known."""

    def __init__(self, file: str, split: int, size: int, width: int):
        self.file, self.split, self.size, self.width = file, split, size, width
        self.place = 0  # of the stretch that comes next
        self.rows: list[dict] = []  # candidates of this block
        self.block = 0
        self.now: dict | None = None  # a record that goes on beyond its stretch, whose digest is being taken
        self.hash = None

    def feed(self, stretch: bytes) -> Iterator[dict]:
        """Takes the next stretch; yields the rows of a block that is complete."""
        at = self.place - len(MAGIC)  # of the bytes that open the stretch
        end = self.place + len(stretch)
        opening = self.split > 0 or self.place > 0
        self.place = end + len(MAGIC)
        if self.now is not None:
            now = self.now
            self.hash.update((MAGIC + stretch)[: now["next"] - len(_END) - at])
            if end >= now["next"] - len(_END):
                if end == now["next"] and stretch.endswith(_END):
                    now["sha"] = base64.b32encode(self.hash.digest()).decode()
                else:
                    now["next"] = -1  # it does not end where a record may
                self.now = None
        block = max(0, at) // self.width
        if block != self.block:
            yield from self.flush()
            self.block = block
        found = header(stretch) if opening else None
        if found is None:
            return
        size, begin = int(found["length"]), found["begin"]
        step = self.place - len(MAGIC) - len(stretch) + begin + size + len(_END)
        if step < end or step == end and not stretch.endswith(_END):
            return
        number = {k: int(found[k]) if k in found else None for k in ("page_id", "refers_to")}
        row = {"at": at, "next": step, "open": step > end, "begin": at + len(MAGIC) + begin, "kind": found["kind"].decode(), "digest": found.get("digest", b"").decode(), "sha": None, **number}
        row["bytes"] = int(found["full"]) if row["kind"] == "revisit" and "full" in found else size
        if not row["open"]:
            row["sha"] = payload_digest(stretch[begin : begin + size])
        elif self.now is None:
            self.now, self.hash = row, hashlib.sha1(stretch[begin:])
        self.rows.append(row)

    def flush(self) -> Iterator[dict]:
        """The rows so far, with the first place outside the block that the links of each lead to. A record whose digest is still being
        taken is held back."""
        leaves: dict[int, int] = {}
        for row in reversed(self.rows):
            step = row["next"]
            inside = not row["open"] and max(0, step) // self.width == self.block
            leaves[row["at"]] = leaves.get(step, -1 if step < self.place - len(MAGIC) else step) if inside else step
        held = [row for row in self.rows if row is self.now]
        for row in self.rows:
            if row is not self.now and row["next"] >= 0:
                first = self.split + max(0, row["at"]) // self.width * self.width
                yield row | {"leaves": leaves[row["at"]], "file": self.file, "split": self.split, "block": first, "total": None}
        self.rows = held

    def close(self) -> Iterator[dict]:
        self.now = None
        yield from self.flush()
        yield {"file": self.file, "split": self.split, "bytes": self.size, "total": self.place}


def candidates(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _LINKS for the stretches (file, split, stretch, size) of a scan, and for each range one with the bytes it holds (total)
    and those of its file (bytes)."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in _LINKS.split(", "))]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kind) for name, kind in fields], [name for name, _ in fields])

    here: _Range | None = None
    for batch in batches:
        for k in range(batch.num_rows):
            file, split = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if here is None or (here.file, here.split) != (file, split):
                if here is not None:
                    yield batch_of(list(here.close()))
                here = _Range(file, split, batch.column(3)[k].as_py(), width)
            rows = list(here.feed(batch.column(2)[k].as_py()))
            if rows:
                yield batch_of(rows)
    if here is not None:
        yield batch_of(list(here.close()))


def _reached(table: pa.Table) -> pa.Table:
    """Of a block's candidates, those on the way from an entry."""
    at, step, entry = (table.column(c).to_pylist() for c in ("at", "next", "entry"))
    links = {a: (n, k) for k, (a, n) in enumerate(zip(at, step, strict=True))}
    keep = set()
    for a, e in zip(at, entry, strict=True):
        while e and a in links and links[a][1] not in keep:
            keep.add(links[a][1])
            a = links[a][0]
    return table.take(pa.array(sorted(keep), pa.int64())).drop_columns(["entry"])


def _stretches(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, stretch, size): what stands between two openings of records, in the order of each range of a file."""
    scan = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(folder)
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("stretch"), F.col("_metadata.file_size").alias("size"))


def _gathered(spark: SparkSession, folder: str, records: DataFrame, before: DataFrame, block_bytes: int) -> DataFrame:
    """(file, at, sha) of the records (file, at, begin, stop), from all stretches that hold a part of their payload."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = None, 0
        for batch in batches:
            places = []
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                here, place = own, (place if own == here else 0)
                places.append(place)
                place += len(batch.column(2)[k].as_py()) + len(MAGIC)
            yield batch.append_column("place", pa.array(places, pa.int64()))

    def digest(table: pa.Table) -> pa.Table:
        begin, stop = table.column("begin")[0].as_py(), table.column("stop")[0].as_py()
        out, parts = hashlib.sha1(), sorted(zip(table.column("pos").to_pylist(), range(table.num_rows), strict=True))
        for pos, k in parts:
            part = MAGIC + table.column("stretch")[k].as_py()
            out.update(part[max(0, begin - pos + len(MAGIC)) : max(0, stop - pos + len(MAGIC))])
        return pa.table({"file": table.column("file")[:1], "at": table.column("at")[:1], "sha": [base64.b32encode(out.digest()).decode()]})

    width = F.lit(block_bytes)
    stretches = _stretches(spark, folder).drop("size").mapInArrow(placed, "file string, split long, stretch binary, place long").join(before, ["file", "split"])
    stretches = stretches.withColumn("pos", F.col("before") + F.col("place")).select("file", "pos", "stretch")
    last = F.col("pos") + F.octet_length("stretch")
    touched = stretches.withColumn("block", F.explode(F.sequence(F.floor((F.col("pos") - len(MAGIC)) / width), F.floor(last / width))))
    wanted = records.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("stop") / width))))
    met = touched.join(wanted, ["file", "block"]).where((F.col("pos") - len(MAGIC) < F.col("stop")) & (last > F.col("begin")))
    return met.dropDuplicates(["file", "at", "pos"]).groupBy("file", "at").applyInArrow(digest, "file string, at long, sha string")


def read_archives(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of the archives (``part-*``) in a folder without their payloads: (file, at, page_id, kind, refers_to, bytes, digest),
    those that the chain of each file reaches.

    Raises if a chain ends before its file does, or if a response's digest does not fit its payload.
    """
    prepare(spark)
    found = _stretches(spark, folder).mapInArrow(lambda batches: candidates(block_bytes, batches), _LINKS).checkpoint()
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ranges = found.where("total IS NOT NULL").select("file", "split", "bytes", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    before = ranges.select("file", "split", "before").checkpoint()
    moved = {c: F.when(F.col(c) < 0, F.lit(-1)).otherwise(F.col(c) + F.col("before")) if c == "leaves" else F.col(c) + F.col("before") for c in ("at", "next", "leaves", "begin")}
    links = found.where("total IS NULL").join(before, ["file", "split"]).withColumns(moved).drop("before", "total", "split").checkpoint()
    start = ranges.groupBy("file").agg(F.max("bytes").alias("size")).withColumn("at", F.lit(0).cast("long")).checkpoint()
    hops = links.groupBy("file").agg((F.count_distinct("block") + F.count_if("open")).alias("n")).agg(F.max("n")).first()[0] or 0
    exits = links.where("leaves >= 0").select("file", "at", F.col("leaves").alias("to"))
    # a place matters if a chain can enter a block there
    doors = exits.select("file", F.col("to").alias("at")).union(start.select("file", "at")).distinct()
    jump = exits.join(doors, ["file", "at"], "left_semi").checkpoint()
    reach = start.select("file", "at")
    for _ in range(int(hops).bit_length()):
        reach = reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct().checkpoint()
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = jump.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")).checkpoint()
    whole = start.join(reach.select("file", F.col("at").alias("size")), ["file", "size"], "left_semi").count()
    if whole != start.count():
        raise ValueError("the records of an archive end before its file does")
    entries = reach.withColumn("entry", F.lit(True))
    marked = links.join(entries, ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    kept = marked.groupBy("file", "block").applyInArrow(_reached, marked.drop("entry").schema).checkpoint()
    responses = kept.where("kind = 'response'")
    if responses.where("sha <> digest").limit(1).count():
        raise ValueError("a payload does not fit its digest")
    table = f"{folder}-open"
    responses.where("sha IS NULL").select("file", "at", "begin", (F.col("next") - len(_END)).alias("stop"), "digest").write.parquet(table)
    untold = spark.read.schema("file string, at long, begin long, stop long, digest string").parquet(table)
    n = untold.count()
    if n:
        sums = _gathered(spark, folder, untold.drop("digest"), before, block_bytes)
        if untold.join(sums, ["file", "at"]).where("sha = digest").count() != n:
            raise ValueError("a payload does not fit its digest")
    delete_folder(spark, table)
    return kept.select("file", "at", "page_id", "kind", "refers_to", "bytes", "digest")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as archives, reads them back, and returns one row per page.

    Columns: page_id, payload_bytes, payload_digest (base 32 of SHA-1; both of the full payload), record_type and refers_to. A null
    payload counts as empty. A null page_id stays null; such a row is a response only if no copy of its payload has an id. Rows that
    repeat the smallest id of their payload are responses too. An empty table gives an empty result; other columns are ignored. A
    payload may be of any length that a string column holds. The archives are removed once their records have been read.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, id_col, url_col, payload_col)
    records = read_archives(spark, folder)
    delete_folder(spark, folder)
    return records.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


#: DuckDB has SHA-1 in hexadecimal digits only; base 32 is made from groups of five digits.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, (5 * (k // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM b
"""
