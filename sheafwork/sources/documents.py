"""Scanned documents at the edge of the relational core: file scans, decoding, recognition results, and a plain PDF writer and reader.

Decoders and recognition engines are passed in as functions that make one; each is made once per stream of batches of a worker.
The reader here knows PDFs of the kind that the writer makes: one content stream a page, hidden text word by word over an image.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import text as X
from sheafwork.functions.geometry import HELVETICA
from sheafwork.session import bound_batches, join_heavy, ship_package

WORD = "struct<text:string,x0:double,x1:double,top:double,bottom:double>"
_PAGES = f"file_id string, path string, content_sha string, page_idx int, width double, height double, has_text boolean, words array<{WORD}>, error string"
#: Words and pages from which decoded pages are handed on.
BATCH_WORDS = 16_384
BATCH_PAGES = 2_048
#: Bytes of written files from which they are handed on.
BATCH_BYTES = 8 << 20

#: A decoder maps a file's bytes to pages: (width, height, [(text, x0, x1, top, bottom), ...]).
Decoder = Callable[[bytes], list[tuple[float, float, list[tuple[str, float, float, float, float]]]]]


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf", must_exist: bool = False) -> DataFrame:
    """(path, length, content, file_id, content_sha) of a tree's files by path, without those below hidden folders.

    With ``must_exist`` an empty tree is an error, as nothing to verify is no success.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    files = files.where(~F.col("path").rlike(r"/\.[^/]*/"))
    if must_exist and not files.select("path").take(1):
        raise ValueError(f"no file {glob} below {folder}")
    return files.select("path", "length", "content", X.file_stem("path").alias("file_id"), content_hash("content").alias("content_sha"))


def content_hash(content: str):
    """SHA-256 of a file's bytes; results are cached by its first 16 digits."""
    return F.sha2(F.col(content), 256)


def decoded_batches(batches: Iterator[pa.RecordBatch], decode: Decoder, repair: Callable[[bytes], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`decode_pages` for batches of (file_id, path, content_sha, content), handed on as soon as BATCH_WORDS or BATCH_PAGES are there."""
    word = pa.struct([("text", pa.string()), *[(c, pa.float64()) for c in ("x0", "x1", "top", "bottom")]])
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(word), pa.string()]
    names = [c.split()[0] for c in _PAGES.split(", ")]
    rows: list[tuple] = []
    ends, words = [0], tuple([] for _ in word)

    def put(row: tuple, found: list, error: str) -> None:
        for column, values in zip(words, zip(*found, strict=True), strict=False):
            column.extend(values)
        ends.append(len(words[0]))
        rows.append((*row, bool(found), error))

    def taken() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(words, word, strict=True)], fields=list(word)))
        arrays = [pa.array(v, t) for v, t in zip((*columns[:7], columns[7]), (*types[:7], types[8]), strict=True)]
        rows.clear()
        ends[1:] = []
        for column in words:
            column.clear()
        return pa.RecordBatch.from_arrays([*arrays[:7], lists, arrays[7]], names=names)

    for batch in batches:
        files, contents = [batch.column(k).to_pylist() for k in range(3)], batch.column(3)
        for k, (file_id, path, sha) in enumerate(zip(*files, strict=True)):
            error, pages = "", []
            try:
                content = contents[k].as_py()
                pages = decode(content)
                if not pages and repair is not None:
                    pages = decode(repair(content))
            except Exception as e:  # a broken file must not end the job
                error = f"{type(e).__name__}: {e}"
            if not pages:
                put((file_id, path, sha, None, None, None), [], error or "no pages")
            for place, (width, height, found) in enumerate(pages):
                put((file_id, path, sha, place, width, height), found, "")
                if len(words[0]) >= BATCH_WORDS or len(rows) >= BATCH_PAGES:
                    yield taken()
    if rows:
        yield taken()


def decode_pages(files: DataFrame, make_decoder: Callable[[], Decoder], repair: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """One row per page with its words; a file that cannot be read gives one row with page_idx null and the error, never none.

    A decoder that finds no page is given the repaired bytes, if there is a way to repair them. A worker holds the words of one file and
    of one batch of pages, however many files its batches of contents have.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded_batches(batches, make_decoder(), repair)

    return files.select("file_id", "path", "content_sha", F.col("content").cast("binary").alias("content")).mapInArrow(run, _PAGES)


def words_of(pages: DataFrame) -> DataFrame:
    """(file_id, page_idx, word_seq, text, x0, x1, top, bottom) of decoded pages."""
    rows = pages.where("page_idx IS NOT NULL").select("file_id", "page_idx", F.posexplode("words").alias("word_seq", "w"))
    return rows.select("file_id", "page_idx", "word_seq", "w.*")


def words_in(words: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The words whose box lies in a region of the page."""
    return words.where((F.col("x0") >= left) & (F.col("x1") <= right) & (F.col("top") >= top) & (F.col("bottom") <= bottom))


def chosen_words(native: DataFrame, recognised: DataFrame, pages: DataFrame) -> DataFrame:
    """The words of a page's own text layer where it has one, else those that were recognised."""
    has = pages.select("file_id", "page_idx", "has_text")
    own = native.join(has.where("has_text"), ["file_id", "page_idx"], "left_semi")
    return own.unionByName(recognised.join(has.where("NOT has_text"), ["file_id", "page_idx"], "left_semi"))


def words_from_recognition(results: DataFrame) -> DataFrame:
    """Words in page points from ``results(file_id, page_idx, dpi, left, top, texts, boxes)``; boxes are (x0, y0, x1, y1) in pixels.

    A region's offset is added, texts are trimmed, and those without a letter or digit are dropped.
    """
    zipped = F.arrays_zip(F.col("texts").alias("text"), F.col("boxes").alias("box"))
    rows = results.select("file_id", "page_idx", "dpi", F.col("left").alias("dx"), F.col("top").alias("dy"), F.posexplode(zipped).alias("word_seq", "w"))
    unit = F.lit(72.0) / F.col("dpi")
    place = lambda k, offset: F.col("w.box")[k] * unit + F.col(offset)
    rows = rows.select("file_id", "page_idx", "word_seq", X.trimmed("w.text").alias("text"), place(0, "dx").alias("x0"), place(2, "dx").alias("x1"), place(1, "dy").alias("top"), place(3, "dy").alias("bottom"))
    return rows.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def recognise(rasters: DataFrame, make_engine: Callable[[], Callable[[np.ndarray], list[tuple[str, tuple[float, float, float, float]]]]]) -> DataFrame:
    """Runs an engine over ``rasters(file_id, page_idx, dpi, left, top, grey, n_rows, n_cols)``."""
    ship_package(rasters.sparkSession)
    bound_batches(rasters.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                found = engine(np.frombuffer(r.grey, np.uint8).reshape(r.n_rows, r.n_cols))
                out.append((r.file_id, r.page_idx, r.dpi, r.left, r.top, [t for t, _ in found], [list(map(float, b)) for _, b in found]))
            yield pd.DataFrame(out, columns=["file_id", "page_idx", "dpi", "left", "top", "texts", "boxes"])

    schema = "file_id string, page_idx int, dpi double, left double, top double, texts array<string>, boxes array<array<double>>"
    return rasters.select("file_id", "page_idx", "dpi", "left", "top", "grey", "n_rows", "n_cols").mapInPandas(run, schema)


# A plain PDF writer and reader


def write_pdf(pages: list[tuple[float, float, np.ndarray | None, list[str]]]) -> bytes:
    """A PDF of (width, height, grey raster or None, text operators) pages; equal pages give equal bytes, identifier included."""
    objects: list[bytes] = [b"", b""]
    kids = []
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects.append(font)
    for width, height, grey, operators in pages:
        image = b""
        draw = ""
        if grey is not None:
            data = zlib.compress(np.ascontiguousarray(grey, np.uint8).tobytes(), 6)
            head = f"<< /Type /XObject /Subtype /Image /Width {grey.shape[1]} /Height {grey.shape[0]} /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length {len(data)} >>"
            objects.append(head.encode() + b"\nstream\n" + data + b"\nendstream")
            image = f" /XObject << /Im0 {len(objects)} 0 R >>".encode()
            draw = f"q {width:.2f} 0 0 {height:.2f} 0 0 cm /Im0 Do Q\n"
        content = zlib.compress((draw + "\n".join(operators)).encode("latin-1", "replace"), 6)
        objects.append(f"<< /Filter /FlateDecode /Length {len(content)} >>".encode() + b"\nstream\n" + content + b"\nendstream")
        resources = b"<< /Font << /F1 3 0 R >>" + image + b" >>"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.2f} {height:.2f}] /Contents {len(objects)} 0 R /Resources ".encode() + resources + b" >>")
        kids.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    name = hashlib.md5(bytes(out)).hexdigest()
    table = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R /ID [<{name}> <{name}>] >>\nstartxref\n{table}\n%%EOF\n".encode()
    return bytes(out)


_OBJECT = re.compile(rb"(\d+) 0 obj\n(.*?)\nendobj\n", re.S)
_WORD = re.compile(r"/F1 ([\d.]+) Tf ([\d.]+) 0 0 1 ([-\d.]+) ([-\d.]+) Tm \(((?:[^\\()]|\\.)*)\) Tj")


def read_pdf(data: bytes) -> list[tuple[float, float, list[tuple[str, float, float, float, float]]]]:
    """The pages of a PDF that :func:`write_pdf` made; none for other bytes."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    kids = re.search(rb"/Kids \[([^\]]*)\]", objects.get(2, b""))
    out = []
    for k in re.findall(rb"(\d+) 0 R", kids[1]) if kids else []:
        page = objects[int(k)]
        width, height = map(float, re.search(rb"/MediaBox \[0 0 ([\d.]+) ([\d.]+)\]", page).groups())
        stream = objects[int(re.search(rb"/Contents (\d+) 0 R", page)[1])].partition(b"\nstream\n")[2].rpartition(b"\nendstream")[0]
        words = []
        for size, scale, x, y, raw in _WORD.findall(zlib.decompress(stream).decode("latin-1")):
            text = re.sub(r"\\(.)", r"\1", raw).strip()
            natural = sum(HELVETICA[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * float(size) / 1000
            top = height - float(y) - 0.8 * float(size)
            words.append((text, float(x), float(x) + natural * float(scale), top, top + float(size)))
        out.append((width, height, words))
    return out


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Puts a file in place by a rename, so that nobody reads a part of it."""
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    out.write(bytearray(content))
    out.close()
    files.delete(target, False)
    files.rename(draft, target)


def delete_file(spark: SparkSession, path: str) -> None:
    """Removes a file or folder if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def publish(operators: DataFrame, pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, content): the PDF of each packet, from text operators (tag, offset, word_seq, operator), pages (tag, offset, width, height)
    and paths (tag, path). Redacted rasters, where there are any, come in ``pages`` as grey, n_rows and n_cols.
    """
    ship_package(pages.sparkSession)
    raster = [F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in (("grey", "binary"), ("n_rows", "int"), ("n_cols", "int"))]
    texts = operators.groupBy("tag", "offset").agg(F.sort_array(F.collect_list(F.struct("word_seq", "operator"))).alias("ops"))
    joined = join_heavy if "grey" in pages.columns else DataFrame.join
    rows = joined(joined(pages.select("tag", "offset", "width", "height", *raster), texts, ["tag", "offset"], "left"), paths.select("tag", "path"), ["tag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return published_batches(batches)

    placed = rows.select("path", "offset", "width", "height", "grey", "n_rows", "n_cols", F.col("ops.operator").alias("ops"))
    return placed.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(run, "path string, content binary")


def published_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) from pages (path, offset, width, height, grey, n_rows, n_cols, ops) in the order of paths and offsets.

    A packet may span batches; a worker holds one packet's pages and the files of one batch.
    """
    path, pages, paths, files, held = None, [], [], [], 0

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])
        paths.clear()
        files.clear()
        return out

    for batch in batches:
        greys = batch.column(4)
        texts, _, widths, heights, n_rows, n_cols, ops = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6, 7))
        for k, this in enumerate(texts):
            if pages and this != path:
                paths.append(path)
                files.append(write_pdf(pages))
                pages, held = [], held + len(files[-1])
                if held >= BATCH_BYTES or len(files) >= BATCH_PAGES:
                    yield taken()
                    held = 0
            path = this
            grey = np.frombuffer(greys[k].as_py(), np.uint8).reshape(n_rows[k], n_cols[k]) if greys[k].is_valid else None
            pages.append((widths[k], heights[k], grey, ops[k] or []))
    if pages:
        paths.append(path)
        files.append(write_pdf(pages))
    if paths:
        yield taken()
