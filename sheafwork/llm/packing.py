"""Best-fit packing of tokenized documents into sequences of bounded length.

Each task tokenizes its documents and packs them online, the pieces of an Arrow batch from the longest to the shortest: a fixed
number of bins is open, filed in a bitset by their free space. A piece goes to the open bin that it fills best; if none has room a
new bin is opened, and when too many are open the fullest closes.
What is still open at the end of the tasks is packed once more, bins taking the place of pieces, in groups of bounded size. So the
waste of a task's end does not add up over tasks, and no step needs all pieces in one place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafwork.llm.bpe import _byte_letters
from sheafwork.llm.common import prepare, rows_of, texts_of

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 2048
END_ID = 0
#: Bins that a task keeps open, and open bins that are packed again in one group.
OPEN_BINS = 1024
GROUP_BINS = 16_384
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long"


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level file.

    The same vocabulary and pattern in tiktoken's engine are five times as fast; the tests compare both on every code point. A text
    that its pattern engine gives up on goes to the tokenizers library.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.path = path

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except (ValueError, RuntimeError):
            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def _loaded(path: str | None) -> ByteBpe:
    return ByteBpe(path or public_tokenizers.path(TOKENIZER))


class BestFit:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f is set if an open bin has f free
        self.by_free: dict[int, list] = {}
        self.n_open = 0

    def _take(self, free: int):
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return out

    def _put(self, free: int, key) -> None:
        self.by_free.setdefault(free, []).append(key)
        self.bits |= 1 << free
        self.n_open += 1

    def place(self, size: int, new_key) -> tuple:
        """(bin, offset) for an item; ``new_key`` names the bin if one is opened."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            key = self._take(free)
        else:
            free, key = self.capacity, new_key
        if free > size:
            if self.n_open == self.open_bins:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            self._put(free - size, key)
        return key, self.capacity - free

    def still_open(self) -> Iterator[tuple]:
        """(bin, tokens in it) of the open bins, the fullest first."""
        for free in sorted(self.by_free):
            for key in self.by_free[free]:
                yield key, self.capacity - free


def _tokenize_and_pack(path: str | None, capacity: int, open_bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, packer = _loaded(path), BestFit(capacity, open_bins)
    first_id = TaskContext.get().partitionId() << 40
    opened = 0
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
    names = [x.split()[0] for x in _PIECES.split(", ")]
    for doc_ids, raws in rows_of(batches):
        pieces = []
        for doc_id, raw in zip(doc_ids, raws, strict=True):
            ids = np.append(encoder.encode((raw or b"").decode("utf-8", "replace")), np.uint32(END_ID)).astype("<u4")
            first_stop = (len(ids) - 1) % capacity + 1  # a first piece may be shorter, all others are full
            for piece, stop in enumerate(range(first_stop, len(ids) + 1, capacity)):
                start = max(0, stop - capacity) if piece else 0
                pieces.append((stop - start, doc_id, piece, start, zlib.crc32(ids[start:stop].tobytes())))
        rows = []
        for size, doc_id, piece, start, crc in sorted(pieces, key=lambda x: -x[0]):
            key, offset = packer.place(size, first_id + opened)
            opened += key == first_id + opened
            rows.append((doc_id, piece, start, size, crc, key, offset, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    left = [(None, None, None, None, None, key, None, used) for key, used in packer.still_open()]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left, strict=True), types, strict=True)], names)


def _repack(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins = sorted(((used, key) for b in batches for key, used in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), reverse=True)
    packer = BestFit(capacity, max(1, len(bins)))
    moved = [(key, *packer.place(used, key)) for used, key in bins]
    if moved:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*moved, strict=True)], ["bin", "into", "shift"])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_bins: int = GROUP_BINS
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0. One of over ``capacity`` ids is cut so that its first piece may be shorter and all others
    are full. A null text counts as empty (one id). Repeated rows are packed each for itself; a null doc_id stays null; an empty
    table gives an empty result; other columns are ignored. ``tokenizer_path`` must be readable on the executors (None: the
    installed file). The result of the first step, which holds no text, is checkpointed, so that a lost executor costs no repeat of it.
    """
    prepare(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tokenize_and_pack(tokenizer_path, capacity, open_bins, batches)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _repack(capacity, batches)

    packed = texts_of(docs, id_col, text_col).mapInArrow(first, _PIECES).checkpoint()
    left = packed.where("used IS NOT NULL").select("sequence_id", "used")
    groups = max(1, -(-left.count() // group_bins))
    moved = left.repartition(groups, "sequence_id").mapInArrow(second, "bin long, into long, shift long").checkpoint()
    pieces = packed.where("used IS NULL")
    joined = pieces.join(moved, pieces["sequence_id"] == moved["bin"], "left")
    sequence, offset = F.coalesce("into", "sequence_id"), F.col("offset") + F.coalesce("shift", F.lit(0))
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
