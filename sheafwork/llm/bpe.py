"""Byte-pair encoding by backtracking, and decoding through an offset table.

A greedy longest match is right unless two neighbours would have merged otherwise. An Aho-Corasick automaton gives the longest token
at every place of a word; a token is taken if it is compatible with the one before it, else its longest prefix that is a token is
tried, and if none is left the encoder steps back. Places found to be dead ends are marked, so that each is left once and the work
stays linear. Whether two tokens are compatible is found by undoing their merges along the seam, and kept in a table.

Words that recur are kept in a bounded table, so a text costs one look-up a word. Long texts and words need no special case.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sheafwork.llm.common import Recent, prepare, rows_of, texts_of

TOKENIZER = "word_bpe_49k.json"
#: Size of the table of recent words and entries of the table of token pairs, which change the time only.
TABLE_SIZE = 21_000_000
PAIR_ROWS = 300_000
#: Below this code point the normalizer is plain lower-casing and character classes agree; the tests compare every such character.
PLAIN_BELOW = "ɐ"


class BacktrackEncoder:
    """Encodes sequences of atoms (numbers below ``atoms``) with the merges [(left, right), ...]; merge k makes token atoms + k."""

    def __init__(self, atoms: int, merges: list[tuple[int, int]]):
        self.atoms = atoms
        self.parts = merges
        self.made = {pair: atoms + k for k, pair in enumerate(merges)}
        spelled = [chr(0x100 + a) for a in range(atoms)]
        for left, right in merges:
            spelled.append(spelled[left] + spelled[right])
        self.length = [len(s) for s in spelled]
        if len(set(spelled)) != len(spelled):
            raise ValueError("two merges make the same token")
        # a token that its own text is never merged to cannot occur: an earlier merge across its seam always takes its parts apart
        occurs = [True] * atoms
        for k, (left, right) in enumerate(merges):
            occurs.append(occurs[left] and occurs[right] and self._seam(left, right, atoms + k))
        of = {s: k for k, s in enumerate(spelled) if occurs[k]}
        self.automaton = ahocorasick.Automaton()
        for s, k in of.items():
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        self.shorter = [next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in of), -1) for s in spelled]
        self.compatible: dict[tuple[int, int], bool] = {}

    def _seam(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the seam, of a rank under ``before``, would come before the merges that made left and right."""
        while True:
            made = self.made.get((left, right))
            if made is not None and made < before:
                return False
            # undo the later of the two; at equal rank the one further left was merged first
            undo_left = left > right
            if undo_left and left < self.atoms or not undo_left and right < self.atoms:
                return True
            if undo_left:
                before, left = left, self.parts[left - self.atoms][1]
            else:
                before, right = right + 1, self.parts[right - self.atoms][0]

    def _fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= PAIR_ROWS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._seam(left, right, len(self.length))
        return known

    def encode(self, atoms: list[int]) -> list[int]:
        text = "".join([chr(0x100 + a) for a in atoms])
        longest = [-1] * len(text)
        length = self.length
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token  # ends come in order, so the longest is the last
        alive = bytearray(b"\x01") * (len(text) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if text else -1
        while at < len(text):
            while token >= 0 and not (alive[at + length[token]] and (not out or self._fits(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < len(text) else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]
        return out


def _byte_letters() -> list[str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a file of the kind of ``word_bpe_49k.json``."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        letters = _byte_letters()
        spelled = [*letters, *(c + suffix for c in letters)]
        place = {s: k for k, s in enumerate(spelled)}
        pairs = []
        for k, (left, right) in enumerate(merges):
            pairs.append((place[left], place[right]))
            place[left + right] = len(spelled)
            spelled.append(left + right)
        self.ids = [vocab[s] for s in spelled]
        self.encoder = BacktrackEncoder(2 * len(letters), pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.known: Recent = Recent(TABLE_SIZE)
        # the offset table: token k is blob[offset[k]:offset[k + 1]], each with the space that joins it to the next
        by_id = sorted([(i, s) for s, i in (vocab | self.special).items()])
        if [i for i, _ in by_id] != list(range(len(by_id))):
            raise ValueError("ids of the vocabulary are not consecutive")
        texts = [s.encode() + b" " for _, s in by_id]
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        atoms = [*raw[:-1], 256 + raw[-1]]
        return np.array([self.ids[t] for t in self.encoder.encode(atoms)], dtype="<u4").tobytes()

    def _section(self, text: str) -> list[bytes]:
        if text.isascii() or max(text) < PLAIN_BELOW:
            words = self.words.findall(text.lower())
        else:
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            words = [bytes(self.byte_of[c] for c in letters).decode() for letters, _ in split]
        known = self.known.young
        return [known.get(word) or self._look_up(word) for word in words]

    def _look_up(self, word: str) -> bytes:
        return self.known.get(word) or self.known.put(word, self._word(word))

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers. Special tokens written in a text are found before anything else."""
        out: list[bytes] = []
        for section in self.splits.split(text) if "<|" in text else [text]:
            if section in self.special:
                out.append(np.array([self.special[section]], dtype="<u4").tobytes())
            elif section:
                out += self._section(section)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by spaces, gathered from the offset table in one step."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)].tobytes()[:-1]


@lru_cache(maxsize=2)
def _loaded(path: str | None) -> WordBpe:
    return WordBpe(path or public_tokenizers.path(TOKENIZER))


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens, and the digests of the empty string. Repeated rows give repeated results, an empty table
    an empty one; other columns are ignored. ``tokenizer_path`` must be readable on the executors (None: the installed file).
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer_path)
        for doc_ids, raws in rows_of(batches):
            n, of_ids, of_text = [], [], []
            for raw in raws:
                ids = bpe.encode((raw or b"").decode("utf-8", "replace"))
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
