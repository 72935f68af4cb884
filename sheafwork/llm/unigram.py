"""Unigram pieces over a fixed public vocabulary: token counts by Viterbi, and language scores by the forward algorithm.

Both enumerate the pieces that match a word with an Aho-Corasick automaton and run over the word once. The Viterbi pass carries, for
each place, only the best score and the number of pieces on the best way, with the tie rules of the tokenizers library: ways are
compared in the order of their last piece's start, and only a strictly better score replaces an earlier one; a character that no
single-character piece covers may be an unknown piece, scored ten below the lowest score; neighbouring unknowns count as one piece.
The forward pass sums the probabilities of all segmentations.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import Recent, prepare, rows_of, texts_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Size of the table of recent words (about 300,000 of them), which changes the time only.
TABLE_SIZE = 21_000_000
#: White space as the tokenizers library sees it; Python's split() also takes U+001C to U+001F.
_SPACES = re.compile("[^\t-\r \x85\xa0  -     　]+")
_MORE_SPACES = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> tuple[str, ...]:
    """The pieces of the vocabulary file in its order, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    ids = range(model.get_piece_size())
    return tuple(model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


def zipf_scores(pieces: Iterable[str]) -> list[tuple[str, float]]:
    """Each piece with the logarithm of a Zipf probability of its rank: a fixed rule, nothing is trained."""
    pieces = list(pieces)
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return [(p, -math.log(k + 1) - total) for k, p in enumerate(pieces)]


def _automaton(pieces: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for piece, value in pieces:
        out.add_word(piece, (len(piece), value))
    out.make_automaton()
    return out


def _by_start(automaton: ahocorasick.Automaton, word: str) -> list[list[tuple[int, object]]]:
    """For each place the pieces that start there as (end, value), the shortest first."""
    out: list[list[tuple[int, object]]] = [[] for _ in word]
    for last, (size, value) in automaton.iter(word):
        out[last + 1 - size].append((last + 1, value))
    return out


class UnigramCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, scored: list[tuple[str, float]]):
        self.automaton = _automaton(scored)
        self.unknown = min(score for _, score in scored) - UNKNOWN_PENALTY
        self.known: Recent = Recent(TABLE_SIZE)

    def count_word(self, word: str) -> tuple[float, int]:
        """(best score, pieces) of a word that already has its mark."""
        n = len(word)
        best: list[float | None] = [0.0, *[None] * n]
        pieces = [0] * (n + 1)
        unknown_last = [False] * (n + 1)
        for start, found in enumerate(_by_start(self.automaton, word)):
            here = best[start]
            single = False
            for end, score in found:
                single |= end == start + 1
                total = score + here
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], unknown_last[end] = total, pieces[start] + 1, False
            if not single:
                total = self.unknown + here
                if best[start + 1] is None or total > best[start + 1]:
                    best[start + 1], unknown_last[start + 1] = total, True
                    pieces[start + 1] = pieces[start] + (not unknown_last[start])
        return best[n], pieces[n]

    def count(self, text: str) -> int:
        known = self.known.young
        words = _SPACES.findall(text) if _MORE_SPACES.search(text) else text.split()
        return sum([known.get(word) or self._look_up(word) for word in words])

    def _look_up(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            marked = word if word.startswith(MARK) else MARK + word
            n = self.known.put(word, sum(self.count_word(part)[1] for part in re.findall(f"{MARK}[^{MARK}]*", marked)))
        return n


@lru_cache(maxsize=2)
def _counter(path: str | None) -> UnigramCounter:
    return UnigramCounter(zipf_scores(vocabulary(path)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens of the whole text.

    The tokenizer is a unigram model over the pieces of a public vocabulary with :func:`zipf_scores`; words are split at white space
    and carry a leading mark. A null or empty text has 0 tokens. Repeated rows give repeated results, an empty table an empty one;
    other columns are ignored. ``vocabulary_path`` must be readable on the executors (None: the installed file).
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary_path)
        for ids, raws in rows_of(batches):
            n = [counter.count((raw or b"").decode("utf-8", "replace")) for raw in raws]
            sizes = [len(raw or b"") for raw in raws]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


# Language identification

#: Training documents per language, the smallest by a hash of their id; the bound of the labelled sample.
TRAIN_DOCS = 100
TRAIN_ROUNDS = 3
#: A piece that a language did not show gets this probability, and so does a character that no piece covers.
FLOOR = 1e-7
#: Words of evidence that count in full; beyond them the log-odds are scaled, so that the score tells mixed texts from plain ones.
EVIDENCE_WORDS = 25
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Short words whose log-probabilities a worker keeps, words of a text that are looked up at once, and words scored in one batch. They
#: change the time only, like the letters from which a word is scored by itself: a short word's sums cannot vanish.
TABLE_WORDS = 1 << 19
CHUNK_WORDS = 1 << 16
BATCH_WORDS = 1 << 13
SHORT_WORD = 24
#: Places between two rescalings of running sums. A place is worth FLOOR at least, so sums stay in the range of a double.
STRIDE = 16


def letter_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def _longest(pieces: Iterable[str]) -> int:
    """Characters of the longest piece. Two strides of FLOOR must not vanish, so a vocabulary of longer pieces is refused."""
    out = max(STRIDE, max(map(len, pieces), default=1))
    if FLOOR ** (out + STRIDE) < 1e-290:
        raise ValueError("the vocabulary has a piece of over 25 characters")
    return out


def _leaving(automaton: ahocorasick.Automaton, word: str, first: int, stop: int, reach: int, p: dict[str, float]) -> list[tuple[int, int, float, str | None]]:
    """The arcs (start, end, probability, piece) that leave the places from ``first`` to ``stop``, by their starts.

    A place that no single-character piece leaves has an arc of one character and probability FLOOR.
    """
    out, single = [], set()
    for last, (size, piece) in automaton.iter(word[first : stop + reach - 1]):
        start = first + last + 1 - size
        if start < stop:
            out.append((start, start + size, p.get(piece, FLOOR), piece))
            if size == 1:
                single.add(start)
    out += [(k, k + 1, FLOOR, None) for k in range(first, stop) if k not in single]
    return sorted(out, key=lambda arc: arc[0])


def _expected(automaton: ahocorasick.Automaton, word: str, p: dict[str, float], n: float, into: dict[str, float], reach: int) -> None:
    """Adds n times the expected number of uses of each piece over all segmentations of the word (forward and backward pass).

    The word is walked in blocks of ``reach`` places, the longest piece, whose arcs are made anew in each pass, so its length is not
    bounded. Forward sums are rescaled where a block begins. Backward sums carry the inverse of the same scale, divided by the sum of
    all segmentations: the product of the two at a place is the probability that a segmentation cuts there.
    """
    size = len(word)
    blocks = [(a, min(size, a + reach)) for a in range(0, size, reach)]
    ahead, scale = array("d", bytes(8 * (size + 1))), array("d", [1.0])
    ahead[0] = 1.0
    for first, stop in blocks:
        for start, end, q, _ in _leaving(automaton, word, first, stop, reach, p):
            ahead[end] += ahead[start] * q
        top = max(ahead[stop : stop + reach])
        for k in range(stop, min(size + 1, stop + reach)):
            ahead[k] /= top
        scale.append(top)
    back = array("d", bytes(8 * (size + 1)))
    back[size] = 1 / ahead[size]
    for place in range(len(blocks) - 1, -1, -1):
        first, stop = blocks[place]
        beyond = scale[place + 1]
        for start, end, q, piece in reversed(_leaving(automaton, word, first, stop, reach, p)):
            part = q * back[end] if end < stop else q * back[end] / beyond
            back[start] += part
            if piece is not None:
                into[piece] += n * ahead[start] * part


class LanguageModel:
    """Piece probabilities of each language; ``pieces`` maps a piece to one probability per language."""

    def __init__(self, languages: list[str], pieces: dict[str, tuple[float, ...]], path: str | None = None):
        self.languages, self.pieces, self.path = languages, pieces, path
        self._table = None

    @classmethod
    def train(cls, counts: dict[str, Counter], path: str | None = None, rounds: int = TRAIN_ROUNDS) -> LanguageModel:
        """Expectation maximisation over the words of each language, from the same start for all."""
        vocab = vocabulary(path)
        automaton, reach = _automaton((p, p) for p in vocab), _longest(vocab)
        languages, fitted = sorted(counts), []
        for language in languages:
            p = dict.fromkeys(vocab, 1 / len(vocab))
            for _ in range(rounds):
                uses: dict[str, float] = defaultdict(float)
                for word in sorted(counts[language]):
                    _expected(automaton, MARK + word, p, counts[language][word], uses, reach)
                total = sum(uses.values()) or 1.0
                p = {piece: max(FLOOR, n / total) for piece, n in uses.items()}
            fitted.append(p)
        pieces = {x: tuple(p.get(x, FLOOR) for p in fitted) for x in sorted(set(vocab))}
        return cls(languages, pieces, path)

    @property
    def learned(self) -> bool:
        """Whether any language showed a word."""
        return any(q > FLOOR for p in self.pieces.values() for q in p)

    def _start(self) -> None:
        """What prediction needs: an automaton whose values are (length << 20 | place in the list of pieces), and the table of words."""
        floor = (FLOOR,) * len(self.languages)
        pieces = {p: floor for p in vocabulary(self.path) if len(p) == 1} | self.pieces
        self._reach = _longest(pieces)
        self._automaton = ahocorasick.Automaton()
        for place, piece in enumerate(pieces):
            self._automaton.add_word(piece, len(piece) << 20 | place)
        self._automaton.make_automaton()
        self._chances = [*pieces.values(), floor]
        self._matrix = np.array(self._chances)
        self._rows: dict[str, int] = {}
        self._table = np.empty((TABLE_WORDS, len(self.languages)))

    def _word(self, word: str) -> tuple[float, ...]:
        """Log-probability of a word in each language, summed over all its segmentations, in blocks of STRIDE places.

        A block needs the sums of the places that its longest piece could start at. These are rescaled after each block.
        """
        size, reach, n, floor = len(word), self._reach, len(self.languages), self._chances[-1]
        sums, logs = [[1.0] for _ in range(n)], [0.0] * n
        for first in range(0, size, STRIDE):
            stop = min(size, first + STRIDE)
            origin = max(0, first - reach + 1)  # places and sums below are counted from here
            arcs, single = [], set()
            for last, value in self._automaton.iter(word[origin:stop]):
                if last >= first - origin:
                    arcs.append((last + 1 - (value >> 20), last + 1, self._chances[value & 0xFFFFF]))
                    if value >> 20 == 1:
                        single.add(last)
            arcs += [(k, k + 1, floor) for k in range(first - origin, stop - origin) if k not in single]
            arcs.sort(key=lambda arc: arc[1])
            for i in range(n):  # arcs come by their ends, so a place is complete before an arc leaves it
                ways = sums[i] + [0.0] * (stop - first)
                for start, end, p in arcs:
                    ways[end] += ways[start] * p[i]
                if stop == size:
                    logs[i] += math.log(ways[-1])
                    continue
                ways = ways[max(0, stop - reach + 1) - origin :]
                top = max(ways)
                sums[i] = [x / top for x in ways]
                logs[i] += math.log(top)
        return tuple(logs)

    def _short_words(self, words: list[str]) -> np.ndarray:
        """As :meth:`_word` for many words of so few letters that no sum can vanish: one pass of the automaton, then place by place."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        found = np.fromiter(chain.from_iterable(self._automaton.iter("\0".join(words))), np.int64).reshape(-1, 2)
        length, piece = found[:, 1] >> 20, found[:, 1] & 0xFFFFF
        word = np.searchsorted(at, found[:, 0], "right") - 1
        end = found[:, 0] - at[word] + 1
        bare = np.arange(int(size.max())) < size[:, None]
        bare[word[length == 1], end[length == 1] - 1] = False
        more_words, more_starts = np.nonzero(bare)
        word, end = np.concatenate([word, more_words]), np.concatenate([end, more_starts + 1])
        length = np.concatenate([length, np.ones(len(more_words), np.int64)])
        piece = np.concatenate([piece, np.full(len(more_words), len(self._chances) - 1)])
        order = np.lexsort((word, end))
        word, end, start, piece = word[order], end[order], (end - length)[order], piece[order]
        ways = np.zeros((len(words), int(size.max()) + 1, len(self.languages)))
        ways[:, 0] = 1.0
        cuts = np.searchsorted(end, np.arange(1, int(size.max()) + 2))
        for place, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
            own = word[a:b]
            heads = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
            ways[own[heads], place] = np.add.reduceat(ways[own, start[a:b]] * self._matrix[piece[a:b]], heads, axis=0)
        return np.log(ways[np.arange(len(words)), size])

    def _sums(self, words: list[str], owner: np.ndarray, owners: int) -> np.ndarray:
        """Per owner the sum of the log-probabilities of its words, added in their order. Rows of words stay in a table until it is full."""
        rows = np.fromiter(map(self._rows.get, words, repeat(-1)), np.int64, len(words))
        out = np.zeros((owners, len(self.languages)))
        if (rows < 0).any():
            new = dict.fromkeys(words[k] for k in np.nonzero(rows < 0)[0].tolist())
            if len(self._rows) + len(new) > TABLE_WORDS:
                self._rows.clear()
                new = dict.fromkeys(words)
            short = [w for w in new if len(w) < SHORT_WORD]
            for k in range(0, len(short), BATCH_WORDS):
                part, size = short[k : k + BATCH_WORDS], len(self._rows)
                self._table[size : size + len(part)] = self._short_words([MARK + w for w in part])
                self._rows.update(zip(part, range(size, size + len(part)), strict=True))
            long = {w: self._word(MARK + w) for w in new if len(w) >= SHORT_WORD}
            for k, w in enumerate(words) if long else ():
                if w in long:
                    out[owner[k]] += long[w]
            rows = np.fromiter(map(self._rows.get, words, repeat(-1)), np.int64, len(words))
            owner, rows = owner[rows >= 0], rows[rows >= 0]
        for i in range(len(self.languages)):
            out[:, i] += np.bincount(owner, self._table[rows, i], owners)
        return out

    def predict_all(self, texts: list[str]) -> list[tuple[str, float]]:
        """For each text (language, score): the most probable language, ties to the first by name, and its share of the scaled
        likelihoods. Texts are taken together until they hold CHUNK_WORDS words; one of more words is taken alone, in parts."""
        if self._table is None:
            self._start()
        out: list[tuple[str, float]] = []
        held, sizes = [], []
        for k, text in enumerate(texts):
            words = letter_words(text)
            held += words
            sizes.append(len(words))
            if k + 1 < len(texts) and len(held) < CHUNK_WORDS:
                continue
            if len(sizes) > 1 and len(held) > CHUNK_WORDS:  # the last one alone
                out += self._told(held[: -len(words)], sizes[:-1])
                held, sizes = words, sizes[-1:]
            out += self._told(held, sizes)
            held, sizes = [], []
        return out

    def _told(self, words: list[str], sizes: list[int]) -> Iterator[tuple[str, float]]:
        owner, total = np.repeat(np.arange(len(sizes)), sizes), np.zeros((len(sizes), len(self.languages)))
        for k in range(0, len(words) if self.languages else 0, CHUNK_WORDS):
            total += self._sums(words[k : k + CHUNK_WORDS], owner[k : k + CHUNK_WORDS], len(sizes))
        for n, row in zip(sizes, total.tolist(), strict=True):
            if not n or not row:
                yield UNDETERMINED, 0.0
                continue
            scale, top = min(1.0, EVIDENCE_WORDS / n), max(row)
            yield self.languages[row.index(top)], 1 / sum(math.exp((x - top) * scale) for x in row)

    def predict(self, text: str) -> tuple[str, float]:
        return self.predict_all([text])[0]


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, path: str | None = None) -> LanguageModel:
    """Fits on about ``per_language`` documents of each language, never over twice as many, whose crc32(id as text) mod 3 is not 1.

    They are taken by a hash of their id, at a rate that follows from one count per language; only they are brought to the driver.
    """
    key = F.col(id_col).cast("string")
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), key.alias("k"), F.col(text_col).cast("string").alias("t"))
    eligible = named.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & F.col("k").isNotNull() & (F.crc32("k") % 3 != 1))
    sizes = {r["lang"]: r["n"] for r in eligible.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, path)
    steps = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(steps, -(-steps * per_language // n)))])
    hashed = eligible.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(steps)))
    chosen = hashed.where(F.col("h") < rate[F.col("lang")]).orderBy("h", "k", "t").limit(2 * per_language * len(sizes))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for row in chosen.select("lang", "t").toLocalIterator():
        counts[row["lang"]].update(letter_words(row["t"]))
    return LanguageModel.train(counts, path)


#: The model of the last task of this worker: the next task of the same query goes on with its table of words.
_last_model: list[tuple[str, LanguageModel]] = []


class _Sent:
    """A model as it is sent to tasks: its pickled form, which a worker opens once."""

    def __init__(self, model: LanguageModel):
        self.state = pickle.dumps((model.languages, model.pieces, model.path), pickle.HIGHEST_PROTOCOL)
        self.key = hashlib.sha256(self.state).hexdigest()

    def open(self) -> LanguageModel:
        if not _last_model or _last_model[0][0] != self.key:
            _last_model[:] = [(self.key, LanguageModel(*pickle.loads(self.state)))]
        return _last_model[0][1]


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its whole text alone."""
    prepare(docs.sparkSession)
    sent = _Sent(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.open()
        for ids, raws in rows_of(batches):
            found = model.predict_all([(raw or b"").decode("utf-8", "replace") for raw in raws])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def told_rows(texts: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is told with at least a score, with all their columns, whatever these are called.

    A model that learned no language can tell none: then the rows that have letters stay.
    """
    prepare(texts.sparkSession)
    place = texts.columns.index(text_col)
    learned, sent = model.learned, _Sent(model)

    def told(model: LanguageModel, texts: list[str]) -> list[bool]:
        if not learned:
            return [_LETTERS.search(text) is not None for text in texts]
        return [lang != UNDETERMINED and score >= least_score for lang, score in model.predict_all(texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.open()
        for batch in batches:
            yield batch.filter(pa.array(told(model, [t or "" for t in batch.column(place).to_pylist()]), pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out (crc32(id as text) mod 3 is 1; false for a null id), lang_pred, score.

    A text that is null or has no letters is ``und`` with score 0, and so is any text if no row is labelled. Repeated rows give
    repeated results, an empty table an empty one; other columns are ignored.
    """
    model = train_language_model(docs, id_col, text_col, lang_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return predict_languages(docs, model, id_col, text_col).select("doc_id", held.alias("held_out"), "lang_pred", "score")
