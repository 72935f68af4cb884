"""Scores of texts against all names of a block at once: the rules of :mod:`sheafwork.functions.fuzzy` over numpy columns.

The places of a text's characters are bit masks; a step of the recurrence takes one character of all names. Scores equal those of the
rules, to the last bit. Pairs that columns do not hold (over MASK_CHARS characters, shared or repeated words) go to the rules themselves.

Where only the best names are asked for, letters that two texts share, in any order, bound their score from above: a product of matrices.
Pairs whose bound is below the last of a text's best scores are not compared.
"""

from __future__ import annotations

import numpy as np

from sheafwork.functions import fuzzy as Z

#: Texts whose bounds are held at a time, pairs that are compared at a time, and classes of letters, which are told apart by number.
CHUNK_TEXTS = 64
CHUNK_PAIRS = 16_384
LETTER_CLASSES = 64
#: More than bounds in 32-bit numbers can be off.
SLACK = 1e-3


class Column:
    """Texts of at most MASK_CHARS characters as rows of letter numbers, 0 beyond their ends; longer ones are left to ``long``."""

    def __init__(self, texts: list[str], letters: dict[str, int]):
        self.texts, self.letters = texts, letters
        self.long = np.array([k for k, t in enumerate(texts) if len(t) > Z.MASK_CHARS], dtype=np.int64)
        kept = ["" if len(t) > Z.MASK_CHARS else t for t in texts]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        width = max(map(len, kept), default=0)
        self.codes = np.zeros((width, len(texts)), np.int32)
        if width:
            points = np.array(kept, f"U{width}").view(np.uint32).reshape(len(kept), width).T
            inside = np.arange(width)[:, None] < np.where(self.sizes > Z.MASK_CHARS, 0, self.sizes)
            found, at = np.unique(points[inside], return_inverse=True)
            self.codes[inside] = np.array([letters.setdefault(chr(c), len(letters) + 1) for c in found], np.int32)[at]

    def masks(self, text: str) -> np.ndarray:
        """For each letter number the places that it has in a text, as bits."""
        out = np.zeros(len(self.letters) + 1, np.int64)
        for i, c in enumerate(text):
            k = self.letters.get(c)
            if k is not None:
                out[k] |= 1 << i
        return out

    def ratios(self, text: str) -> np.ndarray:
        """The ratio of a text with each row."""
        if len(text) > Z.MASK_CHARS:
            return np.array([Z.py_ratio(text, t) for t in self.texts], dtype=np.float64)
        total = len(text) + self.sizes
        common = _common(self.masks(text), (1 << len(text)) - 1, self.codes)
        out = np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)
        for k in self.long:
            out[k] = Z.py_ratio(text, self.texts[k])
        return out

    def partial_ratios(self, text: str, rows: np.ndarray) -> np.ndarray:
        """The best ratio with a window, for rows whose length differs from the text's; neither is empty or over MASK_CHARS."""
        out = np.zeros(len(rows))
        masks, sizes = self.masks(text), self.sizes[rows]
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            codes = self.codes[: int(n), rows[at]]
            out[at] = _windows_of_text(text, masks, codes) if n < len(text) else _windows_of_rows(text, masks, codes)
        return out


def _common(masks: np.ndarray, full: int, codes: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of masked texts with the columns of ``codes``.

    With ``among`` (windows, 1) the masks are a window's (windows, letters) and ``full`` is its bits.
    """
    if among is None:
        s = np.full(codes.shape[1], full, np.int64)
        for line in codes:
            u = s & masks[line]
            s = ((s + u) | (s & ~u)) & full
        return int(full).bit_count() - np.bitwise_count(s).astype(np.int64)
    s = np.repeat(among, codes.shape[1], axis=1)
    for line in codes:
        u = s & masks[:, line]
        s = ((s + u) | (s & ~u)) & among
    return np.bitwise_count(among).astype(np.int64) - np.bitwise_count(s).astype(np.int64)


def _windows_of_text(text: str, masks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows of one length below the text's, which slide over the text."""
    n = codes.shape[0]
    starts = [(max(0, k), min(len(text), k + n)) for k in range(1 - n, len(text))]
    kind = np.int32 if n <= 30 else np.int64
    low, high = (np.array(x, np.int64)[:, None] for x in zip(*starts, strict=True))
    among = ((np.int64(1) << (high - low)) - 1).astype(kind)
    cut = ((masks[None, :] >> low) & ((np.int64(1) << (high - low)) - 1)).astype(kind)
    return (200.0 * _common(cut, 0, codes, among) / ((high - low) + n)).max(axis=0)


def _windows_of_rows(text: str, masks: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows of one length above the text's, over which the text slides."""
    n, size = len(text), codes.shape[0]
    out = np.zeros(codes.shape[1])
    for k in range(1 - n, size):
        part = codes[max(0, k) : k + n]
        out = np.maximum(out, 200.0 * _common(masks, (1 << n) - 1, part) / (n + part.shape[0]))
    return out


def _sorted_words(x: str) -> str:
    return " ".join(sorted(x.split()))


class _Variants:
    """The variants of names, each form once, shorter forms first: ``form[j]`` is one of the forms of the name ``name[j]``."""

    def __init__(self, names: list[list[str]]):
        forms = {v: j for j, v in enumerate(sorted({v for variants in names for v in variants}, key=lambda v: (len(v), v)))}
        pairs = sorted({(k, forms[v]) for k, variants in enumerate(names) for v in variants})
        letters: dict[str, int] = {}
        self.n, self.forms = len(names), list(forms)
        self.name, self.form = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [])))
        self.plain = Column(self.forms, letters)
        ordered: dict[str, int] = {}
        self.ordered_of = np.array([ordered.setdefault(_sorted_words(v), len(ordered)) for v in self.forms], dtype=np.int64)
        self.ordered = Column(list(ordered), letters)

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Of each name the best of its forms' scores; 0 without a form."""
        out = np.zeros(self.n)
        np.maximum.at(out, self.name, scores[self.form])
        return out


class Grid:
    """The names of a block. Called with a text, it gives the scores of all names; ``best`` gives the first names of many texts.

    The rule is that of ``native_name_score`` (plain and token-sorted ratios), or with ``weighted`` that of ``name_score``, which is
    ``py_score`` of normalized texts: the weighted and the token-sorted ratio.
    """

    def __init__(self, names: list[list[str]], weighted: bool):
        self.weighted = weighted
        self.v = v = _Variants([[x for x in map(Z.py_normalize, variants) if x] for variants in names] if weighted else names)
        words = [x.split() for x in v.forms]
        self.repeated = [k for k, w in enumerate(words) if len(set(w)) < len(w) or len(v.forms[k]) > Z.MASK_CHARS] if weighted else []
        self.with_word: dict[str, list[int]] = {}
        for k, w in enumerate(words if weighted else []):
            for x in w:
                self.with_word.setdefault(x, []).append(k)

    def __call__(self, text: str) -> np.ndarray:
        v = self.v
        if not self.weighted:
            return v.best(np.maximum(v.plain.ratios(text), v.ordered.ratios(_sorted_words(text))[v.ordered_of]))
        text = Z.py_normalize(text)
        if len(text.replace(" ", "")) < 3:
            return np.zeros(v.n)
        ordered = _sorted_words(text)
        out = np.maximum(v.plain.ratios(text), v.ordered.ratios(ordered)[v.ordered_of])
        odd = self._odd(text)
        by_rule = set(range(len(v.forms))) if odd else self._by_rule(text)
        if not odd:
            size, sizes = len(text), np.maximum(v.plain.sizes, 1)
            unlike = np.maximum(size, sizes) / np.minimum(size, sizes)
            far = np.ones(len(v.forms), bool)
            far[list(by_rule)] = False
            rows = np.flatnonzero(far & (unlike >= 1.5))
            scale = np.where(unlike[rows] <= 8, 0.9, 0.6)
            whole = v.plain.partial_ratios(text, rows)
            of_ordered, back = np.unique(v.ordered_of[rows], return_inverse=True)
            by_words = v.ordered.partial_ratios(ordered, of_ordered)[back]
            out[rows] = np.maximum(out[rows], np.maximum(scale * whole, 0.95 * scale * by_words))
        for k in by_rule:
            out[k] = max(out[k], Z.py_weighted(text, v.forms[k]))
        return v.best(out)

    def _odd(self, text: str) -> bool:
        """Whether a text's words repeat or it is too long for the masks."""
        own = text.split()
        return len(text) > Z.MASK_CHARS or self.weighted and len(set(own)) < len(own)

    def _by_rule(self, text: str) -> set[int]:
        return {*self.repeated, *(k for w in text.split() for k in self.with_word.get(w, ()))}

    def best(self, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, name, score), numbers of the k best names of each text in order, ties in the order of the names."""
        found, by_size = [], {}
        for t, text in enumerate(texts):
            of = Z.py_normalize(text) if self.weighted else text
            ordered = _sorted_words(of)
            if not self.v.forms or not of or len(ordered) != len(of) or self._odd(of) or self.weighted and len(of.replace(" ", "")) < 3:
                found.append((np.full(min(k, self.v.n), t), *first_names(self(text), k)))
            else:
                by_size.setdefault(len(of), []).append((t, of, ordered))
        if by_size:
            bounds = _Bounds(self)
            for group in by_size.values():
                for a in range(0, len(group), CHUNK_TEXTS):
                    numbers, plain, ordered = zip(*group[a : a + CHUNK_TEXTS], strict=True)
                    of, rows, scores = bounds.best(list(plain), list(ordered), k)
                    found.append((np.array(numbers)[of], rows, scores))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def first_names(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and scores of the k best, ties in their order."""
    n = len(scores)
    rows = np.flatnonzero(scores >= np.partition(scores, n - k)[n - k]) if n > k else np.arange(n)
    rows = rows[np.argsort(-scores[rows], kind="stable")[:k]]
    return rows, scores[rows]


class _Bounds:
    """The forms of a grid as letter counts. Texts come in chunks of one length; they and their token-sorted forms are equally long."""

    def __init__(self, grid: Grid):
        self.grid, self.v = grid, grid.v
        v, self.column = grid.v, {}
        sizes = v.plain.sizes
        #: Forms that the counts do not bound: long ones, and those that token sorting shortens.
        self.always = np.flatnonzero((sizes > Z.MASK_CHARS) | (v.ordered.sizes[v.ordered_of] != sizes) | (sizes == 0))
        letter_class = np.zeros(len(v.plain.letters) + 1, np.int64)
        for c, n in v.plain.letters.items():
            letter_class[n] = 0 if c.isspace() else n % LETTER_CLASSES
        self.classes = {c: int(letter_class[n]) for c, n in v.plain.letters.items()}
        counts = np.zeros((len(v.forms), LETTER_CLASSES), np.int32)
        for line in v.plain.codes:
            np.add.at(counts, (np.flatnonzero(line), letter_class[line[line > 0]]), 1)
        self.most = counts.max(axis=0)
        self.bags = self._unary(counts)
        # the names of a form, of which the first k are enough
        order = np.argsort(v.form, kind="stable")
        self.names = v.name[order]
        self.starts = np.searchsorted(v.form[order], np.arange(len(v.forms) + 1))
        self.bare = np.setdiff1d(np.arange(v.n), v.name)
        self.forms_of_name = int(np.bincount(v.name).max())

    def _unary(self, counts: np.ndarray) -> np.ndarray:
        """Counts as ones, so that the product of two rows is the size of what both share."""
        return np.concatenate([counts[:, [c]] > np.arange(n) for c, n in enumerate(self.most) if n], axis=1).astype(np.float32) if self.most.any() else np.zeros((len(counts), 1), np.float32)

    def best(self, texts: list[str], ordered: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, n_texts, n_forms = self.v, len(texts), len(self.v.forms)
        counts = np.zeros((n_texts, LETTER_CLASSES), np.int32)
        for t, text in enumerate(texts):
            for c in text:
                if (x := 0 if c.isspace() else self.classes.get(c)) is not None:
                    counts[t, x] += 1
        size = len(texts[0])
        upper = self._upper(self._unary(counts) @ self.bags.T, size)
        upper[:, self.always] = np.inf
        ruled = np.zeros((n_texts, n_forms), bool) if self.grid.weighted else None
        if ruled is not None:
            for t, text in enumerate(texts):
                ruled[t, list(self.grid._by_rule(text))] = True
            upper[ruled] = np.inf
        masks = tuple(np.array([column.masks(x) for x in own]) for column, own in ((v.plain, texts), (v.ordered, ordered)))
        scored = lambda of, forms, least: self._scores(texts, ordered, masks, ruled, of, forms, least)
        # scores of the most promising forms, which give a lower bound of the last of the best
        first = self.forms_of_name * k + 8
        if first < n_forms:
            limit = np.partition(upper, n_forms - first, axis=1)[:, n_forms - first]
        else:
            limit = np.full(n_texts, -1, np.float32)
        of, forms = np.divmod(np.flatnonzero(upper >= limit[:, None]), n_forms)
        scores = scored(of, forms, np.zeros(n_texts))
        picked = self._names(of, forms, scores, k, n_texts)
        last = np.zeros(n_texts)
        enough = np.bincount(picked[0], minlength=n_texts) >= k
        ends = np.searchsorted(picked[0], np.arange(n_texts), side="right") - 1
        last[enough] = picked[2][ends[enough]]
        # all other forms that can reach it
        more_of, more_forms = np.divmod(np.flatnonzero((upper >= (last - SLACK)[:, None].astype(np.float32)) & (upper < limit[:, None])), n_forms)
        if not len(more_of):
            return picked
        more = scored(more_of, more_forms, last)
        keep, kept = scores >= last[of], more >= last[more_of]
        return self._names(np.concatenate([of[keep], more_of[kept]]), np.concatenate([forms[keep], more_forms[kept]]), np.concatenate([scores[keep], more[kept]]), k, n_texts)

    def _upper(self, shared: np.ndarray, size: int) -> np.ndarray:
        """The most that texts of ``size`` characters can score, by the letters they share with each form."""
        sizes = np.maximum(self.v.plain.sizes, 1)
        least = np.minimum(size, sizes)
        unlike = np.maximum(size, sizes) / least
        out = shared * (200.0 / (size + sizes)).astype(np.float32)
        if self.grid.weighted:
            # a window of the shorter text's length or less: best one that holds what is shared and nothing else; forms are ordered by length
            below, above = int(np.sum((sizes < size) & (unlike >= 1.5))), int(np.sum((sizes > size) & (unlike >= 1.5)))
            for rows in (slice(0, below), slice(len(sizes) - above, len(sizes))):
                n = least[rows].astype(np.float32)
                common = np.minimum(shared[:, rows], n)
                of_window = common * np.where(unlike[rows] <= 8, 180.0, 120.0).astype(np.float32) / (n + common)
                np.maximum(out[:, rows], of_window, out=out[:, rows])
        return out

    def _scores(self, texts: list[str], ordered: list[str], masks: tuple[np.ndarray, np.ndarray], ruled: np.ndarray | None, of: np.ndarray, forms: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The scores of pairs, right where they reach the ``least`` of their text."""
        v, size = self.v, len(texts[0])
        out = np.maximum(_pair_ratios(v.plain, masks[0], size, of, forms), _pair_ratios(v.ordered, masks[1], size, of, v.ordered_of[forms]))
        for at in np.flatnonzero(np.isin(forms, v.plain.long)):
            out[at] = max(Z.py_ratio(texts[of[at]], v.forms[forms[at]]), Z.py_token_sort(texts[of[at]], v.forms[forms[at]]))
        if ruled is None:
            return out
        by_rule = ruled[of, forms]
        for at in np.flatnonzero(by_rule):
            out[at] = max(out[at], Z.py_weighted(texts[of[at]], v.forms[forms[at]], out[at]))
        sizes = np.maximum(v.plain.sizes[forms], 1)
        unlike = np.maximum(size, sizes) / np.minimum(size, sizes)
        rows = np.flatnonzero(~by_rule & (unlike >= 1.5))
        if len(rows):
            scale = np.where(unlike[rows] <= 8, 0.9, 0.6)
            wanted = lambda at: np.maximum(least[of[rows[at]]], out[rows[at]]) - SLACK
            whole = _pair_windows(v.plain, masks[0], size, of[rows], forms[rows], wanted(slice(None)) / scale)
            out[rows] = np.maximum(out[rows], scale * whole)
            in_order = v.ordered_of[forms[rows]]
            same = (np.array([a == b for a, b in zip(texts, ordered, strict=True)])[of[rows]]) & self._as_ordered(forms[rows])
            left = np.flatnonzero(~same & (95.0 * scale >= wanted(slice(None))))
            by_words = _pair_windows(v.ordered, masks[1], size, of[rows[left]], in_order[left], wanted(left) / (0.95 * scale[left]))
            out[rows[left]] = np.maximum(out[rows[left]], 0.95 * scale[left] * by_words)
        return out

    def _as_ordered(self, forms: np.ndarray) -> np.ndarray:
        """Whether forms equal their token-sorted forms."""
        if "same" not in self.column:
            self.column["same"] = np.array([x == self.v.ordered.texts[k] for x, k in zip(self.v.forms, self.v.ordered_of, strict=True)])
        return self.column["same"][forms]

    def _names(self, of: np.ndarray, forms: np.ndarray, scores: np.ndarray, k: int, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best names of each text by the scores of their forms, in order."""
        counts = np.minimum(self.starts[forms + 1] - self.starts[forms], k)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        names = self.names[np.repeat(self.starts[forms], counts) + within]
        of, scores = np.repeat(of, counts), np.repeat(scores, counts)
        bare = self.bare[:k]
        of, names, scores = np.concatenate([of, np.repeat(np.arange(n_texts), len(bare))]), np.concatenate([names, np.tile(bare, n_texts)]), np.concatenate([scores, np.zeros(n_texts * len(bare))])
        order = np.lexsort((-scores, names, of))
        of, names, scores = of[order], names[order], scores[order]
        once = np.ones(len(of), bool)
        once[1:] = (of[1:] != of[:-1]) | (names[1:] != names[:-1])
        of, names, scores = of[once], names[once], scores[once]
        order = np.lexsort((names, -scores, of))
        of, names, scores = of[order], names[order], scores[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        return of[place < k], names[place < k], scores[place < k]


def _pair_ratios(column: Column, masks: np.ndarray, size: int, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ratios of pairs of a text (masks by letter, ``size`` characters) and a row of a column."""
    out = np.empty(len(of))
    full = np.int64((1 << size) - 1)
    for a in range(0, len(of), CHUNK_PAIRS):
        at, row = of[a : a + CHUNK_PAIRS], rows[a : a + CHUNK_PAIRS]
        sizes = column.sizes[row]
        order = np.argsort(-sizes, kind="stable")
        base, row, ends = at[order] * masks.shape[1], row[order], -sizes[order]
        s = np.full(len(at), full)
        flat = masks.ravel()
        for j in range(min(column.codes.shape[0], int(sizes.max()))):
            n = int(np.searchsorted(ends, -j))  # rows with a character in this place
            x = s[:n]
            u = x & flat[base[:n] + column.codes[j, row[:n]]]
            s[:n] = ((x + u) | (x & ~u)) & full
        common = np.empty(len(at), np.int64)
        common[order] = size - np.bitwise_count(s).astype(np.int64)
        out[a : a + CHUNK_PAIRS] = 200.0 * common / (size + sizes)
    return out


def _pair_windows(column: Column, masks: np.ndarray, size: int, of: np.ndarray, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``partial_ratios`` of pairs of a text (masks by letter, ``size`` characters) and a row of another length, right where they reach ``least``."""
    out, sizes = np.zeros(len(of)), column.sizes[rows]
    for n in map(int, np.unique(sizes)):
        every = np.flatnonzero(sizes == n)
        step = max(1, CHUNK_PAIRS // (n + size))
        for a in range(0, len(every), CHUNK_PAIRS):
            at = every[a : a + CHUNK_PAIRS]
            met = masks.ravel()[of[at] * masks.shape[1] + column.codes[:n, rows[at]]]  # (characters of the row, pairs): their places in the text
            if n < size:
                kept = _reaching(met, size, least[at])
                at, met = at[kept], met[:, kept]
            for b in range(0, len(at), step):
                few = met[:, b : b + step]
                out[at[b : b + step]] = _rows_over_text(few, size) if n < size else _text_over_rows(few, size)
    return out


def _reaching(met: np.ndarray, size: int, least: np.ndarray) -> np.ndarray:
    """The pairs for which ``_rows_over_text`` can reach ``least``.

    A window has no more in common than the row's letters that the text has, nor than its places whose letters the row has. By the first
    bound, and at the ends of the text, where windows are shorter, by both, most pairs fall out; the others are bounded window by window.
    """
    n, kind = met.shape[0], np.int32 if size <= 30 else np.int64
    met = met.astype(kind)
    places, shared = np.bitwise_or.reduce(met, axis=0), (met != 0).sum(axis=0, dtype=np.uint8)
    reach, lowest = shared >= least * (n / 100.0), least.min(initial=np.inf)
    among = lambda low, high: np.minimum(np.bitwise_count(places & kind((1 << high) - (1 << low))), shared) >= least * ((high - low + n) / 200.0)
    for m in range(1, n):
        if 200.0 * m / (m + n) >= lowest:
            reach |= among(0, m) | among(size - m, size)
    kept = np.flatnonzero(reach)
    places, shared, least = places[kept], shared[kept], least[kept]
    reach = np.zeros(len(kept), bool)
    for k in range(1 - n, size):
        low, high = max(0, k), min(size, k + n)
        if 200.0 * (high - low) / (high - low + n) >= lowest:
            reach |= among(low, high)
    return kept[reach]


def _rows_over_text(met: np.ndarray, size: int) -> np.ndarray:
    n = met.shape[0]
    kind = np.int32 if size <= 30 else np.int64
    low, high = (np.array(x, kind)[:, None] for x in zip(*((max(0, k), min(size, k + n)) for k in range(1 - n, size)), strict=True))
    among = ((np.int64(1) << (high - low).astype(np.int64)) - 1).astype(kind)
    s = np.repeat(among, met.shape[1], axis=1)
    for line in met.astype(kind):
        u = s & (line >> low)
        s = ((s + u) | (s & ~u)) & among
    common = np.bitwise_count(among).astype(np.int64) - np.bitwise_count(s)
    return (200.0 * common / ((high - low).astype(np.int64) + n)).max(axis=0)


def _text_over_rows(met: np.ndarray, size: int) -> np.ndarray:
    n = met.shape[0]
    full = np.int64((1 << size) - 1)
    out = np.zeros(met.shape[1])
    for k in range(1 - size, n):
        part = met[max(0, k) : k + size]
        s = np.full(met.shape[1], full)
        for line in part:
            u = s & line
            s = ((s + u) | (s & ~u)) & full
        out = np.maximum(out, 200.0 * (size - np.bitwise_count(s).astype(np.int64)) / (size + part.shape[0]))
    return out


def plain_grid(names: list[list[str]]) -> Grid:
    """The rule of ``native_name_score``."""
    return Grid(names, False)


def weighted_grid(names: list[list[str]]) -> Grid:
    """The rule of ``name_score``."""
    return Grid(names, True)
