r"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans, which always stay. Around every trigger (digits, ``@``, a bracketed "at" or "dot", a run of 16 or
more letters and digits) a region of tokens, widened to white space at both ends, is decoded by a semi-Markov model: a segmentation is
a sequence of plain tokens and entities of at most MAX_TOKENS tokens, an entity is scored by features of its whole span (digit counts,
checksums, separators, neighbours, the word before), and dynamic programming picks boundaries and kinds together. The weights maximise
the conditional likelihood of a bounded sample of documents, labelled by the patterns and by a rule for assigned secrets, and of
made-up sentences with forms that the patterns do not cover (national phone numbers, spelled-out e-mail addresses, secrets of letters
alone) and with numbers that are no personal data.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import prepare, rows_of, texts_of

#: Kinds in the order in which spans with equal starts are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Documents sampled for training, regions of them that are used, and characters of such a region at most.
TRAIN_DOCS = 2000
TRAIN_REGIONS = 240
TRAIN_CHARS = 2000
EPOCHS = 6
#: Tokens of an entity, and characters of context around a trigger.
MAX_TOKENS = 24
CONTEXT = 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each @ outwards: a search from the left would try every start of a long run of letters
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start and kind, in code points; matches that fail their test are dropped."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m[0]) if m.end() - m.start() <= 37 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# The segment model

_TRIGGER = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}|[0-9](?:[0-9]|\.[0-9])|@|[\[(](?:at|dot)[\])]")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_NUMERIC = re.compile(r"[0-9\x20().+-]+")
_AT = re.compile(r"@|[\[(]at[\])]")
_SPELLED = re.compile(r"[\w.+-]+\x20?[\[(]at[\])]\x20?[\w-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[\w-]+)+")
_SECRET = re.compile(r"\b(?:token|secret|key|password)\s*[=:]\s*[\"']?([A-Za-z0-9]{24,})")
_HEX = re.compile(r"[0-9a-fA-F]+")
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Words before a span that are features of their own.
_CUES = frozenset("token secret key password tel phone call fax mail email contact card visa account ip host server version page year on no".split())
_WORD_BEFORE = re.compile(r"([^\W_]+)[^\w]{0,4}\Z")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, from white space to white space; stretches that meet are one."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        if a > end:
            if end > 0:
                yield start, end
            start = a
        if b > end:
            space = _SPACE.search(text, b)
            end = space.start() if space else len(text)
    if end > 0:
        yield start, end


def _bucket(n: int, steps: tuple[int, ...]) -> int:
    return sum(n >= s for s in steps)


def span_features(text: str, start: int, end: int) -> dict[str, list[str]]:
    """For each kind that the span text[start:end] could be, the names of its features."""
    span = text[start:end]
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    edge = f"{'a' if left.isalnum() else 's' if left.isspace() else left}_{'a' if right.isalnum() else 's' if right.isspace() else 'p'}"
    cue = _WORD_BEFORE.search(text, max(0, start - 24), start)
    cue = cue[1].lower() if cue and cue[1].lower() in _CUES else "-"
    out: dict[str, list[str]] = {}
    if _AT.search(span):
        whole = "base" if "@" in span and _is_email(span) else "spelled" if _SPELLED.fullmatch(span) else "no"
        out["email"] = [f"shape={whole}", f"edge={edge}", f"cue={cue}"]
    elif _NUMERIC.fullmatch(span):
        digits = _NOT_DIGITS.sub("", span)
        n = len(digits)
        groups = [len(g) for g in re.split("[^0-9]+", span) if g]
        if n >= 4 and "(" not in span.partition(")")[2]:
            marks = "".join(sorted({"+" if c == "+" else "(" if c in "()" else c for c in span if not c.isdigit()}))
            shared = [f"edge={edge}", f"cue={cue}", f"marks={marks}", f"digits={_bucket(n, (7, 8, 9, 10, 11, 12, 16, 20))}"]
            if span[0] in "+(" or len(groups) >= 2:
                shape = "base" if _PHONE.fullmatch(span) and 9 <= n <= 15 else "national" if groups in ([3, 3, 4], [1, 3, 3, 4]) and span[0] != "+" and "." not in span else "no"
                out["phone"] = [*shared, f"shape={shape}"]
            parts = span.split(".")
            if len(parts) == 4 and all(p.isdigit() for p in parts):
                out["ip"] = [*shared, f"shape={all(int(p) <= 255 for p in parts if len(p) < 9) and max(map(len, parts)) <= 3}"]
            if 12 <= n <= 19 and not set(marks) - {" ", "-"}:
                out["card"] = [*shared, f"luhn={luhn(digits)}", f"even={len(set(groups[:-1])) <= 1}"]
    elif _ALNUM.fullmatch(span) and len(span) >= 16:
        mixed = f"{any(c.isdigit() for c in span):d}{any(c.isalpha() for c in span):d}{_HEX.fullmatch(span) is not None:d}"
        out["secret"] = [f"mixed={mixed}", f"size={_bucket(len(span), (20, 24, 32, 40, 64))}", f"cue={cue}", f"edge={edge}"]
    return {kind: [f"{kind}:{x}" for x in ("bias", *names)] for kind, names in out.items()}


def _is_email(span: str) -> bool:
    return next(_emails(span), None) == (0, len(span))


def walk(text: str, start: int, end: int) -> Iterator[tuple[int, int, str, list[tuple[int, int, str, list[str]]]]]:
    """For each token of a region: its bounds, its feature as a plain token, and the entities that begin with it.

    An entity is (tokens, end, kind, features). No more than MAX_TOKENS tokens are held at once, whatever the region's length.
    """
    coming = _TOKEN.finditer(text, start, end)
    held: deque[tuple[int, int, str, bool]] = deque()
    while True:
        while len(held) < MAX_TOKENS and (m := next(coming, None)):
            t = m[0]
            held.append((*m.span(), t, t[0].isascii() and t.isdigit() or t in " ().+-"))
        if not held:
            return
        at, stop, first, _ = held[0]
        found = []
        if first[0].isalnum() or first in "+(":
            in_number, has_at = True, False
            for n, (_, until, t, numeric) in enumerate(held, 1):
                in_number &= numeric
                has_at |= t in ("@", "at")
                spaced = t.isspace() and t != " "
                if spaced or n > 1 and not in_number and not has_at and not (t in " .[(_-+%" or t[0].isalnum()):
                    break
                if t[-1].isalnum() and (in_number or has_at or n == 1 and len(first) >= 16):
                    found += [(n, until, kind, names) for kind, names in span_features(text, at, until).items()]
        yield at, stop, "plain:" + ("digits" if first[0].isdigit() else "@" if first == "@" else "long" if len(first) >= 16 else "word"), found
        held.popleft()


class Lattice:
    """A region's tokens, and the entity segments that could stand there: (from token, to token, kind, features). For training only."""

    def __init__(self, text: str, start: int, end: int):
        rows = list(walk(text, start, end))
        self.cuts = [at for at, *_ in rows] + [end]
        self.plain = [[name] for *_, name, _ in rows]
        self.segments: list[list[tuple[int, str, list[str]]]] = [[] for _ in rows]  # by their end
        for i, (*_, found) in enumerate(rows):
            for n, _, kind, names in found:
                self.segments[i + n - 1].append((i, kind, names))

    def gold(self, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]] | None:
        """Spans as (from token, to token, kind); None if one lies on the region's edge or is no segment here."""
        place = {c: k for k, c in enumerate(self.cuts)}
        out, free = [], 0
        for a, b, kind in spans:
            if b <= self.cuts[0] or a >= self.cuts[-1]:
                continue
            i, j = place.get(a), place.get(b)
            if i is None or j is None or i < free or not any(s[0] == i and s[1] == kind for s in self.segments[j - 1]):
                return None
            out.append((i, j - 1, kind))
            free = j
        return out


class SegmentModel:
    """A semi-Markov conditional random field over the segments of a :class:`Lattice`."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(weights or {})

    def _scored(self, lattice: Lattice) -> tuple[list[float], list[list[tuple[int, str, list[str], float]]]]:
        w = self.weights
        plain = [sum(w.get(f, 0.0) for f in names) for names in lattice.plain]
        return plain, [[(i, kind, names, sum(w.get(f, 0.0) for f in names)) for i, kind, names in ends] for ends in lattice.segments]

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """The best segmentation's entities in text[start:end] as (start, end, kind).

        Of equal scores the one with plain tokens wins, then the longest entity, then the first kind in the order of its features.
        Scores are held for the places an entity can reach; a token leaves only its place and the way that ends there.
        """
        w = self.weights
        scores, ways = deque([0.0]), deque([0])  # of the place now and of those after it; a way is tokens * 8 + kind, or 0
        cuts, backs = array("q", [start]), array("q", [0])
        for _, stop, plain, found in walk(text, start, end):
            here = scores.popleft()
            ways.popleft()
            while len(scores) < max([1, *(n for n, *_ in found)]):
                scores.append(-math.inf)
                ways.append(0)
            for n, _, kind, names in found:
                score = here + sum(w.get(f, 0.0) for f in names)
                if score > scores[n - 1]:
                    scores[n - 1], ways[n - 1] = score, n * 8 + KINDS.index(kind)
            score = here + w.get(plain, 0.0)
            if score >= scores[0]:
                scores[0], ways[0] = score, 0
            cuts.append(stop)
            backs.append(ways[0])
        out, j = [], len(cuts) - 1
        while j > 0:
            n, kind = divmod(backs[j], 8)
            if n:
                out.append((cuts[j - n], cuts[j], KINDS[kind]))
            j -= n or 1
        return out[::-1]

    def _update(self, lattice: Lattice, gold: list[tuple[int, int, str]], rate: float) -> None:
        """One gradient step on the log-likelihood of the gold segmentation (forward and backward pass in logarithms)."""
        plain, segments = self._scored(lattice)
        n = len(plain)
        ahead = [0.0]
        for j, p in enumerate(plain):
            ahead.append(_log_sum([ahead[j] + p, *(ahead[i] + s for i, _, _, s in segments[j])]))
        back: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
        total = [0.0] * (n + 1)
        for j in range(n, 0, -1):
            total[j] = _log_sum(back[j])
            back[j - 1].append(total[j] + plain[j - 1])
            for i, _, _, s in segments[j - 1]:
                back[i].append(total[j] + s)
        step: dict[str, float] = defaultdict(float)
        covered = [False] * n
        for i, j, kind in gold:
            covered[i : j + 1] = [True] * (j + 1 - i)
            for name in next(names for a, k, names, _ in segments[j] if a == i and k == kind):
                step[name] += 1
        z = ahead[n]
        for j, p in enumerate(plain):
            share = math.exp(ahead[j] + p + total[j + 1] - z)
            for name in lattice.plain[j]:
                step[name] += (not covered[j]) - share
            for i, _, names, s in segments[j]:
                share = math.exp(ahead[i] + s + total[j + 1] - z)
                if share > 1e-9:
                    for name in names:
                        step[name] -= share
        for name, x in step.items():
            self.weights[name] = self.weights.get(name, 0.0) * (1 - rate * 1e-3) + rate * x

    @classmethod
    def train(cls, examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS) -> SegmentModel:
        model = cls()
        data = []
        for text, spans in examples:
            for a, b in regions(text):
                if b - a > TRAIN_CHARS:
                    continue
                lattice = Lattice(text, a, b)
                gold = lattice.gold(spans)
                if gold is not None and any(lattice.segments):
                    data.append((lattice, gold))
        for epoch in range(epochs):
            for lattice, gold in data:
                model._update(lattice, gold, 0.5 / (1 + epoch))
        return model


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def seed_examples() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up sentences. Entities stand between braces as {kind|text}."""
    forms = []
    for k in range(24):
        a, b, c = 200 + 31 * k % 700, 100 + 17 * k % 800, 1000 + 271 * k % 8000
        raw = hashlib.sha512(f"seed {k}".encode()).digest()[: (24, 32, 40, 64)[k % 4]]
        letters, mixed = ("".join(chars[x % len(chars)] for x in raw) for chars in (_LETTERS, _LETTERS + "0123456789"))
        forms += [
            f"you can call {{phone|({a}) {b}-{c}}} before noon",
            f"our phone is {{phone|{a}-{b}-{c}}}, ask for the desk",
            f"fax {{phone|1 {a} {b} {c}}} or write",
            f"reach us at {{phone|+1 ({a}) {b}-{c}}} today.",
            f"mail {{email|reader{k} [at] house{k} [dot] example}} for more",
            f"write to {{email|desk{k} (at) mail{k}.example.com}} soon",
            f"send it to {{email|who.{k}@mail{k}.example.com}}, please",
            f"the server {{ip|10.{k}.{a % 256}.{b % 256}}} was down",
            f"in {1900 + k * 5} there were {a},{b} people and {c} houses",
            f"no address is {300 + k}.{k}.{a % 256}.{b % 256} of course",
            f"api key: {{secret|{hashlib.sha1(str(-k).encode()).hexdigest()}}} and more",
            f"secret={{secret|{hashlib.md5(str(k).encode()).hexdigest()}}}",
            f"version {k}.{a % 10}.{b % 10} of {2000 + k}-{1 + k % 12:02}-{1 + k:02} is out",
            f"order {a}{b}{c} of {c}{a} pieces, page {a}",
            f"the sum is {a}.{b % 100:02} for {c} units ({a % 100} %)",
            f'set token = "{{secret|{hashlib.sha1(str(k).encode()).hexdigest()}}}" in the file',
            f"{('token = ', 'key: ', 'password=', 'secret: ')[k // 4 % 4]}{{secret|{mixed}}} is set",
            f"{('key: ', 'password=', 'secret = ', 'token: ')[k // 4 % 4]}{{secret|{letters}}}",
            f"the word {'abcdefghij' * 2}{'klm'[k % 3]} has {20 + k} letters",
        ]
    out = []
    for form in forms:
        text, spans = "", []
        for part in re.split(r"(\{\w+\|[^}]*\})", form):
            if part.startswith("{"):
                kind, _, body = part[1:-1].partition("|")
                spans.append((len(text), len(text) + len(body), kind))
                part = body
            text += part
        out.append((text, spans))
    return out


def weak_labels(text: str) -> list[tuple[int, int, str]]:
    """Base spans and assigned secrets, without overlaps: of two that overlap the earlier stays."""
    found = sorted([*base_spans(text), *((*m.span(1), "secret") for m in _SECRET.finditer(text))], key=_order)
    out: list[tuple[int, int, str]] = []
    for span in found:
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def train_segment_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = TRAIN_DOCS, sample_regions: int = TRAIN_REGIONS) -> SegmentModel:
    """Fits on the made-up sentences and at most ``sample_regions`` regions of about ``sample_docs`` documents.

    Documents are taken by a hash of id and text, so rows without an id or with the same one are spread like others, and the choice
    does not depend on the layout. Regions of over TRAIN_CHARS characters are not learned from.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t"))
    steps = 1 << 30
    rate = min(steps, -(-steps * sample_docs // max(1, rows.count())))
    picked = rows.withColumn("h", F.pmod(F.xxhash64("k", "t"), F.lit(steps))).where((F.col("h") < rate) & F.col("t").rlike("[0-9]{4}|@|[A-Za-z0-9]{16}"))
    picked = picked.select("h", "t").orderBy("h", "t").limit(sample_docs).select("t")
    examples = seed_examples()
    stretches = []
    for row in picked.toLocalIterator():
        for a, b in regions(row["t"]):
            if b - a > TRAIN_CHARS:
                continue
            stretch = row["t"][a:b]
            stretches.append((hashlib.sha256(stretch.encode()).digest(), stretch))
    for _, stretch in sorted(set(stretches))[:sample_regions]:
        examples.append((stretch, weak_labels(stretch)))
    return SegmentModel.train(examples)


def all_spans(text: str, model: SegmentModel) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the model's spans are added where they meet no base span."""
    base = base_spans(text)
    more = []
    for a, b in regions(text):
        more += model.decode(text, a, b)
    if more and base:
        taken = bytearray(len(text))
        for s, e, _ in base:
            taken[s:e] = b"\x01" * (e - s)
        more = [x for x in more if not any(taken[x[0] : x[1]])]
    return base, sorted([*base, *more], key=_order)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: SegmentModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (all, as kind:start:end).

    A null text counts as empty: no spans, and the digest of the empty string. Repeated rows give repeated results, an empty table
    an empty one; other columns are ignored. Ties between segmentations: see :meth:`SegmentModel.decode`. Very long texts, regions
    and numbers need no special case: a region is decoded with MAX_TOKENS tokens in hand.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
    types = [*[pa.int64()] * 5, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in rows_of(batches):
            rows = []
            for doc_id, raw in zip(ids, raws, strict=True):
                base, spans = all_spans((raw or b"").decode("utf-8", "replace"), model)
                counts = [sum(s[2] == k for s in base) for k in BASE_KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def redacted_texts(texts: DataFrame, model: SegmentModel, text_col: str = "text") -> DataFrame:
    """The rows of texts with all spans of ``text_col`` replaced; other columns, nulls and repeated rows stay as they are."""
    prepare(texts.sparkSession)
    place = texts.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = [None if t is None else redact(t, all_spans(t, model)[1]) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(column, batch.schema.field(place).type))

    return texts.mapInArrow(run, texts.schema)


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains the segment model on docs and applies it with the base patterns to every whole text; see :func:`find_personal_data`."""
    return find_personal_data(docs, train_segment_model(docs, id_col, text_col), id_col, text_col)
