"""Token counts, language ID, byte-pair encoding and packing against the tokenizers library and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from sheafwork.llm import bpe as B
from sheafwork.llm import packing as K
from sheafwork.llm import unigram as U

from .helpers import AWKWARD, documents

ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aab", "<|endoftext|> ", "é ñ'sΣİ", "中文字 ", "0123!?.,\n\t", "▁ ▁", "\x1c\x85​", "😀𝒳"]


def random_texts(n, seed):
    random.seed(seed)
    return ["".join(random.choice(random.choice(ALPHABETS)) for _ in range(random.choice([0, 3, 8, 20, 60]))) for _ in range(n)]


# byte-pair encoding


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path(B.TOKENIZER)
    return B.WordBpe(path), Tokenizer.from_file(path)


def test_encoder_equals_the_library(word_bpe):
    ours, library = word_bpe
    for text in [*random_texts(3000, 1), "a" * 5000, "<|startoftext|>Ab<|endoftext|>", "</w>", "I'll it's 'S"]:
        ids = ours.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert ours.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_plain_characters_need_no_library(word_bpe):
    ours, library = word_bpe
    for code in range(ord(B.PLAIN_BELOW)):
        text = f"a{chr(code)}b {chr(code)}1 {chr(code)}{chr(code)}  x"
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_backtracking_equals_merging_in_order():
    """Random merge tables: the encoder against merging pairs one rank after another."""
    random.seed(4)
    for _ in range(60):
        merges, spelled = [], ["a", "b", "c"]
        while len(merges) < 12:
            pair = random.randrange(len(spelled)), random.randrange(len(spelled))
            if spelled[pair[0]] + spelled[pair[1]] not in spelled:
                merges.append(pair)
                spelled.append(spelled[pair[0]] + spelled[pair[1]])
        encoder = B.BacktrackEncoder(3, merges)
        for _ in range(40):
            word = [random.randrange(3) for _ in range(random.randint(1, 14))]
            want = list(word)
            while True:
                ranks = [(merges.index(p), k) for k, p in enumerate(zip(want, want[1:], strict=False)) if p in merges]
                if not ranks:
                    break
                rank, k = min(ranks)
                want[k : k + 2] = [3 + rank]
            assert encoder.encode(word) == want


def test_round_trip_rows(spark, word_bpe):
    _, library = word_bpe
    found = B.bpe_round_trip(documents(spark)).collect()
    want = []
    for i, t, _ in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)
    assert B.bpe_round_trip(documents(spark, [])).count() == 0


# token counts


@pytest.fixture(scope="module")
def unigram():
    scored = U.zipf_scores(U.vocabulary())
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], 0, False))
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return U.UnigramCounter(scored), library


def test_counts_equal_the_library(unigram):
    ours, library = unigram
    for text in random_texts(3000, 2):
        assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_ties_follow_the_library():
    """Equal scores everywhere: which of several best ways is counted depends on the tie rules alone."""
    random.seed(6)
    for _ in range(50):
        pieces = sorted({"".join(random.choice("ab▁") for _ in range(random.randint(1, 4))) for _ in range(10)})
        scored = [(p, float(-random.randint(1, 2))) for p in pieces]
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], 0, False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        ours = U.UnigramCounter([("\0", 0.0), *scored])
        ours.unknown = min([0.0, *(s for _, s in scored)]) - U.UNKNOWN_PENALTY
        for _ in range(20):
            text = "".join(random.choice("abc") for _ in range(random.randint(1, 12)))
            assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), (scored, text)


def test_count_rows(spark, unigram):
    ours, _ = unigram
    found = U.token_counts(documents(spark)).collect()
    assert sorted(map(str, [(i, len((t or "").encode()), ours.count(t or "")) for i, t, _ in AWKWARD])) == sorted(str(tuple(r)) for r in found)
    assert U.token_counts(documents(spark, [])).count() == 0


# language ID


def test_forward_sums_all_segmentations():
    model = U.LanguageModel(["x", "y"], {"▁a": (0.2, 0.1), "b": (0.3, 0.2), "ab": (0.05, 0.4), "▁ab": (0.01, 0.02), "▁": (0.1, 0.1), "a": (0.2, 0.3)})
    model.predict("a")

    def brute(word, k):
        if not word:
            return 1.0
        return sum(model.pieces[word[:n]][k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in model.pieces)

    for word in ("▁ab", "▁abab", "▁a", "▁bbab"):
        assert model._word(word) == pytest.approx([math.log(brute(word, k)) for k in (0, 1)])


def test_every_piece_of_the_vocabulary_counts():
    """Words outside the training sample: pieces that no language showed have the floor's probability."""
    model = U.LanguageModel.train({"x": Counter({"house": 3}), "y": Counter({"mouse": 2})})
    model.predict("a")
    vocabulary, floor = set(U.vocabulary()), (U.FLOOR, U.FLOOR)
    for word in ("▁understanding", "▁stationhouse", "▁ñandú中"):
        want = []
        for k in (0, 1):
            ways = [1.0, *[0.0] * len(word)]
            for a in range(len(word)):
                for b in range(a + 1, len(word) + 1):
                    if word[a:b] in vocabulary or b == a + 1:
                        ways[b] += ways[a] * model.pieces.get(word[a:b], floor)[k]
            want.append(math.log(ways[-1]))
        assert model._word(word) == pytest.approx(want)


def test_expected_counts_weigh_all_segmentations():
    automaton = U._automaton((p, p) for p in ("▁", "a", "b", "ab", "▁a"))
    p = {"▁": 0.1, "a": 0.2, "b": 0.3, "ab": 0.05, "▁a": 0.2}
    ways = {("▁", "a", "b"): 0.1 * 0.2 * 0.3, ("▁", "ab"): 0.1 * 0.05, ("▁a", "b"): 0.2 * 0.3}
    want = Counter()
    for way, q in ways.items():
        for piece in way:
            want[piece] += 2 * q / sum(ways.values())
    got = Counter()
    U._expected(automaton, "▁ab", p, 2, got, U.STRIDE)
    assert dict(got) == pytest.approx(dict(want))


def test_training_is_expectation_maximisation():
    """Three rounds on few words against all their segmentations."""
    counts = {"x": Counter({"ab": 3, "the": 2, "a": 1}), "y": Counter({"the": 1})}
    vocabulary = set(U.vocabulary())

    def ways(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in vocabulary:
                for rest in ways(word[n:]):
                    yield (word[:n], *rest)

    model = U.LanguageModel.train(counts)
    for k, lang in enumerate(("x", "y")):
        p = dict.fromkeys(vocabulary, 1 / len(U.vocabulary()))
        for _ in range(U.TRAIN_ROUNDS):
            uses = Counter()
            for word, n in counts[lang].items():
                weight = {way: math.prod(p.get(x, U.FLOOR) for x in way) for way in ways(U.MARK + word)}
                for way, q in weight.items():
                    for piece in way:
                        uses[piece] += n * q / sum(weight.values())
            p = {x: max(U.FLOOR, n / sum(uses.values())) for x, n in uses.items()}
        assert {x: q[k] for x, q in model.pieces.items()} == pytest.approx({x: p.get(x, U.FLOOR) for x in vocabulary})


def log_sums(arcs_from, size):
    """Logarithm of the sum over all ways from 0 to size, in logarithms at every place; arcs_from(k) gives (end, probability)."""
    ways = [0.0, *[-math.inf] * size]
    for k in range(size):
        for end, q in arcs_from(k):
            a, b = max(ways[end], ways[k] + math.log(q)), min(ways[end], ways[k] + math.log(q))
            ways[end] = a + math.log1p(math.exp(b - a))
    return ways


def random_word(n, seed):
    random.seed(seed)
    return U.MARK + "".join(random.choice("thequickbrownfoxéñ中") for _ in range(n))


def test_long_words_sum_all_segmentations():
    """No cut at any length: words of many strides against sums in logarithms, in both passes."""
    model = U.LanguageModel.train({"x": Counter({"house": 3, "the": 2}), "y": Counter({"mouse": 2, "quick": 1})})
    model.predict("a")
    vocabulary = set(U.vocabulary())
    for n in (15, 16, 17, 31, 32, 33, 63, 64, 65, 200, 1500):
        word = random_word(n, n)
        for k in (0, 1):
            arcs = lambda a, k=k, word=word: [(b, model.pieces.get(word[a:b], (U.FLOOR,) * 2)[k]) for b in range(a + 1, min(len(word), a + 16) + 1) if b == a + 1 or word[a:b] in vocabulary]
            assert model._word(word)[k] == pytest.approx(log_sums(arcs, len(word))[-1], rel=1e-12)


def test_long_words_weigh_all_segmentations():
    p = {"▁": 0.1, "t": 0.02, "h": 0.01, "th": 1e-6, "qu": 0.3, "he": 0.2, "▁t": 0.004}
    automaton = U._automaton((x, x) for x in p)
    for n in (14, 15, 16, 17, 40, 300, 2000):
        word = random_word(n, n)
        arcs = lambda a, word=word: [(b, p.get(word[a:b], U.FLOOR)) for b in (a + 1, a + 2) if b <= len(word) and (b == a + 1 or word[a:b] in p)]
        ahead = log_sums(arcs, len(word))
        back = log_sums(lambda b, word=word: [(len(word) - a, p.get(word[a : len(word) - b], U.FLOOR)) for a in (len(word) - b - 1, len(word) - b - 2) if a >= 0 and (a == len(word) - b - 1 or word[a : len(word) - b] in p)], len(word))[::-1]
        want, got = Counter(), Counter()
        for a in range(len(word)):
            for b, q in arcs(a):
                if word[a:b] in p:
                    want[word[a:b]] += 3 * math.exp(ahead[a] + math.log(q) + back[b] - ahead[-1])
        U._expected(automaton, word, p, 3, got, U.STRIDE)
        assert dict(got) == pytest.approx(dict(want), rel=1e-9)


def test_short_words_in_batches_equal_single_words():
    model = U.LanguageModel.train({"x": Counter({"house": 3, "the": 2}), "y": Counter({"mouse": 2, "quick": 1})})
    model.predict("a")
    words = [random_word(k % (U.SHORT_WORD + 1), k) for k in range(500)]
    assert model._short_words(words) == pytest.approx(np.array([model._word(w) for w in words]), rel=1e-12)


def test_word_table_changes_nothing(monkeypatch):
    random.seed(21)
    counts = {"x": Counter({"house": 3, "the": 2}), "y": Counter({"mouse": 2, "quick": 1})}
    texts = [" ".join(random_word(random.choice([1, 2, 5, 30, 90]), random.randrange(200))[1:] for _ in range(random.randint(1, 80))) for _ in range(60)]
    want = [U.LanguageModel.train(counts).predict(t) for t in texts]
    for name, n in (("TABLE_WORDS", 8), ("CHUNK_WORDS", 8), ("BATCH_WORDS", 3)):
        monkeypatch.setattr(U, name, n)
    model = U.LanguageModel.train(counts)
    for text, (lang, score) in zip(texts, want, strict=True):
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(score)
    for k in (1, 7, 60):
        assert [x for a in range(0, 60, k) for x in model.predict_all(texts[a : a + k])] == [model.predict(t) for t in texts]
    assert model.predict_all([]) == [] and model.predict_all(["", "12"]) == [("und", 0.0)] * 2


UNBROKEN = ["x" * 64, "abcdefghijklmnopqrstuvwxyz" * 3, "x" * 1_000_000, "中文字" * 170, "ひらがな" * 12, "".join(chr(0x0E01 + k % 46) for k in range(500)), "ñandú" * 40_000]


def test_unbroken_letters(spark):
    """Runs of letters of any length have a language and a score, among the texts learned from too."""
    rows = [(10 + k, t, "en" if k % 2 else "de") for k, t in enumerate(UNBROKEN)] + [(1, "a plain text", "en"), (2, "ein Text", "de")]
    found = U.language_id(documents(spark, rows)).collect()
    assert len(found) == len(rows) and all(r["lang_pred"] in ("de", "en") and 0 < r["score"] <= 1 for r in found)
    model = U.LanguageModel.train({"x": Counter(["x" * 100_000, "y"]), "y": Counter(["中" * 70])})
    assert all(model.predict(t)[0] in ("x", "y") for t in UNBROKEN)


def test_recent_words_are_bounded_by_characters():
    table = U.Recent(4000)
    for k in range(1000):
        table.put(f"{'w' * 50}{k}", k)
        assert sum(len(x) + U.Recent.ENTRY for x in [*table.young, *table.old]) <= 4000 + 2 * 118
    table.put("w" * 65, 1)
    assert table.get("w" * 65) is None and table.get(f"{'w' * 50}999") == 999


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = U.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r["lang_pred"] == r["lang"] for r in found) / len(found) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_prediction_ignores_label_source_and_id(spark):
    docs = documents(spark)
    model = U.train_language_model(docs)
    a = U.predict_languages(docs, model).select("lang_pred", "score")
    b = U.predict_languages(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.lit(0)}), model).select("lang_pred", "score")
    assert a.exceptAll(b).count() == 0
    rows = {(r["doc_id"], r["lang_pred"]) for r in U.language_id(docs).collect()}
    assert {(k, "und") for k in (2, 3, 4)} <= rows
    held = {r["doc_id"]: r["held_out"] for r in U.language_id(docs).collect()}
    assert held == {i: (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in AWKWARD}


def test_without_labels_nothing_is_told(spark):
    found = U.language_id(documents(spark, [(1, "some text", None), (3, "more", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert U.language_id(documents(spark, [])).count() == 0


# packing


def test_fast_ids_equal_the_library():
    path = public_tokenizers.path(K.TOKENIZER)
    ours, library = K.ByteBpe(path), Tokenizer.from_file(path)
    for text in [*random_texts(2000, 3), "x <|endoftext|> y", " " * 300]:
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 5000):
        text = "a".join(every[k : k + 5000])
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, k


def check_packing(rows, texts, capacity):
    """Whether rows are a right packing of the texts [(id, text)]: whole documents, right cuts, no gap."""
    library = Tokenizer.from_file(public_tokenizers.path(K.TOKENIZER))
    want = Counter()
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_packing(spark):
    n, _ = check_packing(K.pack_documents(documents(spark).repartition(3)).collect(), [(i, t) for i, t, _ in AWKWARD], 2048)
    check_packing(K.pack_documents(documents(spark), capacity=8, open_bins=2, group_bins=3).collect(), [(i, t) for i, t, _ in AWKWARD], 8)
    assert K.pack_documents(documents(spark, [])).count() == 0 and n > 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bins, tokens = check_packing(K.pack_documents(docs).collect(), texts, 2048)
    assert bins <= 1.01 * -(-tokens // 2048)


def test_best_fit_rules():
    packer = K.BestFit(10, 2)
    assert packer.place(6, "a") == ("a", 0) and packer.place(5, "b") == ("b", 0)
    assert packer.place(4, "c") == ("a", 6)  # fills a, the better fit, and so closes it
    assert packer.place(7, "c") == ("c", 0)
    assert packer.place(8, "d") == ("d", 0)  # three would be open: c, the fullest, closes
    assert dict(packer.still_open()) == {"b": 5, "d": 8}
